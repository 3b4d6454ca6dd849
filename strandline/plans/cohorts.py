"""Program cohorts, their claims and outcomes, and listed persons' stays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.dates import as_date, day_diff
from strandline.functions.labels import either_in_period, lasted_or_open
from strandline.operators.relational import code_rows, conditional_cap, in_keys, with_code_in

CANCELLED = "CX"


def program_cohort(
    auth: DataFrame, crosswalk: DataFrame, program: str, start_from, start_before, min_days: int = 180
) -> DataFrame:
    """Authorisations of a program that lasted ``min_days`` or are open, with the external id."""
    rows = auth.filter(
        (F.col("program") == program)
        & (F.col("start_date") >= as_date(start_from))
        & (F.col("start_date") < as_date(start_before))
        & lasted_or_open("start_date", "expire_date", min_days)
        & (F.col("status_code") != CANCELLED)
    )
    return rows.join(crosswalk.select("kcid", "p1_id"), "kcid").select(
        "auth_no", "agency_id", "kcid", "p1_id", "status_code", "status_reason", "start_date", "expire_date",
        F.lit(0).alias("capped_end"),
    )


def cap_open_end(cohort: DataFrame, cutoff, cap) -> DataFrame:
    """Flag and cap end dates that are missing or at/after the cutoff."""
    return conditional_cap(cohort, "expire_date", cutoff, cap, "capped_end")


def cohort_inpatient_claims(
    claim_line: DataFrame,
    claim_header: DataFrame,
    codes: DataFrame,
    cohort: DataFrame,
    version: str = "2020",
    header_columns: Sequence[str] = ("admit_date",),
    line_columns: Sequence[str] = (),
    need_header: bool = False,
) -> DataFrame:
    """Claims of cohort members with an inpatient revenue code, with header dates.

    ``need_header`` drops claims without a header; otherwise their dates are NULL.
    """
    lines = claim_line.select("id_mcaid", "claim_header_id", "rev_code", *[F.col(c).alias(f"ln_{c}") for c in line_columns])
    lines = with_code_in(lines, "rev_code", code_rows(codes, ["Inpatient Stay"], "UBREV", version))
    lines = in_keys(lines.drop("rev_code"), "id_mcaid", (cohort, "p1_id"))
    header = claim_header.select(
        "claim_header_id", F.col("admsn_date").alias("admit_date"), F.col("dschrg_date").alias("discharge_date"),
        "first_service_date", "last_service_date",
    ).select("claim_header_id", *header_columns)
    return lines.join(header, "claim_header_id", "inner" if need_header else "left").select(
        "id_mcaid", "claim_header_id", *header_columns, *[f"ln_{c}" for c in line_columns]
    ).distinct()


def attach_person_id(claims: DataFrame, cohort: DataFrame) -> DataFrame:
    """Claims with every person id their external id stands for."""
    ids = cohort.select("p1_id", "kcid").distinct()
    return claims.withColumnRenamed("id_mcaid", "p1_id").join(ids, "p1_id").select(
        "p1_id", "kcid", "claim_header_id", "admit_date"
    ).distinct()


def outcome_flag(cohort: DataFrame, claims: DataFrame) -> DataFrame:
    """Each cohort row with 1 if its external id has a claim, else 0."""
    had = claims.select(F.col("id_mcaid").alias("p1_id"), F.lit(1).alias("flag")).distinct()
    return cohort.select("p1_id").join(had, "p1_id", "left").select("p1_id", F.coalesce("flag", F.lit(0)).alias("flag"))


def listed_person_stays(
    stay: DataFrame, auth: DataFrame, ip_master: DataFrame, persons: DataFrame, start, end,
    ip_type: str = "I", status: str = "AA",
) -> DataFrame:
    """Stays of listed persons (under either id) that begin or end in the period."""
    listed = in_keys(auth.filter(F.col("status_code") == status), "kcid", (persons, "kcid"), (persons, "kcid2"))
    typed = ip_master.filter(F.col("ip_type") == ip_type).select("auth_no")
    return (
        stay.filter(either_in_period("discharge_date", "admit_date", start, end))
        .select("auth_no", "agency_id", "admit_date", "discharge_date")
        .join(listed.select("auth_no", "kcid"), "auth_no").join(typed, "auth_no")
        .select("kcid", "admit_date", "discharge_date", "agency_id", day_diff("admit_date", "discharge_date").alias("los_days"))
    )


# ---- data checks ------------------------------------------------------------------

def code_set_inventory(codes: DataFrame, names: Sequence[str]) -> DataFrame:
    """Number of codes per version, value set and code system."""
    return codes.filter(F.col("value_set_name").isin(*names)).groupBy("version", "value_set_name", "code_system").agg(
        F.count("code").alias("n_codes")
    )


def code_dictionary_lookup(code_dict: DataFrame, column_name: str | None = None, codes: Sequence[str] | None = None) -> DataFrame:
    """Dictionary rows of one column, or of some codes, in column order."""
    if column_name is not None:
        code_dict = code_dict.filter(F.col("column_name") == column_name)
    if codes is not None:
        code_dict = code_dict.filter(F.col("code_id").isin(*codes))
    return code_dict.orderBy("column_name", "code_id")


def column_mismatch_check(df: DataFrame, left: str, right: str) -> DataFrame:
    """Rows whose two values differ; rows missing either are not reported."""
    return df.filter(F.col(left) != F.col(right))


def null_date_profile(claims: DataFrame, column: str = "discharge_date", other: str = "last_service_date") -> DataFrame:
    """Distinct claims with and without a date, and the extremes of another date in each."""
    return claims.groupBy(F.col(column).isNull().cast("int").alias("is_missing")).agg(
        F.countDistinct("claim_header_id").alias("cnt"), F.min(other).alias("min_date"), F.max(other).alias("max_date")
    )
