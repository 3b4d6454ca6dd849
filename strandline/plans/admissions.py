"""Hospital admissions by legal status and payer, across two person id systems."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.dates import day_diff, half_year, month_key_int, same_month
from strandline.functions.labels import facility_type, fallback_in_range, flag, in_closed_range
from strandline.operators.relational import (
    code_rows, first_ranks, in_keys, left_join_in_range, left_join_many, level_counts, not_in_keys, pivot_ranks, rows_in_both,
    rows_only_in_first, with_code_in,
)
from strandline.plans.cohorts import CANCELLED
from strandline.sources.sinks import written_step

# Diagnosis sets that make a mental health admission, and community agencies.
MENTAL_HEALTH_SETS = ["Mental Health Diagnosis", "Mental Illness", "Intentional Self-Harm"]
ET_AGENCIES = ["058", "481", "482", "486", "605", "781", "947", "948", "961", "968", "991"]
ACTIVE = ["TM", "AA"]


# ---- claims side ------------------------------------------------------------------

def inpatient_stays(claim_line: DataFrame, claim_header: DataFrame, codes: DataFrame, start, end, version: str = "2020") -> DataFrame:
    """Distinct claims with an inpatient revenue code; the admission date is NULL
    unless it (or, where missing, the service date) lies in the period."""
    lines = with_code_in(claim_line, "rev_code", code_rows(codes, ["Inpatient Stay"], "UBREV", version))
    header = claim_header.select("claim_header_id", "admsn_date", "first_service_date")
    return left_join_in_range(
        lines.select("id_mcaid", "claim_header_id"), header, "claim_header_id", fallback_in_range("admsn_date", "first_service_date", start, end)
    ).select("id_mcaid", "claim_header_id", F.col("admsn_date").alias("admit_date")).distinct()


def principal_dx_claims(
    claim_dx: DataFrame, claim_header: DataFrame, codes: DataFrame, start, end,
    sets: Sequence[str] = tuple(MENTAL_HEALTH_SETS),
) -> DataFrame:
    """Distinct claims whose principal ICD-10 diagnosis is in the value sets.

    Id, claim and date come from the header in the period, so claims outside give
    one all-NULL row.
    """
    dx = claim_dx.filter((F.col("icdcm_version") == 10) & (F.col("icdcm_number") == "01"))
    dx = with_code_in(dx, "icdcm_norm", code_rows(codes, sets, "ICD10CM")).select("claim_header_id")
    header = claim_header.filter(in_closed_range("admsn_date", start, end)).select(
        "claim_header_id", "id_mcaid", F.col("claim_header_id").alias("header_claim"), F.col("admsn_date").alias("admit_date")
    )
    return dx.join(header, "claim_header_id", "left").select(
        "id_mcaid", F.col("header_claim").alias("claim_header_id"), "admit_date"
    ).distinct()


def inpatient_mh_claims(
    claim_line: DataFrame, claim_dx: DataFrame, claim_header: DataFrame, codes: DataFrame, start, end, version: str = "2020",
    sets: Sequence[str] = tuple(MENTAL_HEALTH_SETS),
) -> DataFrame:
    """Claims that are both inpatient stays and mental health claims of the period, with one read of the headers.

    Equal to ``inpatient_mh`` of the two: lines and diagnoses meet the headers in one join, and
    rows found on both sides are those of either kind in one grouping.
    """
    lines = with_code_in(claim_line, "rev_code", code_rows(codes, ["Inpatient Stay"], "UBREV", version))
    dx = claim_dx.filter((F.col("icdcm_version") == 10) & (F.col("icdcm_number") == "01"))
    dx = with_code_in(dx, "icdcm_norm", code_rows(codes, sets, "ICD10CM"))
    # Lines are dealt by claim and person: sides of unlike partitioning are found in tasks of their own.
    # Of like partitioning, one task would sort the inputs of both sides and the headers at a time.
    found_lines = lines.select("claim_header_id", F.col("id_mcaid").alias("_line_id"), F.lit(True).alias("_stay")).distinct()
    found_dx = dx.select("claim_header_id", F.lit(None).cast(claim_line.schema["id_mcaid"].dataType).alias("_line_id"), F.lit(False).alias("_stay")).distinct()
    asked = found_lines.repartition("claim_header_id", "_line_id").unionByName(found_dx)
    header = claim_header.select("claim_header_id", "id_mcaid", "admsn_date", "first_service_date", F.lit(True).alias("_there"))
    rows = asked.join(header, "claim_header_id", "left")
    stay, found = F.col("_stay"), F.col("_there") & in_closed_range("admsn_date", start, end)
    in_period = fallback_in_range("admsn_date", "first_service_date", start, end)
    sides = rows.select(
        F.when(stay, F.col("_line_id")).when(found, F.col("id_mcaid")).alias("id_mcaid"),
        F.when(stay | found, F.col("claim_header_id")).alias("claim_header_id"),
        F.when(F.when(stay, in_period).otherwise(found), F.col("admsn_date")).alias("admit_date"), "_stay",
    )
    both = sides.groupBy("id_mcaid", "claim_header_id", "admit_date").agg(F.bool_or("_stay").alias("_a"), F.bool_and("_stay").alias("_b"))
    return both.where("_a AND NOT _b").drop("_a", "_b")


def inpatient_mh(stays: DataFrame, mh_claims: DataFrame) -> DataFrame:
    """Claims in both sets (whole rows; NULL equals NULL)."""
    return rows_in_both(stays, mh_claims)


# ---- authorisation side -----------------------------------------------------------

def status_in(codes: Sequence[str] = tuple(ACTIVE)) -> Column:
    return F.col("status_code").isin(*codes)


def status_not(code: str = CANCELLED) -> Column:
    return F.col("status_code") != code


def _admissions(auth, stay, records, status, program, start, end, cohort):
    rows = auth.filter(status)
    if program is not None:
        rows = rows.filter(F.col("program") == program)
    if cohort is not None:
        rows = in_keys(rows, "kcid", (cohort, "kcid"))
    # A legal record only has to exist, so it cannot repeat an admission.
    rows = in_keys(rows, "auth_no", (records, "auth_no")).select("auth_no", "kcid")
    if start is not None:
        stay = stay.filter(in_closed_range("admit_date", start, end))
    return rows.join(stay.select("auth_no", "admit_date", "agency_id"), "auth_no")


def involuntary_admissions(
    auth: DataFrame, stay: DataFrame, ip_invol: DataFrame, status: Column, program: str | None = None,
    start=None, end=None, cohort: DataFrame | None = None,
) -> DataFrame:
    """Distinct stays under an authorisation with an involuntary record."""
    rows = _admissions(auth, stay, ip_invol, status, program, start, end, cohort)
    return rows.select("auth_no", "kcid", "admit_date", F.lit(1).alias("invol_flag"), "agency_id").distinct()


def voluntary_admissions(
    auth: DataFrame, stay: DataFrame, ip_vol: DataFrame, status: Column, program: str | None = None,
    start=None, end=None, by_auth: bool = True,
) -> DataFrame:
    """Distinct stays with a voluntary record; ``by_auth=False`` counts two
    authorisations of one person, day and agency once."""
    rows = _admissions(auth, stay, ip_vol, status, program, start, end, None)
    if by_auth:
        return rows.select("auth_no", "kcid", "admit_date", F.lit(0).alias("invol_flag"), "agency_id").distinct()
    return rows.select("kcid", "admit_date", F.lit(1).alias("vol_flag"), "agency_id").distinct()


def recorded_admissions(auth: DataFrame, stay: DataFrame, ip_invol: DataFrame, ip_vol: DataFrame, status: Column, start, end) -> DataFrame:
    """Distinct stays of the period under an authorisation with a legal record, and which kinds it has."""
    kinds = ip_invol.select("auth_no", F.lit(True).alias("_i")).unionByName(ip_vol.select("auth_no", F.lit(False).alias("_i")))
    kinds = kinds.groupBy("auth_no").agg(F.bool_or("_i").alias("involuntary"), F.bool_or(~F.col("_i")).alias("voluntary"))
    stays = stay.filter(in_closed_range("admit_date", start, end)).select("auth_no", "admit_date", "agency_id")
    return auth.filter(status).select("auth_no", "kcid").join(kinds, "auth_no").join(stays, "auth_no").select(
        "auth_no", "kcid", "admit_date", "agency_id", "involuntary", "voluntary").distinct()


def admissions_by_year(stays: DataFrame, flag_column: str, person: str = "kcid") -> DataFrame:
    """Stays and distinct members per admit year."""
    return stays.groupBy(F.year("admit_date").alias("admit_year")).agg(
        F.sum(flag_column).alias("count_inpatient_stay"), F.countDistinct(person).alias("count_unique_mbr")
    )


def admissions_by_half_year(stays: DataFrame, flag_column: str, person: str = "kcid") -> DataFrame:
    """Stays and distinct members per admit year and half."""
    return stays.groupBy(F.year("admit_date").alias("admit_year"), half_year("admit_date").alias("admit_time")).agg(
        F.sum(flag_column).alias("count_inpatient_stay"), F.countDistinct(person).alias("count_unique_mbr")
    )


def admissions_by_level(stays: DataFrame, flag_column: str, person: str = "kcid") -> DataFrame:
    """Stays and distinct members per admit half, per year, per agency and year, and of all, from one shuffle of the members."""
    dated = stays.select(
        person, flag_column, "agency_id", F.year("admit_date").alias("admit_year"), half_year("admit_date").alias("admit_time")
    )
    levels = {"half": ["admit_year", "admit_time"], "year": ["admit_year"], "agency": ["agency_id", "admit_year"], "all": []}
    return level_counts(dated, levels, person, F.col(flag_column), ("count_inpatient_stay", "count_unique_mbr"))


# ---- coverage and id crosswalk ----------------------------------------------------

def coverage_months(
    coverage: DataFrame, persons: DataFrame | None = None, plan: str = "F19", label: str = "Medicaid"
) -> DataFrame:
    """Months with a coverage row of the plan inside one month, of listed or all persons."""
    rows = coverage.filter((F.col("plan") == plan) & same_month("start_date", "end_date"))
    if persons is not None:
        rows = in_keys(rows, "kcid", (persons, "kcid"))
    return rows.select(
        "kcid", month_key_int("start_date").alias("census_month"), F.lit(label).alias("coverage_plan")
    ).distinct()


def coverage_flag(stays: DataFrame, months: DataFrame, label: str = "Medicaid") -> DataFrame:
    """Admissions with 1 where the person is covered in the admission month."""
    return (
        stays.withColumn("census_month", month_key_int("admit_date"))
        .join(months, ["kcid", "census_month"], "left")
        .select("auth_no", "kcid", "admit_date", "agency_id",
                flag(F.col("coverage_plan") == label).alias("medicaid_flag"), "invol_flag")
        .distinct()
    )


def id_crosswalk_wide(crosswalk: DataFrame, persons: DataFrame, keep: int = 3) -> DataFrame:
    """The first ``keep`` person ids of each external id, by post time, side by side."""
    ranked = first_ranks(in_keys(crosswalk, "kcid", (persons, "kcid")), "p1_id", ["post_stamp", "kcid"], keep)
    return pivot_ranks(ranked, "p1_id", "row_num", "kcid", range(1, keep + 1), "kcid_")


def attach_external_id(stays: DataFrame, wide: DataFrame) -> DataFrame:
    """Admissions with each external id that lists the person first."""
    ids = wide.select(F.col("kcid_1").alias("kcid"), "p1_id")
    return left_join_many(stays, ids, "kcid").select(*stays.columns, "p1_id")


def voluntary_by_difference(mh_claims: DataFrame, invol_with_id: DataFrame) -> DataFrame:
    """Mental health (id, date) pairs that are no covered involuntary admission."""
    covered = invol_with_id.filter(F.col("medicaid_flag") == 1).select("p1_id", "admit_date")
    pairs = rows_only_in_first(mh_claims.select(F.col("id_mcaid").alias("p1_id"), "admit_date"), covered)
    return pairs.select("*", F.lit(0).alias("invol_flag"), F.lit(1).alias("medicaid_flag"))


def voluntary_combined(mcaid: DataFrame, other: DataFrame) -> DataFrame:
    """Voluntary admissions of both id systems, tagged by system."""
    def tagged(df, key, covered, kind):
        return df.select(
            F.col(key).cast("string").alias("id"), "admit_date", "invol_flag", covered.alias("medicaid_flag"),
            F.lit(1).alias("vol_flag"), F.lit(kind).alias("id_type"),
        )

    return tagged(mcaid, "p1_id", F.col("medicaid_flag"), "P1").union(tagged(other, "kcid", F.lit(0), "KC")).distinct()


def covered_match_rate(invol_with_id: DataFrame, mh_claims: DataFrame) -> DataFrame:
    """Covered involuntary (person, date) pairs by presence among the claims."""
    seen = mh_claims.select(F.col("id_mcaid").alias("p1_id"), "admit_date", F.lit(1).alias("_seen")).distinct()
    return (
        invol_with_id.filter(F.col("medicaid_flag") == 1)
        .join(seen, ["p1_id", "admit_date"], "left")
        .select("kcid", "admit_date", "medicaid_flag", "invol_flag", F.coalesce("_seen", F.lit(0)).alias("p1_flag"))
        .distinct().groupBy("p1_flag").agg(F.count(F.lit(1)).alias("n"))
    )


@dataclass
class AdmissionChain:
    """Inpatient claims, involuntary and voluntary admissions and their match, from the tables of both id systems.

    Each step is planned once, when it is first asked for. Steps that several others use are
    written once to the session's shared folder and read from there, so their inputs are not
    read again and a lost executor costs no more than the step at hand.
    """

    claim_line: DataFrame
    claim_dx: DataFrame
    claim_header: DataFrame
    codes: DataFrame
    auth: DataFrame
    stay: DataFrame
    ip_invol: DataFrame
    ip_vol: DataFrame
    coverage: DataFrame
    crosswalk: DataFrame
    start: str
    end: str
    status: Column | None = None

    @cached_property
    def inpatient_mh(self) -> DataFrame:
        return inpatient_mh_claims(self.claim_line, self.claim_dx, self.claim_header, self.codes, self.start, self.end)

    @cached_property
    def admissions(self) -> DataFrame:
        """Used by both kinds, the coverage flag and the id crosswalk: written."""
        return written_step(recorded_admissions(self.auth, self.stay, self.ip_invol, self.ip_vol, self._status, self.start, self.end), "admissions")

    @cached_property
    def involuntary(self) -> DataFrame:
        return self.admissions.where("involuntary").select("auth_no", "kcid", "admit_date", F.lit(1).alias("invol_flag"), "agency_id")

    @cached_property
    def voluntary(self) -> DataFrame:
        return self.admissions.where("voluntary").select("auth_no", "kcid", "admit_date", F.lit(0).alias("invol_flag"), "agency_id")

    @cached_property
    def covered(self) -> DataFrame:
        # The join itself picks the months of these persons: no need to list them first.
        return coverage_flag(self.involuntary, coverage_months(self.coverage))

    @cached_property
    def crosswalk_wide(self) -> DataFrame:
        """Counted for heavy persons and joined: written."""
        return written_step(id_crosswalk_wide(self.crosswalk, self.involuntary), "crosswalk")

    @cached_property
    def involuntary_with_id(self) -> DataFrame:
        return attach_external_id(self.covered, self.crosswalk_wide)

    @cached_property
    def voluntary_mcaid(self) -> DataFrame:
        return voluntary_by_difference(self.inpatient_mh, self.involuntary_with_id)

    @cached_property
    def voluntary_all(self) -> DataFrame:
        return voluntary_combined(self.voluntary_mcaid, self.voluntary)

    @cached_property
    def match_rate(self) -> DataFrame:
        return covered_match_rate(self.involuntary_with_id, self.inpatient_mh)

    @property
    def _status(self) -> Column:
        return status_in() if self.status is None else self.status


# ---- residential stays and length of stay -----------------------------------------

def residential_stays(
    stay: DataFrame, auth: DataFrame, program: str = "SRS", auth_type: str = "IP",
    cohort: DataFrame | None = None, start=None, end=None,
) -> DataFrame:
    """Distinct residential stays that were not cancelled, with length of stay."""
    rows = auth.filter((F.col("program") == program) & (F.col("auth_type") == auth_type) & status_not())
    if cohort is not None:
        rows = in_keys(rows, "kcid", (cohort, "kcid"))
    if start is not None:
        stay = stay.filter(in_closed_range("admit_date", start, end))
    return stay.join(rows.select("auth_no", "kcid", "auth_type", "program"), "auth_no").select(
        "auth_no", "kcid", "auth_type", "program", "agency_id", "admit_date", "discharge_date",
        day_diff("admit_date", "discharge_date").alias("length_of_stay"), "stay_no",
    ).distinct()


def residential_admissions(stays: DataFrame) -> DataFrame:
    """Residential admissions as distinct (authorisation, person, agency, day) with a flag."""
    return stays.select("auth_no", "kcid", "agency_id", "admit_date").distinct().withColumn("flag", F.lit(1))


def residential_by_year(stays: DataFrame) -> DataFrame:
    """Residential admissions per admit year."""
    return stays.groupBy(F.year("admit_date").alias("admit_year")).agg(F.count("admit_date").alias("count_sud"))


def stay_length_by_facility(
    stay: DataFrame, auth: DataFrame, ip_master: DataFrame, excluded: DataFrame, cohort: DataFrame,
    agencies: Sequence[str] = tuple(ET_AGENCIES), ip_type: str = "I", status: str = "AA",
) -> DataFrame:
    """Cohort members' involuntary stays outside the excluded list, with length and facility type."""
    rows = in_keys(auth.filter(F.col("status_code") == status), "kcid", (cohort, "kcid")).select("auth_no", "kcid")
    typed = ip_master.filter(F.col("ip_type") == ip_type).select("auth_no")
    return (
        not_in_keys(stay.join(rows, "auth_no").join(typed, "auth_no"), "stay_no", excluded, "stay_no")
        .select("kcid", "auth_no", "admit_date", "discharge_date",
                day_diff("admit_date", "discharge_date").alias("length_of_stay"),
                facility_type("agency_id", agencies).alias("facility_type"))
    )
