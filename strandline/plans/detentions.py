"""Crisis intakes: classification, detention sequences, repeat and yearly counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.dates import minute_diff, month_end, month_key_text, month_start
from strandline.functions.labels import count_bucket, flag, ratio, relabel, stamp_in_range, yes_flag
from strandline.operators.relational import in_keys, left_join_many, spread, subset_share
from strandline.operators.sequence import (
    HOT_ROWS, add_gaps, add_year_gaps, first_events, mean_gap, number_events,
)

# Who referred the call, by statutory time limit.
CALL_TYPES = {"6": "ER", "12": "Law Enforcement"}
MAX_MINUTES = 43_200
REVOCATION = "FR"


def detained_codes(disposition_ref: DataFrame, version: str | None = "2021") -> DataFrame:
    """Dispositions that mean detention, of one version of the reference table."""
    out = disposition_ref.filter(F.col("detained") == "Y")
    return out if version is None else out.filter(F.col("version") == version)


# ---- classification ---------------------------------------------------------------

def response_minutes() -> Column:
    """Minutes from face-to-face referral to disposition, capped at 30 days.

    NULL where the referral carries the year-1900 placeholder or comes after the
    disposition.
    """
    minutes = minute_diff("face_ref_stamp", "disposition_stamp")
    return (
        F.when((F.year("face_ref_stamp") == 1900) | (minutes < 0), None)
        .otherwise(F.when(minutes > MAX_MINUTES, MAX_MINUTES).otherwise(minutes))
    )


def response_hours() -> Column:
    """The same in hours, as an exact decimal."""
    return response_minutes().cast("decimal(9,2)") / F.lit(60).cast("decimal(10,0)")


def classify_events(
    intake: DataFrame,
    disposition_ref: DataFrame,
    since=None,
    revocation: str = REVOCATION,
    cohort: DataFrame | None = None,
) -> DataFrame:
    """Intakes with disposition flags, call month, call type and response time.

    Every matching row of the reference table gives a row, so two versions of a
    disposition repeat the intake. ``cohort`` limits to its ``kcid`` values.
    """
    rows = intake.filter(F.col("call_stamp").isNotNull() & F.col("disposition").isNotNull())
    if since is not None:
        rows = rows.filter(F.col("call_stamp") >= F.lit(str(since)).cast("date"))
    if cohort is not None:
        rows = in_keys(rows, "kcid", (cohort, "kcid"))
    rows = rows.join(disposition_ref, "disposition", "left")
    detained = F.col("detained") == "Y"
    return rows.select(
        "intake_no", "kcid", "call_stamp", month_start("call_stamp").alias("call_month"), "disposition", "description",
        relabel("statute_timeline_ind", CALL_TYPES, "N/A").alias("type"),
        response_minutes().alias("response_time_min"),
        response_hours().alias("response_time_hrs"),
        yes_flag("investigation").alias("investigation"),
        yes_flag("detained").alias("detained"),
        flag(detained & (F.col("disposition") != revocation)).alias("new_detained"),
        flag(detained & (F.col("disposition") == revocation)).alias("revoked_detained"),
        yes_flag("voluntary").alias("voluntary"),
        yes_flag("discharge_referral").alias("discharge_referral"),
    )


def monthly_event_count(events: DataFrame, measure: str = "investigation") -> DataFrame:
    """Sum of one flag per call month, labelled by year and month end."""
    return events.groupBy("call_month").agg(F.sum(measure).alias("count")).select(
        F.year("call_month").alias("year"), month_end("call_month").alias("report_date"), "count"
    )


def persons_by_event_year(events: DataFrame, start, end=None, measure: str = "investigation", after: bool = False) -> DataFrame:
    """Distinct (person, year) with the flag set and the call stamp in the period.

    ``after=True`` leaves the start date itself out and has no upper end.
    """
    if after:
        period = F.col("call_stamp") > F.lit(str(start)).cast("date")
    else:
        period = stamp_in_range("call_stamp", start, end)
    return events.filter(period & (F.col(measure) == 1)).select("kcid", F.year("call_month").alias("year")).distinct()


# ---- detention sequences ----------------------------------------------------------

def detained_intakes(intake: DataFrame, disposition_ref: DataFrame, start, end, version: str | None = "2021") -> DataFrame:
    """Distinct detained intakes in a period; ``start=None`` leaves the past open."""
    rows = intake.filter(
        F.col("call_stamp").isNotNull() & F.col("disposition").isNotNull() & stamp_in_range("call_stamp", start, end)
    )
    codes = detained_codes(disposition_ref, version).select("disposition")
    return rows.join(codes, "disposition", "left_semi").select("intake_no", "kcid", "call_stamp").distinct()


def detention_sequence(detained: DataFrame, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Detained intakes with each person's ordinal (same-stamp events share the last)."""
    return number_events(detained, "kcid", "call_stamp", "intake_no", hot_rows=hot_rows).select(
        "intake_no", "kcid", "call_stamp", "ordinal", "prev_stamp"
    )


def episode_gaps(sequence: DataFrame) -> DataFrame:
    """Detention sequence with the prior stamp and the days since it."""
    return add_gaps(sequence).drop("prev_stamp")


def year_gap_history(sequence: DataFrame) -> DataFrame:
    """Detention sequence with call year, prior call year and years between them."""
    return add_year_gaps(sequence.withColumn("call_year", F.year("call_stamp"))).drop("prev_stamp")


def repeat_counts(detained: DataFrame) -> DataFrame:
    """Detentions per person (the person's last ordinal)."""
    return detained.groupBy("kcid").agg(F.count("intake_no").alias("max_ita"))


def repeat_distribution(detained: DataFrame) -> DataFrame:
    """Persons by number of detentions."""
    return repeat_counts(detained).groupBy("max_ita").agg(F.count("kcid").alias("count"))


def repeat_gap_groups(detained: DataFrame) -> DataFrame:
    """Repeaters with their whole-day mean gap and a count group.

    The missing person counts as one, but has no gap: it finds no partner by key.
    """
    rows = mean_gap(detained, "kcid", "call_stamp").filter(F.col("n_events") > 1)
    return rows.select(
        "kcid",
        F.col("n_events").alias("max_ita"),
        F.when(F.col("kcid").isNotNull(), F.col("mean_gap")).alias("av"),
        count_bucket("n_events").alias("grp"),
    )


def overall_mean_gap(detained: DataFrame) -> DataFrame:
    """One row: whole-day mean of all gaps."""
    return mean_gap(detained, "kcid", "call_stamp", by_person=False).withColumnRenamed("mean_gap", "avg")


def new_entrants_by_year(detained: DataFrame) -> DataFrame:
    """First-ever detentions, all detentions and distinct persons per year.

    A person whose first two detentions share a stamp has no first one. Years that
    no first detention falls in are left out.
    """
    entries = (
        first_events(detained, "kcid", "call_stamp", "intake_no").filter(F.col("n_first") == 1)
        .groupBy(F.year("first_stamp").alias("call_year")).agg(F.count("kcid").alias("entry_cnt"))
    )
    totals = detained.groupBy(F.year("call_stamp").alias("call_year")).agg(
        F.count("kcid").alias("total_cnt"), F.countDistinct("kcid").alias("total_cnt_dis")
    )
    return entries.join(totals, "call_year", "left")


def _numbered_petitions(intake: DataFrame, petition: DataFrame, filed_by, hot_rows: int | None, *last: str) -> DataFrame:
    rows = intake.filter(F.col("call_stamp").isNotNull()).select("intake_no", "kcid", "call_stamp")
    if filed_by is None:
        rows = left_join_many(rows, petition.select("intake_no", "petition_no", "file_date"), "intake_no")
    else:
        rows = rows.join(petition.filter(F.col("file_date") <= F.lit(str(filed_by)).cast("date")), "intake_no")
    rows = rows.select("petition_no", "file_date", "intake_no", "kcid", "call_stamp").distinct()
    return number_events(rows, "kcid", "call_stamp", ["intake_no", "petition_no", *last], hot_rows=hot_rows).select(
        "petition_no", "file_date", "intake_no", "kcid", "call_stamp", F.year("call_stamp").alias("call_year"), "ordinal", "prev_stamp"
    )


def petition_history(intake: DataFrame, petition: DataFrame, filed_by=None, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Intakes with their petitions, numbered per person by call stamp.

    ``filed_by`` keeps petitions filed up to that date (and so drops intakes without).
    """
    return _numbered_petitions(intake, petition, filed_by, hot_rows).drop("prev_stamp")


def petition_year_gaps(intake: DataFrame, petition: DataFrame, filed_by=None, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Petition history with the year of the row before and the years since it.

    Rows of one stamp follow each other by intake, petition and filing date.
    """
    return add_year_gaps(_numbered_petitions(intake, petition, filed_by, hot_rows, "file_date")).drop("prev_stamp")


def nth_event_by_year(history: DataFrame) -> DataFrame:
    """Events by their ordinal (1st … 5th and later), total and distinct, per year.

    Only years with a 1st event appear; an ordinal absent from a year is NULL.
    """
    n = F.col("ordinal")

    def how_many(c: str, at) -> Column:
        return F.when(F.count(F.when(at, 1)) > 0, F.count(F.when(at, F.col(c))))

    return (
        history.groupBy("call_year")
        .agg(
            how_many("intake_no", n == 1).alias("cnt_1st"),
            how_many("intake_no", n == 2).alias("cnt_2nd"),
            how_many("kcid", n == 3).alias("cnt_3rd"),
            how_many("kcid", n == 4).alias("cnt_4th"),
            how_many("kcid", n > 4).alias("cnt_5plus"),
            F.count("intake_no").alias("total_cnt"),
            F.countDistinct("intake_no").alias("total_cnt_dis"),
        )
        .filter(F.col("cnt_1st").isNotNull())
    )


def plan_share_by_month(
    intake: DataFrame, disposition_ref: DataFrame, monthly_coverage: DataFrame, start, end, plan: str
) -> DataFrame:
    """Detained intakes of a plan's members and all detained intakes per call month.

    An intake covered by two plans in its month counts once under each flag value.
    """
    detained = detained_intakes(intake, disposition_ref, start, end).withColumn("call_month", month_key_text("call_stamp"))
    cover = monthly_coverage.select("kcid", F.col("census_month").alias("call_month"), "mco")
    tagged = (
        detained.join(cover, ["kcid", "call_month"], "left")
        .select("intake_no", "kcid", "call_stamp", "call_month", flag(F.col("mco") == plan).alias("in_plan"))
        .distinct()
    )
    return subset_share(tagged, ["call_month"], "intake_no", F.col("in_plan") == 1).select(
        "call_month", F.col("subset_count").alias("plan_count"), "total_count"
    )


def detentions_by_type_year(intake: DataFrame, disposition_ref: DataFrame, start, end) -> DataFrame:
    """Detentions and distinct members per year and disposition type.

    All versions of the reference table count, each as a row of its own.
    """
    rows = intake.filter(F.col("disposition").isNotNull() & stamp_in_range("call_stamp", start, end))
    rows = rows.join(detained_codes(disposition_ref, None).select("disposition", "disposition_type"), "disposition")
    return rows.groupBy(F.year("call_stamp").alias("year"), "disposition_type").agg(
        F.count(F.lit(1)).alias("count_ita"), F.countDistinct("kcid").alias("count_unique_mbr")
    )


def metric_rate(metrics: DataFrame, top: str, bottom: str) -> DataFrame:
    """Metrics side by side per report date, and top / bottom."""

    return spread(metrics, ["report_date"], "met_abbr", "count", [top, bottom], only_listed=True).withColumn("pct", ratio(top, bottom))
