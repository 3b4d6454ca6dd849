"""Race, ethnicity and age roll-ups. 0.5 marks a value that cannot be classified.

Expects one row per person, so every recode is an expression on the row: only the
final counts shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.dates import age_group, age_years
from strandline.functions.labels import first_max_label, row_sum
from strandline.operators.relational import distinct_with_null, spread
from strandline.operators.sequence import first_events

# The flags summed per person, and the order that breaks ties for a label.
SUMMED = ["AIAN", "Asian", "BlackAA", "MENA", "NHPI", "Other", "White", "unknown"]
LABEL_ORDER = ["AIAN", "Asian", "BlackAA", "MENA", "NHPI", "White", "Other", "unknown"]


def recode_ethnicity(demographics: DataFrame) -> DataFrame:
    """Adds ``hisp`` and ``unknown`` as 0 / 1 / 0.5."""
    return demographics.selectExpr(
        "*",
        "CASE WHEN hispanic = 'yes' THEN 1D WHEN hispanic IN ('no', 'unknown') THEN 0D ELSE 0.5D END AS hisp",
        """CASE WHEN Unknown_Race = 1 AND hispanic IN ('yes', 'no', 'unknown') THEN 1D
                WHEN Unknown_Race = 0 AND hispanic = 'unknown' THEN 1D
                WHEN Unknown_Race = 0 AND hispanic IN ('yes', 'no') THEN 0D ELSE 0.5D END AS unknown""",
    )


def multiple_race_flag(recoded: DataFrame) -> DataFrame:
    """Adds ``sum_race`` and ``multiple_NH`` (several races and not Hispanic)."""
    return recoded.withColumn("sum_race", row_sum(SUMMED)).selectExpr(
        "*",
        """CASE WHEN (Multiple_race = 1 OR sum_race > 1) AND hisp IN (0, 1) THEN 1D - hisp
                WHEN Multiple_race = 0 AND sum_race IN (0, 1) AND hisp IN (0, 1) THEN 0D ELSE 0.5D END AS multiple_NH""",
    )


def _single(zero_label: str | None) -> Column:
    label = first_max_label(LABEL_ORDER)
    if zero_label is None:
        return label
    return F.when(F.greatest(*LABEL_ORDER) == 0, zero_label).otherwise(label)


def _labelled(rows: DataFrame, race: Column) -> DataFrame:
    return rows.select("kcid", race.alias("race")).filter("race IS NOT NULL")


def single_race_label(flagged: DataFrame, zero_label: str | None = None) -> DataFrame:
    """Label of the first largest race flag of single-race, non-Hispanic persons.

    Flags that are all zero give the first label in order, or ``zero_label``.
    """
    return _labelled(flagged.filter("hisp = 0 AND multiple_NH = 0"), _single(zero_label))


def race_rollup(flagged: DataFrame, zero_label: str | None = None) -> DataFrame:
    """One label per person; persons that cannot be classified give no row."""
    race = F.expr("CASE WHEN hisp = 1 THEN 'Hispanic' WHEN hisp = 0 AND multiple_NH = 1 THEN 'Multi-Race,NH' END")
    single = F.when(F.expr("hisp = 0 AND multiple_NH = 0"), _single(zero_label))
    return _labelled(flagged, F.coalesce(race, single))


def race_summary(persons: DataFrame, labels: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Distinct persons per race (persons without a label under NULL), per ``by`` group."""
    return persons.join(labels, "kcid", "left").groupBy(*by, "race").agg(distinct_with_null("kcid").alias("count"))


def race_summary_wide(persons: DataFrame, labels: DataFrame, years: Sequence[int]) -> DataFrame:
    """Race by year, one column per year."""
    wide = spread(race_summary(persons, labels, ["year"]), ["race"], "year", "count", years)
    return wide.select("race", *[F.col(f"`{y}`").alias(f"y{y}") for y in years])


def first_dates_of_repeaters(detained: DataFrame) -> DataFrame:
    """(person, date) of the first event of persons with more than one event.

    Persons whose first events share a stamp have no first one.
    """
    return (
        first_events(detained, "kcid", "call_stamp", "intake_no")
        .filter(F.col("kcid").isNotNull() & (F.col("n_first") == 1) & (F.col("n_events") > 1))
        .select("kcid", F.col("first_stamp").cast("date").alias("call_date"))
    )


def age_at_first_event(first_dates: DataFrame, demographics: DataFrame) -> DataFrame:
    """Distinct persons per age group on their first date."""
    aged = first_dates.join(demographics.select("kcid", "dob"), "kcid", "left").select(
        "kcid", age_group(age_years("dob", "call_date")).alias("age_group")
    )
    return aged.groupBy("age_group").agg(distinct_with_null("kcid").alias("count"))
