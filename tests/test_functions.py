"""Boundary date arithmetic, labels and predicates on hand-made rows."""

from datetime import date, datetime

import pytest

from strandline.functions import dates, labels
from strandline.operators import relational as rel


def one(spark, schema, row, expr):
    return spark.createDataFrame([row], schema).select(expr.alias("x")).first().x


@pytest.mark.parametrize("a, b, months", [
    (date(2020, 1, 31), date(2020, 2, 1), 1), (date(2019, 12, 31), date(2020, 2, 1), 2),
    (date(2020, 3, 1), date(2020, 2, 29), -1), (date(2020, 1, 1), date(2020, 1, 31), 0), (None, date(2020, 1, 1), None),
])
def test_month_diff_counts_boundaries(spark, a, b, months):
    assert one(spark, "a date, b date", (a, b), dates.month_diff("a", "b")) == months


@pytest.mark.parametrize("a, b, minutes", [
    (datetime(2020, 1, 1, 23, 0, 59), datetime(2020, 1, 1, 23, 1, 0), 1),
    (datetime(2020, 1, 1, 23, 0, 0), datetime(2020, 1, 1, 23, 0, 59), 0),
    (datetime(2020, 3, 8, 1, 0), datetime(2020, 3, 8, 4, 0), 180),  # clocks change here: stamps have no zone
    (datetime(2020, 1, 2, 0, 1), datetime(2020, 1, 1, 23, 59), -2),
])
def test_minute_diff_counts_boundaries(spark, a, b, minutes):
    assert one(spark, "a timestamp_ntz, b timestamp_ntz", (a, b), dates.minute_diff("a", "b")) == minutes


@pytest.mark.parametrize("birth, on, age", [
    (date(2000, 2, 29), date(2001, 2, 28), 0), (date(2000, 2, 29), date(2001, 3, 1), 1),
    (date(1990, 6, 15), date(2020, 6, 14), 29), (date(1990, 6, 15), date(2020, 6, 15), 30), (None, date(2020, 1, 1), None),
])
def test_age_is_completed_years(spark, birth, on, age):
    assert one(spark, "a date, b date", (birth, on), dates.age_years("a", "b")) == age


def test_age_groups(spark):
    ages = [None, 0, 17, 18, 24, 25, 34, 35, 44, 45, 54, 55, 64, 65, 99]
    df = spark.createDataFrame([(a,) for a in ages], "a int").select(dates.age_group("a").alias("g"))
    assert [r.g for r in df.collect()] == [
        "0.5", "<18", "<18", "18-24", "18-24", "25-34", "25-34", "35-44", "35-44", "45-54", "45-54", "55-64", "55-64", "65+", "65+"
    ]


def test_month_ends_and_keys(spark):
    d = date(2019, 12, 31)
    assert one(spark, "a date", (d,), dates.add_months("a", 2)) == date(2020, 2, 29)
    assert one(spark, "a date", (d,), dates.month_start("a")) == date(2019, 12, 1)
    assert one(spark, "a timestamp_ntz", (datetime(2020, 2, 10, 23, 59),), dates.month_end("a")) == date(2020, 2, 29)
    assert one(spark, "a timestamp_ntz", (datetime(2020, 2, 10, 23, 59),), dates.month_key_text("a")) == "2020-02"
    assert one(spark, "a date", (d,), dates.month_key_int("a")) == 201912


def test_half_year_of_a_missing_date(spark):
    assert one(spark, "a date", (None,), dates.half_year("a")) == "What"


def test_end_day_counts_only_at_midnight(spark):
    rows = [(datetime(2020, 12, 31),), (datetime(2020, 12, 31, 0, 1),), (datetime(2020, 1, 1),), (datetime(2019, 12, 31, 23, 59),), (None,)]
    df = spark.createDataFrame(rows, "a timestamp_ntz").filter(labels.stamp_in_range("a", "2020-01-01", "2020-12-31"))
    assert sorted(r.a for r in df.collect()) == [datetime(2020, 1, 1), datetime(2020, 12, 31)]


def test_unknown_conditions_fall_to_else(spark):
    assert one(spark, "a string", (None,), labels.yes_flag("a")) == 0
    assert one(spark, "a string", (None,), labels.facility_type("a", ["1"])) == "OTHER"
    assert one(spark, "a string", ("x",), labels.relabel("a", {"y": "z"})) is None
    assert one(spark, "a int", (1,), labels.count_bucket("a")) == "whut"


def test_ratio_and_row_sum(spark):
    assert one(spark, "a bigint, b bigint", (1, 0), labels.ratio("a", "b")) is None
    assert one(spark, "a int, b int", (1, None), labels.row_sum(["a", "b"])) is None


def test_first_max_label(spark):
    rows = [(0, 1, 1), (0, 0, 0), (None, 0, 0), (None, None, None), (0, None, 2)]
    df = spark.createDataFrame(rows, "a int, b int, c int").select(labels.first_max_label(["a", "b", "c"]).alias("l"))
    assert [r.l for r in df.collect()] == ["b", "a", "b", None, "c"]


def test_arg_max_matches_and_drops_all_missing(spark):
    rows = [(1, 0, 1, 1), (2, 0, 0, 0), (3, None, 0, 0), (4, None, None, None)]
    df = rel.arg_max(spark.createDataFrame(rows, "k int, a int, b int, c int"), "k", ["a", "b", "c"], "race", "cnt")
    assert {r.k: (r.race, r.cnt) for r in df.collect()} == {1: ("b", 1), 2: ("a", 0), 3: ("b", 0)}


def test_whole_mean_truncates(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", -3), ("b", 0), ("c", None)], "k string, x int")
    assert {r.k: r.m for r in df.groupBy("k").agg(rel.whole_mean("x").alias("m")).collect()} == {"a": 1, "b": -1, "c": None}


def test_missing_id_counts_as_one_person(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), ("a", None), ("b", 1)], "k string, x int")
    assert {r.k: r.n for r in df.groupBy("k").agg(rel.distinct_with_null("x").alias("n")).collect()} == {"a": 2, "b": 1}


def test_spread_refuses_two_values_for_a_cell(spark):
    df = spark.createDataFrame([("a", "m", 1), ("a", "m", 2)], "d string, name string, v bigint")
    with pytest.raises(Exception, match="more than one v for name m"):
        rel.spread(df, ["d"], "name", "v", ["m"]).collect()
    good = spark.createDataFrame([("a", "m", 1), ("a", "n", None), ("b", "n", 3)], "d string, name string, v bigint")
    assert {tuple(r) for r in rel.spread(good, ["d"], "name", "v", ["m", "n"]).collect()} == {("a", 1, None), ("b", None, 3)}


def test_spread_loses_no_unlisted_name(spark):
    df = spark.createDataFrame([("a", "m", 1), ("a", "n", 2), ("b", None, 3)], "d string, name string, v long")
    for rows in (df, df.where("name is null"), df.where("name is not null")):
        with pytest.raises(Exception, match="not listed"):
            rel.spread(rows, ["d"], "name", "v", ["m"]).collect()
    assert [tuple(r) for r in rel.spread(df, ["d"], "name", "v", ["m"], only_listed=True).collect()] == [("a", 1)]


def test_range_in_the_join_keeps_unmatched_rows(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    right = spark.createDataFrame([(1, date(2020, 5, 1)), (2, date(2021, 5, 1))], "k int, d date")
    out = rel.left_join_in_range(left, right, "k", labels.in_closed_range("d", "2020-01-01", "2020-12-31"))
    assert {(r.k, r.d) for r in out.collect()} == {(1, date(2020, 5, 1)), (2, None), (None, None)}


def test_key_lists(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    a, b = spark.createDataFrame([(1,), (1,), (None,)], "x int"), spark.createDataFrame([(2,)], "y int")
    assert [r.k for r in rel.in_keys(df, "k", (a, "x")).collect()] == [1]
    assert sorted(r.k for r in rel.in_keys(df, "k", (a, "x"), (b, "y")).collect()) == [1, 2]
    assert {r.k for r in rel.not_in_keys(df, "k", a, "x").collect()} == {2, None}


def test_flag_is_set_before_the_cap(spark):
    rows = [(date(2021, 3, 1),), (None,), (date(2020, 12, 31),)]
    out = rel.conditional_cap(spark.createDataFrame(rows, "e date"), "e", "2021-01-01", "2020-12-31", "f")
    assert [(r.e, r.f) for r in out.collect()] == [(date(2020, 12, 31), 1), (date(2020, 12, 31), 1), (date(2020, 12, 31), 0)]


def test_set_operations_are_distinct_and_match_missing_values(spark):
    a = spark.createDataFrame([(1, None), (1, None), (None, None), (2, "x"), (3, "y")], "k int, v string")
    b = spark.createDataFrame([(1, None), (None, None), (None, None), (2, "z"), (4, "y")], "other int, name string")
    assert sorted(map(tuple, rel.rows_in_both(a, b).collect()), key=str) == sorted(map(tuple, a.intersect(b).collect()), key=str)
    assert sorted(map(tuple, rel.rows_only_in_first(a, b).collect())) == [(2, "x"), (3, "y")]
