"""Windows of a key as an array: equal to the steps on rows, and nothing is sorted or grouped once windows are opened."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401  (registers the queries)
from strandline.plans import conditions
from strandline.plans.conditions import KEYS, Calendar, ConditionSpec
from suite.registry import QUERIES

SCHEMA = "id_mcaid string, bh_cond string, svc_date date"


def some_events(spark, seed):
    rng = random.Random(seed)
    days = [date(2014, 6, 1) + timedelta(days=rng.randrange(3000)) for _ in range(80)] + [None]
    rows = [(rng.choice(["a", "b", "c", None]), rng.choice(["x", None]), rng.choice(days)) for _ in range(120)]
    return spark.createDataFrame(rows + rows[:20], SCHEMA)


def found(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("cal", [Calendar("2015-01-01", 60, 1), Calendar("2015-03-01", 80, 3), Calendar("2014-01-01", 90, 24)], ids=str)
def test_nested_steps_equal_steps_on_rows(spark, cal):
    events = some_events(spark, str(cal))
    rows = conditions.window_matrix(events, cal).select(*KEYS, "start_window", "end_window").distinct()
    assert found(conditions.windows_with_events(events, cal)) == found(rows)
    nested = conditions.windows_with_events(events, cal, nested=True)
    flagged = conditions.flag_discontinuity(nested)
    assert found(conditions.open_windows(flagged)) == found(conditions.flag_discontinuity(rows))
    want = conditions.window_groups(conditions.flag_discontinuity(rows))
    assert found(conditions.open_windows(conditions.window_groups(flagged))) == found(want)
    assert want.agg(F.max("grp")).first()[0] > 0 or cal.months == 24


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("most", [500, 3])
def test_any_table_of_windows(spark, seed, most):
    """Windows that overlap, nest, repeat, leave days out, end before they start or lack a bound."""
    rng = random.Random(seed)
    table = [(s := date(2014, 1, 1) + timedelta(days=rng.randrange(3000)), s + timedelta(days=rng.randrange(-5, 200))) for _ in range(25)]
    table += table[:3] + [(None, date(2020, 1, 1)), (date(2020, 1, 1), None), (date(2014, 7, 7), date(2014, 7, 7))]
    windows = spark.createDataFrame(table, "start_window date, end_window date")
    events = some_events(spark, seed)
    rows = events.join(windows, F.col("svc_date").between(F.col("start_window"), F.col("end_window"))).select(*KEYS, "start_window", "end_window").distinct()
    assert found(conditions.windows_with_events(events, windows, most=most)) == found(rows)
    nested = conditions.windows_with_events(events, windows, nested=True, most=most)
    assert found(conditions.window_periods(nested)) == found(conditions.window_periods(rows)) and rows.count() > 0
    none = windows.where("start_window IS NULL")
    assert conditions.windows_with_events(events, none, most=most).count() == 0


@pytest.mark.parametrize("name", ["running_group_id", "discontinuity_flag", "any_calendar_periods", "window_claim_threshold"])
def test_nothing_is_sorted_or_grouped_after_windows_are_opened(spark, small, name):
    plan = QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    lines = plan.splitlines()
    opened = next(i for i, x in enumerate(lines) if "Generate" in x)
    assert not any(w in x for x in lines[:opened] for w in ("Window", "Sort", "Aggregate", "Exchange"))
    assert not any(" Window" in x for x in lines)


@pytest.mark.parametrize("cal", [Calendar("2015-01-01", 60, 1), Calendar("2015-03-01", 40, 24), Calendar("2014-01-01", 30, 70)], ids=str)
def test_window_counts_equal_brute_force(spark, cal):
    rng = random.Random(str(cal))
    specs = [ConditionSpec(1, "one", "c1", 1), ConditionSpec(2, "two", "c2", 2)]
    rows = [(rng.choice(["a", "b", None]), rng.choice([1, 2]), date(2014, 6, 1) + timedelta(days=rng.randrange(3000)), rng.randrange(1, 3), int(rng.random() < 0.2), int(rng.random() < 0.5)) for _ in range(120)]
    claims = spark.createDataFrame(rows, "id_mcaid string, ccw_code int, first_service_date date, n_dx long, condition1 int, condition2 int")
    claims = claims.withColumn("condition_2_from_date", F.when(F.col("condition2") == 1, F.col("first_service_date")))
    want = set()
    for k in range(cal.n):
        at = lambda n: date((m := date.fromisoformat(cal.first).year * 12 + date.fromisoformat(cal.first).month - 1 + n) // 12, m % 12 + 1, 1)
        start, end = at(k), at(k + cal.months) - timedelta(days=1)
        for p in "ab":
            for c in (1, 2):
                own = [r for r in rows if r[0] == p and r[1] == c and start <= r[2] <= end]
                n1, n2 = sum(r[3] * r[4] for r in own), sum(r[3] * r[5] for r in own)
                days = [r[2] for r in own if r[5]]
                if n1 >= 1 or (c == 2 and n2 >= 2 and max(days) > min(days)):
                    want.add((p, c, start, end, n1, n2, min(days, default=None), max(days, default=None)))
    got = [tuple(r) for r in conditions.window_claim_threshold(claims, specs, cal).collect()]
    assert set(got) == want and len(got) == len(want) > 0
