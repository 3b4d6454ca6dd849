"""Counts of several levels from one shuffle of the persons."""

import random

from pyspark.sql import functions as F

from strandline.operators.relational import level_counts

LEVELS = {"month": ["y", "m"], "year": ["y"], "place": ["p"], "all": []}


def counted(df):
    return level_counts(df, LEVELS, "k", F.col("f"), ("n", "persons"))


def test_levels_equal_a_grouping_each(spark):
    rng = random.Random(7)
    some = lambda *values: rng.choice([*values, None])
    rows = [(some(*range(9)), some(2019, 2020), some(1, 2, 3), some("a", "b"), some(0, 1)) for _ in range(300)]
    rows += [(None, 2020, 1, "a", 1)] * 500 + [(4, 2020, 1, "a", 1)] * 500 + [(None, 2022, 5, "c", None)]
    df = spark.createDataFrame(rows, "k long, y int, m int, p string, f int")
    got = [tuple(r) for r in counted(df).select("level", "y", "m", "p", "n", "persons").collect()]
    want = set()
    for level, columns in LEVELS.items():
        for r in df.groupBy(*columns).agg(F.sum("f").alias("n"), F.countDistinct("k").alias("persons")).collect():
            want.add((level, *[r[c] if c in columns else None for c in ("y", "m", "p")], r.n, r.persons))
    assert len(got) == len(set(got)) and set(got) == want
    assert counted(df.limit(0)).count() == 0


def test_persons_are_shuffled_once(spark):
    df = spark.range(1000).selectExpr("id % 7 AS k", "CAST(id % 3 AS INT) AS y", "CAST(id % 4 AS INT) AS m", "'x' AS p", "1 AS f")
    plan = counted(df)._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line]
    assert sum("hashpartitioning(k#" in line for line in moved) == 1 and len(moved) == 3  # persons, finest groups, groups
    assert "SinglePartition" not in plan and "Window" not in plan
