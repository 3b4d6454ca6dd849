"""Code lists as filters at the scan, and as joins where they are long."""

import pytest
from pyspark.sql import functions as F

from strandline.operators import relational as rel
from strandline.plans import conditions


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.fixture
def lines(spark, tmp_path):
    rows = [(i, ["0100", "0200", "0300", None, "0999"][i % 5]) for i in range(50)]
    spark.createDataFrame(rows, "id long, rev_code string").write.parquet(str(tmp_path / "lines"))
    return spark.read.parquet(str(tmp_path / "lines"))


@pytest.fixture
def codes(spark):
    rows = [("S", "0100", "a"), ("S", "0100", "b"), ("S", "0300", "c"), ("S", None, "d"), ("T", "0200", "e")]
    return spark.createDataFrame(rows, "value_set_name string, code string, definition string")


@pytest.mark.parametrize("most", [0, 1, 2, 100])
def test_a_list_above_the_bound_gives_the_same_rows(lines, codes, most):
    wanted = rel.code_rows(codes, ["S"])
    semi = rel.with_code_in(lines, "rev_code", wanted, most)
    assert sorted(r.id for r in semi.collect()) == [i for i in range(50) if i % 5 in (0, 2)]
    joined = rel.with_code_columns(lines, "rev_code", codes.where("value_set_name = 'S'").select("code", "definition"), most)
    assert sorted((r.id, r.definition) for r in joined.collect()) == sorted(
        [(i, d) for i in range(0, 50, 5) for d in "ab"] + [(i, "c") for i in range(2, 50, 5)])
    for df in (semi, joined):
        pushed = "PushedFilters: [In(rev_code, [0100,0300])" in plan(df)
        assert pushed == (most >= 2), plan(df)
    assert ("Join" in plan(semi)) == (most < 2)


def test_empty_lists_and_other_types(spark, lines, codes):
    assert rel.with_code_in(lines, "rev_code", rel.code_rows(codes, ["none"])).count() == 0
    assert rel.with_code_in(lines, "id", rel.code_rows(codes.withColumn("code", F.lit("7")), ["S"])).count() == 1  # the join casts
    assert rel.listed_codes(codes, ["value_set_name"]) == {("S",): ["0100", "0300"], ("T",): ["0200"]}
    assert rel.listed_codes(codes, most=2) is None


def test_events_read_only_listed_codes(spark, tmp_path):
    """Both lists come from one read of the code table and reach the scans of the claims; long lists give the same events."""
    import datetime

    day = datetime.date(2020, 1, 5)
    spark.createDataFrame([(1, day, "F10"), (2, day, "F99"), (3, day, None)], "id_mcaid long, first_service_date date, icdcm_norm string").write.parquet(str(tmp_path / "dx"))
    spark.createDataFrame([(1, day, "n1"), (2, day, "n2")], "id_mcaid long, rx_fill_date date, ndc string").write.parquet(str(tmp_path / "rx"))
    dx, rx = spark.read.parquet(str(tmp_path / "dx")), spark.read.parquet(str(tmp_path / "rx"))
    sets = [(conditions.DIAGNOSIS_SETS[0], "Depression", "F10"), (conditions.PHARMACY_SET, "ADHD Rx", "n2"), ("other", "x", "F99")]
    value_set = spark.createDataFrame(sets, "value_set_name string, sub_group string, code string")
    events = conditions.condition_events(dx, rx, value_set)
    assert sorted(r.id_mcaid for r in events.collect()) == [1, 2]
    assert "EqualTo(icdcm_norm,F10)" in plan(events) and "EqualTo(ndc,n2)" in plan(events)
    assert conditions._listed(value_set, most=1) is None
    assert sorted(r.id_mcaid for r in conditions._by_diagnosis(dx, value_set).collect()) == [1]
