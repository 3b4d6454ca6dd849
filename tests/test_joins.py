"""Left joins with heavy keys, the admission chain, and steps that are written once."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from strandline.operators import relational as rel
from strandline.plans import admissions as adm
from suite import composites
from suite.views import Inputs


def left_join(a, b):
    out = Counter()
    for k, x in a:
        found = [y for j, y in b if k is not None and j == k]
        out.update((k, x, y) for y in found or [None])
    return out


@pytest.mark.parametrize("rows", [1, 3, 20, 10**6])
def test_left_join_with_heavy_keys(spark, rows):
    """Any bound for heavy keys gives the rows of a left join: heavy on the right, on the left, null, repeated, without partner."""
    rng = random.Random(rows)
    a = [(rng.choice([1, 1, 1, 2, 3, 4, None, 9]), i) for i in range(60)]
    b = [(rng.choice([1, 1, 2, 2, 2, 2, 2, 3, None, 7]), rng.randrange(12)) for i in range(80)]
    left, right = spark.createDataFrame(a, "k int, x int"), spark.createDataFrame(b, "k int, y int")
    joined = rel.left_join_many(left, right, "k", rows)
    assert joined.columns == ["k", "x", "y"]
    assert Counter(map(tuple, joined.collect())) == left_join(a, b)


def test_a_heavy_right_key_is_dealt_to_parts(spark):
    right = spark.range(1000).select(F.lit("x").alias("k"), "id")
    left = spark.createDataFrame([("x", 1), ("y", 2)], "k string, n int")
    assert rel.heavy_keys(right, "k", 100) == [("x", 10)] and rel.heavy_keys(right, "k", 1000) == []
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = rel.left_join_many(left, right, "k", 100)
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == 1001 and "_part" in plan and joined.where("k = 'y'").first().id is None
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def planned(spark, df):
    """The plan fixed ahead, without a side small enough to broadcast on its own."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_petition_history_reads_each_side_once(spark, small):
    plan = planned(spark, entry.queries()["petition_history"](spark, small))
    scans = [x for x in plan.splitlines() if "FileScan" in x]
    assert len([x for x in scans if "lineitem.parquet" in x]) == 1 and len([x for x in scans if "orders.parquet" in x]) == 1


def test_admission_chain_shares_steps(spark, small):
    """At most six tenths of the exchanges of the steps planned one by one, and fewer reads."""
    t = Inputs(spark, small)
    chain = composites.chain(t)
    assert chain.involuntary is chain.involuntary and chain.inpatient_mh is chain.inpatient_mh
    shared = planned(spark, chain.voluntary_all)

    def invol():
        return adm.involuntary_admissions(t.auth, t.facility_stay, t.ip_invol, adm.status_in(), None, composites.FROM, composites.TO)

    covered = adm.coverage_flag(invol(), adm.coverage_months(t.coverage))
    ids = adm.id_crosswalk_wide(t.crosswalk, invol()).select(F.col("kcid_1").alias("kcid"), "p1_id")
    with_id = covered.join(ids, "kcid", "left").select(*covered.columns, "p1_id")
    apart = planned(spark, adm.voluntary_combined(
        adm.voluntary_by_difference(adm.inpatient_mh(composites.stays_ip(t), composites.claims_mh(t)), with_id), composites.vol(t)))
    count = lambda plan, what: plan.count(what) - plan.count(f"Reused{what}")
    assert count(shared, "Exchange") <= 0.6 * count(apart, "Exchange"), (count(shared, "Exchange"), count(apart, "Exchange"))
    assert shared.count("FileScan") < apart.count("FileScan")
    assert {tuple(r) for r in chain.inpatient_mh.collect()} == {tuple(r) for r in adm.inpatient_mh(composites.stays_ip(t), composites.claims_mh(t)).collect()}


def test_one_read_of_the_headers_equals_both_steps(spark):
    """Missing ids, missing dates, repeated rows and claims without a header."""
    codes = spark.createDataFrame([("2020", "Inpatient Stay", "UBREV", "100"), ("2020", "Mental Illness", "ICD10CM", "F1")], "version string, value_set_name string, code_system string, code string")
    rng = random.Random(3)
    pick = lambda *x: rng.choice(x)
    lines = [(pick("a", "b", None), pick(1, 2, 3, 4, 9, None), pick("100", "200")) for _ in range(60)]
    dx = [(pick(1, 2, 3, 4, 8, None), pick("F1", "F2"), pick(9, 10), pick("01", "02")) for _ in range(60)]
    header = [(pick("a", "b", None), c, pick("2020-02-01", "2021-02-01", None), pick("2020-03-01", "2022-01-01", None)) for c in (1, 2, 3, 4, 4, 5, None)]
    line = spark.createDataFrame(lines, "id_mcaid string, claim_header_id long, rev_code string")
    dx = spark.createDataFrame(dx, "claim_header_id long, icdcm_norm string, icdcm_version int, icdcm_number string")
    head = spark.createDataFrame(header, "id_mcaid string, claim_header_id long, a string, f string").selectExpr("id_mcaid", "claim_header_id", "CAST(a AS DATE) AS admsn_date", "CAST(f AS DATE) AS first_service_date")
    args = codes, "2020-01-01", "2020-12-31"
    apart = adm.inpatient_mh(adm.inpatient_stays(line, head, *args), adm.principal_dx_claims(dx, head, *args))
    together = adm.inpatient_mh_claims(line, dx, head, *args)
    assert sorted(map(str, together.collect())) == sorted(map(str, apart.collect())) and together.count() > 0


def test_sides_of_inpatient_claims_are_found_in_stages_of_their_own(spark, small):
    """A task that finds lines does not sort the inputs of the diagnoses and the headers as well."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "64k")
    try:
        plan = planned(spark, entry.queries()["inpatient_mh"](spark, small)).splitlines()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    union = next(i for i, x in enumerate(plan) if "Union" in x)
    depth = lambda x: len(x) - len(x.lstrip(" :+-"))
    above = [x for i, x in enumerate(plan[:union]) if all(depth(y) > depth(x) for y in plan[i + 1:union + 1])]
    below = plan[union + 1]
    assert "Exchange" in below and any("Exchange" in x for x in above[above.index(next(x for x in above if "Join" in x)):])
