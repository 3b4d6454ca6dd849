"""The configured condition load and versioned results: what is checked first, what a failure leaves, what a repeat adds."""

import json
import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from strandline.plans import condition_load
from strandline.plans.conditions import specs_from_config
from strandline.sources import versions
from test_conditions import CALENDARS, brute_periods, random_dates, windows

SECTION = {"ccw_abbrev": "c1", "dx_fields": "any", "claim_type1": [0, 1], "claim_type2": [2]}
CONFIG = {
    "schema": "stage", "to_table": "person_condition", "claim_header_from_schema": "stage", "claim_header_from_table": "header",
    "icdcm_from_schema": "stage", "icdcm_from_table": "diagnosis",
    "cond_one": {**SECTION, "ccw_code": 1, "condition_type": 1, "dx_exclude1": "e1", "dx_exclude1_fields": "1", "lookback_months": 3},
    "cond_two": {**SECTION, "ccw_code": 2, "ccw_abbrev": "c2", "claim_type1": 0, "condition_type": 2, "lookback_months": 24},
}


def vars_of(person, kind):
    return {"last_run": "DATETIME", person: kind, "from_date": "DATE", "to_date": "DATE", "ccw_code": "SMALLINT", "ccw_desc": "VARCHAR(20)"}


@pytest.mark.parametrize("source, person, kind, make", [("apcd", "id_apcd", "bigint", int), ("both", "id_all", "string", lambda p: f"P{p}")])
def test_load_from_a_configuration_alone(spark, tmp_path, source, person, kind, make):
    rng = random.Random(person)
    cals = {3: CALENDARS[1], 24: CALENDARS[2]}
    header = {c: (make(rng.randrange(8)), rng.randrange(4), random_dates(rng, 1)[0]) for c in range(150)}
    lookup = {f"K{i}": {n: int(rng.random() < 0.4) for n in ("ccw_c1", "ccw_c2", "ccw_e1")} for i in range(12)}
    dx = [(header[c][0], c, f"K{rng.randrange(12)}", 10, f"{n:02d}") for c in range(150) for n in range(1, 4)]
    tables = {
        "diagnosis": spark.createDataFrame(dx, f"{person} {kind}, claim_header_id int, icdcm_norm string, icdcm_version int, icdcm_number string"),
        "header": spark.createDataFrame([(h[0], c, *h[1:]) for c, h in header.items()], f"{person} {kind}, claim_header_id int, claim_type_id int, first_service_date date"),
        "dx_lookup": spark.createDataFrame([(k, 10, *v.values()) for k, v in lookup.items()], "dx string, dx_ver int, ccw_c1 int, ccw_c2 int, ccw_e1 int"),
        **{f"rolling_time_{m}mo_2012_2020": spark.createDataFrame(windows(c), "start_window date, end_window date") for m, c in cals.items()},
    }
    for name, df in tables.items():
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    config = {**CONFIG, "vars": vars_of(person, "VARCHAR(255)" if kind == "string" else "BIGINT")}
    (tmp_path / "config.json").write_text(json.dumps(config))
    specs = specs_from_config(config)
    want = set().union(*[brute_periods(dx, header, lookup, s, cals[s.lookback_months]) for s in specs])

    def load(given, **more):
        return condition_load.load_conditions(spark, given, source, str(tmp_path / "out"), root=str(tmp_path), own_names={"both": "id_all"}, **more)

    out = load(str(tmp_path / "config.json"), load_id="first")
    assert out.columns == list(config["vars"]) and dict(out.dtypes)[person] == kind and dict(out.dtypes)["ccw_code"] == "smallint"
    assert out.where("last_run IS NULL").count() == 0
    rows = [tuple(r) for r in out.select(person, "from_date", "to_date", "ccw_code", "ccw_desc").collect()]
    assert want and len(rows) == len(set(rows)) and set(rows) == want
    folder = str(tmp_path / "out" / "stage.person_condition")
    assert versions.current(spark, folder).count() == len(want)
    assert load(config, load_id="first").inputFiles() == out.inputFiles()  # done before
    assert load(config, rows=0, load_id="trial").count() == 0


def test_configuration_is_checked_before_anything_runs(spark, tmp_path):
    def refused(match, config, **more):
        with pytest.raises(ValueError, match=match):
            condition_load.resolve(config, "apcd", **more)

    refused("icdcm_from_table is missing", {**CONFIG, "icdcm_from_table": None})
    refused("no section", {k: v for k, v in CONFIG.items() if "cond_" not in k})
    refused("share a code", {**CONFIG, "cond_two": {**CONFIG["cond_two"], "ccw_code": 1}})
    refused("condition_type is 3.*dx_fields is '1-3'|dx_fields is '1-3'.*condition_type is 3", {**CONFIG, "cond_one": {**CONFIG["cond_one"], "condition_type": 3, "dx_fields": "1-3"}})
    refused("lookback_months is missing", {**CONFIG, "cond_one": {**CONFIG["cond_one"], "lookback_months": None}})
    refused("declared columns", {**CONFIG, "vars": {"id_apcd": "BIGINT"}})
    spark.createDataFrame([], "id_apcd bigint, claim_header_id int").write.parquet(str(tmp_path / "header.parquet"))
    with pytest.raises(ValueError, match="no column claim_type_id, first_service_date"):
        condition_load.load_conditions(spark, CONFIG, "apcd", str(tmp_path / "out"), root=str(tmp_path))
    assert not (tmp_path / "out").exists()


def test_tables_of_a_server_section():
    section = {"to_schema": "s", "to_table": "t", "claim_header_from_table": "h", "icdcm_from_schema": "d", "icdcm_from_table": "i", "ref_schema": "r", "ref_table": "x_"}
    load = condition_load.resolve({**CONFIG, "main": section}, "apcd", "main")
    assert (load.target, load.header, load.diagnoses, load.lookup) == ("s.t", "h", "d.i", "r.x_dx_lookup")
    assert load.calendars == {m: f"r.x_rolling_time_{m}mo_2012_2020" for m in (3, 24)}
    load = condition_load.resolve(CONFIG, "apcd", "main")  # no such section: the top level
    assert (load.target, load.header, load.lookup) == ("stage.person_condition", "stage.header", "ref.dx_lookup")


def test_calendar_must_have_the_look_back(spark, tmp_path):
    shapes = {"header": "id_apcd bigint, claim_header_id int, claim_type_id int, first_service_date date", "dx_lookup": "dx string, dx_ver int, ccw_c1 int, ccw_c2 int, ccw_e1 int",
              "diagnosis": "claim_header_id int, icdcm_norm string, icdcm_version int, icdcm_number string"}
    for name, schema in shapes.items():
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    for m in (3, 24):
        spark.createDataFrame(windows(CALENDARS[1]), "start_window date, end_window date").write.parquet(str(tmp_path / f"rolling_time_{m}mo_2012_2020.parquet"))
    with pytest.raises(ValueError, match="windows of 3 months"):
        condition_load.load_conditions(spark, CONFIG, "apcd", str(tmp_path / "out"), root=str(tmp_path))


def test_a_failed_load_leaves_the_former_rows(spark, tmp_path):
    root = str(tmp_path / "t")
    with pytest.raises(ValueError, match="nothing"):
        versions.current(spark, root)
    old = spark.createDataFrame([(1, date(2020, 1, 1))], "k int, d date")
    assert versions.replace(old, root, "a").count() == 1
    broken = spark.range(5).select(F.when(F.col("id") == 3, F.raise_error(F.lit("stop"))).otherwise(F.col("id")).cast("int").alias("k"), F.current_date().alias("d"))
    for step in (versions.replace, versions.add):
        with pytest.raises(Exception, match="stop"):
            step(broken, root, "b")
        assert [r.k for r in versions.current(spark, root).collect()] == [1]
    before = versions.current(spark, root)
    assert [r.k for r in versions.replace(old.withColumn("k", F.lit(2)), root, "b").collect()] == [2]
    assert [r.k for r in before.collect()] == [1]  # a reader keeps its version


def test_a_repeated_load_adds_nothing(spark, tmp_path):
    root = str(tmp_path / "t")
    rows = spark.createDataFrame([(1, "x"), (None, None)], "k int, v string")
    for _ in range(2):
        assert versions.add(rows, root, "a").count() == 2
    out = versions.add(spark.createDataFrame([("y", 7)], "v string, k bigint"), root, "b")  # other order and type
    assert out.schema.simpleString() == "struct<k:int,v:string>" and out.count() == 3
    assert versions.add(rows, root, "b").count() == 3 and versions.add(rows, root).count() == 5
    with pytest.raises(ValueError, match="columns"):
        versions.add(rows.drop("v"), root)
    assert versions.replace(rows.limit(0), root, "c").count() == 0
