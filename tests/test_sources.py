"""Readers and writers."""

import pytest

from strandline.session import work_folder
from strandline.sources import sinks, tables


def test_rebuild_replaces_and_append_adds(spark, tmp_path):
    path = str(tmp_path / "t")
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(3,)], "k int")
    sinks.overwrite_result(a, path)
    assert [r.k for r in sinks.overwrite_result(b, path).collect()] == [3]
    declared = sinks.declare_result(spark, str(tmp_path / "d"), "k int, last_run timestamp")
    assert declared.count() == 0 and declared.columns == ["k", "last_run"]
    sinks.append_with_stamp(a, str(tmp_path / "d"))
    out = sinks.append_with_stamp(b, str(tmp_path / "d")).collect()
    assert sorted(r.k for r in out) == [1, 2, 3] and all(r.last_run for r in out)


def test_report_is_one_file_per_sheet(spark, tmp_path):
    paths = sinks.report_export({"x": spark.range(5).repartition(4)}, str(tmp_path))
    assert list(paths) == ["x"]
    assert len(list((tmp_path / "x").glob("*.csv"))) == 1


def test_row_cap(spark):
    df = spark.range(10)
    assert tables.row_cap(df, ["id"], None).count() == 10
    assert [r.id for r in tables.row_cap(df, ["id"], 3).collect()] == [0, 1, 2]
    with pytest.raises(TypeError):
        tables.row_cap(df, ["id"], 2.5)


def test_config_scan_prefers_server_settings(spark, tmp_path):
    spark.createDataFrame([("a", 1, 2)], "id_all string, x int, y int").write.parquet(str(tmp_path / "mine.parquet"))
    config = {"from_table": "other", "second": {"from_schema": "s", "from_table": "mine"}}
    df = tables.config_scan(spark, config, "from", ["x"], "both", "second", str(tmp_path), {"both": "id_all"})
    assert df.columns == ["id_all", "x"]
    with pytest.raises(Exception, match="other"):
        tables.config_scan(spark, config, "from", ["x"], "mcaid", root=str(tmp_path))


def test_named_steps(spark):
    df = spark.createDataFrame([(1, None), (None, 2)], "kcid bigint, kcid2 bigint")
    assert tables.key_list_load(df, "kcid", "kcid2", "t_list").count() == 1
    assert spark.table("t_list").columns == ["kcid", "kcid2"]
    assert tables.stage_intermediate(df, "t_step", reused=True).count() == 2
    spark.catalog.clearCache()


class Session:
    """Stands for a session on a given master with a given checkpoint folder."""

    def __init__(self, master, folder):
        self.conf = {} if folder is None else {"spark.checkpoint.dir": folder}
        self.sparkContext = type("Context", (), {"master": master})


def test_work_folder_follows_the_session():
    first, second = (work_folder(Session("spark://host:7077", "hdfs:/shared/"), "x") for _ in range(2))
    assert first.startswith("hdfs:/shared/x-") and first != second
    assert work_folder(Session("local[2]", None), "x")
    with pytest.raises(ValueError):
        work_folder(Session("spark://host:7077", None), "x")
