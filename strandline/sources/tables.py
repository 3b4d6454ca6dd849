"""Reading tables by name, by configuration and from files."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.functions.labels import in_closed_range

METRIC_SCHEMA = T.StructType([
    T.StructField("report_date", T.DateType()),
    T.StructField("met_abbr", T.StringType()),
    T.StructField("count", T.LongType()),
])


def table_scan(spark: SparkSession, name: str, columns: Sequence[str] | None = None, root: str | None = None) -> DataFrame:
    """A catalog table, or ``root/name.parquet``, with only the columns asked for."""
    df = spark.table(name) if root is None else spark.read.parquet(f"{root}/{name}.parquet")
    return df if columns is None else df.select(*columns)


def source_id_column(source: str, own_names: Mapping[str, str] | None = None) -> str:
    """Name of the person id column of a data source; combined sources may have a name of their own."""
    return (own_names or {}).get(source, f"id_{source}")


def config_scan(
    spark: SparkSession,
    config: Mapping,
    table_key: str,
    columns: Sequence[str],
    source: str,
    server: str | None = None,
    root: str | None = None,
    own_names: Mapping[str, str] | None = None,
) -> DataFrame:
    """Read the table that a configuration names, with the source's id column first.

    Settings under ``config[server]`` win over settings at the top level.
    """
    settings = config.get(server, config) if server else config
    schema = settings.get(f"{table_key}_schema")
    name = settings[f"{table_key}_table"]
    full = name if root is not None or not schema else f"{schema}.{name}"
    return table_scan(spark, full, [source_id_column(source, own_names), *columns], root)


def row_cap(df: DataFrame, keys: Sequence[str], n: int | None) -> DataFrame:
    """First n rows by key for a trial run; the whole table without n."""
    if n is None:
        return df
    if isinstance(n, bool) or not isinstance(n, int):
        raise TypeError("the row cap must be a whole number")
    return df.orderBy(*keys).limit(n)


def metric_file_scan(spark: SparkSession, path: str, metrics: Sequence[str], start, end) -> DataFrame:
    """Rows of some metrics in a closed date range from a long CSV metric file."""
    df = spark.read.schema(METRIC_SCHEMA).option("header", True).csv(path)
    return df.filter(F.col("met_abbr").isin(*metrics) & in_closed_range("report_date", start, end)).select(
        "report_date", "met_abbr", "count"
    )


def key_list_load(df: DataFrame, key: str, other: str, name: str) -> DataFrame:
    """Publish the listed persons (rows with a key) under a view name."""
    df.select(key, other).filter(F.col(key).isNotNull()).createOrReplaceTempView(name)
    return df.sparkSession.table(name)


def stage_intermediate(df: DataFrame, name: str, reused: bool = False) -> DataFrame:
    """Name a step. ``reused=True`` also keeps its rows for steps that read it again."""
    if reused:
        df = df.persist()
    df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)
