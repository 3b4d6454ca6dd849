"""Writing results: rebuild, append with load time, declare, export."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.session import work_folder


def overwrite_result(df: DataFrame, path: str) -> DataFrame:
    """Drop and rebuild a result; returns it as read back."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_step(df: DataFrame, name: str) -> DataFrame:
    """The rows as a fresh table in the session's shared folder, for steps that others read more than once."""
    path = work_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def declare_result(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """An empty result with declared columns."""
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def append_with_stamp(df: DataFrame, path: str) -> DataFrame:
    """Append rows with their load time to a declared result, in its column order."""
    target = df.sparkSession.read.parquet(path)
    stamped = df.withColumn("last_run", F.current_timestamp())
    stamped.select(*[F.col(f.name).cast(f.dataType) for f in target.schema]).write.mode("append").parquet(path)
    return df.sparkSession.read.schema(target.schema).parquet(path)


def report_export(summaries: Mapping[str, DataFrame], folder: str) -> dict[str, str]:
    """Write named summaries as one CSV file each; returns name to path.

    Meant for report-size tables: the finished rows of each are moved to one task.
    """
    paths = {name: f"{folder}/{name}" for name in summaries}
    for name, df in summaries.items():
        df.repartition(1).write.mode("overwrite").option("header", True).csv(paths[name])
    return paths
