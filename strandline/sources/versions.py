"""Results in versions: a load is written whole to a folder of its own, then one manifest row makes it current.

``root/manifest`` holds a row per load: the version's number, the load's id, the folders that make it up and its
columns. Readers take the row with the largest number, so a load that fails half-way leaves the result as it was, and
a load whose id is in the manifest is not done again. One writer at a time; readers need not wait.
Folders of earlier versions stay until their owner removes them.
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = "version long, load_id string, parts array<string>, columns string"


def _manifest(spark: SparkSession, root: str) -> DataFrame:
    try:
        return spark.read.schema(MANIFEST).parquet(f"{root}/manifest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)


def _latest(spark: SparkSession, root: str, load_id: str | None = None) -> tuple[Row | None, bool]:
    """The manifest's last row, and whether ``load_id`` is in it: one aggregate row."""
    row = F.struct("version", "load_id", "parts", "columns")
    found = _manifest(spark, root).agg(F.max_by(row, "version").alias("last"), F.max(F.col("load_id") == F.lit(load_id)).alias("done")).first()
    return found["last"], bool(found["done"])


def _read(spark: SparkSession, root: str, last: Row) -> DataFrame:
    schema = T.StructType.fromJson(json.loads(last["columns"]))
    if not last["parts"]:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{root}/{p}" for p in last["parts"]])


def current(spark: SparkSession, root: str) -> DataFrame:
    """The result as of the last finished load."""
    last, _ = _latest(spark, root)
    if last is None:
        raise ValueError(f"nothing has been loaded to {root}")
    return _read(spark, root, last)


def _commit(df: DataFrame, root: str, load_id: str | None, keep: bool) -> DataFrame:
    spark, load_id = df.sparkSession, load_id or uuid.uuid4().hex
    last, done = _latest(spark, root, load_id)
    if done:
        return _read(spark, root, last)
    schema = df.schema
    if keep and last is not None:
        schema = _read(spark, root, last).schema
        if set(schema.names) != set(df.columns):
            raise ValueError(f"columns {df.columns} are not those of the result, {schema.names}")
        df = df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema])
    part = f"load-{uuid.uuid4().hex}"
    df.write.parquet(f"{root}/{part}")
    parts = [*(last["parts"] if keep and last is not None else []), part]
    row = [((last["version"] if last is not None else 0) + 1, load_id, parts, schema.json())]
    spark.createDataFrame(row, MANIFEST).coalesce(1).write.mode("append").parquet(f"{root}/manifest")
    return current(spark, root)


def replace(df: DataFrame, root: str, load_id: str | None = None) -> DataFrame:
    """Make ``df`` the result; the former one stays current until the new one is whole.

    A ``load_id`` that has been loaded before changes nothing. Returns the result as read back.
    """
    return _commit(df, root, load_id, keep=False)


def add(df: DataFrame, root: str, load_id: str | None = None) -> DataFrame:
    """Add the rows of ``df`` to the result, in its columns and types; a ``load_id`` loaded before adds nothing."""
    return _commit(df, root, load_id, keep=True)
