"""Helpers shared by the operators: inputs, slices, written steps, connected components."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator, Sequence
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.session import work_folder

SLICE = 2_000_000  # characters handled at once inside a task


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text (null: empty), so that other columns cannot clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def with_row(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The text (null: empty) and, as one struct, the other columns of its row and whether the text was null."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    return docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.struct(F.col(text_col).isNull().alias("_null_text"), *others).alias("row"))


def rows_again(df: DataFrame, like: DataFrame, text_col: str = "text") -> DataFrame:
    """The columns of ``like`` from (text, row)."""
    text = F.when(~F.col("row._null_text"), F.col("text")).alias(text_col)
    return df.select(*[text if c == text_col else F.col(f"row.`{c}`").alias(c) for c in like.columns])


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """128 bits, as text, equal for rows with equal id and text (null: empty); two hashes with different beginnings."""
    row = (F.col(f"`{id_col}`").cast("long"), F.col(f"`{id_col}`").isNull(), F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    return F.concat(F.hex(F.xxhash64(*row)), F.lit("-"), F.hex(F.xxhash64(F.lit(1), *row)))


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df`` as a table in the shared folder: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = work_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(sizes: Sequence[int], most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of rows whose sizes add up to about ``most`` (one row at least)."""
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and total + size > most:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def byte_sizes(column: pa.Array) -> list[int]:
    """Bytes of each text or binary value; null has none."""
    return pc.fill_null(pc.binary_length(column), 0).to_pylist()


def text_slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Parts of an Arrow batch with the texts of each as a list."""
    texts = batch.column(column)
    for a, b in slices(byte_sizes(texts), most):
        yield batch.slice(a, b - a), texts.slice(a, b - a).to_pylist()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every node in ``edges`` (src, dst: long); the component is its smallest node.

    Alternating large-star and small-star steps; each is a minimum per node (combined
    before the shuffle) and a join that adaptive execution splits where one node has
    very many neighbours. Every round is a written table, so nothing reaches the driver
    but one row that tells whether the last round changed anything.
    """
    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first())

    current = written(edges.where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct(), "edges")
    before = state(current)
    for _ in range(rounds):
        if before[0] == 0:
            break
        both = current.unionByName(current.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        low = both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("low"))
        large = both.join(low, "src").where("dst > src").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
        large = large.where("src <> dst").distinct()
        low = large.groupBy("src").agg(F.min("dst").alias("low"))
        small = large.join(low, "src").select(F.explode(F.array(F.struct("src", F.col("low").alias("dst")), F.struct(F.col("dst").alias("src"), F.col("low").alias("dst")))).alias("e"))
        current = written(small.select("e.*").where("src <> dst").distinct(), "edges")
        after = state(current)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components have not settled in {rounds} rounds")
    star = current.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("component"))
    roots = current.select(F.col("dst").alias("node")).distinct().join(star.select("node"), "node", "left_anti")
    return star.unionByName(roots.select("node", F.col("node").alias("component")))


class Recent(dict):
    """A dictionary of at most about ``limit`` entries that forgets what was not asked for lately.

    When half full it is set aside whole; what is asked for again is taken back from there.
    """

    def __init__(self, limit: int):
        super().__init__()
        self.half, self.aside = limit // 2, {}

    def missing(self, keys: Iterable) -> list:
        """The keys that are not known; the others are ready to be looked up until the next call."""
        if len(self) > self.half:
            self.aside = dict(self)
            self.clear()
        new = [k for k in keys if k not in self]
        for k in new:
            if k in self.aside:
                self[k] = self.aside.pop(k)
        return [k for k in new if k not in self] if self.aside else new


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the Python workers, once per application, for clusters where it isn't installed."""
    if spark.sparkContext.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[2]
    # The driver's own folder; Spark itself copies the file to the workers.
    archive = f"{tempfile.mkdtemp(prefix='strandline-')}/strandline_{uuid.uuid4().hex[:8]}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted((root / "strandline").rglob("*.py")):
            z.write(f, f.relative_to(root))
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(spark.sparkContext.applicationId)
