"""Quality classifier: regularised quadratic discriminant on transformed document statistics."""

from __future__ import annotations

import warnings
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from strandline.llm.common import documents, id_and_text, rows_again, text_slices, with_row, written

FEATURES = (
    "chars", "words", "word_length", "capitals", "digits", "symbols", "marks", "exclamations", "line_length", "distinct_words",
    "echoes", "top_word", "repeated_lines", "distinct_triples", "long_words", "sentence_ends",
)
_KINDS = {
    "capitals": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digits": b"0123456789", "symbols": b"#*$%&|<>", "marks": b".,;:'\"()-?/_=+@[]{}~^`\\",
    "exclamations": b"!",
}
_MEMBERS = np.array([[b in members for b in range(256)] for members in _KINDS.values()], np.float64)


def statistics(text: str) -> list[float]:
    """The statistics of a whole text, transformed to be closer to normal; an empty text has zeros and ones."""
    raw = text.encode()
    words = raw.lower().split()
    n, size = max(len(words), 1), max(len(raw), 1)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    capitals, digits, symbols, marks, exclamations = (_MEMBERS @ np.bincount(np.frombuffer(raw, np.uint8), minlength=256)).tolist()
    counts = Counter(words)
    word_bytes = sum(map(len, words))
    triples = max(len(words) - 2, 1)
    return [
        np.log1p(len(raw)), np.log1p(len(words)), np.log1p(word_bytes / n), np.sqrt(capitals / size), np.sqrt(digits / size),
        np.sqrt(symbols / n), np.sqrt(marks / n), np.sqrt(exclamations / n), np.log1p(len(raw) / max(len(lines), 1)),
        np.sqrt(len(counts) / n), np.sqrt(sum(map(eq, words, words[1:])) / n), np.sqrt(max(counts.values(), default=0) / n),
        np.sqrt((len(lines) - len(set(lines))) / max(len(lines), 1)), len(set(zip(words, words[1:], words[2:]))) / triples,
        np.sqrt(sum(1 for w in words if len(w) > 16) / n), np.sqrt(sum(1 for w in words if w[-1] == 46) / n),
    ]


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x: the statistics) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch):
                x = pa.array([statistics(t) for t in texts], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), x], names=["doc_id", "x"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, x array<double>")


def _with_statistics(docs: DataFrame, text_col: str) -> DataFrame:
    """(text, row, x) of every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch):
                x = pa.array([statistics(t) for t in texts], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([part.column("text"), part.column("row"), x], names=["text", "row", "x"])

    rows = with_row(docs, text_col)
    return rows.mapInArrow(run, StructType([rows.schema["text"], rows.schema["row"], StructField("x", ArrayType(DoubleType()))]))


@dataclass
class Discriminant:
    """Class means, and of each shrunk covariance the Cholesky factor's inverse and the log determinant."""

    center: np.ndarray
    scale: np.ndarray
    means: list[np.ndarray]
    inverses: list[np.ndarray]
    constants: list[float]
    prior: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1."""
        if not self.means:
            return np.full(len(x), self.prior)
        z = (x - self.center) / self.scale
        density = [c - 0.5 * (((z - m) @ inverse.T) ** 2).sum(axis=1) for m, inverse, c in zip(self.means, self.inverses, self.constants)]
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -700, 700)))


def fit(labelled: DataFrame, shrink: float = 0.1, ridge: float = 0.01) -> Discriminant:
    """Fit on (x, label 0 or 1), all rows.

    Counts, sums and products of each class are added up where the rows are; the driver
    gets one number per pair of statistics. A class covariance is drawn by ``shrink``
    towards the pooled one and by ``ridge`` towards the unit matrix of the scaled
    statistics. With a class missing, every score is the share of class 1 (half without rows).
    """
    d = len(FEATURES)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(-1, d)
            label = batch.column("label").to_numpy()
            for k in (0, 1):
                own = x[label == k]
                total[k] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
        place = np.arange(total.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat([0, 1], len(place))), pa.array(np.tile(place, 2)), pa.array(total.ravel())], names=["label", "place", "value"])

    rows = labelled.where("label in (0, 1)").select("x", F.col("label").cast("long").alias("label")).mapInArrow(moments, "label long, place long, value double")
    total = np.zeros((2, 1 + d + d * d))
    for r in rows.groupBy("label", "place").agg(F.sum("value").alias("value")).collect():  # 2 * (1 + d + d * d) rows
        total[r.label, r.place] = r.value
    n = total[:, 0]
    if (n < 2).any():
        return Discriminant(np.zeros(d), np.ones(d), [], [], [], float(n[1] / n.sum()) if n.sum() else 0.5)
    center = total[:, 1 : 1 + d].sum(axis=0) / n.sum()
    spread = total[:, 1 + d :].sum(axis=0).reshape(d, d) / n.sum() - np.outer(center, center)
    scale = np.sqrt(np.maximum(np.diag(spread), 1e-12))
    means, covariances = [], []
    for k in (0, 1):
        mean = total[k, 1 : 1 + d] / n[k]
        covariances.append((total[k, 1 + d :].reshape(d, d) / n[k] - np.outer(mean, mean)) / np.outer(scale, scale))
        means.append((mean - center) / scale)
    pooled = (n[0] * covariances[0] + n[1] * covariances[1]) / n.sum()
    inverses, constants = [], []
    for k in (0, 1):
        factor = np.linalg.cholesky((1 - shrink) * covariances[k] + shrink * pooled + ridge * np.eye(d))
        inverses.append(np.linalg.inv(factor))
        constants.append(float(np.log(n[k] / n.sum()) - np.log(np.diag(factor)).sum()))
    return Discriminant(center, scale, means, inverses, constants, float(n[1] / n.sum()))


def score(marked: DataFrame, model: Discriminant) -> DataFrame:
    """(doc_id, score) of every row of statistics."""
    d = len(FEATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(-1, d)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.scores(x))], names=["doc_id", "score"])

    return marked.select("doc_id", "x").mapInArrow(run, "doc_id long, score double")


def passing(
    docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", learn_from: DataFrame | None = None,
) -> DataFrame:
    """The rows of ``docs``, as they are, that score ``threshold`` or more.

    Learns from the labelled, not held-out rows of ``learn_from`` (by default of ``docs``),
    which should be a table that no filter has gone over: a filter that rejects what is
    labelled bad leaves nothing to tell bad from good. With a class missing there, nothing
    can be told either: every row stays, with a warning.
    """
    marked = written(_with_statistics(docs, text_col), "quality-rows")
    taught = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("label")).where(~held_out())
    if learn_from is None:
        known = marked.select(F.col(f"row.{id_col}").cast("long").alias("doc_id"), "x")
    else:
        known = features(learn_from, id_col, text_col)
    model = fit(known.join(taught, "doc_id"))
    if not model.means:
        warnings.warn("labels of a class are missing: the quality classifier keeps every row", stacklevel=2)
        return rows_again(marked, docs, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = model.scores(batch.column("x").flatten().to_numpy().reshape(-1, len(FEATURES))) >= threshold
            yield batch.select(["text", "row"]).filter(pa.array(good))

    return rows_again(marked.mapInArrow(run, StructType([marked.schema["text"], marked.schema["row"]])), docs, text_col)


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that no label is learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document.

    Learns from ``labels`` (doc_id, quality) of documents that are not held out; null or
    other labels teach nothing. Null texts count as empty, repeated rows are scored each,
    a row with a null id is scored but not learned from, an empty table gives no rows.
    """
    marked = written(features(docs, id_col, text_col), "quality-statistics")
    taught = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("label")).where(~held_out())
    model = fit(marked.join(taught, "doc_id"))
    return score(marked, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document."""
    return classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
