"""Nearest vectors by inner product: multiprobe p-stable hashing with exact reranking.

Vectors get one more component that brings them to the same length, so that the largest
inner product becomes the least distance. A table hashes them by a few random
projections cut into steps. A query visits buckets in the order of the estimated chance
that a near vector lies there, until the chances add up to a target: that order gives
the least chance it still visits, and this number travels with the query, once to each
part of the table that holds such buckets. What it meets is scored exactly; the tables'
finds are merged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, erf, isfinite, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.llm.common import written

_PLACES = np.linspace(-8, 8, 8193)
_BELOW = np.array([0.5 * (1 + erf(p / sqrt(2))) for p in _PLACES])


def _normal(x: np.ndarray) -> np.ndarray:
    """The normal distribution function; chances only order buckets, so a table of it will do."""
    return np.interp(x, _PLACES, _BELOW)


@dataclass
class Tables:
    """The projections: (tables, hashes, dimension + 1), their offsets, the step, and the common length."""

    projections: np.ndarray
    offsets: np.ndarray
    step: float
    length: float
    near: float

    @classmethod
    def drawn(cls, dimension: int, length: float, tables: int, hashes: int, step: float, near: float, seed: int = 7) -> Tables:
        random = np.random.default_rng(seed)
        return cls(random.standard_normal((tables, hashes, dimension + 1)), random.random((tables, hashes)) * step, step, length, near)

    def project(self, x: np.ndarray, table: int, query: bool) -> np.ndarray:
        """Projections in steps, of rows brought to unit length."""
        high = np.abs(x).max(axis=1, keepdims=True)
        own = high[:, 0] * np.sqrt(((x / high) ** 2).sum(axis=1))
        if query:
            x = np.concatenate([x / own[:, None], np.zeros((len(x), 1))], axis=1)
        else:
            x = x / self.length
            x = np.concatenate([x, np.sqrt(np.maximum(0, 1 - (own / self.length) ** 2))[:, None]], axis=1)
        return x @ self.projections[table].T

    def cells(self, place: np.ndarray, table: int) -> np.ndarray:
        return np.clip(np.floor((place + self.offsets[table]) / self.step), -512, 511).astype(np.int64)

    def bucket(self, cells: np.ndarray) -> np.ndarray:
        """One number for the cells of all projections."""
        return ((cells + 512) << 10 * np.arange(cells.shape[1])).sum(axis=1)

    def part(self, bucket: np.ndarray, table: int, parts: int) -> np.ndarray:
        """The part of its table that holds a bucket; the remainder by the number of tables tells the table."""
        mixed = (bucket.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
        return (mixed % np.uint64(parts)).astype(np.int64) * len(self.projections) + table

    def parts(self, x: np.ndarray, table: int, parts: int) -> np.ndarray:
        return self.part(self.bucket(self.cells(self.project(x, table, False), table)), table, parts)

    def chances(self, place: np.ndarray, cells: np.ndarray, table: int) -> np.ndarray:
        """(queries, buckets): the chance that a near vector of a query lies in the cells of a bucket.

        The projection of a vector at similarity ``near`` is normal around near times the
        query's; a bucket's chance is the product over the projections.
        """
        out = np.ones((len(place), len(cells)))
        for j in range(cells.shape[1]):
            values, at = np.unique(cells[:, j], return_inverse=True)
            edges = values * self.step - self.offsets[table, j]
            mean, spread = self.near * place[:, j, None], sqrt(1 - self.near * self.near)
            out *= (_normal((edges + self.step - mean) / spread) - _normal((edges - mean) / spread))[:, at]
        return out

    def probes(self, x: np.ndarray, table: int, target: float, reach: int, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The least chance that each query visits, and (query, part) of what it visits.

        The cells within ``reach`` steps are taken likeliest first until their chances
        add up to ``target`` of all of theirs. A target of 1 visits everything.
        """
        if target >= 1:
            rows, part = np.divmod(np.arange(len(x) * parts), parts)
            return np.zeros(len(x)), rows, part * len(self.projections) + table
        place = self.project(x, table, True)
        own = self.cells(place, table)
        moves = np.arange(-reach, reach + 1)
        joint = np.ones((len(x), 1), np.float32)
        steps = np.zeros(1, np.int64)
        for j in range(own.shape[1]):
            edges = (own[:, j, None] + np.arange(-reach, reach + 2)) * self.step - self.offsets[table, j]
            chance = np.diff(_normal((edges - self.near * place[:, j, None]) / sqrt(1 - self.near * self.near)), axis=1).astype(np.float32)
            joint = (joint[:, :, None] * chance[:, None, :]).reshape(len(x), -1)
            steps = (steps[:, None] + (moves << 10 * j)).ravel()
        falling = -np.sort(-joint, axis=1)
        sums = np.cumsum(falling, axis=1, dtype=np.float64)
        last = np.minimum((sums < target * sums[:, -1:]).sum(axis=1), sums.shape[1] - 1)
        least = falling[np.arange(len(x)), last].astype(np.float64) * (1 - 1e-5)
        row, move = np.nonzero(joint >= least[:, None])
        part = self.part(self.bucket(own)[row] + steps[move], table, parts)
        seen = np.unique(row * (parts * len(self.projections)) + part)
        row, part = np.divmod(seen, parts * len(self.projections))
        return least, row, part


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimension)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector) of the rows that take part: no null id, no null, zero, or non-finite vector; other types than float as double."""
    kind = vectors.schema[vector_col].dataType.simpleString()
    vector = F.col(vector_col).cast(kind if kind == "array<float>" else "array<double>").alias("vector")
    v = vectors.select(F.col(id_col).cast("long").alias("id"), vector)
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.where(F.col("id").isNotNull() & F.col("vector").isNotNull() & ~bad & F.exists("vector", lambda x: x != 0))


def _best(query: np.ndarray, item: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best different items of each query, ties to the smaller item."""
    order = np.lexsort((item, -score, query))
    query, item, score = query[order], item[order], score[order]
    again = np.zeros(len(query), bool)
    again[1:] = (query[1:] == query[:-1]) & (item[1:] == item[:-1])
    query, item, score = query[~again], item[~again], score[~again]
    first = np.flatnonzero(np.append(True, query[1:] != query[:-1])) if len(query) else np.empty(0, int)
    rank = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
    keep = rank < k
    return query[keep], item[keep], score[keep]


def _score(
    items: np.ndarray, item_ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int, cuts: np.ndarray | None = None, visits: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best items of each query, ties to the smaller item; the scores are summed alike for every pair.

    Items lie in buckets, ``cuts`` apart; ``visits`` tells which query meets which (default:
    all meet). A bucket's products preselect: what may reach the k-th best so far, within
    what rounding can change.
    """
    if cuts is None:
        cuts, visits = np.array([0, len(items)]), np.ones((len(queries), 1), bool)
    slack = 4 * items.shape[1] * np.finfo(float).eps * np.sqrt((items * items).sum(axis=1).max()) * np.sqrt((queries * queries).sum(axis=1))
    least = np.full(len(queries), -np.inf)
    best = np.empty(0, np.int64), np.empty(0, item_ids.dtype), np.empty(0)
    waiting: list[tuple[np.ndarray, np.ndarray]] = []
    n, room = 0, 20_000 + 24 * len(queries)

    def settle() -> None:
        nonlocal best, n
        row, at = (np.concatenate(x) for x in zip(*waiting))
        score = np.concatenate([(items[at[i : i + 20_000]] * queries[row[i : i + 20_000]]).sum(axis=1) for i in range(0, len(at), 20_000)])
        good = score >= least[row]
        best = _best(np.concatenate([best[0], row[good]]), np.concatenate([best[1], item_ids[at[good]]]), np.concatenate([best[2], score[good]]), k)
        counts = np.bincount(best[0], minlength=len(queries))
        full = counts >= k
        least[full] = best[2][np.cumsum(counts)[full] - 1] - slack[full]
        waiting.clear()
        n = 0

    for bucket in np.flatnonzero(visits.any(axis=0)):
        meets = np.flatnonzero(visits[:, bucket])
        for lo in range(cuts[bucket], cuts[bucket + 1], 1024):
            group = items[lo : min(lo + 1024, cuts[bucket + 1])].T
            for rows in (meets[i : i + 1024] for i in range(0, len(meets), 1024)):
                row, at = np.nonzero(queries[rows] @ group >= least[rows, None])
                waiting.append((rows[row], lo + at))
                n += len(row)
                if n > room:
                    settle()
    if waiting:
        settle()
    return query_ids[best[0]], best[1], best[2]


def _met(rows: DataFrame, dimension: int, k: int, hashing: Tables) -> DataFrame:
    """Scores of what meets: rows (part, block, side 0 item or 1 query, id, vector, least) in equal (part, block).

    A query meets the buckets whose chance is at least its ``least``.
    """
    tables = len(hashing.projections)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, items, item_ids = None, [], []
        table, cuts, cells = 0, None, None
        out: list[tuple] = []

        def pack(rows: tuple) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(rows[0]), pa.array(rows[1]), pa.array(rows[2])], names=["query", "item", "score"])

        for batch in batches:
            for lo in range(0, batch.num_rows, 20_000):
                part = batch.slice(lo, 20_000)
                held, block, side, ids, least = (part.column(c).to_numpy() for c in ("part", "block", "side", "id", "least"))
                x = _matrix(part.column("vector"), dimension)
                ends = np.flatnonzero((held[1:] != held[:-1]) | (block[1:] != block[:-1]) | (side[1:] != side[:-1])) + 1
                for a, b in zip(np.append(0, ends).tolist(), np.append(ends, len(ids)).tolist()):
                    group = (held[a], block[a])
                    if group != at:
                        at, items, item_ids, cuts = group, [], [], None
                    if side[a] == 0:
                        items.append(x[a:b])
                        item_ids.append(ids[a:b])
                        continue
                    if not items:
                        continue
                    if cuts is None:  # the first query: the part is whole
                        whole, whole_ids, table = np.concatenate(items), np.concatenate(item_ids), int(held[a]) % tables
                        cells = hashing.cells(hashing.project(whole, table, False), table)
                        bucket = hashing.bucket(cells)
                        order = np.argsort(bucket, kind="stable")
                        items, item_ids = [whole[order]], [whole_ids[order]]
                        first = np.flatnonzero(np.append(True, np.diff(bucket[order]) != 0))
                        cuts, cells = np.append(first, len(order)), cells[order[first]]
                    step = max(16, min(2048, 2_000_000 // len(cells)))
                    for q in range(a, b, step):
                        e = min(q + step, b)
                        visits = hashing.chances(hashing.project(x[q:e], table, True), cells, table) >= least[q:e, None]
                        out.append(_score(items[0], item_ids[0], x[q:e], ids[q:e], k, cuts, visits))
                if sum(len(o[0]) for o in out) > 300_000:
                    out = [_best(*(np.concatenate(c) for c in zip(*out)), k)]
                    if len(out[0][0]) > 150_000:
                        yield pack(out[0])
                        out = []
        if out:
            yield pack(_best(*(np.concatenate(c) for c in zip(*out)), k))

    return rows.repartition("part", "block").sortWithinPartitions("part", "block", "side").mapInArrow(run, "query long, item long, score double")


def _dealt(items: DataFrame, queries: DataFrame, block: int) -> DataFrame:
    """Items and queries of each part, items of large parts in blocks that all its queries visit."""
    counts = items.groupBy("part").agg(F.count("*").alias("n"))
    large = written(counts.where(F.col("n") > 2 * block).select("part", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "large-parts")
    which = F.coalesce(F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"), F.lit(0)).alias("block")
    items = items.join(large, "part", "left").select("part", which, F.lit(0).alias("side"), "id", "vector", F.lit(0.0).alias("least"))
    blocks = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("blocks") - 1, F.lit(0)))).alias("block")
    queries = queries.join(large, "part", "left").select("part", blocks, F.lit(1).alias("side"), "id", "vector", "least")
    return items.unionByName(queries)


def _top(found: DataFrame, k: int) -> DataFrame:
    """The k best different items of each query; Spark cuts before the shuffle, too."""
    best = Window.partitionBy("query").orderBy(F.desc("score"), "item")
    return found.distinct().withColumn("place", F.row_number().over(best)).where(F.col("place") <= k).drop("place")


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 20, tables: int = 2, hashes: int = 6, step: float = 1.5, near: float = 0.4,
    target: float = 0.75, reach: int = 2, block: int = 16_384, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``queries`` its ``k`` nearest other rows of ``vectors``.

    Equal vectors are searched once and stand for their k + 1 smallest ids, so copies
    never crowd a bucket. ``near`` is the similarity expected of a near vector, ``target``
    the chance with which a table's visits reach it, estimated from the cells within
    ``reach`` steps of the query's own in each of the at most 6 projections; a target of 1
    visits every bucket and is exact. A query with fewer than k finds is compared with all
    rows, in blocks. Components are taken as they are (float) or as doubles. Null ids take no part, nor do vectors that are null,
    zero, hold null or non-finite components, or differ in length from the most common
    one; an empty table gives no rows. A repeated id counts as one row per different vector.
    """
    spark = vectors.sparkSession
    good = usable(vectors, id_col, vector_col)
    asked = usable(queries, id_col, vector_col)
    sizes = good.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n"), F.max(F.aggregate("vector", F.lit(0.0), lambda t, x: t + x.cast("double") * x)).alias("length"), F.max(F.array_max(F.transform("vector", F.abs))).alias("high"))
    common = sizes.orderBy(F.desc("n"), "d").limit(1).collect()  # one row
    if not common:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dimension, length = int(common[0].d), sqrt(common[0].length)
    length = length if isfinite(length) and length > 0 else common[0].high * sqrt(int(common[0].d))  # squares beyond the doubles
    good, asked = (x.where(F.size("vector") == dimension) for x in (good, asked))
    copy = F.row_number().over(Window.partitionBy(F.xxhash64("vector"), "vector").orderBy("id"))
    few = good.distinct().withColumn("copy", copy).where(F.col("copy") <= k + 1)
    classes = written(few.groupBy("vector").agg(F.min("id").alias("id"), F.collect_list("id").alias("ids")), "vector-classes")
    marked = written(asked.groupBy("vector").agg(F.min("id").alias("id")), "query-classes")
    marked = marked.repartition(spark.sparkContext.defaultParallelism, "id")
    parts = max(1, ceil(classes.count() / block))
    hashing = Tables.drawn(dimension, length, tables, hashes, step, near)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("vector"), dimension)
            for t in range(tables):
                yield pa.RecordBatch.from_arrays([pa.array(hashing.parts(x, t, parts)), batch.column("id"), batch.column("vector")], names=["part", "id", "vector"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                some = batch.slice(lo, 64)
                x = _matrix(some.column("vector"), dimension)
                for t in range(tables):
                    least, row, part = hashing.probes(x, t, target, reach, parts)
                    at = pa.array(row)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(part), some.column("id").take(at), some.column("vector").take(at), pa.array(least[row])], names=["part", "id", "vector", "least"])

    vector = classes.schema["vector"].dataType.simpleString()
    items = classes.select("id", "vector").mapInArrow(index, f"part long, id long, vector {vector}")
    visits = marked.select("id", "vector").mapInArrow(probe, f"part long, id long, vector {vector}, least double")
    found = written(_top(_met(_dealt(items, visits, block), dimension, k + 1, hashing), k + 1), "found")
    counted = found.join(classes.select(F.col("id").alias("item"), F.size("ids").alias("n")), "item").groupBy(F.col("query").alias("id")).agg(F.sum("n").alias("n"))
    short = written(marked.join(counted.where(F.col("n") > k), "id", "left_anti"), "short-queries")
    if short.limit(1).collect():
        first = F.explode(F.sequence(F.lit(0).cast("long"), F.lit((parts - 1) * tables).cast("long"), F.lit(tables).cast("long"))).alias("part")
        everywhere = short.select(first, "id", "vector", F.lit(0.0).alias("least"))  # all of the first table
        everything = items.where(F.col("part") % tables == 0)
        found = _top(found.unionByName(_met(_dealt(everything, everywhere, block), dimension, k + 1, hashing)), k + 1)
    top = found
    top = top.join(classes.select(F.col("id").alias("item"), "ids"), "item").select("query", "score", F.explode("ids").alias("vec_id"))
    mine = marked.withColumnRenamed("id", "query").join(asked.distinct().select("vector", F.col("id").alias("query_id")), "vector")
    pairs = mine.select("query", "query_id").join(top, "query").where("query_id <> vec_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every row whose id is divisible by 20."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0))
