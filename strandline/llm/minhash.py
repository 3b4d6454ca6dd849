"""Near duplicates by b-bit MinHash: low bits of the minima, compared by bit counts, confirmed on the full sets.

A text is the set of its shingles; texts with equal sets are one class. Of each class ``VALUES`` minima are taken. Bands
of whole minima choose which classes meet; of every minimum BITS bits stay, packed. The share of equal lanes of two
packed signatures, corrected for lanes that agree by chance, estimates the similarity. What the estimate leaves possible
is confirmed on the sets.

Nothing is paired with everything. In a bucket the classes first meet its leader, then each meets its most similar one of
another component; both lists of pairs are no longer than the bucket. Only where components still share a bucket are
the remaining possible pairs compared, inside the task and without being written; it returns links that connect.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import components, documents, id_and_text, row_key, text_slices, written
from strandline.llm.simhash import hashed_shingles

# 20 bands of 5 minima: two texts of similarity 0.85 share none with a chance of 0.00001. The estimate from 128 lanes of
# 4 bits has a standard deviation of 0.033 there; MARGIN is over 4.5 of them.
BITS, VALUES, BANDS, ROWS, MARGIN = 4, 128, 20, 5, 0.15
_RANDOM = np.random.default_rng(85)
_MASKS, _ODD = _RANDOM.integers(0, 2**64, VALUES, dtype=np.uint64), _RANDOM.integers(0, 2**64, VALUES, dtype=np.uint64) | np.uint64(1)
_LANES = np.uint64(0x1111111111111111)  # the lowest bit of each lane
WORDS = VALUES * BITS // 64


def shingle_sets(texts: list[str], shingle: int) -> list[np.ndarray]:
    """The distinct hashes of each text's shingles, sorted; none without a word."""
    full, sizes, steps = hashed_shingles(texts, shingle)
    flat = np.concatenate([np.empty(0, np.uint64), *(h for _, _, h, _ in steps)])
    out = [np.empty(0, np.uint64)] * len(texts)
    for i, own in zip(full.tolist(), np.split(flat, np.cumsum(sizes)[:-1])):
        out[i] = np.unique(own)
    return out


def minima(sets: Sequence[np.ndarray]) -> np.ndarray:
    """``VALUES`` minima of each set, which must not be empty; two sets agree in each with the chance of their similarity."""
    out = np.empty((len(sets), VALUES), np.uint64)
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets)])[:-1]
    step = 1 << 16
    for k in range(VALUES):
        out[:, k] = np.uint64(2**64 - 1)
    for a in range(0, len(flat), step):
        part = flat[a : a + step]
        lo = int(np.searchsorted(starts, a, side="right")) - 1
        hi = int(np.searchsorted(starts, a + len(part), side="left"))
        cuts = np.maximum(starts[lo:hi], a) - a
        for k in range(VALUES):
            np.minimum(out[lo:hi, k], np.minimum.reduceat((part ^ _MASKS[k]) * _ODD[k], cuts), out=out[lo:hi, k])
    return out


def packed(values: np.ndarray) -> np.ndarray:
    """The low BITS bits of the minima, 64 / BITS lanes in a word."""
    lanes = (values & np.uint64(2**BITS - 1)).reshape(len(values), WORDS, 64 // BITS)
    return np.bitwise_or.reduce(lanes << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS)), axis=2)


def estimated(own: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Similarity estimated from packed signatures: the share of equal lanes, less those equal by chance."""
    x = own ^ others
    for shift in (2, 1):
        x = x | (x >> np.uint64(shift))
    equal = 1 - np.bitwise_count(x & _LANES).sum(axis=-1) / VALUES
    chance = 2.0**-BITS
    return (equal - chance) / (1 - chance)


def bands(values: np.ndarray) -> np.ndarray:
    """One number for the minima of each band and its place."""
    rows = values[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _ODD[0], rows.shape[:2])
    for k in range(ROWS):
        out = (out ^ rows[:, :, k]) * _ODD[1]
        out = out ^ (out >> np.uint64(29))
    return out


def sketches(docs: DataFrame, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, digest, n, bands, signature) of every row; ``digest`` is that of the set, null if it is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch, most=1_000_000):
                sets = shingle_sets(texts, shingle)
                some = [i for i, s in enumerate(sets) if len(s)]
                digests, signatures, banded = [None] * len(texts), [None] * len(texts), [None] * len(texts)
                if some:
                    values = minima([sets[i] for i in some])
                    for i, b, p in zip(some, bands(values).view(np.int64), packed(values)):
                        digests[i], signatures[i], banded[i] = blake2b(sets[i].tobytes(), digest_size=16).digest(), p.tobytes(), b
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), part.column("key"), pa.array(digests, pa.binary()), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(banded, pa.list_(pa.int64())), pa.array(signatures, pa.binary()),
                ], names=["doc_id", "key", "digest", "n", "bands", "signature"])

    rows = id_and_text(docs, id_col, text_col).withColumn("key", row_key())
    return rows.mapInArrow(run, "doc_id long, key string, digest binary, n long, bands array<long>, signature binary")


class Group:
    """The rows of one bucket (or of two of its blocks) in a task."""

    def __init__(self, rows: dict[str, np.ndarray], least: float):
        self.node, self.root, self.side, self.n = (rows[c] for c in ("node", "root", "side", "n"))
        self.signature, self.bands, self.bucket, self.least = rows["signature"], rows["bands"], rows["bucket"][0], least
        self.sets = rows.get("shingles")

    def possible(self, i: int, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``others`` can be similar to i, and the estimates.

        Not those of its component, of a size too different, or from the other half of a bucket that meets its
        own half elsewhere; nor a pair that shares an earlier band, which is compared there.
        """
        others = others[(self.root[others] != self.root[i]) & ((self.side[others] == 0) | (self.side[others] != self.side[i]))]
        small, large = np.minimum(self.n[others], self.n[i]), np.maximum(self.n[others], self.n[i])
        others = others[small >= self.least * large - 1e-9]
        estimate = estimated(self.signature[i], self.signature[others])
        near = estimate >= self.least - MARGIN
        others, estimate = others[near], estimate[near]
        if len(others):
            equal = self.bands[others] == self.bands[i]
            here = self.bands[others, equal.argmax(axis=1)] == self.bucket
            others, estimate = others[here], estimate[here]
        return others, estimate

    def with_leader(self) -> np.ndarray:
        """Pairs of the first row and what can be similar to it."""
        others, _ = self.possible(0, np.arange(1, len(self.node)))
        return np.stack([np.zeros(len(others), np.int64), others], axis=1)

    def with_best(self) -> np.ndarray:
        """Pairs of each row and the most similar row of another component."""
        out, every = [], np.arange(len(self.node))
        for i in every.tolist():
            others, estimate = self.possible(i, every)
            if len(others):
                out.append((i, int(others[estimate.argmax()])))
        return np.array(out, np.int64).reshape(-1, 2)

    def busy(self) -> np.ndarray:
        """Rows that can be similar to another, each as a pair with itself."""
        found, every = np.zeros(len(self.node), bool), np.arange(len(self.node))
        for i in every.tolist():
            others, _ = self.possible(i, np.flatnonzero(~found) if found[i] else every)
            found[others] = True
            found[i] |= len(others) > 0
            if found.all():
                break
        return np.repeat(np.flatnonzero(found), 2).reshape(-1, 2)

    def linked(self) -> np.ndarray:
        """Similar pairs, confirmed, that connect components; pairs that these already connect are not compared."""
        out = []
        for i in range(len(self.node)):
            others, estimate = self.possible(i, np.arange(i + 1, len(self.node)))
            for j in others[np.argsort(-estimate)].tolist():
                if self.root[i] != self.root[j]:
                    common = len(np.intersect1d(self.sets[i], self.sets[j], assume_unique=True))
                    if common >= self.least * (len(self.sets[i]) + len(self.sets[j]) - common) - 1e-9:
                        self.root[self.root == self.root[j]] = self.root[i]
                        out.append((i, j))
        return np.array(out, np.int64).reshape(-1, 2)


KEYS = ("bucket", "low", "high")


def _in_groups(rows: DataFrame, pairs: Callable[[Group], np.ndarray], least: float, keep_bucket: bool = False) -> DataFrame:
    """(a, b) of the pairs that ``pairs`` finds among rows (bucket, low, high, side, node, root, n, bands, signature) with equal KEYS."""
    sets = "shingles" in rows.columns

    def arrays(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        out = {c: batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (*KEYS, "side", "node", "root", "n")}
        out["bands"] = batch.column("bands").flatten().to_numpy(zero_copy_only=False).reshape(-1, BANDS)
        out["signature"] = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint64).reshape(-1, WORDS)
        if sets:
            out["shingles"] = np.empty(batch.num_rows, object)
            out["shingles"][:] = [x.values.to_numpy(zero_copy_only=False) for x in batch.column("shingles")]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []

        def found(rows: dict[str, np.ndarray], ends: np.ndarray) -> pa.RecordBatch:
            out = [np.empty((0, 5), np.int64)]
            for lo, hi in zip([0, *ends[:-1].tolist()], ends.tolist()):
                if hi - lo > 1:
                    at = pairs(Group({c: v[lo:hi] for c, v in rows.items()}, least))
                    node = rows["node"][lo:hi]
                    where = [np.full(len(at), rows[c][lo]) for c in KEYS]
                    out.append(np.stack([np.minimum(node[at[:, 0]], node[at[:, 1]]), np.maximum(node[at[:, 0]], node[at[:, 1]]), *where], axis=1))
            table = np.concatenate(out)
            if not keep_bucket:
                table = np.unique(table[:, :2], axis=0)
            return pa.RecordBatch.from_arrays([pa.array(table[:, i]) for i in range(table.shape[1])], names=["a", "b", *KEYS][: table.shape[1]])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(arrays(batch))
            if sum(len(x["node"]) for x in held) >= 20_000:
                rows = {c: np.concatenate([x[c] for x in held]) for c in held[0]}
                ends = np.flatnonzero(np.any([rows[c][1:] != rows[c][:-1] for c in KEYS], axis=0)) + 1
                if len(ends):
                    yield found(rows, ends)
                    rows = {c: v[ends[-1] :] for c, v in rows.items()}
                held = [rows]
        if held:
            rows = {c: np.concatenate([x[c] for x in held]) for c in held[0]}
            ends = np.flatnonzero(np.any([rows[c][1:] != rows[c][:-1] for c in KEYS], axis=0)) + 1
            yield found(rows, np.append(ends, len(rows["node"])))

    schema = "a long, b long" + (", bucket long, low int, high int" if keep_bucket else "")
    if keep_bucket:
        whole, run_ = run, lambda batches: (pa.RecordBatch.from_arrays([x.cast(t) for x, t in zip(b.columns, (pa.int64(),) * 3 + (pa.int32(),) * 2)], names=b.schema.names) for b in whole(batches))
    else:
        run_ = run
    return rows.repartition(*KEYS).sortWithinPartitions(*KEYS, "node").mapInArrow(run_, schema)


def _unsettled(members: DataFrame, root: DataFrame | None) -> DataFrame:
    """Members (bucket, node, ...) with ``root``, of buckets that hold more than one component."""
    rooted = members.withColumn("root", F.col("node")) if root is None else members.join(root, "node")
    mixed = rooted.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("rows")).where("x < y").select("bucket", "rows")
    # Written first, so that its size is known when Spark chooses how to join it.
    return rooted.join(written(mixed, "mixed-buckets"), "bucket")


def _alone(rows: DataFrame, block: int) -> DataFrame:
    """Every row once; a bucket with over ``block`` rows in blocks that do not meet."""
    own = F.pmod(F.xxhash64("node"), F.ceil(F.col("rows") / block)).cast("int")
    return rows.select("*", own.alias("low"), own.alias("high"), F.lit(0).alias("side"))


def _two_by_two(rows: DataFrame, block: int) -> DataFrame:
    """A bucket with over ``block`` rows in blocks each two of which meet: rows * rows / block of them."""
    blocks = F.ceil(F.col("rows") / block).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    meets = F.transform(F.sequence(F.lit(0), blocks - 1), lambda other: F.struct(
        F.least(own, other).alias("low"), F.greatest(own, other).alias("high"), F.when(own == other, 0).when(own < other, 1).otherwise(2).alias("side")))
    return rows.withColumn("at", F.explode(meets)).select(*rows.columns, "at.low", "at.high", "at.side")


def similar_links(docs: DataFrame, classes: DataFrame, least: float, shingle: int, id_col: str = "doc_id", text_col: str = "text", block: int = 1024) -> DataFrame:
    """(node, component) of classes (node, key, n, bands, signature) linked to others by a similarity of ``least`` or more.

    Every link is confirmed on the sets of shingles; the links found connect all that similar pairs
    with a common band and an estimate of ``least`` - MARGIN or more connect.
    """
    banded = classes.select(F.explode("bands").alias("bucket"), "node")
    shared = written(banded.groupBy("bucket").agg(F.count("*").alias("rows")).where("rows > 1"), "shared-buckets")
    first = written(banded.join(shared, "bucket").join(classes.select("node", "n", "bands", "signature"), "node"), "bucket-members")
    busy = _in_groups(_two_by_two(first.withColumn("root", F.col("node")), block), Group.busy, least).select(F.col("a").alias("node")).distinct()
    busy = written(busy.join(classes.select("node", "key"), "node"), "busy-classes")

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch, most=1_000_000):
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array([s.view(np.int64) for s in shingle_sets(texts, shingle)], pa.list_(pa.int64()))], names=["node", "shingles"])

    # Sorted and merged at every size: what is busy grows with the input.
    texts = id_and_text(docs, id_col, text_col).withColumn("key", row_key()).join(busy.hint("merge"), "key").groupBy("node").agg(F.first("text").alias("text"))
    sets = written(texts.mapInArrow(hashes, "node long, shingles array<long>"), "shingle-sets")
    members = written(first.drop("rows").join(busy.select("node"), "node"), "busy-members")

    def confirmed(pairs: DataFrame) -> DataFrame:
        pairs = written(pairs.distinct(), "possible-pairs")
        both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
        shared = F.size(F.array_intersect("x", "y"))
        return both.where(shared >= least * (F.size("x") + F.size("y") - shared) - 1e-9).select(F.col("a").alias("src"), F.col("b").alias("dst"))

    def rooted(links: DataFrame) -> DataFrame:
        member = components(links)
        found = busy.select("node").join(member, "node", "left").select("node", F.coalesce("component", "node").alias("root"))
        return written(found, "class-components")

    links = written(confirmed(_in_groups(_alone(_unsettled(members, None), block), Group.with_leader, least)), "leader-links")
    root = rooted(links)
    more = written(confirmed(_in_groups(_two_by_two(_unsettled(members, root), block), Group.with_best, least)), "best-links")
    if more.limit(1).collect():
        links = links.unionByName(more)
        root = rooted(links)
    # What is left: rows that still can be similar to another component, with their sets.
    left = written(_two_by_two(_unsettled(members, root), block // 4), "unsettled")
    some = written(_in_groups(left, Group.busy, least, keep_bucket=True).select(F.col("a").alias("node"), *KEYS).distinct(), "unsettled-busy")
    if some.limit(1).collect():
        rest = left.join(some, ["node", *KEYS]).join(sets, "node")
        found = written(_in_groups(rest, Group.linked, least).select(F.col("a").alias("src"), F.col("b").alias("dst")), "last-links")
        root = rooted(links.unionByName(found))
    return root.withColumnRenamed("root", "component")


def near_duplicates(docs: DataFrame, shingle: int = 5, least: float = 0.85, id_col: str = "doc_id", text_col: str = "text", block: int = 1024) -> DataFrame:
    """(doc_id, n_shingles, component_id): the set's size and the smallest doc_id reachable over links.

    Texts link if the intersection of their sets of ``shingle`` words is ``least`` of the union or
    more; a shorter text is one shingle; texts without a word (also null ones) have an empty set and
    link with nothing. Rows with a null id take part but have no say in the component's name;
    repeated rows give repeated results, an empty table none. Other columns are not read.
    """
    marked = written(sketches(docs, shingle, id_col, text_col), "sketches")
    classes = marked.where("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("smallest"), *[F.first(c).alias(c) for c in ("key", "n", "bands", "signature")])
    # Numbered as written, so that a number stays with its class.
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "set-classes")
    member = similar_links(docs, classes, least, shingle, id_col, text_col, block)
    named = classes.select("digest", "node", "smallest").join(member, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least_id = named.groupBy("component").agg(F.min("smallest").alias("component_id"))
    named = named.join(least_id, "component").select("digest", "component_id")
    rows = marked.select("doc_id", "digest", F.col("n").alias("n_shingles"))
    linked = rows.where("digest IS NOT NULL").join(named, "digest").select("doc_id", "n_shingles", "component_id")
    return linked.unionByName(rows.where("digest IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of the shingle set and component of every document, over 5-word shingles and a similarity of 0.85 or more."""
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


#: The same in DuckDB: all pairs of sets that share a shingle, and what they reach.
ORACLE = r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i : i + 4], ' ')) END) AS s FROM texts
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), links AS (
  SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2) p
  JOIN sizes m ON m.doc_id = p.a JOIN sizes n ON n.doc_id = p.b WHERE 100 * k >= 85 * (m.n + n.n - k)
), reached AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION
  SELECT r.doc_id, l.b FROM reached r JOIN links l ON l.a = r.other
)
SELECT r.doc_id, coalesce(any_value(s.n), 0) AS n_shingles, min(r.other) AS component_id, r.doc_id = min(r.other) AS kept
FROM reached r LEFT JOIN sizes s ON s.doc_id = r.doc_id GROUP BY r.doc_id
"""
