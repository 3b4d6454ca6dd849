"""Near duplicates by SimHash: fingerprints met on a grid of segment bit counts.

Every fingerprint becomes the vector of the bit counts of its 2-bit segments. The
Manhattan distance of two such vectors never exceeds the Hamming distance of the
fingerprints, so links of up to 4 bits have vectors within 4, and in one half of the
vector within 2. Half vectors within 2 of each other share a grid point within 1 of
both: each fingerprint is dealt to those points, and what meets is verified exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import components, documents, id_and_text, row_key, text_slices, written

# Constants of the 64-bit XXH64 hash.
P1, P2, P3, P4, P5 = (np.uint64(x) for x in (
    11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))


def _rotate(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def xxh64(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of many byte ranges of one buffer at once."""
    padded = np.concatenate([buffer, np.zeros(8, np.uint8)])
    words = np.lib.stride_tricks.as_strided(padded[:8].view("<u8"), (len(buffer) + 1,), (1,))
    halves = np.lib.stride_tricks.as_strided(padded[:4].view("<u4"), (len(buffer) + 1,), (1,))
    with np.errstate(over="ignore"):
        seed_ = np.uint64(seed)
        length = (ends - starts).astype(np.int64)
        at = starts.astype(np.int64).copy()
        h = np.full(len(at), seed_ + P5, np.uint64)
        long = np.flatnonzero(length >= 32)
        if len(long):
            lanes = [np.full(len(long), x, np.uint64) for x in (seed_ + P1 + P2, seed_ + P2, seed_, seed_ - P1)]
            live, position, left = np.arange(len(long)), at[long].copy(), length[long] // 32
            while len(live):
                for k in range(4):
                    lanes[k][live] = _rotate(lanes[k][live] + words[position[live] + 8 * k] * P2, 31) * P1
                position[live] += 32
                left[live] -= 1
                live = live[left[live] > 0]
            mixed = _rotate(lanes[0], 1) + _rotate(lanes[1], 7) + _rotate(lanes[2], 12) + _rotate(lanes[3], 18)
            for lane in lanes:
                mixed = (mixed ^ _rotate(lane * P2, 31) * P1) * P1 + P4
            h[long], at[long] = mixed, position
        h += length.astype(np.uint64)
        live = np.flatnonzero(ends - at >= 8)
        while len(live):
            h[live] = _rotate(h[live] ^ _rotate(words[at[live]] * P2, 31) * P1, 27) * P1 + P4
            at[live] += 8
            live = live[ends[live] - at[live] >= 8]
        live = np.flatnonzero(ends - at >= 4)
        h[live] = _rotate(h[live] ^ halves[at[live]].astype(np.uint64) * P1, 23) * P2 + P3
        at[live] += 4
        live = np.flatnonzero(ends > at)
        while len(live):
            h[live] = _rotate(h[live] ^ padded[at[live]].astype(np.uint64) * P5, 11) * P1
            at[live] += 1
            live = live[ends[live] > at[live]]
        h = (h ^ (h >> np.uint64(33))) * P2
        h = (h ^ (h >> np.uint64(29))) * P3
        return h ^ (h >> np.uint64(32))


STEP = 1 << 17  # shingles hashed at once
DEALT = 40_000  # fingerprints that a task deals to grid points


def hashed_shingles(texts: list[str], shingle: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray, Iterator[tuple[int, int, np.ndarray, np.ndarray]]]:
    """The texts with words, the counts of their shingles, and the shingles' hashes in steps.

    A step is (first and last text + 1 among those with words, hashes, where each text starts in them).
    """
    # lower() and split() of bytes know just A-Z and the six ASCII white space characters.
    words = [t.encode().lower().split() for t in texts]
    counts = np.array([len(w) for w in words], np.int64)
    flat = [x for w in words for x in w]
    buffer = np.frombuffer(b" ".join(flat), np.uint8)
    sizes = np.fromiter(map(len, flat), np.int64, len(flat))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    shingles = np.where(counts > 0, np.maximum(counts - shingle + 1, 1), 0)
    first = np.repeat(np.cumsum(counts) - counts, shingles) + np.arange(int(shingles.sum())) - np.repeat(np.cumsum(shingles) - shingles, shingles)
    width = np.repeat(np.minimum(counts, shingle), shingles)
    full = np.flatnonzero(shingles)
    edges = np.concatenate([[0], np.cumsum(shingles[full])])

    def steps() -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        for a in range(0, len(first), STEP):
            b = min(a + STEP, len(first))
            h = xxh64(buffer, starts[first[a:b]], ends[first[a:b] + width[a:b] - 1], seed)
            lo = int(np.searchsorted(edges, a, side="right")) - 1
            hi = int(np.searchsorted(edges, b, side="left"))
            yield lo, hi, h, np.maximum(edges[lo:hi], a) - a

    return full, shingles[full], steps()


def simhashes(texts: list[str], shingle: int, seed: int = 42) -> np.ndarray:
    """A 64-bit fingerprint of each text: a bit is set if set in over half of the shingles' hashes."""
    out = np.zeros(len(texts), np.uint64)
    full, shingles, steps = hashed_shingles(texts, shingle, seed)
    if not len(full):
        return out
    totals = np.zeros((len(full), 64), np.int64)
    for lo, hi, h, cuts in steps:
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        totals[lo:hi] += np.add.reduceat(bits, cuts, axis=0, dtype=np.int64)
    out[full] = np.packbits(2 * totals > shingles[:, None], axis=1, bitorder="little").view("<u8").reshape(-1)
    return out


def fingerprints(docs: DataFrame, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, fp) of every row: ``fp`` the fingerprint's 64 bits as a long, zero for texts without a word;
    ``key`` is equal for rows with equal id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch, most=1_000_000):
                fp = pa.array(simhashes(texts, shingle).view(np.int64))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("key"), fp], names=["doc_id", "key", "fp"])

    return id_and_text(docs, id_col, text_col).withColumn("key", row_key()).mapInArrow(run, "doc_id long, key string, fp long")


def grid_points(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, point) of every grid point within 1 of each half of each fingerprint's count vector.

    A half has 16 segments of 2 bits; their counts (0 to 2) stand in 2 bits each.
    """
    odd = np.uint64(0x5555555555555555)
    counts = (fp & odd) + ((fp >> np.uint64(1)) & odd)
    index, points = [], []
    rows = np.arange(len(fp))
    for half in (0, 1):
        own = ((counts >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)).astype(np.int64) | (half << 32)
        index.append(rows)
        points.append(own)
        for segment in range(16):
            count = (own >> (2 * segment)) & 3
            for change in (1, -1):
                fits = np.flatnonzero(count < 2 if change > 0 else count > 0)
                index.append(fits)
                points.append(own[fits] + change * (1 << (2 * segment)))
    return np.concatenate(index), np.concatenate(points)


def links_in_groups(group: np.ndarray, fp: np.ndarray, side: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows with equal ``group`` (sorted) within ``most`` bits, fewer than the rows.

    Every pair that meets is verified; a pair that earlier ones already connect is not
    returned. ``side`` 1 and 2 are compared only across, 0 within.
    """
    n = len(fp)
    root = np.arange(n)
    kept_a, kept_b = [], []
    rows = np.arange(n - 1)
    k = 1
    while len(rows := rows[rows + k < n]):
        rows = rows[group[rows] == group[rows + k]]
        if not len(rows):
            break
        other = rows + k
        near = (np.bitwise_count(fp[rows] ^ fp[other]) <= most) & ((side[rows] == 0) | (side[rows] != side[other]))
        a, b = rows[near], other[near]
        while len(a):  # union by repeated hooking of the larger root to the smaller
            ra, rb = root[a], root[b]
            differ = ra != rb
            a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
            if not len(a):
                break
            low, high = np.minimum(ra, rb), np.maximum(ra, rb)
            order = np.argsort(low, kind="stable")[::-1]
            root[high[order]] = low[order]
            won = root[high] == low
            _, one = np.unique(high[won], return_index=True)
            kept_a.append(a[won][one])
            kept_b.append(b[won][one])
            while not np.array_equal(root, root[root]):
                root = root[root]
        k += 1
    empty = np.empty(0, np.int64)
    return np.concatenate([empty, *kept_a]), np.concatenate([empty, *kept_b])


def _meetings(marked: DataFrame, node: str) -> DataFrame:
    """``marked`` with ``at``: the groups (low, high, side) in which the ``blocks`` of its row (null: one) meet two by two."""
    own = F.pmod(F.xxhash64(node), F.col("blocks")).cast("int")
    # Where blocks meet: the lower one has side 1, the higher side 2; a block on its own has side 0.
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda other: F.struct(
        F.least(own, other).alias("low"), F.greatest(own, other).alias("high"),
        F.when(own == other, 0).when(own < other, 1).otherwise(2).alias("side")))
    alone = F.array(F.struct(F.lit(0).alias("low"), F.lit(0).alias("high"), F.lit(0).alias("side")))
    return marked.withColumn("at", F.explode(F.when(F.col("blocks").isNull(), alone).otherwise(meets)))


def near_links(distinct: DataFrame, most: int = 4, block: int = 4096) -> DataFrame:
    """Links (src, dst) between distinct fingerprints (``fp``) at ``most`` (up to 4) differing bits.

    They connect exactly what all such pairs connect, but a task returns fewer links than
    it has fingerprints. A grid point with more than ``block`` fingerprints is split into
    blocks by hash, and every two of its blocks meet in a group of their own.
    """
    if most > 4:
        raise ValueError("the grid finds links of up to 4 bits")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for a in range(0, len(fp), 50_000):
                part = fp[a : a + 50_000]
                index, points = grid_points(part)
                yield pa.RecordBatch.from_arrays([pa.array(points), pa.array(part[index].view(np.int64))], names=["point", "fp"])

    # A fingerprint becomes some 50 rows: a fixed number of them a task, whatever the files of the table.
    dealt = distinct.select("fp").repartition(distinct.count() // DEALT + 1, "fp").mapInArrow(deal, "point long, fp long")
    crowded = dealt.groupBy("point").agg(F.count("*").alias("n")).where(F.col("n") > block)
    # Written first, so that its size is known when Spark chooses how to join it.
    crowded = written(crowded.select("point", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "crowded-points")
    groups = _meetings(dealt.join(crowded, "point", "left"), "fp").select("point", "at.low", "at.high", "at.side", "fp")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def links(table: np.ndarray) -> pa.RecordBatch:
            change = np.any(table[1:, :3] != table[:-1, :3], axis=1)
            group = np.concatenate([[0], np.cumsum(change)])
            fp = table[:, 4]
            a, b = links_in_groups(group, fp.view(np.uint64), table[:, 3], most)
            pairs = np.unique(np.stack([np.minimum(fp[a], fp[b]), np.maximum(fp[a], fp[b])], axis=1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 1]), pa.array(pairs[:, 0])], names=["src", "dst"])

        for batch in batches:
            held.append(np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1))
            if sum(map(len, held)) >= 400_000:
                table = np.ascontiguousarray(np.concatenate(held))
                last = np.flatnonzero(np.any(table[1:, :3] != table[:-1, :3], axis=1))
                cut = int(last[-1]) + 1 if len(last) else 0
                if cut:
                    yield links(np.ascontiguousarray(table[:cut]))
                held = [table[cut:]]
        if held:
            yield links(np.ascontiguousarray(np.concatenate(held)))

    return groups.repartition("point", "low", "high").sortWithinPartitions("point", "low", "high").mapInArrow(verify, "src long, dst long")


def _components(marked: DataFrame) -> DataFrame:
    """(fp, component) of every fingerprint; the component is its smallest fingerprint."""
    classes = written(marked.select("fp").distinct(), "fingerprint-classes")
    member = components(near_links(classes, 4))
    return written(classes.join(member, classes.fp == member.node, "left").select("fp", F.coalesce("component", "fp").alias("component")), "fingerprint-components")


def near_duplicates(docs: DataFrame, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id reachable over links of up to 4 bits.

    Equal fingerprints link; so do texts without a word (fingerprint zero). Null texts are
    empty ones. Rows with a null id take part but have no say in the component's name;
    repeated rows give repeated results, an empty table none.
    """
    marked = written(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    member = _components(marked)
    least = marked.groupBy("fp").agg(F.min("doc_id").alias("least")).join(member, "fp")
    names = least.groupBy("component").agg(F.min("least").alias("component_id"))
    return marked.join(member.join(names, "component").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def representatives(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, as they are, that stand for their component: the smallest id (null last), once.

    Components are those of ``near_duplicates``: fingerprints within 4 bits link. Texts without
    a word, null ones among them, all have fingerprint zero and count as copies of one another.
    Equal rows leave one; an empty table gives none; columns may have any names.
    """
    marked = written(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    first = marked.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "key")).alias("row"))
    chosen = first.join(_components(marked), "fp").groupBy("component").agg(F.min("row").alias("row")).select(F.col("row.key").alias("key"))
    keyed = docs.select(row_key(id_col, text_col).alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    # Equal rows share a key; one of them is enough.
    return keyed.join(chosen, "key", "left_semi").groupBy("key").agg(F.first("row").alias("row")).select("row.*")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document, over 4-word shingles and links of up to 4 bits."""
    found = near_duplicates(documents(spark, sf_dir), shingle=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
