"""Repeated windows of bytes by a depth-limited radix sort of suffixes.

Suffixes are ordered only as deep as the window (200 bytes): those that agree so far are
the repeated windows, and nothing deeper is looked at. Digits are taken most significant
first, and a pass keeps only suffixes whose group has a second member:

1. The first digit is a 32-byte string inside the window, the one with the least hash.
   Equal windows choose equal digits, and neighbouring windows mostly the same one, so
   whole runs of window starts share a row.
2. The second digit is the text of the whole run. Runs that agree are settled at once;
   copies, however many, collapse in the map-side combination.
3. Runs that agree in the first digit only are split to single windows, whose last digit
   is all their 200 bytes.

Digits are compared by 64-bit hashes within the groups of the digits before.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from strandline.llm.common import byte_sizes, documents, rows_again, slices, with_row, written

WINDOW = 200
DIGIT = 32
REACH = WINDOW - DIGIT  # a window holds its digit at 0..REACH
LONGEST_RUN = 512  # starts in a row; longer runs (periodic text) are cut

_STEP = np.uint64(6364136223846793005)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= _MIX
    h ^= h >> np.uint64(32)
    h *= _MIX
    h ^= h >> np.uint64(32)
    return h


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_STEP), n, 1 << 64))


def rolling(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the 32-byte digit and of the 200-byte window at every place of a buffer."""
    h = _mix((buffer.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    parts = {1: h}
    width = 1
    while width < 128:
        h = parts[width]
        parts[2 * width] = h[:-width] * _power(width) + h[width:]
        if width not in (8, 32, 64):
            del parts[width]
        width *= 2
    n = len(buffer) - WINDOW + 1
    digit = _mix(parts[32])
    window = parts[128][:n] * _power(72) + parts[64][128 : 128 + n] * _power(8) + parts[8][192 : 192 + n]
    return digit, _mix(window)


def _least(h: np.ndarray) -> np.ndarray:
    """The least of REACH + 1 values from each place on."""
    width = 1
    while 2 * width <= REACH + 1:
        h = np.minimum(h[:-width], h[width:])
        width *= 2
    over = REACH + 1 - width
    return np.minimum(h[:-over], h[over:]) if over else h


def runs(texts: list[bytes]) -> dict[str, np.ndarray]:
    """Runs of window starts with the same first digit, over all texts.

    Columns: text (its number), start, n (window starts), digit, content (hash of the
    run's bytes), tied (whether its digit occurs more than once in the run).
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    names = ("text", "start", "n", "digit", "content", "tied")
    use = np.flatnonzero(sizes >= WINDOW)
    if not len(use):
        return {k: np.empty(0, np.int64) for k in names}
    buffer = np.frombuffer(b"".join(texts[i] for i in use), np.uint8)
    ends = np.cumsum(sizes[use])
    begins = ends - sizes[use]
    digit, window = rolling(buffer)
    least = _least(digit)
    inside = np.zeros(len(least) + 1, np.int8)
    inside[begins] += 1
    inside[ends - WINDOW + 1] -= 1
    valid = np.cumsum(inside[:-1], dtype=np.int8) > 0
    at = np.flatnonzero(valid)
    value = least[at]
    new = np.ones(len(at), bool)
    new[1:] = (value[1:] != value[:-1]) | (at[1:] != at[:-1] + 1)
    new[np.searchsorted(at, begins)] = True
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, len(at)))
    if length.max() > LONGEST_RUN:  # cut long runs
        pieces = -(-length // LONGEST_RUN)
        k = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        whole = np.repeat(length, pieces)
        first = np.repeat(first, pieces) + k * LONGEST_RUN
        length = np.minimum(LONGEST_RUN, whole - k * LONGEST_RUN)
    start, stop = at[first], at[first] + length - 1
    text = np.searchsorted(ends, start, side="right")
    mine = value[first]
    # The first and the last window hold the whole run where they meet.
    content = _mix(window[start] * np.uint64(31) + window[stop] * np.uint64(1000003) + length.astype(np.uint64))
    for i in np.flatnonzero(length > WINDOW):
        body = np.frombuffer(hashlib.blake2b(buffer[start[i] : stop[i] + WINDOW].tobytes(), digest_size=8).digest(), np.uint64)
        content[i] = body[0]
    tied = _tied(digit, np.where(valid, least, np.uint64(0)), start, stop, mine)
    return {"text": use[text], "start": start - begins[text], "n": length, "digit": mine.view(np.int64), "content": content.view(np.int64), "tied": tied}


def _tied(digit: np.ndarray, least: np.ndarray, start: np.ndarray, stop: np.ndarray, mine: np.ndarray) -> np.ndarray:
    """Whether a run's digit occurs at two places of the run (only then can two of its windows be equal).

    A place is the digit of some window if its hash is the largest least hash of the
    windows over it; ``least`` is zero where no window starts.
    """
    edge = np.zeros(REACH, np.uint64)
    over = ~_least(~np.concatenate([edge, least, edge]))
    places = np.flatnonzero(digit == over)
    lo, hi = np.searchsorted(places, start), np.searchsorted(places, stop + REACH, side="right")
    n = hi - lo
    at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n - lo, n)
    same = digit[places[at]] == np.repeat(mine, n)
    return np.bincount(np.repeat(np.arange(len(n)), n)[same], minlength=len(n)) > 1


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """text, key (rows with equal keys are equal in id and text), and the whole row."""
    rows = with_row(docs, text_col)
    own = F.col(f"row.`{id_col}`")
    return rows.withColumn("key", F.xxhash64(own.cast("long"), own.isNull(), F.col("text")))


def _bytes(column: pa.Array) -> list[bytes]:
    return column.cast(pa.binary()).to_pylist()


def first_pass(keyed: DataFrame) -> DataFrame:
    """Every run of every text: (key, start, n, digit, content, tied)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column("key").to_numpy(), batch.column("text")
            for a, b in slices(byte_sizes(texts)):
                found = runs(_bytes(texts.slice(a, b - a)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[a:b][found["text"]]), pa.array(found["start"], pa.int32()), pa.array(found["n"], pa.int32()),
                     pa.array(found["digit"]), pa.array(found["content"]), pa.array(found["tied"].astype(bool))],
                    names=["key", "start", "n", "digit", "content", "tied"],
                )

    return keyed.select("key", "text").mapInArrow(run, "key long, start int, n int, digit long, content long, tied boolean")


def _texts_of(runs_: DataFrame, keyed: DataFrame) -> DataFrame:
    """Runs with their bytes: (digit, key, start, n, copies, body)."""
    wanted = runs_.groupBy("key").agg(F.collect_list(F.struct("digit", "start", "n", "copies")).alias("runs"))
    texts = keyed.select("key", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            for a, b in slices(byte_sizes(texts)):
                part = batch.slice(a, b - a)
                rows = [
                    (x["digit"], key, x["start"], x["n"], x["copies"], text[x["start"] : x["start"] + x["n"] + WINDOW - 1])
                    for key, text, found in zip(part.column("key").to_pylist(), _bytes(part.column("text")), part.column("runs").to_pylist())
                    for x in found
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()))],
                    names=["digit", "key", "start", "n", "copies", "body"],
                )

    # Equal rows share a key and a text; one of them is enough.
    one = texts.join(wanted, "key").groupBy("key").agg(F.first("text").alias("text"), F.first("runs").alias("runs"))
    return one.mapInArrow(cut, "digit long, key long, start int, n int, copies long, body binary")


def _windows(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every window of every body, in order."""
    sizes = np.array([len(b) for b in bodies], np.int64)
    buffer = np.frombuffer(b"".join(bodies), np.uint8)
    _, window = rolling(buffer)
    n = sizes - WINDOW + 1
    begins = np.cumsum(sizes) - sizes
    row = np.repeat(np.arange(len(bodies)), n)
    return row, window[np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begins, n)]


def _ranges(key: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Consecutive starts of a key as (key, first, count)."""
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    return key[first], start[first], np.diff(np.append(first, len(key)))


STRETCH = 16


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs cut where the distance of a window's start to the digit is a multiple of STRETCH."""
    for batch in batches:
        for a, b in slices(byte_sizes(batch.column("body")), 500_000):
            part = batch.slice(a, b - a)
            rows = []
            for digit, key, start, copies, body in zip(*(part.column(c).to_pylist() for c in ("digit", "key", "start", "copies", "body"))):
                digits, windows = rolling(np.frombuffer(body, np.uint8))
                place = int(np.flatnonzero(digits.view(np.int64) == digit)[0])
                cuts = [0, *range((place - 1) % STRETCH + 1, len(windows), STRETCH), len(windows)]
                for x, y in zip(cuts, cuts[1:]):
                    if x < y:
                        own = windows[x:y].view(np.int64).tolist()
                        content = int.from_bytes(hashlib.blake2b(windows[x:y].tobytes(), digest_size=8).digest(), "little", signed=True)
                        rows.append((digit, content, key, start + x, copies, own))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["digit", "content", "key", "start", "copies", "windows"])


def repeated_windows(keyed: DataFrame, together: int = 2048) -> DataFrame:
    """(key, start, n): ranges of starts of windows that start anywhere else, too.

    Groups of up to ``together`` different runs are settled in one task; larger ones are
    dealt by stretches of windows, and what is left by window, so that no task holds more
    of a group than that.
    """
    every = written(first_pass(keyed), "suffix-runs")
    shared = every.groupBy("digit").agg(F.count("*").alias("members"), F.max("tied").alias("tied")).where("members > 1 or tied")
    alive = written(every.join(shared.select("digit"), "digit", "left_semi"), "suffix-shared")
    by_content = alive.groupBy("digit", "content").agg(
        F.count("*").alias("copies"), F.max("tied").alias("tied"), F.min(F.struct("key", "start", "n")).alias("one"))
    variants = written(by_content.select("digit", "content", "copies", "tied", "one.*"), "suffix-variants")

    settled = alive.join(variants.where("copies > 1").select("digit", "content"), ["digit", "content"], "left_semi").select("key", "start", "n")

    group = variants.groupBy("digit").agg(F.count("*").alias("size"), F.max((F.col("copies") == 1).cast("int")).alias("unsettled"), F.max("tied").alias("tied"))
    group = written(group.where("unsettled = 1 and (size > 1 or tied)").select("digit", "size"), "suffix-unsettled")
    left = variants.join(group, "digit")
    bodies = written(_texts_of(left, keyed), "suffix-bodies")

    small = bodies.join(group.where(F.col("size") <= together).select("digit"), "digit", "left_semi")
    large = bodies.join(group.where(F.col("size") > together).select("digit"), "digit", "left_semi")

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by digit; whole groups are settled together."""
        held: list[pa.RecordBatch] = []
        size = 0

        def settle(table: pa.Table) -> pa.RecordBatch:
            row, window = _windows(table.column("body").to_pylist())
            digit = table.column("digit").to_numpy()
            combined = _mix(window ^ _mix(digit.view(np.uint64))[row])
            order = np.argsort(combined, kind="stable")
            same = combined[order][1:] == combined[order][:-1]
            repeated = np.zeros(len(row), bool)
            repeated[order[1:]] |= same
            repeated[order[:-1]] |= same
            n = table.column("n").to_numpy().astype(np.int64)
            start = table.column("start").to_numpy().astype(np.int64)[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            repeated &= table.column("copies").to_numpy()[row] == 1
            key, first, count = _ranges(table.column("key").to_numpy()[row][repeated], start[repeated])
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(first, pa.int32()), pa.array(count, pa.int32())], names=["key", "start", "n"])

        for batch in batches:
            for a, b in slices(byte_sizes(batch.column("body")), 1_000_000):
                held.append(batch.slice(a, b - a))
                size += sum(byte_sizes(held[-1].column("body")))
                if size > 1_000_000:
                    table = pa.Table.from_batches(held)
                    digit = table.column("digit").to_numpy()
                    last = np.flatnonzero(digit[1:] != digit[:-1])
                    if len(last):
                        cut = int(last[-1]) + 1
                        yield settle(table.slice(0, cut))
                        held = table.slice(cut).to_batches()
                        size = sum(sum(byte_sizes(x.column("body"))) for x in held)
        if held:
            yield settle(pa.Table.from_batches(held))

    ranges = "key long, start int, n int"
    grouped = small.repartition("digit").sortWithinPartitions("digit").mapInArrow(within, ranges)

    # Large groups are refined once more before single windows: each run in stretches of up to 16
    # starts at equal distances from the digit, which copies share wherever no edit is near.
    stretches = written(large.mapInArrow(_stretches, "digit long, content long, key long, start int, copies long, windows array<long>"), "suffix-stretches")
    distinct = stretches.groupBy("digit", "content").agg(F.count("*").alias("times"), F.first(F.struct("key", "start", "copies", "windows")).alias("one"))
    shared_stretch = distinct.where("times > 1").select("digit", "content")
    dealt = stretches.where("copies = 1").join(shared_stretch, ["digit", "content"], "left_semi").select("key", "start", F.size("windows").alias("n"))
    single = distinct.select("digit", F.col("one.key").alias("key"), F.col("one.start").alias("start"), ((F.col("one.copies") == 1) & (F.col("times") == 1)).alias("open"), F.posexplode("one.windows").alias("at", "window"))
    twice = single.groupBy("digit", "window").agg(F.count("*").alias("times")).where("times > 1").select("digit", "window")
    alone = single.where("open").join(twice, ["digit", "window"], "left_semi").select("key", (F.col("start") + F.col("at")).alias("start"), F.lit(1).alias("n"))
    return settled.unionByName(grouped).unionByName(dealt).unionByName(alone)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, n_bytes, n_removed, spans, kept): every text without the bytes of repeated windows.

    A window is 200 bytes of a text's UTF-8 that also start anywhere else, in the same
    text or another (equal rows are each other's copies). All its occurrences go; spans
    are the removed byte ranges and ``kept`` the remaining bytes, which may end inside a
    character. ``row`` has the other columns of ``docs``. Null texts count as empty; texts
    under 200 bytes stay whole; an empty table gives no rows; null and repeated ids are
    no matter.
    """
    keyed = _keyed(docs, id_col, text_col)
    covers = repeated_windows(keyed.select("key", "text")).groupBy("key").agg(F.collect_set(F.struct("start", "n")).alias("covers"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            for a, b in slices(byte_sizes(texts)):
                part = batch.slice(a, b - a)
                rows = []
                for raw, covers in zip(_bytes(part.column("text")), part.column("covers").to_pylist()):
                    spans: list[list[int]] = []
                    for start, end in sorted((c["start"], c["start"] + c["n"] - 1 + WINDOW) for c in covers or ()):
                        if spans and start <= spans[-1][1]:
                            spans[-1][1] = max(spans[-1][1], end)
                        else:
                            spans.append([start, end])
                    kept, at = [], 0
                    for start, end in spans:
                        kept.append(raw[at:start])
                        at = end
                    kept.append(raw[at:])
                    rows.append((len(raw), sum(e - s for s, e in spans), [{"start": s, "stop": e} for s, e in spans], b"".join(kept)))
                kinds = (pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])), pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("row"), *(pa.array(c, t) for c, t in zip(zip(*rows), kinds))], names=["row", "n_bytes", "n_removed", "spans", "kept"])

    span = ArrayType(StructType([StructField("start", LongType()), StructField("stop", LongType())]))
    schema = StructType([keyed.schema["row"], StructField("n_bytes", LongType()), StructField("n_removed", LongType()), StructField("spans", span), StructField("kept", BinaryType())])
    return keyed.join(covers, "key", "left").select("row", "text", "covers").mapInArrow(cut, schema)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """All rows of ``docs`` with repeated windows cut from the text (and characters cut in half), and the length, if there, renewed."""
    found = remove_repeats(docs, id_col, text_col)
    changed = F.col("n_removed") > 0

    def whole(column: pd.Series) -> pd.Series:
        return column.map(lambda b: b.decode("utf-8", "ignore"))

    out = found.select("row", changed.alias("changed"), F.pandas_udf(whole, "string")("kept").alias("text"))
    if length_col not in docs.columns:
        return rows_again(out, docs, text_col)
    length = F.when(F.col("changed"), F.length("text")).otherwise(F.col(f"row.`{length_col}`")).cast(docs.schema[length_col].dataType)
    return rows_again(out.withColumn("row", F.col("row").withField(f"`{length_col}`", length)), docs, text_col)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: bytes, removed bytes and spans, and the digest of what remains."""
    found = remove_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("row.doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
