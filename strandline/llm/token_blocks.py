"""Token ids as patched frame-of-reference blocks, in parquet rows that hold whole documents.

A payload packs the ids of consecutive documents in blocks of 128: the block's minimum is
subtracted, the differences are packed at the width that holds the chosen share of them,
and the others stand as (position, value) exceptions. An index of block starts lets a
range of ids be read without the blocks around it.

    u32 count of ids | u32 count of blocks | u32 start of each block, and the end
    block: u32 minimum | u8 width | u8 exceptions | packed differences | u8 positions | u32 values
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import documents, id_and_text, text_slices
from strandline.llm.subwords import DROPS_SPACES, Subwords, default_path
from strandline.session import work_folder

BLOCK = 128
HEAD = 6  # bytes of a block before its packed part
CHUNK = 1 << 18  # ids in a row's payload, at least, while documents last


def _ramp(counts: np.ndarray) -> np.ndarray:
    """0..n-1 for each n."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - counts, counts)


def encode_blocks(ids: np.ndarray, share: float = 0.9) -> bytes:
    """A payload of unsigned 32-bit ids; ``share`` of each block's differences fit its width."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    if not blocks:
        return np.array([0, 0, 12], "<u4").tobytes()
    grid = np.empty(blocks * BLOCK, np.uint32)
    grid[:n] = ids
    grid[n:] = ids[-1]  # the last block is filled up with its last id
    grid = grid.reshape(blocks, BLOCK)
    low = grid.min(axis=1)
    rest = grid - low[:, None]
    bits = np.frexp(rest.astype(np.float64))[1].astype(np.uint8)  # bits that a difference needs
    width = np.sort(bits, axis=1)[:, int(np.ceil(share * BLOCK)) - 1]
    odd = bits > width[:, None]
    odd_rows, odd_at = np.nonzero(odd)
    odds = odd.sum(axis=1)
    packed = width.astype(np.int64) * (BLOCK // 8)
    size = HEAD + packed + 5 * odds
    head = 8 + 4 * (blocks + 1)
    starts = head + np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(int(starts[-1]), np.uint8)
    out[:8] = np.array([n, blocks], "<u4").view(np.uint8)
    out[8:head] = starts.astype("<u4").view(np.uint8)
    at = starts[:-1]
    out[at[:, None] + np.arange(4)] = low.astype("<u4").view(np.uint8).reshape(-1, 4)
    out[at + 4], out[at + 5] = width, odds
    for w in np.unique(width).tolist():
        if w:
            mine = np.flatnonzero(width == w)
            plane = (rest[mine][:, :, None] >> np.arange(w, dtype=np.uint32)).astype(np.uint8) & 1
            out[at[mine][:, None] + HEAD + np.arange(w * BLOCK // 8)] = np.packbits(plane.reshape(len(mine), -1), axis=1, bitorder="little")
    if len(odd_rows):
        k, base = _ramp(odds), at[odd_rows] + HEAD + packed[odd_rows]
        out[base + k] = odd_at
        out[(base + odds[odd_rows] + 4 * k)[:, None] + np.arange(4)] = rest[odd_rows, odd_at].astype("<u4").view(np.uint8).reshape(-1, 4)
    return out.tobytes()


def decode_blocks(payload: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids ``first`` to ``last`` (not included) of a payload; only their blocks are unpacked."""
    raw = np.frombuffer(payload, np.uint8)
    n, blocks = (int(x) for x in raw[:8].view("<u4"))
    last = n if last is None else min(last, n)
    if first >= last:
        return np.empty(0, np.uint32)
    a, b = first // BLOCK, -(-last // BLOCK)
    starts = raw[8 : 8 + 4 * (blocks + 1)].view("<u4")[a:b].astype(np.int64)
    low = raw[starts[:, None] + np.arange(4)].view("<u4").reshape(-1)
    width, odds = raw[starts + 4].astype(np.int64), raw[starts + 5].astype(np.int64)
    rest = np.zeros((b - a, BLOCK), np.uint32)
    for w in np.unique(width).tolist():
        if w:
            mine = np.flatnonzero(width == w)
            plane = np.unpackbits(raw[starts[mine][:, None] + HEAD + np.arange(w * BLOCK // 8)], axis=1, bitorder="little").reshape(len(mine), BLOCK, w)
            rest[mine] = (plane.astype(np.uint32) << np.arange(w, dtype=np.uint32)).sum(axis=2, dtype=np.uint32)
    if odds.any():
        rows, k = np.repeat(np.arange(b - a), odds), _ramp(odds)
        base = starts[rows] + HEAD + width[rows] * (BLOCK // 8)
        rest[rows, raw[base + k]] = raw[(base + odds[rows] + 4 * k)[:, None] + np.arange(4)].view("<u4").reshape(-1)
    return (rest + low[:, None]).reshape(-1)[first - a * BLOCK : last - a * BLOCK]


def write_token_table(docs: DataFrame, folder: str, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write every document's ids, ended by ``end_id``, in ascending order of the document ids.

    Documents are dealt into ranges of ids and sorted inside each (null ids first; repeated
    ids by a hash of the text); null texts count as empty and an empty table writes no rows.
    A row of the table holds whole documents, so a very long text makes one long payload.
    Shards number the ranges; positions count from the start of the shard.
    """
    keyed = id_and_text(docs, id_col, text_col).select("*", F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("row"))
    order = ["doc_id", "tie", "row"]  # the last keeps very many equal rows from one range
    ordered = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    end = np.array([end_id], "<u4").tobytes()

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part = Subwords.load(vocabulary, DROPS_SPACES), TaskContext.get().partitionId()
        held: list[bytes] = []
        held_ids: list[int | None] = []
        first = size = 0

        def row() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), "<u4")
            cells = [[part], [first], [len(ids)], [list(held_ids)], [[len(x) // 4 for x in held]], [encode_blocks(ids)]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, _TABLE)], names=_NAMES)

        for batch in batches:
            for part_batch, texts in text_slices(batch, most=6_000_000):
                for doc_id, ids in zip(part_batch.column("doc_id").to_pylist(), words.encode(texts)):
                    held.append(ids + end)
                    held_ids.append(doc_id)
                    size += len(ids) // 4 + 1
                    if size >= CHUNK:
                        yield row()
                        first, size = first + size, 0
                        held.clear()
                        held_ids.clear()
        if held:
            yield row()

    ordered.mapInArrow(shard, "shard int, first long, n_ids long, doc_ids array<long>, lengths array<long>, payload binary").write.parquet(folder)


_NAMES = ["shard", "first", "n_ids", "doc_ids", "lengths", "payload"]
_TABLE = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]


def read_token_table(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document: ``ids`` little-endian unsigned 32-bit,
    ``start`` the ids of all documents before it."""
    table = spark.read.schema("shard int, first long, n_ids long, doc_ids array<long>, lengths array<long>, payload binary").parquet(folder)
    # A number per shard; shards are the tasks that wrote the table.
    shards = sorted(table.groupBy("shard").agg(F.sum("n_ids")).collect())
    bases = dict(zip([s for s, _ in shards], accumulate((n for _, n in shards), initial=0)))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                lengths, at = batch.column("lengths")[r].as_py(), bases[batch.column("shard")[r].as_py()] + batch.column("first")[r].as_py()
                ids = decode_blocks(batch.column("payload")[r].as_py()).astype("<u4").tobytes()
                ends = np.cumsum(lengths)
                begins = ends - lengths
                yield pa.RecordBatch.from_arrays(
                    [pa.array(batch.column("doc_ids")[r].as_py(), pa.int64()), pa.array(begins + at, pa.int64()),
                     pa.array(lengths, pa.int64()), pa.array([ids[4 * a : 4 * b] for a, b in zip(begins.tolist(), ends.tolist())], pa.binary())],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )

    return table.mapInArrow(unpack, "doc_id long, start long, n_tokens long, ids binary")


def op1_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: where its ids lie in the written stream, how many, and their checksum."""
    folder = work_folder(spark, "token-blocks")
    write_token_table(documents(spark, sf_dir), folder, default_path("word_bpe_49k.json"), end_id=1)
    return read_token_table(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
