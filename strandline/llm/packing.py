"""Harmonic packing of token ids into sequences of fixed capacity."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import documents, id_and_text, text_slices
from strandline.llm.subwords import KEEPS_SPACES, Subwords, default_path

#: doc_id, start in the document, ids (4 bytes each), ids of the whole document.
Piece = tuple


def _cut(piece: Piece, n: int) -> tuple[Piece, Piece | None]:
    """The first n ids of a piece, and the rest."""
    doc, start, ids, total = piece
    if len(ids) <= 4 * n:
        return piece, None
    return (doc, start, ids[: 4 * n], total), (doc, start + n, ids[4 * n :], total)


class HarmonicPacker:
    """Sequences of ``capacity`` ids, filled by one worker on its own.

    A document gives whole sequences; what remains, of length r, is in class
    j = capacity // r, and a bin of class j takes exactly j remainders (they always fit).
    The gap that a full bin leaves is closed with ids cut from the next long documents.
    Bins that wait for such ids are bounded: beyond ``waiting`` the emptiest is poured
    into the others. At the end all but one are full; the last is cut into powers of two.
    """

    def __init__(self, capacity: int = 1024, waiting: int = 256):
        self.capacity, self.waiting = capacity, waiting
        self.open: dict[int, list[Piece]] = {}
        self.gapped: list[tuple[int, list[Piece]]] = []  # (ids held, pieces)

    def add(self, piece: Piece) -> Iterator[list[Piece]]:
        rest: Piece | None = piece
        while rest is not None and len(rest[2]) >= 4 * self.capacity:
            if self.gapped:
                held, pieces = self.gapped.pop()
                head, rest = _cut(rest, self.capacity - held)
                yield [*pieces, head]
            else:
                head, rest = _cut(rest, self.capacity)
                yield [head]
        if rest is None:
            return
        kind = self.capacity // (len(rest[2]) // 4)
        pieces = self.open.setdefault(kind, [])
        pieces.append(rest)
        if len(pieces) == kind:
            yield from self._close(self.open.pop(kind))
            if len(self.gapped) > self.waiting:
                yield from self._pour(self.waiting // 2)

    def _close(self, pieces: list[Piece]) -> Iterator[list[Piece]]:
        held = sum(len(p[2]) for p in pieces) // 4
        if held == self.capacity:
            yield pieces
        else:
            self.gapped.append((held, pieces))

    def _pour(self, down_to: int) -> Iterator[list[Piece]]:
        """Empty the least filled bins into the fullest, so that few documents are cut."""
        self.gapped.sort(key=lambda x: x[0])
        while len(self.gapped) > down_to:
            _, source = self.gapped.pop(0)
            while source and self.gapped:
                held, pieces = self.gapped.pop()
                while source and held < self.capacity:
                    head, rest = _cut(source.pop(), self.capacity - held)
                    pieces.append(head)
                    held += len(head[2]) // 4
                    if rest is not None:
                        source.append(rest)
                if held == self.capacity:
                    yield pieces
                else:
                    self.gapped.append((held, pieces))
            if source:
                self.gapped.append((sum(len(p[2]) for p in source) // 4, source))

    def finish(self) -> Iterator[list[Piece]]:
        for kind in sorted(self.open):
            yield from self._close(self.open[kind])
        self.open.clear()
        yield from self._pour(1)
        for _, pieces in self.gapped:
            left = sum(len(p[2]) for p in pieces) // 4
            queue = pieces[::-1]
            while left:
                room = size = 1 << (left.bit_length() - 1)
                out = []
                while room:
                    head, rest = _cut(queue.pop(), room)
                    out.append(head)
                    room -= len(head[2]) // 4
                    if rest is not None:
                        queue.append(rest)
                yield out
                left -= size
        self.gapped.clear()


SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
_TYPES = [pa.int64()] * 6 + [pa.binary()]
_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def pack(docs: DataFrame, vocabulary: str, end_id: int, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of every document (its ids and ``end_id``) placed in sequences.

    Every partition packs what it reads: no shuffle, whatever keys are frequent. Sequence
    ids hold the partition in their upper bits. Null texts count as empty (a document of
    one id), repeated rows are packed each, an empty table gives no rows. The length of
    each sequence is ``capacity``, or a power of two at the end of a partition, so no
    padding is needed.
    """
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, packer = Subwords.load(vocabulary, KEEPS_SPACES), HarmonicPacker(capacity)
        number = TaskContext.get().partitionId() << 33
        rows: list[tuple] = []

        def place(sequence: list[Piece]) -> None:
            nonlocal number
            offset = 0
            for doc, start, ids, total in sequence:
                length = len(ids) // 4
                rows.append((doc, start, length, total, number, offset, ids))
                offset += length
            number += 1

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], names=_NAMES)
            rows.clear()
            return batch

        for batch in batches:
            for part, texts in text_slices(batch):
                for doc, ids in zip(part.column("doc_id").to_pylist(), words.encode(texts)):
                    for sequence in packer.add((doc, 0, ids + end, len(ids) // 4 + 1)):
                        place(sequence)
                if rows:
                    yield flush()
        for sequence in packer.finish():
            place(sequence)
        if rows:
            yield flush()

    return id_and_text(docs, id_col, text_col).mapInArrow(run, SCHEMA)


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies, with the checksum of its ids."""
    return digest(pack(documents(spark, sf_dir), default_path("byte_bpe_50k.json"), end_id=0))
