"""Token counts that follow edits: a segment tree of pre-tokens per document.

Leaves hold up to 64 pre-tokens as (characters, tokens); inner nodes hold sums. An edit
finds its leaves by character position, re-encodes the pre-tokens it touches and their
neighbours up to where the old boundaries return, and updates the sums above.
"""

from __future__ import annotations

import re
import struct
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from strandline.llm.common import documents, id_and_text, text_slices
from strandline.llm.subwords import KEEPS_SPACES, Subwords, default_path

LEAF = 64
Unit = tuple[int, int]  # characters, tokens
Edit = tuple[int, int, str]  # from, to (not included) in the unedited text, and what stands there instead


class SegmentTree:
    """Sums of (characters, tokens) over leaves of pre-tokens."""

    def __init__(self, units: Sequence[Unit]):
        self.leaves: list[list[Unit]] = [list(units[i : i + LEAF]) for i in range(0, len(units), LEAF)] or [[]]
        self._build()

    def _build(self) -> None:
        self.size = 1 << max(0, (len(self.leaves) - 1).bit_length())
        self.chars, self.tokens = [0] * (2 * self.size), [0] * (2 * self.size)
        for i, leaf in enumerate(self.leaves):
            self.chars[self.size + i], self.tokens[self.size + i] = sum(u[0] for u in leaf), sum(u[1] for u in leaf)
        for i in range(self.size - 1, 0, -1):
            self._sum(i)

    def _sum(self, i: int) -> None:
        self.chars[i], self.tokens[i] = self.chars[2 * i] + self.chars[2 * i + 1], self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    @property
    def units(self) -> list[Unit]:
        return [u for leaf in self.leaves for u in leaf]

    def leaf_at(self, offset: int) -> tuple[int, int]:
        """(leaf, its first character) of the leaf that holds a character, or the last one."""
        i, start = 1, 0
        while i < self.size:
            i *= 2
            if offset >= start + self.chars[i] and self.chars[i + 1]:
                start += self.chars[i]
                i += 1
        return i - self.size, start

    def replace(self, first: int, last: int, units: list[Unit]) -> None:
        """Put units in the place of leaves first to last; only sums above them change if their number stays."""
        n = last - first + 1
        if len(units) <= 2 * LEAF * n and (n == 1 or len(units) >= n):
            cut = [len(units) * k // n for k in range(n + 1)]
            self.leaves[first : last + 1] = [units[a:b] for a, b in zip(cut, cut[1:])]
            level = range(self.size + first, self.size + last + 1)
            for i in level:
                leaf = self.leaves[i - self.size]
                self.chars[i], self.tokens[i] = sum(u[0] for u in leaf), sum(u[1] for u in leaf)
            while level.start > 1:
                level = range(level.start // 2, (level.stop - 1) // 2 + 1)
                for i in level:
                    self._sum(i)
        else:
            self.leaves[first : last + 1] = [units[i : i + LEAF] for i in range(0, len(units), LEAF)] or [[]]
            self._build()

    def dump(self) -> bytes:
        """The leaves' units; sums are made again when loaded."""
        flat = np.array(self.units, np.uint32).reshape(-1, 2)
        wide = bool(len(flat) and flat.max() > 255)
        return struct.pack("<?", wide) + zlib.compress(flat.T.astype("<u4" if wide else np.uint8).tobytes(), 1)

    @classmethod
    def load(cls, data: bytes) -> SegmentTree:
        flat = np.frombuffer(zlib.decompress(data[1:]), "<u4" if data[0] else np.uint8).reshape(2, -1)
        return cls(list(zip(flat[0].tolist(), flat[1].tolist())))


def apply_edits(tree: SegmentTree, text: str, edits: Sequence[Edit], split: Callable, count: Callable) -> tuple[str, int]:
    """Bring a tree up to date with edits of its text (any order, not overlapping).

    ``split`` cuts a text into pre-tokens, ``count`` gives their tokens. Returns the
    edited text and how many pre-tokens were encoded.
    """
    encoded = 0
    # From the back, so that positions in front of an edit stay those of the unedited text.
    for start, stop, new in sorted(edits, reverse=True):
        first, at = tree.leaf_at(max(start - 1, 0))
        last, _ = tree.leaf_at(min(stop, max(tree.chars[1] - 1, 0)))
        shift = len(new) - (stop - start)
        while True:
            old = [u for leaf in tree.leaves[first : last + 1] for u in leaf]
            bounds = [at]
            for u in old:
                bounds.append(bounds[-1] + u[0])
            # Stays: all but one of the pre-tokens that end before the edit.
            keep = bisect_left(bounds, start) - 2
            if keep < 0 and first > 0:
                first -= 1
                at -= tree.chars[tree.size + first]
                continue
            keep = max(keep, 0)
            left = bounds[keep]
            whole = last == len(tree.leaves) - 1
            region = text[left:start] + new + text[stop : bounds[-1] + (0 if whole else 1)]
            pieces = split(region)
            old_bounds = {b + shift: k for k, b in enumerate(bounds) if b >= stop}
            position, resume = left, None
            for k, piece in enumerate(pieces):
                position += len(piece)
                # The last boundary is forced by the end of the region unless the text ends there.
                if position >= start + len(new) and position in old_bounds and (whole or k + 1 < len(pieces)):
                    resume = k + 1, old_bounds[position]
                    break
            if resume is None and not pieces and whole:
                resume = 0, len(old)
            if resume is not None:
                break
            last += 1
        fresh = pieces[: resume[0]]
        encoded += len(fresh)
        tree.replace(first, last, old[:keep] + list(zip(map(len, fresh), count(fresh))) + old[resume[1] :])
        text = text[:start] + new + text[stop:]
    return text, encoded


def count_trees(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, n_tokens, tree) of every document; a null text counts as empty. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Subwords.load(vocabulary, KEEPS_SPACES)
        for batch in batches:
            for part, texts in text_slices(batch):
                trees = [SegmentTree(units) for units in words.counts(texts)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text"), pa.array([t.total for t in trees], pa.int64()), pa.array([t.dump() for t in trees], pa.binary())],
                    names=["doc_id", "text", "n_tokens", "tree"],
                )

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, text string, n_tokens long, tree binary")


def recount(counted: DataFrame, vocabulary: str, edits_of: Callable[[str], list[Edit]]) -> DataFrame:
    """(doc_id, n_tokens, n_edits, n_encoded, n_tokens_after, tree) after the edits that ``edits_of`` gives for each text.

    Rows come from ``count_trees``. Only pre-tokens near an edit are encoded (``n_encoded``).
    Repeated rows give repeated results, an empty table none.
    """
    kinds = {"n_edits": pa.int64(), "n_encoded": pa.int64(), "n_tokens_after": pa.int64(), "tree": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Subwords.load(vocabulary, KEEPS_SPACES)

        def count(units: list[str]) -> list[int]:
            return [len(ids) // 4 for ids in words.encode_units(units)]

        for batch in batches:
            for part, texts in text_slices(batch):
                rows = []
                for text, data in zip(texts, part.column("tree").to_pylist()):
                    edits = edits_of(text)
                    if not edits:
                        rows.append((0, 0, None, data))
                        continue
                    tree = SegmentTree.load(data)
                    _, encoded = apply_edits(tree, text, edits, words.units, count)
                    rows.append((len(edits), encoded, tree.total, tree.dump()))
                columns = list(zip(*rows))
                columns[2] = [n if a is None else a for a, n in zip(columns[2], part.column("n_tokens").to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("n_tokens"), *(pa.array(c, t) for c, t in zip(columns, kinds.values()))],
                    names=["doc_id", "n_tokens", *kinds],
                )

    return counted.mapInArrow(run, "doc_id long, n_tokens long, n_edits long, n_encoded long, n_tokens_after long, tree binary")


def count_edited(docs: DataFrame, vocabulary: str, edits_of: Callable[[str], list[Edit]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_edits, n_encoded, n_tokens_after) before and after edits that are known at once.

    As ``recount`` after ``count_trees``, in one pass: a tree is kept for as long as its document
    is edited, and a document without an edit needs none. Null texts count as empty; repeated
    rows give repeated results, an empty table none. No shuffle.
    """
    names = ["doc_id", "n_tokens", "n_edits", "n_encoded", "n_tokens_after"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Subwords.load(vocabulary, KEEPS_SPACES)

        def count(units: list[str]) -> list[int]:
            return [len(ids) // 4 for ids in words.encode_units(units)]

        for batch in batches:
            for part, texts in text_slices(batch, most=6_000_000):
                edits = [edits_of(t) for t in texts]
                plain = iter(words.encode([t for t, e in zip(texts, edits) if not e]))
                trees = iter(words.counts([t for t, e in zip(texts, edits) if e]))
                rows = []
                for text, own in zip(texts, edits):
                    if own:
                        tree = SegmentTree(next(trees))
                        before = tree.total
                        _, encoded = apply_edits(tree, text, own, words.units, count)
                        rows.append((before, len(own), encoded, tree.total))
                    else:
                        n = len(next(plain)) // 4
                        rows.append((n, 0, 0, n))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, pa.int64()) for c in zip(*rows))], names=names)

    return id_and_text(docs, id_col, text_col).mapInArrow(run, ", ".join(f"{n} long" for n in names))


_ASKED = re.compile(r"[@\d]").search
_PERSONAL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+|(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d.])|\+\d{1,3}[ (]*\d{2,4}[) -]*\d{3}-\d{4}")


def redactions(text: str) -> list[Edit]:
    """Edits that blank out mail addresses, IP addresses and phone numbers, and drop lines that repeat an earlier one."""
    edits: list[Edit] = []
    seen: set[str] = set()
    at = 0
    for line in text.split("\n"):
        end = at + len(line)
        if line.strip() and line in seen:
            edits.append((max(at - 1, 0), end, ""))
        else:
            seen.add(line)
            if _ASKED(line):
                edits += [(at + m.start(), at + m.end(), "[redacted]") for m in _PERSONAL.finditer(line)]
        at = end + 1
    return edits


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document before and after its redactions, counted through the trees."""
    vocabulary = default_path("byte_bpe_50k.json")
    return count_edited(documents(spark, sf_dir), vocabulary, redactions)
