"""SentencePiece encoding whose pieces keep the bytes of the original text they stand for.

Normalisation is done here, by the longest prefixes of the model's compiled character
map, and records for every normalised byte the original byte it came from. The
normalised text then goes through the model's merges (with its own normaliser switched
off), and the piece lengths are projected through the alignment to byte spans.
"""

from __future__ import annotations

import hashlib
import re
import struct
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from strandline.llm.common import Recent, documents, id_and_text, text_slices
from strandline.llm.subwords import default_path

BLANK = "▁"


class CharacterMap:
    """A compiled character map: a double-array trie of byte strings and their replacements."""

    def __init__(self, blob: bytes):
        self.units: tuple[int, ...] = ()
        self.values = b""
        if blob:
            (size,) = struct.unpack_from("<I", blob)
            self.units = struct.unpack_from(f"<{size // 4}I", blob, 4)
            self.values = blob[4 + size :]

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest key that starts at ``at``."""
        if not self.units:
            return None
        units, found = self.units, None
        node = 0
        step = units[0]
        node ^= (step >> 10) << ((step & 0x200) >> 6)
        for i in range(at, len(text)):
            node ^= text[i]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != text[i]:
                break
            node ^= (unit >> 10) << ((unit & 0x200) >> 6)
            if unit >> 8 & 1:
                found = i + 1 - at, units[node] & 0x7FFFFFFF
        if found is None:
            return None
        length, value = found
        return length, self.values[value : self.values.index(b"\0", value)]

    def first_bytes(self) -> frozenset[int]:
        """Bytes with which a key may start."""
        if not self.units:
            return frozenset()
        root = (self.units[0] >> 10) << ((self.units[0] & 0x200) >> 6)
        return frozenset(b for b in range(256) if root ^ b < len(self.units) and self.units[root ^ b] & 0x800000FF == b)


class Normaliser:
    """Normalised text of an original, with the original byte behind each normalised one."""

    def __init__(self, charmap: CharacterMap, dummy_prefix: bool, squeeze: bool, escape: bool):
        self.charmap, self.dummy, self.squeeze = charmap, dummy_prefix, squeeze
        self.blank = BLANK.encode() if escape else b" "
        self.first = charmap.first_bytes()

    @property
    def plain(self) -> bool:
        """Whether only the blanks change."""
        return not self.charmap.units and not self.squeeze

    def _prefix(self, raw: bytes, at: int) -> tuple[int, bytes]:
        lead = raw[at]
        size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        if lead in self.first and (hit := self.charmap.longest(raw, at)):
            return hit
        return size, raw[at : at + size]

    def __call__(self, text: str) -> tuple[bytes, list[int]]:
        """(normalised bytes, for each of them and for the end the original offset)."""
        raw = text.encode()
        out, origin, at = bytearray(), [], 0
        if self.squeeze:  # blanks at the front are left out
            while at < len(raw):
                size, put = self._prefix(raw, at)
                if put.strip(b" "):
                    break
                at += size
        if at >= len(raw):
            return b"", [len(raw) if self.squeeze else 0]
        if self.dummy:
            out += self.blank
            origin += [at] * len(self.blank)
        after_blank = self.squeeze
        while at < len(raw):
            size, put = self._prefix(raw, at)
            if after_blank:
                put = put.lstrip(b" ")
            for byte in put:
                if byte == 0x20:
                    out += self.blank
                    origin += [at] * len(self.blank)
                else:
                    out.append(byte)
                    origin.append(at)
            if put:
                after_blank = self.squeeze and put.endswith(b" ")
            at += size
        end = len(raw)
        if self.squeeze:
            while out.endswith(self.blank):
                end = origin[len(out) - len(self.blank)]
                del out[-len(self.blank) :], origin[-len(self.blank) :]
        origin.append(end)
        return bytes(out), origin


class PieceModel:
    """A loaded model; one per worker process and path.

    Texts are cut where no piece of the vocabulary can reach across (before a run of
    blanks, and around line breaks where these are in no longer piece); each part goes
    through the model once and is remembered, about ``limit`` parts at a time.
    """

    _loaded: dict[str, PieceModel] = {}

    def __init__(self, path: str, limit: int = 300_000):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        self.normalise = Normaliser(CharacterMap(spec.precompiled_charsmap), spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces)
        self.dummy = spec.add_dummy_prefix
        spec.precompiled_charsmap, spec.name = b"", "identity"
        spec.add_dummy_prefix = spec.remove_extra_whitespaces = False
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        ordinary = [p.piece for p in model.pieces if p.type in (1, 4)]
        across = any(re.search(f"[^{BLANK}]{BLANK}", p) for p in ordinary)
        lines = any("\n" in p and len(p) > 1 for p in ordinary)
        tied = across or not model.trainer_spec.byte_fallback or any(p.type == 4 for p in model.pieces)
        blank, cut = f" {BLANK}", "" if lines else "\n"
        pattern = r"(?s:.+)" if tied else rf"[{blank}]*[^{blank}{cut}]+|[{blank}]+" + ("" if lines else r"|\n")
        self.parts = re.compile(pattern).findall
        # The text behind each id: its bytes, and how many of the normalised text it takes.
        self.surface = [bytes([int(p.piece[3:5], 16)]) if p.type == 6 else p.piece.replace(BLANK, " ").encode() for p in model.pieces]
        self.byte = [p.type == 6 for p in model.pieces]
        self.taken = np.array([1 if p.type == 6 else len(p.piece.encode()) for p in model.pieces], np.int64)
        self.known = Recent(limit)

    @classmethod
    def load(cls, path: str) -> PieceModel:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def _surface(self, ids: Sequence[int]) -> bytes:
        """Bytes of a part; what its byte pieces spell but no character has becomes U+FFFD."""
        if any(self.byte[i] for i in ids):
            return b"".join(self.surface[i] for i in ids).decode("utf-8", "replace").encode()
        return b"".join(self.surface[i] for i in ids)

    def encode(self, texts: Sequence[str]) -> list[tuple[list[tuple], list[int] | None]]:
        """For each text its parts as (ids, their decimals, surface), and the alignment where it isn't plain."""
        split, aligned = [], []
        for text in texts:
            if self.normalise.plain:
                split.append(self.parts((" " if self.dummy and text else "") + text))
                aligned.append(None)
            else:
                out, origin = self.normalise(text)
                split.append(self.parts(out.decode()))
                aligned.append(origin)
        new = self.known.missing(set(chain.from_iterable(split)))
        for part, ids in zip(new, self.library.encode(new, num_threads=1) if new else []):
            self.known[part] = (np.array(ids, "<i4").tobytes(), ",".join(map(str, ids)).encode(), self._surface(ids))
        out = [[self.known[p] for p in parts] for parts in split]
        for part in new:
            if len(part) > 64:
                del self.known[part]
        return list(zip(out, aligned))

    def decoded(self, parts: Sequence[tuple]) -> bytes:
        text = b"".join([p[2] for p in parts])
        return text[1:] if self.dummy and text.startswith(b" ") else text

    def spans(self, text: str, ids: np.ndarray, origin: list[int] | None) -> tuple[np.ndarray, np.ndarray]:
        """Byte span in the original of each piece; the front blank that normalisation adds takes none."""
        ends = np.cumsum(self.taken[ids])
        if origin is None:
            raw = np.frombuffer(text.encode(), np.uint8)
            # A blank takes three normalised bytes and one (or, written as itself, three) of the original.
            wide = np.where(raw == 0x20, 3, 1)
            reach = np.concatenate([[0], np.cumsum(wide)]) + (3 if self.dummy and len(raw) else 0)
            at = lambda x: np.maximum(np.searchsorted(reach, x, side="left"), 0)
            last = at(ends)
            return np.concatenate([[0], last[:-1]]).astype(np.int64)[: len(ids)], last.astype(np.int64)
        table = np.array(origin, np.int64)
        begins = table[ends - self.taken[ids]]
        return begins, np.concatenate([begins[1:], [table[-1]]]) if len(ids) else begins


#: What ``encode_pieces`` can return besides doc_id.
COLUMNS = {
    "ids": pa.list_(pa.int32()), "begins": pa.list_(pa.int64()), "ends": pa.list_(pa.int64()), "decoded": pa.string(),
    "n_tokens": pa.int64(), "covered": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string(),
}
_SPARK = {"ids": "array<int>", "begins": "array<long>", "ends": "array<long>", "n_tokens": "long", "covered": "long"}


def encode_pieces(docs: DataFrame, model: str, columns: Sequence[str] = ("ids", "begins", "ends", "decoded"), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document its piece ids, their byte spans in the original, and the decoded text.

    Also ``n_tokens``, ``covered`` (where the last span ends: the bytes of the text) and the
    SHA-256 of the ids (decimals joined by commas) and of the decoded text. Rows are
    independent: no shuffle. A null text counts as empty: no ids. Repeated rows give
    repeated results, an empty table none.
    """
    wanted = list(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = PieceModel.load(model)
        for batch in batches:
            for part, texts in text_slices(batch):
                out: dict[str, list] = {c: [] for c in wanted}
                for text, (parts, origin) in zip(texts, pieces.encode(texts)):
                    ids = np.frombuffer(b"".join([p[0] for p in parts]), "<i4")
                    cells: dict = {"n_tokens": len(ids)}
                    if {"begins", "ends", "covered"} & set(wanted):
                        begins, ends = pieces.spans(text, ids, origin)
                        cells |= {"begins": begins, "ends": ends, "covered": int(ends[-1]) if len(ends) else 0}
                    if "ids" in wanted:
                        cells["ids"] = ids
                    if "ids_sha256" in wanted:
                        cells["ids_sha256"] = hashlib.sha256(b",".join([p[1] for p in parts])).hexdigest()
                    if {"decoded", "decoded_sha256"} & set(wanted):
                        text = pieces.decoded(parts)
                        cells["decoded"] = text.decode()
                        cells["decoded_sha256"] = hashlib.sha256(text).hexdigest()
                    for c in wanted:
                        out[c].append(cells[c])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(out[c], COLUMNS[c]) for c in wanted)], names=["doc_id", *wanted])

    schema = ", ".join(["doc_id long", *(f"{c} {_SPARK.get(c, 'string')}" for c in wanted)])
    return id_and_text(docs, id_col, text_col).mapInArrow(run, schema)


def pieces_of(begins: Sequence[int], ends: Sequence[int], start: int, stop: int) -> range:
    """Numbers of the pieces whose spans meet bytes ``start`` to ``stop`` of the original."""
    first = bisect_right(ends, start)
    last = first
    while last < len(begins) and begins[last] < stop:
        last += 1
    return range(first, last)


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: how many pieces, and the digests of its ids and of the decoded text."""
    return encode_pieces(documents(spark, sf_dir), default_path("piece_bpe_32k.model"), ["n_tokens", "ids_sha256", "decoded_sha256", "covered"])
