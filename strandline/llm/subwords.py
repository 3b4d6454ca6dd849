"""Sub-word encoding with the tokenizers library, remembered per unit.

Where no token of a vocabulary spans the gap between two units, a text's ids are those of
its units in order; that is tested when a vocabulary is loaded, and texts are encoded
whole if it fails. Texts are cut with array operations on their bytes
and each distinct unit of a slice is looked up once; those that a worker has not met go
through the library.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Sequence
from itertools import chain

import numpy as np
import pyarrow as pa

from strandline.llm.common import Recent

# The characters with the Unicode property White_Space.
SPACES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

#: Byte-level pre-tokens keep one space before a word; the rest of a run of spaces stands alone.
KEEPS_SPACES = rf" ?[^{SPACES}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"
DROPS_SPACES = rf"[^{SPACES}]+"

_BYTES = np.arange(256)
_ASCII_SPACE = np.isin(_BYTES, list(b"\t\n\x0b\x0c\r "))
_LETTER = np.isin(_BYTES | 32, np.arange(ord("a"), ord("z") + 1)) & (_BYTES < 128)
_SIGN = (_BYTES < 128) & ~_LETTER & ~_ASCII_SPACE & (_BYTES != ord("'"))
_PLAIN = re.compile(" ?[A-Za-z]+").fullmatch


def _space_bytes(raw: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 text belong to characters of ``SPACES``; ``raw`` ends in two spare zeros."""
    space = _ASCII_SPACE[raw]
    for lead in (0xC2, 0xE1, 0xE2, 0xE3):
        at = np.flatnonzero(raw == lead)
        b, c = raw[at + 1], raw[at + 2]
        if lead == 0xC2:
            at = at[(b == 0x85) | (b == 0xA0)]
        elif lead == 0xE1:
            at = at[(b == 0x9A) & (c == 0x80)]
        elif lead == 0xE2:
            at = at[(b == 0x80) & ((c <= 0x8A) | np.isin(c, [0xA8, 0xA9, 0xAF])) | (b == 0x81) & (c == 0x9F)]
        else:
            at = at[(b == 0x80) & (c == 0x80)]
        for k in range(2 if lead == 0xC2 else 3):
            space[at + k] = True
    return space


def unit_starts(raw: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Where units begin in concatenated UTF-8 texts (``raw`` ends in two spare zeros; none of the texts is empty).

    The last space before a word belongs to it if it is a plain one and stands alone
    otherwise; earlier spaces are a unit. ASCII letters and ASCII signs next to each other
    are cut apart too, except at an apostrophe: no pre-token holds both.
    """
    space = _space_bytes(raw)
    after = np.zeros(len(raw), bool)  # the byte before is a space of the same text
    after[1:] = space[:-1]
    after[text_starts] = False
    after[-2:] = False  # nothing follows the last text
    before = np.ones(len(raw), bool)  # ... is no space, or of another text
    before[1:] = ~space[:-1]
    starts = space & before
    word = np.flatnonzero(~space & after)
    one, two = raw[word - 1] < 128, raw[word - 2] == 0xC2
    last = word - np.where(one, 1, np.where(two, 2, 3))
    starts[last] = True
    starts[word[raw[last] != ord(" ")]] = True
    letter, sign = _LETTER[raw], _SIGN[raw]
    starts[1:] |= letter[1:] & sign[:-1] | sign[1:] & letter[:-1]
    starts[text_starts] = True
    starts[-2:] = False
    return np.flatnonzero(starts)


def _byte_letters() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: itself if printable, else one from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _token_bytes(library) -> list[bytes]:
    """What the tokens stand for in a text, special ones left out."""
    config = json.loads(library.to_str())
    added = {a["content"]: a["special"] for a in config["added_tokens"]}
    affixes = [x for x in (config["model"].get("end_of_word_suffix"), config["model"].get("continuing_subword_prefix")) if x]
    letters = _byte_letters() if '"ByteLevel"' in json.dumps(config["pre_tokenizer"]) else None
    out = [t.encode() for t, special in added.items() if not special]
    for token in library.get_vocab(with_added_tokens=False):
        if token in added:
            continue
        for affix in affixes:
            token = token.removesuffix(affix) if affix == affixes[0] else token.removeprefix(affix)
        if letters is not None and all(c in letters for c in token):
            out.append(bytes(letters[c] for c in token))
        else:
            out.append(token.replace("\u2581", " ").encode())
    return [t for t in out if t]


#: Short texts whose ids must be those of their units.
_PROBES = ("a", "a b", " a", "a  b ", "it's a\n\n test, b.c (d) #e", "A\tB\u3000c \u00e9\u00a0d  ", "x1 2y 33 'll 's")

_LOADED: dict[tuple, Subwords] = {}


class Subwords:
    """``encode`` gives each text's ids as little-endian unsigned 32-bit integers.

    ``limit`` bounds the units remembered (those not met lately go first); units over 64
    characters are encoded but not remembered longer than a slice. A vocabulary with a
    token across a cut (or a rule that looks across one) has no ``cuts``: ``encode`` then
    gives the library's ids of whole texts, and what needs units raises ValueError.
    """

    def __init__(self, path: str, unit: str, limit: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True  # their strings in a text are ordinary text
        self.units = re.compile(unit).findall
        self.known = Recent(limit)
        # A unit of ASCII letters is one pre-token, so its merges can be asked for directly.
        normalizer = self.library.normalizer
        self.lower = normalizer is not None and normalizer.normalize_str("A") == "a"
        self.cuts = self._cuts()
        if self.cuts:
            self.lead = self.library.pre_tokenizer.pre_tokenize_str(" a")[0][0][:-1]

    def _cuts(self) -> bool:
        """Whether a text's ids are those of its units."""
        if self.library.pre_tokenizer is None or not hasattr(self.library.model, "tokenize"):
            return False
        tokens = _token_bytes(self.library)
        ends = np.cumsum([len(t) + 2 for t in tokens])  # apart, by bytes no text has: parts of characters don't join
        raw = np.frombuffer(b"\xff\xff".join(tokens) + b"\xff\xff\0\0", np.uint8)
        if len(unit_starts(raw, np.sort(np.concatenate([[0], ends, ends - 2]))[:-1])) > 2 * len(tokens):
            return False
        split = re.compile(KEEPS_SPACES).findall
        ids = [e.ids for e in self.library.encode_batch(list(_PROBES), add_special_tokens=False)]
        return all(list(chain.from_iterable(e.ids for e in self.library.encode_batch(split(t), add_special_tokens=False))) == own for t, own in zip(_PROBES, ids))

    def _need_cuts(self) -> None:
        if not self.cuts:
            raise ValueError("tokens of this vocabulary span words: texts can only be encoded whole")

    @classmethod
    def load(cls, path: str, unit: str) -> Subwords:
        """One per worker process and vocabulary."""
        if (path, unit) not in _LOADED:
            _LOADED[path, unit] = cls(path, unit)
        return _LOADED[path, unit]

    def _learn(self, units: Sequence[str]) -> None:
        new = self.known.missing(units)
        plain, rest = [], []
        for u in new:
            (plain if _PLAIN(u) else rest).append(u)
        merges = self.library.model.tokenize
        found = []
        for u in plain:
            word = u.lower() if self.lower else u
            found.append([t.id for t in merges(self.lead + word[1:] if word[0] == " " else word)])
        found += [e.ids for e in self.library.encode_batch_fast(rest, add_special_tokens=False)] if rest else []
        ids = np.fromiter(chain.from_iterable(found), "<u4").tobytes()
        at = 0
        for u, x in zip(chain(plain, rest), found):
            self.known[u] = ids[at : at + 4 * len(x)]
            at += 4 * len(x)

    def _forget_long(self, units: Sequence[str]) -> None:
        for u in units:
            if len(u) > 64:
                self.known.pop(u, None)

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        if not self.cuts:
            return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(list(texts), add_special_tokens=False)]
        column = pa.array(texts, pa.string())
        sizes = np.frombuffer(column.buffers()[1], np.int32)[: len(texts) + 1]
        total = int(sizes[-1]) if len(texts) else 0
        if not total:
            return [b""] * len(texts)
        data = column.buffers()[2]
        raw = np.zeros(total + 2, np.uint8)
        raw[:total] = np.frombuffer(data, np.uint8)[:total]
        if self.lower:  # the vocabulary knows no capitals; fewer different units are looked up
            raw += 32 * ((raw >= ord("A")) & (raw <= ord("Z"))).astype(np.uint8)
            data = pa.py_buffer(raw)
        cuts = np.append(unit_starts(raw, np.unique(sizes[:-1][np.diff(sizes) > 0])), total).astype(np.int32)
        units = pa.StringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts), data).dictionary_encode()
        distinct = units.dictionary.to_pylist()
        self._learn(distinct)
        ids = pa.array([self.known[u] for u in distinct], pa.large_binary()).take(units.indices)
        self._forget_long(distinct)
        ends = np.frombuffer(ids.buffers()[1], np.int64)[: len(ids) + 1][np.searchsorted(cuts, sizes)].tolist()
        whole = memoryview(ids.buffers()[2])
        return [bytes(whole[a:b]) for a, b in zip(ends, ends[1:])]

    def encode_units(self, units: Sequence[str]) -> list[bytes]:
        """The ids of each of some units."""
        self._need_cuts()
        self._learn(set(units))
        return [self.known[u] for u in units]

    def counts(self, texts: Sequence[str]) -> list[list[tuple[int, int]]]:
        """(characters, tokens) of every unit of each text."""
        self._need_cuts()
        split = [self.units(t) for t in texts]
        distinct = set(chain.from_iterable(split))
        self._learn(distinct)
        pairs = {u: (len(u), len(self.known[u]) // 4) for u in distinct}
        self._forget_long(distinct)
        return [[pairs[u] for u in units] for units in split]


def default_path(name: str) -> str:
    """Where the box keeps a public vocabulary; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)
