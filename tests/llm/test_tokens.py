"""Token blocks, packing, pieces and edit-aware counts against the libraries themselves."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandline.llm import packing, pieces, token_blocks, token_counts
from strandline.llm.queries import QUERIES
from strandline.llm.subwords import KEEPS_SPACES, Subwords, default_path
from strandline.session import work_folder


def library(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_path(name))
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=700), st.integers(0, 700), st.integers(0, 700))
@settings(max_examples=60, deadline=None)
def test_blocks_round_trip(ids, a, b):
    payload = token_blocks.encode_blocks(np.array(ids, np.uint32))
    assert token_blocks.decode_blocks(payload).tolist() == ids
    assert token_blocks.decode_blocks(payload, a, b).tolist() == ids[a:b]


def test_blocks_store_outliers_apart():
    ids = np.arange(128, dtype=np.uint32) % 16
    ids[7] = 4_000_000_000
    assert len(token_blocks.encode_blocks(ids)) < 8 + 8 + 6 + 64 + 5 + 1


def test_token_table(llm, odd, odd_texts, none):
    encode = library("word_bpe_49k.json")
    folder = work_folder(llm, "t")
    token_blocks.write_token_table(odd, folder, default_path("word_bpe_49k.json"), 1)
    rows = sorted(token_blocks.read_token_table(llm, folder).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted((i for i, *_ in odd_texts), key=lambda i: (i is not None, i or 0))
    want = defaultdict(list)
    for i, t, _ in odd_texts:
        want[i].append(encode(t) + [1])
    at = 0
    for r in rows:
        got = np.frombuffer(r.ids, "<u4").tolist()
        assert got in want[r.doc_id] and (r.start, r.n_tokens) == (at, len(got))
        at += len(got)
    empty = work_folder(llm, "t")
    token_blocks.write_token_table(none, empty, default_path("word_bpe_49k.json"), 1)
    assert token_blocks.read_token_table(llm, empty).count() == 0


def test_op1_whole_table(llm, small):
    docs = llm.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").collect()
    encode, start, want = library("word_bpe_49k.json"), 0, set()
    for d in docs:
        ids = encode(d.text) + [1]
        want.add((d.doc_id, start, len(ids), crc(ids)))
        start += len(ids)
    assert {tuple(r) for r in QUERIES["op1_token_blocks"](llm, small).collect()} == want


def _check_packing(rows, texts, capacity=1024):
    encode = library("byte_bpe_50k.json")
    want = defaultdict(list)
    for i, t in texts:
        want[i].append(encode(t) + [0])
    sequences, copies = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append(r)
        copies[r.doc_id].append(r)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= capacity and at & (at - 1) == 0  # full, or a power of two: nothing to pad
    for i, own in copies.items():
        if len(want[i]) == 1:
            at = 0
            for r in sorted(own, key=lambda r: r.start):
                assert (r.start, r.doc_tokens) == (at, len(want[i][0]))
                assert crc(want[i][0][at : at + r.length]) == r.ids_crc32
                at += r.length
            assert at == len(want[i][0])
        assert sum(r.length for r in own) == sum(map(len, want[i]))
    assert set(copies) == set(want)


def test_packing(llm, odd, odd_texts, none, small):
    vocabulary = default_path("byte_bpe_50k.json")
    _check_packing(packing.digest(packing.pack(odd, vocabulary, 0)).collect(), [(i, t) for i, t, _ in odd_texts])
    assert packing.pack(none, vocabulary, 0).count() == 0
    docs = llm.read.parquet(f"{small}/documents.parquet").collect()
    _check_packing(QUERIES["op6_packing"](llm, small).collect(), [(d.doc_id, d.text) for d in docs])


def test_harmonic_bins_hold_a_fixed_number():
    packer, out, r = packing.HarmonicPacker(64, waiting=4), [], random.Random(1)
    sizes = [r.choice([1, 3, 9, 20, 33, 63, 64, 65, 200]) for _ in range(400)]
    for i, n in enumerate(sizes):
        out += packer.add((i, 0, b"abcd" * n, n))
        assert len(packer.gapped) <= 5 and all(len(p) < k for k, p in packer.open.items())
    out += packer.finish()
    filled = [sum(len(p[2]) for p in s) // 4 for s in out]
    assert sum(filled) == sum(sizes) and sum(f != 64 for f in filled) <= 6


def test_pieces_equal_the_library(llm, odd, odd_texts, none, small):
    import sentencepiece

    model = default_path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    want = defaultdict(list)
    for i, t, _ in odd_texts:
        want[i].append(t or "")
    for r in pieces.encode_pieces(odd, model).collect():
        text = next(t for t in want[r.doc_id] if sp.encode(t) == r.ids)
        raw = text.encode()
        assert r.decoded == sp.decode(r.ids)
        assert r.begins[1:] == r.ends[:-1] and (not raw or (r.begins[0], r.ends[-1]) == (0, len(raw)))
        for i, a, b in list(zip(r.ids, r.begins, r.ends))[:500]:
            if not sp.is_byte(i):
                assert raw[a:b].decode().replace(" ", "▁") == sp.id_to_piece(i)[-len(raw[a:b].decode()) or 99 :]
    assert pieces.encode_pieces(none, model).count() == 0
    docs = {d.doc_id: d.text or "" for d in llm.read.parquet(f"{small}/documents.parquet").collect()}
    for r in QUERIES["op9_pieces"](llm, small).collect():
        ids = sp.encode(docs[r.doc_id])
        assert r.n_tokens == len(ids) and r.covered == len(docs[r.doc_id].encode())
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf", "identity"])
def test_normaliser_equals_the_library(rule):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as proto

    theirs = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    spec = proto.ModelProto()
    spec.ParseFromString(theirs.serialized_model_proto())
    s = spec.normalizer_spec
    mine = pieces.Normaliser(pieces.CharacterMap(s.precompiled_charsmap), s.add_dummy_prefix, s.remove_extra_whitespaces, s.escape_whitespaces)
    r = random.Random(3)
    letters = list("aÀe ① ﬁ½ Ａ日本㌔́ ​\t Ⅷ가가 　")
    for _ in range(400):
        text = "".join(r.choice(letters) for _ in range(r.randint(0, 12)))
        out, origin = mine(text)
        assert out.decode() == theirs.normalize(text), text
        assert len(origin) == len(out) + 1 and origin == sorted(origin) and origin[-1] <= len(text.encode())


def test_trees_follow_edits():
    words = Subwords.load(default_path("byte_bpe_50k.json"), KEEPS_SPACES)
    encode = library("byte_bpe_50k.json")
    count = lambda units: [len(x) // 4 for x in words.encode_units(units)]
    r = random.Random(5)
    parts = ["a", "the", " ", "  ", "\n", " \n", "'s", "12", "é", "!", "\t", "　", "don't"]
    for _ in range(250):
        make = lambda n: "".join(r.choice(parts) for _ in range(n))
        text, edits, at = make(r.choice([0, 1, 5, 50, 400])), [], 0
        while at <= len(text) and len(edits) < 5:
            a = at + r.randint(0, 30)
            if a > len(text):
                break
            b = min(len(text), a + r.choice([0, 0, 1, 3, 40]))
            edits.append((a, b, make(r.choice([0, 0, 1, 4]))))
            at = b + 1
        tree = token_counts.SegmentTree.load(token_counts.SegmentTree(words.counts([text])[0]).dump())
        new, _ = token_counts.apply_edits(tree, text, edits, words.units, count)
        for a, b, s in sorted(edits, reverse=True):
            text = text[:a] + s + text[b:]
        assert new == text and tree.total == len(encode(text)) and tree.units == words.counts([text])[0]


def test_op5_counts(llm, odd, odd_texts, none, small):
    encode, vocabulary = library("byte_bpe_50k.json"), default_path("byte_bpe_50k.json")

    def want(text):
        after = text
        for a, b, s in sorted(token_counts.redactions(text), reverse=True):
            after = after[:a] + s + after[b:]
        return len(encode(text)), len(encode(after))

    docs = {d.doc_id: d.text or "" for d in llm.read.parquet(f"{small}/documents.parquet").collect()}
    rows = QUERIES["op5_token_counts"](llm, small).collect()
    assert {r.doc_id: (r.n_tokens, r.n_tokens_after) for r in rows} == {i: want(t) for i, t in docs.items()}
    assert sum(r.n_edits for r in rows) > 0
    counted = token_counts.recount(token_counts.count_trees(odd, vocabulary), vocabulary, token_counts.redactions)
    assert sorted((r.n_tokens, r.n_tokens_after) for r in counted.collect()) == sorted(want(t or "") for _, t, _ in odd_texts)
    names = ["n_tokens", "n_edits", "n_encoded", "n_tokens_after"]
    once = token_counts.count_edited(odd, vocabulary, token_counts.redactions)
    assert sorted(map(tuple, once.select(names).collect())) == sorted(map(tuple, counted.select(names).collect()))
    assert token_counts.count_trees(none, vocabulary).count() == 0 and token_counts.count_edited(none, vocabulary, token_counts.redactions).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_units_give_the_ids_of_whole_texts(name):
    """Odd spaces, apostrophes, signs, combining marks and the strings of special tokens, in texts of every length."""
    rng = random.Random(5)
    signs = "ab'Z\xe9́Σ 1.,\n\t\x85\xa0    　中\U0001f600K\x1c\x00"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(40))) for _ in range(3000)]
    texts += ["", "<|endoftext|>", "don't it'll x's 'S ''s 3rd (a)b.", "w" * 500 + " " + "w" * 500]
    words = Subwords(default_path(name), KEEPS_SPACES)
    got = [np.frombuffer(x, "<u4").tolist() for x in words.encode(texts)]
    assert got == [e.ids for e in words.library.encode_batch(texts, add_special_tokens=False)]
    assert words.encode([]) == [] and words.encode(["", ""]) == [b"", b""]
    assert words.cuts
    for t in ["a\n\n", "a  ", "\n\n\n", "a\xa0\xa0", "b \u3000\u3000"]:  # the end of the last text is like that of any other
        assert np.frombuffer(words.encode(["x", t])[1], "<u4").tolist() == words.library.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("split", [True, False])
def test_a_vocabulary_with_tokens_across_a_blank_encodes_whole_texts(tmp_path, split):
    """Byte level, with a merge across the blank, or words with a blank before every text: ids are the library's."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    tokens = ["a", "b", "\u0120", "a\u0120", "a\u0120b"] if not split else ["a", "b", "\u0120", "\u0120a", "\u0120b"]
    merges = [("a", "\u0120"), ("a\u0120", "b")] if not split else [("\u0120", "a"), ("\u0120", "b")]
    library = Tokenizer(models.BPE(vocab={t: i for i, t in enumerate(tokens)}, merges=merges))
    library.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=split, use_regex=split)
    library.save(str(tmp_path / "own.json"))
    words = Subwords(str(tmp_path / "own.json"), KEEPS_SPACES)
    texts = ["a b", "", "ab a b", " a"]
    assert not words.cuts
    assert [np.frombuffer(x, "<u4").tolist() for x in words.encode(texts)] == [e.ids for e in library.encode_batch(texts)]
    if not split:
        assert np.frombuffer(words.encode(["a b"])[0], "<u4").tolist() == [4]
    with pytest.raises(ValueError, match="whole"):
        words.counts(texts)
