"""b-bit MinHash, spelling variants and the manifest against brute force."""

import zlib
from collections import Counter, defaultdict
from hashlib import sha256
from random import Random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import manifest, minhash, spelling
from strandline.llm.common import written


def shingles(text, k=5):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def components_of(ids, sets, least=85):
    parent = list(range(len(ids)))
    for i, x in enumerate(sets):
        for j in range(i):
            if x and 100 * len(x & sets[j]) >= least * len(x | sets[j]):
                parent = [parent[j] if p == parent[i] else p for p in parent]
    return [min((ids[j] for j in range(len(ids)) if parent[j] == parent[i] and ids[j] is not None), default=None) for i in range(len(ids))]


def test_minhash_on_odd_texts(odd, odd_texts, none):
    sets, ids = [shingles(t) for _, t, _ in odd_texts], [i for i, *_ in odd_texts]
    want = sorted(((i or 0, len(s), c or 0) for i, s, c in zip(ids, sets, components_of(ids, sets))))
    got = minhash.near_duplicates(odd)
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in got.collect()) == want
    assert minhash.near_duplicates(none).count() == 0


def edited(r, words, n):
    out = list(words)
    for p in r.choice(len(words), n, replace=False):
        out[p] = f"new{r.integers(10**9)}"
    return " ".join(out)


@pytest.mark.parametrize("block", [1024, 16])
def test_minhash_of_crowds(llm, block):
    """Copies around the limit: components equal those of all pairs, with leaders, best partners and the rest all at work."""
    r = np.random.default_rng(6)
    texts = []
    for _ in range(3):
        words = [f"w{x}" for x in r.integers(0, 10**6, 250)]
        texts += sorted({edited(r, words, int(n)) for n in r.integers(0, 11, 60)})
    texts += [" ".join(f"w{x}" for x in r.integers(0, 10**6, 60)) for _ in range(20)]
    order = r.permutation(len(texts)).tolist()
    docs = llm.createDataFrame([(i, texts[k]) for i, k in enumerate(order)], "doc_id long, text string")
    want = components_of(list(range(len(texts))), [shingles(texts[k]) for k in order])
    assert 20 < len(set(want)) < len(texts) - 40
    assert [c for _, c in sorted((x.doc_id, x.component_id) for x in minhash.near_duplicates(docs, block=block).collect())] == want


def test_a_crowd_below_the_limit_writes_no_pairs(llm):
    """1,500 copies that are similar by 0.75 to 0.85: what is handed on stays below the members, whatever the pairs."""
    r = np.random.default_rng(9)
    words = [f"w{x}" for x in r.integers(0, 10**6, 300)]
    texts = [edited(r, words, 5) for _ in range(1500)]
    rows = []
    for text in texts:
        s = np.sort(np.frombuffer(b"".join(sha256(x).digest()[:8] for x in shingles(text)), np.uint64))
        rows.append(s)
    values = minhash.minima(rows)
    n = len(rows)
    group = minhash.Group({
        "node": np.arange(n), "root": np.arange(n), "side": np.zeros(n, np.int64), "n": np.array([len(s) for s in rows]), "bucket": minhash.bands(values)[:1, 0].view(np.int64).repeat(n),
        "signature": minhash.packed(values), "bands": np.repeat(minhash.bands(values)[:1].view(np.int64), n, axis=0), "shingles": np.array(rows, object)}, 0.85)
    assert len(group.with_leader()) < n and len(group.with_best()) <= n and len(group.busy()) <= n
    small = {k: (v[:150] if isinstance(v, np.ndarray) else v) for k, v in vars(group).items()}
    for k, v in small.items():
        setattr(group, k, v)
    links = group.linked()
    parent = list(range(150))
    for i in range(150):
        for j in range(i):
            k = len(np.intersect1d(rows[i], rows[j]))
            if 100 * k >= 85 * (len(rows[i]) + len(rows[j]) - k):
                parent = [parent[j] if p == parent[i] else p for p in parent]
    assert len(links) < 150 and len(set(group.root.tolist())) == len(set(parent))


def test_estimates_are_close():
    r = np.random.default_rng(3)
    for share in (0.3, 0.6, 0.85, 0.95):
        common, own = r.integers(0, 2**64, 2000, dtype=np.uint64), r.integers(0, 2**64, (2, 1000), dtype=np.uint64)
        k = round(len(common) * (1 - share) / share / 2)
        sets = [np.unique(np.concatenate([common, x[:k]])) for x in own] if k <= 1000 else [np.unique(np.concatenate([common[:800], x[:934]])) for x in own]
        real = len(np.intersect1d(*sets)) / len(np.union1d(*sets))
        a, b = minhash.packed(minhash.minima(sets))
        assert abs(minhash.estimated(a, b) - real) < 0.15


def brute_words(rows, least=7):
    out = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += len(run) >= least
    return {w: n for w, n in out.items() if n >= 2}


def brute_near(words):
    keys = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            keys[w[:i] + "\0" + w[i + 1 :]].add(w)
        for i in range(len(w) + 1):
            keys[w[:i] + "\0" + w[i:]].add(w)
    near = defaultdict(set)
    for group in keys.values():
        for a in group:
            near[a] |= group - {a}
    out = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        out[w] = (n, len(near[w]), best if best and words[best] >= 10 * n else None)
    return out


def check_spelling(found, words):
    want = brute_near(words)
    got = {r.word: r for r in found}
    assert set(got) == set(want) and len(found) == len(want)
    for w, (n, k, form) in want.items():
        root = w
        while want[root][2]:
            root = want[root][2]
        assert (got[w].n, got[w].n_near, got[w].form, got[w].root, got[w].form_n) == (n, k, form, root, words[form] if form else None)


def test_spelling_of_odd_texts(llm, odd, odd_texts, none):
    rows = [(i, t) for i, t, _ in odd_texts] + [(90 + k, t) for k, t in enumerate(["long" * 500, "LONG" * 500, "Straße straße STRASSE strasse naïveté naïvete naïvette " * 12, "aaaaaaa aaaaaaaa aaaaaaaaa " * 30])]
    docs = odd.select("doc_id", "text").unionByName(llm.createDataFrame(rows[len(odd_texts) :], "doc_id long, text string"))
    check_spelling(spelling.forms(spelling.near_words(spelling.words(docs))).collect(), brute_words(rows))
    assert spelling.forms(spelling.near_words(spelling.words(none))).count() == 0


@pytest.mark.parametrize("part_words", [1, 3, 50, 10**6])
def test_spelling_over_many_parts(llm, part_words):
    r = Random(1)
    some = ["".join(r.choice("abé") for _ in range(r.randint(1, 6))) for _ in range(150)]
    words = {w: r.choice([2, 3, 20, 30, 400, 4000]) for w in some}
    counted = llm.createDataFrame(list(words.items()), "word string, n long").repartition(3)
    check_spelling(spelling.forms(spelling.near_words(counted, part_words=part_words)).collect(), words)


def test_trie_nodes_are_prefixes(llm):
    r = Random(2)
    words = sorted({"".join(r.choice("ab") for _ in range(r.randint(1, 9))) for _ in range(200)})
    for part_words in (1, 7, 1000):
        df = llm.createDataFrame([(w,) for w in words], "word string")
        nodes = defaultdict(set)
        ordered = spelling._sorted(df, "word", len(words) // part_words + 1, "t").withColumnRenamed("at", "w")
        spelled = {x.w: x.word for x in ordered.collect()}
        for x in spelling.trie(ordered, "word").collect():
            assert len(x.nodes) == len(spelled[x.w]) + 1
            for d, node in enumerate(x.nodes):
                nodes[spelled[x.w][:d]].add(node)
        assert all(len(v) == 1 for v in nodes.values()) and len({min(v) for v in nodes.values()}) == len(nodes)


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def brute_tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def brute_siblings(levels, i):
    out = []
    for level in levels[:-1]:
        g = i - i % 3
        out.append((level[g:i], level[i + 1 : g + 3]))
        i //= 3
    return out


def brute_manifest(rows):
    """(doc_id, leaf, subroot, root, proof, folded root, verified) of rows (doc_id, source, lang, n_chars, text)."""
    value = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda row: H("".join(map(value, row)))
    groups = defaultdict(list)
    for row in rows:
        groups[row[1]].append(row)
    trees = {}
    for source, own in groups.items():
        own.sort(key=lambda row: (row[0] is not None, row[0] or 0, leaf(row)))
        trees[source] = brute_tree([leaf(x) for x in own])
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    top = brute_tree([trees[s][-1][0] for s in names])
    out = []
    for source, own in groups.items():
        for i, row in enumerate(own):
            path = brute_siblings(trees[source], i) + brute_siblings(top, names.index(source))
            new = row
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 and row[4] is not None:
                new = (*row[:4], row[4].replace("\n", ""))
            node = leaf(new)
            for before, after in path:
                node = H(*before, node, *after)
            proof = H("".join("".join(b) + "".join(a) for b, a in path))
            out.append((row[0], leaf(row), trees[source][-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return sorted(out, key=repr)


def found_manifest(docs, levels):
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    found = manifest.manifest(docs, {"text": F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))}, levels=levels)
    return [(r.doc_id, r.leaf, r.subroot, r.root, H("".join(r.proof)), r.folded_root, r.folded_root == r.root) for r in found.collect()]


@pytest.mark.parametrize("levels", [1, 2, 6])
def test_manifest(llm, odd, odd_texts, none, levels):
    rows = [(i, [None, "", "web", "Überall"][k % 4], g, len(t or ""), t) for k, (i, t, g) in enumerate(odd_texts)]
    rows += [(100 + i % 80, f"s{i % 7 // 3}", None, None, f"line\n{i // 90}") for i in range(130)] + [(7, "alone", "en", 1, "x\n")] + [(1, "same", None, None, None)] * 5
    docs = llm.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").withColumn("rank", F.lit(1)).withColumn("hash", F.lit(2)).repartition(3)
    assert sorted(found_manifest(docs, levels), key=repr) == brute_manifest(rows)
    empty = docs.where("false")
    assert found_manifest(empty, levels) == []
    one = docs.where("source = 'alone'")
    assert found_manifest(one, levels) == brute_manifest([rows[-6]])


def test_versions_share_what_they_do_not_copy(llm):
    """A version's own ancestors and the base's other nodes make the tree of the tampered table."""
    rows = [(i, "s", None, i, f"t{i}") for i in range(40)]
    docs = llm.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    found = manifest.manifest(docs, {"text": F.when(F.col("doc_id") % 5 == 0, "other").otherwise(F.col("text"))}, levels=2).collect()
    value = lambda v: "-" if v is None else f"{len(str(v))}:{v}"
    base = [H("".join(map(value, x))) for x in rows]
    for r in found:
        assert (r.version_leaf is None) == (r.doc_id % 5 > 0) == (r.copied is None)
        if r.copied:
            changed = [*base[: r.rank], r.version_leaf, *base[r.rank + 1 :]]
            levels, i = brute_tree(changed), r.rank
            assert r.version_leaf == H("".join(map(value, (*rows[r.doc_id][:4], "other")))) and r.folded_root == levels[-1][0]
            for level, node in zip(levels[1:], r.copied):
                i //= 3
                assert level[i] == node
