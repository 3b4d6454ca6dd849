"""Rules, classifier, SimHash, suffix dedup, page text and the pipeline against brute force."""

import re
import time
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash

import corpus_pipeline
from strandline.llm import neighbours, pages, quality, rules, simhash, suffixes
from strandline.llm.common import components
from strandline.llm.queries import ORACLES, QUERIES
from suite.compare import differences, duck


@pytest.mark.parametrize("name", list(ORACLES))
def test_agrees_with_sql(llm, small, name):
    assert differences(QUERIES[name](llm, small), duck(small), ORACLES[name]) == []


def test_rules_on_odd_texts(llm, odd, odd_texts, none, tmp_path):
    found = {(r.doc_id, r.n_words): r for r in rules.judge(rules.ledger(odd)).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [(i, t) for i, t, _ in odd_texts])
    for row in con.sql(rules.ORACLE).fetchall():
        r = found[row[0], row[1]]
        assert (r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.kept, r.fails) == (*row[2:6], row[7], row[8])
    assert rules.ledger(none).count() == 0 and rules.passing(none).columns == none.columns
    kept = rules.passing(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {i for (i, _), r in found.items() if r.kept}


def test_ablations_count_bits(llm, small):
    marked = rules.ledger(llm.read.parquet(f"{small}/documents.parquet"))
    bits = [r.fails for r in marked.collect()]
    for r in rules.ablations(marked, "v1").collect():
        whole, bit = rules.mask(rules.POLICIES["v1"]), rules.mask([r.rule])
        assert r.failed == sum(b & bit != 0 for b in bits)
        assert r.failed_alone == sum(b & whole == bit for b in bits)
        assert r.kept_without == sum(b & whole & ~bit == 0 for b in bits)


def test_classifier_on_held_out_rows(llm):
    folder = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in llm.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = QUERIES["op8_quality"](llm, folder).collect()
    assert len(rows) == llm.read.parquet(f"{folder}/documents.parquet").count()
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert all(r.held_out == (__import__("zlib").crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    assert np.mean([r.predicted == labels[r.doc_id] for r in held]) > 0.93


def test_classifier_on_odd_texts(llm, odd, odd_texts, none, small):
    labels = llm.read.parquet(f"{small}/labels.parquet").select("doc_id", "quality")
    assert quality.classify(odd, labels).count() == len(odd_texts)
    assert quality.classify(none, labels).count() == 0
    assert {r.score for r in quality.classify(odd, labels.limit(0)).collect()} == {0.5}
    assert quality.passing(odd, labels).columns == odd.columns


def test_classifier_stage_learns_from_unfiltered_rows(llm, tmp_path):
    folder = "/root/testdata/sf0.01"
    docs, labels = llm.read.parquet(f"{folder}/documents.parquet"), llm.read.parquet(f"{folder}/labels.parquet")
    bad = docs.join(labels.where("quality = 0").where(quality.held_out()).select("doc_id"), "doc_id", "left_semi")
    passed = rules.passing(docs)
    ids = {r.doc_id for r in passed.select("doc_id").collect()}
    # Bad documents as if the rules let them pass: held out, and the same without any label.
    given = passed.unionByName(bad).unionByName(bad.withColumn("doc_id", bad.doc_id + 10_000_000))
    n_bad = bad.count()
    kept = {r.doc_id for r in corpus_pipeline.quality_classifier(llm, given, folder).collect()}
    assert n_bad >= 5 and len(kept - ids) <= 0.1 * 2 * n_bad
    assert len(kept & ids) > 0.9 * len(ids)
    for left in (labels.where("quality = 1"), labels.where("quality = 0"), labels.limit(0)):
        with pytest.warns(UserWarning, match="class are missing"):
            assert quality.passing(bad, left, learn_from=docs).count() == n_bad


def test_xxh64_of_many_ranges():
    data = bytes(np.random.default_rng(1).integers(0, 256, 3000, dtype=np.uint8))
    starts = np.arange(0, 900, 3)
    ends = starts + np.arange(300) % 140
    got = simhash.xxh64(np.frombuffer(data, np.uint8), starts, ends)
    assert got.tolist() == [xxhash.xxh64_intdigest(data[a:b], 42) for a, b in zip(starts, ends)]


def brute_simhash(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]), 42) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, prints, most=4):
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    a = np.array(prints, np.uint64)
    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= most):
            x, y = find(i), find(int(j))
            parent[max(x, y)] = min(x, y)
    least = {}
    for i, own in enumerate(ids):
        least.setdefault(find(i), []).append(own)
    return [min(least[find(i)], key=lambda x: (x is None, x)) for i in range(len(ids))]


def test_simhash_components(llm, small, odd, odd_texts, none):
    docs = llm.read.parquet(f"{small}/documents.parquet").collect()
    prints = [brute_simhash(d.text, 4) for d in docs]
    want = {d.doc_id: (f"{p:016x}", c) for d, p, c in zip(docs, prints, brute_components([d.doc_id for d in docs], prints))}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op7_simhash"](llm, small).collect()} == want
    prints = [brute_simhash(t, 5) for _, t, _ in odd_texts]
    comps = brute_components([i for i, *_ in odd_texts], prints)
    got = sorted((r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(odd).collect())
    assert got == sorted(zip(prints, comps))
    one = simhash.representatives(odd)
    assert one.columns == odd.columns and sorted(r.doc_id or 0 for r in one.collect()) == sorted(set(c or 0 for c in comps))
    assert simhash.near_duplicates(none).count() == 0 and simhash.representatives(none).count() == 0


@pytest.mark.parametrize("block", [4096, 16])
def test_links_of_dense_and_random_fingerprints(llm, block):
    r = np.random.default_rng(2)
    centre = r.integers(0, 2**64, dtype=np.uint64)
    flips = [np.bitwise_or.reduce(np.uint64(1) << r.integers(0, 64, n).astype(np.uint64)) if n else np.uint64(0) for n in r.integers(0, 8, 300)]
    fp = np.unique(np.concatenate([r.integers(0, 2**64, 500, dtype=np.uint64), centre ^ np.array(flips, np.uint64)]))
    df = llm.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long")
    found = {x.node: x.component for x in components(simhash.near_links(df, 4, block)).collect()}
    signed = fp.view(np.int64).tolist()
    order = sorted(range(len(fp)), key=lambda i: signed[i])
    want = dict(zip([signed[i] for i in order], brute_components([signed[i] for i in order], [int(fp[i]) for i in order])))
    assert {x: found.get(x, x) for x in signed} == want


def test_near_duplicate_stage_keeps_one_of_each_component(llm, small):
    docs = llm.read.parquet(f"{small}/documents.parquet")
    found = QUERIES["op7_simhash"](llm, small).collect()
    kept = corpus_pipeline.near_duplicates(llm, docs, small)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({r.component_id for r in found}) and len(found) > kept.count()


def brute_suffixes(texts):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + 200] for t in raw for i in range(len(t) - 199))
    out = []
    for t in raw:
        mark = bytearray(len(t))
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                mark[i : i + 200] = b"\1" * 200
        spans = len(re.findall(rb"\x01+", bytes(mark)))
        out.append((len(t), sum(mark), spans, bytes(b for b, m in zip(t, mark) if not m)))
    return out


def test_suffix_dedup(llm, odd, odd_texts, none, small):
    want = brute_suffixes([t for _, t, _ in odd_texts if len(t or "") < 100_000])
    got = suffixes.remove_repeats(odd.where("text is null or length(text) < 100000"))
    assert sorted((r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in got.collect()) == sorted(want)
    assert [r.n_removed for r in suffixes.remove_repeats(odd.where("doc_id = 16")).collect()] == [120_000]
    assert suffixes.remove_repeats(none).count() == 0
    docs = llm.read.parquet(f"{small}/documents.parquet").collect()
    want = dict(zip([d.doc_id for d in docs], brute_suffixes([d.text for d in docs])))
    for r in QUERIES["op10_suffix_dedup"](llm, small).collect():
        n, removed, spans, kept = want[r.doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (n, removed, spans, __import__("hashlib").sha256(kept).hexdigest())
    cleaned = suffixes.without_repeats(odd)
    assert cleaned.columns == odd.columns and cleaned.count() == len(odd_texts)
    assert all(r.n_chars == len(r.text or "") for r in cleaned.collect())


def test_suffix_dedup_of_variants(llm):
    """Many variants of one text, settled in groups and, beyond a size, by window."""
    r = np.random.default_rng(3)
    base = "".join(r.choice(list("abcdefgh ")) for _ in range(900))
    texts = []
    for _ in range(60):
        t = list(base)
        for p in r.integers(0, 900, 3):
            t[p] = "#"
        texts.append("".join(t))
    texts += ["ab" * 150, "q" * 250, base[100:350]]
    df = llm.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = [(n, m, s) for n, m, s, _ in brute_suffixes(texts)]
    for together in (2048, 8):
        keyed = suffixes._keyed(df, "doc_id", "text")
        marks = [bytearray(len(t)) for t in texts]
        keys = {x.key: x.row.doc_id for x in keyed.collect()}
        for x in suffixes.repeated_windows(keyed.select("key", "text"), together).collect():
            marks[keys[x.key]][x.start : x.start + x.n + 199] = b"\1" * (x.n + 199)
        assert [(len(m), sum(m), len(re.findall(rb"\x01+", bytes(m)))) for m in marks] == want


def test_pages(llm, none):
    def page(i, body):
        return f"<!DOCTYPE html><html><head><title>t{i}</title><script>var a='</p>';</script></head><body class='x'><nav><a>Home {i}</a></nav><div class=sidebar><p>See {i}</p></div>{body}<div id='comments'><p>I like {i}</p></div><footer>&copy; {i}</footer></body></html>"

    rows = [(i, "http://h.example/%d" % i, page(i, f"<article><h1>Title&nbsp;{i}</h1><p>Body  <b>of</b>\n {i}<br>ends &amp; all.<p>Next {i}<ul><li>one {i}<li>two</ul><form><p>Send</p></form></article>")) for i in range(12)]
    rows += [(100 + i, "http://plain.example/", page(i, f"<div id=wrap><div class=story><p>Only {i} divs here, with a longer text {i * 7}.</p><p>Read our rules.</p></div></div>")) for i in range(3)]
    rows += [(200, None, None), (201, None, ""), (202, "http://h.example/x", "just text <b>here</b>"), (203, "x", "<article><p>unclosed & <i>odd"), (203, "x", "<article><p>unclosed & <i>odd")]
    df = llm.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as rule", "2 as host", "3 as text")
    got = {r.page_id: r.text for r in pages.extract(df).collect()}
    assert got[3] == "Title 3\n\nBody of 3 ends & all.\n\nNext 3\n\none 3\n\ntwo"
    assert got[101] == "Only 1 divs here, with a longer text 7.\n\nRead our rules."
    assert (got[200], got[201], got[202], got[203]) == ("", "", "just text here", "unclosed & odd")
    assert pages.extract(df).count() == len(rows) and pages.extract(df.limit(0)).count() == 0


def test_pages_with_comments_as_articles(llm):
    """Comments in article elements, longer than every article, on one page and on one of another shape."""
    say = "<div id=comments><article class=comment-body><p>" + "I never read such a thing. " * 60 + "</p></article><article><p>Nor did I.</p></article></div>"
    text = [f"Text {i} of the story, number {i * 7}, with some words more." for i in range(12)]
    rows = [(i, "http://h.example/", f"<body><article class=post><p>{t}</p></article>{say if i in (3, 4) else ''}</body>") for i, t in enumerate(text)]
    rows += [(20, "http://h.example/", f"<body><main><p>Another shape.</p></main>{say}</body>")]
    rows += [(30 + i, "http://k.example/", f"<body><article class=comment><p>{'Long remark. ' * 90}</p></article><div><p>{t}</p></div></body>") for i, t in enumerate(text)]
    rows += [(50 + i, "http://m.example/", f"<body class='no-sidebar'><article><p>{t}</p></article>{say}</body>") for i, t in enumerate(text)]
    got = {r.page_id: r.text for r in pages.extract(llm.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {**dict(enumerate(text)), 20: "Another shape.", **{30 + i: t for i, t in enumerate(text)}, **{50 + i: t for i, t in enumerate(text)}}


def test_pages_of_copies_keep_their_blocks(llm):
    """Blocks that only copies of one article have are text; those that every page has are template."""
    body = "The one article that many pages copy, with quite some words in it, so that a heading is short beside it. " * 3
    copy = f"<article><h1>One</h1><h2>Its heading</h2><div class=more><blockquote>Its quote</blockquote></div><p>{body}</p><h6>Terms apply</h6></article>"
    text = [f"Text {i} of the site. " + f"Word{i} and more words {i * 7} follow here. " * 12 for i in range(30)]
    rows = [(i, "http://h.example/", f"<body><nav>{i}</nav>{copy}</body>") for i in range(12)]
    rows += [(100 + i, "http://h.example/", f"<body><article><h1>T{i}</h1><p>{t}</p><h6>Terms apply</h6></article></body>") for i, t in enumerate(text)]
    # All but one page are copies, and the other has the same heading.
    rows += [(200 + i, "http://k.example/", f"<body><nav>{i}</nav><article><h2>Its heading</h2><p>{text[0] if i else text[1]}</p></article></body>") for i in range(12)]
    got = {r.page_id: r.text for r in pages.extract(llm.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {got[i] for i in range(12)} == {f"One\n\nIts heading\n\nIts quote\n\n{body.strip()}"}
    assert all(got[100 + i] == f"T{i}\n\n{t.strip()}" for i, t in enumerate(text))
    assert all(got[200 + i] == f"Its heading\n\n{text[0 if i else 1].strip()}" for i in range(12))


def test_pages_of_any_depth_and_length(llm):
    """Nesting without end, tags and comments that are never closed, hosts of two pages and without an article element."""
    long = "deep text" + "<p>more</p>tail"
    html = {
        1: "<article>" + "<div>" * 5000 + long + "</div>" * 5000 + "</article>", 2: "<article><p>kept</p>" + "<script " * 650_000, 3: "<article><p>kept</p>" + '<p a="x ' * 650_000,
        4: "<article><p>kept</p></article>" + "<!--" * 1_200_000, 5: "<article><p>kept</p>" + "<blockquote>" * 60_000, 6: '<article><p>kept</p><p a="x ' + "</h1>" * 100_000,
        7: "<div class=main><p>one two three</p></div><div class=menu>menu</div>", 8: "<div class=main><p>four five six</p></div><div class=menu>menu</div>", 9: None, 10: "",
        11: "<script </script>all of it", 12: "<article>" + "<nav><div>" * 400 + "never</article>",
    }
    started = time.perf_counter()
    for page in html.values():
        pages.skeleton(pages.parse(page or ""))
    assert time.perf_counter() - started < 60
    rows = [(i, f"http://h{i // 7}.example/{i}" if i % 2 else f"\thttp://h{i // 7}.example/{i}", h) for i, h in html.items()]
    found = {r.page_id: r.text for r in pages.extract(llm.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found[1] == "deep text\n\nmore\n\ntail" and all(found[i].startswith("kept") for i in (2, 3, 4, 5, 6))
    assert found[7] == "one two three" and found[8] == "four five six" and [found[i] for i in (9, 10, 11, 12)] == [""] * 4


def test_simple_tree_matching():
    tree = lambda label, *children: [label, False, 1, 1, 1, list(children), 1]
    a = tree("r", tree("x"), tree("y", tree("p")), tree("z"))
    b = tree("r", tree("y", tree("p"), tree("q")), tree("w"), tree("z"))
    assert pages._match(a, b, {}) == 4
    assert [c[0] for c in pages.merge(a, b)[5]] == ["x", "y", "w", "z"]


def test_op4_on_articles(llm, small):
    for r in QUERIES["op4_pages"](llm, small).join(llm.read.parquet(f"{small}/pages.parquet").select("page_id", "html"), "page_id").collect():
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", body.replace("<br>", " ")))
        want = "\n\n".join(x for x in (" ".join(__import__("html").unescape(b).split()) for b in blocks) if x)
        assert (r.text, r.n_chars) == (want, len(want))


def test_neighbours_recall(llm, small):
    v = llm.read.parquet(f"{small}/embeddings.parquet").orderBy("vec_id").collect()
    x, ids = np.array([r.embedding for r in v], np.float64), np.array([r.vec_id for r in v])
    got = {}
    for r in QUERIES["op2_neighbours"](llm, small).collect():
        got.setdefault(r.query_id, []).append(r)
    asked = np.flatnonzero(ids % 20 == 0)
    hits = 0
    for q in asked:
        scores = x @ x[q]
        scores[q] = -np.inf
        best = sorted(got[ids[q]], key=lambda r: r.rank)
        assert [r.rank for r in best] == list(range(1, 21)) and all(abs(r.score - scores[np.searchsorted(ids, r.vec_id)]) < 1e-12 for r in best)
        assert [(-r.score, r.vec_id) for r in best] == sorted((-r.score, r.vec_id) for r in best)
        hits += len({r.vec_id for r in best} & set(ids[np.argsort(-scores, kind="stable")[:20]].tolist()))
    assert hits / 20 / len(asked) >= 0.9


@pytest.mark.parametrize("n", [60, 3000])
def test_neighbours_ties_of_one_hot_vectors(n):
    """All products but one are zero: the smaller ids win, whatever the order of the items."""
    ids = np.random.default_rng(4).permutation(n)
    x = np.eye(60)[ids % 60] * (1 + ids // 60)[:, None]
    q, item, score = neighbours._score(x, ids, np.eye(60)[:30], np.arange(30), 5)
    want = [sorted((-(1.0 + i // 60) if i % 60 == own else 0.0, i) for i in range(n))[:5] for own in range(30)]
    assert list(zip(q.tolist(), (-score).tolist(), item.tolist())) == [(own, s, i) for own in range(30) for s, i in want[own]]


def test_neighbours_of_odd_vectors(llm):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.0, 2.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, None]),
            (8, [3.0, 4.0]), (9, [-1.0, -1.0]), (10, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (40, [0.0, 0.0])]
    df = llm.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as id", "2 as bucket")
    got = neighbours.nearest(df, df.where("vec_id % 20 = 0"), k=4).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in got] == [
        (0, 1, 8, 3.0), (0, 2, 1, 1.0), (0, 3, 2, 1.0), (0, 4, 20, 0.0), (20, 1, 8, 8.0), (20, 2, 0, 0.0), (20, 3, 1, 0.0), (20, 4, 2, 0.0)]
    assert neighbours.nearest(df.limit(0), df.limit(0)).count() == 0
    assert [r.vec_id for r in neighbours.nearest(df, df.where("vec_id = 0")).collect()] == [8, 1, 2, 20, 9]


def test_neighbours_of_doubles(llm):
    """Scores are of the doubles as given: nothing is rounded to float, and 1e39 is a finite component."""
    rows = [(0, [1.0, 0.5]), (1, [1.0, 0.0]), (2, [1.000000001, 0.0]), (3, [1e39, 0.0]), (4, [-1.0, 1e-300]), (5, [1e200, 1e200])]
    df = llm.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.nearest(df, df.where("vec_id = 0")).collect()
    assert [(r.vec_id, r.score) for r in got] == [(5, 1.5e200), (3, 1e39), (2, 1.000000001), (1, 1.0), (4, -1.0 + 5e-301)]


@pytest.mark.parametrize("block", [50, 16_384])
def test_neighbours_of_clusters(llm, block):
    """Vectors in tight clusters, one of which holds a third of the rows: exact where everything is visited, and recall otherwise."""
    random = np.random.default_rng(2)
    centres = random.standard_normal((30, 12))
    of = np.where(random.random(900) < 0.33, 0, random.integers(0, 30, 900))
    x = (centres[of] + 0.2 * random.standard_normal((900, 12))) * random.uniform(0.5, 2, (900, 1))
    df = llm.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    asked = list(range(0, 900, 20))
    want = {q: [i for _, i in sorted((-(x[q] * x[i]).sum(), i) for i in range(900) if i != q)[:10]] for q in asked}

    def found(**how):
        out = {}
        for r in neighbours.nearest(df, df.where("vec_id % 20 = 0"), k=10, block=block, **how).orderBy("query_id", "rank").collect():
            out.setdefault(r.query_id, []).append(r.vec_id)
        return out

    assert found(target=1.0) == want
    some = found()
    assert sum(len(set(some[q]) & set(want[q])) for q in asked) >= 0.9 * 10 * len(asked)


def test_pipeline(llm, small):
    docs = corpus_pipeline.documents(llm, small)
    texts = {d.doc_id: d.text for d in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(llm, docs, small), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        rows = {d.doc_id: d.text for d in docs.collect()}
        assert rows.keys() <= texts.keys() and (name == "repeated_passages" or all(texts[i] == t for i, t in rows.items()))
        if name == "repeated_passages":
            before = brute_suffixes([texts[i] for i in rows])
            assert [kept.decode("utf-8", "ignore") for *_, kept in before] == list(rows.values())
        texts = rows
    packed = corpus_pipeline.STAGES[-1][1](llm, docs, small).collect()
    assert sorted((r.doc_id, r.start, r.length) for r in corpus_pipeline.run(llm, small).collect())[:1][0][0] == min(texts)
    assert {r.doc_id for r in packed} == texts.keys()
