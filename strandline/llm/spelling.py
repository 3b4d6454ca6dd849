"""Spelling variants: words one code point apart, met through the nodes of two tries.

The trie of the words and the trie of the reversed words are numbered. A word cut at i is the pair (node of its first
i code points, node of its last ones). Two words differ in one code point replaced where their pairs around a skipped
position are equal, and by one inserted where the pair around a skipped position equals the other's pair without a
skip. Node numbers are exact, so equal pairs need no check, and a pair is shared by no more words than there are
different code points.

A trie is numbered from the sorted words: a word adds the nodes below what it has in common with the word before it.
Sorted parts are numbered on their own; the nodes that lie across an edge between parts are named by the edge.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import documents, id_and_text, text_slices, written

RUN = "a-zA-ZÀ-ÿ"
MOST_WORDS = 100_000  # different words counted in a task before they are passed on
PART_WORDS = 100_000  # words in a sorted part
PART_BITS = 40  # a part numbers its nodes below 2 ** 40


def variants(text: str, doc_id: int | None, least: int, every: int) -> Counter:
    """Counts of the words of a text: lower-cased runs of letters, some with one letter left out."""
    out: Counter = Counter()
    prefix = f"{'' if doc_id is None else doc_id}:".encode()
    # Lower-casing bytes touches A-Z alone. Runs of fewer letters cannot become long enough.
    for run, n in Counter(re.findall(f"[{RUN}]{{{least},}}", text.encode().lower().decode())).items():
        h = crc32(run.encode(), crc32(prefix))
        if h % every == 0:
            k = h % len(run)
            run = run[:k] + run[k + 1 :]
        if len(run) >= least:
            out[run] += n
    return out


def words(docs: DataFrame, least: int = 7, twice: int = 2, every: int = 31, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of all words of at least ``least`` code points that occur ``twice`` or more in all texts together.

    Where ``every`` divides the crc32 of `id:run`, the run loses a code point (a null id
    is written as nothing). Null and empty texts have no words; repeated rows count again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for part, texts in text_slices(batch):
                for doc_id, text in zip(part.column("doc_id").to_pylist(), texts):
                    held.update(variants(text, doc_id, least, every))
                    if len(held) > MOST_WORDS:
                        yield out()
                        held.clear()
        yield out()

    counted = id_and_text(docs, id_col, text_col).mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= twice)


def common(a: str, b: str) -> int:
    """Length of the common beginning."""
    most = min(len(a), len(b))
    if a[:most] == b[:most]:
        return most
    low, high = 0, most  # a[:low] is common, a[:high] is not
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid)
    return low


class Edges:
    """The last word of each part and the first of the next. A node across edges is named by the first edge it crosses."""

    def __init__(self, parts: list[tuple[int, str, str]]):
        self.parts = [p for p, _, _ in parts]
        self.first = [f for _, f, _ in parts]
        self.named: list[list[int]] = [[]]  # by edge: names of the nodes across it, from depth 1
        for i in range(1, len(parts)):
            before = self.named[-1]
            through = min(len(before), common(parts[i - 1][1], parts[i - 1][2]))
            depth = common(parts[i - 1][2], parts[i][1])
            self.named.append([before[d] if d < through else -(i << PART_BITS) - d - 1 for d in range(depth)])
        self.named.append([])

    def around(self, part: int) -> tuple[list[int], str, list[int]]:
        """Names of the nodes shared with the part before, the first word of the next part, names of the nodes shared with that."""
        i = bisect_right(self.parts, part) - 1
        return self.named[i], self.first[i + 1] if i + 1 < len(self.first) else "", self.named[i + 1]


class Numbering:
    """The nodes of the words of a part, asked for in their order."""

    def __init__(self, part: int, edges: Edges):
        back, self.next_word, self.ahead = edges.around(part)
        self.nodes, self.shared = [0, *back], len(back)
        self.last, self.count = "", part << PART_BITS

    def of(self, word: str) -> list[int]:
        """The trie nodes from the root (0) to the word."""
        nodes = self.nodes[: (common(self.last, word) if self.last else self.shared) + 1]
        crossing = common(word, self.next_word)
        for depth in range(len(nodes), len(word) + 1):
            if depth <= crossing:
                nodes.append(self.ahead[depth - 1])
            else:
                self.count += 1
                nodes.append(self.count)
        self.last, self.nodes = word, nodes
        return nodes


def trie(sorted_words: DataFrame, spelled: str) -> DataFrame:
    """(w, nodes) of words (w, ``spelled``, part) whose parts are ranges in the order of ``spelled``.

    What reaches the driver is the first and the last word of each part.
    """
    ends = sorted_words.groupBy("part").agg(F.min(spelled).alias("first"), F.max(spelled).alias("last")).orderBy("part").collect()
    edges = Edges([(r.part, r.first, r.last) for r in ends])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, numbering, size = None, None, 0
        ids: list[int] = []
        nodes: list[list[int]] = []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(nodes, pa.list_(pa.int64()))], names=["w", "nodes"])

        for batch in batches:
            for part, w, word in zip(*(batch.column(c).to_pylist() for c in ("part", "w", "spelled"))):
                if part != current:
                    current, numbering = part, Numbering(part, edges)
                ids.append(w)
                nodes.append(numbering.of(word))
                size += len(word)
                if size > 500_000:
                    yield out()
                    ids, nodes, size = [], [], 0
        yield out()

    dealt = sorted_words.select("part", "w", F.col(spelled).alias("spelled")).repartition("part").sortWithinPartitions("part", "spelled")
    return dealt.mapInArrow(run, "w long, nodes array<long>")


def _sorted(df: DataFrame, by: str, parts: int, name: str) -> DataFrame:
    return written(df.repartitionByRange(parts, by).sortWithinPartitions(by).withColumn("at", F.monotonically_increasing_id()), name).withColumn("part", F.shiftright("at", 33))


def near_words(counted: DataFrame, name: str = "spelling", part_words: int = PART_WORDS) -> DataFrame:
    """(w, word, n, n_near, best) of distinct words (word, n): how many words are one code point away, and the most frequent of them.

    ``w`` numbers the words in code-point order. ``best`` (n, back: the word's ``w`` times -1)
    is null without a near word; of equally frequent ones it is the first in code-point order.
    """
    counted = written(counted, f"{name}-words")
    parts = counted.count() // part_words + 1
    forward = _sorted(counted, "word", parts, f"{name}-forward").withColumnRenamed("at", "w")
    backward = _sorted(forward.select("w", F.reverse("word").alias("reversed")), "reversed", parts, f"{name}-backward")
    ends = trie(backward, "reversed").withColumnRenamed("nodes", "ends")
    spelled = forward.select("w", F.split("word", "").alias("letters"), "n")
    both = written(spelled.join(trie(forward, "word"), "w").join(ends, "w"), f"{name}-nodes")
    # The pair around each code point i (leaving out either of two equal neighbours gives the same word: the
    # first stands for both), and the pair before each code point and at the end, without a skip.
    around = "transform(sequence(1, size(letters)), i -> struct(nodes[i - 1] AS head, ends[size(letters) - i] AS tail, i = 1 OR letters[i - 1] <> get(letters, i - 2) AS first))"
    between = "transform(sequence(1, size(nodes)), i -> struct(nodes[i - 1] AS head, ends[size(nodes) - i] AS tail, CAST(NULL AS boolean) AS first))"
    skip, gap = (both.select("w", "n", F.explode(F.expr(pairs)).alias("pair")).select("pair.*", "w", "n") for pairs in (around, between))
    shared = skip.unionByName(gap).groupBy("head", "tail").agg(F.collect_list(F.struct("n", (-F.col("w")).alias("back"), "first")).alias("all")).where("size(all) > 1")
    met = shared.select("all", F.explode("all").alias("own")).select(
        (-F.col("own.back")).alias("w"),
        # Skips meet all other skips, and the word without a skip where they are the first of equal neighbours.
        F.expr("filter(all, x -> x.back <> own.back AND CASE WHEN own.first IS NULL THEN x.first ELSE x.first IS NOT NULL OR own.first END)").alias("near"),
    ).where("size(near) > 0").select("w", F.size("near").alias("k"), F.expr("array_max(transform(near, x -> struct(x.n AS n, x.back AS back)))").alias("best"))
    summed = met.groupBy("w").agg(F.sum("k").alias("n_near"), F.max("best").alias("best"))
    return forward.select("w", "word", "n").join(summed, "w", "left").withColumn("n_near", F.coalesce("n_near", F.lit(0)).cast("long"))


def forms(near: DataFrame, times: int = 10, rounds: int = 60) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of words (w, word, n, n_near, best).

    A form is the best near word, if it is ``times`` as frequent; a root the end of the forms,
    found by steps of doubled length.
    """
    near = written(near, "spelling-near").withColumn("form_w", F.when(F.col("best.n") >= times * F.col("n"), -F.col("best.back")))
    steps = written(near.where("form_w IS NOT NULL").select("w", F.col("form_w").alias("root_w")), "spelling-steps")
    for _ in range(rounds):
        ahead = steps.select(F.col("w").alias("root_w"), F.col("root_w").alias("next"))
        longer = written(steps.join(ahead, "root_w", "left").select("w", F.coalesce("next", "root_w").alias("root_w"), F.col("next").isNotNull().alias("moved")), "spelling-steps")
        steps = longer.drop("moved")
        if not longer.where("moved").limit(1).collect():
            break
    else:
        raise RuntimeError(f"forms have not ended in {rounds} rounds")
    chained = near.select("w", "word", "n", "n_near", "form_w", F.when(F.col("form_w").isNotNull(), F.col("best.n")).alias("form_n")).join(steps, "w", "left")
    some = chained.where("form_w IS NOT NULL")
    named = some.join(near.select(F.col("w").alias("form_w"), F.col("word").alias("form")), "form_w").join(near.select(F.col("w").alias("root_w"), F.col("word").alias("root")), "root_w")
    alone = chained.where("form_w IS NULL").withColumn("form", F.lit(None).cast("string")).withColumn("root", F.col("word"))
    columns = ["word", "form", "root", "n", "n_near", "form_n"]
    return named.select(columns).unionByName(alone.select(columns))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of at least 7 code points that occurs twice, its near words, its form and its root."""
    return forms(near_words(words(documents(spark, sf_dir))))


#: The same in DuckDB: words that share a spelling with one code point skipped.
ORACLE = r"""
WITH RECURSIVE runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents
), counted AS (
  SELECT id, run, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY id, run
), hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(id || ':' || run, ''),
      lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [(192 + (unicode(c) >> 6))::BIGINT, (128 + (unicode(c) & 63))::BIGINT] END))),
    lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))) AS h
  FROM counted
), spelled AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n FROM hashed
), words AS (
  SELECT word, sum(n)::BIGINT AS n FROM spelled WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), skips AS (
  SELECT word, n, i, substr(word, 1, i - 1) || '*' || substr(word, i + 1) AS replaced, substr(word, 1, i - 1) || substr(word, i + 1) AS deleted
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), near AS (
  SELECT a.word, b.word AS other, b.n FROM skips a JOIN skips b ON a.replaced = b.replaced AND a.word <> b.word
  UNION
  SELECT a.word, b.word, b.n FROM skips a JOIN words b ON a.deleted = b.word
  UNION
  SELECT b.word, a.word, a.n FROM skips a JOIN words b ON a.deleted = b.word
), best AS (
  SELECT word, count(*) AS n_near, max(n) AS most FROM near GROUP BY word
), formed AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.most >= 10 * w.n THEN b.most END AS form_n,
    CASE WHEN b.most >= 10 * w.n THEN (SELECT min(x.other) FROM near x WHERE x.word = w.word AND x.n = b.most) END AS form
  FROM words w LEFT JOIN best b ON b.word = w.word
), chain AS (
  SELECT word, word AS here, 0 AS step FROM formed
  UNION ALL
  SELECT c.word, f.form, step + 1 FROM chain c JOIN formed f ON f.word = c.here WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM formed f JOIN (SELECT word, arg_max(here, step) AS root FROM chain GROUP BY word) c ON c.word = f.word
"""
