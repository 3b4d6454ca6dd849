"""Merkle manifest of a table, with a version of the tree for every tampered row.

The leaves of a group, in the order of their ids, are cut into aligned blocks of FAN ** levels. A block builds its part
of the tree; its root is a node of the next layer, which is cut the same way, and the groups' roots are the leaves of a
last tree. The tree is persistent: a tampered leaf copies its ancestors and shares every other node. Inside its block a
version copies the nodes from leaf to block root; above, it goes on along the block's path, which the layers hand down
from the top, so that no task sees all versions.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.llm.common import documents, written

FAN, LEVELS = 3, 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def leaf(values: Sequence[Column]) -> Column:
    """Digest of values, each `-` if null, else its length in bytes, a colon and itself."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]), 256)


def ranked(df: DataFrame, tree: str, order: Sequence[str], name: str) -> DataFrame:
    """``df`` with ``rank`` (from 0) inside its tree and ``n``, the tree's size; rows equal in ``order`` stand in any order.

    Rows are sorted over all tasks; what is summed up is one row per tree and task. A running
    number after the order keeps very many equal rows from meeting in one task.
    """
    keys = [tree, *order, "_row"]
    dealt = df.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_row")
    placed = written(dealt.withColumn("_at", F.monotonically_increasing_id()), name).withColumn("_part", F.shiftright("_at", 33))
    spans = placed.groupBy(tree, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_count"))
    whole = Window.partitionBy(tree)
    before = F.coalesce(F.sum("_count").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = spans.select(tree, "_part", (before - F.col("_first")).alias("_shift"), F.sum("_count").over(whole).alias("n"))
    return placed.join(shifts, [tree, "_part"]).withColumn("rank", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def build(hashes: list[str], levels: int, alone: bool) -> list[list[str]]:
    """The nodes of a block by level; ``levels`` above the leaves, or up to a single node if the block is its whole tree."""
    out = [hashes]
    while len(out[-1]) > 1 if alone else len(out) <= levels:
        below = out[-1]
        out.append([digest(*below[i : i + FAN]) for i in range(0, len(below), FAN)])
    return out


def path(nodes: list[list[str]], i: int) -> list[str]:
    """The siblings before and after the i-th leaf and each of its ancestors, two texts a level."""
    out = []
    for level in nodes[:-1]:
        first = i - i % FAN
        out += ["".join(level[first:i]), "".join(level[i + 1 : first + FAN])]
        i //= FAN
    return out


def copies(node: str, siblings: Sequence[str]) -> list[str]:
    """The ancestors that a version with ``node`` in its place has of its own; all other nodes are shared."""
    out = []
    for before, after in zip(siblings[::2], siblings[1::2]):
        node = digest(before, node, after)
        out.append(node)
    return out


def one_by_one(batch: pa.RecordBatch) -> Iterator[dict]:
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


def _blocks(nodes: DataFrame, levels: int, extra: Mapping[str, str], name: str) -> DataFrame:
    """One row per aligned block of (tree, rank, n, hash): its hashes in order, its root, and lists of the ``extra`` columns."""
    size = FAN**levels
    types = {"tree": "string", "block": "long", "n": "long", "hashes": "array<string>", "root": "string", **{c: f"array<{t}>" for c, t in extra.items()}}

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("rank")
        hashes, n = table["hash"].to_pylist(), table["n"][0].as_py()
        root = build(hashes, levels, n <= size)[-1][0]
        kinds = {"long": pa.int64(), "string": pa.string()}
        return pa.table({
            "tree": pa.array([table["tree"][0].as_py()], pa.string()), "block": pa.array([table["block"][0].as_py()], pa.int64()),
            "n": pa.array([n], pa.int64()), "hashes": pa.array([hashes], pa.list_(pa.string())), "root": pa.array([root], pa.string()),
            **{c: pa.array([table[c].to_pylist()], pa.list_(kinds[t])) for c, t in extra.items()},
        })

    blocked = nodes.select("tree", F.expr(f"rank div {size}").alias("block"), "rank", "n", "hash", *extra)
    return written(blocked.groupBy("tree", "block").applyInArrow(run, ", ".join(f"{c} {t}" for c, t in types.items())), name)


def _climb(nodes: DataFrame, levels: int) -> DataFrame:
    """(tree, rank, path, top) of nodes (tree, rank, n, hash): the siblings from each up to the root of its tree, and that root."""
    size, layers = FAN**levels, []
    while True:
        layers.append(_blocks(nodes, levels, {}, "manifest-layer"))
        if (layers[-1].agg(F.max("n")).first()[0] or 0) <= size:
            break
        nodes = layers[-1].where(F.col("n") > size).select("tree", F.col("block").alias("rank"), F.ceil(F.col("n") / size).alias("n"), F.col("root").alias("hash"))

    def hand_down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in one_by_one(batch):
                inner = build(row["hashes"], levels, row["n"] <= size)
                k = len(row["hashes"])
                yield pa.RecordBatch.from_pydict({
                    "tree": [row["tree"]] * k, "rank": [row["block"] * size + i for i in range(k)],
                    "path": pa.array([path(inner, i) + (row["path"] or []) for i in range(k)], pa.list_(pa.string())), "top": [row["top"] or row["root"]] * k,
                })

    known = layers[-1].select("tree", F.lit(0).cast("long").alias("rank"), F.array().cast("array<string>").alias("path"), F.col("root").alias("top")).where("false")
    for layer in reversed(layers):
        known = layer.join(known.withColumnRenamed("rank", "block"), ["tree", "block"], "left").mapInArrow(hand_down, "tree string, rank long, path array<string>, top string")
        known = written(known, "manifest-paths")
    return known


def manifest(docs: DataFrame, tampered: Mapping[str, Column] | None = None, fields: Sequence[str] = FIELDS, id_col: str = "doc_id", group_col: str = "source", levels: int = LEVELS) -> DataFrame:
    """The tree over ``docs`` and a version for each row whose ``fields`` change to the ``tampered`` values.

    Returns per row: doc_id, tree (null group: empty, else `s` and the group), rank, leaf,
    subroot, root, proof (siblings from leaf to root, as before and after at each level),
    version_leaf and copied (the version's leaf and own ancestors up to its root; null where
    the tampering changes nothing) and folded_root (the version's root, or that of the siblings
    and the leaf). Rows without an id come first in their group; rows with equal ids stand in
    the order of their leaves, equal rows in any order. An empty table gives no rows, a table of
    one row a root that is its leaf. Other columns are not read.
    """
    tampered = tampered or {}
    own = [F.col(f"`{f}`") for f in fields]
    rows = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.coalesce(F.concat(F.lit("s"), F.col(f"`{group_col}`").cast("string")), F.lit("")).alias("tree"),
        leaf(own).alias("hash"), (leaf([tampered.get(f, c) for f, c in zip(fields, own)]) if tampered else F.lit(None).cast("string")).alias("version"),
    ).withColumn("version", F.when(F.col("version") != F.col("hash"), F.col("version")))
    size = FAN**levels
    nodes = ranked(written(rows, "manifest-leaves"), "tree", ["doc_id", "hash"], "manifest-sorted")
    blocks = _blocks(nodes, levels, {"doc_id": "long", "version": "string"}, "manifest-blocks")
    upper = _climb(blocks.where(F.col("n") > size).select("tree", F.col("block").alias("rank"), F.ceil(F.col("n") / size).alias("n"), F.col("root").alias("hash")), levels)
    subroots = blocks.where(F.col("n") <= size).select("tree", F.col("root").alias("hash")).unionByName(upper.where("rank = 0").select("tree", F.col("top").alias("hash")))
    groups = written(ranked(subroots.select(F.lit("").alias("all"), "tree", "hash"), "all", ["tree"], "manifest-groups"), "manifest-subroots")
    last = _climb(groups.select(F.col("all").alias("tree"), "rank", "n", "hash"), levels)
    ends = groups.join(last.select("rank", F.col("path").alias("end"), F.col("top").alias("root_")), "rank").select("tree", F.col("hash").alias("subroot"), "end", "root_")
    placed = blocks.join(upper.select("tree", F.col("rank").alias("block"), "path"), ["tree", "block"], "left").join(ends, "tree")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in one_by_one(batch):
                inner = build(row["hashes"], levels, row["n"] <= size)
                above, k = (row["path"] or []) + row["end"], len(row["hashes"])
                proofs = [path(inner, i) + above for i in range(k)]
                own = [None if v is None else copies(v, p) for v, p in zip(row["version"], proofs)]
                # A proof is folded with its own leaf too: it must lead to the root.
                folded = [([v, *c] if v else [h, *copies(h, p)])[-1] for v, c, h, p in zip(row["version"], own, row["hashes"], proofs)]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(row["doc_id"], pa.int64()), "tree": [row["tree"]] * k, "rank": [row["block"] * size + i for i in range(k)],
                    "leaf": row["hashes"], "subroot": [row["subroot"]] * k, "root": [row["root_"]] * k, "proof": pa.array(proofs, pa.list_(pa.string())),
                    "version_leaf": pa.array(row["version"], pa.string()), "copied": pa.array(own, pa.list_(pa.string())), "folded_root": folded,
                })

    schema = "doc_id long, tree string, rank long, leaf string, subroot string, root string, proof array<string>, version_leaf string, copied array<string>, folded_root string"
    return placed.select("tree", "block", "n", "hashes", "doc_id", "version", "path", "subroot", "end", "root_").mapInArrow(fold, schema)


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document; documents whose id has an even crc32 are tampered with: their line ends go."""
    docs = documents(spark, sf_dir)
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    found = manifest(docs, {"text": F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))})
    proof = F.sha2(F.array_join("proof", ""), 256)
    return found.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


_LEAF = " || ".join(f"coalesce(strlen({v}::VARCHAR) || ':' || {v}::VARCHAR, '-')" for v in ("d.doc_id", "source", "lang", "n_chars", "{text}"))

#: The same in DuckDB: both trees level by level, proofs from their nodes, versions folded step by step.
ORACLE = f"""
WITH RECURSIVE crc AS (
  SELECT doc_id, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))) AS r
  FROM (SELECT DISTINCT doc_id FROM documents)
), leaves AS (
  SELECT d.doc_id, coalesce('s' || source, '') AS tree, sha256({_LEAF.format(text="text")}) AS h,
    CASE WHEN xor(r, 4294967295) % 2 = 0 THEN sha256({_LEAF.format(text="replace(text, chr(10), '')")}) ELSE sha256({_LEAF.format(text="text")}) END AS v
  FROM documents d JOIN crc c ON c.doc_id IS NOT DISTINCT FROM d.doc_id
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM leaves
), inner_nodes AS (
  SELECT tree, 0 AS level, i, n, h FROM placed
  UNION ALL
  SELECT tree, level + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM inner_nodes WHERE n > 1 GROUP BY tree, level, i // 3, n
), subroots AS (
  SELECT tree, h, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n FROM inner_nodes WHERE n = 1
), outer_nodes AS (
  SELECT 1000 AS level, i, n, h FROM subroots
  UNION ALL
  SELECT level + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM outer_nodes WHERE n > 1 GROUP BY level, i // 3, n
), nodes AS (
  SELECT tree, level, i, n, h FROM inner_nodes WHERE n > 1
  UNION ALL
  SELECT s.tree, o.level, o.i, o.n, o.h FROM subroots s CROSS JOIN outer_nodes o WHERE o.n > 1
), runs AS (
  SELECT tree, level, i // 3 AS run, n, list(h ORDER BY i) AS hs FROM nodes GROUP BY tree, level, i // 3, n
), folds AS (
  SELECT p.tree, p.i AS leaf_no, 0 AS level, p.i, p.v AS node, '' AS proof FROM placed p
  UNION ALL
  SELECT f.tree, f.leaf_no,
    CASE WHEN r.level IS NULL THEN 1000 ELSE f.level + 1 END, CASE WHEN r.level IS NULL THEN s.i ELSE f.i // 3 END,
    CASE WHEN r.level IS NULL THEN f.node ELSE sha256(array_to_string(list_concat(list_concat(hs[1 : (f.i % 3)], [f.node]), hs[f.i % 3 + 2 : 3]), '')) END,
    CASE WHEN r.level IS NULL THEN f.proof ELSE f.proof || array_to_string(list_concat(hs[1 : (f.i % 3)], hs[f.i % 3 + 2 : 3]), '') END
  FROM folds f JOIN subroots s ON s.tree = f.tree LEFT JOIN runs r ON r.tree = f.tree AND r.level = f.level AND r.run = f.i // 3
  WHERE r.level IS NOT NULL OR f.level < 1000
), ends AS (
  SELECT tree, leaf_no, arg_max(node, level) AS folded, arg_max(proof, level) AS proof FROM folds GROUP BY tree, leaf_no
)
SELECT p.doc_id, p.h AS leaf, s.h AS subroot, t.h AS root, sha256(e.proof) AS proof_sha256, e.folded AS folded_root, e.folded = t.h AS verified
FROM placed p JOIN subroots s ON s.tree = p.tree JOIN ends e ON e.tree = p.tree AND e.leaf_no = p.i CROSS JOIN (SELECT h FROM outer_nodes WHERE n = 1) t
"""
