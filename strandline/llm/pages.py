"""Main text of web pages by wrapper induction over pages of the same host.

Every page becomes a tree of its block elements. Trees of a host are aligned by simple
tree matching (the largest order-preserving match of children with equal labels); nodes
whose text is the same on all pages are template, the others are slots. The slot that
holds the article gives the host's content path, and short constant nodes inside it are
left out of every page's text.
"""

from __future__ import annotations

import html
import json
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from hashlib import blake2b

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import byte_sizes, slices, written

# Kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "xmp")
BLOCKS = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr legend li main menu nav ol optgroup option p pre section select summary table caption tbody thead tfoot tr td th ul button".split()
)
#: Start tags that end an open paragraph.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
ENDS_OWN = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("ul ol menu table dl select body html article section div nav main aside".split())
NEVER = frozenset("head nav aside form footer select button dialog".split())
#: Words of class names and ids that mark what is no article text.
BOILERPLATE = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar comment comments disqus cookie cookies "
    "notice notices consent gdpr popup modal overlay newsletter subscribe subscription menu nav navigation navbar breadcrumb breadcrumbs footer header "
    "masthead topbar share sharing social related recommended recommendations widget login signup search toolbar alert pagination pager copyright "
    "reply replies respond feedback paywall disclaimer".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
ARTICLE = frozenset("article content post entry story main body text".split())
ROOTS = ("article", "main")

_TOKEN = re.compile(
    r"(?P<note><!--)(?:.*?(?P<over>-->)|.*\Z)|<(?P<raw>" + "|".join(RAW) + r")\b[^>]*>(?:.*?(?P<end></(?P=raw)\s*>)|.*\Z)|<[!?][^>]*>"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>[^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*)>|<[/a-zA-Z][^>]*>",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Node:
    """A block element: its label, whether it can be article text, its children and texts in order."""

    __slots__ = ("label", "tag", "never", "parts")

    def __init__(self, label: str, tag: str, never: bool):
        self.label, self.tag, self.never, self.parts = label, tag, never, []

    @property
    def children(self) -> list[Node]:
        return [p for p in self.parts if not isinstance(p, str)]


def _marks(rest: str) -> tuple[str, bool]:
    """The part of a label that class and id give, and whether they mark boilerplate."""
    label, never = "", False
    for name, *values in _ATTRIBUTE.findall(rest):
        value, name = "".join(values), name.lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            never = True
        elif name == "role":
            never |= value.lower() in ROLES
        elif name in ("class", "id"):
            words = [w.lower() for w in _WORD.findall(value)]
            never |= not BOILERPLATE.isdisjoint(words)
            label += ("." if name == "class" else "#") + "-".join(words[:4])
    return label, never


#: Elements below this depth hang on the one at this depth, as in browsers (which allow 512), in page order.
DEPTH = 150


class _Open:
    """The open elements while a page is read."""

    def __init__(self):
        self.stack = [Node("", "", False)]
        self.count: Counter = Counter()  # open elements by tag, so that what is not open isn't looked for

    def add(self, part: str | Node) -> None:
        top = self.stack[-1]
        if len(self.stack) - 1 > DEPTH:
            above = self.stack[DEPTH]
            if isinstance(part, Node):
                part.never |= top.never
                above.parts.append(part)
                return
            if above.parts[-1] is not top:  # goes on after an element inside it
                top = self.stack[-1] = Node(top.label, top.tag, top.never)
                above.parts.append(top)
        top.parts.append(part)

    def push(self, node: Node) -> None:
        self.stack.append(node)
        self.count[node.tag] += 1

    def cut(self, i: int) -> None:
        for node in self.stack[i:]:
            self.count[node.tag] -= 1
        del self.stack[i:]

    def close(self, tag: str) -> bool:
        """Close the innermost element with the tag and all inside it."""
        if not self.count[tag]:
            return False
        if tag not in ("body", "html"):  # what follows these still belongs to the page
            self.cut(next(i for i in range(len(self.stack) - 1, 0, -1) if self.stack[i].tag == tag))
        return True

    def end_inside(self, tags: Sequence[str], more: bool = False) -> None:
        """Close the innermost open element with one of the tags, up to the scope around; ``more``: all of them."""
        if any(self.count[t] for t in tags):
            for i in range(len(self.stack) - 1, 0, -1):
                if self.stack[i].tag in tags:
                    self.cut(i)
                    if not more:
                        break
                elif self.stack[i].tag in SCOPES:
                    break


def _ends_open(m: re.Match) -> bool:
    """Whether a token is a comment or raw element without an end: all that follows belongs to it."""
    return bool(m["raw"] and not m["end"] or m["note"] and not m["over"])


def _tokens(page: str) -> Iterator[tuple[str, re.Match | None]]:
    """The texts and tags of a page in order. Tags end in `>`: nothing is sought behind the last one, where a search would fail at its very end."""
    stop = page.rfind(">") + 1
    at, m = 0, None
    for m in _TOKEN.finditer(page, 0, stop):
        yield page[at : m.start()], m
        at = m.end()
    if m is None or at < stop or not _ends_open(m):
        comment = page.find("<!--", stop)
        yield page[at : len(page) if comment < 0 else comment], None


def parse(page: str) -> Node:
    """The tree of a page; unclosed and misplaced tags are mended as browsers do."""
    tree = _Open()
    stack = tree.stack
    for text, m in _tokens(page):
        if text:
            tree.add(text)
        if m is None:
            break
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if name == "br":
            tree.add(" ")
            continue
        if name not in BLOCKS:
            continue
        if m["close"]:
            if not tree.close(name) and name == "p":
                tree.add(Node("p", "p", False))
            continue
        if name in ENDS_P:
            tree.end_inside(("p",))
        elif own := ENDS_OWN.get(name):
            tree.end_inside(own, more=name == "tr")
        if name in ("html", "body") and tree.count[name]:
            continue
        rest = m["rest"]
        label, never = _marks(rest) if "class" in rest or "id" in rest or "role" in rest else ("", False)
        node = Node(name + label, name, never or name in NEVER)
        tree.add(node)
        if name not in VOID and not rest.endswith("/"):
            tree.push(node)
    return stack[0]


def _flat(text: str) -> str:
    return " ".join(html.unescape(text).split() if "&" in text else text.split())


# A wrapper node: [label, never, low hash, high hash, longest text, children, pages, contents]. Low and high differ where the
# text varies; contents are the least hashes of different pages' texts, up to TEMPLATE_PAGES.
#: A node is template only if it is the same on this many pages of different content at least.
TEMPLATE_PAGES = 8


def skeleton(node: Node) -> list:
    """The page's tree as a wrapper; neighbours with equal labels and no blocks inside are one node."""
    texts = _flat("".join(p for p in node.parts if isinstance(p, str)))
    children: list[list] = []
    for child in node.children:
        made = skeleton(child)
        last = children[-1] if children else None
        if last and last[0] == made[0] and not last[5] and not made[5]:
            last[2] = last[3] = (last[2] * 1000003 + made[2]) % (1 << 61)
            last[4] += made[4]
        else:
            children.append(made)
    h = int.from_bytes(blake2b(texts.encode(), digest_size=7).digest(), "little") if texts else 0
    return [node.label, node.never, h, h, len(texts), children, 1]


def _match(a: list, b: list, memo: dict) -> int:
    """Size of the largest match of two trees whose roots have equal labels."""
    if a[0] != b[0]:
        return 0
    key = id(a), id(b)
    if key not in memo:
        row = [0] * (len(b[5]) + 1)
        for x in a[5]:
            new = [0]
            for j, y in enumerate(b[5]):
                new.append(max(new[j], row[j + 1], row[j] + (_match(x, y, memo) if x[0] == y[0] else 0)))
            row = new
        memo[key] = row[-1] + 1
    return memo[key]


def merge(a: list, b: list, memo: dict | None = None) -> list:
    """Two wrappers as one: matched nodes join, the others stay where they are."""
    memo = {} if memo is None else memo
    xs, ys = a[5], b[5]
    table = [[0] * (len(ys) + 1) for _ in range(len(xs) + 1)]
    for i, x in enumerate(xs):
        for j, y in enumerate(ys):
            table[i + 1][j + 1] = max(table[i][j + 1], table[i + 1][j], table[i][j] + (_match(x, y, memo) if x[0] == y[0] else 0))
    i, j, out = len(xs), len(ys), []
    while i or j:
        if i and j and xs[i - 1][0] == ys[j - 1][0] and table[i][j] == table[i - 1][j - 1] + _match(xs[i - 1], ys[j - 1], memo):
            i, j = i - 1, j - 1
            out.append(merge(xs[i], ys[j], memo))
        elif i and table[i][j] == table[i - 1][j]:
            i -= 1
            out.append(xs[i])
        else:
            j -= 1
            out.append(ys[j])
    contents = [sorted({*x, *y})[:TEMPLATE_PAGES] for x, y in zip(a[7:], b[7:])]
    return [a[0], a[1] and b[1], min(a[2], b[2]), max(a[3], b[3]), max(a[4], b[4]), out[::-1], a[6] + b[6], *contents]


def _mass(node: list) -> int:
    """Text that may be an article's, by its longest length, in a wrapper's node."""
    return 0 if node[1] else node[4] + sum(map(_mass, node[5]))


def _varied(node: list) -> int:
    """The part of it in nodes whose text differs between pages."""
    return 0 if node[1] else node[4] * (node[2] != node[3]) + sum(map(_varied, node[5]))


def content(wrapper: list) -> dict:
    """The path of labels to the slot with the article, and the paths of template nodes inside it."""
    found: list[tuple[int, list[str], list]] = []

    def look(node: list, path: list[str], hidden: bool) -> None:
        for child in node[5]:
            here = [*path, child[0]]
            tag = child[0].split(".")[0].split("#")[0]
            never = hidden or child[1] and tag not in ("html", "body")
            if tag in ROOTS and not never:
                found.append((_mass(child), here, child))
            look(child, here, never)

    look(wrapper, [], False)
    if found:
        _, path, node = max(found, key=lambda x: x[0])
    else:  # go down while one child holds most of the text
        path, node = [], wrapper
        while node[5]:
            best = max(node[5], key=_mass)
            if best[1] or _mass(best) < 0.8 * max(_mass(node), 1) or not best[5]:
                break
            path, node = [*path, best[0]], best
    constant = []
    whole = _mass([node[0], False, *node[2:]])
    varied = _varied([node[0], False, *node[2:]])

    def template(n: list, at: list[str]) -> None:
        for child in n[5]:
            here = [*at, child[0]]
            # On every page that has the slot: what only some have, such as copies of one article, is theirs.
            everywhere = child[6] == node[6] and len(child[7]) >= TEMPLATE_PAGES
            same = child[2] == child[3] and child[2] and not child[5] and everywhere
            if same and 10 * child[4] < whole and sum(c[0] == child[0] for c in n[5]) == 1:
                constant.append("/".join(here))
            template(child, here)

    if 2 * varied > whole:
        template(node, path)
    return {"path": path, "template": constant}


def article(page: str, rule: dict) -> str:
    """The article's blocks, joined by blank lines."""
    tree = parse(page)
    path, template = rule["path"], set(rule["template"])

    def open_(node: Node) -> bool:
        return not node.never or node.tag in ("html", "body")

    def descend(nodes: list[Node], depth: int) -> list[Node]:
        if depth == len(path):
            return nodes
        return descend([c for n in nodes for c in n.children if c.label == path[depth] and open_(c)], depth + 1)

    def named(node: Node) -> list[Node]:
        out = []
        for c in filter(open_, node.children):
            out += [c] if c.tag in ROOTS else named(c)
        return out

    roots = descend([tree], 0)
    above = path
    if not roots:
        roots, above = named(tree) or [tree], None
    blocks: list[str] = []

    def walk(node: Node, at: str | None) -> None:
        text: list[str] = []
        for part in node.parts:
            if isinstance(part, str):
                text.append(part)
                continue
            if text:
                blocks.append("".join(text))
                text = []
            here = None if at is None else f"{at}/{part.label}" if at else part.label
            if part.tag in ("html", "body") and not above or not (part.never or here in template):
                walk(part, here)
        if text:
            blocks.append("".join(text))

    for r in roots:
        walk(r, None if above is None else "/".join(above))
    return "\n\n".join(x for x in map(_flat, blocks) if x)


def host(url: Column) -> Column:
    """Host of an url, empty for null."""
    name = F.regexp_replace(F.lower(F.trim(F.coalesce(url, F.lit("")))), r"^[a-z][a-z0-9+.-]*://", "")
    return F.regexp_replace(F.regexp_extract(name, r"^[^/?#]*", 0), r"^.*@", "")


def _shape(node: list) -> list:
    return [node[0], int(node[1]), [_shape(c) for c in node[5]]]


def _hashes(node: list) -> list[tuple]:
    return [(*node[2:5], node[6]), *(h for c in node[5] for h in _hashes(c))]


def _content(node: list) -> list[int]:
    """Hashes of the texts that may be an article's, in order."""
    return [] if node[1] and node[0].split(".")[0].split("#")[0] not in ("html", "body") else [node[2], *(h for c in node[5] for h in _content(c))]


def _joined(shape: list, values: Iterator, contents: list[int]) -> list:
    low, high, size, n = next(values)
    return [shape[0], bool(shape[1]), low, high, size, [_joined(c, values, contents) for c in shape[2]], n, contents]


def wrappers(pages: DataFrame, together: int = 64) -> DataFrame:
    """(host, rule) of every host, as JSON.

    Pages with the same tree are joined in the partition that reads them and again in the
    shuffle, so a host with very many pages sends few rows. The different trees of a host
    are aligned in groups of up to ``together``, then the results, until one is left.
    """
    def shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, str], list] = {}
        texts: dict[tuple[str, str], list[int]] = {}

        def flush() -> pa.RecordBatch:
            rows = [(*key, i, *v, texts[key] if i == 0 else []) for key, values in seen.items() for i, v in enumerate(values)]
            seen.clear()
            texts.clear()
            kinds = (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["host", "shape", "place", "low", "high", "size", "n", "contents"])

        for batch in batches:
            for name, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
                tree = skeleton(parse(page))
                key, values = (name, json.dumps(_shape(tree))), _hashes(tree)
                old = seen.get(key)
                seen[key] = values if old is None else [(min(a[0], b[0]), max(a[1], b[1]), max(a[2], b[2]), a[3] + b[3]) for a, b in zip(old, values)]
                own = int.from_bytes(blake2b(repr(_content(tree)).encode(), digest_size=7).digest(), "little")
                texts[key] = sorted({*texts.get(key, ()), own})[:TEMPLATE_PAGES]
                if len(seen) >= 5000:
                    yield flush()
        if seen:
            yield flush()

    places = pages.mapInArrow(shapes, "host string, shape string, place int, low long, high long, size long, n long, contents array<long>")
    contents = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("contents")))), 1, TEMPLATE_PAGES).alias("contents")
    places = places.groupBy("host", "shape", "place").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.max("size").alias("size"), F.sum("n").alias("n"), contents)
    trees = places.groupBy("host", "shape").agg(F.sort_array(F.collect_list(F.struct("place", "low", "high", "size", "n", "contents"))).alias("places"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [json.dumps(_joined(json.loads(s), iter([(v["low"], v["high"], v["size"], v["n"]) for v in p]), p[0]["contents"])) for s, p in zip(batch.column("shape").to_pylist(), batch.column("places").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(made, pa.string())], names=["host", "tree"])

    current = written(trees.mapInArrow(whole, "host string, tree string"), "page-trees")

    def align(group: pd.DataFrame) -> pd.DataFrame:
        made = sorted(json.loads(t) for t in group["tree"])
        out = made[0]
        for other in made[1:]:
            out = merge(out, other)
        return pd.DataFrame({"host": [group["host"].iloc[0]], "tree": [json.dumps(out)]})

    while True:
        counts = current.groupBy("host").agg(F.count("*").alias("n"))
        if (counts.agg(F.max("n")).first()[0] or 1) == 1:
            break
        part = F.pmod(F.xxhash64("tree"), F.greatest(F.ceil(F.col("n") / together).cast("long"), F.lit(1))).alias("part")
        dealt = current.join(counts, "host").select("host", "tree", part)
        current = written(dealt.groupBy("host", "part").applyInPandas(align, "host string, tree string"), "page-trees")

    def rules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [json.dumps(content(json.loads(t))) for t in batch.column("tree").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(made, pa.string())], names=["host", "rule"])

    return written(current.mapInArrow(rules, "host string, rule string"), "page-rules")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text) of every page.

    Character references are decoded, white space inside a block becomes one space, blocks
    are joined by a blank line. Null or empty html gives an empty text; pages without an
    url share a host; repeated rows give repeated results, an empty table none. Elements nested
    over DEPTH deep are read as lying side by side; an unclosed comment or script goes to the end.
    """
    raw = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    # The table of rules is written, so that Spark knows its size when it chooses the join.
    raw = raw.withColumn("host", host(F.col("url")))
    rules = wrappers(raw.select("host", "html"))
    joined = raw.join(rules, "host", "left").select("page_id", "url", "html", "rule")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str | None, dict] = {None: {"path": [], "template": []}}
        for batch in batches:
            for a, b in slices(byte_sizes(batch.column("html"))):
                part = batch.slice(a, b - a)
                out = []
                for page, rule in zip(part.column("html").to_pylist(), part.column("rule").to_pylist()):
                    if rule not in known:
                        known[rule] = json.loads(rule)
                    out.append(article(page, known[rule]))
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(out, pa.string())], names=["page_id", "url", "text"])

    return joined.mapInArrow(run, "page_id long, url string, text string")


def op4_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of every page, with its length."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumn("n_chars", F.length("text").cast("long"))
