"""Quality rules as a ledger of failure bits, judged by versioned policies.

Every rule is evaluated once. The ledger keeps the measurements and one bit per failed
rule; policies are bit masks, so a new policy, or what each rule adds to one, needs no
second look at the texts. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import documents, id_and_text, rows_again, with_row

# White space between words, and the characters counted as symbols.
GAP = r"[\x20\x09-\x0D]"
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Rule and when it fails, on the measurements; the bit is the place in this list.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("repeated_lines", "2 * n_dup_lines > n_lines"),
    ("capitals", "10 * n_capitals > 4 * word_chars"),
    ("exclamations", "10 * n_exclamations > 2 * n_words"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 25 * n_words"),
]

#: Versions of what makes a document go.
POLICIES: dict[str, list[str]] = {
    "base": ["few_words", "repeated_words"],
    "v1": ["few_words", "repeated_words", "symbols", "repeated_lines"],
    "v2": ["few_words", "repeated_words", "symbols", "repeated_lines", "capitals", "exclamations", "short_words", "long_words"],
}


def mask(rules: list[str]) -> int:
    places = {name: i for i, (name, _) in enumerate(RULES)}
    return sum(1 << places[name] for name in rules)


def _less(text: Column, characters: str) -> Column:
    """How many of the characters a text holds."""
    return F.length(text) - F.length(F.translate(text, characters, ""))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the measurements. A null text has no words, and zero of everything."""
    return _measure(id_and_text(docs, id_col, text_col), "doc_id")


def _measure(df: DataFrame, *kept: str) -> DataFrame:
    df = df.select(
        *kept,
        F.filter(F.split("text", GAP + "+"), lambda w: w != "").alias("words"),
        F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.length(F.translate("text", BLANKS, "")).cast("long").alias("word_chars"),
        _less(F.col("text"), SYMBOLS).cast("long").alias("n_symbols"),
        _less(F.col("text"), CAPITALS).cast("long").alias("n_capitals"),
        _less(F.col("text"), "!").cast("long").alias("n_exclamations"),
    )
    # Windows of three words as (hash, place), in order of the hash: equal ones are neighbours.
    window = F.transform(
        F.expr("slice(words, 1, greatest(size(words) - 2, 0))"),
        lambda w, i: F.struct(F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2)).alias("h"), i.alias("p")),
    )
    df = df.select(
        *kept, "word_chars", "n_symbols", "n_capitals", "n_exclamations",
        F.size("words").cast("long").alias("n_words"), F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.sort_array(window).alias("windows"),
    )
    again = F.filter(
        F.transform("windows", lambda e, i: F.when(
            (e.h == F.get("windows", i - 1).h) | (e.h == F.get("windows", i + 1).h), e.p)),
        lambda p: p.isNotNull(),
    )
    df = df.withColumn("places", F.sort_array(again)).drop("windows")
    covered = F.aggregate(
        F.transform("places", lambda p, i: F.coalesce(F.least(F.get("places", i + 1) - p, F.lit(3)), F.lit(3))),
        F.lit(0).cast("long"), lambda total, n: total + n,
    )
    # One row made of one: a filter on measurements then stays above, where each is evaluated once.
    measures = F.struct(*[c for c in df.columns if c not in (*kept, "places")], covered.alias("n_repeat_words"))
    return df.select(*kept, F.inline(F.array(measures)))


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measurements of every document and ``fails``: bit i is set if rule i fails.

    Rows are independent: no shuffle. Repeated rows give repeated results, an empty
    table none; a null id stays null.
    """
    return _marked(measure(docs, id_col, text_col))


def _marked(measured: DataFrame) -> DataFrame:
    bits = [F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, (_, rule) in enumerate(RULES)]
    fails = bits[0]
    for b in bits[1:]:
        fails = fails.bitwiseOR(b)
    return measured.withColumn("fails", fails)


def judge(marked: DataFrame, policy: str = "v2") -> DataFrame:
    """The ledger with ``kept``: no rule of the policy failed."""
    return marked.withColumn("kept", F.col("fails").bitwiseAND(F.lit(mask(POLICIES[policy])).cast("long")) == 0)


def passing(docs: DataFrame, policy: str = "v2", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, as they are, that a policy keeps."""
    marked = judge(_marked(_measure(with_row(docs, text_col), "row", "text")), policy)
    return rows_again(marked.where("kept"), docs, text_col)


def ablations(marked: DataFrame, policy: str = "v2") -> DataFrame:
    """Per rule of a policy: documents it fails, those only it fails, and those kept without it.

    The ledger is first counted per pattern of bits, so a few rows meet after the shuffle.
    """
    whole = mask(POLICIES[policy])
    patterns = marked.groupBy(F.col("fails").bitwiseAND(F.lit(whole).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(mask([r])).cast("long").alias("bit")) for r in POLICIES[policy]])).alias("r")
    each = patterns.select("bits", "n", rules).select("bits", "n", "r.*")
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias
    return each.groupBy("rule").agg(
        count(F.col("bits").bitwiseAND(F.col("bit")) != 0)("failed"),
        count(F.col("bits") == F.col("bit"))("failed_alone"),
        count(F.col("bits").bitwiseAND(F.bitwise_not("bit")) == 0)("kept_without"),
    )


def op3_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements, base verdict and verdict of every document."""
    found = judge(ledger(documents(spark, sf_dir)))
    base = F.col("fails").bitwiseAND(F.lit(mask(POLICIES["base"])).cast("long")) != 0
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "fails")


_RULE_BITS = " + ".join(f"CASE WHEN {rule} THEN {1 << i} ELSE 0 END" for i, (_, rule) in enumerate(RULES))

ORACLE = rf"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), places AS (
  SELECT r, words, unnest(range(1, len(words) - 1)) AS p FROM w
), windows AS (
  SELECT r, p, count(*) OVER (PARTITION BY r, words[p], words[p + 1], words[p + 2]) AS n FROM places
), covered AS (
  SELECT r, count(DISTINCT p + k) AS n FROM windows, (VALUES (0), (1), (2)) t(k) WHERE n > 1 GROUP BY r
), m AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, length(regexp_replace(text, '[^A-Z]', '', 'g'))::BIGINT AS n_capitals,
         length(regexp_replace(text, '[^!]', '', 'g'))::BIGINT AS n_exclamations, len(lines)::BIGINT AS n_lines,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN covered USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, ({_RULE_BITS}) = 0 AS kept, ({_RULE_BITS})::BIGINT AS fails
FROM m
"""
