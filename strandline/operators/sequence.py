"""Numbering a person's events in time order, safe for persons of any size.

A plain window sends every row of a person to one task. That is right for almost
everyone and wrong for the one key (often the NULL person) that holds a large part
of the table. Persons above ``hot_rows`` rows therefore take a second route: their
rows are counted per hour, per stamp and per block of each tie-break column in turn,
and each level is summed up front to back, so that window frames hold the hours of
the calendar, the stamps of an hour, the blocks of a stamp or the ids of a block.
Both routes give the same columns for any rows, and all rows are kept.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.dates import day_diff

# Rows of one person that a single task may sort. The list of persons above it has at
# most (table rows / HOT_ROWS) entries: 500,000 for 10^12 rows, a few megabytes.
HOT_ROWS = 2_000_000
TIE_BLOCK = 1_000_000
TIE_PREFIX = 6  # text ids with equal first characters form a block
# The list of large persons is broadcast only where this bounds it by rows / 100,000.
BROADCAST_FROM = 100_000


def _attach(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on all keys, NULL matching NULL, keeping the left side's key columns once."""
    names = {k: f"_key_{i}" for i, k in enumerate(keys)}
    on = F.expr(" AND ".join(f"`{k}` <=> `{r}`" for k, r in names.items()))
    return left.join(right.withColumnsRenamed(names), on, how).drop(*names.values())


def split_hot(df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> tuple[DataFrame, DataFrame]:
    """(rows of ordinary keys, rows of keys with more than ``hot_rows`` rows).

    Counts are combined before the shuffle; the list is bounded by rows / hot_rows and
    broadcast by a hint only from ``BROADCAST_FROM`` on. Rows are marked by an outer join and not filtered by a semi and an
    anti join: those would sink below the caller's own steps, and each route would run
    the steps again instead of reading their shuffle output.
    """
    hot = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > hot_rows)
    large = hot.select(*keys, F.lit(True).alias("_large"))
    marked = _attach(df, F.broadcast(large) if hot_rows >= BROADCAST_FROM else large, keys, "left")
    return marked.filter("_large IS NULL").drop("_large"), marked.filter("_large").drop("_large")


def _over(function: str, parent: Sequence[str], order: Sequence[str], frame: str = "") -> str:
    """Text of a window expression; the default frame takes in rows that tie."""
    by, to = (", ".join(f"`{c}`" for c in cols) for cols in (parent, order))
    return f"{function} OVER (PARTITION BY {by} ORDER BY {to} {frame})"


def _before(n: str, parent: Sequence[str], order: str) -> str:
    """Sum of ``n`` over the earlier siblings under the same parent."""
    return f"coalesce({_over(f'sum({n})', parent, [order], 'ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING')}, 0)"


def _ordinary(df, person, stamp, tie, counted):
    return df.selectExpr(
        "*",
        f"CAST({_over('row_number()', person, [stamp, *tie])} AS BIGINT) AS position",
        f"{_over(f'lag(`{stamp}`)', person, [stamp, *tie])} AS prev_stamp",
    ).selectExpr("*", f"{_over(f'count(`{counted}`)', person, [stamp])} AS ordinal")


def _block(df: DataFrame, column: str) -> str:
    """Text of an expression that rises with a tie-break column and takes far fewer values."""
    kind = df.schema[column].dataType.typeName()
    if kind in ("byte", "short", "integer", "long"):
        return f"floor(`{column}` / {TIE_BLOCK})"
    if kind == "string":
        return f"substr(`{column}`, 1, {TIE_PREFIX})"
    if kind in ("date", "timestamp", "timestamp_ntz"):
        return f"year(`{column}`) * 12 + month(`{column}`)"
    return "0"


def _hot(df, person, stamp, tie, counted):
    cols = [f"`{c}`" for c in df.columns]
    # Whole hours since 1970, from date parts: no detour through the session time zone.
    df = df.selectExpr(
        "*", f"datediff(`{stamp}`, DATE '1970-01-01') * 24 + hour(`{stamp}`) AS _hour",
        *[f"{_block(df, c)} AS _block_{i}" for i, c in enumerate(tie)],
    )
    # hour, stamp, block of the first tie column, its value, block of the second, ...
    steps = ["_hour", stamp]
    for i, c in enumerate(tie):
        steps += [f"_block_{i}", c]
    steps.pop()  # values of the last tie column are numbered inside their block
    keys = [[*person, *steps[: i + 1]] for i in range(len(steps))]

    tables = [df.groupBy(*keys[-1]).agg(F.expr("count(1) AS _n"), F.expr(f"count(`{counted}`) AS _c"))]
    for above in keys[-2::-1]:
        tables.insert(0, tables[0].groupBy(*above).agg(F.expr("sum(_n) AS _n"), F.expr("sum(_c) AS _c")))

    last = tables[1].groupBy(*keys[0]).agg(F.expr(f"max(`{stamp}`) AS _last"))
    places = _attach(tables[0], last, keys[0]).selectExpr(
        *[f"`{k}`" for k in keys[0]],
        f"{_before('_n', person, '_hour')} AS _front",
        f"{_before('_c', person, '_hour')} AS _c_hour",
        f"{_over('lag(_last)', person, ['_hour'])} AS _prev_hour",
    )
    stamps = tables[1].selectExpr(
        *[f"`{k}`" for k in keys[1]],
        f"{_before('_n', keys[0], stamp)} AS _more",
        f"{_before('_c', keys[0], stamp)} + _c AS _c_stamp",
        f"{_over(f'lag(`{stamp}`)', keys[0], [stamp])} AS _prev_in_hour",
    )
    places = _attach(stamps, places, keys[0]).selectExpr(
        *[f"`{k}`" for k in keys[1]], "_front + _more AS _front", "CAST(0 AS BIGINT) AS _inside",
        "_c_hour + _c_stamp AS _ordinal", "coalesce(_prev_in_hour, _prev_hour) AS _prev",
    )
    for i in range(2, len(steps)):
        level = tables[i].selectExpr(*[f"`{k}`" for k in keys[i]], f"{_before('_n', keys[i - 1], steps[i])} AS _more")
        places = _attach(level, places, keys[i - 1]).selectExpr(
            *[f"`{k}`" for k in keys[i]], "_front", "_inside + _more AS _inside", "_ordinal", "_prev"
        )

    df = _attach(df.selectExpr("*", f"{_over('row_number()', keys[-1], [tie[-1]])} AS _local"), places, keys[-1])
    return df.selectExpr(
        *cols,
        "CAST(_front + _inside + _local AS BIGINT) AS position",
        f"CASE WHEN _inside + _local = 1 THEN _prev ELSE `{stamp}` END AS prev_stamp",
        "CAST(_ordinal AS BIGINT) AS ordinal",
    )


def number_events(
    df: DataFrame,
    person: str | Sequence[str],
    stamp: str,
    tie: str | Sequence[str],
    counted: str | None = None,
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Number events within a person by ``stamp``; adds three bigint/stamp columns.

    * ``position``: 1, 2, 3 … by (stamp, tie);
    * ``ordinal``: non-NULL ``counted`` values up to and including this stamp, so
      events sharing a stamp share the last number;
    * ``prev_stamp``: stamp of the row before, NULL on the first.

    ``tie`` columns may be of any type that can be ordered, may be NULL (first) and may
    repeat; which of two equal rows comes first is open. ``hot_rows=None`` skips the size check.
    """
    person = [person] if isinstance(person, str) else list(person)
    tie = [tie] if isinstance(tie, str) else list(tie)
    counted = counted or tie[0]
    if hot_rows is None:
        return _ordinary(df, person, stamp, tie, counted)
    ordinary, hot = split_hot(df, person, hot_rows)
    return _ordinary(ordinary, person, stamp, tie, counted).unionByName(_hot(hot, person, stamp, tie, counted))


def add_gaps(numbered: DataFrame, stamp: str = "call_stamp") -> DataFrame:
    """Prior stamp and days since it; both NULL on rows whose ordinal is 1."""
    repeat = F.col("ordinal") != 1
    return numbered.withColumn("prev_call", F.when(repeat, F.col("prev_stamp"))).withColumn(
        "gap_days", F.when(repeat, day_diff("prev_stamp", stamp))
    )


def add_year_gaps(numbered: DataFrame, stamp: str = "call_stamp") -> DataFrame:
    """Year of the prior event and years since it; both NULL on rows whose ordinal is 1."""
    prev = F.when(F.col("ordinal") != 1, F.year("prev_stamp"))
    return numbered.withColumn("prev_year", prev).withColumn("gap_years", F.year(stamp) - F.col("prev_year"))


def first_events(df: DataFrame, person: str, stamp: str, counted: str) -> DataFrame:
    """One row per person: first stamp, events on it, and all events.

    Two aggregates that combine before their shuffle, so no person needs one task.
    """
    per_stamp = df.groupBy(person, stamp).agg(F.count(counted).alias("n"))
    first = F.min(F.struct(F.col(stamp), F.col("n")))
    return (
        per_stamp.groupBy(person).agg(first.alias("f"), F.sum("n").alias("n_events"))
        .select(person, F.col(f"f.{stamp}").alias("first_stamp"), F.col("f.n").alias("n_first"), "n_events")
    )


def mean_gap(df: DataFrame, person: str, stamp: str, by_person: bool = True) -> DataFrame:
    """Whole-number mean of the days between consecutive events.

    Consecutive gaps add up to last minus first, so one aggregate per person is
    enough and no event has to be put in order.
    """
    spans = df.groupBy(person).agg(
        F.count(F.lit(1)).alias("n_events"), day_diff(F.min(stamp), F.max(stamp)).alias("span_days")
    )
    mean = F.expr("CASE WHEN n_events > 1 THEN CAST(span_days div (n_events - 1) AS INT) END")
    if by_person:
        return spans.select(person, "n_events", mean.alias("mean_gap"))
    return (
        spans.agg(F.sum("span_days").alias("span_days"), F.sum(F.col("n_events") - 1).alias("gaps"))
        .select(F.expr("CASE WHEN gaps > 0 THEN CAST(span_days div gaps AS INT) END").alias("mean_gap"))
    )


# ---- chains of dated intervals ----------------------------------------------------

def collapse_chains(df: DataFrame, keys: Sequence[str], order: str, begins: Column, first: Column, last: Column) -> DataFrame:
    """First and last bound of each chain of rows within ``keys``.

    A chain is named by the ``order`` value of the latest row where one begins, so rows
    that tie fall into one chain in whatever order they arrive. One shuffle by ``keys``
    serves the window and the grouping. Callers pass at most one row per calendar day
    and key, which bounds a group whatever the person's share of the table.
    """
    latest = F.max("_begin").over(Window.partitionBy(*keys).orderBy(order))
    return (
        df.withColumn("_begin", F.when(begins, F.col(order))).withColumn("_chain", latest)
        .filter("_chain IS NOT NULL").groupBy(*keys, "_chain").agg(first.alias("first"), last.alias("last"))
        .drop("_chain")
    )
