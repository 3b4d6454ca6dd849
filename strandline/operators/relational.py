"""Joins, groupings, set operations and reshapes with the semantics the cohort jobs need.

No join here carries a broadcast hint on a data-dependent side. Code tables and
cohorts are broadcast by Spark when their measured size is under
``spark.sql.autoBroadcastJoinThreshold`` (re-checked at run time by adaptive
execution) and shuffled, with skewed partitions split, when it is not.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.dates import as_date, month_index


# ---- joins ------------------------------------------------------------------------

def in_keys(df: DataFrame, key: str, *lists: tuple[DataFrame, str]) -> DataFrame:
    """Rows whose key occurs in any of the lists (one semi join for all lists).

    The lists are reduced to distinct keys on the partitioning the join needs anyway,
    so a key that fills a list is sent once per input task.
    """
    keys = reduce(DataFrame.union, [d.select(F.col(c).alias("_k")) for d, c in lists])
    return df.join(keys.distinct(), F.col(key) == F.col("_k"), "left_semi")


def not_in_keys(df: DataFrame, key: str, other: DataFrame, other_key: str) -> DataFrame:
    """Rows whose key has no partner (rows with a NULL key stay)."""
    keys = other.select(F.col(other_key).alias("_k")).distinct()
    return df.join(keys, F.col(key) == F.col("_k"), "left_anti")


def code_rows(codes: DataFrame, names: Sequence[str], system: str | None = None, version: str | None = None) -> DataFrame:
    """Codes of some value sets, as one ``code`` column plus the set name."""
    out = codes.filter(F.col("value_set_name").isin(*names))
    if system is not None:
        out = out.filter(F.col("code_system") == system)
    if version is not None:
        out = out.filter(F.col("version") == version)
    return out.select("code", "value_set_name")


CODE_LIST = 2_000  # codes that a filter may hold


def listed_codes(codes: DataFrame, by: Sequence[str] = (), column: str = "code", most: int = CODE_LIST) -> dict[tuple, list] | None:
    """The distinct codes under each value of ``by``, from one read of the code table; None if they are more than ``most`` in all.

    At most ``most`` + 1 rows reach the driver, whatever the size of the table. Missing codes match nothing and are left out.
    """
    rows = codes.where(F.col(column).isNotNull()).select(*by, column).distinct().limit(most + 1).collect()
    if len(rows) > most:
        return None
    out: dict[tuple, list] = {}
    for *key, code in rows:
        out.setdefault(tuple(key), []).append(code)
    return {key: sorted(found) for key, found in out.items()}


def at_scan(df: DataFrame, column: str, values: Sequence | None) -> DataFrame:
    """Rows whose value is in a list, as a filter that reaches the file reader; all rows where there is no list."""
    if values is None:
        return df
    return df.where(F.col(column).isin(*values) if values else F.lit(False))


def with_code_in(df: DataFrame, column: str, codes: DataFrame, most: int = CODE_LIST) -> DataFrame:
    """Rows whose code is listed; a code listed twice does not repeat the row.

    Up to ``most`` codes of the column's type are a filter at the scan; more are a semi join.
    """
    if df.schema[column].dataType == codes.schema["code"].dataType:
        lists = listed_codes(codes, most=most)
        if lists is not None:
            return at_scan(df, column, lists.get((), []))
    return df.join(codes.select(F.col("code").alias("_k")), F.col(column) == F.col("_k"), "left_semi")


def with_code_columns(df: DataFrame, column: str, codes: DataFrame, most: int = CODE_LIST) -> DataFrame:
    """Rows joined to their entries in ``codes`` (code and further columns), repeated once an entry.

    Up to ``most`` different codes of the column's type are a filter at the scan before the join.
    """
    if df.schema[column].dataType == codes.schema["code"].dataType:
        lists = listed_codes(codes, most=most)
        df = at_scan(df, column, None if lists is None else lists.get((), []))
    return df.join(codes.withColumnRenamed("code", column), column)


def left_join_in_range(df: DataFrame, other: DataFrame, key: str, in_range: Column) -> DataFrame:
    """Left join with a range test inside the join: rows without a partner in range stay,
    with NULLs on the other side."""
    return df.join(other.filter(in_range), key, "left")


HEAVY_ROWS = 2_000_000  # rows of one key that a task may join


def heavy_keys(df: DataFrame, key: str, rows: int = HEAVY_ROWS) -> list[tuple]:
    """Keys with more than ``rows`` rows and the number of parts of that size they fill.

    One counted pass, combined before its shuffle. At most (all rows / ``rows``) keys reach the driver.
    """
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > rows)
    return [(r[0], -(-r[1] // rows)) for r in counts.collect()]


def left_join_many(df: DataFrame, other: DataFrame, key: str, rows: int = HEAVY_ROWS) -> DataFrame:
    """Left join to a side on which one key may hold a large part of all rows.

    Spark splits a skewed left side of a left join, but never the right one. Right rows of a
    heavy key are therefore dealt to parts by a hash of the row, and left rows of these keys
    alone are repeated, once a part. Both sides are read once; without a heavy key this is a plain left join.
    """
    heavy = heavy_keys(other, key, rows)
    if not heavy:
        return df.join(other, key, "left")
    kind = other.schema[key].dataType.simpleString()
    # The list is bounded by the rows of ``other`` / ``rows``.
    listed = F.broadcast(df.sparkSession.createDataFrame(heavy, f"`{key}` {kind}, _parts long"))
    left = df.join(listed, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("_parts") - 1, F.lit(0)))))
    own = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in other.columns]), F.coalesce(F.col("_parts"), F.lit(1)))
    right = other.join(listed, key, "left").withColumn("_part", own).drop("_parts").withColumn("_found", F.lit(True))
    joined = left.join(right, [key, "_part"], "left")
    # A heavy key has partners: a repeat that met an empty part is no row without a partner.
    return joined.where("_parts IS NULL OR _found").drop("_part", "_parts", "_found")


def window_pairs(df: DataFrame, windows: DataFrame, on: str) -> DataFrame:
    """Every (row, calendar window) pair whose window contains the date ``on``.

    Works for any calendar. Windows are listed once per month they touch, so the
    join is on the month number instead of a comparison with every window.
    """
    by_month = windows.select(
        "*", F.explode(F.sequence(month_index("start_window"), month_index("end_window"))).alias("_month")
    )
    return (
        df.withColumn("_month", month_index(on)).join(by_month, "_month")
        .filter(F.col(on).between(F.col("start_window"), F.col("end_window")))
        .drop("_month")
    )


# ---- groupings --------------------------------------------------------------------

def distinct_with_null(c: str) -> Column:
    """Distinct values, counting a missing value as one."""
    return F.countDistinct(c) + F.max(F.col(c).isNull().cast("bigint"))


def whole_mean(c: str) -> Column:
    """Mean of whole numbers, cut to a whole number."""
    return F.expr(f"CASE WHEN count({c}) > 0 THEN CAST(sum({c}) div count({c}) AS INT) END")


def null_profile(df: DataFrame, column: str, counted: str) -> DataFrame:
    """Distinct ``counted`` values where ``column`` is missing (1) and present (0)."""
    return df.groupBy(F.col(column).isNull().cast("int").alias("is_missing")).agg(F.countDistinct(counted).alias("cnt"))


def count_chain(df: DataFrame, by: Sequence[Column | str], counts: Mapping[str, Column | None]) -> DataFrame:
    """Row counts of several conditions side by side per group, for groups in which the first is met.

    The counts of a chain of summaries, each left-joined to the first: one grouping gives them
    all. A condition that a group does not meet is NULL; None counts every row.
    """
    def rows(condition: Column | None) -> Column:
        return F.count(F.lit(1)) if condition is None else F.nullif(F.count_if(condition), F.lit(0))

    first = next(iter(counts))
    return df.groupBy(*by).agg(*[rows(c).alias(name) for name, c in counts.items()]).where(F.col(first).isNotNull())


def subset_share(df: DataFrame, by: Sequence[str], counted: str, subset: Column) -> DataFrame:
    """Subset count next to the total count per group, for groups the subset reaches."""
    return (
        df.groupBy(*by)
        .agg(
            F.count(F.when(subset, F.col(counted))).alias("subset_count"),
            F.count(counted).alias("total_count"),
            F.count(F.when(subset, 1)).alias("_reached"),
        )
        .filter("_reached > 0").drop("_reached")
    )


def level_counts(df: DataFrame, levels: Mapping[str, Sequence[str]], person: str, total: Column, names: tuple[str, str]) -> DataFrame:
    """A total and the distinct persons of every group of every level, as rows (level, columns of all levels, ``names``).

    ``levels`` maps a level's name to the columns it groups by; columns it lacks are NULL. The rows of a
    person are shuffled once for all levels: combined to the set of the finest groups the person is in, which
    the levels' groups are taken from. These sets are bounded by the number of groups, not by rows. A missing
    person counts in the total only; an empty table gives no row. No column may be named ``level``.
    """
    finest = list(dict.fromkeys(c for columns in levels.values() for c in columns))

    def groups(value: Column) -> Column:
        def column(level: str, c: str) -> Column:
            return (value[c] if c in levels[level] else F.lit(None).cast(df.schema[c].dataType)).alias(c)

        return F.array(*[F.struct(F.lit(level).alias("level"), *[column(level, c) for c in finest]) for level in levels])

    sets = df.groupBy(person).agg(F.collect_set(F.struct(*finest)).alias("_in"))
    reached = F.explode(F.array_distinct(F.flatten(F.transform("_in", groups)))).alias("_group")
    persons = sets.select(reached, F.lit(None).alias("_total"), F.col(person).isNotNull().cast("bigint").alias("_person"))
    totals = df.groupBy(*finest).agg(F.sum(total).alias("_total"))
    totals = totals.select(F.explode(groups(F.struct(*finest))).alias("_group"), "_total", F.lit(0).cast("bigint").alias("_person"))
    counted = totals.unionByName(persons).groupBy("_group").agg(F.sum("_total").alias(names[0]), F.sum("_person").alias(names[1]))
    return counted.select("_group.*", *names)


def pivot_ranks(df: DataFrame, by: str, rank: str, value: str, ranks: Sequence[int], prefix: str) -> DataFrame:
    """One column per listed rank holding the largest value at that rank."""
    wide = df.groupBy(by).pivot(rank, list(ranks)).agg(F.max(value))
    return wide.select(by, *[F.col(f"`{r}`").alias(f"{prefix}{r}") for r in ranks])


def spread(df: DataFrame, by: Sequence[str], name: str, value: str, names: Sequence, only_listed: bool = False) -> DataFrame:
    """Long to wide on listed names. Two rows for one cell are an error, as the cell
    could hold only one of them; so is a name that isn't listed, unless ``only_listed``
    says that the others are not wanted."""
    listed = F.coalesce(F.col(name).isin(list(names)), F.lit(False))
    if only_listed:
        df = df.where(listed)
    n = F.count(F.lit(1)).alias("_n")
    cells = df.groupBy(*by, name).agg(n, F.first(value).alias("_v"))
    message = F.concat(F.lit(f"more than one {value} for {name} "), F.col(name).cast("string"))
    unlisted = F.concat(F.lit(f"{name} is not listed: "), F.coalesce(F.col(name).cast("string"), F.lit("NULL")))
    checked = F.when(~listed, F.raise_error(unlisted)).when(F.col("_n") == 1, F.col("_v")).otherwise(F.raise_error(message))
    # Numeric cells: a cell is present once, so max() returns it unchanged.
    return cells.withColumn("_v", checked).groupBy(*by).pivot(name, list(names)).agg(F.max("_v"))


def arg_max(df: DataFrame, by: str, columns: Sequence[str], label: str, value: str) -> DataFrame:
    """Per key, the first column (in list order) that reaches the largest value.

    Keys whose values are all missing give no row.
    """
    position = F.create_map(*[x for i, c in enumerate(columns) for x in (F.lit(c), F.lit(-i))])
    return (
        df.unpivot([by], list(columns), label, value).filter(F.col(value).isNotNull())
        .groupBy(by)
        .agg(F.max(F.struct(F.col(value), position[F.col(label)].alias("_p"), F.col(label))).alias("_m"))
        .select(by, F.col(f"_m.{label}").alias(label), F.col(f"_m.{value}").alias(value))
    )


def first_ranks(df: DataFrame, by: str, order: Sequence[str], keep: int, rank: str = "row_num") -> DataFrame:
    """The first ``keep`` rows per key. Spark drops later rows before the shuffle
    already, so a key of any size sends at most ``keep`` rows per input task."""
    w = Window.partitionBy(by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= keep)


# ---- order and set operations -----------------------------------------------------

def top_rows(df: DataFrame, order: Sequence[str | Column], n: int) -> DataFrame:
    """First n rows in a stated order (each task keeps n rows; nothing is sorted whole)."""
    return df.orderBy(*order).limit(n)


def _by_side(first: DataFrame, second: DataFrame) -> DataFrame:
    """Each distinct row of the two sides once (columns matched by position, NULL equal to
    NULL) with a flag per side. One grouping: equal rows are combined before the shuffle."""
    sides = first.selectExpr("*", "1 AS _first", "0 AS _second").union(second.selectExpr("*", "0", "1"))
    return sides.groupBy(*first.columns).agg(F.max("_first").alias("_first"), F.max("_second").alias("_second"))


def rows_in_both(first: DataFrame, second: DataFrame) -> DataFrame:
    """Distinct rows found on both sides."""
    return _by_side(first, second).filter("_first = 1 AND _second = 1").drop("_first", "_second")


def rows_only_in_first(first: DataFrame, second: DataFrame) -> DataFrame:
    """Distinct rows of the first side that the second does not hold."""
    return _by_side(first, second).filter("_first = 1 AND _second = 0").drop("_first", "_second")


def stack_by_name(*frames: DataFrame) -> DataFrame:
    """All rows of all frames; a column absent from a frame is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def conditional_cap(df: DataFrame, column: str, cutoff, cap, flag_name: str) -> DataFrame:
    """Flag values at or after the cutoff (or missing), then replace them by the cap."""
    open_end = (F.col(column) >= as_date(cutoff)) | F.col(column).isNull()
    return df.withColumn(flag_name, F.when(open_end, 1).otherwise(0)).withColumn(
        column, F.when(F.col(flag_name) == 1, as_date(cap)).otherwise(F.col(column))
    )
