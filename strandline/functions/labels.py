"""Flags, code labels and row-wise expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandline.functions.dates import as_date, day_diff


def yes_flag(c: str | Column, yes: str = "Y") -> Column:
    """1 where the text equals ``yes``, else 0 (missing counts as 0)."""
    c = F.col(c) if isinstance(c, str) else c
    return flag(c == yes)


def flag(condition: Column) -> Column:
    """1 where the condition is true, 0 where it is false or unknown."""
    return F.when(condition, 1).otherwise(0)


def relabel(c: str | Column, labels: Mapping[str, str], other: str | Column | None = None) -> Column:
    """Map codes to labels; codes outside the map become ``other`` (NULL by default)."""
    c = F.col(c) if isinstance(c, str) else c
    out = reduce(lambda acc, kv: acc.when(c == kv[0], kv[1]), labels.items(), F)
    return out if other is None else out.otherwise(other)


def count_bucket(c: str | Column) -> Column:
    """Text group of a repeat count."""
    c = F.col(c) if isinstance(c, str) else c
    return (
        F.when(c == 2, "two").when(c == 3, "three").when(c.isin(4, 5), "four-five")
        .when(c > 5, "more than 5").otherwise("whut")
    )


def facility_type(agency: str | Column, codes: Sequence[str], inside: str = "ET", outside: str = "OTHER") -> Column:
    """``inside`` for agencies in the code list, else ``outside``."""
    agency = F.col(agency) if isinstance(agency, str) else agency
    return F.when(agency.isin(*codes), inside).otherwise(outside)


def row_sum(columns: Sequence[str]) -> Column:
    """Sum over the columns of one row; NULL as soon as one of them is NULL."""
    return F.expr(" + ".join(f"`{c}`" for c in columns))


def ratio(top: str, bottom: str) -> Column:
    """top / bottom, NULL for a zero or missing bottom."""
    return F.try_divide(F.col(top), F.col(bottom))


def first_max_label(columns: Sequence[str]) -> Column:
    """Name of the first column, in the order given, that holds the row's maximum.

    NULLs are skipped; a row of NULLs only gives NULL.
    """
    listed = ", ".join(f"`{c}`" for c in columns)
    names = ", ".join(f"'{c}'" for c in columns)
    position = f"CAST(array_position(array({listed}), greatest({listed})) AS INT)"
    # Rows of NULLs are told apart first: generated code takes the position as never NULL.
    return F.expr(f"CASE WHEN coalesce({listed}) IS NOT NULL THEN element_at(array({names}), {position}) END")


# ---- predicates -----------------------------------------------------------------

def in_closed_range(c: str, start, end) -> Column:
    return F.col(c).between(as_date(start), as_date(end))


def stamp_in_range(c: str, start, end) -> Column:
    """Stamp range whose end is a date: the end day counts only at 00:00."""
    out = F.col(c) <= as_date(end)
    return out if start is None else (F.col(c) >= as_date(start)) & out


def either_in_period(first: str, second: str, start, end) -> Column:
    return in_closed_range(first, start, end) | in_closed_range(second, start, end)


def fallback_in_range(main: str, fallback: str, start, end) -> Column:
    """``main`` in range, or ``fallback`` in range where ``main`` is missing."""
    return in_closed_range(main, start, end) | (F.col(main).isNull() & in_closed_range(fallback, start, end))


def lasted_or_open(start: str, end: str, days: int) -> Column:
    """At least ``days`` days long, or without an end."""
    return (day_diff(start, end) >= days) | F.col(end).isNull()
