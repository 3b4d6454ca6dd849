"""Registration of queries and of the SQL that checks them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandline.session import tune
from suite.views import VIEWS, Inputs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Named sub-queries the check SQL may select from, besides the views.
PARTS: dict[str, str] = {}

_FROM = re.compile(r"\b(?:FROM|JOIN)\s+(\w+)", re.I)


def part(name: str, sql: str) -> None:
    PARTS[name] = sql


def with_parts(body: str) -> str:
    """Prefix the views and parts a statement selects from, in dependency order."""
    known = VIEWS | PARTS
    order: list[str] = []

    def visit(text: str) -> None:
        for name in _FROM.findall(text):
            if name in known and name not in order:
                visit(known[name])
                order.append(name)

    visit(body)
    if not order:
        return body.strip()
    ctes = ",\n".join(f"{n} AS ({known[n].strip()})" for n in order)
    body = body.strip()
    return f"WITH {ctes},\n{body[5:]}" if body.upper().startswith("WITH ") else f"WITH {ctes}\n{body}"


def query(slug: str, sql: str | None = None):
    """Register ``fn(inputs) -> DataFrame`` under a slug, with its check SQL."""

    def register(fn: Callable[[Inputs], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Inputs(tune(spark), sf_dir))

        if slug in QUERIES:
            raise ValueError(f"{slug} is registered twice")
        run.__name__, run.__doc__ = slug, fn.__doc__
        QUERIES[slug] = run
        if sql is not None:
            ORACLES[slug] = sql
        return fn

    return register


def oracle_sql() -> dict[str, str]:
    return {slug: with_parts(sql) for slug, sql in ORACLES.items()}
