"""Compare a Spark result with a DuckDB result: columns, types and rows regardless of order."""

from __future__ import annotations

from collections import Counter

# Names under which both engines describe the same type.
SPARK_TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
               "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN"}


def duck(sf_dir: str):
    import duckdb

    from suite.views import RAW

    con = duckdb.connect()
    for name in RAW:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def differences(df, con, sql: str) -> list[str]:
    """What differs, empty if nothing does. Doubles are compared to 9 significant digits."""
    expected = con.sql(sql)
    types = dict(zip(expected.columns, map(str, expected.types)))
    mine = {f.name: SPARK_TYPES.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema}
    out = []
    if mine != types:
        out.append(f"types: {sorted(mine.items() ^ types.items())}")
    if set(mine) != set(types):
        return out
    names = sorted(mine)

    def plain(v):
        return float(f"{v:.9g}") if isinstance(v, float) else v

    at = [expected.columns.index(n) for n in names]
    want = Counter(tuple(plain(r[i]) for i in at) for r in expected.fetchall())
    got = Counter(tuple(plain(r[n]) for n in names) for r in df.select(*names).collect())
    if got != want:
        only_got, only_want = got - want, want - got
        out.append(
            f"rows: {sum(got.values())} against {sum(want.values())}; only in Spark {sum(only_got.values())} "
            f"{list(only_got)[:3]}; only in SQL {sum(only_want.values())} {list(only_want)[:3]}"
        )
    if not want:
        out.append("empty result")
    return out
