"""The condition load from a configuration alone: tables, rules, calendars and target are resolved and checked first.

A configuration names the tables at its top level or in a section per server, holds a section per condition
(``cond_`` in its name) and may declare the target's columns under ``vars``.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.plans.conditions import DX_FIELDS, Calendar, ConditionSpec, multi_condition_run, specs_from_config
from strandline.sources import versions
from strandline.sources.tables import row_cap, source_id_column, table_scan

# Names of the reference tables, the schema they have without a server section, and declared types.
LOOKUP = "dx_lookup"
CALENDAR = "rolling_time_{months}mo_2012_2020"
REF_SCHEMA = "ref"
DECLARED = {"varchar": "string", "nvarchar": "string", "char": "string", "text": "string", "datetime": "timestamp", "datetime2": "timestamp"}


@dataclass(frozen=True)
class ConditionLoad:
    """What a configuration resolves to: full table names, rules, and the target's columns (None: as produced)."""

    person: str
    header: str
    diagnoses: str
    lookup: str
    calendars: Mapping[int, str]
    target: str
    specs: tuple[ConditionSpec, ...]
    columns: Mapping[str, str] | None

    @property
    def produced(self) -> list[str]:
        return [self.person, "from_date", "to_date", "ccw_code", "ccw_desc", "last_run"]


def read_config(spark: SparkSession, path: str) -> dict:
    """A JSON configuration from any file system that Spark reads."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def _spark_type(declared: str) -> str:
    base = declared.strip().lower().split("(")[0].split(" ")[0]
    return DECLARED.get(base, declared.strip().lower().split(" ")[0])


def resolve(config: Mapping, source: str, server: str | None = None, own_names: Mapping[str, str] | None = None) -> ConditionLoad:
    """Resolve a configuration; everything that is missing or contradicts itself is told at once.

    Settings of the section ``server`` are used where there is one; its reference tables may have a
    prefix (``ref_table``). Without a section the target's schema is ``schema`` and the reference
    tables are in ``ref``. The calendar of a look-back is named by its months.
    """
    section = bool(server) and server in config
    settings = config[server] if section else config
    schema_of = {"to": "to_schema" if section else "schema"}
    wrong = [f"{k}_table is missing" for k in ("to", "claim_header_from", "icdcm_from") if not settings.get(f"{k}_table")]

    def table(key: str) -> str:
        schema, name = settings.get(schema_of.get(key, f"{key}_schema")), settings.get(f"{key}_table")
        return f"{schema}.{name}" if schema else str(name)

    ref = settings.get("ref_schema") if section else REF_SCHEMA
    prefix = (f"{ref}." if ref else "") + ((settings.get("ref_table") or "") if section else "")
    for name, c in config.items():
        if "cond_" in name:
            wrong += [f"{name}: {k} is missing" for k in ("ccw_code", "ccw_abbrev", "condition_type", "dx_fields", "lookback_months") if c.get(k) is None]
            wrong += [f"{name}: {k} is {c[k]!r}" for k in ("dx_fields", "dx_exclude1_fields", "dx_exclude2_fields") if c.get(k) is not None and str(c[k]) not in (*DX_FIELDS, "any")]
            if c.get("condition_type") is not None and str(c["condition_type"]) not in ("1", "2"):
                wrong.append(f"{name}: condition_type is {c['condition_type']!r}")
    specs = () if wrong else tuple(specs_from_config(config))
    if not wrong and not specs:
        wrong.append("no section describes a condition")
    if len({s.code for s in specs}) < len(specs):
        wrong.append("two conditions share a code")
    declared = config.get("vars")
    load = ConditionLoad(
        source_id_column(source, own_names), table("claim_header_from"), table("icdcm_from"), prefix + LOOKUP,
        {s.lookback_months: prefix + CALENDAR.format(months=s.lookback_months) for s in specs}, table("to"), specs,
        None if declared is None else {k: _spark_type(v) for k, v in declared.items()},
    )
    if load.columns is not None and set(load.columns) != set(load.produced):
        wrong.append(f"declared columns {sorted(load.columns)} are not {sorted(load.produced)}")
    if wrong:
        raise ValueError("; ".join(wrong))
    return load


def _scan(spark: SparkSession, name: str, columns: list[str], root: str | None) -> DataFrame:
    df = table_scan(spark, name if root is None else name.split(".")[-1], None, root)
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{name} has no column {', '.join(missing)}")
    return df.select(*columns)


def periods_of(spark: SparkSession, load: ConditionLoad, root: str | None = None, rows: int | None = None) -> DataFrame:
    """Periods of every condition of a resolved configuration, in the target's columns, with load time.

    Tables come from the catalog, or from ``root/name.parquet``. ``rows`` caps the diagnoses for a trial run.
    """
    flags = sorted({s.abbrev for s in load.specs} | {c for s in load.specs for c, _ in s.exclusions})
    header = _scan(spark, load.header, [load.person, "claim_header_id", "claim_type_id", "first_service_date"], root)
    diagnoses = _scan(spark, load.diagnoses, ["claim_header_id", "icdcm_norm", "icdcm_version", "icdcm_number"], root)
    lookup = _scan(spark, load.lookup, ["dx", "dx_ver", *flags], root)
    windows = {m: _scan(spark, name, ["start_window", "end_window"], root) for m, name in load.calendars.items()}
    # Every table is known to exist by now; the first job reads a calendar.
    calendars = {}
    for months, table in windows.items():
        calendars[months] = Calendar.of(table)
        if calendars[months].months != months:
            raise ValueError(f"{load.calendars[months]} has windows of {calendars[months].months} months")
    diagnoses = row_cap(diagnoses, ["claim_header_id", "icdcm_number", "icdcm_norm"], rows)
    periods = multi_condition_run(diagnoses, header, lookup, load.specs, calendars, load.person)
    kinds = load.columns or {load.person: header.schema[load.person].dataType.simpleString(), "from_date": "date", "to_date": "date", "ccw_code": "int", "ccw_desc": "string", "last_run": "timestamp"}
    stamped = periods.withColumn("last_run", F.current_timestamp())
    return stamped.select(*[F.col(c).cast(T.DataType.fromDDL(kind)).alias(c) for c, kind in kinds.items()])


def load_conditions(
    spark: SparkSession, config: Mapping | str, source: str, folder: str, server: str | None = None, root: str | None = None,
    own_names: Mapping[str, str] | None = None, rows: int | None = None, load_id: str | None = None,
) -> DataFrame:
    """Rebuild the condition table that a configuration (or the path of one) describes; returns it as read back.

    The result is ``folder/<target table>`` in versions: the former rows stay until the new ones
    are whole, and a ``load_id`` that has been loaded is not loaded again. ``own_names`` gives the
    person id column of combined sources.
    """
    load = resolve(read_config(spark, config) if isinstance(config, str) else config, source, server, own_names)
    return versions.replace(periods_of(spark, load, root, rows), f"{folder.rstrip('/')}/{load.target}", load_id)
