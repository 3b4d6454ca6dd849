"""Turning dated diagnoses and prescriptions into periods during which a person has a condition.

A calendar of equal windows on a monthly step never has to be joined: the windows
that contain a date are the consecutive numbers from (month - length + 1) to month.
Events become such number ranges, one per person, condition and month or day, and
ranges that touch are merged. Groups are reduced to calendar steps with partial
aggregation before anything is ordered, so the largest group a task orders is one
row per day of the calendar, whatever share of the claims a person holds.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.dates import add_months, as_date, month_diff, month_index, spans_days
from strandline.functions.labels import flag, in_closed_range, relabel
from strandline.operators import bitmaps
from strandline.operators.relational import CODE_LIST, at_scan, listed_codes, not_in_keys, window_pairs
from strandline.operators.sequence import collapse_chains
from strandline.sources import versions

# Value sets, small groups folded together, and the condition a drug group points to.
DIAGNOSIS_SETS = ["MI-Diagnosis", "SUD-Dx-Value-Set"]
SUBSTANCE_SET = "SUD-Dx-Value-Set"
PHARMACY_SET = "Psychotropic-NDC"
SMALL_GROUPS = ["NA", "Hallucinogen", "Inhalant"]
DRUG_CONDITIONS = {
    "ADHD Rx": "ADHD",
    "Antianxiety Rx": "Anxiety",
    "Antidepressants Rx": "Depression",
    "Antimania Rx": "Mania/Bipolar",
    "Antipsychotic Rx": "Psychotic",
}
KEYS = ["id_mcaid", "bh_cond"]


@dataclass(frozen=True)
class Calendar:
    """``n`` windows of ``months`` months; window k starts k months after ``first``.

    ``first`` is the first of a month; windows end on the last day of a month. The
    three may also be columns, for calendars that differ from row to row.
    """

    first: str | Column
    n: int | Column
    months: int | Column = 24
    # Where ``n`` and ``months`` are columns: bounds of the months covered and of a window's length.
    most_months: int | None = None
    longest_window: int | None = None

    @classmethod
    def of(cls, windows: DataFrame) -> Calendar:
        """Read a calendar table (one small aggregate row) and check that it is regular."""
        row = windows.agg(
            F.min("start_window").alias("first"),
            F.countDistinct("start_window").alias("n"),
            F.count(F.lit(1)).alias("n_rows"),
            (F.max(month_index("start_window")) - F.min(month_index("start_window")) + 1).alias("steps"),
            F.min(month_index("end_window") - month_index("start_window") + 1).alias("shortest"),
            F.max(month_index("end_window") - month_index("start_window") + 1).alias("longest"),
            F.bool_and(
                (F.dayofmonth("start_window") == 1) & (F.last_day("end_window") == F.col("end_window"))
            ).alias("whole_months"),
        ).first()
        if not (row.n == row.n_rows == row.steps and row.shortest == row.longest and row.whole_months):
            raise ValueError("not equal windows on a monthly step: use window_pairs for this calendar")
        return cls(str(row["first"]), row.n, row.shortest)

    @property
    def span(self) -> int:
        """Months from the first window's first to the last window's last, at most."""
        return self.most_months or self.n + self.months - 1

    @property
    def longest(self) -> int:
        return self.longest_window or self.months

    @property
    def reach(self) -> int | Column:
        """Months in which a window goes beyond its first."""
        return self.months - 1

    def month(self, on: str | Column) -> Column:
        """Month number of a date, 0 for the first window's first month."""
        return month_diff(as_date(self.first), on)

    def covers(self, on: str) -> Column:
        """True where at least one window contains the date (a plain range of dates,
        which reaches the file scan)."""
        return F.col(on).between(as_date(self.first), self.end(F.lit(self.n - 1)))

    def lowest(self, month: Column) -> Column:
        return F.greatest(month - (self.months - 1), F.lit(0))

    def highest(self, month: Column) -> Column:
        return F.least(month, F.lit(self.n - 1))

    def start(self, k: Column) -> Column:
        return F.add_months(as_date(self.first), k)

    def end(self, k: Column) -> Column:
        return F.last_day(F.add_months(as_date(self.first), k + (self.months - 1)))

    def last_day_of(self, month: Column) -> Column:
        return F.last_day(self.start(month))

    def bounds(self, k: Column) -> list[Column]:
        """Start and end of window k."""
        return [self.start(k).alias("start_window"), self.end(k).alias("end_window")]

    def explode(self, low: Column, high: Column, columns: Sequence[str], df: DataFrame) -> DataFrame:
        """One row per window number from low to high, with the window's bounds."""
        return df.select(*columns, F.explode(F.sequence(low, high)).alias("_k")).select(
            *columns, *self.bounds(F.col("_k"))
        )


# ---- events -----------------------------------------------------------------------

def _condition_of_set() -> Column:
    folded = (F.col("value_set_name") == SUBSTANCE_SET) & F.col("sub_group").isin(*SMALL_GROUPS)
    return F.when(folded, "Other Substance").otherwise(F.col("sub_group"))


def _listed(value_set: DataFrame, most: int = CODE_LIST) -> dict[str, list] | None:
    """Codes of diagnoses and of prescriptions, both from one read of the table; None if there are very many."""
    kind = F.when(F.col("value_set_name") == PHARMACY_SET, "rx").otherwise("dx").alias("_kind")
    wanted = value_set.filter(F.col("value_set_name").isin(*DIAGNOSIS_SETS, PHARMACY_SET))
    lists = listed_codes(wanted.select(kind, "code"), ["_kind"], most=most)
    return None if lists is None else {k: lists.get((k,), []) for k in ("dx", "rx")}


def _at_scan(df: DataFrame, column: str, value_set: DataFrame, values: list | None) -> DataFrame:
    """The list as a filter where the column has the type of the codes; the join that follows decides."""
    return at_scan(df, column, values) if df.schema[column].dataType == value_set.schema["code"].dataType else df


def _by_diagnosis(claim_dx, value_set, lists=None):
    claim_dx = _at_scan(claim_dx, "icdcm_norm", value_set, lists and lists["dx"])
    codes = value_set.filter(F.col("value_set_name").isin(*DIAGNOSIS_SETS)).select(
        F.col("code").alias("icdcm_norm"), _condition_of_set().alias("bh_cond")
    )
    return claim_dx.select("id_mcaid", F.col("first_service_date").alias("svc_date"), "icdcm_norm").join(
        codes, "icdcm_norm"
    ).select("id_mcaid", "svc_date", "bh_cond")


def _by_pharmacy(claim_pharm, value_set, lists=None):
    claim_pharm = _at_scan(claim_pharm, "ndc", value_set, lists and lists["rx"])
    codes = value_set.filter(F.col("value_set_name") == PHARMACY_SET).select(
        F.col("code").alias("ndc"), relabel("sub_group", DRUG_CONDITIONS).alias("bh_cond")
    )
    return claim_pharm.select("id_mcaid", F.col("rx_fill_date").alias("svc_date"), "ndc").join(codes, "ndc").select(
        "id_mcaid", "svc_date", "bh_cond"
    )


def conditions_from_diagnosis(claim_dx: DataFrame, value_set: DataFrame) -> DataFrame:
    """Distinct (person, date, condition) of diagnoses in the value sets."""
    return _by_diagnosis(claim_dx, value_set, _listed(value_set)).distinct()


def conditions_from_pharmacy(claim_pharm: DataFrame, value_set: DataFrame) -> DataFrame:
    """Distinct (person, date, condition) of prescriptions in the value set."""
    return _by_pharmacy(claim_pharm, value_set, _listed(value_set)).distinct()


def condition_events(claim_dx: DataFrame, claim_pharm: DataFrame, value_set: DataFrame) -> DataFrame:
    """Both kinds of events, each once."""
    lists = _listed(value_set)
    return _by_diagnosis(claim_dx, value_set, lists).union(_by_pharmacy(claim_pharm, value_set, lists)).distinct()


def condition_person_table(claim_dx: DataFrame, claim_pharm: DataFrame, value_set: DataFrame, start, end) -> DataFrame:
    """Person and condition pairs found in a period, with its bounds."""
    lists = _listed(value_set)
    dx = _by_diagnosis(claim_dx.filter(in_closed_range("first_service_date", start, end)), value_set, lists)
    rx = _by_pharmacy(claim_pharm.filter(in_closed_range("rx_fill_date", start, end)), value_set, lists)
    return dx.union(rx).select("id_mcaid", F.col("bh_cond").alias("indicator")).distinct().select(
        "*", as_date(start).alias("from_date"), as_date(end).alias("to_date")
    )


def condition_counts(person_table: DataFrame) -> DataFrame:
    """Persons per condition."""
    return person_table.groupBy("indicator").agg(F.count("id_mcaid").alias("cnt"))


# ---- periods opened by each event -------------------------------------------------

def _days(events: DataFrame, months: int) -> DataFrame:
    """Each distinct event with the one before and the one after it, in two levels.

    The days of a key are dealt to blocks of the calendar; in a block they are bits, joined by OR
    before the shuffle, so that repeats never travel and a key is split over tasks. Blocks are then
    stitched by their last and first day: what is put in order is a row per block.
    """
    day = F.datediff("svc_date", F.lit("1970-01-01").cast("date"))
    block = F.floor(day / bitmaps.WORD)
    blocks = events.select(*KEYS, block.alias("_block"), (day - block * bitmaps.WORD).alias("_d")).groupBy(*KEYS, "_block").agg(
        F.coalesce(bitmaps.union_of(F.col("_d"), 1)[0], F.lit(0).cast("long")).alias("_bits")
    )
    date_of = lambda d: F.date_add(F.lit("1970-01-01").cast("date"), (F.col("_block") * bitmaps.WORD).cast("int") + d)
    dated = blocks.select(*KEYS, "_block", F.transform(bitmaps.places([F.col("_bits")]), date_of).alias("_dates"))
    w = Window.partitionBy(*KEYS).orderBy("_block")
    first, last = F.get("_dates", F.lit(0)), F.get("_dates", F.size("_dates") - 1)
    stitched = dated.withColumn("_prior", F.lag(last).over(w)).withColumn("_next", F.lead(first).over(w))
    # An event without a date has a block without days: it stays, as one row.
    at = stitched.select(*KEYS, "_dates", "_prior", "_next", F.posexplode_outer("_dates").alias("_i", "svc_date"))
    return at.select(
        *KEYS, "svc_date", add_months("svc_date", months).alias("end_window"),
        F.coalesce(F.get("_dates", F.col("_i") - 1), "_prior").alias("_prior"), F.coalesce(F.get("_dates", F.col("_i") + 1), "_next").alias("_next"),
    )


def next_dates(events: DataFrame) -> DataFrame:
    """Distinct events with the date of the next one of the person and condition, for keys of any size."""
    return _days(events, 0).select(*KEYS, "svc_date", F.col("_next").alias("next_date"))


def overlap_flag(events: DataFrame, months: int = 24) -> DataFrame:
    """Events with the window they open and 1 where the window before is still open.

    An event given more than once counts once.
    """
    still_open = add_months("_prior", months) >= F.col("svc_date")
    return _days(events, months).select(*KEYS, "svc_date", "end_window", flag(still_open).alias("cont"))


def forward_window_periods(events: DataFrame, months: int = 24) -> DataFrame:
    """Each event opens a window; overlapping windows form one period.

    Events in one stretch of ``months`` calendar months always belong together, so a key's
    stretch is its first and last day, reduced before the shuffle; stretches are then chained.
    """
    stretch = F.expr(f"_month div {months}") if months > 0 else F.col("svc_date")
    blocks = events.select(*KEYS, "svc_date", month_index("svc_date").alias("_month")).groupBy(*KEYS, stretch.alias("_stretch")).agg(
        F.min("svc_date").alias("_first"), F.max("svc_date").alias("_last")
    )
    before = F.lag("_last").over(Window.partitionBy(*KEYS).orderBy("_first"))
    rows = blocks.withColumn("_begins", F.coalesce(add_months(before, months) < F.col("_first"), F.lit(True)))
    chains = collapse_chains(rows, KEYS, "_first", F.col("_begins"), F.min("_first"), F.max("_last"))
    return chains.select(*KEYS, F.col("first").alias("from_date"), add_months("last", months).alias("to_date"))


def boundary_event_rows(events: DataFrame, months: int = 24) -> DataFrame:
    """Only the events that begin or end a period, with the bound they set."""
    cont = flag(add_months("_prior", months) >= F.col("svc_date"))
    last = F.coalesce(F.col("end_window") < F.col("_next"), F.lit(True))
    return _days(events, months).withColumn("cont", cont).filter((F.col("cont") == 0) | last).select(
        *KEYS, "svc_date", "end_window", "cont",
        F.when(F.col("cont") == 0, F.col("svc_date")).alias("start_window"),
        F.when(F.col("cont") == 1, F.col("end_window")).alias("new_end_window"),
    )


# ---- periods over a calendar of windows -------------------------------------------

def window_matrix(events: DataFrame, calendar: Calendar) -> DataFrame:
    """Each event with every calendar window that contains it."""
    month = calendar.month("svc_date")
    rows = events.filter(calendar.covers("svc_date"))
    return calendar.explode(calendar.lowest(month), calendar.highest(month), [*KEYS, "svc_date"], rows)


WINDOW_LIST = 500  # windows of a table that are numbered and marked by bits


def _months_with_events(events: DataFrame, calendar: Calendar, keys: Sequence[str]) -> DataFrame:
    """The months of a key's events as bits, joined by OR before the shuffle: a key is one row a task."""
    words = bitmaps.words_for(calendar.span)
    rows = events.filter(calendar.covers("svc_date")).select(*keys, calendar.month("svc_date").alias("_m"))
    return rows.groupBy(*keys).agg(*[w.alias(c) for w, c in zip(bitmaps.union_of(F.col("_m"), words), bitmaps.columns("_w", words))])


def _windows_of_calendar(events: DataFrame, calendar: Calendar, keys: Sequence[str]) -> DataFrame:
    words = bitmaps.words_for(calendar.span)
    sets = bitmaps.spread(_months_with_events(events, calendar, keys), "_w", words, calendar.reach, calendar.longest - 1, up=False)
    runs = bitmaps.runs(bitmaps.below(bitmaps.get("_w", words), calendar.n))
    numbers = F.flatten(F.transform(runs, lambda r: F.sequence(r["first"], r["last"])))
    return sets.select(*keys, F.transform(numbers, lambda k: F.struct(*calendar.bounds(k))).alias("windows"))


def _windows_of_table(events: DataFrame, windows: DataFrame, keys: Sequence[str], most: int) -> DataFrame:
    """As for a calendar, with bits for the stretches between the bounds of all windows; a window is a mask.

    At most ``most`` + 1 windows reach the driver. Of more windows than that, a key's are collected.
    """
    windows = windows.select("start_window", "end_window").where("start_window <= end_window")
    dates = all(kind == "date" for _, kind in windows.dtypes)
    listed = sorted(tuple(r) for r in windows.distinct().limit(most + 1).collect()) if dates else []
    if not dates or len(listed) > most:
        days = events.select(*keys, "svc_date").distinct()
        found = F.sort_array(F.collect_set(F.struct("start_window", "end_window")))
        return window_pairs(days, windows, "svc_date").groupBy(*keys).agg(found.alias("windows"))
    spans = [(first.toordinal(), last.toordinal() + 1) for first, last in listed]
    points = sorted({p for span in spans for p in span})
    number = {p: i for i, p in enumerate(points)}
    words = bitmaps.words_for(max(len(points) - 1, 1))
    day = lambda n: f"DATE '{date.fromordinal(n)}'"
    rows = [f"({day(a)}, {day(b - 1)}, {i})" for i, (a, b) in enumerate(zip(points, points[1:]))] or ["(NULL, NULL, 0)"]
    stretches = events.sparkSession.sql(f"SELECT CAST(a AS DATE) AS start_window, CAST(b AS DATE) AS end_window, _m FROM VALUES {', '.join(rows)} AS t(a, b, _m)")
    marked = window_pairs(events.select(*keys, "svc_date"), stretches, "svc_date").groupBy(*keys).agg(
        *[w.alias(c) for w, c in zip(bitmaps.union_of(F.col("_m"), words), bitmaps.columns("_w", words))]
    )

    def masks(a: int, b: int) -> list[Column]:
        bits = (1 << number[b]) - (1 << number[a])
        return [F.lit(bits >> bitmaps.WORD * i & bitmaps.FULL).cast("long").alias(f"_w{i}") for i in range(words)]

    if not listed:
        return marked.select(*keys, F.array().cast("array<struct<start_window:date,end_window:date>>").alias("windows")).where(F.lit(False))
    known = F.array(*[F.struct(F.lit(first).alias("start_window"), F.lit(last).alias("end_window"), *masks(*span)) for (first, last), span in zip(listed, spans)])
    hit = lambda w: reduce(Column.bitwiseOR, [F.col(c).bitwiseAND(w[c]) for c in bitmaps.columns("_w", words)]) != 0
    bounds = lambda w: F.struct(w["start_window"].alias("start_window"), w["end_window"].alias("end_window"))
    return marked.select(*keys, F.transform(F.filter(known, hit), bounds).alias("windows"))


def open_windows(nested: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """One row per window of a key, with what is known of it.

    The outer form, as of the inner one Spark infers a filter on the size of the array, which it
    pushes below the steps that made the array and so repeats them inside each other.
    """
    return nested.select(*keys, F.inline_outer("windows")).where(F.col("start_window").isNotNull())


def windows_with_events(
    events: DataFrame, windows: Calendar | DataFrame, keys: Sequence[str] = KEYS, nested: bool = False, most: int = WINDOW_LIST
) -> DataFrame:
    """Distinct windows with an event per key, for a regular calendar or any table of windows.

    A key's events are bits until its windows are known, so that only the bits are shuffled and nothing is
    made distinct afterwards. ``nested`` gives one row per key with its windows in order, as the array
    ``windows``; the steps below then go from window to window inside the row and sort nothing.
    """
    found = _windows_of_calendar(events, windows, keys) if isinstance(windows, Calendar) else _windows_of_table(events, windows, keys, most)
    return found if nested else open_windows(found, keys)


def _goes_on(before: Column, start: Column, number: Column) -> Column:
    return (month_diff(before, start) <= 1) | (start < before) | (number == 1)


def flag_discontinuity(windows: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Windows with their row number where a month or more lies between them and the window before."""
    if "windows" in windows.columns:
        def flagged(x: Column, i: Column) -> Column:
            goes_on = _goes_on(F.get("windows", i - 1)["end_window"], x["start_window"], i + 1)
            return x.withField("discont", F.when(~goes_on, i + 1))

        return windows.withColumn("windows", F.transform("windows", flagged))
    w = Window.partitionBy(*keys).orderBy("start_window", "end_window")
    number, before = F.row_number().over(w), F.lag("end_window").over(w)
    return windows.withColumn("discont", F.when(~_goes_on(before, F.col("start_window"), number), number))


def window_groups(flagged: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Flagged windows with the running number of their group."""
    if "windows" in flagged.columns:
        # Most keys have no gap. The marks are read twice, so they stay a column and are not found anew for each window.
        def grouped(x: Column, i: Column) -> Column:
            until = F.when(F.size("_marks") == 0, 0).otherwise(F.size(F.filter("_marks", lambda m: m <= i + 1)))
            return x.withField("grp", until.cast("long"))

        marked = flagged.withColumn("_marks", F.filter(F.col("windows.discont"), lambda m: m.isNotNull()))
        return marked.withColumn("windows", F.transform("windows", grouped)).drop("_marks")
    w = Window.partitionBy(*keys).orderBy("start_window", "end_window").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return flagged.withColumn("grp", F.sum(flag(F.col("discont").isNotNull())).over(w))


def window_periods(windows: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Periods of windows that follow each other, for windows of any calendar."""
    groups = window_groups(flag_discontinuity(windows, keys), keys)
    if "windows" in windows.columns:
        def period(g: Column) -> Column:
            own = lambda c: F.transform(F.filter("windows", lambda x: x["grp"] == g), lambda x: x[c])
            return F.struct(F.array_min(own("start_window")).alias("from_date"), F.array_max(own("end_window")).alias("to_date"))

        numbers = F.sequence(F.lit(0).cast("long"), F.get("windows", F.size("windows") - 1)["grp"])
        return groups.select(*keys, F.inline(F.transform(numbers, period)))
    groups = groups.groupBy(*keys, "grp")
    return groups.agg(F.min("start_window").alias("from_date"), F.max("end_window").alias("to_date")).drop("grp")


def _periods(df: DataFrame, keys: Sequence[str], prefix: str, words: int, calendar: Calendar) -> DataFrame:
    """Dated periods from the window numbers in the set ``prefix`` of each row.

    Windows that overlap or follow each other without a month left out cover a run of months.
    """
    df = bitmaps.put(df, **{prefix: bitmaps.below(bitmaps.get(prefix, words), calendar.n)})
    df = bitmaps.spread(df, prefix, words, calendar.reach, calendar.longest - 1, up=True)
    found = df.select(*keys, F.explode(bitmaps.runs(bitmaps.get(prefix, words))).alias("_r"))
    return found.select(*keys, calendar.start(F.col("_r.first")).alias("from_date"), calendar.last_day_of(F.col("_r.last")).alias("to_date"))


def rolling_condition_periods(events: DataFrame, calendar: Calendar) -> DataFrame:
    """Periods of consecutive calendar windows that contain an event.

    The months of a key's events are bits, joined by OR before the shuffle; a key is one row
    a task, however many events it has, and nothing is put in order.
    """
    words = bitmaps.words_for(calendar.span)
    windows = bitmaps.spread(_months_with_events(events, calendar, KEYS), "_w", words, calendar.reach, calendar.longest - 1, up=False)
    return _periods(windows, KEYS, "_w", words, calendar)


# ---- conditions described by a table of rules -------------------------------------

@dataclass(frozen=True)
class ConditionSpec:
    """How claims show a condition.

    ``abbrev`` and the exclusions name 0/1 columns of the diagnosis lookup. Fields
    are '1', '1-2' or 'any' diagnosis positions. Type 1 needs one claim of a
    ``claim_type1`` in a window; type 2 also accepts two or more claims of a
    ``claim_type2`` at least a day apart.
    """

    code: int
    desc: str
    abbrev: str
    condition_type: int
    dx_fields: str = "any"
    claim_type1: tuple[int, ...] = ()
    claim_type2: tuple[int, ...] = ()
    exclude1: str | None = None
    exclude1_fields: str = "any"
    exclude2: str | None = None
    exclude2_fields: str = "any"
    lookback_months: int = 24

    @property
    def exclusions(self) -> list[tuple[str, str]]:
        both = [(self.exclude1, self.exclude1_fields), (self.exclude2, self.exclude2_fields)]
        return [(c, f) for c, f in both if c is not None]


def specs_from_config(config: Mapping, prefix: str = "ccw_") -> list[ConditionSpec]:
    """Condition rules from the sections of a configuration with ``cond_`` in their name.

    Lookup columns are the configured names with ``prefix``. Results carry the prefixed
    short name as description.
    """
    def column(name: str | None) -> str | None:
        return None if name is None else prefix + name

    def types(value) -> tuple[int, ...]:
        listed = value if isinstance(value, (list, tuple)) else [] if value is None else [value]
        return tuple(int(v) for v in listed)

    return [
        ConditionSpec(
            code=int(c["ccw_code"]), desc=column(c["ccw_abbrev"]), abbrev=column(c["ccw_abbrev"]),
            condition_type=int(c["condition_type"]), dx_fields=str(c["dx_fields"]),
            claim_type1=types(c.get("claim_type1")), claim_type2=types(c.get("claim_type2")),
            exclude1=column(c.get("dx_exclude1")), exclude1_fields=str(c.get("dx_exclude1_fields") or "any"),
            exclude2=column(c.get("dx_exclude2")), exclude2_fields=str(c.get("dx_exclude2_fields") or "any"),
            lookback_months=int(c["lookback_months"]),
        )
        for name, c in config.items() if "cond_" in name
    ]


# Diagnosis position codes allowed by each field rule.
DX_FIELDS = {"1": ["01"], "1-2": ["01", "02"]}


def dx_field_filter(fields: str, number: str = "icdcm_number") -> Column:
    """True for the diagnosis positions a rule allows."""
    if fields == "any":
        return F.lit(True)
    if fields not in DX_FIELDS:
        raise ValueError(f"diagnosis fields must be '1', '1-2' or 'any', not {fields!r}")
    return F.col(number).isin(*DX_FIELDS[fields])


def _any(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def _match_codes(claim_dx: DataFrame, dx_lookup: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Diagnoses joined to the lookup rows that carry at least one of the flags."""
    names = sorted(set(columns))
    ref = dx_lookup.filter(_any([F.col(c) == 1 for c in names])).select(
        F.col("dx").alias("icdcm_norm"), F.col("dx_ver").alias("icdcm_version"), *names
    )
    return claim_dx.select("claim_header_id", "icdcm_norm", "icdcm_version", "icdcm_number").join(
        ref, ["icdcm_norm", "icdcm_version"]
    )


def max_flags(claim_dx: DataFrame, dx_lookup: DataFrame, flags: Mapping[str, str]) -> DataFrame:
    """Per claim, whether any of its diagnoses carries each lookup flag, for claims with one at least.

    ``flags`` maps result columns to lookup columns.
    """
    matched = _match_codes(claim_dx, dx_lookup, list(flags.values()))
    return matched.groupBy("claim_header_id").agg(*[F.max(column).alias(name) for name, column in flags.items()])


def claim_exclusion(claim_dx: DataFrame, dx_lookup: DataFrame, spec: ConditionSpec) -> DataFrame:
    """Diagnoses of the claims that carry none of the condition's exclusions."""
    if not spec.exclusions:
        return claim_dx
    hits = _match_codes(claim_dx, dx_lookup, [c for c, _ in spec.exclusions]).filter(
        _any([(F.col(c) == 1) & dx_field_filter(f) for c, f in spec.exclusions])
    )
    return not_in_keys(claim_dx, "claim_header_id", hits, "claim_header_id")


def qualifying_claims(claim_dx: DataFrame, dx_lookup: DataFrame, specs: Sequence[ConditionSpec]) -> DataFrame:
    """Claims per condition with their number of qualifying diagnoses, without the
    claims the condition excludes. All conditions in one pass over the diagnoses.

    A diagnosis without a claim id stands alone: no exclusion reaches it, and it shares
    no row with others of its kind.
    """
    needed = [s.abbrev for s in specs] + [c for s in specs for c, _ in s.exclusions]
    matched = _match_codes(claim_dx, dx_lookup, needed)

    def hit(spec: ConditionSpec) -> Column:
        counts = (F.col(spec.abbrev) == 1) & dx_field_filter(spec.dx_fields)
        bars = _any([(F.col(c) == 1) & dx_field_filter(f) for c, f in spec.exclusions])
        return F.when(
            counts | bars,
            F.struct(F.lit(spec.code).alias("ccw_code"), flag(counts).alias("counts"), flag(bars & F.col("claim_header_id").isNotNull()).alias("bars")),
        )

    alone = F.when(F.col("claim_header_id").isNull(), F.monotonically_increasing_id()).alias("_alone")
    hits = matched.select(
        "claim_header_id", alone, F.explode(F.filter(F.array(*[hit(s) for s in specs]), lambda h: h.isNotNull())).alias("h")
    ).select("claim_header_id", "_alone", "h.*")
    return (
        hits.groupBy("claim_header_id", "_alone", "ccw_code")
        .agg(F.sum("counts").alias("n_dx"), F.max("bars").alias("_barred"))
        .filter((F.col("_barred") == 0) & (F.col("n_dx") > 0)).drop("_barred", "_alone")
    )


def _claim_flags(specs: Sequence[ConditionSpec], attribute: str) -> Column:
    return flag(_any([
        (F.col("ccw_code") == s.code) & F.col("claim_type_id").isin(*getattr(s, attribute))
        for s in specs if getattr(s, attribute)
    ]))


def _with_header(claims: DataFrame, claim_header: DataFrame, specs: Sequence[ConditionSpec], how: str, person: str) -> DataFrame:
    header = claim_header.select(
        person, "claim_header_id", F.col("claim_header_id").alias("_claim"), "claim_type_id", "first_service_date"
    )
    return header.join(claims, "claim_header_id", how).select(
        person, F.col("_claim").alias("claim_header_id"), "claim_type_id", "first_service_date", "ccw_code", "n_dx",
        _claim_flags(specs, "claim_type1").alias("condition1"),
        _claim_flags(specs, "claim_type2").alias("condition2"),
    )


def classify_claims(
    claim_dx: DataFrame, claim_header: DataFrame, dx_lookup: DataFrame, specs: Sequence[ConditionSpec], person: str = "id_mcaid"
) -> DataFrame:
    """Qualifying claims with flags and dates by claim type, one row per claim and
    condition; ``n_dx`` is the number of qualifying diagnoses.

    Claims without a header stay, with NULLs from it; so does each diagnosis without a claim id.
    """
    rows = _with_header(qualifying_claims(claim_dx, dx_lookup, specs), claim_header, specs, "right", person)
    for i in (1, 2):
        rows = rows.withColumn(
            f"condition_{i}_from_date", F.when(F.col(f"condition{i}") == 1, F.col("first_service_date"))
        )
    return rows


def per_diagnosis(classified: DataFrame) -> DataFrame:
    """Classified claims with one row per qualifying diagnosis instead of a count."""
    columns = [c for c in classified.columns if c != "n_dx"]
    return classified.select(*columns, F.explode(F.sequence(F.lit(1), F.col("n_dx").cast("int")))).select(*columns)


def person_window_matrix(persons: DataFrame, calendar: Calendar, person: str = "id_mcaid") -> DataFrame:
    """Every person with every window."""
    ids = persons.select(person).distinct()
    return calendar.explode(F.lit(0), F.lit(calendar.n - 1), [person], ids)


def window_claim_threshold(
    classified: DataFrame, specs: Sequence[ConditionSpec], calendar: Calendar, person: str = "id_mcaid"
) -> DataFrame:
    """Claim counts per person, condition and window, for windows that meet the rule.

    Claims are summed per month first, so a person and condition holds at most one entry per month.
    """
    keys = [person, "ccw_code"]
    dated = classified.filter(F.col(person).isNotNull() & calendar.covers("first_service_date"))
    monthly = dated.groupBy(*keys, calendar.month("first_service_date").alias("m")).agg(
        F.sum(F.col("n_dx") * F.col("condition1")).alias("n1"),
        F.sum(F.col("n_dx") * F.col("condition2")).alias("n2"),
        F.min("condition_2_from_date").alias("d_min"),
        F.max("condition_2_from_date").alias("d_max"),
    )
    # A person and condition is one row with its months. Windows differ only where a month enters or
    # leaves, so months are added up once for each stretch of equal windows, inside the row: rows of
    # windows are only made where the rule is met, and nothing is grouped after that.
    months = monthly.groupBy(*keys).agg(F.collect_list(F.struct("m", "n1", "n2", "d_min", "d_max")).alias("_months"))
    bound = lambda of: F.transform("_months", lambda x: of(x["m"]))
    points = F.array_distinct(F.concat(bound(calendar.lowest), bound(lambda m: calendar.highest(m) + 1)))
    months = months.withColumn("_points", F.sort_array(points))
    zero, never = F.lit(0).cast("long"), F.lit(None).cast("date")
    names = ["condition_1_cnt", "condition_2_cnt", "condition_2_min_date", "condition_2_max_date"]

    def of(*values: Column) -> Column:
        return F.struct(*[v.alias(n) for v, n in zip(values, names)])

    def added(s: Column, x: Column) -> Column:
        return of(s[names[0]] + x["n1"], s[names[1]] + x["n2"], F.least(s[names[2]], x["d_min"]), F.greatest(s[names[3]], x["d_max"]))

    def stretch(i: Column) -> Column:
        k = F.get("_points", i)
        inside = F.filter("_months", lambda x: x["m"].between(k, k + (calendar.months - 1)))
        return F.struct(k.alias("first"), (F.get("_points", i + 1) - 1).alias("last"), F.aggregate(inside, of(zero, zero, never, never), added).alias("c"))

    two_claims = F.col("ccw_code").isin(*[s.code for s in specs if s.condition_type == 2])

    def meets(w: Column) -> Column:
        c = w["c"]
        twice = (c["condition_2_cnt"] >= 2) & spans_days(c["condition_2_min_date"], c["condition_2_max_date"])
        return (c["condition_1_cnt"] >= 1) | (two_claims & twice)

    stretches = F.transform(F.sequence(F.lit(0), F.size("_points") - 2), stretch)
    found = months.select(*keys, F.inline(F.filter(stretches, meets)))
    opened = found.select(*keys, F.explode(F.sequence("first", "last")).alias("k"), *[F.col(f"c.{n}") for n in names])
    return opened.select(*keys, *calendar.bounds(F.col("k")), *names)


def condition_periods(
    claim_dx: DataFrame, claim_header: DataFrame, dx_lookup: DataFrame, specs: Sequence[ConditionSpec], calendar: Calendar,
    person: str = "id_mcaid",
) -> DataFrame:
    """Periods per person and condition, for all conditions that share a calendar.

    A window meets the rule if it contains a type-1 claim, or (type 2) type-2 claims on two
    days. Days are reduced per month (a type-1 claim, a type-2 claim, type-2 claims on two
    days), months are bits of a key's row, and windows and periods are found by shifts.
    """
    keys = [person, "ccw_code"]
    claims = _with_header(qualifying_claims(claim_dx, dx_lookup, specs), claim_header, specs, "inner", person)
    two_claims = F.col("ccw_code").isin(*[s.code for s in specs if s.condition_type == 2])
    dated = claims.filter(F.col(person).isNotNull() & calendar.covers("first_service_date"))
    second = F.when((F.col("condition2") == 1) & two_claims, F.col("first_service_date"))
    monthly = dated.groupBy(*keys, calendar.month("first_service_date").alias("_m")).agg(
        F.max("condition1").alias("one"), F.min(second).alias("_from"), F.max(second).alias("_to")
    )
    words = bitmaps.words_for(calendar.span)
    sets = {"_one": F.col("one") == 1, "_two": F.col("_from").isNotNull(), "_both": F.col("_from") < F.col("_to")}
    marked = monthly.groupBy(*keys).agg(*[
        w.alias(c) for prefix, only in sets.items()
        for w, c in zip(bitmaps.union_of(F.col("_m"), words, only), bitmaps.columns(prefix, words))
    ])
    found = bitmaps.spread(marked, "_one", words, calendar.reach, calendar.longest - 1, up=False)
    found = bitmaps.twice_within(found, "_two", "_both", words, calendar.months, calendar.longest)
    found = bitmaps.put(found, _one=bitmaps.either(bitmaps.get("_one", words), bitmaps.get("_both", words)))
    names = relabel(F.col("ccw_code").cast("string"), {str(s.code): s.desc for s in specs})
    return _periods(found, keys, "_one", words, calendar).select(person, "from_date", "to_date", "ccw_code", names.alias("ccw_desc"))


def _calendar_by_code(used: Mapping[int, Calendar]) -> Calendar:
    """The calendar of each row's condition."""
    if len(set(used.values())) == 1:
        return next(iter(used.values()))

    def pick(value) -> Column:
        return reduce(lambda acc, kv: acc.when(F.col("ccw_code") == kv[0], value(kv[1])), used.items(), F)

    return Calendar(
        pick(lambda c: as_date(c.first)), pick(lambda c: c.n), pick(lambda c: c.months),
        most_months=max(c.span for c in used.values()), longest_window=max(c.longest for c in used.values()),
    )


def multi_condition_run(
    claim_dx: DataFrame, claim_header: DataFrame, dx_lookup: DataFrame, specs: Sequence[ConditionSpec],
    calendars: dict[int, Calendar], person: str = "id_mcaid",
) -> DataFrame:
    """Periods of every condition; ``calendars`` maps look-back months to the calendar.

    All look-backs share one pass over the claims: the calendar is a column.
    """
    missing = {s.lookback_months for s in specs} - set(calendars)
    if missing:
        raise ValueError(f"no calendar for a look-back of {sorted(missing)} months")
    used = {s.code: calendars[s.lookback_months] for s in specs}
    # Bounds over all calendars are constants, so they reach the file scan.
    start = min(c.first for c in used.values())
    ends = [c.end(F.lit(c.n - 1)) for c in set(used.values())]
    header = claim_header.filter(
        F.col("first_service_date").between(as_date(start), ends[0] if len(ends) == 1 else F.greatest(*ends))
    )
    return condition_periods(claim_dx, header, dx_lookup, specs, _calendar_by_code(used), person)


def load_condition_table(periods: DataFrame, path: str, load_id: str | None = None) -> DataFrame:
    """Rebuild the condition table from the periods of all conditions, with load time.

    The former table stays current until the new one is whole; a ``load_id`` loaded before changes
    nothing. The id keeps the type it has in the claims.
    """
    return versions.replace(periods.withColumn("last_run", F.current_timestamp()), path, load_id)
