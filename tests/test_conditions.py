"""Condition periods against brute force on small random claims, for several calendars."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from strandline.operators import bitmaps
from strandline.operators.relational import window_pairs
from strandline.plans import conditions
from strandline.plans.conditions import Calendar, ConditionSpec


def add_months(d, n):
    ix = d.year * 12 + d.month - 1 + n
    return date(ix // 12, ix % 12 + 1, 1)


def windows(cal):
    first = date.fromisoformat(cal.first)
    return [(add_months(first, k), add_months(first, k + cal.months) - timedelta(days=1)) for k in range(cal.n)]


def chain(hit):
    """Literal collapse of the windows hit: a gap of more than one month boundary starts a period."""
    out = []
    for start, end in sorted(hit):
        if out and (start.year - out[-1][1].year) * 12 + start.month - out[-1][1].month <= 1:
            out[-1][1] = end
        else:
            out.append([start, end])
    return [tuple(p) for p in out]


def random_dates(rng, n):
    return [date(2014, 6, 1) + timedelta(days=rng.randrange(3000)) for _ in range(n)]


CALENDARS = [Calendar("2015-01-01", 60, 1), Calendar("2015-01-01", 48, 3), Calendar("2015-03-01", 40, 24), Calendar("2016-11-01", 1, 12),
             Calendar("2014-01-01", 60, 30), Calendar("2013-01-01", 120, 7), Calendar("2014-01-01", 30, 70)]


@pytest.mark.parametrize("cal", CALENDARS, ids=str)
def test_rolling_periods_equal_the_window_matrix(spark, cal):
    rng = random.Random(str(cal))
    events = {(f"P{p}", rng.choice(["x", None]), d) for p in range(12) for d in random_dates(rng, rng.randrange(1, 7))}
    df = spark.createDataFrame(sorted(events, key=str), "id_mcaid string, bh_cond string, svc_date date")
    want = set()
    for key in {e[:2] for e in events}:
        hit = [w for w in windows(cal) if any(e[:2] == key and w[0] <= e[2] <= w[1] for e in events)]
        want |= {key + p for p in chain(hit)}
    assert {tuple(r) for r in conditions.rolling_condition_periods(df, cal).collect()} == want
    pairs = {(*e, *w) for e in events for w in windows(cal) if w[0] <= e[2] <= w[1]}
    got = conditions.window_matrix(df, cal).select("id_mcaid", "bh_cond", "svc_date", "start_window", "end_window")
    assert {tuple(r) for r in got.collect()} == pairs
    table = spark.createDataFrame(windows(cal), "start_window date, end_window date")
    assert {tuple(r) for r in window_pairs(df, table, "svc_date").select(got.columns).collect()} == pairs
    assert Calendar.of(table) == cal


def test_bit_sets_equal_sets(spark):
    """Shifts, windows with one or two members, and runs, over one to four words."""
    rng = random.Random(4)
    for n in (5, 62, 63, 64, 126, 130, 200):
        words = bitmaps.words_for(n)
        sets = [sorted(rng.sample(range(n), rng.randrange(0, min(n, 12)))) for _ in range(25)] + [[], list(range(n)), [0], [n - 1]]
        rows = spark.createDataFrame([(i, p) for i, s in enumerate(sets) for p in s] + [(i, None) for i in range(len(sets))], "i int, p int")
        df = rows.groupBy("i").agg(*[w.alias(c) for w, c in zip(bitmaps.union_of(F.col("p"), words, F.col("p").isNotNull()), bitmaps.columns("a", words))])
        length = rng.randrange(1, n + 1)
        df = bitmaps.put(df, b=bitmaps.get("a", words), c=bitmaps.get("a", words), d=[F.lit(0).cast("long")] * words)
        df = bitmaps.spread(df, "b", words, F.lit(length - 1), length - 1, up=True)
        df = bitmaps.twice_within(df, "c", "d", words, length, length)
        found = df.select("i", *[bitmaps.places(bitmaps.below(bitmaps.get(x, words), n)).alias(x) for x in "abcd"], bitmaps.runs(bitmaps.get("a", words)).alias("runs")).collect()
        for r in found:
            own = sets[r.i]
            assert r.a == own
            assert r.b == [k for k in range(n) if any(k - length < p <= k for p in own)]
            inside = [sum(k <= p < k + length for p in own) for k in range(n)]
            assert r.c == [k for k in range(n) if inside[k] > 0] and r.d == [k for k in range(n) if inside[k] > 1]
            assert [p for a, b in r.runs for p in range(a, b + 1)] == own and all(b + 1 not in own for _, b in r.runs)


def test_periods_over_bits_need_no_order(spark):
    events = spark.createDataFrame([("p", date(2015, 1, 3), "c")], "id_mcaid string, svc_date date, bh_cond string")
    plan = conditions.rolling_condition_periods(events, CALENDARS[2])._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "Window" not in plan and plan.count("Exchange") == 1


def test_a_key_of_repeated_events(spark):
    """A million rows of one key, all on few days: repeats fall out before anything travels, and the flags are those of the days."""
    days = [date(2015, 1, 1), date(2015, 3, 4), date(2017, 3, 4), date(2019, 3, 5), date(2019, 3, 6)]
    many = spark.range(1_000_000).select(
        F.lit("p").alias("id_mcaid"), F.array(*[F.lit(d) for d in days])[(F.col("id") % 5).cast("int")].alias("svc_date"), F.lit("c").alias("bh_cond"))
    many = many.unionByName(many.limit(2).withColumn("svc_date", F.lit(None).cast("date")))
    flags = {r.svc_date: r.cont for r in conditions.overlap_flag(many).collect()}
    assert flags == dict(zip([None, *days], [0, 0, 1, 1, 0, 1]))
    periods = conditions.forward_window_periods(many).collect()
    assert sorted((r.from_date, r.to_date) for r in periods) == [(date(2015, 1, 1), date(2019, 3, 4)), (date(2019, 3, 5), date(2021, 3, 6))]
    plan = conditions.overlap_flag(many)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Sort") < plan.index("partial_bit_or")


def test_irregular_calendars_are_refused_but_joinable(spark):
    odd = [(date(2020, 1, 10), date(2020, 2, 20)), (date(2020, 5, 1), date(2020, 5, 31))]
    table = spark.createDataFrame(odd, "start_window date, end_window date")
    with pytest.raises(ValueError):
        Calendar.of(table)
    df = spark.createDataFrame([(date(2020, 2, 20),), (date(2020, 2, 21),), (date(2020, 5, 1),)], "d date")
    assert {(r.d, r.start_window) for r in window_pairs(df, table, "d").collect()} == {
        (date(2020, 2, 20), odd[0][0]), (date(2020, 5, 1), odd[1][0])
    }


def test_forward_periods(spark):
    d = date
    rows = [("P", "x", d(2015, 1, 31)), ("P", "x", d(2017, 1, 31)), ("P", "x", d(2019, 2, 1)), ("P", "y", d(2015, 1, 1)), ("P", "y", None)]
    df = spark.createDataFrame(rows, "id_mcaid string, bh_cond string, svc_date date")
    assert {tuple(r) for r in conditions.forward_window_periods(df).collect()} == {
        ("P", "x", d(2015, 1, 31), d(2019, 1, 31)), ("P", "x", d(2019, 2, 1), d(2021, 2, 1)), ("P", "y", d(2015, 1, 1), d(2017, 1, 1))
    }


SPECS = [
    ConditionSpec(1, "one", "c1", 1, "1-2", (0, 1), (2,), "e1", "any"),
    ConditionSpec(2, "two", "c2", 2, "any", (0,), (1, 2, 3), "e1", "1", "e2", "1-2"),
    ConditionSpec(3, "late", "c2", 2, "1", (), (1, 2), None, "any", "e2", "any"),
]


def allowed(fields, number):
    return fields == "any" or number in {"1": ["01"], "1-2": ["01", "02"]}[fields]


def brute_periods(dx, header, lookup, spec, cal):
    barred = {c for _, c, code, _, n in dx for e, f in spec.exclusions if lookup[code][e] == 1 and allowed(f, n)}
    claims = [header[c] for _, c, code, _, n in dx if lookup[code][spec.abbrev] == 1 and allowed(spec.dx_fields, n) and c not in barred and c in header]
    out = set()
    for person in {h[0] for h in claims}:
        hit = []
        for w in windows(cal):
            inside = [h for h in claims if h[0] == person and w[0] <= h[2] <= w[1]]
            one = [h for h in inside if h[1] in spec.claim_type1]
            two = [h[2] for h in inside if h[1] in spec.claim_type2]
            if one or (spec.condition_type == 2 and len(two) >= 2 and (max(two) - min(two)).days >= 1):
                hit.append(w)
        out |= {(person, *p, spec.code, spec.desc) for p in chain(hit)}
    return out


@pytest.mark.parametrize("seed, cal", [(1, CALENDARS[1]), (2, CALENDARS[2]), (3, CALENDARS[0])])
def test_condition_periods_equal_brute_force(spark, seed, cal):
    rng = random.Random(seed)
    header = {c: (f"P{rng.randrange(8)}", rng.randrange(4), random_dates(rng, 1)[0]) for c in range(150) if c % 11}
    lookup = {f"K{i}": {n: int(rng.random() < q) for n, q in [("c1", 0.5), ("c2", 0.5), ("e1", 0.15), ("e2", 0.15)]} for i in range(12)}
    dx = [(header.get(c, ("Z",))[0], c, f"K{rng.randrange(12)}", 10, f"{n:02d}") for c in range(150) for n in range(1, rng.randrange(2, 5))]
    frames = (
        spark.createDataFrame(dx, "id_mcaid string, claim_header_id int, icdcm_norm string, icdcm_version int, icdcm_number string"),
        spark.createDataFrame([(h[0], c, h[1], h[2]) for c, h in header.items()],
                              "id_mcaid string, claim_header_id int, claim_type_id int, first_service_date date"),
        spark.createDataFrame([(k, 10, v["c1"], v["c2"], v["e1"], v["e2"]) for k, v in lookup.items()],
                              "dx string, dx_ver int, c1 int, c2 int, e1 int, e2 int"),
    )
    want = set().union(*[brute_periods(dx, header, lookup, s, cal) for s in SPECS])
    got = [tuple(r) for r in conditions.condition_periods(*frames, SPECS, cal).collect()]
    assert len(got) == len(set(got)) and set(got) == want

    # The counted form must qualify exactly the windows the periods are made of.
    classified = conditions.classify_claims(*frames, SPECS)
    per_window = conditions.window_claim_threshold(classified, SPECS, cal).collect()
    names = {s.code: s.desc for s in SPECS}
    keys = {(r.id_mcaid, r.ccw_code) for r in per_window}
    rebuilt = {
        (p, *per, c, names[c]) for p, c in keys
        for per in chain([(r.start_window, r.end_window) for r in per_window if (r.id_mcaid, r.ccw_code) == (p, c)])
    }
    assert rebuilt == want


def test_multi_condition_run_by_look_back(spark):
    from dataclasses import replace

    dx = spark.createDataFrame([("P", 1, "K", 10, "01")], "id_mcaid string, claim_header_id int, icdcm_norm string, icdcm_version int, icdcm_number string")
    header = spark.createDataFrame([("P", 1, 0, date(2016, 5, 5))], "id_mcaid string, claim_header_id int, claim_type_id int, first_service_date date")
    lookup = spark.createDataFrame([("K", 10, 1, 1, 0, 0)], "dx string, dx_ver int, c1 int, c2 int, e1 int, e2 int")
    specs = [replace(SPECS[0], lookback_months=12), SPECS[1]]
    calendars = {12: Calendar("2016-01-01", 12, 12), 24: Calendar("2016-01-01", 12, 24)}
    got = {tuple(r) for r in conditions.multi_condition_run(dx, header, lookup, specs, calendars).collect()}
    assert got == {("P", date(2016, 1, 1), date(2017, 4, 30), 1, "one"), ("P", date(2016, 1, 1), date(2018, 4, 30), 2, "two")}
    plan = conditions.multi_condition_run(dx, header, lookup, specs, calendars)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 2  # codes and headers, once for both look-backs
    with pytest.raises(ValueError):
        conditions.multi_condition_run(dx, header, lookup, specs, {24: calendars[24]})


@pytest.mark.parametrize("seed", [4, 5])
def test_mixed_look_backs_equal_brute_force(spark, seed):
    from dataclasses import replace

    rng = random.Random(seed)
    header = {c: (f"P{rng.randrange(6)}", rng.randrange(4), random_dates(rng, 1)[0]) for c in range(120)}
    lookup = {f"K{i}": {n: int(rng.random() < 0.4) for n in ("c1", "c2", "e1", "e2")} for i in range(10)}
    dx = [(header[c][0], c, f"K{rng.randrange(10)}", 10, f"{n:02d}") for c in range(120) for n in range(1, 4)]
    specs = [replace(s, lookback_months=m) for s, m in zip(SPECS, (1, 3, 24))]
    calendars = {1: CALENDARS[0], 3: CALENDARS[1], 24: CALENDARS[2]}
    frames = (
        spark.createDataFrame(dx, "id_mcaid string, claim_header_id int, icdcm_norm string, icdcm_version int, icdcm_number string"),
        spark.createDataFrame([(h[0], c, h[1], h[2]) for c, h in header.items()],
                              "id_mcaid string, claim_header_id int, claim_type_id int, first_service_date date"),
        spark.createDataFrame([(k, 10, v["c1"], v["c2"], v["e1"], v["e2"]) for k, v in lookup.items()],
                              "dx string, dx_ver int, c1 int, c2 int, e1 int, e2 int"),
    )
    want = set().union(*[brute_periods(dx, header, lookup, s, calendars[s.lookback_months]) for s in specs])
    assert want and {tuple(r) for r in conditions.multi_condition_run(*frames, specs, calendars).collect()} == want


def test_unknown_field_rule_is_refused():
    with pytest.raises(ValueError):
        conditions.dx_field_filter("3")


def test_claims_without_header_stay_classified(spark):
    dx = spark.createDataFrame([("P", 9, "K", 10, "01"), ("P", 9, "K", 10, "02")], "id_mcaid string, claim_header_id int, icdcm_norm string, icdcm_version int, icdcm_number string")
    header = spark.createDataFrame([], "id_mcaid string, claim_header_id int, claim_type_id int, first_service_date date")
    lookup = spark.createDataFrame([("K", 10, 1, 0, 0, 0)], "dx string, dx_ver int, c1 int, c2 int, e1 int, e2 int")
    rows = conditions.per_diagnosis(conditions.classify_claims(dx, header, lookup, SPECS[:1])).collect()
    assert [(r.id_mcaid, r.claim_header_id, r.condition1, r.condition2) for r in rows] == [(None, None, 0, 0)] * 2


def test_config_gives_the_same_specs():
    from dataclasses import replace

    from suite.composites import CONFIG, SPECS as written

    assert conditions.specs_from_config(CONFIG) == [replace(s, lookback_months=24) for s in written]
    only_second = {"cond_z": {"ccw_code": 9, "ccw_abbrev": "z", "condition_type": 1, "dx_fields": 1, "dx_exclude2": "z_excl", "lookback_months": 12}}
    assert conditions.specs_from_config(only_second)[0].exclusions == [("ccw_z_excl", "any")]


def test_diagnoses_without_a_claim_stand_alone(spark):
    dx = spark.createDataFrame(
        [(None, "A", 10, "01"), (None, "A", 10, "01"), (None, "X", 10, "01"), (1, "A", 10, "01"), (1, "X", 10, "01"), (2, "A", 10, "01"), (2, "A", 10, "02")],
        "claim_header_id long, icdcm_norm string, icdcm_version int, icdcm_number string",
    )
    lookup = spark.createDataFrame([("A", 10, 1, 0), ("X", 10, 0, 1)], "dx string, dx_ver int, c int, x int")
    spec = conditions.ConditionSpec(
        code=1, desc="c", abbrev="c", condition_type=1, dx_fields="any", claim_type1=(1,), claim_type2=(), exclude1="x", exclude1_fields="any",
        exclude2=None, exclude2_fields="any", lookback_months=12,
    )
    got = sorted(((r.claim_header_id, r.n_dx) for r in conditions.qualifying_claims(dx, lookup, [spec]).collect()), key=str)
    assert got == [(2, 2), (None, 1), (None, 1)]


def test_sections_with_cond_anywhere_in_their_name():
    section = {"ccw_code": 1, "ccw_abbrev": "a", "condition_type": 1, "dx_fields": "any", "lookback_months": 12}
    assert len(conditions.specs_from_config({"x_cond_a": section, "cond_b": section, "other": section})) == 2
