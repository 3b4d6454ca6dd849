"""Event numbering: tie rules, and both routes for persons of any size."""

import random
from datetime import datetime, timedelta

import pytest

from strandline.operators import sequence as seq
from strandline.plans import detentions

SCHEMA = "intake_no bigint, kcid bigint, call_stamp timestamp_ntz"


def make_events(n, seed, persons=4, share_null=0.3):
    rng, base = random.Random(seed), datetime(2020, 3, 7, 23, 0)  # a clock change follows the next day
    rows = []
    for i in range(n):
        person = None if rng.random() < share_null else rng.randrange(persons)
        rows.append((i * 7 % (n * 7 + 1), person, base + timedelta(minutes=rng.choice([0, 0, 1, 30, 61, 180, 1440]) * rng.randrange(4))))
    return rows


def expected(rows):
    out, by_person = {}, {}
    for r in rows:
        by_person.setdefault(r[1], []).append(r)
    for rs in by_person.values():
        rs.sort(key=lambda r: (r[2], r[0]))
        for i, r in enumerate(rs):
            out[r[0]] = (i + 1, sum(x[2] <= r[2] for x in rs), rs[i - 1][2] if i else None)
    return out


@pytest.mark.parametrize("hot_rows", [None, 2_000_000, 40, 0])
def test_both_routes_match_a_direct_count(spark, monkeypatch, hot_rows):
    monkeypatch.setattr(seq, "TIE_BLOCK", 50)
    rows = make_events(300, 5)
    df = seq.number_events(spark.createDataFrame(rows, SCHEMA), "kcid", "call_stamp", "intake_no", hot_rows=hot_rows)
    got = {r.intake_no: (r.position, r.ordinal, r.prev_stamp) for r in df.collect()}
    assert got == expected(rows)
    assert dict(df.dtypes)["ordinal"] == dict(df.dtypes)["position"] == "bigint"


def test_split_keeps_every_row_once(spark):
    df = spark.createDataFrame(make_events(200, 1), SCHEMA)
    ordinary, hot = seq.split_hot(df, ["kcid"], 50)
    keys = {r.kcid for r in hot.select("kcid").distinct().collect()}
    assert None in keys
    assert ordinary.count() + hot.count() == 200
    assert not keys & {r.kcid for r in ordinary.select("kcid").distinct().collect()}


def test_ties_share_the_last_ordinal_and_leave_no_first_event(spark):
    d = datetime
    rows = [(1, 1, d(2020, 1, 1)), (2, 1, d(2020, 1, 1)), (3, 1, d(2020, 1, 5)), (4, 2, d(2020, 2, 1))]
    df = spark.createDataFrame(rows, SCHEMA)
    numbered = {r.intake_no: r for r in detentions.episode_gaps(detentions.detention_sequence(df)).collect()}
    assert [numbered[i].ordinal for i in (1, 2, 3, 4)] == [2, 2, 3, 1]
    assert [numbered[i].gap_days for i in (1, 2, 3, 4)] == [None, 0, 4, None]
    entrants = detentions.new_entrants_by_year(df).collect()
    assert [(r.call_year, r.entry_cnt, r.total_cnt, r.total_cnt_dis) for r in entrants] == [(2020, 1, 4, 2)]


def test_mean_gap_needs_no_order(spark):
    """Means from first and last stamp equal means over single gaps."""
    rows = make_events(120, 9, persons=30, share_null=0.1)
    df = spark.createDataFrame(rows, SCHEMA)
    gaps = detentions.episode_gaps(detentions.detention_sequence(df)).filter("ordinal > 1").collect()
    by = {}
    for r in gaps:
        if r.gap_days is not None:
            by.setdefault(r.kcid, []).append(r.gap_days)
    got = {r.kcid: r.av for r in detentions.repeat_gap_groups(df).collect()}
    assert got == {k: None if k is None else sum(v) // len(v) for k, v in by.items()}
    every = [g for v in by.values() for g in v]
    assert detentions.overall_mean_gap(df).first().avg == sum(every) // len(every)


def test_no_repeat_gives_an_empty_mean(spark):
    df = spark.createDataFrame([(1, 1, datetime(2020, 1, 1))], SCHEMA)
    assert detentions.overall_mean_gap(df).collect()[0].avg is None
    assert detentions.repeat_gap_groups(df).collect() == []


def test_both_routes_on_dates(spark, monkeypatch):
    monkeypatch.setattr(seq, "TIE_BLOCK", 5)
    rows = [(i, "a" if i % 3 else None, datetime(2020, 1, 1 + i * 7 % 11).date()) for i in range(60)]
    df = spark.createDataFrame(rows, "kcid bigint, p1_id string, post_stamp date")
    plain, split = (
        {tuple(r) for r in seq.number_events(df, "p1_id", "post_stamp", "kcid", hot_rows=n).collect()} for n in (None, 10)
    )
    assert plain == split and len(plain) == 60


@pytest.mark.parametrize("kind", ["bigint", "string", "date", "double"])
@pytest.mark.parametrize("hot_rows", [2_000_000, 40, 0])
def test_both_routes_agree_for_repeats_and_any_tie(spark, monkeypatch, kind, hot_rows):
    monkeypatch.setattr(seq, "TIE_BLOCK", 3)
    monkeypatch.setattr(seq, "TIE_PREFIX", 2)
    rng, base = random.Random(11), datetime(2020, 3, 7, 23, 0)
    value = {
        "bigint": lambda i: i, "string": lambda i: f"k{i:02d}", "date": lambda i: (base + timedelta(days=9 * i)).date(), "double": float,
    }[kind]
    rows = [
        (rng.choice([None, 1, 2]), base + timedelta(minutes=rng.choice([0, 0, 0, 30, 90, 3000])), rng.choice([None, *map(value, range(12))]), rng.randrange(40))
        for _ in range(300)
    ]
    rows += rows[:60]  # whole rows that repeat
    df = spark.createDataFrame(rows, f"kcid bigint, call_stamp timestamp_ntz, tie {kind}, petition_no bigint")
    for tie in ("tie", ["tie", "petition_no"]):
        plain, split = (
            sorted(map(repr, seq.number_events(df, "kcid", "call_stamp", tie, "petition_no", hot_rows=n).select("kcid", "call_stamp", *([tie] if tie == "tie" else tie), "position", "ordinal", "prev_stamp").collect()))
            for n in (None, hot_rows)
        )
        assert plain == split and len(plain) == 360
