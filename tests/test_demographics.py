"""Race and ethnicity recodes on every combination of the flags that matter."""

from itertools import product

from strandline.plans import demographics as demo

RACES = ["AIAN", "Asian", "BlackAA", "MENA", "NHPI", "Other", "White"]
SCHEMA = "kcid bigint, Multiple_race int, " + ", ".join(f"{r} int" for r in RACES) + ", Unknown_Race int, hispanic string"


def person_rows():
    k = 0
    for multi, asian, white, unknown, hisp in product([0, 1, None], [0, 1], [0, 1, None], [0, 1, None], ["yes", "no", "unknown", None]):
        k += 1
        yield (k, multi, 0, asian, 0, 0, 0, 0, white, unknown, hisp)


def expected(row):
    """The rules, one person at a time; None stands for a value that is not there."""
    _, multi, *races, unknown_race, answer = row
    hisp = {"yes": 1, "no": 0, "unknown": 0}.get(answer, 0.5)
    if answer is None or unknown_race is None:
        unknown = 0.5
    else:
        unknown = 1 if unknown_race == 1 or answer == "unknown" else 0
    total = None if None in races else sum(races) + unknown
    several = multi == 1 or (total is not None and total > 1)
    if several and hisp in (0, 1):
        multiple = 1 - hisp
    elif multi == 0 and total in (0, 1) and hisp in (0, 1):
        multiple = 0
    else:
        multiple = 0.5
    label = None
    if hisp == 1:
        label = "Hispanic"
    elif hisp == 0 and multiple == 1:
        label = "Multi-Race,NH"
    elif hisp == 0 and multiple == 0:
        flags = dict(zip(RACES, races)) | {"unknown": unknown}
        known = [(flags[c], -i, c) for i, c in enumerate(demo.LABEL_ORDER) if flags[c] is not None]
        label = max(known)[2]
    return hisp, unknown, total, multiple, label


def test_recodes_and_rollup(spark):
    rows = list(person_rows())
    flagged = demo.multiple_race_flag(demo.recode_ethnicity(spark.createDataFrame(rows, SCHEMA)))
    got = {r.kcid: (r.hisp, r.unknown, r.sum_race, r.multiple_NH) for r in flagged.collect()}
    assert got == {r[0]: expected(r)[:4] for r in rows}
    labels = {r.kcid: r.race for r in demo.race_rollup(flagged).collect()}
    assert labels == {r[0]: expected(r)[4] for r in rows if expected(r)[4]}
    single = {r.kcid: r.race for r in demo.single_race_label(flagged).collect()}
    assert single == {k: v for k, v in labels.items() if v not in ("Hispanic", "Multi-Race,NH")}


def test_all_zero_flags(spark):
    flagged = demo.multiple_race_flag(demo.recode_ethnicity(spark.createDataFrame([(1, 0, *[0] * 7, 0, "no")], SCHEMA)))
    assert demo.race_rollup(flagged).first().race == "AIAN"
    assert demo.race_rollup(flagged, zero_label="None stated").first().race == "None stated"


def test_persons_without_label_count_under_null(spark):
    persons = spark.createDataFrame([(1, 2020), (2, 2020), (None, 2020), (1, 2021)], "kcid bigint, year int")
    labels = spark.createDataFrame([(1, "Asian")], "kcid bigint, race string")
    assert {(r.race, r["count"]) for r in demo.race_summary(persons, labels).collect()} == {("Asian", 1), (None, 2)}
    wide = demo.race_summary_wide(persons, labels, [2020, 2021]).collect()
    assert {tuple(r) for r in wide} == {("Asian", 1, 1), (None, 2, None)}
