"""Small cases of the fold, lifetimes and survival."""

from __future__ import annotations

import datetime as dt

from bindwell.operators import fold, planning
from bindwell.operators.daily import missing_days

EVENT = "seq int, data_date date, msisdn long, imsi long, imei string, tac string, label string"
A, B = "35100100000001", "35100100000002"


def day(n):
    return dt.date(2026, 2, n)


def events(spark, rows):
    return spark.createDataFrame([(s, day(d), 1, 1, i, i[:8], label) for s, d, i, label in rows], EVENT)


def dump(spark, imeis):
    return spark.createDataFrame([(1, 1, i) for i in imeis], "msisdn long, imsi long, imei string")


def test_last_event_decides_and_date_beats_sequence(spark):
    log = events(spark, [(9, 1, A, "remove"), (2, 2, A, "add")])
    state = fold.fold_all(dump(spark, [B]), log).collect()
    got = {r["imei"]: (r["active"], r["last_change_seq"], r["last_change_date"]) for r in state}
    assert got == {A: (1, 2, day(2)), B: (1, 0, None)}


def test_idle_events_and_periods(spark):
    log = events(spark, [(1, 1, A, "remove"), (2, 2, A, "add"), (3, 3, A, "add"), (4, 4, A, "remove"), (1, 1, B, "add")])
    outcomes = sorted((r["imei"], r["data_date"].day, r["outcome"]) for r in fold.fold_outcomes(log, dump(spark, [B])).collect())
    assert outcomes == [(A, 1, "orphan_remove"), (A, 2, "applied"), (A, 3, "redundant_add"), (A, 4, "applied"), (B, 1, "redundant_add")]
    life = {r["imei"]: r for r in fold.lifetimes(log, dump(spark, [B])).collect()}
    assert (life[A]["periods"], life[A]["active"], life[A]["redundant"], life[A]["orphan"]) == (1, 0, 1, 1)
    assert (life[B]["periods"], life[B]["active"], life[B]["first_seen"]) == (1, 1, dt.date(1970, 1, 1))


def test_late_day_ends_as_if_on_time(spark):
    log = events(spark, [(1, 1, A, "add"), (2, 2, A, "remove"), (7, 3, A, "add"), (1, 1, B, "add")])
    none = dump(spark, [])
    late = log.where("seq = 2")
    got = fold.refold_keys(fold.fold_all(none, log.where("seq <> 2")), log, none, late)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, fold.fold_all(none, log).collect()))


def test_union_of_periods(spark):
    spans = spark.createDataFrame([(1, day(1), day(3)), (1, day(2), day(5)), (1, day(7), None), (1, day(9), day(10))], "msisdn long, open date, close date")
    got = sorted((r["open"], r["close"]) for r in fold.union_periods(spans, ["msisdn"]).collect())
    assert got == [(day(1), day(5)), (day(7), None)]


def test_empty_tables(spark):
    none = events(spark, []), dump(spark, [])
    assert fold.fold_all(none[1], none[0]).count() == 0
    assert fold.lifetimes(*none).count() == 0
    assert missing_days(none[0]).count() == 0


def test_survival_of_ten_spells(spark):
    rows = [(0, d, 1) for d in (2, 2, 4)] + [(0, 4, 2)] + [(0, d, 1) for d in (6, 6)] + [(0, 8, 3)] * 4
    got = [(r["days"], r["share"]) for r in planning.survival(spark.createDataFrame(rows, "cohort int, days int, outcome int")).orderBy("days").collect()]
    assert got == [(2, 0.8), (4, 0.7), (6, round(0.7 * 4 / 6, 6))]
