"""Numbers with many handsets, on both sides of both limits."""

from __future__ import annotations

from collections import Counter
from datetime import date

from bindwell.operators import planning


def spells_of(msisdn, handsets, twins=0):
    """Held spells of handsets far apart; the first ``twins`` have a second IMEI each."""
    imeis = [f"35100000{k * 10:06d}" for k in range(handsets)] + [f"35100000{k * 10 + 1:06d}" for k in range(twins)]
    return [(msisdn, imei, date(2026, 2, 1), None, 0) for imei in imeis]


def test_heavy_numbers_are_one_row_not_assessed(spark):
    rows = spells_of(1, 20) + spells_of(2, 21) + spells_of(3, 20, 20) + spells_of(5, 21, 20) + spells_of(6, 41) + spells_of(7, 21, 19)
    spell = spark.createDataFrame(rows, "msisdn long, imei string, start date, finish date, dump int")
    events = planning.spell_events(spell, "2026-04-25")
    got = Counter((r["msisdn"], r["outcome"]) for r in events.collect())
    assert got == {(1, 3): 20, (2, 4): 1, (3, 3): 20, (5, 4): 1, (6, 4): 1, (7, 4): 1}
    assert all((r["imei"], r["next_imei"], r["days"], r["cohort"]) == (None, None, 0, 0) for r in events.where("outcome = 4").collect())


def test_survival_leaves_out_numbers_not_assessed(spark):
    tenure = spark.createDataFrame([(0, 0, 1), (0, 0, 4), (0, 0, 4), (0, 5, 3)], "cohort int, days int, outcome int")
    assert [(r["days"], r["events"], r["at_risk"], r["share"]) for r in planning.survival(tenure).collect()] == [(0, 1, 2, 0.5)]
