"""Column rules and curves on small cases with known answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindwell.functions.radio import parse_radio
from bindwell.functions.rules import imsi_of_iccid, normal_number
from bindwell.operators import dashboard, planning, signals, views


def radio(spark, bands, kind="Smartphone", removable="0", fixed="0", ntn="Not Known"):
    columns = "tac string, bandDetails string, deviceType string, removableEUICC string, nonremovableEUICC string, ntnConnectivity string"
    return parse_radio(spark.createDataFrame([("1", bands, kind, removable, fixed, ntn)], columns)).first().asDict()


def test_radio(spark):
    got = radio(spark, "5G NR: n1, N78 | 5G DC BC EN-DC FR1 2B: DC_1A_n3A | 5G NA Options: 5G-5Series | 4G: LTE FDD BAND 1, LTE FDD Band 32 | 4G Cat: LTE 12 | 2G/3G: GSM 1800,GSM850 (GSM800),WCDMA FDD Band 1 | Radio Interface: NONE")
    assert (got["nr"], got["nr_bands"], got["lte_bands"], got["gsm_bands"], got["umts_bands"]) == (1, [1, 78], [1, 32], [850, 1800], [1])
    assert (got["sa"], got["nsa"], got["options"], got["sunset"], got["unparsed"]) == (2, 1, "5G-5Series", 1, [])
    got = radio(spark, "5G NA Options: 5G-5Series | 4G: LTE FDD BAND 2", "Mobile Phone/Feature phone")
    assert (got["nr"], got["lte"], got["device_class"]) == (0, 1, "Feature phone")
    got = radio(spark, "LPWAN: Cat-NB1,Cat-M-LTEFDD LTE FDD BAND 25", "Modem")
    assert (got["lte"], got["sunset"], got["lte_m_bands"], got["device_class"]) == (1, 2, [25], "IoT / M2M")
    for bands in ("2G/3G: GSM 900", "LPWAN: EC-GSM-IoT", "Radio Interface: EDGE,GPRS", "Radio Interface: CDMA2000"):
        assert radio(spark, bands)["sunset"] == 3
    assert radio(spark, "SATELLITE: L-Band")["sunset"] == 0 and radio(spark, None)["lte"] == 2
    assert radio(spark, "2G/3G: whatever")["unparsed"] == ["2G/3G: whatever"]


def test_esim_and_ntn(spark):
    esim = {("0", "0"): 0, ("0", "00"): 2, ("1", "00"): 1, ("00", "2"): 1, ("", None): 2, ("x", "0"): 2}
    assert all(radio(spark, "", removable=a, fixed=b)["esim"] == want for (a, b), want in esim.items())
    got = radio(spark, "", ntn="3GPP NTN & TN(GSO, NGSO)")
    assert (got["ntn"], got["ntn_mode"], got["ntn_orbits"]) == (1, "NTN and TN", "GSO,NGSO")
    assert [radio(spark, "", ntn=x)["ntn"] for x in ("NO", "Not Known", "3GPP NTN Only")] == [0, 2, 1]


def test_numbers(spark):
    forms = ["9121234567", "+98 912 123 4567", "00989121234567", "09121234567", "(0912) 123-4567", "9809121234567", "98912", "abc", "0", "+"]
    rows = spark.createDataFrame([(x,) for x in forms], "n string").select(normal_number(F.col("n")).alias("n")).collect()
    assert [r["n"] for r in rows] == ["9121234567"] * 6 + ["98912", None, "0", None]
    cards = spark.createDataFrame([("8998110000000000123",), ("8998111112312345678",), ("8998",), (None,)], "c string").select(imsi_of_iccid(F.col("c")).alias("i")).collect()
    assert [r["i"] for r in cards] == ["432110000000123", None, None, None]


def test_survival(spark):
    """Ten spells: changes on days 2, 4, 4, 6, 8, others end or go on."""
    rows = [(0, d, o) for d, o in ((2, 1), (3, 2), (4, 1), (4, 1), (5, 3), (6, 1), (7, 3), (8, 1), (9, 2), (10, 3))] + [(0, 0, 4)]
    curve = planning.survival(spark.createDataFrame(rows, "cohort int, days int, outcome int"))
    want, left, at_risk = {}, 1.0, 10
    for day in range(1, 11):
        events = sum(d == day and o == 1 for _, d, o in rows[:10])
        if events:
            left *= 1 - events / at_risk
            want[day] = round(left, 6)
        at_risk -= sum(d == day for _, d, _ in rows[:10])
    assert {r["days"]: r["share"] for r in curve.collect()} == want
    figures = views.survival_figures(curve, [1, 4, 10]).first()
    assert (figures["at_1"], figures["at_4"], figures["at_10"]) == (1.0, want[4], want[8])
    assert figures["median_days"] == min(d for d, s in want.items() if s <= 0.5)


def test_compare_periods(spark):
    series = spark.createDataFrame([("2026-02-01", 10), ("2026-02-02", 20), ("2026-02-03", 40)], "d string, value int").selectExpr("cast(d as date) as data_date", "value")
    got = dashboard.compare_periods(series, "2026-02-03", "2026-02-04").first()
    assert (got["current"], got["base"], got["absolute"], got["percent"], got["uneven"]) == (40.0, 30.0, 10.0, round(1000 / 30, 6), True)
    level = dashboard.compare_periods(series, "2026-02-03", "2026-02-04", level=True).first()
    assert (level["current"], level["base"], level["uneven"]) == (40.0, 20.0, False)
    none = dashboard.compare_periods(series, "2026-03-01", "2026-03-02").first()
    assert none["current"] is None and none["percent"] is None


def test_risk_levels(spark):
    """Over the threshold: a signal; of all time or in doubt: an anomaly; two signalling families: a pattern."""
    rows = spark.createDataFrame(
        [("high_device_count_30", "sim", "s", 9, 9, None, 10, 1), ("high_device_count_30", "sim", "d", 9, 9, None, 10, 9), ("shared_imei_sims_ever", "imei", "i", 9, None, None, 0, 0), ("shared_imei_sims_30", "imei", "j", 9, 9, None, 10, 0), ("randomisation_20", "sim", "r", 9, None, 1, 10, 0)],
        "rule string, family string, key string, value long, raw_value long, tacs long, adds long, aside long",
    )
    limits = {"high_device_count_30": 5, "shared_imei_sims_ever": 5, "shared_imei_sims_30": 5, "randomisation_20": 5}
    none = spark.createDataFrame([], "rule string, flagged_days long")
    levels = {r["key"]: r["level"] for r in signals.assess(rows, limits, 1, 0.5, none).collect()}
    assert levels == {"s": 2, "d": 1, "i": 1, "j": 2, "r": 0}
    doubted = spark.createDataFrame([("shared_imei_sims_30", 2)], "rule string, flagged_days long")
    assert {r["key"]: r["level"] for r in signals.assess(rows, limits, 1, 0.5, doubted).collect()}["j"] == 1
    links = spark.createDataFrame([("sim", "s", "imei", "j"), ("imei", "j", "sim", "s"), ("sim", "d", "imei", "j")], "family string, key string, other_family string, other string")
    got = {r["key"]: r["level"] for r in signals.patterns(signals.assess(rows, limits, 1, 0.5, none), links).collect()}
    assert got == {"s": 3, "j": 3, "d": 2, "i": 1, "r": 0}
    views_ = {(r["key"], r["view"]) for r in signals.risk_list(rows, limits, 1, 0.5).collect()}
    assert views_ == {("s", "risk"), ("d", "data_quality"), ("i", "risk"), ("j", "risk")}
