"""Catalogue files and versions, sources whose last update counts, models of a number, the dump's reader."""

from __future__ import annotations

import datetime as dt

import pytest

from bindwell.operators import planning
from bindwell.sources import catalogue, ingest


def line(tac, name="x", fields=26):
    cells = [tac, "maker", "model", name, *[""] * 22]
    return ",".join('"' + c.replace('"', '""') + '"' if any(s in c for s in ',"\n') else c for c in (cells + ["y"])[:fields])


def write(path, *lines):
    path.write_text("\n".join([",".join(catalogue.COLUMNS), *lines]) + "\n")
    return str(path)


def test_scan_names_each_defect(spark, tmp_path):
    path = write(
        tmp_path / "a.csv", line("35000001", 'a "quoted", name\nover two lines'), line("35000002", fields=25), line("35000003", fields=27), line("35000001"), line("3500000x"), "35000004,stray quote\"," + "," * 23,
    )
    scan = catalogue.scan_records(catalogue.read_records(spark, path)).first()
    assert (scan["records"], scan["malformed"], scan["not_eight_digits"], scan["repeated_tacs"], scan["repeated_records"], scan["accepted"]) == (6, 2, 1, 1, 1, False)
    assert len(scan["malformed_samples"]) == 2 and scan["repeated_samples"] == ["35000001"]
    rows = {r["tac"]: r for r in catalogue.read_catalogue(spark, path, 7).collect()}
    assert rows["35000004"]["manufacturer"] == 'stray quote"' and rows["35000004"]["version_id"] == 7 and len(rows) == 3
    good = catalogue.scan_records(catalogue.read_records(spark, write(tmp_path / "b.csv", line("35000001", "x\ny"), line("35000002")))).first()
    assert (good["records"], good["malformed"], good["accepted"], good["malformed_samples"], good["repeated_samples"]) == (2, 0, True, [], [])
    (tmp_path / "c.csv").write_text("tac,manufacturer\n1,2\n")
    with pytest.raises(ValueError, match="lacks"):
        catalogue.read_records(spark, str(tmp_path / "c.csv"))
    empty = catalogue.scan_records(catalogue.read_records(spark, write(tmp_path / "d.csv"))).first()
    assert (empty["records"], empty["accepted"]) == (0, True)


def test_versions_are_loaded_activated_and_dropped(spark, tmp_path):
    versions = catalogue.Versions(spark, str(tmp_path / "versions"))
    assert versions.present() == [] and versions.active() is None
    versions.load(write(tmp_path / "1.csv", line("35000001", "one")), 1)
    versions.load(write(tmp_path / "2.csv", line("35000001", "two"), line("35000002")), 2)
    assert not versions.load(write(tmp_path / "3.csv", line("35000001"), line("35000001")), 3).first()["accepted"]
    assert versions.present() == [1, 2]
    versions.activate(1)
    versions.activate(2)
    assert versions.active() == 2 and versions.rows().count() == 2
    versions.activate(1)
    assert versions.rows().first()["marketingName"] == "one"
    with pytest.raises(ValueError, match="active"):
        versions.drop(1)
    versions.drop(2)
    assert versions.present() == [1]
    for call in (lambda: versions.activate(2), lambda: versions.rows(2)):
        with pytest.raises(ValueError, match="version"):
            call()


def test_the_last_update_of_a_spelling_counts(spark):
    at = lambda h: dt.datetime(2026, 1, 1, h)
    updates = spark.createDataFrame([("a", "A", at(1)), ("a", "B", at(3)), ("a", "C", at(2)), ("b", "X", at(1)), ("b", "", at(2)), ("c", "Y", at(1)), ("c", "Z", at(1))], "raw_manufacturer string, vendor_canonical string, updated_at timestamp")
    assert sorted(map(tuple, catalogue.vendor_map(updates).collect())) == [("a", "B"), ("c", "Z")]


def test_first_rows_of_a_finding(spark):
    findings = spark.createDataFrame([("r", k, f"line {k}") for k in range(500, 0, -1)] + [("s", 7, "x")], "rule string, row long, value string")
    got = {r["rule"]: (r["first_row"], r["samples"]) for r in catalogue.first_rows(findings, "rule", "row").collect()}
    assert got == {"r": (1, ["line 1", "line 2", "line 3"]), "s": (7, ["x"])}


def test_models_of_a_number_with_many(spark):
    stage = spark.createDataFrame([(n, f"{35000000 + k}") for n, most in ((1, 300), (2, 2)) for k in range(most) for _ in range(2)] + [(3, "")], "msisdn long, tac string")
    got = {r["msisdn"]: (r["models"], r["n_models"]) for r in planning.number_models(stage).collect()}
    assert got == {1: ([f"{35000000 + k}" for k in range(64)], 300), 2: (["35000000", "35000001"], 2)}


def test_spells_of_numbers_that_are_not_assessed(spark):
    day = lambda n: dt.date(2026, 2, n)
    imei = lambda k: f"35{k * 7:06d}{k * 10:06d}"
    rows = [(1, imei(k), day(1), None, 0) for k in range(41)] + [(2, imei(k), day(1), None, 0) for k in range(21)]
    rows += [(3, "35000001000005", day(1), day(10), 1), (3, "35000001000006", day(1), None, 0), (3, "35000900000001", day(12), None, 0)]
    got = planning.spell_events(spark.createDataFrame(rows, "msisdn long, imei string, start date, finish date, dump int"), "2026-02-28").collect()
    assert sorted((r["msisdn"], r["outcome"]) for r in got if r["msisdn"] < 3) == [(1, 4), (2, 4)]
    assert sorted((r["imei"], r["outcome"], r["days"], r["cohort"], r["month"], r["next_imei"]) for r in got if r["msisdn"] == 3) == [
        ("35000001000005", 1, 11, 0, 202602, "35000900000001"), ("35000900000001", 3, 16, 202602, 0, None),
    ]


def test_dump_and_backfill(spark, tmp_path):
    (tmp_path / "dump.csv").write_text("imei,imsi,msisdn\n35100100000001,2,1\n")
    assert [tuple(r) for r in ingest.read_dump(spark, str(tmp_path / "dump.csv")).collect()] == [(1, 2, "35100100000001")]
    days = spark.createDataFrame([(dt.date(2026, 2, d),) for d in (1, 2, 3, 9)], "data_date date")
    got = ingest.backfill_days(days.where("data_date = '2026-02-02'"), days, "2026-02-01", "2026-02-05")
    assert sorted(r[0].day for r in got.collect()) == [1, 3]
