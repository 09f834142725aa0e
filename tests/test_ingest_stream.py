"""Files, specifications and streams."""

from __future__ import annotations

from bindwell.operators import daily, fold
from bindwell.operators.explore import explore, export, prefix_ranges, route
from bindwell.sources import ingest
from bindwell.sources.feed import derived
from bindwell.sources.layouts import Journal
from bindwell.streaming import days

SF = "/root/testdata/sf0.001"


def test_validation(spark):
    lines = spark.createDataFrame([("9120,4321,35100100000001,add",), ("x,4321,1,add",), ("1,2",), ("1,2,,remove",), ("1,99999999999999999999,1,add",), ("1,2,12a,drop",)], "value string")
    accepted, findings = ingest.validate_rows(lines)
    assert sorted(map(tuple, accepted.collect())) == [(1, 2, "", "remove"), (9120, 4321, "35100100000001", "add")]
    got = {r["rule"]: r["n"] for r in ingest.quarantine_summary(findings, lines).collect()}
    assert got == {"msisdn_not_numeric": 1, "field_count": 1, "imei_empty": 1, "imsi_not_numeric": 1, "label_unknown": 1, "imei_not_digits": 1, "imei_length": 2}


def test_files_round_trip(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "delta_20260203.csv").write_text("msisdn,imsi,imei,label\n1,2,35100100000001,add\n")
    (folder / "delta_20260201.csv").write_text("msisdn,imsi,imei,label\n1,2,000000,remove\n3,4,35100100000009,add\n")
    rows = ingest.read_days(spark, str(folder))
    log = spark.createDataFrame([], days.SCHEMA)
    numbered = ingest.assign_sequence(log, rows)
    assert sorted((str(r["data_date"]), r["seq"], r["msisdn"]) for r in numbered.collect()) == [("2026-02-01", 1, 1), ("2026-02-01", 1, 3), ("2026-02-03", 2, 1)]
    ingest.replace_days(str(tmp_path / "log"), numbered)
    ingest.replace_days(str(tmp_path / "log"), numbered.where("seq = 2"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 3
    heads = {r["verdict"] for r in ingest.check_headers(spark, str(folder), ["msisdn", "imsi", "imei", "label"]).collect()}
    assert heads == {"ok"}
    assert {r["verdict"] for r in ingest.check_headers(spark, str(folder), ["imsi", "msisdn"]).collect()} == {"reject"}
    known = ingest.dedupe_files(spark, str(folder), spark.createDataFrame([], "sha256 string"))
    assert known.count() == 2 and ingest.dedupe_files(spark, str(folder), known.limit(1).cache()).count() == 1
    ingest.export_csv(spark.createDataFrame([("=1+1", 2)], "a string, b int"), str(tmp_path / "out"))
    assert "'=1+1" in "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))


def test_catalogue_versions(spark):
    columns = "tac string, manufacturer string"
    old = spark.createDataFrame([("35100100", "a"), ("35100200", "b"), ("35100300", "c")], columns)
    new = spark.createDataFrame([("35100100", "a"), ("35100200", "B"), ("35100400", " "), ("1", "d")], columns)
    got = {r["tac"]: r["change"] for r in ingest.diff_versions(old, new).collect()}
    assert got == {"35100100": "unchanged", "35100200": "updated", "35100300": "removed", "35100400": "added", "1": "added"}
    assert tuple(ingest.check_version(new).first()) == (4, 4, 1, 1, None)


def test_explore(spark):
    rows = spark.createDataFrame([(1, 10, "35100100000001", 1, "x", 0), (1, 11, "000000", 1, None, 1), (2, 10, "35100100000001", 0, "y", 0)], "msisdn long, imsi long, imei string, active int, label string, no_handset int")
    spec = {"by": ["msisdn"], "where": {"field": "label", "op": "!=", "value": "y"}, "measures": [{"kind": "count", "as": "n"}, {"kind": "countDistinct", "field": "imei", "as": "imeis", "active": True}], "sort": ["-n"], "limit": 5}
    assert [tuple(r) for r in explore(rows, spec).collect()] == [(1, 1, 1)]
    spec["where"] = {"all": [spec["where"], {"not": {"field": "imei", "op": "startsWith", "value": "99"}}]}
    assert [tuple(r) for r in explore(rows, spec).collect()] == [(1, 2, 1)]
    assert rows.where(prefix_ranges("imsi", "1", 2)).count() == 3


def test_stream_ends_like_the_batch(spark, tmp_path):
    feed = derived(spark, SF)
    events = feed.events.where("seq <= 9").cache()
    source, root = str(tmp_path / "source"), str(tmp_path / "root")
    for k in (1, 3, 2):  # the middle days come late, the others are the newest
        events.where(f"(seq - 1) div 3 = {k - 1}").coalesce(1).write.mode("append").parquet(source)
    days.stream_days(spark, source, feed.snapshot, root, feed.tac).awaitTermination()
    want = fold.fold_all(feed.snapshot, events)
    assert sorted(map(str, days.latest(spark, root).select(*want.columns).collect())) == sorted(map(str, want.collect()))
    marts = Journal(spark, root).table("change_summary")
    expected = daily.change_summary(events)
    assert sorted(map(str, marts.select(*expected.columns).collect())) == sorted(map(str, expected.collect()))
    for name, expected in (("dq_daily", daily.dq_daily(events, feed.tac)), ("history", fold.build_history(events)), ("multi_number", daily.multi_number_sims(events))):
        journal = Journal(spark, root)
        got = (journal.monthly(name) if name == "history" else journal.table(name)).select(*expected.columns)
        assert sorted(map(str, got.collect())) == sorted(map(str, expected.collect()))


def test_exports(spark, tmp_path):
    rows = spark.createDataFrame([(9120000001, 432110000000001, "35100100000001", 1, 0)], "msisdn long, imsi long, imei string, active int, no_handset int")
    export(rows, {"by": ["msisdn", "imei"], "measures": [{"kind": "count", "as": "n"}]}, str(tmp_path / "one"))
    text = "".join(p.read_text() for p in (tmp_path / "one").glob("part-*"))
    assert "912*****01" in text and "35100100******" in text
    ingest.export_tables({"a": rows, "b": rows}, str(tmp_path / "all"))
    assert list((tmp_path / "all" / "b").glob("part-*"))
    (tmp_path / "in" / "batch-1").mkdir(parents=True)
    (tmp_path / "in" / "batch-1" / "x.csv").write_text("msisdn,imsi,imei,label\n1,2,000000,add\n")
    ingest.to_parquet(spark, str(tmp_path / "in" / "batch-1"), str(tmp_path / "pq"))
    assert spark.read.parquet(str(tmp_path / "pq")).first().asDict() == {"msisdn": 1, "imsi": 2, "imei": "000000", "label": "add", "fname": "x.csv", "batch": "batch-1"}
    assert [route({"all": [{"field": "imsi", "op": "startsWith", "value": "43"}, {"field": "active", "op": "=", "value": 1}]})[0], route({"field": "imei", "op": "=", "value": "x"})[0]] == ["imsi", "imei"]


def test_missing_days(spark):
    log = spark.createDataFrame([("2026-02-01",), ("2026-02-04",), ("2026-02-05",)], "data_date string").selectExpr("cast(data_date as date) as data_date")
    assert sorted(str(r[0]) for r in daily.missing_days(log).collect()) == ["2026-02-02", "2026-02-03"]
    assert daily.missing_days(log.limit(0)).count() == 0
    assert tuple(map(str, daily.days_behind(log, "2026-02-09").first())) == ("2026-02-05", "4")
