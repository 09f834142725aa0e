"""Risk and lens queries at size: nothing of the state is shuffled to be looked up, nothing is sorted to be aggregated."""

from __future__ import annotations

import datetime as dt
import os

import public_tokenizers
from pyspark.sql import functions as F

from bindwell.functions import rules
from bindwell.llm.packing import pack
from bindwell.operators import dashboard, fold, risk, signals
from bindwell.plans.network import AS_OF, Tables

SF = "/root/testdata/sf0.001"
plan_of = lambda df: df._jdf.queryExecution().executedPlan().toString()


def test_look_ups_of_any_text_do_not_shuffle_the_table(spark):
    tacs = [("35100001",), ("99999999",), ("00000000",), ("-1234567",), ("3510000A",), (" 3510002",), (None,), ("351",), ("12345678",), ("12345678\n",)]
    tac = spark.createDataFrame(tacs, "tac string")
    imeis = ["35100001000010", "51000010000000", "-1234567000000", "3510000A000000", " 3510002000000", "99999999999990", "23456780000000", "10000A00000000", "351", "", None, "00000000000000", "51000010000001"]
    rows = spark.createDataFrame([(k, i, i[:8] if i and len(i) == 14 else "") for k, i in enumerate(imeis)], "k int, imei string, tac string")
    got = {r["imei"]: (r["known"], r["shifted"]) for r in rules.flag_handsets(rows, tac).collect()}
    known, tails = {t for (t,) in tacs if t}, {t[1:8] for (t,) in tacs if t}
    for i in imeis:
        if i is not None:
            whole, is_known = len(i) == 14, len(i) == 14 and i[:8] in known
            assert got[i] == (int(is_known), int(whole and not is_known and i.endswith("0") and i[:7] in tails)), i
    assert len(got) == len(imeis)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for a catalogue of any size
    try:
        assert "SortMergeJoin" not in plan_of(rules.flag_handsets(rows, tac.where("tac rlike '^[0-9]{8}$'")))
        feed = Tables(spark, SF)
        lens = dashboard.apply_lens(feed.flagged, feed.tac.withColumn("vendor", F.col("manufacturer")), {"vendor": "Maker A Korea", "device_type": "Smartphone"})
        assert "SortMergeJoin" not in plan_of(lens)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_fold_compares_statements_as_structs_do(spark):
    day = dt.date(2026, 3, 1)
    said = [
        (1, day, 3, "add"), (1, day, 3, "remove"), (2, day, 4, "add"), (2, dt.date(2026, 2, 1), 9, "remove"), (3, None, None, "add"), (4, day, None, None), (5, dt.date(1, 1, 1), -(2**31), "aaa"),
        (6, dt.date(9999, 12, 31), 2**31 - 1, "add"), (7, day, 1, "zzz"), (7, day, 1, "add"), (8, day, None, "add"), (8, day, -5, "remove"), (9, None, 7, "remove"),
    ]
    events = spark.createDataFrame([(m, 1, "35100001000010", d, s, label) for m, d, s, label in said], "msisdn long, imsi long, imei string, data_date date, seq int, label string")
    snapshot = spark.createDataFrame([(m, 1, "35100001000010") for m in (1, 3, 9, 10)], "msisdn long, imsi long, imei string")
    out = fold.fold_all(snapshot, events)
    last = fold._versions(snapshot, events).groupBy(*fold.KEY).agg(F.max(F.struct("rank", "date", "seq", "label")).alias("last"))
    want = last.select("msisdn", (F.col("last.label") == "add").cast("int").alias("active"), "last.seq", "last.date")
    assert sorted(map(str, map(tuple, out.select("msisdn", "active", "last_change_seq", "last_change_date").collect()))) == sorted(map(str, map(tuple, want.collect())))
    assert "SortAggregate" not in plan_of(out)


def test_windows_and_assessment_are_aggregated_in_hash_tables(spark):
    t = Tables(spark, SF)
    for window in (risk.sim_window, risk.imei_window):
        apart, shared = window(t.events, t.tac, t.multi, AS_OF, floor=1), window(t.events, t.tac, t.multi, AS_OF, floor=1, adds=t.adds)
        assert sorted(map(str, apart.collect())) == sorted(map(str, shared.collect()))
        assert "SortAggregate" not in plan_of(shared) and "ObjectHashAggregate" not in plan_of(shared)
    rows = spark.createDataFrame(
        [("sim", "a", "randomisation_20", 9, None, 2, 4, 0), ("sim", "a", "high_device_count_30", 3, 3, None, 4, 0), ("sim", "a", "rapid_device_change_7", 0, 0, None, 4, 3), ("imei", "b", "shared_imei_sims_ever", None, None, None, 0, 0)],
        "family string, key string, rule string, value long, raw_value long, tacs long, adds long, aside long",
    )
    none = spark.createDataFrame([], "rule string, flagged_days long")
    done = signals.assess(rows, {r.name: 1 for r in signals.RULES}, 1, 0.5, none)
    assert {r["key"]: (r["level"], r["assessable"], r["reasons"]) for r in done.collect()} == {
        "a": (2, False, "high_device_count_30:2:3,randomisation_20:2:9,rapid_device_change_7:0:0"), "b": (0, True, "shared_imei_sims_ever:0"),
    }
    assert "ObjectHashAggregate" not in plan_of(done)


def test_packing_is_the_same_for_slices_of_any_size(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet") if os.path.exists(f"{SF}/documents.parquet") else spark.range(40).select(F.col("id").alias("doc_id"), F.repeat(F.concat(F.lit("word "), "id", F.lit(" ")), F.col("id").cast("int") * 9).alias("text"))
    packed = [sorted(map(tuple, pack(docs, public_tokenizers.path("byte_bpe_50k.json"), slice_bytes=n).select("doc_id", "piece", "start", "length", "ids_crc32").collect())) for n in (1, 6 << 20)]
    assert packed[0] == packed[1] and packed[0]
