"""Copies of the state, crash-safe days, routed questions, interval joins, streams with state, and the models' mart."""

from __future__ import annotations

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from bindwell.operators import fold, risk, tac_mart
from bindwell.operators.explore import choose, explore, explore_stored, routed
from bindwell.plans.network import Tables
from bindwell.sources.feed import KEY, derived
from bindwell.sources.layouts import Journal, Layouts
from bindwell.streaming import days

SF = "/root/testdata/sf0.001"
COLUMNS = [*KEY, "tac", "active", "last_change_seq", "last_change_date"]


def same(a, b):
    assert sorted(map(str, a.select(*COLUMNS).collect())) == sorted(map(str, b.select(*COLUMNS).collect()))


@pytest.fixture(scope="module")
def feed(spark):
    feed = derived(spark, SF)
    feed.events = feed.events.where("seq <= 12").cache()
    feed.snapshot = feed.snapshot.cache()
    return feed


def files(root, key):
    return {str(p.relative_to(root)) for p in Path(root).glob(f"by_{key}/batch=*/range=*/*.parquet")}


def test_copies_follow_each_batch_and_leave_other_ranges_alone(spark, tmp_path, feed):
    root = str(tmp_path)
    layouts = Layouts(spark, root, ranges=8)
    state = fold.fold_all(feed.snapshot, feed.events.where("seq < 12"))
    manifest = layouts.create(state, 0)
    for key in KEY:
        same(layouts.read(key, manifest), state)
    one = feed.events.where("seq = 12").orderBy(*KEY).limit(1).cache()
    touched = one.select(*KEY)
    changed = fold.fold_day(state.join(touched, KEY, "left_semi"), one).select(*COLUMNS).cache()
    before = {key: files(root, key) for key in KEY}
    after = layouts.update(manifest, touched, changed, 1)
    want = state.join(touched, KEY, "left_anti").select(*COLUMNS).unionByName(changed)
    for key in KEY:
        assert sum(batch == 1 for batch in after[key].values()) == 1  # one binding lies in one range of each copy
        assert before[key] <= files(root, key)
        same(layouts.read(key, after), want)
        same(layouts.read(key, manifest), state)  # the manifest before still reads what it did
        low = layouts.read(key, after).agg(F.min(key)).first()[0]
        assert layouts.ranges_between(key, low, low) == [0]
    gone = layouts.update(after, touched, changed.limit(0), 2)
    same(layouts.read("imei", gone), state.join(touched, KEY, "left_anti"))


def test_a_batch_that_dies_anywhere_is_as_if_it_had_not_come(spark, tmp_path, feed, monkeypatch):
    """Each write of the batch that replaces a day is made to fail once; then the batch comes again."""
    root = str(tmp_path)
    first = feed.events.where("seq <= 6").cache()
    days.on_days(first, feed.snapshot, root, 0)
    lost = first.where("seq = 3").orderBy(*KEY).limit(1).select(*KEY).collect()[0]  # the new delivery lacks this one
    again = first.where("seq = 3").where(~((F.col("msisdn") == lost["msisdn"]) & (F.col("imsi") == lost["imsi"]) & (F.col("imei") == lost["imei"]))).cache()
    want = fold.fold_all(feed.snapshot, first.where("seq <> 3").unionByName(again))
    before = fold.fold_all(feed.snapshot, first)
    writer = type(spark.range(1).write)
    write, count, limit = writer.parquet, [0], [0]

    def failing(self, path, *args, **kwargs):
        count[0] += 1
        if count[0] == limit[0]:
            raise RuntimeError("executor lost")
        return write(self, path, *args, **kwargs)

    monkeypatch.setattr(writer, "parquet", failing)
    for step in range(1, 60, 4):
        count[0], limit[0] = 0, step
        try:
            days.on_days(again, feed.snapshot, root, 1)
            break
        except RuntimeError:
            same(days.latest(spark, root), before)
    assert step > 8
    same(days.latest(spark, root), want)
    count[0], limit[0] = 0, 1
    days.on_days(again, feed.snapshot, root, 1)  # finished batches are not taken twice
    assert count[0] == 0
    history = Journal(spark, root).monthly("history")
    expected = fold.build_history(first.where("seq <> 3").unionByName(again)).select(*history.columns)
    assert sorted(map(str, history.collect())) == sorted(map(str, expected.collect()))
    log = Journal(spark, root).table("log", days.SCHEMA)
    assert log.count() == first.where("seq <> 3").count() + again.count()


def test_a_day_without_changes_takes_the_old_ones_place(spark, tmp_path, feed):
    root = str(tmp_path)
    days.on_days(feed.events.where("seq <= 2"), feed.snapshot, root, 0)
    assert Journal(spark, root).table("change_summary").where("data_date = '2026-01-26'").count() == 1
    only_add = feed.events.where("seq = 1 and label = 'add'")
    days.on_days(only_add, feed.snapshot, root, 1)
    day = Journal(spark, root).table("sim_changes").where("data_date = '2026-01-26'")
    assert day.count() == 0
    assert Journal(spark, root).table("change_summary").where("data_date = '2026-01-26'").first()["removed"] == 0


def test_deliveries_keep_evidence_and_marts(spark, tmp_path, feed):
    root = str(tmp_path)
    days.on_days(feed.events.where("seq <= 8"), feed.snapshot, root, 0, feed.tac, feed.vendors)
    days.on_days(feed.events.where("seq > 8"), feed.snapshot, root, 1, feed.tac, feed.vendors)
    journal = Journal(spark, root)
    from bindwell.functions.rules import flag_handsets
    from bindwell.operators import daily
    from bindwell.operators.marts import kpi, with_vendor

    expected = daily.sim_change_evidence(feed.events, daily.multi_number_sims(feed.events), daily.dq_daily(feed.events, feed.tac))
    got = journal.table("sim_change_evidence").select(*expected.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, expected.collect()))
    whole = tac_mart.kpi_of(tac_mart.under(journal.latest("state_mart"), with_vendor(feed.tac, feed.vendors), {"with_unknown": True}))
    want = kpi(flag_handsets(fold.fold_all(feed.snapshot, feed.events), feed.tac), feed.tac).first()
    found = tac_mart.estimated(whole).first()
    assert all(found[c] == want[c] for c in (*tac_mart.COUNTS, "tac_matched"))
    assert all(abs(found[c] - want[c]) <= 0.03 * want[c] + 1 for c in tac_mart.SKETCHES)
    assert {r["ok"] for r in tac_mart.expectations(journal.latest("dimension_mart"), whole).collect()} == {True}


SPECS = [
    {"where": {"field": "msisdn", "op": "=", "value": 9120000007}},
    {"where": {"all": [{"field": "imsi", "op": "startsWith", "value": "43211000000001"}, {"field": "active", "op": "=", "value": 1}]}},
    {"where": {"all": [{"all": [{"field": "imei", "op": "startsWith", "value": "351000"}]}]}},
    {"where": {"field": "tac", "op": "in", "value": ["35100003", "35100700"]}},
    {"where": {"any": [{"field": "msisdn", "op": "=", "value": 9120000007}, {"field": "active", "op": "=", "value": 0}]}},
    {"where": {"not": {"field": "imsi", "op": "startsWith", "value": "43"}}},
]


def test_routed_questions(spark, feed):
    t = Tables(spark, SF)
    layouts, manifest = t.copies
    for spec in SPECS:
        whole = {"by": list(KEY), "measures": [{"kind": "count", "as": "n"}]} | spec
        assert sorted(map(tuple, explore_stored(layouts, manifest, whole, t.tac).collect())) == sorted(map(tuple, explore(t.flagged, whole).collect()))
    kinds = [(choose(s["where"]).layout, choose(s["where"]).kind) for s in SPECS]
    assert kinds == [("msisdn", "key"), ("imsi", "range"), ("imei", "range"), ("imei", "range"), ("msisdn", "scan"), ("msisdn", "scan")]
    assert choose({"field": "deviceType", "op": "=", "value": "x"}, ["35100003"]).ranges == (("35100003", "35100003:"),)
    rows = layouts.read("imei", manifest)
    asked = routed(layouts, manifest, {"where": {"field": "imei", "op": "=", "value": rows.where("length(imei) = 14").first()["imei"]}}, t.tac)
    plan = asked._jdf.queryExecution().executedPlan().toString()
    assert "by_imei" in plan and "GreaterThanOrEqual(imei" in plan and "by_msisdn" not in plan
    read = layouts.read("imei", manifest, layouts.ranges_between("imei", "351", "351"))
    assert 0 < read.count() < rows.count() / 4  # one range of many


def test_interval_join_of_any_number_of_ranges(spark):
    rng = random.Random(3)
    for n, rows in ((10, 3000), (100_000, 20_000), (0, 5)):
        ranges = [(str(k), low := rng.randrange(10**6), low + rng.choice([0, 1, 9, 10, 99, 12345]) - (1 if k % 97 == 96 else 0)) for k in range(n)]
        few = spark.createDataFrame(ranges, "prefix string, low long, high long")
        keys = spark.range(rows).select(((F.col("id") * 7919) % 1_000_000).alias("imsi"))
        got = risk.interval_join(keys, "imsi", few)
        if n <= 10:
            want = keys.join(F.broadcast(few), F.col("imsi").between(F.col("low"), F.col("high")))
            assert sorted(map(tuple, got.select("imsi", "prefix").collect())) == sorted(map(tuple, want.select("imsi", "prefix").collect()))
        else:
            import numpy as np

            low, high = np.array([r[1] for r in ranges]), np.array([r[2] for r in ranges])
            values = np.array([r[0] for r in keys.collect()])
            good = low <= high
            expected = sum(int(((values >= a) & (values <= b)).sum()) for a, b in zip(low[good][:3000], high[good][:3000], strict=True))
            some = {str(k) for k in np.flatnonzero(good)[:3000]}
            assert sum(r["prefix"] in some for r in got.collect()) == expected


def test_stateful_fold_over_shuffled_days_and_a_restart(spark, tmp_path, feed):
    source, root = str(tmp_path / "source"), str(tmp_path / "root")
    put = lambda rows: rows.select("seq", "data_date", *KEY, "tac", "label").coalesce(1).write.mode("append").parquet(source)
    for k in (3, 1):
        put(feed.events.where(f"seq % 4 = {k}"))
    days.stream_state(spark, source, root).awaitTermination()
    put(feed.snapshot.selectExpr("0 as seq", "cast(null as date) as data_date", *KEY, "'' as tac", "'add' as label"))
    for k in (2, 0):
        put(feed.events.where(f"seq % 4 = {k}"))
    days.stream_state(spark, source, root).awaitTermination()  # goes on from the checkpoint
    same(days.folded(spark, root), fold.fold_all(feed.snapshot, feed.events))


def test_windows_take_late_rows_and_count_those_too_late(spark, tmp_path):
    source, root = str(tmp_path / "source"), str(tmp_path / "root")
    schema = days.SCHEMA

    def deliver(dates):
        rows = [(k, d, 1, 1, "x", "", "add") for k, d in enumerate(dates)]
        frame = spark.createDataFrame(rows, schema.replace("data_date date", "data_date string")).withColumn("data_date", F.to_date("data_date"))
        frame.coalesce(1).write.mode("append").parquet(source)
        query = days.stream_windows(spark, source, root, "7 days", "1 day", "7 days")
        query.awaitTermination()
        return days.too_late(query)

    assert deliver(["2026-03-01", "2026-03-20"]) == 0
    assert deliver(["2026-03-18"]) == 0  # late, but within the watermark
    assert deliver(["2026-02-01", "2026-03-21"]) == 7  # seven windows of a row that is too late
    got = {(str(r["start"])[:10], r["n"]) for r in days.windows(spark, root).collect()}
    assert ("2026-03-18", 3) in got and ("2026-03-14", 2) in got and ("2026-03-15", 3) in got
    assert not any(s.startswith("2026-01") for s, _ in got)


def test_lensed_figures_come_from_the_mart_alone(spark):
    t = Tables(spark, SF)
    from bindwell.operators import dashboard

    for lens in ({"system": "Android"}, {"vendor": "Maker A", "device_type": "Smartphone"}, {"manufacturer": "nobody"}, {}):
        got = tac_mart.estimated(tac_mart.kpi_of(tac_mart.under(t.mart, t.devices, lens)))
        want = dashboard.kpi_under(dashboard.apply_lens(t.flagged, t.devices, lens)).first()
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "tac_mart" in plan and "/state-" not in plan and "/events-" not in plan
        found = got.first()
        assert all(found[c] == want[c] for c in (*tac_mart.COUNTS, "tac_matched", "coverage"))
        assert all(abs(found[c] - want[c]) <= 0.03 * want[c] + 1 for c in tac_mart.SKETCHES)
    with pytest.raises(ValueError, match="numbers"):
        tac_mart.under(t.mart, t.devices, {"number_prefix": "912"})


def test_published_quality_merges_chunks(spark):
    from bindwell.operators import daily
    from bindwell.plans.stored import _published

    t = Tables(spark, SF)
    got = {(r["source"], r["category"]): r for r in _published(t).collect()}
    exact = [("current", r) for r in daily.quality_current(t.state, t.tac).collect()] + [("history", r) for r in daily.quality_history(t.history).collect()]
    assert set(got) == {(source, r["category"]) for source, r in exact}
    for source, r in exact:
        found = got[source, r["category"]]
        assert (found["run_id"], found["bindings"], found["numbers"]) == (2, r["bindings"], r["numbers"])
        assert all(abs(found[c] - r[c]) <= 0.03 * r[c] + 1 for c in ("sims", "imeis"))


def test_derived_tables_are_made_anew_after_a_change(spark, tmp_path):
    from bindwell.sources.store import forget, kept

    path = str(tmp_path / "t")
    spark.range(3).write.parquet(path)
    make = lambda: spark.read.parquet(path)
    assert kept(spark, path, "copy", make).count() == 3
    spark.range(2).write.mode("append").parquet(path)
    assert kept(spark, path, "copy", make).count() == 3
    forget(path)
    assert kept(spark, path, "copy", make).count() == 5
