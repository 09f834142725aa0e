"""Findings of round 3: keyed state, few files a day, sketches by chunk, and what one task holds."""

from __future__ import annotations

from pathlib import Path
from types import SimpleNamespace

from pyspark.sql import functions as F

from bindwell.operators import daily, fold, quality
from bindwell.plans import stored
from bindwell.plans.network import Tables
from bindwell.sources.feed import KEY
from bindwell.sources.layouts import Journal, Layouts
from bindwell.streaming import days

SF = "/root/testdata/sf0.001"


def rows_of(df, *columns):
    return sorted(map(str, df.select(*columns).collect()))


def test_keyed_state_is_spark_s_own_aggregate_on_disk(spark, tmp_path):
    """The fold runs no Python for a binding, keeps its state in RocksDB, and takes deliveries of many files."""
    t = Tables(spark, SF)
    log = SimpleNamespace(spark=spark, events=t.events.where("seq <= 9").repartition(6))
    source = stored._files(log, str(tmp_path), 3)
    assert len(list(Path(source).glob("*.parquet"))) > 3
    assert stored._a_delivery(log, source, 3) > 1
    query = days.stream_state(spark, source, str(tmp_path / "root"), stored._a_delivery(log, source, 3))
    query.awaitTermination()
    state = query.recentProgress[0]["stateOperators"][0]
    assert state["operatorName"] == "stateStoreSave"
    assert any(name.startswith("rocksdb") for name in state["customMetrics"])
    assert "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass", "")
    assert spark.conf.get("spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage", None) is None
    columns = [*KEY, "active", "last_change_seq", "last_change_date"]
    assert rows_of(days.folded(spark, str(tmp_path / "root")), *columns) == rows_of(fold.fold_all(t.snapshot.limit(0), log.events), *columns)


def test_a_batch_opens_few_files_a_day_and_reads_the_touched_ranges_once(spark, tmp_path, monkeypatch):
    """Days from many tasks land in a file each; the touched bindings are joined with the state once for all copies."""
    t = Tables(spark, SF)
    log = t.events.where("seq <= 8").repartition(8).cache()
    days.on_days(log.where("seq <= 6"), t.snapshot, str(tmp_path), 0)
    for name in ("log", "change_daily"):
        assert {len(list(p.glob("*.parquet"))) for p in tmp_path.glob(f"{name}/batch=0/data_date=*")} == {1}
    reads = []
    read = Layouts.read
    monkeypatch.setattr(Layouts, "read", lambda self, key, *args: reads.append(key) or read(self, key, *args))
    days.on_days(log.where("seq > 6"), t.snapshot, str(tmp_path), 1, marts=False)
    assert reads == ["msisdn", "msisdn"]  # for what changed, and for what stays
    assert not list(tmp_path.glob("change_daily/batch=1"))
    columns = [*KEY, "tac", "active", "last_change_seq", "last_change_date"]
    want = rows_of(fold.fold_all(t.snapshot, log), *columns)
    layouts, manifest = Layouts(spark, str(tmp_path)), Journal(spark, str(tmp_path)).manifest()
    for key in KEY:
        assert rows_of(layouts.read(key, manifest), *columns) == want


def test_quality_sketches_are_grouped_by_chunk_over_rows_derived_once(spark):
    """All chunks' figures come from one row a binding, however many categories it is in, and stay exact where they are counts."""
    t = Tables(spark, SF)
    chunks = quality.quality_chunks(t.state, t.history, t.tac, 7, chunks=4)
    assert chunks.inputFiles() and all("quality_amounts" in f for f in chunks.inputFiles())
    whole = chunks.groupBy("source", "category").agg(F.sum("bindings").alias("bindings"), F.sum("numbers").alias("numbers"), F.sum("periods").alias("periods"))
    now = daily.quality_current(t.state, t.tac).select(F.lit("current").alias("source"), "category", "bindings", "numbers", F.lit(0).cast("long").alias("periods"))
    then = daily.quality_history(t.history).select(F.lit("history").alias("source"), "category", "bindings", "numbers", "periods")
    assert rows_of(whole, *whole.columns) == rows_of(now.unionByName(then), *whole.columns)
