"""Findings F7 to F19 of round 3: what one task holds, reads or parses, and how many rows a search makes."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindwell.functions import rules
from bindwell.functions.radio import parse_radio
from bindwell.functions.rules import countable_rows, flag_handsets
from bindwell.operators import daily, devices, marts, risk
from bindwell.plans.network import Tables
from bindwell.sources.store import spread

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_only_imeis_that_may_have_lost_a_digit_are_looked_up(spark):
    """Countable rows are those of the flags, nulls, repeats and odd signs included; the joins see one IMEI in ten."""
    t = Tables(spark, SF)
    odd = spark.createDataFrame([(None, ""), ("", ""), ("0" * 14, "0" * 8), ("3510000000000x", "3510000x"), ("35100001000000", "35100001"), ("51000010000000", "51000010"), ("51000010000001", "51000010")], "imei string, tac string")
    rows = t.events.select("imei", "tac").unionByName(odd).unionByName(odd)
    got = countable_rows(rows, t.tac)
    assert rows_of(got) == rows_of(flag_handsets(rows, t.tac).where("countable = 1").select("imei", "tac"))
    text = got._jdf.queryExecution().optimizedPlan().toString()
    assert "NOT EndsWith(imei" in text and " EndsWith(imei" in text


def test_parts_have_a_bounded_number_of_rows(spark):
    rows = spark.range(10_000)
    parts = spread(rows, rows, "id", most=500)
    assert parts.rdd.getNumPartitions() == 20
    assert max(r["count"] for r in parts.groupBy(F.spark_partition_id()).count().collect()) < 1_000
    t = Tables(spark, SF)
    assert rows_of(daily.handset_day(t.events, t.tac)) == rows_of(daily.tac_day(t.events, t.tac).select("data_date", "tac", "handsets"))
    assert rows_of(marts.tac_holders(t.flagged)) == rows_of(marts.tac_population(t.flagged).where("tac <> ''").select("tac", "handsets", "sims"))


def test_a_large_catalogue_is_not_broadcast(spark, monkeypatch):
    t = Tables(spark, SF)
    firsts = lambda: devices.arrivals(devices.first_days(daily.handset_day(t.events, t.tac), daily.tac_dump(t.snapshot, t.tac)), t.tac, "month")
    small = firsts()
    assert "BroadcastHashJoin" in small._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(rules, "MOST_BROADCAST", 10)
    large = firsts()
    assert "BroadcastHashJoin" not in large._jdf.queryExecution().executedPlan().toString()
    assert rows_of(large) == rows_of(small)


def test_a_band_text_is_parsed_once_and_by_many_tasks(spark, tmp_path):
    """A catalogue of one file is parsed in more than one task, and by distinct text; rows and repeats stay as they are."""
    one = str(tmp_path / "one")
    tac = Tables(spark, SF).tac
    tac.unionByName(tac.limit(3)).unionByName(tac.limit(1).withColumn("bandDetails", F.lit(None).cast("string"))).coalesce(1).write.parquet(one)
    profiles = parse_radio(spark.read.parquet(one))
    assert profiles.rdd.getNumPartitions() >= 4
    assert profiles.count() == tac.count() + 4
    assert profiles.where("options is null or unparsed is null or bands_listed is null").count() == 0
    text = profiles._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(bandDetails" in text and "REPARTITION_BY_NUM" in text


def test_a_search_counts_blocks_instead_of_pairs(spark):
    """Pages and counts of any ranges equal those of all pairs: single numbers, nested, repeated, empty and very long ranges, negative bounds."""
    spots = [(p, lo, hi) for p, lo, hi in (("a", 95, 1205), ("b", 0, 9), ("c", 7, 7), ("d", -5, 10**18), ("e", 100, 99), ("f", 90, 110), ("f", 90, 110), ("f", 105, 2000), ("g", 999, 1000), ("h", 5000, 6000))]
    ranges = spark.createDataFrame(spots, "prefix string, low long, high long")
    key = F.col("id")
    flagged = spark.range(3000).select(
        (key % 37).alias("msisdn"), (key * key % 2003).alias("imsi"), key.cast("string").alias("imei"), (key % 3).cast("string").alias("tac"), (key % 5 != 0).cast("int").alias("active"),
        (key % 7 == 0).cast("int").alias("no_handset"), F.lit("2026-03-01").cast("date").alias("last_change_date"),
    )
    models = spark.createDataFrame([("0", "M", "N", "Tablet", ""), ("1", "M", "N", "Smartphone", "")], "tac string, manufacturer string, marketingName string, deviceType string, operatingSystem string")
    got = risk.search_sims(flagged, ranges, models, 4, active=True, device_type="Smartphone").select("prefix", "place", "imsi", "msisdn", "imei", "total", "left_out").collect()
    rows = [(r["imsi"], r["msisdn"], r["imei"], r["no_handset"] == 0 and r["active"] == 1 and r["tac"] == "1", r["no_handset"]) for r in flagged.collect()]
    want = []
    for p in "abcdefgh":
        hits = [r for q, lo, hi in spots if q == p for r in rows if lo <= r[0] <= hi]
        shown = sorted(r[:3] for r in hits if r[3])
        want += [(p, k, *r, len(shown), sum(x[4] for x in hits)) for k, r in enumerate(shown[:4], 1)]
    assert sorted(map(tuple, got)) == want
    blocks = risk._range_blocks(ranges)
    assert max(r["count"] for r in blocks.groupBy("prefix", "low", "nth", "level").count().collect()) <= 18
