"""What is known of numbers, SIMs and handsets: bindings, events and timelines, for all asked keys at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bindwell.functions.rules import flag_handsets
from bindwell.operators import fold
from bindwell.sources.feed import KEY, tac_of


def with_model(rows: DataFrame, tac: DataFrame) -> DataFrame:
    """Adds brand and model of each row's TAC; null where the catalogue has none."""
    named = tac.select("tac", F.nullif(F.coalesce(F.nullif("brandName", F.lit("")), "manufacturer"), F.lit("")).alias("brand"), F.nullif("marketingName", F.lit("")).alias("model"))
    return rows.join(named, "tac", "left")


def bindings_of(flagged: DataFrame, tac: DataFrame, kind: str = "msisdn", most: int = 1000) -> DataFrame:
    """Bindings of every entity, active ones first, at most ``most`` of each."""
    order = Window.partitionBy(kind).orderBy(F.desc("active"), *[c for c in KEY if c != kind])
    rows = flagged.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    return with_model(rows, tac).select(*KEY, "tac", "brand", "model", "active", "last_change_date", "no_handset", "place")


def sim_left_out(flagged: DataFrame) -> DataFrame:
    """How many of a SIM's bindings are left out of its figures, as no handset carries them."""
    return flagged.where("no_handset = 1").groupBy("imsi").agg(F.count(F.lit(1)).alias("left_out"))


def sim_history(events: DataFrame, tac: DataFrame, start: str, end: str, most: int) -> DataFrame:
    """Events of every SIM in a window, newest first, ``most`` of each, and whether there are more.

    The range is on the column that the log is partitioned by, so other days are not opened.
    """
    inside = flag_handsets(events.where(F.col("data_date").between(start, end)), tac).where("no_handset = 0")
    order = Window.partitionBy("imsi").orderBy(F.desc("data_date"), F.desc("seq"), "msisdn", "imei")
    ranked = inside.withColumn("place", F.row_number().over(order)).withColumn("total", F.count(F.lit(1)).over(Window.partitionBy("imsi")))
    shown = ranked.where(F.col("place") <= most).withColumn("truncated", F.col("total") > most)
    return with_model(shown, tac).select("imsi", "data_date", "seq", "msisdn", "imei", "brand", "model", "label", "place", "truncated")


def _centred(bindings: DataFrame, tac: DataFrame, kind: str) -> DataFrame:
    """Without rows that no handset carries, unless the handset is what is asked about."""
    return bindings if kind == "imei" else flag_handsets(bindings.withColumn("tac", tac_of("imei")), tac).where("no_handset = 0").drop("tac", "known", "shifted", "no_handset", "countable")


def timeline(events: DataFrame, snapshot: DataFrame, state: DataFrame, tac: DataFrame, kind: str) -> DataFrame:
    """A line for every entity of ``kind``: when it was seen, its bindings and neighbours, idle events, and bindings whose
    history and current state disagree."""
    lives = _centred(fold.lifetimes(events, snapshot), tac, kind).withColumnRenamed("active", "held")
    rows = lives.join(state.select(*KEY, "active"), KEY, "left")
    active = F.coalesce("active", F.lit(0))
    others = [c for c in KEY if c != kind]
    seen = F.when(F.length("imei") == 14, F.col("imei"))
    return rows.groupBy(kind).agg(
        F.min("first_seen").alias("first_seen"), F.max("last_change").alias("last_change"), F.count(F.lit(1)).alias("bindings"), F.sum(active).alias("active"),
        *(F.count_distinct(seen if c == "imei" else F.col(c)).alias(f"{c}s") for c in others),
        F.sum("redundant").alias("redundant_adds"), F.sum("orphan").alias("orphan_removes"), F.count_if(F.col("held") != active).alias("mismatched"),
    )


def timeline_groups(events: DataFrame, snapshot: DataFrame, state: DataFrame, tac: DataFrame, kind: str, other: str) -> DataFrame:
    """For every entity and neighbour of another kind: bindings, whether one is active, and the union of their periods."""
    both = [kind, other]
    active = _centred(state, tac, kind).groupBy(*both).agg(F.max("active").alias("active"), F.count(F.lit(1)).alias("bindings"))
    united = fold.union_periods(_centred(fold.periods(events, snapshot), tac, kind), both)
    spans = united.groupBy(*both).agg(F.min("open").alias("first_seen"), F.count(F.lit(1)).alias("periods"), F.max(F.coalesce("close", F.lit("9999-12-31").cast("date"))).alias("until"))
    return active.join(spans, both, "left").select(*both, "bindings", "active", "first_seen", "periods", F.nullif("until", F.lit("9999-12-31").cast("date")).alias("until"))


def seen(history: DataFrame, kind: str) -> DataFrame:
    """First and last day of every entity in the history, and whether the dump has it."""
    return history.groupBy(kind).agg(F.count(F.lit(1)).alias("rows"), F.min("first_date").alias("first_date"), F.max("in_dump").alias("in_dump"), F.max("last_date").alias("last_date"))


def data_through(events: DataFrame) -> DataFrame:
    """The newest day of the log."""
    return events.agg(F.max("data_date").alias("data_through"))


def history_ready(events: DataFrame, history: DataFrame) -> DataFrame:
    """Event days, those that the history has not got, and whether it is complete with the dump."""
    days = events.select("data_date").distinct()
    written = history.select(F.explode("events.date").alias("data_date")).distinct()
    missing = days.join(written, "data_date", "left_anti").agg(F.count(F.lit(1)).alias("missing"))
    dump = history.agg(F.max("in_dump").alias("dump"))
    return days.agg(F.count(F.lit(1)).alias("days")).crossJoin(missing).crossJoin(dump).select("days", "missing", ((F.col("missing") == 0) & (F.col("dump") == 1)).alias("ready"))


def refresh_history(history: DataFrame, events: DataFrame, days: DataFrame) -> DataFrame:
    """The history after ``days`` came: their months are built again from the log, so that a day counts once."""
    months = days.select(F.date_format("data_date", "yyyyMM").cast("int").alias("month")).distinct()
    again = fold.build_history(events.withColumn("month", F.date_format("data_date", "yyyyMM").cast("int")).join(F.broadcast(months), "month", "left_semi").drop("month"))
    return history.join(F.broadcast(months), "month", "left_anti").unionByName(again)


def entity_kind(term: Column) -> Column:
    """Which key a term is looked up by."""
    return F.when(F.length(term) == 10, "msisdn").when(F.length(term) == 15, "imsi").when(F.length(term) == 14, "imei").otherwise("unknown")


def resolve(bindings: DataFrame, kind: str, most: int = 25) -> DataFrame:
    """Models behind every entity of a kind, the commonest ``most``."""
    whole = bindings.where(F.length("imei") == 14).groupBy(kind, F.substring("imei", 1, 8).alias("tac")).agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(kind).orderBy(F.desc("n"), "tac")
    return whole.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def entity_summary(state: DataFrame) -> DataFrame:
    """One line for every number, SIM and handset: bindings, active ones, neighbours of the other kinds and models."""
    whole = F.when(F.length("imei") == 14, F.substring("imei", 1, 8))
    one = lambda kind: state.groupBy(F.col(kind).cast("string").alias("term")).agg(
        F.count(F.lit(1)).alias("bindings"), F.sum("active").alias("active"), F.count_distinct("msisdn").alias("numbers"), F.count_distinct("imsi").alias("sims"), F.count_distinct(whole).alias("models")
    ).withColumn("kind", F.lit(kind))
    return one("msisdn").unionByName(one("imsi")).unionByName(one("imei"))
