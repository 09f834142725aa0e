"""From events to state, lifetimes and history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bindwell.sources.feed import KEY, tac_of

#: The undated dump stands for this day where a date is needed.
DUMP_DAY = "1970-01-01"
#: Days from before the year 1 to 1970, so that every date is a positive number.
DAYS = 800_000


def _versions(snapshot: DataFrame, events: DataFrame) -> DataFrame:
    """Every statement about a binding with its rank: an event beats the dump; date, sequence and label order events."""
    first = snapshot.select(*KEY, F.lit(0).alias("rank"), F.lit(None).cast("date").alias("date"), F.lit(0).alias("seq"), F.lit("add").alias("label"))
    later = events.select(*KEY, F.lit(1).alias("rank"), F.col("data_date").alias("date"), "seq", "label")
    return first.unionByName(later)


def _statement():
    """Rank, date, sequence and label of a statement as one number that sorts as they do, nulls first (dates of the years 1 to 9999).

    The largest of whole numbers is found in hash tables; that of structs with a text would sort all rows twice.
    """
    label = F.when(F.col("label") < "add", 1).when(F.col("label") == "add", 2).when(F.col("label") > "add", 3).otherwise(0)
    date = F.coalesce(F.unix_date("date") + DAYS, F.lit(0))
    seq = F.coalesce(F.col("seq").cast("int").cast("long") + (2**31 + 1), F.lit(0))
    return F.col("rank").cast("long") * 2**57 + date.cast("long") * 2**35 + seq * 4 + label


def fold_all(snapshot: DataFrame, events: DataFrame) -> DataFrame:
    """Current state: the last statement of each binding decides it (one partial aggregate, one shuffle)."""
    folded = _versions(snapshot, events).groupBy(*KEY).agg(F.max(_statement()).alias("last"))
    label, seq, date = F.expr("last & 3"), F.expr(f"shiftright(last, 2) & {2**33 - 1}L"), F.expr(f"shiftright(last, 35) & {2**22 - 1}")
    return folded.select(
        *KEY, tac_of("imei").alias("tac"), F.when(label > 0, (label == 2).cast("int")).alias("active"),
        F.when(seq > 0, seq - (2**31 + 1)).cast(events.schema["seq"].dataType).alias("last_change_seq"),
        F.when(date > 0, F.date_from_unix_date((date - DAYS).cast("int"))).alias("last_change_date"),
    )


def fold_day(state: DataFrame, day: DataFrame) -> DataFrame:
    """State after one newest day: the day's last statement where there is one, else what was."""
    news = day.groupBy(*KEY).agg(F.max(F.struct("data_date", "seq", "label")).alias("news"))
    joined = state.join(news, KEY, "full_outer")
    changed = F.col("news").isNotNull()
    return joined.select(
        *KEY, tac_of("imei").alias("tac"),
        F.when(changed, (F.col("news.label") == "add").cast("int")).otherwise(F.col("active")).alias("active"),
        F.when(changed, F.col("news.seq")).otherwise(F.col("last_change_seq")).alias("last_change_seq"),
        F.when(changed, F.col("news.data_date")).otherwise(F.col("last_change_date")).alias("last_change_date"),
    )


def refold_keys(state: DataFrame, events: DataFrame, snapshot: DataFrame, keys: DataFrame) -> DataFrame:
    """State after a late or replaced day: exactly the touched bindings are derived again from all history."""
    touched = keys.select(*KEY).distinct()
    again = fold_all(snapshot.join(touched, KEY, "left_semi"), events.join(touched, KEY, "left_semi"))
    return state.join(touched, KEY, "left_anti").unionByName(again)


def fold_outcomes(events: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Each event with what it did: applied, redundant_add or orphan_remove."""
    order = Window.partitionBy(*KEY).orderBy("data_date", "seq", "label")
    held = snapshot.select(*KEY, F.lit("add").alias("_dump"))
    before = F.coalesce(F.lag("label").over(order), F.col("_dump"), F.lit("remove"))
    said = events.join(held, KEY, "left").withColumn("_before", before)
    idle = F.when(F.col("label") == "add", "redundant_add").otherwise("orphan_remove")
    return said.withColumn("outcome", F.when(F.col("label") == F.col("_before"), idle).otherwise("applied")).withColumn("in_dump", F.col("_dump").isNotNull()).drop("_before", "_dump")


def periods(events: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Open and close of each period in which a binding was held; the dump's open on its day, held ones have no close."""
    applied = fold_outcomes(events, snapshot).where("outcome = 'applied'").select(*KEY, "data_date", "seq", "label")
    dump = snapshot.select(*KEY, F.lit(DUMP_DAY).cast("date").alias("data_date"), F.lit(0).alias("seq"), F.lit("add").alias("label"))
    order = Window.partitionBy(*KEY).orderBy("data_date", "seq", "label")
    steps = applied.unionByName(dump).withColumn("close", F.lead("data_date").over(order))
    return steps.where("label = 'add'").select(*KEY, F.col("data_date").alias("open"), "close")


def lifetimes(events: DataFrame, snapshot: DataFrame) -> DataFrame:
    """A binding's life: first seen, last change, periods, idle events, days with conflicts, state."""
    done = fold_outcomes(events, snapshot)
    opened = (F.col("outcome") == "applied") & (F.col("label") == "add")
    by_day = done.groupBy(*KEY, "data_date").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("outcome") == "redundant_add").alias("redundant"), F.count_if(F.col("outcome") == "orphan_remove").alias("orphan"),
        F.count_if(opened).alias("opened"), F.max(F.struct("seq", "label")).alias("end"),
    )
    sums = by_day.groupBy(*KEY).agg(
        F.min("data_date").alias("first"), F.max("data_date").alias("last_change"), F.sum("redundant").alias("redundant"), F.sum("orphan").alias("orphan"), F.count_if(F.col("n") > 1).alias("conflicts"),
        F.sum("opened").alias("opened"), F.max_by("end.label", "data_date").alias("last"),
    )
    held = sums.join(snapshot.select(*KEY, F.lit(1).alias("in_dump")).distinct(), KEY, "full_outer")
    # the dump opens a period; what the last event says holds, and without one the dump
    dumped = F.coalesce("in_dump", F.lit(0))
    active = F.when(F.col("last").isNull(), dumped).otherwise((F.col("last") == "add").cast("int"))
    every = held.withColumn("periods", F.coalesce("opened", F.lit(0)) + dumped).withColumn("active", active)
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    seen = F.when(F.col("in_dump") == 1, F.lit(DUMP_DAY).cast("date")).otherwise(F.col("first")).alias("first_seen")
    return every.select(*KEY, seen, "last_change", *map(zero, ("periods", "active", "in_dump", "redundant", "orphan", "conflicts")))


def union_periods(spans: DataFrame, by: list[str]) -> DataFrame:
    """The union of overlapping periods (open, close; no close is endless) for each ``by``."""
    endless = F.lit("9999-12-31").cast("date")
    # of periods that open on a day only the longest matters: a row a day, however many periods a value has
    order = Window.partitionBy(*by).orderBy("open")
    ends = spans.groupBy(*by, "open").agg(F.max(F.coalesce("close", endless)).alias("_end"))
    reach = F.max("_end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    starts = ends.withColumn("_new", F.when(F.col("open") <= reach, 0).otherwise(1))
    islands = starts.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    united = islands.groupBy(*by, "_island").agg(F.min("open").alias("open"), F.max("_end").alias("_end"))
    return united.select(*by, "open", F.nullif("_end", endless).alias("close"))


def build_history(events: DataFrame) -> DataFrame:
    """Events by month and binding, nested in order of date and sequence."""
    row = F.struct(F.col("data_date").alias("date"), "seq", F.when(F.col("label") == "add", 1).otherwise(2).cast("byte").alias("label"))
    return events.groupBy(F.date_format("data_date", "yyyyMM").cast("int").alias("month"), *KEY).agg(
        F.lit(0).alias("in_dump"), F.min("data_date").alias("first_date"), F.max("data_date").alias("last_date"),
        F.count_if(F.col("label") == "add").alias("adds"), F.count_if(F.col("label") == "remove").alias("removes"), F.array_sort(F.collect_list(row)).alias("events"),
    )


def history_from_dump(snapshot: DataFrame) -> DataFrame:
    """The dump in the history's form: month 0, no events."""
    none = F.array().cast("array<struct<date:date,seq:int,label:tinyint>>")
    return snapshot.select(
        F.lit(0).alias("month"), *KEY, F.lit(1).alias("in_dump"), F.lit(None).cast("date").alias("first_date"), F.lit(None).cast("date").alias("last_date"),
        F.lit(0).cast("long").alias("adds"), F.lit(0).cast("long").alias("removes"), none.alias("events"),
    )


def folded_count(day: DataFrame) -> DataFrame:
    """How many bindings each day touched."""
    return day.groupBy("data_date", *KEY).agg(F.lit(1).alias("one")).groupBy("data_date").agg(F.count("one").alias("bindings"))
