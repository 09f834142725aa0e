"""Figures of each delivered day: changes, churn and feed quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bindwell.functions.rules import countable_rows, flag_handsets
from bindwell.sources.feed import KEY, tac_of
from bindwell.sources.store import spread

CHECKS = ("shifted_imei", "multi_number_sim", "malformed_imei", "unknown_device")


def change_daily(events: DataFrame) -> DataFrame:
    return events.groupBy("data_date", "tac", "label").agg(F.count(F.lit(1)).alias("n"))


def change_summary(events: DataFrame) -> DataFrame:
    return events.groupBy("data_date").agg(
        F.count_if(F.col("label") == "add").alias("added"), F.count_if(F.col("label") == "remove").alias("removed"),
        F.count_if(F.col("imei") == "000000").alias("unknown_device"), F.count(F.lit(1)).alias("rows_total"),
    )


def _swaps(events: DataFrame, what: str) -> DataFrame:
    """Numbers and days with a removed ``what`` and another that was added and not removed."""
    said = events.groupBy("data_date", "msisdn", what).agg(F.max((F.col("label") == "add").cast("int")).alias("added"), F.max((F.col("label") == "remove").cast("int")).alias("removed"))
    came = F.count_if((F.col("added") == 1) & (F.col("removed") == 0))
    return said.groupBy("data_date", "msisdn").agg(came.alias("came"), F.sum("removed").alias("went")).where("came > 0 and went > 0")


def sim_changes(events: DataFrame) -> DataFrame:
    return _swaps(events, "imsi").groupBy("data_date").agg(F.count(F.lit(1)).alias("changes"))


def device_changes(events: DataFrame) -> DataFrame:
    return _swaps(events, "imei").groupBy("data_date").agg(F.count(F.lit(1)).alias("changes"))


def built_days(*marts: DataFrame) -> DataFrame:
    """Days that every mart holds."""
    days = [m.select("data_date").distinct() for m in marts]
    out = days[0]
    for other in days[1:]:
        out = out.intersect(other)
    return out


def backfill(step, events: DataFrame, built: DataFrame) -> DataFrame:
    """One job for all days that ``step`` has not built yet."""
    return step(events.join(built.select("data_date").distinct(), "data_date", "left_anti"))


def missing_days(events: DataFrame) -> DataFrame:
    """Days between the first and the last loaded one on which nothing was loaded."""
    bounds = events.agg(F.min("data_date").alias("a"), F.max("data_date").alias("b")).where("a is not null")
    every = bounds.select(F.explode(F.sequence("a", "b")).alias("data_date"))
    return every.join(events.select("data_date").distinct(), "data_date", "left_anti")


def days_behind(events: DataFrame, today: str) -> DataFrame:
    """The newest day and how many days it is behind ``today``."""
    return events.agg(F.max("data_date").alias("newest")).withColumn("behind", F.datediff(F.lit(today).cast("date"), "newest"))


def multi_number_sims(events: DataFrame) -> DataFrame:
    """SIMs under two or more numbers on a day (two linear groupings instead of a distinct count a SIM)."""
    pairs = events.groupBy("data_date", "imsi", "msisdn").agg(F.count(F.lit(1)).alias("r"))
    return pairs.groupBy("data_date", "imsi").agg(F.count(F.lit(1)).alias("numbers"), F.sum("r").alias("rows")).where("numbers > 1")


def dq_daily(events: DataFrame, tac: DataFrame, multi: DataFrame | None = None) -> DataFrame:
    """Defects of each day's feed. ``multi``: the events' ``multi_number_sims``, where they stand already."""
    flagged = flag_handsets(events, tac)
    lost = (F.col("shifted") == 1) & (F.col("imei") != "0" * 14)
    whole = F.length("imei") == 14
    rows = flagged.groupBy("data_date").agg(
        F.count(F.lit(1)).alias("rows_total"), F.count_if(F.col("imei") == "000000").alias("unknown_device_rows"),
        F.count_if(~whole & (F.col("imei") != "000000")).alias("malformed_imei_rows"), F.count_if(whole & (F.col("known") == 0)).alias("unknown_tac_rows"),
        F.count_if(lost).alias("shifted_imei_rows"),
    )
    sims = events.select("data_date", "imsi").distinct().groupBy("data_date").agg(F.count(F.lit(1)).alias("sims_total"))
    multi = (multi_number_sims(events) if multi is None else multi).groupBy("data_date").agg(F.count(F.lit(1)).alias("multi_number_sims"), F.sum("rows").alias("multi_number_sim_rows"))
    joined = rows.join(sims, "data_date").join(multi, "data_date", "left")
    return joined.fillna(0, ["multi_number_sims", "multi_number_sim_rows"])


def _ratio(a: str, b: str) -> Column:
    return F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))


def rates(dq: DataFrame) -> DataFrame:
    """Each day's rate of each check, one row a day and check."""
    pairs = (("shifted_imei_rows", "rows_total"), ("multi_number_sims", "sims_total"), ("malformed_imei_rows", "rows_total"), ("unknown_device_rows", "rows_total"))
    cells = F.array(*(F.struct(F.lit(name).alias("check"), _ratio(a, b).alias("rate")) for name, (a, b) in zip(CHECKS, pairs, strict=True)))
    return dq.select("data_date", F.inline(cells))


def assess_feed(dq: DataFrame, ref_from: str, ref_to: str, multiplier: float = 5.0, floor: float = 0.0001) -> DataFrame:
    """Checks whose rate is over a multiple of the reference days' median. The reference is four numbers."""
    every = rates(dq)
    reference = every.where(F.col("data_date").between(ref_from, ref_to)).groupBy("check").agg(F.median("rate").alias("median"))
    judged = every.join(F.broadcast(reference), "check", "left").withColumn("threshold", F.when(F.col("median").isNotNull(), F.greatest(F.col("median") * multiplier, F.lit(floor))))
    return judged.withColumn("flagged", F.coalesce(F.col("rate") > F.col("threshold"), F.lit(False)))


def sim_change_evidence(events: DataFrame, multi: DataFrame, dq: DataFrame, most: int = 5) -> DataFrame:
    """Numbers that changed SIM on a day, up to ``most`` new and old SIMs, and why a change is set aside."""
    said = events.groupBy("data_date", "msisdn", "imsi").agg(F.max((F.col("label") == "add").cast("int")).alias("added"), F.max((F.col("label") == "remove").cast("int")).alias("removed"))
    shared = multi.select("data_date", "imsi", F.lit(1).alias("multi"))
    marked = said.join(shared, ["data_date", "imsi"], "left").withColumn("new", (F.col("added") == 1) & (F.col("removed") == 0))
    some = lambda c: F.slice(F.array_sort(F.collect_list(F.when(c, F.col("imsi")))), 1, most)
    grouped = marked.groupBy("data_date", "msisdn").agg(
        some(F.col("new")).alias("new_imsis"), some(F.col("removed") == 1).alias("old_imsis"), F.count_if("new").alias("new_count"), F.sum("removed").alias("old_count"),
        F.max("multi").alias("multi"),
    ).where("new_count > 0 and old_count > 0")
    measured = dq.select("data_date", F.lit(1).alias("measured"))
    reason = F.when(F.col("measured").isNull(), "dq_unavailable").when(F.col("multi") == 1, "multi_number").otherwise("none")
    return grouped.join(measured, "data_date", "left").withColumn("set_aside", reason).drop("multi", "measured")


def tac_day(events: DataFrame, tac: DataFrame) -> DataFrame:
    """Countable handsets, SIMs and adds of each model and day."""
    added = countable_rows(events.where("label = 'add'"), tac)
    return added.groupBy("data_date", "tac").agg(F.count_distinct("imei").alias("handsets"), F.count_distinct("imsi").alias("sims"), F.count(F.lit(1)).alias("adds"))


def handset_day(events: DataFrame, tac: DataFrame) -> DataFrame:
    """Countable handsets of each model and day, where nothing else of ``tac_day`` is asked."""
    added = countable_rows(events.where("label = 'add'").select("data_date", "tac", "imei"), tac)
    return spread(added, events, "imei").groupBy("data_date", "tac").agg(F.count_distinct("imei").alias("handsets"))


def tac_dump(snapshot: DataFrame, tac: DataFrame) -> DataFrame:
    """Countable handsets, SIMs and bindings of each model in the dump."""
    held = countable_rows(snapshot.select(*KEY, tac_of("imei").alias("tac")), tac)
    return held.groupBy("tac").agg(F.count_distinct("imei").alias("handsets"), F.count_distinct("imsi").alias("sims"), F.count(F.lit(1)).alias("bindings"))


def quality_tests() -> dict[str, Column]:
    """What each quality category asks of a binding of a flagged state."""
    missing = F.col("imei").isin("000000", "")
    return {
        "all": F.lit(True), "active": F.col("active") == 1, "missing_imei": missing, "invalid_imei": ~missing & ~F.col("imei").rlike("^[0-9]{14}$"),
        "zero_imei": F.col("imei") == "0" * 14, "shifted_imei": F.col("shifted") == 1, "unknown_tac": (F.col("countable") == 1) & (F.col("known") == 0),
        "invalid_imsi": F.length(F.col("imsi").cast("string")) != 15, "invalid_msisdn": F.length(F.col("msisdn").cast("string")) != 10,
        "untouched_since_dump": (F.col("active") == 1) & F.col("last_change_date").isNull(),
    }


def quality_cells(f: DataFrame) -> DataFrame:
    """The bindings of a flagged state by quality category, in each that fits."""
    named = F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test in quality_tests().items())))
    return f.select(*KEY, F.explode(named).alias("category"))


def quality_current(state: DataFrame, tac: DataFrame) -> DataFrame:
    """Quality categories of the current state, a binding in each that fits it."""
    return quality_cells(flag_handsets(state, tac)).groupBy("category").agg(
        F.count(F.lit(1)).alias("bindings"), F.count_distinct("msisdn").alias("numbers"), F.count_distinct("imsi").alias("sims"), F.count_distinct("imei").alias("imeis")
    )


#: Quality categories of the history.
HISTORY_CATEGORIES = (
    "history_all", "redundant_add", "orphan_remove", "period_same_day", "period_1_day", "period_2_7_days", "period_8_30_days", "period_31_90_days", "period_over_90_days", "still_held",
)


def quality_history_amounts(history: DataFrame) -> DataFrame:
    """A row a binding with a column a category of the history: idle events, lengths of add-to-remove periods, still held."""
    whole = history.groupBy(*KEY).agg(F.max("in_dump").alias("dump"), F.array_sort(F.flatten(F.collect_list("events"))).alias("ev"))
    at = F.sequence(F.lit(1), F.size("ev"))
    is_, before = (lambda i: F.element_at("ev", i)["label"]), (lambda i: F.when(i > 1, F.element_at("ev", F.greatest(i - 1, F.lit(1)))["label"]))
    some = F.when(F.size("ev") > 0, at).otherwise(F.array().cast("array<int>"))
    lens = F.transform(
        F.filter(some, lambda i: (is_(i) == 2) & F.coalesce(before(i) == 1, F.lit(False))),
        lambda i: F.datediff(F.element_at("ev", i)["date"], F.element_at("ev", F.greatest(i - 1, F.lit(1)))["date"]),
    )
    counted = whole.select(
        *KEY, "dump", "ev",
        F.size(F.filter(some, lambda i: (is_(i) == 1) & F.coalesce(before(i) == 1, F.lit(False)))).alias("redundant"),
        F.size(F.filter(some, lambda i: (is_(i) == 2) & F.coalesce(before(i) == 2, F.col("dump") == 0))).alias("orphan"),
        lens.alias("lens"),
    )
    within = lambda a, b: F.size(F.filter("lens", lambda x: (x >= a) & (x <= b)))
    held = F.when(F.size("ev") == 0, F.col("dump") == 1).otherwise(F.element_at("ev", F.greatest(F.size("ev"), F.lit(1)))["label"] == 1).cast("int")
    amounts = {
        "history_all": F.lit(1), "redundant_add": F.col("redundant"), "orphan_remove": F.col("orphan"), "period_same_day": within(0, 0), "period_1_day": within(1, 1),
        "period_2_7_days": within(2, 7), "period_8_30_days": within(8, 30), "period_31_90_days": within(31, 90), "period_over_90_days": within(91, 1 << 30), "still_held": held,
    }
    return counted.select(*KEY, *(amounts[k].cast("long").alias(k) for k in HISTORY_CATEGORIES))


def quality_history_cells(history: DataFrame) -> DataFrame:
    """Bindings by quality category of the history, with the amount of each."""
    cells = F.array(*(F.struct(F.lit(k).alias("category"), F.col(k).alias("amount")) for k in HISTORY_CATEGORIES))
    return quality_history_amounts(history).select(*KEY, F.inline(cells)).where("amount > 0")


def quality_history(history: DataFrame) -> DataFrame:
    """Figures of the history's quality categories."""
    return quality_history_cells(history).groupBy("category").agg(
        F.count(F.lit(1)).alias("bindings"), F.count_distinct("msisdn").alias("numbers"), F.count_distinct("imsi").alias("sims"), F.count_distinct("imei").alias("imeis"), F.sum("amount").alias("periods")
    )
