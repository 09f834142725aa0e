"""Network planning: what sunsets strike, who changes handset, how long handsets stay."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHIFTED, NO_HANDSET, NOT_IN_CATALOGUE = 5, 6, 7
#: The outcome of a number with too many handsets.
NOT_ASSESSED = 4


def handset_stage(flagged: DataFrame, radio: DataFrame) -> DataFrame:
    """Handsets of each number: sunset class of the model, or why there is none."""
    joined = flagged.where("active = 1").join(radio.select("tac", "sunset", "esim", "umts", "device_class"), "tac", "left")
    signs = ~F.col("imei").rlike("^[0-9]*$")  # no handset has other signs than digits
    state = F.when(F.col("shifted") == 1, SHIFTED).when((F.col("no_handset") == 1) | signs, NO_HANDSET).when(F.col("sunset").isNull(), NOT_IN_CATALOGUE).otherwise(F.col("sunset"))
    return joined.groupBy("msisdn", "imei").agg(
        F.min("tac").alias("tac"), F.min(state).alias("state"), F.min(F.coalesce("esim", F.lit(2))).alias("esim"), F.max(F.coalesce("umts", F.lit(0))).alias("umts"),
        F.max(F.coalesce((F.col("device_class") == "IoT / M2M").cast("int"), F.lit(0))).alias("iot"), F.count(F.lit(1)).alias("bindings"),
    )


def number_class(stage: DataFrame) -> DataFrame:
    """The class of each number; an unclear handset borrows from a dual-SIM partner on the number."""
    head, serial = F.substring("imei", 1, 8).cast("int"), F.substring("imei", 9, 6).cast("int")
    pad = lambda a, b: F.concat(F.lpad(a.cast("string"), 8, "0"), F.lpad(b.cast("string"), 6, "0"))
    partners = F.array(pad(head, serial + 1), pad(head, serial - 1), pad(head + 100, serial), pad(head - 100, serial))
    unclear = stage.where("state in (0, 7)").select("msisdn", "imei", F.explode(partners).alias("partner"))
    clear = stage.where("state in (1, 2, 3)").select("msisdn", F.col("imei").alias("partner"), "state", "esim", "umts", "iot")
    found = unclear.join(clear, ["msisdn", "partner"]).groupBy("msisdn", "imei").agg(
        F.min("state").alias("p_state"), F.when(F.max((F.col("esim") == 1).cast("int")) == 1, 1).otherwise(F.min("esim")).alias("p_esim"), F.max("umts").alias("p_umts"), F.max("iot").alias("p_iot")
    )
    seen = stage.join(found, ["msisdn", "imei"], "left")
    use = lambda c: F.coalesce(f"p_{c}", c)
    asked = ~F.col("state").isin(SHIFTED, NO_HANDSET)
    any_ = lambda c: F.max(c.cast("int"))
    sums = seen.groupBy("msisdn").agg(
        *(any_(use("state") == k).alias(f"s{k}") for k in (0, 1, 2, 3, 5, 7)), *(any_(asked & (use("esim") == k)).alias(f"e{k}") for k in (1, 2)), any_(asked).alias("asked"),
        F.max(use("iot")).alias("iot"), F.max(use("umts")).alias("umts"), F.count(F.lit(1)).alias("handsets"), F.sum("bindings").alias("bindings"), F.count("p_state").alias("paired"),
    )
    on = lambda c: F.col(c) == 1
    sunset = F.when(on("s1"), 1).when(on("s2"), 2).when(on("s0") | on("s7"), 4).when(on("s3"), 3).otherwise(4)
    reason = F.when(F.col("sunset") != 4, 0).when(on("s7"), 3).when(on("s0"), 4).when(on("s5"), 1).otherwise(2)
    return sums.withColumn("sunset", sunset).select(
        "msisdn", "sunset", reason.alias("reason"), F.when(on("e1"), 1).when(on("e2") | (F.col("asked") == 0), 2).otherwise(0).alias("esim"), "iot",
        ((F.col("sunset") == 3) & (F.col("umts") == 0)).cast("int").alias("gsm_only"), "handsets", "bindings", "paired",
    )


def number_models(stage: DataFrame, most: int = 64) -> DataFrame:
    """The TACs of each number's handsets: the first ``most`` in order, and how many there are.

    A number's rows are cut to ``most`` where they stand, before they are shuffled, so a number with
    many handsets never has an unbounded list.
    """
    held = stage.where("tac <> ''").select("msisdn", "tac").distinct()
    counts = held.groupBy("msisdn").agg(F.count(F.lit(1)).alias("n_models"))
    first = held.withColumn("_k", F.row_number().over(Window.partitionBy("msisdn").orderBy("tac"))).where(F.col("_k") <= most)
    return first.groupBy("msisdn").agg(F.array_sort(F.collect_list("tac")).alias("models")).join(counts, "msisdn")


def class_summary(numbers: DataFrame, stage: DataFrame) -> DataFrame:
    """Numbers, bindings and handsets of each sunset class and reason, and of each eSIM class (reason 0)."""
    cells = F.array(F.struct(F.lit("sunset").alias("measure"), F.col("sunset").alias("class"), "reason"), F.struct(F.lit("esim").alias("measure"), F.col("esim").alias("class"), F.lit(0).alias("reason")))
    by = ["measure", "class", "reason"]
    counted = numbers.select("bindings", F.inline(cells)).groupBy(*by).agg(F.count(F.lit(1)).alias("numbers"), F.sum("bindings").alias("bindings"))
    handsets = stage.select("msisdn", "imei").join(numbers.select("msisdn", F.inline(cells)), "msisdn").groupBy(*by).agg(F.count_distinct("imei").alias("handsets"))
    return counted.join(handsets, by, "left").fillna(0, ["handsets"])


def breakdown(stage: DataFrame, numbers: DataFrame) -> DataFrame:
    """Numbers, bindings and handsets of each class by model."""
    return stage.join(numbers.select("msisdn", "sunset"), "msisdn").groupBy("sunset", "tac").agg(
        F.count_distinct("msisdn").alias("numbers"), F.sum("bindings").alias("bindings"), F.count_distinct("imei").alias("handsets")
    )


def summary(numbers: DataFrame) -> DataFrame:
    return numbers.groupBy("sunset", "reason", "esim").agg(F.count(F.lit(1)).alias("numbers"), F.sum("iot").alias("iot"), F.sum("gsm_only").alias("gsm_only"))


def spells(events: DataFrame, snapshot: DataFrame, flagged: DataFrame, as_of: str, least_days: int = 7) -> DataFrame:
    """From when to when a number used a handset; a held one ends nowhere, a dump one began before the feed."""
    day = F.lit(as_of).cast("date")
    begun = events.where("label = 'add'").groupBy("msisdn", "imei").agg(F.min("data_date").alias("first"))
    dump = snapshot.select("msisdn", "imei", F.lit(1).alias("dump")).distinct()
    now = flagged.where("countable = 1").groupBy("msisdn", "imei").agg(F.max("active").alias("held"), F.max("last_change_date").alias("last"))
    joined = now.join(begun, ["msisdn", "imei"], "left").join(dump, ["msisdn", "imei"], "left")
    start = F.when(F.col("dump") == 1, F.lit("2026-01-25").cast("date")).otherwise(F.col("first"))
    spell = joined.select("msisdn", "imei", start.alias("start"), F.when(F.col("held") == 0, F.col("last")).alias("finish"), F.coalesce("dump", F.lit(0)).alias("dump"))
    return spell.where(F.col("start").isNotNull() & (F.datediff(F.coalesce("finish", day), "start") >= least_days))


def spell_events(spell: DataFrame, as_of: str, overlap: int = 7, gap: int = 30, most_imeis: int = 40, most_handsets: int = 20) -> DataFrame:
    """What ended each spell: 1 a change to the next handset (in ``month``), 2 gone, 3 still held. Higher twins are left out.

    The successor is the first later-starting handset, by start and IMEI, within the overlap and gap.
    A number with more than ``most_imeis`` IMEIs, or ``most_handsets`` handsets once twins are left out, is
    not assessed: one row of outcome 4 without handsets, of 0 days and cohort 0.
    """
    day = F.lit(as_of).cast("date")
    # the spells of a number side by side: cut to one more than are assessed before they are shuffled
    first = spell.withColumn("_k", F.row_number().over(Window.partitionBy("msisdn").orderBy("imei"))).where(F.col("_k") <= most_imeis + 1)
    listed = first.groupBy("msisdn").agg(F.collect_list(F.struct("imei", "start", "finish", "dump")).alias("all"))
    head, serial = (lambda x: F.substring(x["imei"], 1, 8).cast("int")), (lambda x: F.substring(x["imei"], 9, 6).cast("int"))
    pad = lambda a, b: F.concat(F.lpad(a.cast("string"), 8, "0"), F.lpad(b.cast("string"), 6, "0"))
    lower = lambda x: F.array(pad(head(x), serial(x) - 1), pad(head(x) - 100, serial(x)))
    alone = listed.withColumn("names", F.transform("all", lambda x: x["imei"])).select("msisdn", "all", F.filter("all", lambda x: ~F.arrays_overlap("names", lower(x))).alias("kept"))
    heavy = (F.size("all") > most_imeis) | (F.size("kept") > most_handsets)
    after = lambda x: F.filter("kept", lambda y: (y["start"] > x["start"]) & F.datediff(y["start"], x["finish"]).between(-overlap, gap))
    following = lambda x: F.array_min(F.transform(after(x), lambda y: F.struct(y["start"].alias("start"), y["imei"].alias("imei"))))
    def told(x):
        own, then = x["own"], x["next"]
        outcome = F.when(own["finish"].isNull(), 3).when(then.isNotNull(), 1).otherwise(2)
        end = F.coalesce(then["start"], own["finish"], day)
        cohort = F.when(own["dump"] == 1, 0).otherwise(F.date_format(own["start"], "yyyyMM").cast("int"))
        month = F.when(outcome == 1, F.date_format(then["start"], "yyyyMM").cast("int")).otherwise(0)
        return F.struct(own["imei"].alias("imei"), outcome.alias("outcome"), F.greatest(F.datediff(end, own["start"]), F.lit(0)).alias("days"), cohort.alias("cohort"), month.alias("month"), then["imei"].alias("next_imei"))

    no_text, zero = F.lit(None).cast("string"), F.lit(0)
    nothing = F.array(F.struct(no_text.alias("imei"), F.lit(NOT_ASSESSED).alias("outcome"), zero.alias("days"), zero.alias("cohort"), zero.alias("month"), no_text.alias("next_imei")))
    paired = F.transform("kept", lambda x: F.struct(x.alias("own"), F.when(x["finish"].isNotNull(), following(x)).alias("next")))
    return alone.select("msisdn", F.inline(F.when(heavy, nothing).otherwise(F.transform(paired, told))))


def survival(tenure: DataFrame, by: str = "cohort") -> DataFrame:
    """Kaplan-Meier share still in use after each day with a change; other outcomes are censored, numbers not assessed left out."""
    days = tenure.where(F.col("outcome") != NOT_ASSESSED).groupBy(by, "days").agg(F.count_if(F.col("outcome") == 1).alias("events"), F.count(F.lit(1)).alias("ended"))
    back = Window.partitionBy(by).orderBy(F.desc("days"))
    at_risk = days.withColumn("at_risk", F.sum("ended").over(back))
    order = Window.partitionBy(by).orderBy("days")
    dead = F.max((F.col("events") == F.col("at_risk")).cast("int")).over(order)
    product = F.exp(F.sum(F.log(F.when(F.col("events") < F.col("at_risk"), 1 - F.col("events") / F.col("at_risk")).otherwise(F.lit(1.0)))).over(order))
    return at_risk.select(by, "days", "events", "at_risk", F.round(F.when(dead == 1, 0.0).otherwise(product), 6).alias("share")).where("events > 0")


def device_age(events: DataFrame, snapshot: DataFrame, flagged: DataFrame) -> DataFrame:
    """Active handsets by model and the month in which they first came, 0 for those of the dump."""
    seen = events.select("imei", F.col("data_date").alias("first"), F.lit(0).alias("dump")).unionByName(snapshot.select("imei", F.lit(None).cast("date").alias("first"), F.lit(1).alias("dump")))
    first = seen.groupBy("imei").agg(F.min("first").alias("first"), F.max("dump").alias("dump"))
    active = flagged.where("active = 1 and countable = 1").select("imei").distinct()
    month = F.when(F.col("dump") == 1, 0).otherwise(F.date_format("first", "yyyyMM").cast("int"))
    return active.join(first, "imei").groupBy(F.substring("imei", 1, 8).alias("tac"), month.alias("month")).agg(F.count(F.lit(1)).alias("handsets"))
