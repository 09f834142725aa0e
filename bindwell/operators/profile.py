"""What a feed is: keys, lengths, coverage, skew, consistency of days, replay of events, spellings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bindwell.sources.feed import KEY


def _n(name: str) -> Column:
    return F.count(F.lit(1)).alias(name)



def key_quality(rows: DataFrame) -> DataFrame:
    """Rows, distinct keys and bindings, and rows that repeat a binding."""
    return rows.groupBy(*KEY).agg(_n("n")).agg(
        F.sum("n").alias("rows"), F.count_distinct("msisdn").alias("numbers"), F.count_distinct("imsi").alias("sims"), F.count_distinct("imei").alias("imeis"), _n("bindings"), (F.sum("n") - F.count(F.lit(1))).alias("repeated")
    )


def field_lengths(rows: DataFrame) -> DataFrame:
    """How long each key's values are."""
    cells = F.array(*(F.struct(F.lit(c).alias("field"), F.length(F.col(c).cast("string")).alias("length")) for c in KEY))
    return rows.select(F.inline(cells)).groupBy("field", "length").agg(_n("n"))


def imei_classes(rows: DataFrame) -> DataFrame:
    """Classes of IMEIs with their share of rows."""
    size = F.length("imei")
    kind = F.when(F.col("imei").isNull(), "null").when(F.col("imei") == "000000", "unknown").when(F.col("imei").rlike("^0+$"), "zeros").when(size == 14, "whole").otherwise(F.concat(F.lit("length "), size.cast("string")))
    counts = rows.groupBy(kind.alias("kind")).agg(_n("n"))
    return counts.withColumn("percent", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 4))


def short_imeis(rows: DataFrame, n: int) -> DataFrame:
    """The commonest IMEIs that are not whole."""
    return rows.where(F.length("imei") != 14).groupBy("imei").agg(_n("n")).orderBy(F.desc("n"), "imei").limit(n)


def per_entity(rows: DataFrame, of: str, count: str, most: int) -> DataFrame:
    """How many entities have so many distinct ``count``, larger numbers together."""
    pairs = rows.select(of, count).distinct().groupBy(of).agg(_n("k"))
    return pairs.groupBy(F.least("k", F.lit(most)).alias("k")).agg(_n("entities"))


def rows_per_number(rows: DataFrame, most: int = 10) -> DataFrame:
    """Rows a number, with the share of numbers."""
    counts = rows.groupBy("msisdn").agg(_n("k")).groupBy(F.least("k", F.lit(most)).alias("k")).agg(_n("numbers"))
    return counts.withColumn("percent", F.round(100 * F.col("numbers") / F.sum("numbers").over(Window.partitionBy(F.lit(1))), 3))


def coverage(rows: DataFrame, tac: DataFrame) -> DataFrame:
    """Rows and models that the catalogue knows."""
    whole = rows.select(F.when(F.length("imei") == 14, F.substring("imei", 1, 8)).alias("tac"))
    models = whole.groupBy("tac").agg(_n("n")).join(tac.select("tac", F.lit(1).alias("known")).distinct(), "tac", "left")
    has, known = F.col("tac").isNotNull(), F.col("known").isNotNull()
    return models.agg(
        F.sum("n").alias("rows"), F.sum(F.when(~has, F.col("n")).otherwise(0)).alias("no_model"), F.sum(F.when(known, F.col("n")).otherwise(0)).alias("matched"),
        F.sum(F.when(has & ~known, F.col("n")).otherwise(0)).alias("unmatched"), F.count_if(has).alias("models"), F.count_if(known).alias("models_matched"),
    )


def unmatched_models(rows: DataFrame, tac: DataFrame, n: int) -> DataFrame:
    """The commonest models that the catalogue lacks."""
    models = rows.where(F.length("imei") == 14).groupBy(F.substring("imei", 1, 8).alias("tac")).agg(_n("n"))
    return models.join(tac, "tac", "left_anti").orderBy(F.desc("n"), "tac").limit(n)


def model_skew(rows: DataFrame) -> DataFrame:
    """The share of rows in the 10, 100 and 1000 commonest models. One row a model is ranked."""
    models = rows.where(F.length("imei") == 14).groupBy(F.substring("imei", 1, 8).alias("tac")).agg(_n("n"))
    ranked = models.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "tac")))
    top = lambda k: F.round(100 * F.sum(F.when(F.col("place") <= k, F.col("n"))) / F.sum("n"), 2).alias(f"top_{k}")
    return ranked.agg(top(10), top(100), top(1000), _n("models"))


def day_consistency(events: DataFrame) -> DataFrame:
    """For each day its rows, distinct statements, bindings and numbers, and the numbers that have adds, removes or both."""
    by = events.groupBy("data_date", *KEY, "label").agg(_n("n"))
    sums = by.groupBy("data_date").agg(F.sum("n").alias("rows"), _n("statements"), F.count_distinct(F.struct(*KEY)).alias("bindings"))
    is_ = lambda label: F.max((F.col("label") == label).cast("int"))
    numbers = by.groupBy("data_date", "msisdn").agg(is_("add").alias("a"), is_("remove").alias("r")).groupBy("data_date").agg(
        _n("numbers"), F.count_if((F.col("a") == 1) & (F.col("r") == 1)).alias("both"), F.count_if(F.col("r") == 0).alias("only_adds"), F.count_if(F.col("a") == 0).alias("only_removes")
    )
    return sums.join(numbers, "data_date")


def days_per_statement(events: DataFrame, most: int = 5) -> DataFrame:
    """In how many days the same statement stands."""
    same = events.groupBy(*KEY, "label").agg(F.count_distinct("data_date").alias("days"))
    return same.groupBy(F.least("days", F.lit(most)).alias("days")).agg(_n("n"))


def replay(events: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Adds of bindings whose balance is held already, and removes of those that is not, from the dump on."""
    order = Window.partitionBy(*KEY).orderBy("data_date", "seq", "label").rowsBetween(Window.unboundedPreceding, -1)
    step = F.when(F.col("label") == "add", 1).otherwise(-1)
    held = events.join(snapshot.select(*KEY, F.lit(1).alias("_dump")), KEY, "left")
    balance = F.coalesce(F.sum(step).over(order), F.lit(0)) + F.coalesce("_dump", F.lit(0))
    return held.select("label", balance.alias("before")).groupBy("label").agg(
        _n("n"), F.count_if((F.col("before") == 0) & (F.col("label") == "remove")).alias("orphan_removes"), F.count_if((F.col("before") >= 1) & (F.col("label") == "add")).alias("double_adds")
    )


def net_balance(events: DataFrame) -> DataFrame:
    """Adds less removes of each binding over all days."""
    net = events.groupBy(*KEY).agg(F.sum(F.when(F.col("label") == "add", 1).otherwise(-1)).alias("net"))
    return net.groupBy("net").agg(_n("bindings"))


def alternation(events: DataFrame) -> DataFrame:
    """Events whose label repeats the one before, by label."""
    order = Window.partitionBy(*KEY).orderBy("data_date", "seq", "label")
    said = events.withColumn("before", F.lag("label").over(order))
    again = F.col("before") == F.col("label")
    return said.groupBy("label").agg(
        _n("events"), F.count_if(F.col("before").isNull()).alias("first"), F.count_if(again).alias("repeats"),
        F.round(100 * F.count_if(again) / F.nullif(F.count("before"), F.lit(0)), 4).alias("percent"),
    )


def first_event(events: DataFrame, snapshot: DataFrame) -> DataFrame:
    """The first label of each binding against whether the dump has it."""
    first = events.groupBy(*KEY).agg(F.min_by("label", F.struct("data_date", "seq", "label")).alias("first_label"))
    joined = first.join(snapshot.select(*KEY, F.lit(True).alias("s")), KEY, "left").groupBy("first_label", F.col("s").isNotNull().alias("in_dump")).agg(_n("bindings"))
    return joined.withColumn("percent", F.round(100 * F.col("bindings") / F.sum("bindings").over(Window.partitionBy("first_label")), 2))


def reconstructed(state: DataFrame) -> DataFrame:
    """Bindings ever seen and active ones, with the numbers that hold them."""
    return state.agg(_n("bindings"), F.sum("active").alias("active"), F.count_distinct(F.when(F.col("active") == 1, F.col("msisdn"))).alias("active_numbers"))


def active_per_number(state: DataFrame, most: int = 6) -> DataFrame:
    """Active bindings a number."""
    counts = state.groupBy("msisdn").agg(F.sum("active").alias("k")).groupBy(F.least("k", F.lit(most)).alias("k")).agg(_n("numbers"))
    return counts.withColumn("percent", F.round(100 * F.col("numbers") / F.sum("numbers").over(Window.partitionBy(F.lit(1))), 2))


def day_sizes(events: DataFrame) -> DataFrame:
    """The smallest, mean and largest day."""
    days = events.groupBy("data_date").agg(_n("n"))
    return days.agg(F.min("n").alias("least"), F.round(F.avg("n"), 4).alias("mean"), F.max("n").alias("most"), _n("days"), F.sum("n").alias("rows"))


def spellings(tac: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct values of text columns, raw and trimmed in lower case."""
    cells = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("raw"), F.lower(F.trim(c)).alias("tidy")) for c in columns))
    return tac.select(F.inline(cells)).groupBy("column").agg(F.count_distinct("raw").alias("raw"), F.count_distinct("tidy").alias("tidy"))


def spelling_variants(tac: DataFrame, column: str) -> DataFrame:
    """Values that stand for one name in several spellings: same first word in lower case."""
    word = F.lower(F.substring_index(F.trim(column), " ", 1))
    return tac.where(F.trim(column) != "").groupBy(word.alias("name")).agg(F.count_distinct(column).alias("spellings"), _n("models")).where("spellings > 1")


def catalogue_profile(tac: DataFrame) -> DataFrame:
    """Key quality, cardinalities, "Not Known" values and the range of allocation dates of a catalogue."""
    date = F.to_date(F.try_to_timestamp("allocationDate", F.lit("dd-MMM-yyyy")))
    text = ["manufacturer", "brandName", "modelName", "marketingName", "deviceType", "operatingSystem"]
    return tac.agg(
        _n("rows"), F.count_distinct("tac").alias("tacs"), F.count_if(F.col("tac").isNull()).alias("null_tac"), F.count_if(F.length("tac") != 8).alias("odd_length"), F.count_if(~F.col("tac").rlike("^[0-9]+$")).alias("not_digits"),
        *(F.count_distinct(c).alias(c) for c in text), F.count_if(F.col("ntnConnectivity") == "Not Known").alias("ntn_not_known"), F.count_if(F.coalesce("operatingSystem", F.lit("")) == "").alias("system_blank"),
        F.min(date).alias("first_allocated"), F.max(date).alias("last_allocated"), F.count_if(date.isNull()).alias("undated"),
    )


def examples(flagged: DataFrame, events: DataFrame, tests: dict, n: int) -> DataFrame:
    """The first ``n`` bindings of each category by the hash of their key, with their history as text.

    Only the chosen bindings' events are gathered.
    """
    named = F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test in tests.items())))
    mark = F.md5(F.concat_ws("|", *(F.col(c).cast("string") for c in KEY)))
    rows = flagged.select(*KEY, F.explode(named).alias("category"), mark.alias("mark"))
    # the smallest n of each category, kept apart in every partition first: no category meets whole in one task
    best = rows.withColumn("salt", F.pmod(F.xxhash64("mark"), F.lit(64)))
    inner = Window.partitionBy("category", "salt").orderBy("mark")
    few = best.withColumn("place", F.row_number().over(inner)).where(F.col("place") <= n)
    chosen = few.withColumn("place", F.row_number().over(Window.partitionBy("category").orderBy("mark"))).where(F.col("place") <= n).select("category", "place", *KEY)
    said = F.concat_ws(":", F.col("data_date").cast("string"), "label")
    told = events.join(chosen.select(*KEY).distinct(), KEY, "left_semi").groupBy(*KEY).agg(F.array_join(F.array_sort(F.collect_list(said)), ",").alias("history"))
    return chosen.join(told, KEY, "left").fillna("", ["history"])
