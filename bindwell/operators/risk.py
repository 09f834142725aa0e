"""Risk windows and look-ups over bindings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bindwell.functions.rules import flag_handsets, imsi_range, look_ups
from bindwell.sources.store import cut


def marked_adds(events: DataFrame, tac: DataFrame, multi: DataFrame, as_of: str) -> DataFrame:
    """Adds of whole identifiers in the 30 days to ``as_of``, and whether each is clean."""
    day = F.lit(as_of).cast("date")
    recent = events.where((F.col("label") == "add") & F.col("data_date").between(F.date_sub(day, 29), day) & (F.length("imei") == 14))
    shared = multi.select("data_date", "imsi", F.lit(1).alias("_multi"))
    marked = flag_handsets(recent, tac).join(shared, ["data_date", "imsi"], "left")
    clean = (F.col("countable") == 1) & F.col("_multi").isNull()
    return marked.select("data_date", "msisdn", "imsi", "imei", "countable", clean.alias("clean"), F.datediff(day, "data_date").alias("age"))


def _busiest(name: str) -> list[Column]:
    """Of rows (a day's ``age`` and its count ``n``) the number of days, the largest count and the first day that has it.

    Count and age are compared as one number, which is found in hash tables; structs would be sorted.
    """
    return [F.count(F.lit(1)).alias("add_days_30"), F.max("n").alias(name), F.max(F.col("n") * 64 + F.col("age")).alias("_top")]


def _max_day(as_of: str) -> Column:
    return F.when(F.col("_top").isNotNull(), F.date_sub(F.lit(as_of).cast("date"), (F.col("_top") % 64).cast("int")))


def sim_window(events: DataFrame, tac: DataFrame, multi: DataFrame, as_of: str, floor: int = 6, adds: DataFrame | None = None) -> DataFrame:
    """SIMs with many handsets: clean and raw counts over 30, 20 and 7 days, busiest day, commonest models. ``adds``: the ``marked_adds``, where they stand already."""
    adds = marked_adds(events, tac, multi, as_of) if adds is None else adds
    pair = adds.groupBy("imsi", "imei").agg(
        F.max("clean").alias("c30"), F.max(F.col("clean") & (F.col("age") < 20)).alias("c20"), F.max(F.col("clean") & (F.col("age") < 7)).alias("c7"),
        F.max(F.col("age") < 7).alias("r7"), F.count(F.lit(1)).alias("adds"), F.count_if(~F.col("clean")).alias("aside"),
    )
    sims = pair.groupBy("imsi").agg(
        F.count_if("c30").alias("imeis_30"), F.count(F.lit(1)).alias("imeis_30_raw"), F.count_if("c20").alias("imeis_20"),
        F.count_distinct(F.when(F.col("c20"), F.substring("imei", 1, 8))).alias("tacs_20"), F.count_if("c7").alias("imeis_7"), F.count_if("r7").alias("imeis_7_raw"),
        F.sum("adds").alias("adds_30"), F.sum("aside").alias("adds_set_aside_30"),
    ).where(F.col("imeis_30_raw") >= floor)
    days = adds.where("clean").groupBy("imsi", "age").agg(F.count_distinct("imei").alias("n"))
    busy = days.groupBy("imsi").agg(*_busiest("max_imeis_one_day_30")).withColumn("max_day_30", _max_day(as_of)).drop("_top")
    models = pair.where("c20").groupBy("imsi", F.substring("imei", 1, 8).alias("tac")).agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("imsi").orderBy(F.desc("n"), "tac")
    five = F.concat_ws(",", "tac", *(F.lead("tac", k).over(order) for k in range(1, 5)))
    top = models.select("imsi", five.alias("top_tacs_20"), F.row_number().over(order).alias("k")).where("k = 1").drop("k")
    return sims.join(busy, "imsi", "left").join(top, "imsi", "left").fillna(0, ["add_days_30", "max_imeis_one_day_30"]).fillna("", ["top_tacs_20"])


def imei_window(events: DataFrame, tac: DataFrame, multi: DataFrame, as_of: str, floor: int = 6, adds: DataFrame | None = None) -> DataFrame:
    """Handsets with many SIMs or numbers over 30 days. ``adds``: the ``marked_adds``, where they stand already."""
    adds = (marked_adds(events, tac, multi, as_of) if adds is None else adds).where("countable = 1")
    pair = adds.groupBy("imei", "imsi").agg(
        F.max("clean").alias("clean"), F.max(F.col("clean") & (F.col("age") < 7)).alias("c7"), F.count(F.lit(1)).alias("adds"), F.count_if(~F.col("clean")).alias("aside")
    )
    sims = pair.groupBy("imei").agg(
        F.count_if("clean").alias("sims_30"), F.count(F.lit(1)).alias("sims_30_raw"), F.count_if("c7").alias("sims_7"), F.sum("adds").alias("adds_30"), F.sum("aside").alias("adds_set_aside_30")
    )
    numbers = adds.groupBy("imei", "msisdn").agg(F.max("clean").alias("clean")).groupBy("imei").agg(F.count_if("clean").alias("numbers_30"))
    days = adds.where("clean").groupBy("imei", "age").agg(F.count_distinct("imsi").alias("n"))
    busy = days.groupBy("imei").agg(*_busiest("max_sims_one_day_30")).withColumn("max_day_30", _max_day(as_of)).drop("_top")
    counted = sims.join(numbers, "imei").where(F.greatest("sims_30_raw", "numbers_30") >= floor)
    return counted.join(busy, "imei", "left").fillna(0, ["add_days_30", "max_sims_one_day_30"])


def imei_lifetime(flagged: DataFrame, floor: int = 6) -> DataFrame:
    """SIMs and numbers a handset ever had, and those not removed since."""
    countable = flagged.where("countable = 1")
    held = (F.col("active") == 1) & F.col("last_change_date").isNotNull()
    dump = (F.col("active") == 1) & F.col("last_change_date").isNull()
    pair = countable.groupBy("imei", "imsi").agg(F.count(F.lit(1)).alias("bindings"), F.max(held).alias("dated"), F.max(dump).alias("dump"))
    sims = pair.groupBy("imei").agg(
        F.count(F.lit(1)).alias("sims_ever"), F.sum("bindings").alias("bindings"), F.count_if("dated").alias("sims_not_removed_dated"), F.count_if(F.col("dump") & ~F.col("dated")).alias("sims_not_removed_dump")
    )
    numbers = countable.groupBy("imei", "msisdn").agg(F.lit(1).alias("one")).groupBy("imei").agg(F.count("one").alias("numbers_ever"))
    return sims.join(numbers, "imei").where((F.col("sims_ever") >= floor) | (F.col("sims_not_removed_dated") >= floor))


def risk_distribution(windows: DataFrame, column: str, edges: list[int]) -> DataFrame:
    """How many entities reach each edge."""
    reached = F.filter(F.array(*map(F.lit, edges)), lambda e: e <= F.col(column))
    return windows.select(F.explode(reached).alias("edge")).groupBy("edge").agg(F.count(F.lit(1)).alias("n"))


def number_changes(evidence: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """SIM changes of each number in the last days, clean ones apart."""
    day = F.lit(as_of).cast("date")
    recent = evidence.where(F.col("data_date").between(F.date_sub(day, days - 1), day))
    return recent.groupBy("msisdn").agg(F.count_if(F.col("set_aside") == "none").alias("clean"), F.count(F.lit(1)).alias("raw"))


def neighbours(state: DataFrame, kind: str) -> DataFrame:
    """For every entity of a kind its neighbours of the other kinds: bindings, active ones, last confirmed."""
    others = [c for c in ("msisdn", "imsi", "imei") if c != kind]
    cells = F.array(*(F.struct(F.lit(c).alias("neighbour_kind"), F.col(c).cast("string").alias("neighbour")) for c in others))
    rows = state.select(kind, "active", "last_change_date", F.inline(cells))
    return rows.groupBy(kind, "neighbour_kind", "neighbour").agg(F.count(F.lit(1)).alias("bindings"), F.sum("active").alias("active"), F.max("last_change_date").alias("last_confirmed"))


def paired_handsets(state: DataFrame, tac: DataFrame) -> DataFrame:
    """Dual-SIM pairs on a number: serial one apart in a model, or the same serial in models 100 apart of one name.

    Each handset names the partners it could have, so the pairs are found by an equi join.
    """
    names = tac.select("tac", F.lower(F.trim("marketingName")).alias("name"))
    own = state.where("active = 1 and length(imei) = 14").select("msisdn", "imei", "tac").distinct().join(names, "tac")
    head, serial = F.substring("imei", 1, 8), F.substring("imei", 9, 6)
    above = F.array(F.concat(head, F.lpad((serial.cast("int") + 1).cast("string"), 6, "0")), F.concat(F.lpad((head.cast("int") + 100).cast("string"), 8, "0"), serial))
    asks = own.select("msisdn", "imei", "name", F.explode(above).alias("partner"))
    have = own.select("msisdn", F.col("imei").alias("partner"), F.col("name").alias("partner_name"))
    return asks.join(have, ["msisdn", "partner"]).where("name = partner_name").select("msisdn", "imei", "partner")


def sim_facts(state: DataFrame) -> DataFrame:
    return state.groupBy("imsi").agg(
        F.count_distinct("msisdn").alias("numbers"), F.count_distinct("imei").alias("handsets"), F.sum("active").alias("active"), F.min("last_change_date").alias("first"), F.max("last_change_date").alias("last")
    )


def interval_join(rows: DataFrame, key: str, ranges: DataFrame) -> DataFrame:
    """Rows with every (low, high) range that their ``key`` (a whole number) lies in, for any number of ranges.

    A range has the level of the smallest power of ten that is no less than its length, so it meets
    one or two blocks of that size; rows ask in one block of each level that occurs (19 at most). An
    equi join on level and block finds the pairs, which the bounds then confirm. No side is broadcast
    unless Spark finds it small, and a hot block is split as any skewed join key is.
    """
    length = (F.col("high") - F.col("low") + 1).cast("string")
    power = F.length(length) - F.when(length.rlike("^10*$"), 1).otherwise(0)
    cut = ranges.where("low <= high").withColumn("_level", power).withColumn("_unit", F.expr("cast(pow(10, _level) as bigint)"))
    cut = cut.withColumn("_block", F.explode(F.array_distinct(F.array(F.expr("low div _unit"), F.expr("high div _unit"))))).drop("_unit")
    levels = [r[0] for r in cut.select("_level").distinct().collect()]  # 19 at most
    asks = F.array(*(F.struct(F.lit(k).alias("_level"), F.expr(f"{key} div {10**k}L").alias("_block")) for k in levels)) if levels else F.expr("cast(array() as array<struct<_level:int,_block:bigint>>)")
    asking = rows.select("*", F.inline(asks))
    return asking.join(cut, ["_level", "_block"]).where(F.col(key).between(F.col("low"), F.col("high"))).drop("_level", "_block")


def search_imsi(state: DataFrame, ranges: DataFrame, where: Column | None = None) -> DataFrame:
    """Bindings whose SIM lies in one of the (prefix, low, high) ranges, and that meet a condition; the outermost bounds prune the scan."""
    bounds = ranges.agg(F.min("low").alias("low"), F.max("high").alias("high")).first()
    asked = state.where(F.col("imsi").between(bounds["low"], bounds["high"])) if bounds["low"] is not None else state.limit(0)
    found = interval_join(asked if where is None else asked.where(where), "imsi", ranges)
    return found.select("prefix", "msisdn", "imsi", "imei", "active")


def _range_blocks(ranges: DataFrame) -> DataFrame:
    """Each (prefix, low, high) range as blocks of 10 ^ level numbers that it is made of: 18 of a level at most, none in two.

    Numbers have 18 digits at most. A range that stands twice counts twice.
    """
    inside = ranges.select("prefix", F.greatest("low", F.lit(0).cast("long")).alias("low"), F.least("high", F.lit(10**18 - 1)).alias("high")).where("low <= high")
    own = inside.groupBy("prefix", "low", "high").count().select("prefix", "low", "high", F.explode(F.sequence(F.lit(1), F.col("count").cast("int"))).alias("nth"))
    first = lambda k: F.expr(f"low div {10**k}L + if(low % {10**k}L = 0, 0, 1)")
    after = lambda k: F.expr(f"(high + 1) div {10**k}L")
    blocks = lambda start, end: F.when(start < end, F.sequence(start, end - 1)).otherwise(F.array().cast("array<bigint>"))
    at = lambda k: lambda x: F.struct(F.lit(k).alias("level"), x.alias("block"))
    parts = []
    for k in range(18):
        whole = first(k + 1) <= after(k + 1)  # blocks of the next level stand between those at both ends
        mine = F.when(whole, F.concat(blocks(first(k), first(k + 1) * 10), blocks(after(k + 1) * 10, after(k)))).otherwise(blocks(first(k), after(k)))
        parts.append(F.transform(F.when(first(k) < after(k), mine).otherwise(F.array().cast("array<bigint>")), at(k)))
    parts.append(F.transform(blocks(first(18), after(18)), at(18)))
    return own.select("prefix", "low", "high", "nth", F.inline(F.flatten(F.array(*parts))))


def _first_blocks(blocks: DataFrame, most: int) -> DataFrame:
    """The blocks of each range, in order, that its first ``most`` rows lie in."""
    order = Window.partitionBy("prefix", "low", "high", "nth").orderBy(F.col("block") * F.expr("cast(pow(10, level) as bigint)")).rowsBetween(Window.unboundedPreceding, -1)
    return blocks.where("total > 0").withColumn("_before", F.coalesce(F.sum("total").over(order), F.lit(0))).where(F.col("_before") < most).drop("_before")


def search_sims(flagged: DataFrame, ranges: DataFrame, devices: DataFrame, most: int, active: bool | None = None, device_type: str = "", maker: str = "", confirmed_from: str = "", confirmed_to: str = "") -> DataFrame:
    """The first ``most`` bindings of each term, with their models and how many were found, and how many no handset could carry.

    Rows without a handset are left out and counted apart. Filters are on activity, device type,
    maker and the day a binding was last confirmed. No row is paired with the ranges that it lies in: rows are counted by
    blocks of SIM numbers, a range adds up its blocks, and its page is found by descending to the SIMs that it begins with.
    """
    wanted = F.col("no_handset") == 0
    if active is not None:
        wanted &= F.col("active") == int(active)
    for value, column in ((device_type, "deviceType"), (maker, "manufacturer")):
        if value:
            wanted &= F.col(column) == value
    if confirmed_from:
        wanted &= F.col("last_change_date") >= F.lit(confirmed_from).cast("date")
    if confirmed_to:
        wanted &= F.col("last_change_date") <= F.lit(confirmed_to).cast("date")
    named = flagged.join(look_ups(devices, devices.select("tac", "manufacturer", "marketingName", "deviceType", "operatingSystem"))[0], "tac", "left")
    asked = cut(_range_blocks(ranges), "range_blocks")
    deepest = asked.agg(F.max("level")).first()[0] or 0
    levels = F.array(*(F.struct(F.lit(k).alias("level"), F.expr(f"imsi div {10**k}L").alias("block")) for k in range(deepest + 1)))
    sims = named.groupBy("imsi").agg(F.count_if(wanted).alias("total"), F.count_if(F.col("no_handset") == 1).alias("left_out"))
    counts = cut(sims.select("total", "left_out", F.inline(levels)).groupBy("level", "block").agg(F.sum("total").alias("total"), F.sum("left_out").alias("left_out")), "sim_blocks")
    found = asked.join(counts, ["level", "block"])
    sums = found.groupBy("prefix").agg(F.sum("total").alias("total"), F.sum("left_out").alias("left_out"))
    first = _first_blocks(found.drop("left_out"), most)
    for k in range(deepest, 0, -1):
        ten = F.array(*(F.struct(F.lit(k - 1).alias("level"), (F.col("block") * 10 + i).alias("block")) for i in range(10)))
        inner = F.when(F.col("level") == k, ten).otherwise(F.array(F.struct("level", "block")))
        below = first.select("prefix", "low", "high", "nth", F.inline(inner))
        first = _first_blocks(below.join(counts.where(F.col("level") < k).drop("left_out"), ["level", "block"]), most)
    rows = first.select("prefix", F.col("block").alias("imsi")).join(named.where(wanted), "imsi")
    order = Window.partitionBy("prefix").orderBy("imsi", F.desc("active"), "msisdn", "imei")
    page = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    columns = ["prefix", "place", "imsi", "msisdn", "imei", "tac", "manufacturer", "marketingName", "deviceType", "operatingSystem", "active", "last_change_date"]
    return page.join(sums, "prefix").select(*columns, "total", "left_out")


def prefix_ranges(spark: SparkSession, prefixes: list[str]) -> DataFrame:
    """A few prefixes with the ranges of SIM numbers that they stand for."""
    low, high = imsi_range(F.col("prefix"))
    return spark.createDataFrame([(p,) for p in prefixes], "prefix string").select("prefix", low.alias("low"), high.alias("high"))


def imsi_page(found: DataFrame, most: int) -> DataFrame:
    """The first ``most`` bindings of each prefix with the number of all that were found."""
    order = Window.partitionBy("prefix").orderBy("imsi", "msisdn", "imei")
    totals = found.groupBy("prefix").agg(F.count(F.lit(1)).alias("total"))
    ranked = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).drop("place")
    return ranked.join(F.broadcast(totals), "prefix")  # one row a prefix
