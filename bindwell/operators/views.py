"""Planning views: who is struck by a sunset, what models can do, who moves to which model, and lists of numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bindwell.operators.planning import NOT_ASSESSED

SUNSET = {1: "ready-lte", 2: "ready-lpwan", 3: "exposed", 4: "not-assessable"}
ESIM = {0: "not-capable", 1: "capable", 2: "not-stated"}


def number_model(stage: DataFrame, numbers: DataFrame) -> DataFrame:
    """Who holds which model, with the number's classes and counts."""
    held = stage.select("msisdn", "tac").distinct()
    return held.join(numbers.select("msisdn", "sunset", "reason", "esim", "handsets", "bindings"), "msisdn")


def iot_devices(events: DataFrame, snapshot: DataFrame, flagged: DataFrame, radio: DataFrame, as_of: str, recent: int = 90) -> DataFrame:
    """Devices of the IoT class: SIMs and numbers ever, active and first seen lately, first day, and whether the dump has them."""
    models = radio.where("device_class = 'IoT / M2M'").select("tac")
    devices = flagged.where("countable = 1").join(models, "tac", "left_semi").select("msisdn", "imsi", "imei", "tac", "active")
    first = events.groupBy("msisdn", "imsi", "imei").agg(F.min("data_date").alias("first"))
    dump = snapshot.select("msisdn", "imsi", "imei", F.lit(1).alias("dump"))
    rows = devices.join(first, ["msisdn", "imsi", "imei"], "left").join(dump, ["msisdn", "imsi", "imei"], "left")
    late = F.col("first") >= F.date_sub(F.lit(as_of).cast("date"), recent - 1)
    active = F.col("active") == 1
    return rows.groupBy("imei", "tac").agg(
        F.count_distinct("imsi").alias("sims_ever"), F.count_distinct("msisdn").alias("numbers_ever"), F.count_distinct(F.when(active, F.col("imsi"))).alias("sims_active"),
        F.count_distinct(F.when(active, F.col("msisdn"))).alias("numbers_active"), F.count_distinct(F.when(late, F.col("imsi"))).alias("sims_90"), F.min("first").alias("first_date"), F.coalesce(F.max("dump"), F.lit(0)).alias("in_dump"),
    )


def iot_rotation(devices: DataFrame) -> DataFrame:
    """Active devices by how many SIMs each has carried."""
    sims = F.col("sims_ever")
    bucket = F.when(sims <= 1, "1 SIM").when(sims == 2, "2 SIMs").when(sims <= 5, "3-5 SIMs").when(sims <= 10, "6-10 SIMs").when(sims <= 50, "11-50 SIMs").otherwise("more than 50 SIMs")
    return devices.where("numbers_active > 0").groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("devices"), F.sum("numbers_active").alias("numbers_active"))


def change_kind(events: DataFrame, tac: DataFrame) -> DataFrame:
    """Spell events with both models and the kind of a change: 4 the same model (TAC or name), 1 a later allocation, 2 an earlier
    one, 3 neither can be said, 0 no change."""
    date = F.to_date(F.try_to_timestamp("allocationDate", F.lit("dd-MMM-yyyy")))
    models = tac.select("tac", F.coalesce("marketingName", F.lit("")).alias("name"), date.alias("allocated"))
    of = lambda side: models.select(*(F.col(c).alias(f"{side}_{c}") for c in models.columns))
    rows = events.withColumn("from_tac", F.substring("imei", 1, 8)).withColumn("to_tac", F.substring("next_imei", 1, 8))
    rows = rows.join(of("from"), "from_tac", "left").join(of("to"), "to_tac", "left")
    same = (F.col("from_tac") == F.col("to_tac")) | ((F.col("from_name") != "") & (F.col("from_name") == F.col("to_name")))
    a, b = F.col("from_allocated"), F.col("to_allocated")
    kind = F.when(same, 4).when(a.isNull() | b.isNull() | (a == b), 3).when(b > a, 1).otherwise(2)
    return rows.select(*events.columns, "from_tac", "to_tac", F.when(F.col("outcome") == 1, kind).otherwise(0).alias("kind"))


def tenure(kinds: DataFrame) -> DataFrame:
    """Spells by cohort, length, outcome and kind of change."""
    return kinds.groupBy("cohort", "days", "outcome", "kind").agg(F.count(F.lit(1)).alias("n"))


def changes(kinds: DataFrame) -> DataFrame:
    """Moves from model to model by month."""
    return kinds.where("outcome = 1").groupBy("month", "from_tac", "to_tac", "kind").agg(F.count(F.lit(1)).alias("changes"))


def vendor_moves(moves: DataFrame, devices: DataFrame, n: int) -> DataFrame:
    """The commonest moves between vendors, staying included."""
    of = lambda side: devices.select(F.col("tac").alias(f"{side}_tac"), F.col("vendor").alias(f"{side}_vendor"))
    rows = moves.join(of("from"), "from_tac", "left").join(of("to"), "to_tac", "left").fillna("(unknown TAC)", ["from_vendor", "to_vendor"])
    return rows.groupBy("from_vendor", "to_vendor").agg(F.sum("changes").alias("changes")).orderBy(F.desc("changes"), "from_vendor", "to_vendor").limit(n)


def change_kinds(moves: DataFrame) -> DataFrame:
    """Changes by kind with their share."""
    sums = moves.groupBy("kind").agg(F.sum("changes").alias("changes"))
    return sums.withColumn("percent", F.round(100 * F.col("changes") / F.sum("changes").over(Window.partitionBy(F.lit(1))), 3))


def survival_figures(curve: DataFrame, horizons: list[int], by: str = "cohort") -> DataFrame:
    """The share still in use at each horizon, and the median of days: the first day with half or fewer in use."""
    at = [F.coalesce(F.max_by("share", F.when(F.col("days") <= h, F.col("days"))), F.lit(1.0)).alias(f"at_{h}") for h in horizons]
    return curve.groupBy(by).agg(*at, F.min(F.when(F.col("share") <= 0.5, F.col("days"))).alias("median_days"))


def class_view(numbers: DataFrame, view: str) -> DataFrame:
    """Classes of the sunset or eSIM view: numbers, bindings, handsets, share, and how many are GSM only, IoT and paired."""
    names = SUNSET if view == "sunset" else ESIM
    label = F.lit(None).cast("string")
    for k, name in names.items():
        label = F.when(F.col(view) == k, name).otherwise(label)
    sums = numbers.groupBy(label.alias("class")).agg(
        F.count(F.lit(1)).alias("numbers"), F.sum("bindings").alias("bindings"), F.sum("handsets").alias("handsets"), F.sum("gsm_only").alias("gsm_only"), F.sum("iot").alias("iot"), F.sum("paired").alias("paired")
    )
    return sums.withColumn("percent", F.round(100 * F.col("numbers") / F.sum("numbers").over(Window.partitionBy(F.lit(1))), 3))


def not_assessable(numbers: DataFrame) -> DataFrame:
    """Why numbers could not be assessed."""
    return numbers.where("sunset = 4").groupBy("reason").agg(F.count(F.lit(1)).alias("numbers"))


def _figures(rows: DataFrame, *by) -> DataFrame:
    return rows.groupBy(*by).agg(F.count_distinct("msisdn").alias("numbers"), F.count(F.lit(1)).alias("bindings"), F.count_distinct("imei").alias("handsets"))


def _held(flagged: DataFrame) -> DataFrame:
    return flagged.where("active = 1 and no_handset = 0").select("msisdn", "imei", "tac")


def class_rows(flagged: DataFrame, radio: DataFrame, name: Column, where: Column | None = None) -> DataFrame:
    """The population of the models in each class of an expression over their radio profile."""
    models = (radio if where is None else radio.where(where)).select("tac", name.alias("class"))
    return _figures(_held(flagged).join(models, "tac"), "class")


def band_match(technology: str, mine: list[int]) -> Column:
    """Whether a model lists every, some or none of an operator's bands."""
    have, wanted = F.col(f"{technology}_bands"), F.array(*map(F.lit, mine))
    missing = F.size(F.array_except(wanted, have))
    return F.when(F.size(have) == 0, f"{technology}-no-bands").when(missing == 0, f"{technology}-all").when(F.arrays_overlap(have, wanted), f"{technology}-some").otherwise(f"{technology}-none")


def architecture() -> Column:
    sa, nsa = F.col("sa") == 1, F.col("nsa") == 1
    return F.when(sa & nsa, "arch-both").when(sa, "arch-sa").when(nsa, "arch-nsa").otherwise("arch-not-stated")


def ntn_class() -> Column:
    return F.when(F.col("ntn") == 1, "ntn").when(F.col("satellite") == 1, "satellite").when(F.col("ntn") == 0, "not-capable").otherwise("not-stated")


def exposure() -> Column:
    """What an IoT model is left with after 2G and 3G."""
    s = F.col("sunset")
    return F.when((s == 3) & (F.col("umts") == 0), "2g-only").when(s == 3, "2g-3g").when(s == 2, "lpwan").when(s == 1, "lte").otherwise("unknown")


def band_figures(flagged: DataFrame, radio: DataFrame) -> DataFrame:
    """Population of the models that list each LTE and NR band, of each 5G architecture, and of models with unread band text."""
    item = lambda technology: F.transform(f"{technology}_bands", lambda b: F.concat(F.lit(f"{technology}:"), b.cast("string")))
    arch = F.array_compact(F.array(F.when(F.col("nr") == 1, architecture()), F.when(F.size("unparsed") > 0, "ambiguous")))
    models = radio.select("tac", F.explode(F.concat(item("lte"), item("nr"), arch)).alias("item"))
    return _figures(_held(flagged).join(models, "tac"), "item")


def ntn_view(flagged: DataFrame, radio: DataFrame) -> DataFrame:
    """Population of satellite-capable models by mode, orbit and band."""
    none = F.lit("not-stated")
    bands = F.when(F.size("ntn_bands") == 0, F.array(none)).otherwise(F.col("ntn_bands"))
    cell = lambda by, key: F.struct(F.lit(by).alias("by"), key.alias("key"))
    cells = F.concat(F.array(cell("mode", F.coalesce("ntn_mode", none)), cell("orbit", F.coalesce("ntn_orbits", none))), F.transform(bands, lambda b: cell("band", b)))
    models = radio.where("ntn = 1").select("tac", F.inline(cells))
    return _figures(_held(flagged).join(models, "tac"), "by", "key")


def class_breakdown(stage: DataFrame, numbers: DataFrame, devices: DataFrame, view: str, cls: int, by: str, n: int) -> DataFrame:
    """A class by vendor, model or TAC: the page is picked by bindings, then the page alone is counted."""
    names = devices.select("tac", "vendor", F.concat_ws(" ", "vendor", F.nullif("marketingName", F.lit(""))).alias("model"))
    rows = stage.join(numbers.where(F.col(view) == cls).select("msisdn"), "msisdn", "left_semi").join(names, "tac", "left")
    keyed = rows.withColumn("key", F.col("tac") if by == "tac" else F.coalesce(by, F.lit("(unknown TAC)")))
    page = keyed.groupBy("key").agg(F.sum("bindings").alias("bindings")).orderBy(F.desc("bindings"), "key").limit(n)
    counts = keyed.join(F.broadcast(page.select("key")), "key", "left_semi").groupBy("key").agg(F.count_distinct("msisdn").alias("numbers"), F.count_distinct("imei").alias("handsets"))
    return page.join(counts, "key")


def class_numbers(index: DataFrame, devices: DataFrame, view: str, cls: int, vendor: str = "", kind: str = "", limit: int | None = None, offset: int = 0) -> DataFrame:
    """Numbers of a class, narrowed by vendor or device type of a model they hold; all of them without a limit."""
    rows = index.where(F.col(view) == cls)
    if vendor or kind:
        models = devices.where((F.col("vendor") == vendor) if vendor else F.lit(True)).where((F.col("deviceType") == kind) if kind else F.lit(True))
        rows = rows.join(models.select("tac"), "tac", "left_semi")
    out = rows.select("msisdn", "sunset", "reason", "esim", "handsets", "bindings").dropDuplicates(["msisdn"])
    return out if limit is None else out.orderBy("msisdn").offset(offset).limit(limit)


def campaign(index: DataFrame, devices: DataFrame, view: str, cls: int) -> DataFrame:
    """All numbers of a class with the models they hold, one line each, for an export."""
    named = index.where(F.col(view) == cls).join(devices.select("tac", "vendor", "marketingName"), "tac", "left")
    model = F.when(F.col("tac") == "", F.lit(None)).otherwise(F.concat_ws(" ", F.coalesce("vendor", F.lit("(unknown TAC)")), F.coalesce("marketingName", F.col("tac"))))
    return named.groupBy("msisdn").agg(F.first("handsets").alias("handsets"), F.first("bindings").alias("bindings"), F.array_join(F.array_sort(F.collect_set(model)), "; ").alias("models"))


def model_trend(states: dict[int, DataFrame], radio: DataFrame, name: Column, none: str) -> DataFrame:
    """The population of each class of models after each of a few deliveries. ``states``: sequence to flagged state."""
    parts = None
    for seq, flagged in states.items():
        one = _held(flagged).withColumn("seq", F.lit(seq))
        parts = one if parts is None else parts.unionByName(one)
    classes = radio.select("tac", name.alias("class"))
    return _figures(parts.join(classes, "tac", "left").withColumn("class", F.coalesce("class", F.lit(none))), "seq", "class")


def assessed_only(events: DataFrame) -> DataFrame:
    return events.where(F.col("outcome") != NOT_ASSESSED)
