"""Delivery marts: one read of the current state, then merges of what each model holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindwell.functions.rules import counted_tac
from bindwell.sources.store import spread

UNKNOWN_DEVICE, UNKNOWN_TAC = "(unknown device)", "(unknown TAC)"
MEASURES = ("bindings", "subscribers", "handsets")


def with_vendor(tac: DataFrame, vendors: DataFrame) -> DataFrame:
    """The catalogue with each model's vendor: the canonical name, else the maker, else unknown."""
    joined = tac.join(vendors, F.col("manufacturer") == F.col("raw_manufacturer"), "left")
    name = F.coalesce(F.nullif("vendor_canonical", F.lit("")), F.nullif("manufacturer", F.lit("")), F.lit(UNKNOWN_TAC))
    return joined.select(tac["*"], name.alias("vendor"))


def _population(flagged: DataFrame, distinct) -> DataFrame:
    active = flagged.where("active = 1").withColumn("tac", counted_tac())
    short = F.length("imei") != 14
    return active.groupBy("tac").agg(
        F.count(F.lit(1)).alias("bindings"), F.count_if(F.col("imei") == "000000").alias("unknown_device"), F.count_if(short & (F.col("imei") != "000000")).alias("malformed_imei"),
        F.count_if(~short & (F.col("tac") == "")).alias("invalid_imei"), distinct(F.col("msisdn")).alias("subscribers"), distinct(F.col("imsi")).alias("sims"),
        distinct(F.when(F.col("tac") != "", F.col("imei"))).alias("handsets"), F.min("last_change_date").alias("first_seen"), F.max("last_change_date").alias("last_seen"),
    )


def tac_population(flagged: DataFrame) -> DataFrame:
    """Figures of each model, distinct ones exact."""
    return _population(flagged, F.count_distinct)


def tac_holders(flagged: DataFrame) -> DataFrame:
    """Handsets and SIMs of each model in the network, each counted over parts of their own: no row stands twice in one task."""
    held = flagged.where("active = 1 and no_handset = 0")
    counts = [spread(held.select("tac", c), flagged, c).groupBy("tac").agg(F.count_distinct(c).alias(name)) for c, name in (("imei", "handsets"), ("imsi", "sims"))]
    return counts[0].join(counts[1].hint("merge"), "tac")


def tac_population_sketch(flagged: DataFrame) -> DataFrame:
    """Figures of each model with mergeable HLL sketches, the states that later marts merge."""
    return _population(flagged.withColumn("imsi", F.col("imsi").cast("string")).withColumn("msisdn", F.col("msisdn").cast("string")), lambda c: F.hll_sketch_agg(c, 14))


def device_model(sketches: DataFrame) -> DataFrame:
    return sketches.select("tac", "bindings", *(F.hll_sketch_estimate(c).alias(c) for c in ("subscribers", "sims", "handsets")), "first_seen", "last_seen")


def merged(sketches: DataFrame, *by: str) -> DataFrame:
    """Bindings and estimates of any grouping of models."""
    return sketches.groupBy(*by).agg(F.sum("bindings").alias("bindings"), *(F.hll_sketch_estimate(F.hll_union_agg(c)).alias(c) for c in ("subscribers", "sims", "handsets")))


def _figures(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("bindings"), F.count_distinct("msisdn").alias("subscribers"), F.count_distinct("imsi").alias("sims"), F.count_distinct(F.when(F.col("tac") != "", F.col("imei"))).alias("handsets")
    )


def _active(flagged: DataFrame) -> DataFrame:
    return flagged.where("active = 1").select("msisdn", "imsi", "imei", counted_tac().alias("tac"))


def filter_population(flagged: DataFrame, devices: DataFrame) -> DataFrame:
    """Figures of every value that a dashboard can filter by; empty values have no row."""
    cells = F.array(*(F.struct(F.lit(name).alias("dimension"), F.trim(F.col(column)).alias("value")) for name, column in (("deviceType", "deviceType"), ("operatingSystem", "operatingSystem"), ("manufacturer", "manufacturer"), ("vendor", "vendor"))))
    rows = _active(flagged).join(devices, "tac").select("msisdn", "imsi", "imei", "tac", F.inline(cells)).where("value <> ''")
    known = _active(flagged).where("tac <> ''").select("msisdn", "imsi", "imei", "tac", F.lit("knownDevice").alias("dimension"), F.lit("yes").alias("value"))
    return _figures(rows.unionByName(known), "dimension", "value")


def kpi(flagged: DataFrame, tac: DataFrame) -> DataFrame:
    """The KPI row of the whole network."""
    active = _active(flagged).join(tac.select("tac", F.lit(1).alias("matched")), "tac", "left")
    short = F.length("imei") != 14
    return active.agg(
        F.count(F.lit(1)).alias("bindings"), F.count_distinct("msisdn").alias("subscribers"), F.count_distinct("imsi").alias("sims"), F.count_distinct(F.when(F.col("tac") != "", F.col("imei"))).alias("handsets"),
        F.count_if(F.col("imei") == "000000").alias("unknown_device"), F.count_if(short & (F.col("imei") != "000000")).alias("malformed_imei"),
        F.count_if(~short & (F.col("tac") == "")).alias("invalid_imei"), F.count_if(F.col("matched") == 1).alias("tac_matched"),
    )


def _long(df: DataFrame, key: str) -> DataFrame:
    return df.unpivot(key, list(MEASURES), "measure", "n")


def class_mix(flagged: DataFrame, radio: DataFrame) -> DataFrame:
    """Device classes by three measures."""
    name = F.when(F.col("tac") == "", "Unknown device").otherwise(F.coalesce("device_class", F.lit("Unregistered TAC")))
    rows = _active(flagged).join(radio.select("tac", "device_class"), "tac", "left").withColumn("device_class", name)
    return _long(_figures(rows, "device_class"), "device_class")


def capability_mart(flagged: DataFrame, radio: DataFrame) -> DataFrame:
    """Supported, unsupported and unknown by capability and measure; rows without a handset have none."""
    flags = F.array(*(F.struct(F.lit(c).alias("capability"), F.coalesce(F.col(c), F.lit(2)).alias("flag")) for c in ("lte", "nr", "esim", "ntn")))
    rows = _active(flagged).where("tac <> ''").join(radio.select("tac", "lte", "nr", "esim", "ntn"), "tac", "left").select("msisdn", "imsi", "imei", "tac", F.inline(flags))
    answer = F.when(F.col("flag") == 1, "supported").when(F.col("flag") == 0, "unsupported").otherwise("unknown")
    figures = _figures(rows.withColumn("answer", answer), "capability", "answer").unpivot(["capability", "answer"], list(MEASURES), "measure", "n")
    return figures.groupBy("capability", "measure").pivot("answer", ["supported", "unsupported", "unknown"]).agg(F.first("n")).fillna(0)


def dimension_mart(flagged: DataFrame, devices: DataFrame) -> DataFrame:
    """Figures by vendor, maker, model, type, system and TAC, with labels where there is no value."""
    label = lambda c: F.when(F.col("tac") == "", UNKNOWN_DEVICE).otherwise(F.coalesce(F.nullif(F.trim(F.col(c)), F.lit("")), F.lit(UNKNOWN_TAC)))
    names = (("vendor", "vendor"), ("manufacturer", "manufacturer"), ("model", "marketingName"), ("deviceType", "deviceType"), ("operatingSystem", "operatingSystem"))
    cells = [F.struct(F.lit(n).alias("dimension"), label(c).alias("value")) for n, c in names]
    cells.append(F.struct(F.lit("tac").alias("dimension"), F.when(F.col("tac") == "", UNKNOWN_DEVICE).otherwise(F.col("tac")).alias("value")))
    rows = _active(flagged).join(devices, "tac", "left").select("msisdn", "imsi", "imei", "tac", F.inline(F.array(*cells)))
    return _figures(rows, "dimension", "value")


def verify_marts(kpi_row: DataFrame, dimensions: DataFrame) -> DataFrame:
    """Every slice of the dimension mart must add up to the KPI row's bindings."""
    sums = dimensions.groupBy("dimension").agg(F.sum("bindings").alias("bindings"))
    return sums.crossJoin(F.broadcast(kpi_row.select(F.col("bindings").alias("expected")))).withColumn("ok", F.col("bindings") == F.col("expected"))


def top_share(mart: DataFrame, dimension: str, n: int, measure: str, total: DataFrame) -> DataFrame:
    """Top values of a dimension; the percentage is of the counted population, not of the page."""
    rows = mart.where((F.col("dimension") == dimension) & (F.col("value") != UNKNOWN_DEVICE)).orderBy(F.desc(measure), "value").limit(n)
    whole = F.broadcast(total.select(F.col(measure).alias("_whole")))  # one row
    share = F.round(100 * F.col(measure) / F.nullif("_whole", F.lit(0)), 3)
    return rows.crossJoin(whole).select("value", "bindings", "subscribers", "sims", "handsets", share.alias("percent"))
