"""The models' mart: a row a model with counts that add up and sketches that merge.

The state is read once, when the mart is written. KPI rows, dimensions, filters, rankings and lenses
over models are merged from the mart's few rows; their distinct counts are estimates of HyperLogLog
sketches (a standard error of 0.8 %), which merge without counting anyone twice.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bindwell.functions.rules import counted_tac
from bindwell.operators.dashboard import COLUMNS
from bindwell.operators.marts import UNKNOWN_DEVICE, UNKNOWN_TAC

SKETCHES = ("subscribers", "sims", "handsets")
COUNTS = ("bindings", "unknown_device", "malformed_imei", "invalid_imei")
#: 2 ^ this many registers a sketch: 16 KB at most.
REGISTERS = 14


def state_mart(flagged: DataFrame) -> DataFrame:
    """Active bindings by the TAC they are counted under (empty: no handset could carry the row)."""
    rows = flagged.where("active = 1").withColumn("tac", counted_tac())
    short = F.length("imei") != 14
    sketch = lambda c, name: F.hll_sketch_agg(c.cast("string"), REGISTERS).alias(name)
    return rows.groupBy("tac").agg(
        F.count(F.lit(1)).alias("bindings"), F.count_if(F.col("imei") == "000000").alias("unknown_device"), F.count_if(short & (F.col("imei") != "000000")).alias("malformed_imei"),
        F.count_if(~short & (F.col("tac") == "")).alias("invalid_imei"), sketch(F.col("msisdn"), "subscribers"), sketch(F.col("imsi"), "sims"), sketch(F.when(F.col("tac") != "", F.col("imei")), "handsets"),
        F.min("last_change_date").alias("first_seen"), F.max("last_change_date").alias("last_seen"),
    )


def merge(rows: DataFrame, *by: str) -> DataFrame:
    """Counts added and sketches merged for any grouping."""
    return rows.groupBy(*by).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS), *(F.hll_union_agg(c).alias(c) for c in SKETCHES))


def estimated(rows: DataFrame) -> DataFrame:
    """Sketches as the numbers they stand for."""
    return rows.withColumns({c: F.coalesce(F.hll_sketch_estimate(c), F.lit(0)) for c in SKETCHES})


def under(mart: DataFrame, devices: DataFrame, lens: dict) -> DataFrame:
    """The mart's rows that a lens on models lets through, with the model's columns and ``matched``.

    A lens names any of manufacturer, device_type, system, tac and vendor, and whether rows that no
    handset carries are left in. A lens on numbers needs the state itself.
    """
    if lens.get("number_prefix"):
        raise ValueError("the models' mart knows no numbers: read the state for a lens on them")
    models = devices
    for field, column in (("manufacturer", F.col("manufacturer")), ("device_type", F.col("deviceType")), ("system", F.trim("operatingSystem")), ("tac", F.col("tac")), ("vendor", F.col("vendor"))):
        if lens.get(field):
            models = models.where(column == lens[field].strip())
    asked = any(lens.get(x) for x in ("manufacturer", "device_type", "system", "tac", "vendor"))
    rows = mart if lens.get("with_unknown") else mart.where("tac <> ''")
    named = models.select("tac", "manufacturer", "marketingName", "deviceType", "operatingSystem", "vendor", F.lit(1).alias("matched"))
    return rows.join(named, "tac", "inner" if asked else "left")


def kpi_of(rows: DataFrame) -> DataFrame:
    """The KPI row of some of the mart's rows; nothing gives zeros."""
    sums = rows.agg(
        *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS), *(F.hll_union_agg(c).alias(c) for c in SKETCHES), F.coalesce(F.sum(F.when(F.col("matched") == 1, F.col("bindings"))), F.lit(0)).alias("tac_matched")
    )
    return sums.withColumn("coverage", F.coalesce(F.round(100 * F.col("tac_matched") / F.nullif("bindings", F.lit(0)), 3), F.lit(0.0)))


def _label(column: str) -> Column:
    known = F.coalesce(F.nullif(F.trim(F.col(column)), F.lit("")), F.lit(UNKNOWN_TAC))
    return F.when(F.col("tac") == "", UNKNOWN_DEVICE).otherwise(F.when(F.col("matched") == 1, known).otherwise(UNKNOWN_TAC))


def dimensions_of(mart: DataFrame, devices: DataFrame) -> DataFrame:
    """Merged rows by vendor, maker, model, type, system and TAC; sketches stay mergeable."""
    cells = [F.struct(F.lit(name).alias("dimension"), _label(column).alias("value")) for name, column in COLUMNS.items() if name != "tac"]
    cells.append(F.struct(F.lit("tac").alias("dimension"), F.when(F.col("tac") == "", UNKNOWN_DEVICE).otherwise(F.col("tac")).alias("value")))
    rows = under(mart, devices, {"with_unknown": True}).select(*COUNTS, *SKETCHES, F.inline(F.array(*cells)))
    return merge(rows, "dimension", "value")


def top_of(rows: DataFrame, dimension: str, n: int, measure: str = "bindings") -> DataFrame:
    """The first values of a dimension among the mart's rows, each with its share of all rows' figure."""
    named = rows.withColumn("value", _label(COLUMNS[dimension]))
    figure = F.sum("bindings") if measure == "bindings" else F.hll_sketch_estimate(F.hll_union_agg(measure))
    sums = named.groupingSets([["value"], []], "value").agg(figure.alias("n"), F.grouping("value").alias("whole"))
    total = F.max(F.when(F.col("whole") == 1, F.col("n"))).over(Window.partitionBy(F.lit(1)))  # a row a value
    shares = sums.withColumn("total", total).where("whole = 0").select("value", "n", F.round(100 * F.col("n") / F.nullif("total", F.lit(0)), 3).alias("percent"))
    return shares.orderBy(F.desc("n"), "value").limit(n)


def classes_of(mart: DataFrame, radio: DataFrame) -> DataFrame:
    """Merged rows by device class."""
    name = F.when(F.col("tac") == "", "Unknown device").otherwise(F.coalesce("device_class", F.lit("Unregistered TAC")))
    return merge(mart.join(radio.select("tac", "device_class"), "tac", "left").withColumn("device_class", name), "device_class")


def capabilities_of(mart: DataFrame, radio: DataFrame) -> DataFrame:
    """Merged rows by capability and answer; rows without a handset have none."""
    flags = F.array(*(F.struct(F.lit(c).alias("capability"), F.coalesce(F.col(c), F.lit(2)).alias("flag")) for c in ("lte", "nr", "esim", "ntn")))
    rows = mart.where("tac <> ''").join(radio.select("tac", "lte", "nr", "esim", "ntn"), "tac", "left").select(*COUNTS, *SKETCHES, F.inline(flags))
    answer = F.when(F.col("flag") == 1, "supported").when(F.col("flag") == 0, "unsupported").otherwise("unknown")
    return merge(rows.withColumn("answer", answer), "capability", "answer")


def expectations(slices: DataFrame, whole: DataFrame, wanted: Iterable[str] = tuple(COLUMNS)) -> DataFrame:
    """What must hold of a mart of slices against its KPI row: (dimension, check, expected, found, ok).

    Every wanted dimension is there; no value stands twice; counts add up to the KPI row's, and merged
    sketches give its estimates. One aggregate by dimension, whatever the number of checks.
    """
    spark = slices.sparkSession
    names = spark.createDataFrame([(d,) for d in wanted], "dimension string")
    by_dimension = slices.groupBy("dimension").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("value").alias("values"), *(F.sum(c).alias(c) for c in COUNTS), *(F.hll_sketch_estimate(F.hll_union_agg(c)).alias(c) for c in SKETCHES)
    )
    expected = estimated(whole).select(*(F.col(c).alias(f"{c}_expected") for c in (*COUNTS, *SKETCHES)))
    both = names.join(by_dimension, "dimension", "left").crossJoin(F.broadcast(expected))  # one row
    cell = lambda check, want, got: F.struct(F.lit(check).alias("check"), want.cast("long").alias("expected"), F.coalesce(got, F.lit(0)).cast("long").alias("found"))
    cells = [cell("present", F.lit(1), (F.col("rows") > 0).cast("int")), cell("no_repeats", F.lit(0), F.col("rows") - F.col("values"))]
    cells += [cell(c, F.col(f"{c}_expected"), F.col(c)) for c in (*COUNTS, *SKETCHES)]
    return both.select("dimension", F.inline(F.array(*cells))).withColumn("ok", F.col("expected") == F.col("found"))
