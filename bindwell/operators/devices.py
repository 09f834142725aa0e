"""The device catalogue as a network sees it: lists, details, facets, arrivals and ages of models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindwell.functions.rules import look_ups
from bindwell.operators.marts import UNKNOWN_TAC

SEARCHED = ("tac", "manufacturer", "brandName", "modelName", "marketingName")
#: What a list can be sorted by.
SORTS = ("bindings", "handsets", "sims", "subscribers", "first_seen", "last_seen", "manufacturer", "marketingName")


def devices(population: DataFrame, catalogue: DataFrame, text: str = "", kind: str = "", vendor: str = "", sort: str = "bindings", descending: bool = True, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of models in the network, with the number of all that match. Ties end in the TAC, so that pages are stable."""
    if sort not in SORTS:
        raise ValueError(f"unknown sort {sort}")
    rows = population.where("tac <> ''").join(catalogue, "tac", "left")
    if text:
        wanted = F.lit(text.lower())
        found = F.lit(False)
        for c in SEARCHED:
            found = found | F.coalesce(F.lower(c).contains(wanted), F.lit(False))
        rows = rows.where(found)
    if kind:
        rows = rows.where(F.col("deviceType") == kind)
    if vendor:
        rows = rows.where(F.col("vendor") == vendor)
    total = rows.agg(F.count(F.lit(1)).alias("total"))  # a number of its own: no window over all rows
    order = F.desc_nulls_last(sort) if descending else F.asc_nulls_last(sort)
    page = rows.orderBy(order, "tac").offset(offset).limit(limit)
    return page.crossJoin(F.broadcast(total)).select("tac", "manufacturer", "vendor", "brandName", "modelName", "marketingName", "deviceType", "operatingSystem", "bindings", "handsets", "sims", "subscribers", "first_seen", "last_seen", "total")


def device_details(population: DataFrame, start: DataFrame, catalogue: DataFrame, radio: DataFrame) -> DataFrame:
    """Every model's figures, its population at the start, the network's at both ends, its share and capabilities; 2 is not stated."""
    named = lambda df, name: df.where("tac <> ''").select("tac", F.col("bindings").alias(name))
    whole = lambda df, name: df.where("tac <> ''").agg(F.sum("bindings").alias(name))
    rows = population.where("tac <> ''").join(named(start, "at_start"), "tac", "left").join(catalogue.select("tac", "vendor", "marketingName", "deviceType"), "tac", "left")
    rows = rows.join(radio.select("tac", "lte", "nr", "esim"), "tac", "left").crossJoin(F.broadcast(whole(population, "network_now"))).crossJoin(F.broadcast(whole(start, "network_start")))
    return rows.select(
        "tac", "vendor", "marketingName", "deviceType", "bindings", "handsets", "sims", "subscribers", "first_seen", "last_seen", F.coalesce("at_start", F.lit(0)).alias("at_start"), "network_now", "network_start",
        F.round(100 * F.col("bindings") / F.nullif("network_now", F.lit(0)), 4).alias("share"), *(F.coalesce(c, F.lit(2)).alias(c) for c in ("lte", "nr", "esim")), F.col("vendor").isNotNull().alias("registered"),
    )


def identifiers(state: DataFrame, models: list[str], active_only: bool = False, start: str | None = None, end: str | None = None, limit: int = 1000, offset: int = 0) -> DataFrame:
    """Bindings of models' handsets, as ranges of the IMEI layout, which column statistics can prune."""
    inside = F.lit(False)
    for tac in models:
        inside = inside | F.col("imei").between(f"{tac}000000", f"{tac}999999")
    rows = state.where(inside & (F.length("imei") == 14))
    if active_only:
        rows = rows.where("active = 1")
    if start:
        rows = rows.where(F.col("last_change_date").between(start, end))
    return rows.orderBy("imei", F.desc("active"), "imsi", "msisdn").offset(offset).limit(limit).select("imei", "imsi", "msisdn", "active", "last_change_date")


def facets(population: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Types, vendors and systems by the number of models in the network: the commonest 30, 40 and 30."""
    rows = population.where("tac <> ''").join(catalogue, "tac", "left")
    parts = []
    for facet, column, none, most in (("deviceType", "deviceType", "(not stated)", 30), ("manufacturer", "vendor", UNKNOWN_TAC, 40), ("os", "operatingSystem", "(not stated)", 30)):
        value = F.coalesce(F.nullif(F.trim(column) if facet == "os" else F.col(column), F.lit("")), F.lit(none))
        counts = rows.groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("models"))
        parts.append(counts.orderBy(F.desc("models"), "value").limit(most).select(F.lit(facet).alias("facet"), "value", "models"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def first_days(tac_day: DataFrame, dump: DataFrame) -> DataFrame:
    """For each model whether the dump has it, its first day, days seen and handsets of the first day.

    ``tac_day``: data_date, tac, handsets; ``dump``: tac, handsets. Both sides stand by model already, so merging moves nothing.
    """
    days = tac_day.groupBy("tac").agg(F.min("data_date").alias("first_day"), F.count(F.lit(1)).alias("days_seen"), F.min_by("handsets", "data_date").alias("first_day_handsets"))
    return days.join(dump.select("tac", F.lit(1).alias("in_dump")).distinct().hint("merge"), "tac", "full_outer").fillna(0, ["in_dump", "days_seen", "first_day_handsets"])


def new_models(firsts: DataFrame, population: DataFrame, tac: DataFrame, start: str, end: str, known_only: bool = False, brand: str = "", device_type: str = "") -> DataFrame:
    """Models that the dump lacks and whose first countable handset came in a range of days, with what they have come to.

    ``firsts`` as ``first_days`` gives it, ``population``: tac, handsets, sims as served. A brand is
    part of the brand's or else the maker's name, in any case.
    """
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    names = tac.select("tac", F.nullif(F.coalesce(blank("brandName"), F.col("manufacturer")), F.lit("")).alias("brand"), blank("marketingName").alias("model"), blank("deviceType").alias("device_type"), F.lit(1).alias("_known"))
    rows = firsts.where((F.col("in_dump") == 0) & (F.col("days_seen") > 0) & F.col("first_day").between(start, end)).join(look_ups(tac, names)[0], "tac", "left")
    if known_only:
        rows = rows.where("_known = 1")
    if brand:
        rows = rows.where(F.lower(F.coalesce("brand", F.lit(""))).contains(brand.lower()))
    if device_type:
        rows = rows.where(F.col("device_type") == device_type)
    return rows.join(population.select("tac", "handsets", "sims").hint("merge"), "tac", "left").select("tac", "brand", "model", "device_type", "first_day", "days_seen", "first_day_handsets", "handsets", "sims")


def arrivals(firsts: DataFrame, tac: DataFrame, grain: str) -> DataFrame:
    """New models by week or month, and those that the catalogue knows."""
    known = look_ups(tac, tac.select("tac", F.lit(1).alias("known")).distinct())[0]
    new = firsts.where("in_dump = 0 and days_seen > 0").join(known, "tac", "left")
    return new.groupBy(F.date_trunc(grain, "first_day").cast("date").alias("period")).agg(F.count(F.lit(1)).alias("models"), F.count("known").alias("known"))


def network_age(firsts: DataFrame, as_of: str) -> DataFrame:
    """Days since a model was first seen; a lower bound for those in the dump, which began before the first file."""
    first = F.when(F.col("in_dump") == 1, F.lit("2026-01-25").cast("date")).otherwise(F.col("first_day"))
    return firsts.select("tac", F.datediff(F.lit(as_of).cast("date"), first).alias("age"), (F.col("in_dump") == 1).alias("at_least"), "days_seen")
