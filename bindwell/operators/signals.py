"""Risk rules over measured windows: lists, levels and reasons of entities, linked entities and patterns.

Measures are rows (family, key, rule, value, raw, tacs, adds, aside), so that all rules are judged in one pass.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Levels.
OBSERVATION, ANOMALY, SIGNAL, PATTERN = 0, 1, 2, 3


@dataclass(frozen=True)
class Rule:
    """What a rule counts: on which family, over how many days (none: ever), from which columns, and which feed checks cast doubt on it."""

    name: str
    family: str
    days: int | None
    value: str
    raw: str | None
    checks: tuple[str, ...]
    tacs: str | None = None


_IMEI = ("shifted_imei", "multi_number_sim")
# The rules, in the order in which reasons are listed.
RULES = (
    Rule("shared_imei_sims_30", "imei", 30, "sims_30", "sims_30_raw", _IMEI),
    Rule("shared_imei_numbers_30", "imei", 30, "numbers_30", None, _IMEI),
    Rule("shared_imei_sims_ever", "imei", None, "sims_ever", None, ()),
    Rule("shared_imei_sims_not_removed", "imei", None, "sims_not_removed_dated", None, ()),
    Rule("high_device_count_30", "sim", 30, "imeis_30", "imeis_30_raw", (*_IMEI, "malformed_imei")),
    Rule("rapid_device_change_7", "sim", 7, "imeis_7", "imeis_7_raw", (*_IMEI, "malformed_imei")),
    Rule("randomisation_20", "sim", 20, "imeis_20", None, (*_IMEI, "malformed_imei"), "tacs_20"),
    Rule("repeated_sim_change_7", "number", 7, "clean", "raw", ("multi_number_sim",)),
)


def measures(sims: DataFrame, imeis: DataFrame, lifetimes: DataFrame, numbers: DataFrame) -> DataFrame:
    """All measures as rows, from the four tables of windows and counts."""
    sources = {
        "sim": (sims, "imsi", "adds_30", "adds_set_aside_30"), "imei": (imeis, "imei", "adds_30", "adds_set_aside_30"), "lifetime": (lifetimes, "imei", None, None), "number": (numbers, "msisdn", None, None),
    }
    out = None
    for name, (rows, key, adds, aside) in sources.items():
        mine = [r for r in RULES if (r.family if r.days else "lifetime") == name]
        amounts = (F.col("raw"), F.col("raw") - F.col("clean")) if name == "number" else (F.col(adds), F.col(aside)) if adds else (F.lit(0), F.lit(0))
        none = F.lit(None).cast("long")
        cells = F.array(*(
            F.struct(
                F.lit(r.name).alias("rule"), F.lit(r.family).alias("family"), F.col(r.value).cast("long").alias("value"), (F.col(r.raw).cast("long") if r.raw else none).alias("raw_value"),
                (F.col(r.tacs).cast("long") if r.tacs else none).alias("tacs"), amounts[0].cast("long").alias("adds"), amounts[1].cast("long").alias("aside"),
            ) for r in mine
        ))
        part = rows.select(F.col(key).cast("string").alias("key"), F.inline(cells))
        out = part if out is None else out.unionByName(part)
    return out


def _of_rule(pick) -> Column:
    """A number for each rule; null where there is none."""
    out = F.lit(None)
    for r in RULES:
        value = pick(r)
        if value is not None:
            out = F.when(F.col("rule") == r.name, F.lit(value)).otherwise(out)
    return out


def _judged(rows: DataFrame, thresholds: Mapping[str, int], tac_threshold: int, share: float) -> DataFrame:
    limit = _of_rule(lambda r: thresholds.get(r.name)).cast("long")
    many = F.col("tacs").isNull() | (F.col("tacs") > tac_threshold)
    crossed = F.coalesce((F.col("value") > limit) & many, F.lit(False))
    raw = F.coalesce((F.col("raw_value") > limit) & many, F.lit(False))
    return rows.withColumns({"threshold": limit, "crossed": crossed, "raw_crossed": raw, "assessable": F.col("aside") <= share * F.col("adds")})


def risk_list(rows: DataFrame, thresholds: Mapping[str, int], tac_threshold: int, share: float) -> DataFrame:
    """Entities of each rule's two views: ``risk`` if it is over the threshold on clean evidence that suffices, ``data_quality`` if
    only the raw count is over it or most evidence is set aside."""
    judged = _judged(rows, thresholds, tac_threshold, share)
    doubt = (F.col("raw_crossed") & ~F.col("crossed")) | (F.col("crossed") & ~F.col("assessable"))
    view = F.when(F.col("crossed") & F.col("assessable"), "risk").when(doubt, "data_quality")
    return judged.withColumn("view", view).where("view is not null").select("rule", "family", "key", "view", "value", "raw_value", "adds", "aside")


def risk_overview(listed: DataFrame) -> DataFrame:
    """How many entities each rule lists in each view."""
    return listed.groupBy("rule").agg(F.count_if(F.col("view") == "risk").alias("risk"), F.count_if(F.col("view") == "data_quality").alias("data_quality"))


def doubted_rules(assessed: DataFrame, as_of: str) -> DataFrame:
    """Rules whose window has days that were flagged for a check that bears on them, with the number of such days."""
    cells = F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(r.days).alias("days"), F.lit(c).alias("about")) for r in RULES if r.days for c in r.checks))
    flagged = assessed.where("flagged").select("data_date", "check", F.inline(cells)).where("check = about")
    day = F.lit(as_of).cast("date")
    inside = F.col("data_date").between(F.expr(f"date_sub(date'{as_of}', days - 1)"), day)
    return flagged.where(inside).groupBy("rule").agg(F.count_distinct("data_date").alias("flagged_days"))


def assess(rows: DataFrame, thresholds: Mapping[str, int], tac_threshold: int, share: float, doubted: DataFrame) -> DataFrame:
    """Each entity's level and reasons, the gravest first, from one row an entity and rule.

    A count of all time is an anomaly at most; so is a window that feed defects or flagged days cast doubt on.
    """
    judged = _judged(rows, thresholds, tac_threshold, share).join(F.broadcast(doubted), "rule", "left")  # a row a rule
    windowed = _of_rule(lambda r: int(r.days is not None)) == 1
    enough = (F.col("adds") <= 0) | (F.col("aside") / F.nullif(F.col("adds"), F.lit(0)) <= share)
    level = F.when(~F.col("crossed"), OBSERVATION).when(~windowed | ~enough | F.col("flagged_days").isNotNull(), ANOMALY).otherwise(SIGNAL)
    # numbers of each rule side by side are aggregated in hash tables; lists of reasons would be sorted
    mine = lambda r, c: F.max(F.when(F.col("rule") == r.name, c))
    numbers = [x for k, r in enumerate(RULES) for x in (mine(r, level).alias(f"_level{k}"), mine(r, F.col("value")).alias(f"_value{k}"))]
    sums = judged.groupBy("family", "key").agg(F.max(level).alias("level"), F.min(enough).alias("assessable"), *numbers)
    text = lambda k, r, n: F.when(F.col(f"_level{k}") == n, F.concat_ws(":", F.lit(r.name), F.lit(str(n)), F.col(f"_value{k}").cast("string")))
    reasons = F.concat_ws(",", *(text(k, r, n) for n in (SIGNAL, ANOMALY, OBSERVATION) for k, r in enumerate(RULES)))
    return sums.select("family", "key", "level", "assessable", reasons.alias("reasons"))


def linked(events: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Entities that were added beside one in the window: of a SIM its handsets and numbers, of a handset or number its SIMs."""
    day = F.lit(as_of).cast("date")
    added = events.where((F.col("label") == "add") & F.col("data_date").between(F.date_sub(day, days - 1), day)).select("msisdn", "imsi", "imei").distinct()
    sim, number, whole = F.col("imsi").cast("string"), F.col("msisdn").cast("string"), F.length("imei") == 14
    pair = lambda a, x, b, y: F.struct(F.lit(a).alias("family"), x.alias("key"), F.lit(b).alias("other_family"), y.alias("other"))
    pairs = F.array_compact(F.array(
        pair("sim", sim, "number", number), pair("number", number, "sim", sim), F.when(whole, pair("sim", sim, "imei", F.col("imei"))), F.when(whole, pair("imei", F.col("imei"), "sim", sim)),
    ))
    return added.select(F.inline(pairs)).distinct()


def patterns(assessed: DataFrame, links: DataFrame) -> DataFrame:
    """The level of each entity with those linked to it: a pattern if signals of two families stand among them, else the highest, a signal at most."""
    beside = links.join(assessed.select(F.col("family").alias("other_family"), F.col("key").alias("other"), "level"), ["other_family", "other"])
    own = assessed.select("family", "key", F.col("family").alias("other_family"), "level")
    every = own.unionByName(beside.select("family", "key", "other_family", "level").join(assessed.select("family", "key"), ["family", "key"], "left_semi"))
    sums = every.groupBy("family", "key").agg(F.count_distinct(F.when(F.col("level") >= SIGNAL, F.col("other_family"))).alias("families"), F.max("level").alias("top"), F.count(F.lit(1)).alias("entities"))
    return sums.select("family", "key", "families", "entities", F.when(F.col("families") >= 2, PATTERN).otherwise(F.least("top", F.lit(SIGNAL))).alias("level"))


def device_types(listed: DataFrame, sims: DataFrame, tac: DataFrame) -> DataFrame:
    """Device types of each rule's listed SIMs (by their commonest model) and handsets."""
    first = sims.select(F.col("imsi").cast("string").alias("key"), F.substring_index("top_tacs_20", ",", 1).alias("model"))
    of_sims = listed.where("family = 'sim'").join(first, "key", "left")
    of_imeis = listed.where("family = 'imei'").withColumn("model", F.substring("key", 1, 8))
    rows = of_sims.unionByName(of_imeis).join(tac.select(F.col("tac").alias("model"), "deviceType"), "model", "left")
    return rows.groupBy("rule", "view", F.coalesce(F.nullif("deviceType", F.lit("")), F.lit("Not in the catalogue")).alias("type")).agg(F.count(F.lit(1)).alias("entities"))


def distribution(windows: DataFrame, clean: str, raw: str, edges: list[int]) -> DataFrame:
    """How many entities reach each edge, on clean and on raw counts."""
    cells = F.array(*(F.struct(F.lit(e).alias("edge"), (F.col(clean) >= e).cast("int").alias("c"), (F.col(raw) >= e).cast("int").alias("r")) for e in edges))
    return windows.select(F.inline(cells)).groupBy("edge").agg(F.sum("c").alias("clean"), F.sum("r").alias("raw"))


def evidence_quality(overview: DataFrame, assessed: DataFrame, doubted: DataFrame) -> DataFrame:
    """For each rule what it lists, the share of data quality, capped or not, and flagged days."""
    share = F.round(100 * F.col("data_quality") / F.nullif(F.col("risk") + F.col("data_quality"), F.lit(0)), 3)
    days = assessed.where("flagged").agg(F.count_distinct("data_date").alias("all_flagged_days"))
    joined = overview.join(F.broadcast(doubted), "rule", "left").crossJoin(F.broadcast(days))
    return joined.select("rule", "risk", "data_quality", share.alias("data_quality_share"), F.col("flagged_days").isNotNull().alias("capped"), F.coalesce("flagged_days", F.lit(0)).alias("flagged_days"), "all_flagged_days")
