"""What dashboards read: figures under a lens, rankings, series by day, and comparisons of periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bindwell.functions.rules import counted_tac
from bindwell.operators import daily, fold
from bindwell.operators.marts import UNKNOWN_DEVICE, UNKNOWN_TAC

COLUMNS = {"vendor": "vendor", "manufacturer": "manufacturer", "model": "marketingName", "deviceType": "deviceType", "operatingSystem": "operatingSystem", "tac": "tac"}
#: A vendor's growth is only ranked from this population on.
LEAST_BASE = 100_000
#: Models of a lens up to which they are broadcast, with their names (about 50 MB).
MOST_MODELS = 250_000


def apply_lens(flagged: DataFrame, devices: DataFrame, lens: dict) -> DataFrame:
    """Active bindings with their model that a lens lets through.

    A lens names any of manufacturer, device_type, system, tac, vendor and number_prefix, and whether rows
    that no handset carries are left in. Conditions on models reach the catalogue before the join.
    """
    models = devices
    for field, column in (("manufacturer", F.col("manufacturer")), ("device_type", F.col("deviceType")), ("system", F.trim("operatingSystem")), ("tac", F.col("tac")), ("vendor", F.col("vendor"))):
        if lens.get(field):
            models = models.where(column == lens[field].strip())
    rows = flagged.where("active = 1").select("msisdn", "imsi", "imei", "no_handset", counted_tac().alias("tac"))
    if lens.get("number_prefix"):
        rows = rows.where(F.col("msisdn").cast("string").startswith(lens["number_prefix"]))
    if not lens.get("with_unknown"):
        rows = rows.where("no_handset = 0")
    named = models.select("tac", "manufacturer", "marketingName", "deviceType", "operatingSystem", "vendor", F.lit(1).alias("matched"))
    asked = any(lens.get(x) for x in ("manufacturer", "device_type", "system", "tac", "vendor"))
    if asked:  # few models: bindings of the others are dropped where they are read
        return rows.join(F.broadcast(named) if models.count() <= MOST_MODELS else named, "tac")
    return rows.join(named, "tac", "left")


def kpi_under(rows: DataFrame) -> DataFrame:
    """The KPI row of the bindings that a lens let through; nothing gives zeros."""
    whole = F.length("imei") == 14
    figures = rows.agg(
        F.count(F.lit(1)).alias("bindings"), F.count_distinct("msisdn").alias("subscribers"), F.count_distinct("imsi").alias("sims"), F.count_distinct(F.when(F.col("no_handset") == 0, F.col("imei"))).alias("handsets"),
        F.count_if(F.col("imei") == "000000").alias("unknown_device"), F.count_if(~whole & (F.col("imei") != "000000")).alias("malformed_imei"),
        F.count_if(whole & (F.col("no_handset") == 1)).alias("invalid_imei"), F.count_if(F.col("matched") == 1).alias("tac_matched"),
    )
    return figures.withColumn("coverage", F.coalesce(F.round(100 * F.col("tac_matched") / F.nullif("bindings", F.lit(0)), 3), F.lit(0.0)))


def top_under(rows: DataFrame, dimension: str, n: int, measure: str = "bindings") -> DataFrame:
    """Top values of a dimension under a lens. The share is of the ungrouped figure, which the empty grouping set gives in the same pass."""
    figure = {"bindings": F.count(F.lit(1)), "subscribers": F.count_distinct("msisdn"), "handsets": F.count_distinct(F.when(F.col("no_handset") == 0, F.col("imei")))}[measure]
    known = F.coalesce(F.nullif(F.trim(F.col(COLUMNS[dimension])), F.lit("")), F.lit(UNKNOWN_TAC))
    named = rows.withColumn("value", F.when(F.col("tac") == "", UNKNOWN_DEVICE).otherwise(F.when(F.col("matched") == 1, known).otherwise(UNKNOWN_TAC)))
    sums = named.groupingSets([["value"], []], "value").agg(figure.alias("n"), F.grouping("value").alias("whole"))
    total = F.max(F.when(F.col("whole") == 1, F.col("n"))).over(Window.partitionBy(F.lit(1)))  # one row a value
    shares = sums.withColumn("total", total).where("whole = 0").select("value", "n", F.round(100 * F.col("n") / F.nullif("total", F.lit(0)), 3).alias("percent"))
    return shares.orderBy(F.desc("n"), "value").limit(n)


def change_series(changes: DataFrame, first: int, last: int) -> DataFrame:
    """Adds and removes of each delivery in a range, of rows with a TAC. ``changes``: seq, data_date, tac, label, n."""
    inside = changes.where(F.col("seq").between(first, last) & (F.col("tac") != ""))
    of = lambda label: F.sum(F.when(F.col("label") == label, F.col("n")).otherwise(0)).alias(f"{label}s")
    return inside.groupBy("seq").agg(F.min("data_date").alias("data_date"), of("add"), of("remove"))


def daily_changes(events: DataFrame, flagged: DataFrame) -> DataFrame:
    """Changes a day and the population at its end, anchored on the served state's population at the newest day.

    Events without a TAC are left out, as such rows are left out of the population. The window runs over days.
    """
    days = daily.change_summary(events.where("tac <> ''")).select("data_date", "added", "removed")
    served = flagged.where("active = 1 and no_handset = 0").agg(F.count(F.lit(1)).alias("now"))
    net = F.col("added") - F.col("removed")
    later = F.sum(net).over(Window.orderBy(F.desc("data_date")))
    return days.crossJoin(F.broadcast(served)).select("data_date", "added", "removed", net.alias("net"), (F.col("now") - later + net).alias("cumulative"))


def daily_churn(events: DataFrame) -> DataFrame:
    """SIM and handset changes of each day."""
    sim = daily.sim_changes(events).select("data_date", F.col("changes").alias("sim"), F.lit(0).alias("dev"))
    dev = daily.device_changes(events).select("data_date", F.lit(0).alias("sim"), F.col("changes").alias("dev"))
    return sim.unionByName(dev).groupBy("data_date").agg(F.sum("sim").alias("sim_changes"), F.sum("dev").alias("device_changes"))


def population_trend(changes: DataFrame, grain: str) -> DataFrame:
    """The population at the last delivered day of each day, week or month. ``changes``: data_date, cumulative."""
    bucket = F.date_trunc(grain, "data_date").cast("date").alias("bucket")
    return changes.groupBy(bucket).agg(F.max("data_date").alias("last_day"), F.max_by("cumulative", "data_date").alias("population"))


def _vendor_counts(state: DataFrame, devices: DataFrame, name: str) -> DataFrame:
    counted = state.where("active = 1 and no_handset = 0").join(devices.select("tac", "vendor"), "tac", "left")
    return counted.groupBy(F.coalesce("vendor", F.lit(UNKNOWN_TAC)).alias("vendor")).agg(F.count(F.lit(1)).alias(name))


def vendor_movement(events: DataFrame, before: DataFrame, now: DataFrame, devices: DataFrame, start: str, end: str) -> DataFrame:
    """Each vendor's adds and removes in a window, population at both ends, share, change, and points against the network.

    ``before`` and ``now`` are flagged states.
    """
    counts = _vendor_counts(before, devices, "at_start").join(_vendor_counts(now, devices, "at_end"), "vendor", "full_outer").fillna(0, ["at_start", "at_end"])
    moved = events.where(F.col("data_date").between(start, end)).join(devices.select("tac", "vendor"), "tac", "left")
    name = F.when(F.col("tac") == "", UNKNOWN_DEVICE).otherwise(F.coalesce("vendor", F.lit(UNKNOWN_TAC)))
    movement = moved.groupBy(name.alias("vendor")).agg(F.count_if(F.col("label") == "add").alias("added"), F.count_if(F.col("label") == "remove").alias("removed"))
    network = counts.agg(F.sum("at_start").alias("total_start"), F.sum("at_end").alias("total_end"))
    joined = counts.join(movement, "vendor", "left").fillna(0, ["added", "removed"]).crossJoin(F.broadcast(network))
    change = F.col("at_end") - F.col("at_start")
    grown = 100 * change / F.nullif("at_start", F.lit(0))
    whole = 100 * (F.col("total_end") - F.col("total_start")) / F.nullif("total_start", F.lit(0))
    net = F.col("added") - F.col("removed")
    return joined.select(
        "vendor", "added", "removed", net.alias("net"), F.col("at_end").alias("population"), F.col("at_start").alias("population_at_start"), change.alias("population_change"),
        F.round(100 * F.col("at_end") / F.nullif("total_end", F.lit(0)), 4).alias("share"), F.round(grown, 4).alias("change"), F.round(grown - whole, 4).alias("vs_network"),
        F.round(100 * net / F.nullif("at_end", F.lit(0)), 4).alias("net_share"),
    )


def vendor_ranking(movement: DataFrame, ranking: str, n: int, least_base: int = LEAST_BASE) -> DataFrame:
    """Both ends of a ranking by movers or growth, or the largest by share."""
    if ranking == "share":
        return movement.orderBy(F.desc("population"), "vendor").limit(n)
    rows = movement.where(F.col("population_at_start") >= least_base) if ranking == "growth" else movement
    by = "change" if ranking == "growth" else "net"
    return rows.orderBy(F.desc_nulls_last(by), "vendor").limit(n).union(rows.orderBy(F.asc_nulls_last(by), "vendor").limit(n)).distinct()


def compare_periods(series: DataFrame, start: str, end: str, base_start: str | None = None, base_end: str | None = None, level: bool = False, average: bool = False) -> DataFrame:
    """A window's figure against a baseline: the window of the same length before it, or a given one.

    ``series``: data_date, value. The figure is the sum, the mean of a delivered day, or for a level the last
    delivered day's value. ``uneven`` tells sums over different numbers of delivered days.
    """
    day = lambda text: F.lit(text).cast("date")
    length = F.datediff(day(end), day(start)) + 1
    bounds = {"current": (day(start), day(end)), "base": (day(base_start), day(base_end)) if base_start else (F.date_sub(day(start), length), F.date_sub(day(start), 1))}

    def figure(name: str) -> list[Column]:
        inside = F.col("data_date").between(*bounds[name])
        total, days = F.sum(F.when(inside, F.col("value"))), F.count_if(inside)
        value = total / days if average else F.max_by("value", F.when(inside, F.col("data_date"))) if level else total
        return [F.when(days > 0, value).cast("double").alias(name), days.alias(f"{name}_days")]

    figures = series.agg(*figure("current"), *figure("base"))
    apart = F.col("current") - F.col("base")
    uneven = F.lit(False) if average or level else F.col("current_days") != F.col("base_days")
    return figures.select("*", apart.alias("absolute"), F.round(100 * apart / F.nullif(F.abs("base"), F.lit(0.0)), 6).alias("percent"), uneven.alias("uneven"))


def capability_table(mart: DataFrame) -> DataFrame:
    """Shares of supported among assessable and among all, and the share that is assessable."""
    known, every = F.col("supported") + F.col("unsupported"), F.col("supported") + F.col("unsupported") + F.col("unknown")
    share = lambda a, b: F.round(100 * a / F.nullif(b, F.lit(0)), 3)
    return mart.select("capability", "measure", share(F.col("supported"), known).alias("of_assessable"), share(F.col("supported"), every).alias("of_all"), share(known, every).alias("coverage"))


def change_table(changes: DataFrame, series: list[str], start: str, end: str) -> DataFrame:
    """Chosen series of daily changes in a range."""
    return changes.where(F.col("data_date").between(start, end)).select("data_date", *series)


def _checks(assessed: DataFrame) -> DataFrame:
    """Names of each day's flagged checks."""
    return assessed.where("flagged").groupBy("data_date").agg(F.array_join(F.array_sort(F.collect_set("check")), ",").alias("checks"))


def sim_handset_table(churn: DataFrame, assessed: DataFrame, start: str, end: str) -> DataFrame:
    """SIM and handset changes a day beside the checks that were flagged on it."""
    return churn.where(F.col("data_date").between(start, end)).join(_checks(assessed), "data_date", "left").fillna("", ["checks"])


def sim_change_table(evidence: DataFrame, assessed: DataFrame, start: str, end: str) -> DataFrame:
    """SIM changes a day: all, those that count, those set aside and why, and the flagged checks."""
    days = evidence.where(F.col("data_date").between(start, end)).groupBy("data_date").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("set_aside") == "none").alias("counted"), F.count_if(F.col("set_aside") == "multi_number").alias("multi_number"),
        F.count_if(F.col("set_aside") == "dq_unavailable").alias("unmeasured"),
    )
    return days.join(_checks(assessed), "data_date", "left").fillna("", ["checks"])


def feed_trend(assessed: DataFrame, dq: DataFrame, check: str) -> DataFrame:
    """A check's rate and threshold by day, beside the day's rows."""
    return assessed.where(F.col("check") == check).select("data_date", "rate", "threshold", "flagged").join(dq.select("data_date", "rows_total"), "data_date")


def flagged_and_missing(assessed: DataFrame, missing: DataFrame, n: int) -> DataFrame:
    """The newest days that were flagged or are missing."""
    lost = missing.select("data_date", F.lit("missing").alias("checks"))
    return _checks(assessed).unionByName(lost).orderBy(F.desc("data_date")).limit(n)


def signal_groups(current: DataFrame, history: DataFrame) -> DataFrame:
    """Quality categories of state and history with their share of all bindings of their table."""
    rows = current.select(F.lit("current").alias("source"), "category", "bindings").unionByName(history.select(F.lit("history").alias("source"), "category", "bindings"))
    whole = rows.where(F.col("category").isin("all", "history_all")).select("source", F.col("bindings").alias("whole"))
    return rows.join(F.broadcast(whole), "source").select("source", "category", "bindings", F.round(100 * F.col("bindings") / F.col("whole"), 4).alias("percent"))


def state_at(snapshot: DataFrame, events: DataFrame, seq: int) -> DataFrame:
    """The state after a delivery."""
    return fold.fold_all(snapshot, events.where(F.col("seq") <= seq))
