"""Queries over stored copies, marts and streams, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from bindwell.operators import quality, risk, tac_mart
from bindwell.operators.explore import explore_stored
from bindwell.plans.dashboards import LENSED, LENSES
from bindwell.plans.network import ACT, DIM, KPI, ORACLES, QUERIES, query
from bindwell.plans.state import CATEGORY, HISTORY_CATEGORY, STATE, STEPS
from bindwell.sources import catalogue
from bindwell.sources.store import kept, kept_folder
from bindwell.streaming import days

__all__ = ["ORACLES", "QUERIES"]

STATE_COLUMNS = ["msisdn", "imsi", "imei", "tac", "active", "last_change_seq", "last_change_date"]
for _key in ("msisdn", "imsi", "imei"):
    query(f"copy_by_{_key}", STATE)(lambda t, k=_key: t.copies[0].read(k, t.copies[1]).select(*STATE_COLUMNS))

#: Questions for the copies: name -> specification, condition and grouping in SQL.
QUESTIONS = {
    "number_prefix": ({"where": {"field": "msisdn", "op": "startsWith", "value": "91200000"}, "by": ["msisdn"]}, "cast(msisdn as varchar) like '91200000%' and no_handset = 0", "msisdn"),
    "sims": ({"where": {"all": [{"field": "imsi", "op": "in", "value": [432110000000002, 432110000000009, 432110000000014]}, {"field": "active", "op": "=", "value": 1}]}, "by": ["imsi"]}, "imsi in (432110000000002, 432110000000009, 432110000000014) and active = 1 and no_handset = 0", "imsi"),
    "handset_prefix": ({"where": {"field": "imei", "op": "startsWith", "value": "351001"}, "by": ["tac"]}, "imei like '351001%'", "tac"),
    "tacs": ({"where": {"all": [{"field": "tac", "op": "in", "value": ["35100100", "35100107", "35100150"]}, {"not": {"field": "active", "op": "=", "value": 0}}]}, "by": ["tac"]}, "tac in ('35100100', '35100107', '35100150') and active <> 0", "tac"),
    "model": ({"where": {"all": [{"field": "deviceType", "op": "=", "value": "Tablet"}, {"field": "operatingSystem", "op": "contains", "value": "android"}]}, "by": ["manufacturer"]}, "deviceType = 'Tablet' and lower(operatingSystem) like '%android%' and no_handset = 0", "manufacturer"),
    "model_not": ({"where": {"all": [{"field": "deviceType", "op": "!=", "value": "Smartphone"}, {"field": "active", "op": "=", "value": 1}]}, "by": ["deviceType"]}, "coalesce(deviceType, '') <> 'Smartphone' and active = 1 and no_handset = 0", "deviceType"),
}
_MEASURES = [{"kind": "count", "as": "bindings"}, {"kind": "countDistinct", "field": "imsi", "as": "sims", "active": True}, {"kind": "max", "field": "last_change_seq", "as": "newest"}]
for _name, (_spec, _test, _by) in QUESTIONS.items():
    query(f"explore_{_name}", f"\nselect {_by}, count(*) as bindings, count(distinct imsi) filter (active = 1) as sims, max(last_change_seq) as newest from flag left join (select tac, manufacturer, deviceType, operatingSystem from tac) k using (tac) where {_test} group by 1")(
        lambda t, s=_spec: explore_stored(*t.copies, s | {"measures": _MEASURES}, t.tac)
    )


def _terms(t):
    """A range of SIM numbers for every fiftieth customer, of 1 to 100,000 numbers."""
    key = F.col("c_custkey")
    low = F.lit(432110000000000) + key * 2 - key % 7
    length = F.element_at(F.array(*(F.lit(10**k) for k in range(6))), (key % 6 + 1).cast("int"))
    return t.spark.read.parquet(f"{t.sf_dir}/customer.parquet").where("c_custkey % 50 = 0").select(key.cast("string").alias("prefix"), low.cast("long").alias("low"), (low + length - 1).cast("long").alias("high"))


TERMS = """,
terms as (select cast(c_custkey as varchar) as prefix, 432110000000000 + c_custkey * 2 - c_custkey % 7 as low, 432110000000000 + c_custkey * 2 - c_custkey % 7 + cast(pow(10, c_custkey % 6) as bigint) - 1 as high from customer where c_custkey % 50 = 0),
hits as (select prefix, f.*, k.manufacturer, k.marketingName, k.deviceType, k.operatingSystem from flag f join terms on imsi between low and high left join tac k on k.tac = f.tac)"""
query("search_imsi_ranges", TERMS + "\nselect prefix, msisdn, imsi, imei, active from hits where active = 1")(lambda t: risk.search_imsi(t.state, _terms(t), F.col("active") == 1))
query("search_sims", TERMS + """,
out as (select prefix, count(*) filter (no_handset = 1) as left_out from hits group by 1),
shown as (select * from hits where no_handset = 0 and active = 1 and deviceType = 'Smartphone' and last_change_date >= date '2026-02-01' and last_change_date <= date '2026-04-20')
select prefix, row_number() over (partition by prefix order by imsi, active desc, msisdn, imei) as place, imsi, msisdn, imei, tac, manufacturer, marketingName, deviceType, operatingSystem, active, last_change_date,
 count(*) over (partition by prefix) as total, left_out from shown join out using (prefix) qualify place <= 20""")(
    lambda t: risk.search_sims(t.flagged, _terms(t), t.tac, 20, active=True, device_type="Smartphone", confirmed_from="2026-02-01", confirmed_to="2026-04-20")
)

COUNTS = ("bindings", "unknown_device", "malformed_imei", "invalid_imei")
query("mart_kpi", ACT + KPI + "\nselect bindings, unknown_device, malformed_imei, invalid_imei, tac_matched, coalesce(round(100 * tac_matched / nullif(bindings, 0), 3), 0) as coverage from kpi")(
    lambda t: tac_mart.kpi_of(tac_mart.under(t.mart, t.devices, {"with_unknown": True})).select(*COUNTS, "tac_matched", "coverage")
)
for _name, (_lens, _test) in LENSES.items():
    if "number_prefix" not in _lens:
        query(f"mart_kpi_lens_{_name}", LENSED + f"""
select count(*) as bindings, count(*) filter (imei = '000000') as unknown_device, count(*) filter (length(imei) <> 14 and imei <> '000000') as malformed_imei,
 count(*) filter (length(imei) = 14 and no_handset = 1) as invalid_imei, count(*) filter (matched) as tac_matched from seen where {_test}""")(lambda t, x=_lens: tac_mart.kpi_of(tac_mart.under(t.mart, t.devices, x)).select(*COUNTS, "tac_matched"))
query("mart_dimensions", DIM + "\nselect dimension, value, bindings from dim")(lambda t: tac_mart.dimensions_of(t.mart, t.devices).select("dimension", "value", "bindings"))
query("mart_top_vendors", LENSED + """,
x as (select coalesce(nullif(trim(vendor), ''), '(unknown TAC)') as value from seen where os = 'Android' and no_handset = 0)
select value, count(*) as n, round(100 * count(*) / (select count(*) from x), 3) as percent from x group by 1 order by n desc, value limit 10""")(
    lambda t: tac_mart.top_of(tac_mart.under(t.mart, t.devices, {"system": "Android"}), "vendor", 10)
)
query("mart_estimates")(lambda t: tac_mart.estimated(tac_mart.dimensions_of(t.mart, t.devices)))
query("mart_classes")(lambda t: tac_mart.estimated(tac_mart.classes_of(t.mart, t.radio)))
query("mart_capabilities")(lambda t: tac_mart.estimated(tac_mart.capabilities_of(t.mart, t.radio)))


@query("mart_expectations", DIM + KPI + """,
least as (select min(value) as v from dim where dimension = 'vendor'),
found as (select dimension, sum(bindings) as n, 0 as again from dim where not (dimension = 'vendor' and value = (select v from least)) and dimension <> 'operatingSystem' group by 1),
doubled as (select dimension, case when dimension = 'deviceType' then 2 * n else n end as n, case when dimension = 'deviceType' then (select count(*) from dim where dimension = 'deviceType') else 0 end as again from found),
every as (select unnest(['vendor', 'manufacturer', 'model', 'deviceType', 'operatingSystem', 'tac']) as dimension)
select dimension, 'present' as "check", 1 as expected, case when n is null then 0 else 1 end as found, n is not null as ok from every left join doubled using (dimension)
union all select dimension, 'no_repeats', 0, coalesce(again, 0), coalesce(again, 0) = 0 from every left join doubled using (dimension)
union all select dimension, 'bindings', (select bindings from kpi), coalesce(n, 0), coalesce(n, 0) = (select bindings from kpi) from every left join doubled using (dimension)""")
def _(t):
    """A mart that lacks a vendor and a whole dimension, and has all device types twice: each defect is named."""
    whole = tac_mart.kpi_of(tac_mart.under(t.mart, t.devices, {"with_unknown": True}))
    slices = tac_mart.dimensions_of(t.mart, t.devices)
    least = slices.where("dimension = 'vendor'").agg(F.min("value").alias("least"))
    broken = slices.where("dimension <> 'operatingSystem'").crossJoin(F.broadcast(least)).where("not (dimension = 'vendor' and value = least)").drop("least")  # one row
    checks = tac_mart.expectations(broken.unionByName(slices.where("dimension = 'deviceType'")), whole)
    return checks.where("check in ('present', 'no_repeats', 'bindings')")


def _files(t, root: str, groups: int) -> str:
    """The log as deliveries of some days each, as they would arrive: the middle ones first, each as files of its own."""
    source = f"{root}/source"
    for k in sorted(range(groups), key=lambda k: (k * 2) % groups):
        t.events.where(f"seq % {groups} = {k}").select("seq", "data_date", "msisdn", "imsi", "imei", "tac", "label").write.mode("append").parquet(source)
    return source


def _a_delivery(t, source: str, groups: int) -> int:
    """How many files a delivery has, so that a stream takes about one a batch."""
    return -(-len(t.spark.read.parquet(source).inputFiles()) // groups)


@query("stream_days_state", STATE)
def _(t):
    """The state after three deliveries; the last replaces a day that the first had otherwise."""
    def fill(root):
        wrong = t.events.where("seq = 20 and msisdn % 2 = 0").withColumn("label", F.lit("remove"))
        first = t.events.where("seq <= 45 and seq <> 20").unionByName(wrong)
        for number, rows in enumerate((first, t.events.where("seq > 45"), t.events.where("seq = 20"))):
            days.on_days(rows, t.snapshot, root, number)

    return days.latest(t.spark, kept_folder(t.spark, t.sf_dir, "stream_days", fill)).select(*STATE_COLUMNS)


@query("stateful_fold", STATE)
def _(t):
    def fill(root):
        source = _files(t, root, 3)
        dump = t.snapshot.selectExpr("0 as seq", "cast(null as date) as data_date", "msisdn", "imsi", "imei", "'' as tac", "'add' as label")
        dump.write.mode("append").parquet(source)
        days.stream_state(t.spark, source, root, _a_delivery(t, source, 4)).awaitTermination()

    return days.folded(t.spark, kept_folder(t.spark, t.sf_dir, "stateful_fold", fill)).select(*STATE_COLUMNS)


@query("stream_windows", "\nselect cast(d as date) as start, label, count(*) as n from (select label, unnest(generate_series(data_date - 6, data_date, interval 1 day)) as d from ev) group by all")
def _(t):
    """Counts of sliding weeks, with a watermark wide enough for every file."""
    def fill(root):
        source = _files(t, root, 3)
        days.stream_windows(t.spark, source, root, "7 days", "1 day", "100 days", _a_delivery(t, source, 3)).awaitTermination()

    return days.windows(t.spark, kept_folder(t.spark, t.sf_dir, "stream_windows", fill)).select(F.col("start").cast("date").alias("start"), "label", "n")


@query("stream_day_marts", "\nselect data_date, count(*) filter (label = 'add') as added, count(*) filter (label = 'remove') as removed, count(*) filter (imei = '000000') as unknown_device, count(*) as rows_total from ev group by 1")
def _(t):
    """Day marts as the deliveries left them."""
    return t.day_marts.table("change_summary")


CATALOGUE = """,
recs as (select tac, row_number() over (order by tac) as k from tac),
good as (select tac, k from recs where k % 41 <> 0)"""


def _catalogue_files(t):
    """The catalogue as files: quoted line feeds, commas and quotes, short and long records, repeated and odd TACs."""

    def fill(root):
        k = F.row_number().over(Window.orderBy("tac"))  # the catalogue of a test
        rows = t.tac.withColumn("k", k)
        cell = {c: F.col(c) if c in t.tac.columns else F.lit("") for c in catalogue.COLUMNS}
        cell["marketingName"] = F.when(F.col("k") % 7 == 0, F.concat("marketingName", F.lit('\n"two", lines'))).otherwise(F.col("marketingName"))
        cell["tac"] = F.when(F.col("k") % 53 == 0, F.concat(F.lit("x"), F.substring("tac", 2, 7))).otherwise(F.col("tac"))
        quoted = F.concat_ws(",", *(F.concat(F.lit('"'), F.regexp_replace(c, '"', '""'), F.lit('"')) for c in cell.values()))
        line = F.when(F.col("k") % 82 == 0, F.lit("35000000,short,record")).when(F.col("k") % 41 == 0, F.concat(quoted, F.lit(",odd"))).otherwise(quoted)
        again = rows.where("k % 59 = 0 and k % 41 <> 0 and k % 53 <> 0")
        lines = rows.select("k", line.alias("value")).union(again.select("k", line.alias("value")))
        head = t.spark.createDataFrame([(0, ",".join(catalogue.COLUMNS))], "k int, value string")
        head.union(lines).coalesce(1).sortWithinPartitions("k").select("value").write.text(root)

    return kept_folder(t.spark, t.sf_dir, "catalogue_files", fill)


@query("scan_catalogue_files", CATALOGUE + """
select count(*) + (select count(*) from good where k % 59 = 0 and k % 53 <> 0) as records, count(*) filter (k % 41 = 0) as malformed, count(*) filter (k % 41 <> 0 and k % 53 = 0) as not_eight_digits,
 (select count(*) from good where k % 59 = 0 and k % 53 <> 0) as repeated_tacs, (select count(*) from good where k % 59 = 0 and k % 53 <> 0) as repeated_records,
 coalesce((select string_agg(tac, ',' order by tac) from (select tac from good where k % 59 = 0 and k % 53 <> 0 order by tac limit 10)), '') as repeated_samples, false as accepted from recs""")
def _(t):
    scan = catalogue.scan_records(catalogue.read_records(t.spark, _catalogue_files(t)))
    return scan.drop("malformed_samples").withColumn("repeated_samples", F.array_join("repeated_samples", ","))


@query("read_catalogue_files", CATALOGUE + """
select case when k % 53 = 0 then 'x' || substr(tac, 2) else tac end as tac, case when k % 7 = 0 then marketingName || chr(10) || '"two", lines' else marketingName end as marketingName, bandDetails, 3 as version_id, case when k % 59 = 0 and k % 53 <> 0 then 2 else 1 end as n
from good join tac using (tac)""")
def _(t):
    rows = catalogue.read_catalogue(t.spark, _catalogue_files(t), 3)
    return rows.groupBy("tac", "marketingName", F.coalesce("bandDetails", F.lit("")).alias("bandDetails"), "version_id").agg(F.count(F.lit(1)).alias("n"))


@query("vendor_map_updates", """,
updates as (select manufacturer as raw, case when cast(substr(tac, 6, 3) as int) % 5 = 0 then '' else 'vendor ' || right(tac, 2) end as vendor, tac as updated from tac)
select raw as raw_manufacturer, arg_max(vendor, updated) as vendor_canonical from updates group by 1 having arg_max(vendor, updated) <> ''""")
def _(t):
    vendor = F.when(F.substring("tac", 6, 3).cast("int") % 5 == 0, "").otherwise(F.concat(F.lit("vendor "), F.substring("tac", 7, 2)))
    return catalogue.vendor_map(t.tac.select(F.col("manufacturer").alias("raw_manufacturer"), vendor.alias("vendor_canonical"), F.col("tac").alias("updated_at")))


def _published(t):
    """Three runs: an old one over half the state, the one to serve, and a newer one that was never published."""

    def make():
        one = quality.quality_chunks(t.state.where("active = 1"), t.history.limit(0), t.tac, 1)
        return one.unionByName(quality.quality_chunks(t.state, t.history, t.tac, 2)).unionByName(quality.quality_chunks(t.state.limit(0), t.history, t.tac, 3))

    ledger = [(1, "published", 1), (2, "running", 2), (2, "published", 4), (3, "published", 3), (3, "failed", 5), (4, "published", 6)]
    runs = t.spark.createDataFrame([(r, "2026-04-25", state, at) for r, state, at in ledger], "run_id long, as_of string, state string, updated_at int")
    return quality.latest_published(runs, kept(t.spark, t.sf_dir, "quality_chunks", make))


query("quality_published", STEPS + HISTORY_CATEGORY.rsplit("\n", 1)[0] + f"""
select 2 as run_id, '2026-04-25' as as_of, 'current' as source, category, bindings, numbers, 0 as periods from ({CATEGORY})
union all select 2, '2026-04-25', 'history', k.c, count(*), count(distinct msisdn), cast(sum(k.n) as bigint) from x where k.n > 0 group by k.c""")(lambda t: _published(t).select("run_id", "as_of", "source", "category", "bindings", "numbers", "periods"))
query("quality_published_estimates")(lambda t: _published(t).select("source", "category", "sims", "imeis"))
