"""Queries over arriving files, catalogue versions and explorer specifications, on rows that Spark derives from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindwell.functions.rules import enrich_identifiers, imei_quality, imsi_of_iccid, mask_table, model_key, normal_number, term_kind
from bindwell.operators import daily, risk
from bindwell.operators.explore import explore
from bindwell.plans.network import RADIO, Tables
from bindwell.plans.state import FEED
from bindwell.sources import ingest

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = FEED + sql
        return f

    return add


LINES = """,
lines as (select concat(msisdn, ',', imsi, ',', case when seq % 11 = 0 then '' else imei end, ',', case when seq % 13 = 0 then 'swap' else label end, case when seq % 17 = 0 then ',x' else '' end) as value, * from ev)"""


def _lines(t):
    imei = F.when(F.col("seq") % 11 == 0, "").otherwise(F.col("imei"))
    label = F.when(F.col("seq") % 13 == 0, "swap").otherwise(F.col("label"))
    tail = F.when(F.col("seq") % 17 == 0, ",x").otherwise("")
    return t.events.select(F.concat(F.concat_ws(",", F.col("msisdn").cast("string"), F.col("imsi").cast("string"), imei, label), tail).alias("value"))


@query("validate_rows", LINES + """
select msisdn, imsi, case when seq % 11 = 0 then '' else imei end as imei, label from lines where seq % 13 <> 0 and seq % 17 <> 0""")
def _(t):
    return ingest.validate_rows(_lines(t))[0]


@query("validation_findings", LINES + """
select 'field_count' as rule, 'reject' as level, count(*) as n from lines where seq % 17 = 0 having count(*) > 0
union all select 'label_unknown', 'reject', count(*) from lines where seq % 17 <> 0 and seq % 13 = 0 having count(*) > 0
union all select 'imei_empty', 'warn', count(*) from lines where seq % 17 <> 0 and seq % 11 = 0 having count(*) > 0
union all select 'imei_length', 'warn', count(*) from lines where seq % 17 <> 0 and seq % 11 <> 0 and length(imei) not in (6, 14) having count(*) > 0""")
def _(t):
    return ingest.validate_rows(_lines(t))[1].groupBy("rule", "level").agg(F.count(F.lit(1)).alias("n"))


@query("assign_sequence", "\nselect data_date, min(case when seq <= 40 then seq else 0 end) as old_seq, case when seq <= 40 then seq else 40 + dense_rank() over (partition by seq > 40 order by data_date) end as seq from ev group by data_date, seq")
def _(t):
    log = t.events.where("seq <= 40")
    days = t.events.select("data_date").distinct()
    numbered = ingest.assign_sequence(log, days)
    return numbered.select("data_date", F.when(F.col("seq") <= 40, F.col("seq")).otherwise(0).alias("old_seq"), "seq")


VERSION = """,
older as (select * from tac where modelName <> 'M2'), newer as (select * replace (case when modelName = 'M5' then 'renamed' else manufacturer end as manufacturer) from tac where modelName <> 'M7')"""


def _versions(t):
    newer = t.tac.where("modelName <> 'M7'").withColumn("manufacturer", F.when(F.col("modelName") == "M5", "renamed").otherwise(F.col("manufacturer")))
    return t.tac.where("modelName <> 'M2'"), newer


@query("diff_versions", VERSION + "\nselect coalesce(a.tac, b.tac) as tac, case when a.tac is null then 'added' when b.tac is null then 'removed' when a.manufacturer <> b.manufacturer then 'updated' else 'unchanged' end as change from older a full join newer b on a.tac = b.tac")
def _(t):
    return ingest.diff_versions(*_versions(t))


@query("affected_bindings", VERSION + "\nselect change, count(*) as bindings from (select coalesce(a.tac, b.tac) as tac, case when a.tac is null then 'added' when b.tac is null then 'removed' when a.manufacturer <> b.manufacturer then 'updated' end as change from older a full join newer b on a.tac = b.tac) d join cur using (tac) where active = 1 and change is not null group by 1")
def _(t):
    changed = ingest.diff_versions(*_versions(t)).where("change <> 'unchanged'")
    return t.state.where("active = 1").join(changed, "tac").groupBy("change").agg(F.count(F.lit(1)).alias("bindings"))


query("check_version", "\nselect count(*) as rows, count(distinct tac) as tacs, 0 as malformed, 0 as blank_maker, max(cast(strptime(allocationDate, '%d-%b-%Y') as date)) as newest from tac")(lambda t: ingest.check_version(t.tac))
query("model_identity", "\nselect tac, brandName as brand, manufacturer as maker, marketingName as name, lower(trim(manufacturer)) || '|' || lower(trim(marketingName)) as model_key from tac")(
    lambda t: t.tac.select("tac", F.col("brandName").alias("brand"), F.col("manufacturer").alias("maker"), F.col("marketingName").alias("name"), model_key(F.col("manufacturer"), F.col("marketingName")).alias("model_key"))
)
def _spelled(t):
    n = F.col("msisdn").cast("string")
    part = lambda a, b: F.substring(n, a, b)
    forms = [F.concat(F.lit("+98 "), n), F.concat(F.lit("0098"), n), F.concat(F.lit("0"), n), F.concat(F.lit("980"), n), F.concat(F.lit("("), n, F.lit(")")), F.concat(part(1, 3), F.lit("-"), part(4, 3), F.lit("."), part(7, 4))]
    return t.state.select(F.element_at(F.array(*forms), (F.col("msisdn") % 6 + 1).cast("int")).alias("spelled"))


query("normalise_numbers", "\nselect msisdn, count(*) as n from cur group by 1")(lambda t: _spelled(t).groupBy(normal_number(F.col("spelled")).cast("long").alias("msisdn")).agg(F.count(F.lit(1)).alias("n")))
query("imsi_of_iccid", "\nselect imsi, count(*) as n from cur where length(cast(imsi as varchar)) = 15 group by 1")(
    lambda t: enrich_identifiers(t.state).groupBy(imsi_of_iccid(F.col("iccid")).cast("long").alias("imsi")).agg(F.count(F.lit(1)).alias("n")).where("imsi is not null")
)
query("mask_cards", "\nselect concat(substr(c, 1, 6), repeat('*', 9), right(c, 4)) as iccid, count(*) as n from (select concat('8998', substr(cast(imsi as varchar), 4, 4), '000', substr(cast(imsi as varchar), 8, 8)) as c from cur where length(cast(imsi as varchar)) = 15) group by 1")(
    lambda t: mask_table(enrich_identifiers(t.state).where("iccid is not null").select("iccid")).groupBy("iccid").agg(F.count(F.lit(1)).alias("n"))
)
query("classify_rows", LINES + """
select severity, rules, loadable, count(*) as n from (select case when seq % 17 = 0 then 'field_count' else concat_ws(',', case when seq % 11 = 0 then 'imei_not_numeric' when imei = '000000' then 'imei_unknown' when length(imei) <> 14 then 'imei_length' end, case when seq % 13 = 0 then 'label_unknown' end) end as rules,
 case when seq % 17 = 0 then 'quarantine' when seq % 13 = 0 then 'reject' when seq % 11 = 0 then 'quarantine' when imei = '000000' then 'info' when length(imei) <> 14 then 'warning' else 'ok' end as severity,
 not (seq % 17 = 0 or seq % 13 = 0 or seq % 11 = 0) as loadable from lines) group by all""")(lambda t: ingest.classify_rows(_lines(t)).groupBy("severity", "rules", "loadable").agg(F.count(F.lit(1)).alias("n")))
query("quarantine_summary", LINES + """,
found as (select 'field_count' as rule, 'reject' as level, value from lines where seq % 17 = 0 union all select 'label_unknown', 'reject', value from lines where seq % 17 <> 0 and seq % 13 = 0
 union all select 'imei_empty', 'warn', value from lines where seq % 17 <> 0 and seq % 11 = 0 union all select 'imei_length', 'warn', value from lines where seq % 17 <> 0 and seq % 11 <> 0 and length(imei) not in (6, 14))
select rule, level, count(*) as n, min(value) as first, (select count(*) from lines) as rows, level = 'reject' and count(*) > 0.05 * (select count(*) from lines) as quarantined from found group by 1, 2""")(
    lambda t: ingest.quarantine_summary(ingest.validate_rows(_lines(t))[1], _lines(t)).drop("samples")
)
query("reconcile_days", LINES + """
select data_date, accepted, stored, accepted = stored as kept from (select data_date, count(*) as stored, count(*) filter (seq % 13 <> 0 and seq % 17 <> 0) as accepted from lines group by 1)""")(
    lambda t: ingest.reconcile_days(t.events, t.events.where("seq % 13 <> 0 and seq % 17 <> 0"))
)
query("scan_catalogue", """,
recs as (select concat(tac, ',"', replace(marketingName, '"', ''), ', x",', deviceType, case when cast(tac as int) % 97 = 0 then ',odd' else '' end) as value, tac from tac union all select concat(tac, ',a,b'), tac from tac where cast(tac as int) % 89 = 0)
select count(*) as records, count(*) filter (value like '%,odd') as malformed, count(distinct tac) as tacs, count(*) filter (value like '%,a,b') as repeated_tacs, 2 * count(*) filter (value like '%,a,b') as repeated_records,
 count(*) filter (value like '%,odd' or value like '%,a,b') = 0 as accepted from recs""")(
    lambda t: ingest.scan_catalogue(
        t.tac.select(F.concat("tac", F.lit(',"'), F.regexp_replace("marketingName", '"', ""), F.lit(', x",'), "deviceType", F.when(F.col("tac").cast("int") % 97 == 0, ",odd").otherwise("")).alias("value")).union(
            t.tac.where(F.col("tac").cast("int") % 89 == 0).select(F.concat("tac", F.lit(",a,b")).alias("value"))
        ), 3,
    )
)
query("replaced_keys", "\nselect distinct msisdn, imsi, imei from ev where seq in (5, 50)")(lambda t: ingest.replaced_keys(t.events, t.events.where("seq in (5, 50)")))
query("days_behind", "\nselect max(data_date) as newest, datediff('day', max(data_date), date '2026-05-01') as behind from ev")(lambda t: daily.days_behind(t.events, "2026-05-01"))
query("tac_capability", RADIO + "\nselect tac, lte, nr, esim, ntn from radios")(lambda t: t.radio.select("tac", "lte", "nr", "esim", "ntn"))
query("search_imsi_page", "\nselect prefix, msisdn, imsi, imei, active, count(*) over (partition by prefix) as total from (select p as prefix, * from cur, (select unnest(['4321100000001', '43211000000007']) as p) where cast(imsi as varchar) like p || '%' and active = 1) qualify row_number() over (partition by prefix order by imsi, msisdn, imei) <= 30")(
    lambda t: risk.imsi_page(risk.search_imsi(t.state.where("active = 1"), risk.prefix_ranges(t.spark, ["4321100000001", "43211000000007"])), 30)
)
query("classify_terms", "\nselect case when length(imei) = 14 then 'imei' else 'unknown' end as kind, count(*) as n from cur where length(imei) <> 10 group by 1 union all select 'msisdn', count(*) from cur where length(imei) = 10 having count(*) > 0")(
    lambda t: t.state.groupBy(term_kind(F.col("imei")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))
)
query("imei_quality", "\nselect case when length(imei) = 14 then 'well_formed' when imei = '000000' then 'unknown' else 'malformed' end as quality, count(*) as n, round(100 * count(*) / sum(count(*)) over (), 4) as percent from cur group by 1")(
    lambda t: _share(t.state.groupBy(imei_quality(F.col("imei")).alias("quality")).agg(F.count(F.lit(1)).alias("n")))
)


def _share(counts):
    total = counts.agg(F.sum("n").alias("_total"))
    return counts.crossJoin(F.broadcast(total)).select("quality", "n", F.round(100 * F.col("n") / F.col("_total"), 4).alias("percent"))


SPECS = {
    "explore_active_by_tac": (
        {"by": ["tac"], "where": {"all": [{"field": "tac", "op": "startsWith", "value": "351"}, {"field": "active", "op": "=", "value": 1}]}, "measures": [{"kind": "count", "as": "n"}, {"kind": "countDistinct", "field": "imei", "as": "imeis"}], "having": {"field": "n", "op": ">", "value": 10}},
        "\nselect tac, count(*) as n, count(distinct imei) filter (length(imei) = 14) as imeis from flag where tac like '351%' and active = 1 group by 1 having count(*) > 10",
    ),
    "explore_default_exclusion": (
        {"by": ["active"], "measures": [{"kind": "count", "as": "n"}, {"kind": "max", "field": "last_change_date", "as": "last"}]},
        "\nselect active, count(*) as n, max(last_change_date) as last from flag where no_handset = 0 group by 1",
    ),
    "explore_nested": (
        {"by": ["msisdn"], "where": {"any": [{"field": "imei", "op": "in", "value": ["000000"]}, {"not": {"field": "last_change_seq", "op": "between", "value": [0, 80]}}]}, "measures": [{"kind": "count", "as": "n"}], "sort": ["-n"], "limit": 25},
        "\nselect msisdn, count(*) as n from flag where imei = '000000' or last_change_seq not between 0 and 80 group by 1 order by n desc, msisdn limit 25",
    ),
    "explore_prefix_range": (
        {"by": ["imsi"], "where": {"all": [{"field": "imsi", "op": "startsWith", "value": "43211000000"}, {"field": "active", "op": "=", "value": 1}]}, "measures": [{"kind": "count", "as": "n"}]},
        "\nselect imsi, count(*) as n from flag where cast(imsi as varchar) like '43211000000%' and active = 1 and no_handset = 0 group by 1",
    ),
    "explore_contains_not_in": (
        {"by": ["last_change_date"], "where": {"all": [{"field": "imei", "op": "contains", "value": "350"}, {"field": "last_change_date", "op": "notIn", "value": ["2026-03-01", "2026-03-02"]}]}, "measures": [{"kind": "count", "as": "n", "active": True}]},
        "\nselect last_change_date, count(*) filter (active = 1) as n from flag where contains(imei, '350') and (last_change_date is null or last_change_date not in (date '2026-03-01', date '2026-03-02')) group by 1",
    ),
}
for _name, (_spec, _sql) in SPECS.items():
    query(_name, _sql)(lambda t, s=_spec: explore(t.flagged, s))
