"""Queries over dashboard reads, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindwell.functions.rules import flag_handsets
from bindwell.operators import daily, dashboard, marts
from bindwell.plans.network import ACT, KPI, ORACLES, QUERIES, RADIO, query
from bindwell.plans.state import CATEGORY, DQ, EVIDENCE, HISTORY_CATEGORY, REF, STEPS, SWAP
from bindwell.sources.store import kept

__all__ = ["ORACLES", "QUERIES"]
LENSED = """,
lens as (select f.msisdn, f.imsi, f.imei, f.no_handset, case when no_handset = 1 then '' else f.tac end as tac from flag f where active = 1),
seen as (select l.*, d.manufacturer, d.marketingName, d.deviceType, trim(d.operatingSystem) as os, d.vendor, d.tac is not null as matched from lens l left join dev d on d.tac = l.tac)"""
FIGURES = """count(*) as bindings, count(distinct msisdn) as subscribers, count(distinct imsi) as sims, count(distinct imei) filter (no_handset = 0) as handsets, count(*) filter (imei = '000000') as unknown_device,
 count(*) filter (length(imei) <> 14 and imei <> '000000') as malformed_imei, count(*) filter (length(imei) = 14 and no_handset = 1) as invalid_imei, count(*) filter (matched) as tac_matched,
 coalesce(round(100 * count(*) filter (matched) / nullif(count(*), 0), 3), 0) as coverage"""
LENSES = {
    "maker": ({"manufacturer": "Maker A Korea"}, "manufacturer = 'Maker A Korea' and no_handset = 0"),
    "vendor_type": ({"vendor": "Maker A", "device_type": "Smartphone"}, "vendor = 'Maker A' and deviceType = 'Smartphone' and no_handset = 0"),
    "system": ({"system": "Android"}, "os = 'Android' and no_handset = 0"),
    "number_prefix": ({"number_prefix": "91200000"}, "cast(msisdn as varchar) like '91200000%' and no_handset = 0"),
    "everything": ({"with_unknown": True}, "true"),
}
for _name, (_lens, _test) in LENSES.items():
    query(f"kpi_lens_{_name}", LENSED + f"\nselect {FIGURES} from seen where {_test}")(lambda t, x=_lens: dashboard.kpi_under(dashboard.apply_lens(t.flagged, t.devices, x)))
_N = {"bindings": "count(*)", "subscribers": "count(distinct msisdn)", "handsets": "count(distinct imei) filter (no_handset = 0)"}
for _name, _dimension, _measure, _n in (("system", "vendor", "subscribers", 10), ("number_prefix", "deviceType", "handsets", 10), ("everything", "manufacturer", "bindings", 15), ("vendor_type", "model", "handsets", 5)):
    _lens, _test = LENSES[_name]
    _column = dashboard.COLUMNS[_dimension]
    query(f"top_{_dimension}_lens_{_name}", LENSED + f""",
x as (select *, case when tac = '' then '(unknown device)' when not matched then '(unknown TAC)' else coalesce(nullif(trim({_column}), ''), '(unknown TAC)') end as value from seen where {_test})
select value, n, round(100 * n / (select {_N[_measure]} from x), 3) as percent from (select value, {_N[_measure]} as n from x group by 1) order by n desc, value limit {_n}""")(
        lambda t, x=_lens, d=_dimension, m=_measure, n=_n: dashboard.top_under(dashboard.apply_lens(t.flagged, t.devices, x), d, n, m)
    )
query("change_series", "\nselect seq, min(data_date) as data_date, count(*) filter (label = 'add') as adds, count(*) filter (label = 'remove') as removes from ev where seq between 10 and 60 and tac <> '' group by 1")(
    lambda t: dashboard.change_series(t.events.groupBy("seq", "data_date", "tac", "label").agg(F.count(F.lit(1)).alias("n")), 10, 60)
)
CHANGES = """,
dd as (select data_date, count(*) filter (label = 'add') as added, count(*) filter (label = 'remove') as removed from ev where tac <> '' group by 1),
changes as (select data_date, added, removed, added - removed as net, (select count(*) from counted) - sum(added - removed) over (order by data_date desc) + (added - removed) as cumulative from dd)"""
CHURN = f""",
churn as (select data_date, coalesce(s.changes, 0) as sim_changes, coalesce(d.changes, 0) as device_changes from ({SWAP.format(c="imsi")}) s full join ({SWAP.format(c="imei")}) d using (data_date))"""
query("daily_changes", CHANGES + "\nselect * from changes")(lambda t: dashboard.daily_changes(t.events, t.flagged))
query("daily_churn", CHURN + "\nselect * from churn")(lambda t: dashboard.daily_churn(t.events))
for _grain in ("day", "week", "month"):
    query(f"population_trend_{_grain}", CHANGES + f"\nselect cast(date_trunc('{_grain}', data_date) as date) as bucket, max(data_date) as last_day, arg_max(cumulative, data_date) as population from changes group by 1")(
        lambda t, g=_grain: dashboard.population_trend(dashboard.daily_changes(t.events, t.flagged), g)
    )
query("weekly_net_changes", "\nselect cast(date_trunc('week', data_date) as date) as week, max(data_date) as last_day, sum(case when label = 'add' then 1 else -1 end) as net from ev group by 1")(
    lambda t: t.events.groupBy(F.date_trunc("week", "data_date").cast("date").alias("week")).agg(F.max("data_date").alias("last_day"), F.sum(F.when(F.col("label") == "add", 1).otherwise(-1)).alias("net"))
)
MOVED = """,
cur0 as (select msisdn, imsi, imei, case when arg_max(label, seq) = 'add' then 1 else 0 end as active, case when length(imei) = 14 then substr(imei, 1, 8) else '' end as tac
 from (select msisdn, imsi, imei, label, seq from ev where seq <= 30 union all select msisdn, imsi, imei, 'add', 0 from snapshot) group by msisdn, imsi, imei),
counted0 as (select c.* from cur0 c join flag f using (msisdn, imsi, imei) where c.active = 1 and f.no_handset = 0),
vp as (select coalesce(vendor, '(unknown TAC)') as vendor, sum(s) as at_start, sum(e) as at_end from (select tac, 1 as s, 0 as e from counted0 union all select tac, 0, 1 from counted) left join dev using (tac) group by 1),
vm as (select case when tac = '' then '(unknown device)' else coalesce(vendor, '(unknown TAC)') end as vendor, count(*) filter (label = 'add') as added, count(*) filter (label = 'remove') as removed from ev left join dev using (tac) where data_date between date '2026-02-25' and date '2026-04-25' group by 1),
moved as (select vendor, coalesce(added, 0) as added, coalesce(removed, 0) as removed, coalesce(added, 0) - coalesce(removed, 0) as net, at_end as population, at_start as population_at_start, at_end - at_start as population_change,
 round(100 * at_end / sum(at_end) over (), 4) as share, round(100 * (at_end - at_start) / nullif(at_start, 0), 4) as change,
 round(100 * (at_end - at_start) / nullif(at_start, 0) - 100 * (sum(at_end) over () - sum(at_start) over ()) / sum(at_start) over (), 4) as vs_network, round(100 * (coalesce(added, 0) - coalesce(removed, 0)) / nullif(at_end, 0), 4) as net_share
 from vp left join vm using (vendor))"""


def _moved(t):
    """A row a vendor, written once for all rankings."""
    before = flag_handsets(dashboard.state_at(t.snapshot, t.events, 30), t.tac)
    return kept(t.spark, t.sf_dir, "vendor_movement", lambda: dashboard.vendor_movement(t.events, before, t.flagged, t.devices, "2026-02-25", "2026-04-25"))


query("vendor_movement", MOVED + "\nselect * from moved")(_moved)
query("vendor_ranking_share", MOVED + "\nselect * from moved order by population desc, vendor limit 6")(lambda t: dashboard.vendor_ranking(_moved(t), "share", 6))
for _ranking, _by, _least in (("movers", "net", 0), ("growth", "change", 50)):
    query(f"vendor_ranking_{_ranking}", MOVED + f"""
select * from (select * from moved where population_at_start >= {_least} order by {_by} desc nulls last, vendor limit 4) union select * from (select * from moved where population_at_start >= {_least} order by {_by} asc nulls last, vendor limit 4)""")(
        lambda t, r=_ranking, x=_least: dashboard.vendor_ranking(_moved(t), r, 4, x)
    )
for _metric, _kind, _rows in (("added", "sum", "changes"), ("net", "average", "changes"), ("cumulative", "level", "changes"), ("sim_changes", "sum", "churn")):
    _value = {"sum": "sum(v) filter (data_date between {a} and {b})", "average": "avg(v) filter (data_date between {a} and {b})", "level": "arg_max(v, data_date) filter (data_date between {a} and {b})"}[_kind]
    _current, _base = (_value.format(a=f"date '{a}'", b=f"date '{b}'") for a, b in (("2026-03-20", "2026-04-25"), ("2026-02-11", "2026-03-19")))
    query(f"compare_periods_{_metric}", CHANGES + CHURN + f""",
v as (select data_date, {_metric} as v from {_rows}), f as (select cast({_current} as double) as current, count(*) filter (data_date between date '2026-03-20' and date '2026-04-25') as current_days,
 cast({_base} as double) as base, count(*) filter (data_date between date '2026-02-11' and date '2026-03-19') as base_days from v)
select *, current - base as absolute, round(100 * (current - base) / nullif(abs(base), 0), 6) as percent, {'current_days <> base_days' if _kind == 'sum' else 'false'} as uneven from f""")(
        lambda t, m=_metric, k=_kind, r=_rows: dashboard.compare_periods(
            (dashboard.daily_churn(t.events) if r == "churn" else dashboard.daily_changes(t.events, t.flagged)).select("data_date", F.col(m).alias("value")), "2026-03-20", "2026-04-25", level=k == "level", average=k == "average"
        )
    )
query("capability_table", ACT + RADIO + """,
caps as (select capability, measure, coalesce(sum(n) filter (flag = 1), 0) as yes, coalesce(sum(n) filter (flag = 0), 0) as no, coalesce(sum(n) filter (flag = 2), 0) as unknown from (
 select capability, flag, measure, n from (select capability, flag, count(*) as bindings, count(distinct msisdn) as subscribers, count(distinct imei) as handsets from (""" + " union all ".join(
    f"select '{c}' as capability, coalesce({c}, 2) as flag, a.* from act a left join radios r on r.tac = a.tac where a.tac <> ''" for c in ("lte", "nr", "esim", "ntn")
) + """) group by 1, 2) unpivot (n for measure in (bindings, subscribers, handsets))) group by all)
select capability, measure, round(100 * yes / nullif(yes + no, 0), 3) as of_assessable, round(100 * yes / nullif(yes + no + unknown, 0), 3) as of_all, round(100 * (yes + no) / nullif(yes + no + unknown, 0), 3) as coverage from caps""")(  # fmt: skip
    lambda t: dashboard.capability_table(marts.capability_mart(t.flagged, t.radio))
)
query("change_table", CHANGES + "\nselect data_date, net, cumulative from changes where data_date between date '2026-03-01' and date '2026-03-31'")(
    lambda t: dashboard.change_table(dashboard.daily_changes(t.events, t.flagged), ["net", "cumulative"], "2026-03-01", "2026-03-31")
)
CHECKS = """,
checks as (select data_date, string_agg("check", ',' order by "check") as checks from assessed where flagged group by 1)"""
_assessed = lambda t: daily.assess_feed(t.dq, *REF)
_evidence = lambda t: t.evidence
query("sim_handset_table", DQ + CHURN + CHECKS + "\nselect churn.*, coalesce(checks, '') as checks from churn left join checks using (data_date) where data_date between date '2026-03-01' and date '2026-04-10'")(
    lambda t: dashboard.sim_handset_table(dashboard.daily_churn(t.events), _assessed(t), "2026-03-01", "2026-04-10")
)
query("sim_change_table", DQ + EVIDENCE + CHECKS + """
select data_date, count(*) as total, count(*) filter (set_aside = 'none') as counted, count(*) filter (set_aside = 'multi_number') as multi_number, 0 as unmeasured, coalesce(any_value(checks), '') as checks
from evidence left join checks using (data_date) where data_date between date '2026-03-01' and date '2026-04-10' group by 1""")(lambda t: dashboard.sim_change_table(_evidence(t), _assessed(t), "2026-03-01", "2026-04-10"))
query("feed_trend", DQ + """\nselect data_date, rate, threshold, flagged, rows_total from assessed join dq using (data_date) where "check" = 'malformed_imei'""")(lambda t: dashboard.feed_trend(_assessed(t), t.dq, "malformed_imei"))
query("flagged_and_missing_days", DQ + CHECKS + "\nselect data_date, checks from checks order by data_date desc limit 20")(lambda t: dashboard.flagged_and_missing(_assessed(t), daily.missing_days(t.events), 20))
query("signal_groups", STEPS + HISTORY_CATEGORY.rsplit("\n", 1)[0] + f""",
sg as (select 'current' as source, category, bindings from ({CATEGORY}) union all select 'history', k.c, count(*) from x where k.n > 0 group by k.c)
select source, category, bindings, round(100 * bindings / max(bindings) filter (category in ('all', 'history_all')) over (partition by source), 4) as percent from sg""")(
    lambda t: dashboard.signal_groups(daily.quality_current(t.state, t.tac), daily.quality_history(t.history))
)
query("kpi_matches_lens", ACT + KPI + "\nselect bindings, subscribers, sims, handsets from kpi")(lambda t: dashboard.kpi_under(dashboard.apply_lens(t.flagged, t.devices, {"with_unknown": True})).select("bindings", "subscribers", "sims", "handsets"))
