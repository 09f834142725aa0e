"""Queries over risk rules, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindwell.operators import daily, dashboard, risk, signals
from bindwell.plans.network import ADDS, AS_OF, ORACLES, QUERIES, SIM_WINDOW, query
from bindwell.plans.state import EVIDENCE, REF
from bindwell.sources.store import kept

__all__ = ["ORACLES", "QUERIES"]
LIMITS = {"shared_imei_sims_30": 1, "shared_imei_numbers_30": 1, "shared_imei_sims_ever": 2, "shared_imei_sims_not_removed": 2, "high_device_count_30": 2, "rapid_device_change_7": 1, "randomisation_20": 1, "repeated_sim_change_7": 0}
TACS, SHARE = 1, 0.5
IMEI_WINDOW = """,
ipair as (select imei, imsi, max(clean) as clean, max(clean and age < 7) as c7, count(*) as adds, count(*) filter (not clean) as aside from clean where countable group by all),
inum as (select imei, count(distinct msisdn) filter (clean) as numbers from clean where countable group by 1),
ibusy as (select imei, count(*) as add_days, max(n) as most, arg_max(d, n * 100000 - datediff('day', date '1970-01-01', d)) as day from (select imei, d, count(distinct imsi) as n from clean where clean and countable group by all) group by 1),
iw as (select p.imei, count(*) filter (clean) as sims_30, count(*) as sims_30_raw, count(*) filter (c7) as sims_7, any_value(numbers) as numbers_30, sum(adds) as adds_30, sum(aside) as adds_set_aside_30, coalesce(any_value(add_days), 0) as add_days_30,
 coalesce(any_value(most), 0) as max_sims_one_day_30, any_value(day) as max_day_30 from ipair p join inum using (imei) left join ibusy using (imei) group by 1 having greatest(count(*), any_value(numbers)) >= {floor})"""
_head, _tail = SIM_WINDOW.replace("{floor}", "1").split("\n\tselect p.imsi", 1) if "\n\tselect p.imsi" in SIM_WINDOW else SIM_WINDOW.replace("{floor}", "1").split("select p.imsi", 1)
WINDOWS = _head.rstrip() + ",\nsw as (select p.imsi" + _tail + ")" + IMEI_WINDOW.replace("{floor}", "1") + EVIDENCE.replace("{", "{") + """,
lpair as (select imei, imsi, count(*) as bindings, max(active = 1 and last_change_date is not null) as dated from flag where countable = 1 group by all),
lw as (select imei, count(*) as sims_ever, count(*) filter (dated) as sims_not_removed_dated from lpair group by 1),
nw as (select msisdn, count(*) filter (set_aside = 'none') as clean, count(*) as raw from evidence where data_date between date '2026-04-25' - 6 and date '2026-04-25' group by 1),
measures as (
 select 'shared_imei_sims_30' as rule, 'imei' as family, imei as key, sims_30 as value, sims_30_raw as raw_value, null as tacs, adds_30 as adds, adds_set_aside_30 as aside from iw
 union all select 'shared_imei_numbers_30', 'imei', imei, numbers_30, null, null, adds_30, adds_set_aside_30 from iw
 union all select 'shared_imei_sims_ever', 'imei', imei, sims_ever, null, null, 0, 0 from lw union all select 'shared_imei_sims_not_removed', 'imei', imei, sims_not_removed_dated, null, null, 0, 0 from lw
 union all select 'high_device_count_30', 'sim', cast(imsi as varchar), imeis_30, imeis_30_raw, null, adds_30, adds_set_aside_30 from sw
 union all select 'rapid_device_change_7', 'sim', cast(imsi as varchar), imeis_7, imeis_7_raw, null, adds_30, adds_set_aside_30 from sw
 union all select 'randomisation_20', 'sim', cast(imsi as varchar), imeis_20, null, tacs_20, adds_30, adds_set_aside_30 from sw
 union all select 'repeated_sim_change_7', 'number', cast(msisdn as varchar), clean, raw, null, raw, raw - clean from nw),
limits as (select * from (values """ + ", ".join(f"('{r.name}', {k}, {r.days or 'null'}, {LIMITS[r.name]})" for k, r in enumerate(signals.RULES)) + f""") l(rule, place, days, threshold)),
judged as (select m.*, place, days, threshold, value > threshold and (tacs is null or tacs > {TACS}) as crossed, coalesce(raw_value > threshold and (tacs is null or tacs > {TACS}), false) as raw_crossed, aside <= {SHARE} * adds as assessable from measures m join limits using (rule)),
listed as (select *, case when crossed and assessable then 'risk' when (raw_crossed and not crossed) or (crossed and not assessable) then 'data_quality' end as view from judged),
about as (select * from (values """ + ", ".join(f"""('{r.name}', '{c}')""" for r in signals.RULES if r.days for c in r.checks) + """) a(rule, "check")),
doubted as (select rule, count(distinct data_date) as flagged_days from assessed join about using ("check") join limits using (rule) where flagged and data_date between date '2026-04-25' - (days - 1) and date '2026-04-25' group by 1),
levels as (select j.*, coalesce(adds <= 0 or aside / nullif(adds, 0) <= """ + str(SHARE) + """, true) as enough, flagged_days from judged j left join doubted using (rule)),
levelled as (select *, case when not crossed then 0 when days is null or not enough or flagged_days is not null then 1 else 2 end as level from levels),
entities as (select family, key, max(level) as level, bool_and(enough) as assessable, string_agg(concat_ws(':', rule, level, value), ',' order by level desc, place) as reasons from levelled group by all),
near as (select distinct msisdn, imsi, imei from ev where label = 'add' and data_date between date '2026-04-25' - 29 and date '2026-04-25'),
links as (select distinct 'sim' as family, cast(imsi as varchar) as key, 'number' as other_family, cast(msisdn as varchar) as other from near union select 'number', cast(msisdn as varchar), 'sim', cast(imsi as varchar) from near
 union select 'sim', cast(imsi as varchar), 'imei', imei from near where length(imei) = 14 union select 'imei', imei, 'sim', cast(imsi as varchar) from near where length(imei) = 14)"""


def sim_windows(t):
    """The SIMs' windows, written once for all rules."""
    return kept(t.spark, t.sf_dir, "sim_windows", lambda: risk.sim_window(t.events, t.tac, t.multi, AS_OF, floor=1, adds=t.adds))


class Windows:
    """The measured tables of a feed, without floors."""

    def __init__(self, t):
        self.assessed = daily.assess_feed(t.dq, *REF)
        self.sims = sim_windows(t)
        self.imeis = kept(t.spark, t.sf_dir, "imei_windows", lambda: risk.imei_window(t.events, t.tac, t.multi, AS_OF, floor=1, adds=t.adds))
        numbers = kept(t.spark, t.sf_dir, "number_changes_7", lambda: risk.number_changes(t.week_evidence, AS_OF))
        self.rows = signals.measures(self.sims, self.imeis, risk.imei_lifetime(t.flagged, floor=1), numbers)
        self.listed = signals.risk_list(self.rows, LIMITS, TACS, SHARE)
        self.doubted = signals.doubted_rules(self.assessed, AS_OF)

    def entities(self):
        return signals.assess(self.rows, LIMITS, TACS, SHARE, self.doubted)


query("risk_measures", WINDOWS + "\nselect rule, family, key, value, coalesce(raw_value, -1) as raw_value, coalesce(tacs, -1) as tacs, adds, aside from measures")(lambda t: Windows(t).rows.fillna(-1, ["raw_value", "tacs"]))
query("risk_list", WINDOWS + "\nselect rule, family, key, view, value, coalesce(raw_value, -1) as raw_value, adds, aside from listed where view is not null")(lambda t: Windows(t).listed.fillna(-1, ["raw_value"]))
query("risk_overview", WINDOWS + "\nselect rule, count(*) filter (view = 'risk') as risk, count(*) filter (view = 'data_quality') as data_quality from listed where view is not null group by 1")(lambda t: signals.risk_overview(Windows(t).listed))
query("risk_assessments", WINDOWS + "\nselect * from entities")(lambda t: Windows(t).entities())
query("risk_linked", WINDOWS + "\nselect * from links")(lambda t: signals.linked(t.events, AS_OF))
query("risk_patterns", WINDOWS + """,
beside as (select family, key, family as other_family, level from entities union all select l.family, l.key, l.other_family, e.level from links l join entities e on e.family = l.other_family and e.key = l.other
 where exists (select 1 from entities x where x.family = l.family and x.key = l.key))
select family, key, count(distinct other_family) filter (level >= 2) as families, count(*) as entities, case when count(distinct other_family) filter (level >= 2) >= 2 then 3 else least(max(level), 2) end as level from beside group by 1, 2""")(
    lambda t: signals.patterns(Windows(t).entities(), signals.linked(t.events, AS_OF))
)


@query("risk_device_types", WINDOWS + """
select rule, view, coalesce(nullif("deviceType", ''), 'Not in the catalogue') as type, count(*) as entities from (select rule, view, case when family = 'imei' then substr(key, 1, 8) else split_part(top_tacs_20, ',', 1) end as tac from listed left join sw on family = 'sim' and cast(sw.imsi as varchar) = key
 where view is not null and family <> 'number') left join tac using (tac) group by all""")
def _(t):
    w = Windows(t)
    return signals.device_types(w.listed, w.sims, t.tac)


query("risk_distribution_raw", WINDOWS + "\nselect e as edge, count(*) filter (imeis_30 >= e) as clean, count(*) filter (imeis_30_raw >= e) as raw from sw, (select unnest([1, 2, 5, 10, 20]) as e) group by 1")(
    lambda t: signals.distribution(sim_windows(t), "imeis_30", "imeis_30_raw", [1, 2, 5, 10, 20])
)
query("risk_daily", WINDOWS + """
select data_date, count(*) as total, count(*) filter (set_aside = 'none') as counted, count(*) filter (set_aside = 'multi_number') as multi_number, 0 as unmeasured, coalesce(any_value(checks), '') as checks
from evidence left join (select data_date, string_agg("check", ',' order by "check") as checks from assessed where flagged group by 1) using (data_date) group by 1""")(
    lambda t: dashboard.sim_change_table(t.evidence, daily.assess_feed(t.dq, *REF), "1970-01-01", "2100-01-01")
)


@query("evidence_quality", WINDOWS + """
select rule, risk, data_quality, round(100 * data_quality / nullif(risk + data_quality, 0), 3) as data_quality_share, flagged_days is not null as capped, coalesce(flagged_days, 0) as flagged_days, (select count(distinct data_date) from assessed where flagged) as all_flagged_days
from (select rule, count(*) filter (view = 'risk') as risk, count(*) filter (view = 'data_quality') as data_quality from listed where view is not null group by 1) left join doubted using (rule)""")
def _(t):
    w = Windows(t)
    return signals.evidence_quality(signals.risk_overview(w.listed), w.assessed, w.doubted)


query("risk_imei_window", ADDS + IMEI_WINDOW.replace("{floor}", "2") + "\nselect * from iw")(lambda t: risk.imei_window(t.events, t.tac, t.multi, AS_OF, floor=2))
query("risk_listed_families", WINDOWS + "\nselect family, count(distinct key) as entities from listed where view is not null group by 1")(lambda t: Windows(t).listed.groupBy("family").agg(F.count_distinct("key").alias("entities")))
