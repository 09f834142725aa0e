"""Queries over planning views, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindwell.functions.rules import flag_handsets
from bindwell.operators import dashboard, planning, views
from bindwell.plans.network import AS_OF, ORACLES, QUERIES, RADIO, SPELLS, STAGE, query, spells_of
from bindwell.plans.state import COUNTABLE, DQ

__all__ = ["ORACLES", "QUERIES"]
_stage = lambda t: planning.handset_stage(t.flagged, t.radio)
_numbers = lambda t: planning.number_class(_stage(t))
INDEX = STAGE + """,
idx as (select distinct msisdn, s.tac, sunset, reason, n.esim, n.handsets, n.bindings from stage s join numbers n using (msisdn))"""


def _index(t):
    stage = _stage(t)
    return views.number_model(stage, planning.number_class(stage))


query("number_model", INDEX + "\nselect * from idx")(_index)
IOT = RADIO + """,
evfirst as (select msisdn, imsi, imei, min(data_date) as first from ev group by all),
iot as (select f.imei, f.tac, count(distinct imsi) as sims_ever, count(distinct msisdn) as numbers_ever, count(distinct imsi) filter (active = 1) as sims_active, count(distinct msisdn) filter (active = 1) as numbers_active,
 count(distinct imsi) filter (first >= date '2026-04-25' - 89) as sims_90, min(first) as first_date, max(case when s.imei is not null then 1 else 0 end) as in_dump
 from flag f left join evfirst using (msisdn, imsi, imei) left join snapshot s using (msisdn, imsi, imei) where countable = 1 and f.tac in (select tac from radios where device_class = 'IoT / M2M') group by all)"""
_iot = lambda t: views.iot_devices(t.events, t.snapshot, t.flagged, t.radio, AS_OF)
query("iot_devices", IOT + "\nselect * from iot")(_iot)
query("iot_rotation", IOT + "\nselect case when sims_ever <= 1 then '1 SIM' when sims_ever = 2 then '2 SIMs' when sims_ever <= 5 then '3-5 SIMs' when sims_ever <= 10 then '6-10 SIMs' when sims_ever <= 50 then '11-50 SIMs' else 'more than 50 SIMs' end as bucket, count(*) as devices, sum(numbers_active) as numbers_active from iot where numbers_active > 0 group by 1")(
    lambda t: views.iot_rotation(_iot(t))
)
KINDS = SPELLS + """,
alloc as (select tac, coalesce(marketingName, '') as name, cast(strptime(allocationDate, '%d-%b-%Y') as date) as allocated from tac),
kinds as (select t.*, substr(imei, 1, 8) as from_tac, substr(next_imei, 1, 8) as to_tac, case when outcome <> 1 then 0 when substr(imei, 1, 8) = substr(next_imei, 1, 8) or (a.name <> '' and a.name = b.name) then 4
 when a.allocated is null or b.allocated is null or a.allocated = b.allocated then 3 when b.allocated > a.allocated then 1 else 2 end as kind
 from tenure t left join alloc a on a.tac = substr(imei, 1, 8) left join alloc b on b.tac = substr(next_imei, 1, 8)),
moves as (select month, from_tac, to_tac, kind, count(*) as changes from kinds where outcome = 1 group by all)"""
_kinds = lambda t: views.change_kind(planning.spell_events(spells_of(t), AS_OF), t.tac)
_moves = lambda t: views.changes(_kinds(t))
query("change_kind", KINDS + "\nselect msisdn, imei, outcome, days, cohort, month, next_imei, kind from kinds")(lambda t: _kinds(t).drop("from_tac", "to_tac"))
query("tenure", KINDS + "\nselect cohort, days, outcome, kind, count(*) as n from kinds group by all")(lambda t: views.tenure(_kinds(t)))
query("model_changes", KINDS + "\nselect * from moves")(_moves)
query("vendor_moves", KINDS + "\nselect coalesce(a.vendor, '(unknown TAC)') as from_vendor, coalesce(b.vendor, '(unknown TAC)') as to_vendor, sum(changes) as changes from moves left join dev a on a.tac = from_tac left join dev b on b.tac = to_tac group by 1, 2 order by changes desc, from_vendor, to_vendor limit 20")(
    lambda t: views.vendor_moves(_moves(t), t.devices, 20)
)
query("change_kinds", KINDS + "\nselect kind, sum(changes) as changes, round(100 * sum(changes) / sum(sum(changes)) over (), 3) as percent from moves group by 1")(lambda t: views.change_kinds(_moves(t)))
query("survival_figures", SPELLS + """,
sdays as (select cohort, days, count(*) filter (outcome = 1) as events, count(*) as ended from tenure where outcome <> 4 group by all),
srisk as (select *, sum(ended) over (partition by cohort order by days desc) as at_risk from sdays),
km as (select *, max(case when events = at_risk then 1 else 0 end) over w as dead, exp(sum(ln(case when events < at_risk then 1 - events / at_risk else 1.0 end)) over w) as p from srisk window w as (partition by cohort order by days)),
curve as (select cohort, days, round(case when dead = 1 then 0.0 else p end, 6) as share from km where events > 0)
select cohort, coalesce(arg_max(share, days) filter (days <= 14), 1) as at_14, coalesce(arg_max(share, days) filter (days <= 30), 1) as at_30, coalesce(arg_max(share, days) filter (days <= 60), 1) as at_60, coalesce(min(days) filter (share <= 0.5), -1) as median_days from curve group by 1""")(
    lambda t: views.survival_figures(planning.survival(planning.spell_events(spells_of(t), AS_OF)), [14, 30, 60]).fillna(-1, ["median_days"])
)
for _view, _names in (("sunset", views.SUNSET), ("esim", views.ESIM)):
    _case = "case " + _view + " " + " ".join(f"when {k} then '{v}'" for k, v in _names.items()) + " end"
    query(f"{_view}_view", STAGE + f"\nselect {_case} as class, count(*) as numbers, sum(bindings) as bindings, sum(handsets) as handsets, sum(gsm_only) as gsm_only, sum(iot) as iot, sum(paired) as paired, round(100 * count(*) / sum(count(*)) over (), 3) as percent from numbers group by 1")(
        lambda t, v=_view: views.class_view(_numbers(t), v)
    )
query("not_assessable", STAGE + "\nselect reason, count(*) as numbers from numbers where sunset = 4 group by 1")(lambda t: views.not_assessable(_numbers(t)))
HELD = RADIO + ",\nheld as (select msisdn, imei, tac from counted)"
FIGURES = "count(distinct msisdn) as numbers, count(*) as bindings, count(distinct imei) as handsets"


def _classes(name: str, expression, sql: str, where=None, sql_where: str = "true", source=None):
    query(name, HELD + f"\nselect {sql} as class, {FIGURES} from held join radios using (tac) where {sql_where} group by 1")(lambda t: views.class_rows(t.flagged, t.radio, expression(), None if where is None else where()))


MINE = {"lte": [1, 3, 7], "nr": [78]}
for _technology, _mine in MINE.items():
    _list, _have = "[" + ", ".join(map(str, _mine)) + "]", f"{_technology}_bands"
    _classes(
        f"{_technology}_band_match", lambda x=_technology, m=_mine: views.band_match(x, m),
        f"case when len({_have}) = 0 then '{_technology}-no-bands' when list_has_all({_have}, {_list}) then '{_technology}-all' when list_has_any({_have}, {_list}) then '{_technology}-some' else '{_technology}-none' end",
        lambda x=_technology: F.col(x) == 1, f"{_technology} = 1",
    )
ARCH = "case when sa = 1 and nsa = 1 then 'arch-both' when sa = 1 then 'arch-sa' when nsa = 1 then 'arch-nsa' else 'arch-not-stated' end"
NTN = "case when ntn = 1 then 'ntn' when satellite = 1 then 'satellite' when ntn = 0 then 'not-capable' else 'not-stated' end"
_classes("architecture_classes", views.architecture, ARCH, lambda: F.col("nr") == 1, "nr = 1")
_classes("ntn_classes", views.ntn_class, NTN)
_classes("iot_exposure", views.exposure, "case when sunset = 3 and umts = 0 then '2g-only' when sunset = 3 then '2g-3g' when sunset = 2 then 'lpwan' when sunset = 1 then 'lte' else 'unknown' end", lambda: F.col("device_class") == "IoT / M2M", "device_class = 'IoT / M2M'")
query("iot_types", HELD + f"\nselect \"deviceType\" as class, {FIGURES} from held join radios using (tac) join (select tac, deviceType from tac) using (tac) where device_class = 'IoT / M2M' group by 1")(
    lambda t: views.class_rows(t.flagged, t.radio.join(t.tac.select("tac", "deviceType"), "tac"), F.col("deviceType"), F.col("device_class") == "IoT / M2M")
)
query("band_figures", HELD + f""",
items as (select tac, concat('lte:', unnest(lte_bands)) as item from radios union all select tac, concat('nr:', unnest(nr_bands)) from radios union all select tac, {ARCH} from radios where nr = 1 union all select tac, 'ambiguous' from radios where len(unparsed) > 0)
select item, {FIGURES} from held join items using (tac) group by 1""")(lambda t: views.band_figures(t.flagged, t.radio))
query("ntn_view", HELD + f""",
cells as (select tac, 'mode' as "by", coalesce(ntn_mode, 'not-stated') as key from radios where ntn = 1 union all select tac, 'orbit', coalesce(ntn_orbits, 'not-stated') from radios where ntn = 1
 union all select tac, 'band', unnest(case when len(ntn_bands) = 0 then ['not-stated'] else ntn_bands end) from radios where ntn = 1)
select "by", key, {FIGURES} from held join cells using (tac) group by 1, 2""")(lambda t: views.ntn_view(t.flagged, t.radio))
for _by, _key in (("vendor", "coalesce(vendor, '(unknown TAC)')"), ("model", "coalesce(nullif(concat_ws(' ', vendor, nullif(marketingName, '')), ''), '(unknown TAC)')"), ("tac", "s.tac")):
    query(f"class_breakdown_{_by}", STAGE + f""",
rows_ as (select {_key} as key, s.msisdn, s.imei, s.bindings from stage s join numbers n on n.msisdn = s.msisdn left join dev d on d.tac = s.tac where n.sunset = 2)
select key, sum(bindings) as bindings, count(distinct msisdn) as numbers, count(distinct imei) as handsets from rows_ group by 1 order by bindings desc, key limit 12""")(
        lambda t, b=_by: views.class_breakdown(_stage(t), _numbers(t), t.devices, "sunset", 2, b, 12)
    )
query("class_numbers", INDEX + "\nselect distinct msisdn, sunset, reason, esim, handsets, bindings from idx where sunset = 1 and tac in (select tac from dev where vendor = 'Maker A') order by msisdn limit 100")(
    lambda t: views.class_numbers(_index(t), t.devices, "sunset", 1, vendor="Maker A", limit=100)
)
query("campaign_list", INDEX + """
select msisdn, any_value(handsets) as handsets, any_value(bindings) as bindings, coalesce(string_agg(distinct case when tac <> '' then concat_ws(' ', coalesce(vendor, '(unknown TAC)'), coalesce(marketingName, tac)) end, '; ' order by case when tac <> '' then concat_ws(' ', coalesce(vendor, '(unknown TAC)'), coalesce(marketingName, tac)) end), '') as models
from idx left join dev using (tac) where esim = 1 group by 1""")(lambda t: views.campaign(_index(t), t.devices, "esim", 1))
SEQS = (30, 60, 90)


@query("planning_trend", RADIO + f""",
then_ as (select s.seq, e.msisdn, e.imsi, e.imei, arg_max(label, e.seq) as label from (select unnest({list(SEQS)}) as seq) s join (select msisdn, imsi, imei, seq, label from ev union all select msisdn, imsi, imei, 0, 'add' from snapshot) e on e.seq <= s.seq group by all)
select t.seq, coalesce(case sunset when 1 then 'lte' when 2 then 'lpwan' when 3 then 'exposed' else 'unknown' end, 'unknown') as class, count(distinct f.msisdn) as numbers, count(*) as bindings, count(distinct f.imei) as handsets
from then_ t join flag f using (msisdn, imsi, imei) left join radios r on r.tac = f.tac where t.label = 'add' and no_handset = 0 group by 1, 2""")
def _(t):
    states = {seq: flag_handsets(dashboard.state_at(t.snapshot, t.events, seq), t.tac) for seq in SEQS}
    name = F.when(F.col("sunset") == 1, "lte").when(F.col("sunset") == 2, "lpwan").when(F.col("sunset") == 3, "exposed").otherwise("unknown")
    return views.model_trend(states, t.radio, name, "unknown")


query("nr_band_rows", HELD + "\nselect band, count(*) as bindings, count(distinct msisdn) as subscribers, count(distinct imei) as handsets from (select h.*, unnest(nr_bands) as band from held h join radios r using (tac)) group by 1")(
    lambda t: t.flagged.where("active = 1 and no_handset = 0").join(t.radio.select("tac", F.explode("nr_bands").alias("band")), "tac").groupBy("band").agg(F.count(F.lit(1)).alias("bindings"), F.count_distinct("msisdn").alias("subscribers"), F.count_distinct("imei").alias("handsets"))
)
query("device_age", DQ + f"""
select substr(imei, 1, 8) as tac, case when dump then 0 else cast(strftime(first, '%Y%m') as int) end as month, count(*) as handsets
from (select imei, min(data_date) as first, bool_or(d) as dump from (select imei, data_date, false as d from ev union all select imei, null, true from snapshot) group by 1) join (select distinct imei from flag where active = 1 and countable = 1) using (imei) group by all""")(
    lambda t: planning.device_age(t.events, t.snapshot, t.flagged)
)
query("countable_adds", DQ + f"\nselect data_date, count(*) as n from evf where label = 'add' and {COUNTABLE} group by 1")(lambda t: flag_handsets(t.events, t.tac).where("label = 'add' and countable = 1").groupBy("data_date").agg(F.count(F.lit(1)).alias("n")))
