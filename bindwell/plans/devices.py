"""Queries over models in the network, with their SQL."""

from __future__ import annotations

from bindwell.functions.rules import flag_handsets
from bindwell.operators import daily, dashboard, devices, marts
from bindwell.plans.network import ACT, AS_OF, ORACLES, POP, QUERIES, RADIO, query
from bindwell.plans.state import COUNTABLE, DQ

__all__ = ["ORACLES", "QUERIES"]
LIST = POP + """,
listed as (select p.tac, d.manufacturer, d.vendor, d.brandName, d.modelName, d.marketingName, d.deviceType, d.operatingSystem, p.bindings, p.handsets, p.sims, p.subscribers, p.first_seen, p.last_seen from pop p left join dev d using (tac) where p.tac <> '')"""
for _name, _options, _test, _order, _page in (
    ("all", {"limit": 40}, "true", "bindings desc nulls last", "limit 40"),
    ("text", {"text": "twin", "sort": "handsets", "limit": 25, "offset": 5}, "(contains(lower(tac), 'twin') or contains(lower(manufacturer), 'twin') or contains(lower(brandName), 'twin') or contains(lower(modelName), 'twin') or contains(lower(marketingName), 'twin'))", "handsets desc nulls last", "limit 25 offset 5"),
    ("type", {"kind": "Tablet", "sort": "manufacturer", "descending": False, "limit": 30}, "deviceType = 'Tablet'", "manufacturer asc nulls last", "limit 30"),
    ("vendor", {"vendor": "Maker A", "sort": "last_seen", "limit": 20}, "vendor = 'Maker A'", "last_seen desc nulls last", "limit 20"),
):
    query(f"devices_{_name}", LIST + f"\nselect *, (select count(*) from listed where {_test}) as total from listed where {_test} order by {_order}, tac {_page}")(
        lambda t, o=_options: devices.devices(marts.tac_population(t.flagged), t.devices, **o)
    )
query("device_details", POP + RADIO + """,
cur0 as (select msisdn, imsi, imei, case when arg_max(label, seq) = 'add' then 1 else 0 end as active from (select msisdn, imsi, imei, label, seq from ev where seq <= 10 union all select msisdn, imsi, imei, 'add', 0 from snapshot) group by all),
pop0 as (select tac, count(*) as at_start from flag f join cur0 c using (msisdn, imsi, imei) where c.active = 1 and no_handset = 0 group by 1)
select p.tac, d.vendor, d.marketingName, d.deviceType, p.bindings, p.handsets, p.sims, p.subscribers, p.first_seen, p.last_seen, coalesce(at_start, 0) as at_start, (select sum(bindings) from pop where tac <> '') as network_now, (select sum(at_start) from pop0) as network_start,
 round(100 * p.bindings / (select sum(bindings) from pop where tac <> ''), 4) as share, coalesce(lte, 2) as lte, coalesce(nr, 2) as nr, coalesce(esim, 2) as esim, d.tac is not null as registered
from pop p left join pop0 using (tac) left join dev d on d.tac = p.tac left join radios r on r.tac = p.tac where p.tac <> ''""")(
    lambda t: devices.device_details(marts.tac_population(t.flagged), marts.tac_population(flag_handsets(dashboard.state_at(t.snapshot, t.events, 10), t.tac)), t.devices, t.radio)
)
query("device_identifiers", "\nselect imei, imsi, msisdn, active, last_change_date from cur where length(imei) = 14 and tac in ('35100300', '35100007') and active = 1 and last_change_date between date '2026-02-01' and date '2026-04-10' order by imei, active desc, imsi, msisdn limit 1000")(
    lambda t: devices.identifiers(t.state, ["35100300", "35100007"], True, "2026-02-01", "2026-04-10")
)
query("device_facets", LIST + """
select * from (select 'deviceType' as facet, coalesce(nullif(deviceType, ''), '(not stated)') as value, count(*) as models from listed group by 2 order by models desc, value limit 30)
union all select * from (select 'manufacturer', coalesce(nullif(vendor, ''), '(unknown TAC)') as value, count(*) as models from listed group by 2 order by models desc, value limit 40)
union all select * from (select 'os', coalesce(nullif(trim(operatingSystem), ''), '(not stated)') as value, count(*) as models from listed group by 2 order by models desc, value limit 30)""")(lambda t: devices.facets(marts.tac_population(t.flagged), t.devices))
FIRSTS = DQ + f""",
td as (select data_date, tac, count(distinct imei) as handsets from evf where label = 'add' and {COUNTABLE} group by all),
tdump as (select distinct f.tac from snapshot s join flag f using (msisdn, imsi, imei) where countable = 1),
firsts as (select coalesce(f.tac, d.tac) as tac, first_day, coalesce(days_seen, 0) as days_seen, coalesce(first_day_handsets, 0) as first_day_handsets, case when d.tac is not null then 1 else 0 end as in_dump
 from (select tac, min(data_date) as first_day, count(*) as days_seen, arg_min(handsets, data_date) as first_day_handsets from td group by 1) f full join tdump d on d.tac = f.tac)"""
_firsts = lambda t: devices.first_days(daily.handset_day(t.events, t.tac), daily.tac_dump(t.snapshot, t.tac))
query("model_first_days", FIRSTS + "\nselect * from firsts")(_firsts)
NEW = FIRSTS + """,
act as (select msisdn, imsi, imei, tac from flag where active = 1 and no_handset = 0),
held as (select tac, count(distinct imei) as handsets, count(distinct imsi) as sims from act group by 1),
named as (select tac, nullif(coalesce(nullif(brandName, ''), manufacturer), '') as brand, nullif(marketingName, '') as model, nullif(deviceType, '') as device_type from tac),
new as (select f.tac, n.tac is not null as known, brand, model, device_type, first_day, days_seen, first_day_handsets, handsets, sims from firsts f left join named n on n.tac = f.tac left join held h on h.tac = f.tac where in_dump = 0 and days_seen > 0)"""
_NEW = "tac, coalesce(brand, '') as brand, coalesce(model, '') as model, coalesce(device_type, '') as device_type, first_day, days_seen, first_day_handsets, coalesce(handsets, 0) as handsets, coalesce(sims, 0) as sims"


def _new(t, *limits):
    found = devices.new_models(_firsts(t), marts.tac_holders(t.flagged), t.tac, *limits)
    return found.fillna("", ["brand", "model", "device_type"]).fillna(0, ["handsets", "sims"])


query("new_models", NEW + f"\nselect {_NEW} from new where first_day between date '2026-01-26' and date '2026-04-25'")(lambda t: _new(t, "2026-01-26", "2026-04-25"))
query("new_models_filtered", NEW + f"\nselect {_NEW} from new where first_day between date '2026-01-28' and date '2026-03-31' and known and lower(coalesce(brand, '')) like '%brand#%' and device_type = 'Smartphone'")(
    lambda t: _new(t, "2026-01-28", "2026-03-31", True, "brand#", "Smartphone")
)
for _grain in ("week", "month"):
    query(f"model_arrivals_{_grain}", FIRSTS + f"\nselect cast(date_trunc('{_grain}', first_day) as date) as period, count(*) as models, count(k.tac) as known from firsts f left join tac k on k.tac = f.tac where in_dump = 0 and days_seen > 0 group by 1")(
        lambda t, g=_grain: devices.arrivals(_firsts(t), t.tac, g)
    )
query("network_age", FIRSTS + "\nselect tac, datediff('day', case when in_dump = 1 then date '2026-01-25' else first_day end, date '2026-04-25') as age, in_dump = 1 as at_least, days_seen from firsts")(lambda t: devices.network_age(_firsts(t), AS_OF))
query("tac_dump", "\nselect f.tac, count(distinct f.imei) as handsets, count(distinct f.imsi) as sims, count(*) as bindings from snapshot s join flag f using (msisdn, imsi, imei) where countable = 1 group by 1")(lambda t: daily.tac_dump(t.snapshot, t.tac))
query("active_models", ACT + "\nselect count(distinct tac) as models from act where tac <> ''")(lambda t: t.flagged.where("active = 1 and no_handset = 0").select("tac").distinct().groupBy().count().withColumnRenamed("count", "models"))
