"""Queries over look-ups, timelines and history, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindwell.operators import fold, lookups
from bindwell.plans.network import ORACLES, QUERIES, query
from bindwell.plans.state import STEPS

__all__ = ["ORACLES", "QUERIES"]
NAMED = """,
named as (select tac, nullif(coalesce(nullif(brandName, ''), manufacturer), '') as brand, nullif(marketingName, '') as model from tac)"""
HANDSET = """,
nobody as (select msisdn, imsi, imei from flag where no_handset = 1)"""
HISTORY = """,
hist as (select cast(strftime(data_date, '%Y%m') as int) as month, msisdn, imsi, imei, 0 as in_dump, min(data_date) as first_date, max(data_date) as last_date from ev group by all
 union all select 0, msisdn, imsi, imei, 1, null, null from snapshot)"""
LIVES = STEPS + """,
le as (select msisdn, imsi, imei, min(data_date) as first, max(data_date) as last_change, count(*) filter (outcome = 'redundant_add') as redundant, count(*) filter (outcome = 'orphan_remove') as orphan from done group by all),
lp as (select msisdn, imsi, imei, max(case when close is null then 1 else 0 end) as held, max(case when open = date '1970-01-01' then 1 else 0 end) as in_dump from periods group by all),
lives as (select msisdn, imsi, imei, case when in_dump = 1 then date '1970-01-01' else first end as first_seen, last_change, coalesce(redundant, 0) as redundant, coalesce(orphan, 0) as orphan, coalesce(held, 0) as held
 from le full join lp using (msisdn, imsi, imei))"""

for _kind in ("msisdn", "imsi"):
    _rest = ", ".join(c for c in ("msisdn", "imsi", "imei") if c != _kind)
    query(f"bindings_of_{_kind}", NAMED + f"""
select msisdn, imsi, imei, tac, brand, model, active, last_change_date, no_handset, place from (select *, row_number() over (partition by {_kind} order by active desc, {_rest}) as place from flag) left join named using (tac) where place <= 1000""")(
        lambda t, k=_kind: lookups.bindings_of(t.flagged, t.tac, k)
    )
query("sim_left_out", "\nselect imsi, count(*) as left_out from flag where no_handset = 1 group by 1")(lambda t: lookups.sim_left_out(t.flagged))
query("sim_history", NAMED + """,
evh as (select e.* from ev e left join flag f using (msisdn, imsi, imei) where f.no_handset = 0 and data_date between date '2026-02-10' and date '2026-04-10')
select imsi, data_date, seq, msisdn, imei, brand, model, label, place, total > 8 as truncated from (select *, row_number() over (partition by imsi order by data_date desc, seq desc, msisdn, imei) as place, count(*) over (partition by imsi) as total from evh) left join named using (tac) where place <= 8""")(
    lambda t: lookups.sim_history(t.events, t.tac, "2026-02-10", "2026-04-10", 8)
)
for _kind in ("msisdn", "imsi", "imei"):
    _others = [c for c in ("msisdn", "imsi", "imei") if c != _kind]
    _out = "" if _kind == "imei" else " anti join nobody using (msisdn, imsi, imei)"
    _count = lambda c: f"count(distinct imei) filter (length(imei) = 14) as {c}s" if c == "imei" else f"count(distinct {c}) as {c}s"
    query(f"timeline_{_kind}", LIVES + HANDSET + f"""
select {_kind}, min(first_seen) as first_seen, max(last_change) as last_change, count(*) as bindings, sum(coalesce(active, 0)) as active, {', '.join(map(_count, _others))}, sum(redundant) as redundant_adds, sum(orphan) as orphan_removes,
 count(*) filter (held <> coalesce(active, 0)) as mismatched from lives left join cur using (msisdn, imsi, imei){_out} group by 1""")(lambda t, k=_kind: lookups.timeline(t.events, t.snapshot, t.state, t.tac, k))
    query(f"seen_{_kind}", HISTORY + f"\nselect {_kind}, count(*) as rows, min(first_date) as first_date, max(in_dump) as in_dump, max(last_date) as last_date from hist group by 1")(lambda t, k=_kind: lookups.seen(t.history, k))
    query(f"resolve_{_kind}", f"\nselect {_kind}, tac, n, place from (select *, row_number() over (partition by {_kind} order by n desc, tac) as place from (select {_kind}, substr(imei, 1, 8) as tac, count(*) as n from cur where length(imei) = 14 group by all)) where place <= 25")(
        lambda t, k=_kind: lookups.resolve(t.state, k)
    )
for _kind, _other in (("msisdn", "imei"), ("imsi", "msisdn"), ("imei", "imsi")):
    _out = "" if _kind == "imei" else " anti join nobody using (msisdn, imsi, imei)"
    query(f"timeline_groups_{_kind}_{_other}", STEPS + HANDSET + f""",
q as (select distinct {_kind}, {_other}, open, coalesce(close, date '9999-12-31') as e from periods{_out}),
n as (select *, case when open <= max(e) over (partition by {_kind}, {_other} order by open, e rows between unbounded preceding and 1 preceding) then 0 else 1 end as new from q),
spans as (select {_kind}, {_other}, min(open) as first_seen, sum(new) as periods, nullif(max(e), date '9999-12-31') as until from n group by all),
acts as (select {_kind}, {_other}, count(*) as bindings, max(active) as active from cur{_out} group by all)
select {_kind}, {_other}, bindings, active, first_seen, periods, until from acts left join spans using ({_kind}, {_other})""")(lambda t, k=_kind, o=_other: lookups.timeline_groups(t.events, t.snapshot, t.state, t.tac, k, o))
query("data_through", "\nselect max(data_date) as data_through from ev")(lambda t: lookups.data_through(t.events))
query("history_ready", "\nselect count(distinct data_date) as days, 0 as missing, (select count(*) from snapshot) > 0 as ready from ev")(lambda t: lookups.history_ready(t.events, t.history))


@query("refresh_history", "\nselect cast(strftime(data_date, '%Y%m') as int) as month, msisdn, imsi, imei, min(data_date) as first_date, max(data_date) as last_date, count(*) filter (label = 'add') as adds, count(*) filter (label = 'remove') as removes from ev group by all union all select 0, msisdn, imsi, imei, null, null, 0, 0 from snapshot")
def _(t):
    """The day that came last is added to a history without it; the month is the one that any month with that day has."""
    before = fold.build_history(t.events.where("seq <> 40")).unionByName(fold.history_from_dump(t.snapshot))
    after = lookups.refresh_history(before, t.events, t.events.where("seq = 40").select("data_date"))
    return after.select("month", "msisdn", "imsi", "imei", "first_date", "last_date", "adds", "removes")


query("entity_summary", "\n" + " union all ".join(f"select '{k}' as kind, cast({k} as varchar) as term, count(*) as bindings, sum(active) as active, count(distinct msisdn) as numbers, count(distinct imsi) as sims, count(distinct substr(imei, 1, 8)) filter (length(imei) = 14) as models from cur group by {k}" for k in ("msisdn", "imsi", "imei")))(
    lambda t: lookups.entity_summary(t.state)
)
query("left_out_share", "\nselect count(*) filter (no_handset = 1) as left_out, count(*) as bindings from flag")(lambda t: t.flagged.agg(F.count_if(F.col("no_handset") == 1).alias("left_out"), F.count(F.lit(1)).alias("bindings")))
