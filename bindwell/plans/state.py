"""Queries over state, history and days, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindwell.functions.rules import REPORTING_BODIES, enrich_identifiers, flag_handsets, mask_table
from bindwell.operators import daily, fold
from bindwell.sources.feed import KEY, LAST_SEQ, oracle, stored

FEED = "with recursive " + oracle(REPORTING_BODIES)

STEPS = """,
said as (select ev.*, s.imei is not null as in_dump,
  lag(ev.label) over (partition by ev.msisdn, ev.imsi, ev.imei order by data_date, seq, ev.label) as before
 from ev left join snapshot s on ev.msisdn = s.msisdn and ev.imsi = s.imsi and ev.imei = s.imei),
done as (select *, case when label <> coalesce(before, case when in_dump then 'add' else 'remove' end) then 'applied'
  when label = 'add' then 'redundant_add' else 'orphan_remove' end as outcome from said),
steps as (select msisdn, imsi, imei, data_date, seq, label from done where outcome = 'applied'
 union all select msisdn, imsi, imei, date '1970-01-01', 0, 'add' from snapshot),
periods as (select msisdn, imsi, imei, data_date as open, close from
 (select *, lead(data_date) over (partition by msisdn, imsi, imei order by data_date, seq, label) as close from steps) where label = 'add')"""

SWAP = """
select data_date, count(*) as changes from (
 select data_date, msisdn from (select data_date, msisdn, {c}, max(label = 'add') as added, max(label = 'remove') as removed from ev group by all)
 group by all having count(*) filter (removed) > 0 and count(*) filter (added and not removed) > 0) group by data_date"""

DQ = """,
multi as (select data_date, imsi, count(*) as numbers, sum(r) as rows from (select data_date, imsi, msisdn, count(*) as r from ev group by all) group by data_date, imsi having count(*) > 1),
evf as (select ev.*, k.tac is not null as known, s.t7 is not null as tail from ev left join tac k on k.tac = ev.tac
 left join (select distinct substr(tac, 2, 7) as t7 from tac) s on s.t7 = substr(imei, 1, 7)),
dq as (select data_date, count(*) as rows_total, count(distinct imsi) as sims_total, count(*) filter (imei = '000000') as unknown_device_rows,
 count(*) filter (length(imei) <> 14 and imei <> '000000') as malformed_imei_rows, count(*) filter (length(imei) = 14 and not known) as unknown_tac_rows,
 count(*) filter (length(imei) = 14 and not known and right(imei, 1) = '0' and tail and imei <> '00000000000000') as shifted_imei_rows,
 coalesce((select count(*) from multi m where m.data_date = evf.data_date), 0) as multi_number_sims,
 coalesce((select sum(rows) from multi m where m.data_date = evf.data_date), 0) as multi_number_sim_rows from evf group by data_date),
rates as (select data_date, 'shifted_imei' as "check", shifted_imei_rows / rows_total as rate from dq union all select data_date, 'multi_number_sim', multi_number_sims / sims_total from dq
 union all select data_date, 'malformed_imei', malformed_imei_rows / rows_total from dq union all select data_date, 'unknown_device', unknown_device_rows / rows_total from dq),
assessed as (select r.*, m.median, greatest(m.median * 5, 0.0001) as threshold, rate > greatest(m.median * 5, 0.0001) as flagged
 from rates r join (select "check", median(rate) as median from rates where data_date between date '2026-02-01' and date '2026-02-28' group by 1) m using ("check"))"""

EVIDENCE = """,
evidence as (select data_date, msisdn, array_to_string(list_sort(list(imsi) filter (added and not removed))[1:5], ',') as new_imsis,
 array_to_string(list_sort(list(imsi) filter (removed))[1:5], ',') as old_imsis, count(*) filter (added and not removed) as new_count, count(*) filter (removed) as old_count,
 case when max(multi) then 'multi_number' else 'none' end as set_aside
 from (select e.data_date, e.msisdn, e.imsi, max(label = 'add') as added, max(label = 'remove') as removed, max(m.imsi is not null) as multi
  from ev e left join multi m on m.data_date = e.data_date and m.imsi = e.imsi group by all)
 group by data_date, msisdn having count(*) filter (added and not removed) > 0 and count(*) filter (removed) > 0)"""

REF = ("2026-02-01", "2026-02-28")
QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(stored(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = FEED + sql
        return f

    return add


STATE = "\nselect msisdn, imsi, imei, tac, active, last_change_seq, last_change_date from cur"


@query("fold_all", STATE)
def _(f):
    return fold.fold_all(f.snapshot, f.events)


@query("fold_day", STATE)
def _(f):
    before = fold.fold_all(f.snapshot, f.events.where(F.col("seq") < LAST_SEQ))
    return fold.fold_day(before, f.events.where(F.col("seq") == LAST_SEQ))


@query("refold_late_day", STATE)
def _(f):
    late = f.events.where("seq = 30")
    return fold.refold_keys(fold.fold_all(f.snapshot, f.events.where("seq <> 30")), f.events, f.snapshot, late)


@query("fold_outcomes", STEPS + "\nselect data_date, outcome, count(*) as n, count(*) filter (in_dump) as of_dump from done group by all")
def _(f):
    return fold.fold_outcomes(f.events, f.snapshot).groupBy("data_date", "outcome").agg(F.count(F.lit(1)).alias("n"), F.count_if("in_dump").alias("of_dump"))


@query("periods", STEPS + "\nselect * from periods")
def _(f):
    return fold.periods(f.events, f.snapshot)


@query("lifetimes", STEPS + """,
e as (select msisdn, imsi, imei, min(data_date) as first, max(data_date) as last_change, count(*) filter (outcome = 'redundant_add') as redundant,
 count(*) filter (outcome = 'orphan_remove') as orphan, count(*) - count(distinct data_date) as conflicts from done group by all),
p as (select msisdn, imsi, imei, count(*) as periods, max(case when close is null then 1 else 0 end) as active, max(case when open = date '1970-01-01' then 1 else 0 end) as in_dump from periods group by all)
select msisdn, imsi, imei, case when in_dump = 1 then date '1970-01-01' else first end as first_seen, last_change, coalesce(periods, 0) as periods, coalesce(active, 0) as active,
 coalesce(in_dump, 0) as in_dump, coalesce(redundant, 0) as redundant, coalesce(orphan, 0) as orphan, coalesce(conflicts, 0) as conflicts from e full join p using (msisdn, imsi, imei)""")
def _(f):
    return fold.lifetimes(f.events, f.snapshot)


for by in KEY:
    def _(f, by=by):
        return fold.union_periods(fold.periods(f.events, f.snapshot), [by])

    query(f"union_periods_{by}", STEPS + f""",
q as (select distinct {by}, open, coalesce(close, date '9999-12-31') as e from periods),
n as (select *, case when open <= max(e) over (partition by {by} order by open, e rows between unbounded preceding and 1 preceding) then 0 else 1 end as new from q),
i as (select *, sum(new) over (partition by {by} order by open, e rows unbounded preceding) as island from n)
select {by}, min(open) as open, nullif(max(e), date '9999-12-31') as close from i group by {by}, island""")(_)


@query("binding_history", """
select cast(strftime(data_date, '%Y%m') as int) as month, msisdn, imsi, imei, min(data_date) as first_date, max(data_date) as last_date,
 count(*) filter (label = 'add') as adds, count(*) filter (label = 'remove') as removes,
 string_agg(concat(data_date, ':', seq, ':', case when label = 'add' then 1 else 2 end), ',' order by data_date, seq) as events from ev group by all""")
def _(f):
    said = F.transform("events", lambda e: F.concat_ws(":", e["date"].cast("string"), e["seq"].cast("string"), e["label"].cast("string")))
    return fold.build_history(f.events).drop("in_dump").withColumn("events", F.array_join(said, ","))


@query("history_from_dump", "\nselect 0 as month, msisdn, imsi, imei, 1 as in_dump, 0 as n_events from snapshot")
def _(f):
    return fold.history_from_dump(f.snapshot).select("month", *KEY, "in_dump", F.size("events").alias("n_events"))


@query("folded_count", "\nselect data_date, count(distinct (msisdn, imsi, imei)) as bindings from ev group by 1")
def _(f):
    return fold.folded_count(f.events)


@query("change_daily", "\nselect data_date, tac, label, count(*) as n from ev group by all")
def _(f):
    return daily.change_daily(f.events)


@query("change_summary", """
select data_date, count(*) filter (label = 'add') as added, count(*) filter (label = 'remove') as removed, count(*) filter (imei = '000000') as unknown_device, count(*) as rows_total from ev group by 1""")
def _(f):
    return daily.change_summary(f.events)


query("sim_changes", SWAP.format(c="imsi"))(lambda f: daily.sim_changes(f.events))
query("device_changes", SWAP.format(c="imei"))(lambda f: daily.device_changes(f.events))


@query("built_days", "\nselect data_date from (" + SWAP.format(c="imsi") + ") intersect select data_date from (" + SWAP.format(c="imei") + ") intersect select data_date from ev")
def _(f):
    return daily.built_days(daily.change_daily(f.events), daily.change_summary(f.events), daily.sim_changes(f.events), daily.device_changes(f.events))


@query("backfill_days", "\nselect data_date, tac, label, count(*) as n from ev where seq > 45 group by all")
def _(f):
    return daily.backfill(daily.change_daily, f.events, f.events.where("seq <= 45"))


@query("missing_days", "\nselect cast(d as date) as data_date from (select unnest(generate_series((select min(data_date) from ev), (select max(data_date) from ev), interval 1 day)) as d) where cast(d as date) not in (select data_date from ev where seq % 9 <> 4 or seq in (1, 90))")
def _(f):
    """A log that lost every ninth day."""
    return daily.missing_days(f.events.where("seq % 9 <> 4 or seq in (1, 90)"))


query("multi_number_sims", DQ + "\nselect data_date, imsi, numbers, rows from multi")(lambda f: daily.multi_number_sims(f.events))
query("dq_daily", DQ + "\nselect * from dq")(lambda f: daily.dq_daily(f.events, f.tac))
query("feed_days_in_range", DQ + "\nselect * from dq where data_date between date '2026-03-01' and date '2026-03-31'")(lambda f: daily.dq_daily(f.events.where("data_date between date'2026-03-01' and date'2026-03-31'"), f.tac))
query("assess_feed", DQ + "\nselect * from assessed")(lambda f: daily.assess_feed(daily.dq_daily(f.events, f.tac), *REF))


@query("sim_change_evidence", DQ + EVIDENCE + "\nselect * from evidence")
def _(f):
    out = daily.sim_change_evidence(f.events, daily.multi_number_sims(f.events), daily.dq_daily(f.events, f.tac))
    return out.withColumns({c: F.array_join(F.col(c).cast("array<string>"), ",") for c in ("new_imsis", "old_imsis")})


COUNTABLE = "length(imei) = 14 and regexp_full_match(imei, '[0-9]{14}') and imei <> '00000000000000' and not (tail and not known and right(imei, 1) = '0')"
query("tac_day", DQ + f"\nselect data_date, tac, count(distinct imei) as handsets, count(distinct imsi) as sims, count(*) as adds from evf where label = 'add' and {COUNTABLE} group by all")(lambda f: daily.tac_day(f.events, f.tac))
CATEGORY = " union all ".join(
    f"select '{name}' as category, count(*) as bindings, count(distinct msisdn) as numbers, count(distinct imsi) as sims, count(distinct imei) as imeis from flag where {test} having count(*) > 0"
    for name, test in {
        "all": "true", "active": "active = 1", "missing_imei": "imei in ('000000', '')", "invalid_imei": "imei not in ('000000', '') and not regexp_full_match(imei, '[0-9]{14}')",
        "zero_imei": "imei = '00000000000000'", "shifted_imei": "shifted = 1", "unknown_tac": "countable = 1 and known = 0", "invalid_imsi": "length(cast(imsi as varchar)) <> 15",
        "invalid_msisdn": "length(cast(msisdn as varchar)) <> 10", "untouched_since_dump": "active = 1 and last_change_date is null",
    }.items()
)
query("quality_current", "\n" + CATEGORY)(lambda f: daily.quality_current(fold.fold_all(f.snapshot, f.events), f.tac))

HISTORY_CATEGORY = """,
o as (select *, lag(data_date) over (partition by msisdn, imsi, imei order by data_date, seq) as day_before, row_number() over (partition by msisdn, imsi, imei order by data_date desc, seq desc) as last from said),
b as (select msisdn, imsi, imei, count(*) filter (label = 'add' and before = 'add') as redundant, count(*) filter (label = 'remove' and coalesce(before = 'remove', not in_dump)) as orphan,
 list(datediff('day', day_before, data_date)) filter (label = 'remove' and before = 'add') as lens, max(case when last = 1 and label = 'add' then 1 else 0 end) as held from o group by all
 union all select s.msisdn, s.imsi, s.imei, 0, 0, null, 1 from snapshot s anti join ev e on s.msisdn = e.msisdn and s.imsi = e.imsi and s.imei = e.imei),
x as (select msisdn, imsi, imei, unnest([{'c': 'history_all', 'n': 1}, {'c': 'redundant_add', 'n': redundant}, {'c': 'orphan_remove', 'n': orphan},
 {'c': 'period_same_day', 'n': len(list_filter(lens, lambda v: v = 0))}, {'c': 'period_1_day', 'n': len(list_filter(lens, lambda v: v = 1))}, {'c': 'period_2_7_days', 'n': len(list_filter(lens, lambda v: v between 2 and 7))},
 {'c': 'period_8_30_days', 'n': len(list_filter(lens, lambda v: v between 8 and 30))}, {'c': 'period_31_90_days', 'n': len(list_filter(lens, lambda v: v between 31 and 90))},
 {'c': 'period_over_90_days', 'n': len(list_filter(lens, lambda v: v > 90))}, {'c': 'still_held', 'n': held}]) as k from b)
select k.c as category, count(*) as bindings, count(distinct msisdn) as numbers, count(distinct imsi) as sims, count(distinct imei) as imeis, sum(k.n) as periods from x where k.n > 0 group by 1"""


@query("quality_history", STEPS + HISTORY_CATEGORY)
def _(f):
    return daily.quality_history(fold.build_history(f.events).unionByName(fold.history_from_dump(f.snapshot)))


@query("quality_flag_counts", "\nselect category, count(*) as n from (select 'shifted' as category from flag where shifted = 1 union all select 'no_handset' from flag where no_handset = 1) group by 1 having count(*) > 0")
def _(f):
    flagged = flag_handsets(fold.fold_all(f.snapshot, f.events), f.tac)
    named = flagged.select(F.explode(F.array_compact(F.array(F.when(F.col("shifted") == 1, "shifted"), F.when(F.col("no_handset") == 1, "no_handset")))).alias("category"))
    return named.groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query("handset_flags", "\nselect msisdn, imsi, imei, known, shifted, no_handset, countable from flag")
def _(f):
    return flag_handsets(fold.fold_all(f.snapshot, f.events), f.tac).select(*KEY, "known", "shifted", "no_handset", "countable")


@query("enrich_identifiers", """
select msisdn, imsi, imei, length(cast(imsi as varchar)) as imsi_digits, substr(cast(imsi as varchar), 1, 5) as network, length(cast(imsi as varchar)) = 15 as imsi_well_formed,
 case when regexp_full_match(imei, '[0-9]{14}') then 'well_formed' when imei = '000000' then 'unknown' else 'malformed' end as imei_quality,
 case when length(cast(imsi as varchar)) = 15 then concat('8998', substr(cast(imsi as varchar), 4, 4), '000', substr(cast(imsi as varchar), 8, 8)) end as iccid from cur""")
def _(f):
    return enrich_identifiers(fold.fold_all(f.snapshot, f.events))


@query("mask_table", """
select concat(left(cast(msisdn as varchar), 3), '*****', right(cast(msisdn as varchar), 2)) as msisdn, concat(left(cast(imsi as varchar), 5), '******', right(cast(imsi as varchar), 4)) as imsi,
 case when length(imei) > 8 then concat(left(imei, 8), repeat('*', length(imei) - 8)) else repeat('*', length(imei)) end as imei from cur""")
def _(f):
    return mask_table(fold.fold_all(f.snapshot, f.events).select(*KEY))
