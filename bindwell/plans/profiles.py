"""Queries that profile the feed and its catalogue, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindwell.operators import profile
from bindwell.plans.network import ORACLES, QUERIES, query

__all__ = ["ORACLES", "QUERIES"]
KEYS = "msisdn, imsi, imei"
query("profile_keys", f"\nselect sum(n) as rows, count(distinct msisdn) as numbers, count(distinct imsi) as sims, count(distinct imei) as imeis, count(*) as bindings, sum(n) - count(*) as repeated from (select {KEYS}, count(*) as n from ev group by all)")(lambda t: profile.key_quality(t.events))
query("profile_lengths", "\n" + " union all ".join(f"select '{c}' as field, length(cast({c} as varchar)) as length, count(*) as n from snapshot group by 2" for c in ("msisdn", "imsi", "imei")))(lambda t: profile.field_lengths(t.snapshot))
query("profile_imei_classes", "\nselect case when imei = '000000' then 'unknown' when regexp_full_match(imei, '0+') then 'zeros' when length(imei) = 14 then 'whole' else concat('length ', length(imei)) end as kind, count(*) as n, round(100 * count(*) / sum(count(*)) over (), 4) as percent from snapshot group by 1")(
    lambda t: profile.imei_classes(t.snapshot)
)
query("profile_short_imeis", "\nselect imei, count(*) as n from ev where length(imei) <> 14 group by 1 order by n desc, imei limit 15")(lambda t: profile.short_imeis(t.events, 15))
query("profile_rows_per_number", "\nselect least(n, 10) as k, count(*) as numbers, round(100 * count(*) / sum(count(*)) over (), 3) as percent from (select msisdn, count(*) as n from ev group by 1) group by 1")(lambda t: profile.rows_per_number(t.events))
for _of, _count, _most in (("msisdn", "imei", 8), ("msisdn", "imsi", 8), ("imsi", "msisdn", 5), ("imei", "msisdn", 8)):
    query(f"profile_{_count}s_per_{_of}", f"\nselect least(n, {_most}) as k, count(*) as entities from (select {_of}, count(distinct {_count}) as n from cur where length(imei) = 14 group by 1) group by 1")(
        lambda t, o=_of, c=_count, m=_most: profile.per_entity(t.state.where("length(imei) = 14"), o, c, m)
    )
query("profile_coverage", """
select count(*) as rows, count(*) filter (length(imei) <> 14) as no_model, count(*) filter (length(imei) = 14 and k.tac is not null) as matched, count(*) filter (length(imei) = 14 and k.tac is null) as unmatched,
 count(distinct c.tac) filter (length(imei) = 14) as models, count(distinct k.tac) as models_matched from cur c left join tac k on k.tac = c.tac""")(lambda t: profile.coverage(t.state, t.tac))
query("profile_unmatched_models", "\nselect tac, count(*) as n from cur where length(imei) = 14 and tac not in (select tac from tac) group by 1 order by n desc, tac limit 15")(lambda t: profile.unmatched_models(t.state, t.tac, 15))
query("profile_model_skew", """,
c as (select tac, count(*) as n from cur where length(imei) = 14 group by 1), r as (select n, row_number() over (order by n desc, tac) as k, sum(n) over () as total from c)
select round(100 * sum(n) filter (k <= 10) / max(total), 2) as top_10, round(100 * sum(n) filter (k <= 100) / max(total), 2) as top_100, round(100 * sum(n) filter (k <= 1000) / max(total), 2) as top_1000, count(*) as models from r""")(lambda t: profile.model_skew(t.state))
query("profile_days", f"""
select * from (select data_date, count(*) as rows, count(distinct ({KEYS}, label)) as statements, count(distinct ({KEYS})) as bindings from ev group by 1)
 join (select data_date, count(*) as numbers, count(*) filter (a and r) as both, count(*) filter (not r) as only_adds, count(*) filter (not a) as only_removes from (select data_date, msisdn, bool_or(label = 'add') as a, bool_or(label = 'remove') as r from ev group by all) group by 1) using (data_date)""")(lambda t: profile.day_consistency(t.events))
query("profile_days_per_statement", f"\nselect least(d, 5) as days, count(*) as n from (select {KEYS}, label, count(distinct data_date) as d from ev group by all) group by 1")(lambda t: profile.days_per_statement(t.events))
query("profile_replay", f""",
st as (select ev.*, s.imei is not null as dump, coalesce(sum(case when label = 'add' then 1 else -1 end) over (partition by {', '.join('ev.' + c for c in ('msisdn', 'imsi', 'imei'))} order by data_date, seq, label rows between unbounded preceding and 1 preceding), 0) as net from ev left join snapshot s using ({KEYS}))
select label, count(*) as n, count(*) filter (net + cast(dump as int) = 0 and label = 'remove') as orphan_removes, count(*) filter (net + cast(dump as int) >= 1 and label = 'add') as double_adds from st group by 1""")(lambda t: profile.replay(t.events, t.snapshot))
query("profile_net_balance", f"\nselect net, count(*) as bindings from (select {KEYS}, sum(case when label = 'add' then 1 else -1 end) as net from ev group by all) group by 1")(lambda t: profile.net_balance(t.events))
query("profile_alternation", f""",
said as (select label, lag(label) over (partition by {KEYS} order by data_date, seq, label) as before from ev)
select label, count(*) as events, count(*) filter (before is null) as first, count(*) filter (before = label) as repeats, round(100 * count(*) filter (before = label) / nullif(count(before), 0), 4) as percent from said group by 1""")(lambda t: profile.alternation(t.events))
query("profile_first_event", f"""
select first_label, s.imei is not null as in_dump, count(*) as bindings, round(100 * count(*) / sum(count(*)) over (partition by first_label), 2) as percent
from (select {KEYS}, arg_min(label, seq) as first_label from ev group by all) left join snapshot s using ({KEYS}) group by 1, 2""")(lambda t: profile.first_event(t.events, t.snapshot))
query("profile_state", "\nselect count(*) as bindings, sum(active) as active, count(distinct msisdn) filter (active = 1) as active_numbers from cur")(lambda t: profile.reconstructed(t.state))
query("profile_active_per_number", "\nselect least(n, 6) as k, count(*) as numbers, round(100 * count(*) / sum(count(*)) over (), 2) as percent from (select msisdn, sum(active) as n from cur group by 1) group by 1")(lambda t: profile.active_per_number(t.state))
query("profile_day_sizes", "\nselect min(n) as least, round(avg(n), 4) as mean, max(n) as most, count(*) as days, sum(n) as rows from (select data_date, count(*) as n from ev group by 1)")(lambda t: profile.day_sizes(t.events))
_TEXT = ["manufacturer", "brandName", "deviceType", "operatingSystem"]
query("profile_spellings", "\n" + " union all ".join(f"""select '{c}' as "column", count(distinct {c}) as raw, count(distinct lower(trim({c}))) as tidy from tac""" for c in _TEXT))(lambda t: profile.spellings(t.tac, _TEXT))
query("profile_spelling_variants", "\nselect lower(split_part(trim(manufacturer), ' ', 1)) as name, count(distinct manufacturer) as spellings, count(*) as models from tac where trim(manufacturer) <> '' group by 1 having count(distinct manufacturer) > 1")(
    lambda t: profile.spelling_variants(t.tac, "manufacturer")
)
query("profile_catalogue", """
select count(*) as rows, count(distinct tac) as tacs, 0 as null_tac, count(*) filter (length(tac) <> 8) as odd_length, count(*) filter (not regexp_full_match(tac, '[0-9]+')) as not_digits, count(distinct manufacturer) as manufacturer, count(distinct brandName) as "brandName",
 count(distinct modelName) as "modelName", count(distinct marketingName) as "marketingName", count(distinct deviceType) as "deviceType", count(distinct operatingSystem) as "operatingSystem", count(*) filter (ntnConnectivity = 'Not Known') as ntn_not_known,
 count(*) filter (operatingSystem = '') as system_blank, min(cast(strptime(allocationDate, '%d-%b-%Y') as date)) as first_allocated, max(cast(strptime(allocationDate, '%d-%b-%Y') as date)) as last_allocated, 0 as undated from tac""")(lambda t: profile.catalogue_profile(t.tac))
_TESTS = {
    "shifted": "shifted = 1", "no_handset": "no_handset = 1", "untouched_since_dump": "active = 1 and last_change_date is null", "held": "active = 1", "removed": "active = 0", "unknown_model": "countable = 1 and known = 0",
}
query("quality_examples", f""",
cat as ({' union all '.join(f"select '{c}' as category, {KEYS}, md5(concat_ws('|', msisdn, imsi, imei)) as mark from flag where {test}" for c, test in _TESTS.items())}),
chosen as (select category, place, {KEYS} from (select *, row_number() over (partition by category order by mark) as place from cat) where place <= 5),
told as (select {KEYS}, string_agg(concat(data_date, ':', label), ',' order by data_date, label) as history from ev group by all)
select category, place, {KEYS}, coalesce(history, '') as history from chosen left join told using ({KEYS})""")(lambda t: profile.examples(t.flagged, t.events, {c: F.expr(test) for c, test in _TESTS.items()}, 5))
