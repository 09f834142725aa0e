"""Queries over marts, look-ups, risk and planning, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindwell.functions import radio
from bindwell.functions.radio import parse_radio
from bindwell.functions.rules import flag_handsets, imsi_range, model_key
from bindwell.operators import daily, fold, marts, planning, risk, tac_mart
from bindwell.plans.state import DQ, EVIDENCE, FEED
from bindwell.sources.feed import LAST_DAY, stored
from bindwell.sources.layouts import Journal, Layouts
from bindwell.sources.store import kept, kept_folder
from bindwell.streaming.days import on_days

QUERIES, ORACLES = {}, {}
AS_OF = LAST_DAY


class Tables:
    """The feed with what most queries derive from it."""

    def __init__(self, spark, sf_dir):
        self.spark, self.sf_dir = spark, sf_dir
        feed = stored(spark, sf_dir)
        self.events, self.snapshot, self.tac, self.vendors = feed.events, feed.snapshot, feed.tac, feed.vendors
        self.state = kept(spark, sf_dir, "state", lambda: fold.fold_all(feed.snapshot, feed.events))
        self.devices = marts.with_vendor(feed.tac, feed.vendors)

    def _kept(self, name, make):
        return kept(self.spark, self.sf_dir, name, make)

    @property
    def flagged(self):
        """The state with what the catalogue says of its handsets, written once."""
        return self._kept("flagged", lambda: flag_handsets(self.state, self.tac))

    @property
    def radio(self):
        """The catalogue's radio profiles, parsed once a version."""
        return self._kept("radio", lambda: parse_radio(self.tac))

    @property
    def dq(self):
        return self._kept("dq_daily", lambda: daily.dq_daily(self.events, self.tac, self.multi))

    @property
    def evidence(self):
        return self._kept("evidence", lambda: daily.sim_change_evidence(self.events, self.multi, self.dq))

    @property
    def mart(self):
        """The models' mart with its sketches, written once."""
        return self._kept("tac_mart", lambda: tac_mart.state_mart(self.flagged))

    @property
    def copies(self):
        """The sorted copies of the state and their manifest: made from the first days, then kept up to date with the rest."""

        root = self._delivered("copies", marts=False)
        return Layouts(self.spark, root), Journal(self.spark, root).manifest()

    @property
    def day_marts(self):
        """The same two deliveries with all that they leave: marts of their days and history of their months too."""
        return Journal(self.spark, self._delivered("deliveries", marts=True))

    def _delivered(self, name, marts):
        def fill(root):
            early, late = self.events.where("seq <= 60"), self.events.where("seq > 60")
            for number, days in enumerate((early, late)):
                on_days(days, self.snapshot, root, number, marts=marts)

        return kept_folder(self.spark, self.sf_dir, name, fill)

    @property
    def history(self):
        return fold.build_history(self.events).unionByName(fold.history_from_dump(self.snapshot))

    @property
    def multi(self):
        return self._kept("multi", lambda: daily.multi_number_sims(self.events))

    @property
    def adds(self):
        """The adds of the risk windows, marked once for all of them."""
        return self._kept("adds_30", lambda: risk.marked_adds(self.events, self.tac, self.multi, AS_OF))

    @property
    def week_evidence(self):
        """The evidence of the last seven days, from their events alone: what ``number_changes`` reads."""
        week = self.events.where(F.col("data_date") > F.date_sub(F.lit(AS_OF).cast("date"), 7))
        return daily.sim_change_evidence(week, self.multi, self.dq)


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = FEED + sql
        return f

    return add


ACT = """,
act as (select msisdn, imsi, imei, case when no_handset = 1 then '' else tac end as tac, last_change_date from flag where active = 1)"""
FIGURES = "count(*) as bindings, count(distinct msisdn) as subscribers, count(distinct imsi) as sims, count(distinct imei) filter (tac <> '') as handsets"


_words = lambda names: ", ".join(f"'{n}'" for n in names)


def _fits_sql(form: tuple) -> tuple[str, str]:
    """A form as a condition on the list ``ws`` of a token's words, and its number."""
    before, head, digits, fact = form
    size = len(before) + (digits is not None)
    tests = [f"len(ws) = {size}", *(f"ws[{k}] in ({_words(names)})" for k, names in enumerate(before, 1))]
    if digits is None:
        return " and ".join(tests), "try_cast(regexp_extract(ws[1], '-(.)', 1) as int)" if fact == "option" else "null"
    return " and ".join([*tests, f"regexp_full_match(ws[{size}], '{head}[0-9]{{{digits[0]},{digits[1]}}}')"]), f"try_cast(substr(ws[{size}], {len(head) + 1}) as int)"


def _token_sql() -> str:
    """Facts of the band tokens, one select a form."""
    found = [(section, form[3], *_fits_sql(form)) for section, forms in radio.FORMS.items() for form in forms]
    rows = [f"select tac, '{fact}' as f, {number} as band from tok where label = '{section}' and {test}" for section, fact, test, number in found]
    return " union all ".join([*rows, f"select tac, 'gsm', null from tok where label = '2G/3G' and upper(t) like '{radio.RAILWAY}%'"])


def _known_sql(section: str) -> str:
    railway = [f"upper(t) like '{radio.RAILWAY}%'"] if section == "2G/3G" else []
    return " or ".join([*(f"({_fits_sql(form)[0]})" for form in radio.FORMS[section]), *railway])


_OTHER = " or ".join(f"regexp_full_match(w, '{head.replace('.', '[.]')}[{'0-9' if '0' in signs else 'A-Z+' if '+' in signs else 'A-Z'}]{{{least},{most}}}')" for head, signs, least, most in radio.OTHER_WORDS)
RADIO = f""",
sec as (select tac, s, trim(case when contains(s, ':') then split_part(s, ':', 1) else s end) as label from (select tac, unnest(list_filter(list_transform(string_split(bandDetails, '|'), lambda x: trim(x)), lambda x: x <> '')) as s from tac)),
tok as (select *, string_split_regex(case when upper(t) like 'GSM%' and regexp_full_match(upper(t), '[^(]*[(]GSM *[0-9]{{3,4}}[)]') then trim(split_part(upper(t), '(', 1)) else upper(t) end, '\\s+') as ws from (select tac, label, trim(t) as t from (select tac, label, unnest(string_split(substr(s, strpos(s, ':') + 1), ',')) as t from sec where contains(s, ':')) where trim(t) <> '')),
free as (select * from tok where (label = 'Radio Interface' or (label = '2G/3G' and not ({_known_sql('2G/3G')}))) and lower(t) <> '2.4-2.5 ghz'),
word as (select tac, label, t, upper(rtrim(w, ':')) as w from (select tac, label, t, unnest(string_split_regex(t, '[ /]+')) as w from free) where w <> ''),
spoken as ({' union all '.join(f"select tac, '{f}' as f, null as band from word where w in ({_words(n)})" for f, n in radio.WORDS.items() if f)}
 union all select tac, 'lte', cast(substr(w, 2) as int) from word where regexp_full_match(w, 'B[0-9]{{1,3}}')),
fact as ({_token_sql()} union all select * from spoken union all select tac, 'listed', null from spoken where f <> 'satellite'
 union all select tac, 'listed', null from sec where label in ('2G/3G', 'LPWAN', '5G NR', '5G REDCAP') or label like '4G%' union all select tac, 'nr', null from sec where label in ('5G NR', '5G REDCAP')
 union all select tac, 'lte', null from sec where label like '4G%' union all select tac, 'redcap', null from sec where label = '5G REDCAP' union all select tac, 'satellite', null from sec where label = 'SATELLITE'
 union all select tac, 'dual', null from sec where label like '5G%' and (contains(label, 'EN-DC') or contains(label, 'NE-DC'))),
odd as (select tac, concat(label, ': ', t) as t from tok where label in ({_words(radio.FORMS)}) and label <> '2G/3G' and not ({' or '.join(f"(label = '{s}' and ({_known_sql(s)}))" for s in radio.FORMS)})
 union all select distinct tac, concat(label, ': ', t) from word where w not in ({_words(w for n in radio.WORDS.values() for w in n)}) and not regexp_full_match(w, 'B[0-9]{{1,3}}') and not ({_OTHER})
 union all select tac, concat(label, ': (section)') from sec where label not in ({_words(radio.FORMS)}, 'SATELLITE', 'Radio Interface') and label not like '4G%' and label not like '5G%'),
heard as (select tac, {', '.join(f"coalesce(bool_or(f = '{f}'), false) as {f}" for f in ('listed', 'gsm', 'umts', 'cdma', 'lte', 'nr', 'nb_iot', 'lte_m', 'ec_gsm', 'redcap', 'satellite', 'dual'))},
 coalesce(bool_or(f = 'option' and band = 2), false) as alone, coalesce(bool_or(f = 'option' and band in (3, 4, 7)), false) as beside,
 {', '.join(f"coalesce(list_sort(list(distinct band) filter (f = '{f}' and band is not null)), []) as {f}_bands" for f in ('lte', 'nr', 'umts', 'gsm', 'nb_iot', 'lte_m', 'ntn_b', 'ntn_n'))} from tac left join fact using (tac) group by 1),
esims as (select tac, try_cast(nullif(trim(removableEUICC), '00') as int) as a, try_cast(nullif(trim(nonremovableEUICC), '00') as int) as b from tac),
radios as (select tac, cast(listed as int) as bands_listed, case when not listed then 2 when lte or nb_iot or lte_m then 1 else 0 end as lte, case when not listed then 2 when nr then 1 else 0 end as nr, cast(umts as int) as umts,
 cast(gsm or ec_gsm as int) as gsm, cast(cdma as int) as cdma, cast(nb_iot or lte_m as int) as lpwan, cast(redcap as int) as redcap, cast(satellite as int) as satellite, lte_bands, nr_bands, umts_bands, gsm_bands, nb_iot_bands, lte_m_bands,
 case when alone then 1 else 2 end as sa, case when dual or beside then 1 else 2 end as nsa, coalesce(options, '') as options, case when coalesce(a, 0) > 0 or coalesce(b, 0) > 0 then 1 when a = 0 and b = 0 then 0 else 2 end as esim,
 case when lower(trim(ntnConnectivity)) = 'no' then 0 when ntnConnectivity like '3GPP NTN%' then 1 else 2 end as ntn, case when ntnConnectivity like '3GPP NTN &%' then 'NTN and TN' when ntnConnectivity like '3GPP NTN Only%' then 'NTN only' end as ntn_mode,
 case when ntnConnectivity like '3GPP NTN%' then replace(regexp_extract(ntnConnectivity, '[(](.*)[)]', 1), ' ', '') end as ntn_orbits,
 list_concat(list_transform(ntn_b_bands, lambda x: concat('B', x)), list_transform(ntn_n_bands, lambda x: concat('n', x))) as ntn_bands,
 case {' '.join(f"when deviceType in ({_words(kinds)}) then '{name}'" for name, kinds in radio.CLASSES.items())} else 'Other' end as device_class,
 case when not listed then 0 when lte or nr then 1 when nb_iot or lte_m then 2 when gsm or umts or cdma or ec_gsm then 3 else 0 end as sunset, coalesce(unparsed, []) as unparsed
 from heard join esims using (tac) join tac using (tac) left join (select tac, string_agg(t, ',') as options from tok where label = '5G NA Options' group by 1) using (tac)
 left join (select tac, list_sort(list(t)) as unparsed from odd group by 1) using (tac))"""
POP = ACT + """,
pop as (select tac, count(*) as bindings, count(*) filter (imei = '000000') as unknown_device, count(*) filter (length(imei) <> 14 and imei <> '000000') as malformed_imei,
 count(*) filter (length(imei) = 14 and tac = '') as invalid_imei, count(distinct msisdn) as subscribers, count(distinct imsi) as sims, count(distinct imei) filter (tac <> '') as handsets,
 min(last_change_date) as first_seen, max(last_change_date) as last_seen from act group by tac)"""
DIMENSIONS = (("vendor", "vendor"), ("manufacturer", "manufacturer"), ("model", "marketingName"), ("deviceType", "deviceType"), ("operatingSystem", "operatingSystem"))
DIM = ACT + ",\nlabelled as (" + " union all ".join(
    f"select '{name}' as dimension, case when a.tac = '' then '(unknown device)' else coalesce(nullif(trim(d.{column}), ''), '(unknown TAC)') end as value, a.* from act a left join dev d using (tac)" for name, column in DIMENSIONS
) + " union all select 'tac', case when tac = '' then '(unknown device)' else tac end, * from act),\n" + f"dim as (select dimension, value, {FIGURES} from labelled group by all)"
KPI = f""",
kpi as (select {FIGURES}, count(*) filter (imei = '000000') as unknown_device, count(*) filter (length(imei) <> 14 and imei <> '000000') as malformed_imei,
 count(*) filter (length(imei) = 14 and tac = '') as invalid_imei, count(*) filter (tac in (select tac from tac)) as tac_matched from act)"""

query("tac_population", POP + "\nselect * from pop")(lambda t: marts.tac_population(t.flagged))
query("device_model_sketch")(lambda t: marts.device_model(marts.tac_population_sketch(t.flagged)))
query("vendor_sketch_merge")(lambda t: marts.merged(marts.tac_population_sketch(t.flagged).join(t.devices.select("tac", "vendor"), "tac"), "vendor"))
query("filter_population", ACT + f"""
select dimension, value, {FIGURES} from (
 select a.*, 'deviceType' as dimension, trim(deviceType) as value from act a join dev using (tac) union all select a.*, 'operatingSystem', trim(operatingSystem) from act a join dev using (tac)
 union all select a.*, 'manufacturer', trim(manufacturer) from act a join dev using (tac) union all select a.*, 'vendor', trim(vendor) from act a join dev using (tac)
 union all select a.*, 'knownDevice', 'yes' from act a where tac <> '') where value <> '' group by all""")(lambda t: marts.filter_population(t.flagged, t.devices))
query("kpi", ACT + KPI + "\nselect * from kpi")(lambda t: marts.kpi(t.flagged, t.tac))
LONG = "select {k}, measure, n from (select {k}, bindings, subscribers, handsets from ({q})) unpivot (n for measure in (bindings, subscribers, handsets))"
query("class_mix", ACT + RADIO + "\n" + LONG.format(k="device_class", q=f"select case when a.tac = '' then 'Unknown device' else coalesce(device_class, 'Unregistered TAC') end as device_class, {FIGURES.replace('tac', 'a.tac')} from act a left join radios r on r.tac = a.tac group by 1"))(lambda t: marts.class_mix(t.flagged, t.radio))
query("capability_support", ACT + RADIO + """
select capability, measure, coalesce(sum(n) filter (flag = 1), 0) as supported, coalesce(sum(n) filter (flag = 0), 0) as unsupported, coalesce(sum(n) filter (flag = 2), 0) as unknown from (
 select capability, flag, measure, n from (select capability, flag, count(*) as bindings, count(distinct msisdn) as subscribers, count(distinct imei) as handsets from (""" + " union all ".join(
    f"select '{c}' as capability, coalesce({c}, 2) as flag, a.* from act a left join radios r on r.tac = a.tac where a.tac <> ''" for c in ("lte", "nr", "esim", "ntn")
) + ") group by 1, 2) unpivot (n for measure in (bindings, subscribers, handsets))) group by all")(lambda t: marts.capability_mart(t.flagged, t.radio))
query("dimension_mart", DIM + "\nselect * from dim")(lambda t: marts.dimension_mart(t.flagged, t.devices))
query("verify_marts", DIM + KPI + "\nselect dimension, sum(bindings) as bindings, (select bindings from kpi) as expected, sum(bindings) = (select bindings from kpi) as ok from dim group by 1")(
    lambda t: marts.verify_marts(marts.kpi(t.flagged, t.tac), marts.dimension_mart(t.flagged, t.devices))
)
COUNTED = ",\nwhole as (select count(*) as bindings, count(distinct msisdn) as subscribers, count(distinct imei) as handsets from counted)"


def _top(dimension: str, measure: str, n: int):
    def run(t):
        counted = t.flagged.where("active = 1 and no_handset = 0")
        total = counted.agg(F.count(F.lit(1)).alias("bindings"), F.count_distinct("msisdn").alias("subscribers"), F.count_distinct("imei").alias("handsets"))
        return marts.top_share(marts.dimension_mart(t.flagged, t.devices), dimension, n, measure, total)

    return run, DIM + COUNTED + f"\nselect value, bindings, subscribers, sims, handsets, round(100 * {measure} / (select {measure} from whole), 3) as percent from dim where dimension = '{dimension}' and value <> '(unknown device)' order by {measure} desc, value limit {n}"


for _name, _args in {"top_vendors": ("vendor", "bindings", 10), "top_models": ("model", "handsets", 5), "top_manufacturers": ("manufacturer", "subscribers", 20), "distribution_types": ("deviceType", "bindings", 50), "distribution_systems": ("operatingSystem", "bindings", 50)}.items():
    _run, _sql = _top(*_args)
    query(_name, _sql)(_run)


query("enrichment_split", ACT + KPI + "\nselect bindings - unknown_device - malformed_imei - invalid_imei as with_handset, unknown_device, malformed_imei, invalid_imei, tac_matched, round(100 * tac_matched / bindings, 3) as percent_matched from kpi")(
    lambda t: marts.kpi(t.flagged, t.tac).select((F.col("bindings") - F.col("unknown_device") - F.col("malformed_imei") - F.col("invalid_imei")).alias("with_handset"), "unknown_device", "malformed_imei", "invalid_imei", "tac_matched", F.round(100 * F.col("tac_matched") / F.col("bindings"), 3).alias("percent_matched"))
)
query("flagged_days", DQ + '\nselect data_date, "check", rate from assessed where flagged')(lambda t: daily.assess_feed(t.dq, "2026-02-01", "2026-02-28").where("flagged").select("data_date", "check", "rate"))
_LISTS = ("lte_bands", "nr_bands", "umts_bands", "gsm_bands", "nb_iot_bands", "lte_m_bands", "ntn_bands", "unparsed")
query("parse_radio", RADIO + "\nselect * replace (" + ", ".join(f"array_to_string({c}, ',') as {c}" for c in _LISTS) + ") from radios")(
    lambda t: t.radio.withColumns({c: F.array_join(F.col(c).cast("array<string>"), ",") for c in _LISTS})
)
query("band_rows", ACT + RADIO + "\nselect band, count(*) as bindings, count(distinct msisdn) as subscribers, count(distinct imei) as handsets from (select a.*, unnest(lte_bands) as band from act a join radios r on r.tac = a.tac) group by 1")(
    lambda t: t.flagged.where("active = 1 and no_handset = 0").join(t.radio.select("tac", F.explode("lte_bands").alias("band")), "tac").groupBy("band").agg(F.count(F.lit(1)).alias("bindings"), F.count_distinct("msisdn").alias("subscribers"), F.count_distinct("imei").alias("handsets"))
)
query("model_keys", "\nselect tac, lower(regexp_replace(trim(manufacturer), '\\s+', ' ', 'g')) || '|' || lower(regexp_replace(trim(marketingName), '\\s+', ' ', 'g')) as model_key from tac")(
    lambda t: t.tac.select("tac", model_key(F.col("manufacturer"), F.col("marketingName")).alias("model_key"))
)
query("device_timeline", "\nselect data_date, count(*) filter (label = 'add') as adds, count(*) filter (label = 'remove') as removes from ev where tac = '35100300' group by 1")(
    lambda t: t.events.where("tac = '35100300'").groupBy("data_date").agg(F.count_if(F.col("label") == "add").alias("adds"), F.count_if(F.col("label") == "remove").alias("removes"))
)
query("unregistered_population", ACT + RADIO + "\nselect tac, count(*) as bindings, count(distinct imei) as handsets from act where tac <> '' and tac not in (select tac from radios) group by 1")(
    lambda t: t.flagged.where("active = 1 and no_handset = 0").join(t.radio, "tac", "left_anti").groupBy("tac").agg(F.count(F.lit(1)).alias("bindings"), F.count_distinct("imei").alias("handsets"))
)
query("sim_facts", "\nselect imsi, count(distinct msisdn) as numbers, count(distinct imei) as handsets, sum(active) as active, min(last_change_date) as first, max(last_change_date) as last from cur group by 1")(lambda t: risk.sim_facts(t.state))


@query("search_imsi_prefix", "\nselect p as prefix, msisdn, imsi, imei, active from cur, (select unnest(['4321100000001', '43211000000007']) as p) where cast(imsi as varchar) like p || '%'")
def _(t):
    low, high = imsi_range(F.col("prefix"))
    ranges = t.spark.createDataFrame([("4321100000001",), ("43211000000007",)], "prefix string").select("prefix", low.alias("low"), high.alias("high"))
    return risk.search_imsi(t.state, ranges)


for _kind, _others in {"msisdn": ("imsi", "imei"), "imsi": ("msisdn", "imei"), "imei": ("msisdn", "imsi")}.items():
    query(f"neighbours_{_kind}", "\n" + " union all ".join(f"select {_kind}, '{o}' as neighbour_kind, cast({o} as varchar) as neighbour, count(*) as bindings, sum(active) as active, max(last_change_date) as last_confirmed from cur group by {_kind}, {o}" for o in _others))(lambda t, k=_kind: risk.neighbours(t.state, k))
query("paired_handsets", """,
own as (select distinct c.msisdn, c.imei, c.tac, lower(trim(marketingName)) as name from cur c join tac using (tac) where active = 1 and length(imei) = 14)
select a.msisdn, a.imei, b.imei as partner from own a join own b on a.msisdn = b.msisdn and a.name = b.name
 and ((a.tac = b.tac and cast(substr(b.imei, 9, 6) as int) = cast(substr(a.imei, 9, 6) as int) + 1) or (cast(b.tac as int) = cast(a.tac as int) + 100 and substr(a.imei, 9, 6) = substr(b.imei, 9, 6)))""")(lambda t: risk.paired_handsets(t.state, t.tac))
query("explore_models_with_many_sims", "\nselect imei, count(distinct imsi) as sims, count(*) as n, max(last_change_date) as last from counted where tac like '3510%' group by imei having count(distinct imsi) > 2")(
    lambda t: t.flagged.where("active = 1 and no_handset = 0").where(F.col("tac").startswith("3510")).groupBy("imei").agg(F.count_distinct("imsi").alias("sims"), F.count(F.lit(1)).alias("n"), F.max("last_change_date").alias("last")).where("sims > 2")
)
query("explore_not_equal_keeps_null", "\nselect active, count(*) as n from cur where last_change_date is null or last_change_date <> date '2026-03-01' group by 1")(lambda t: t.state.where(F.col("last_change_date").isNull() | (F.col("last_change_date") != "2026-03-01")).groupBy("active").agg(F.count(F.lit(1)).alias("n")))

ADDS = DQ + """,
adds as (select e.msisdn, e.imsi, e.imei, e.data_date as d, length(e.imei) = 14 and regexp_full_match(e.imei, '[0-9]{14}') and e.imei <> '00000000000000' and not (tail and not known and right(e.imei, 1) = '0') as countable,
 m.imsi is null as alone from evf e left join multi m on m.data_date = e.data_date and m.imsi = e.imsi where label = 'add' and length(e.imei) = 14 and e.data_date between date '2026-04-25' - 29 and date '2026-04-25'),
clean as (select *, countable and alone as clean, datediff('day', d, date '2026-04-25') as age from adds)"""
SIM_WINDOW = ADDS + """,
pair as (select imsi, imei, max(clean) as c30, max(clean and age < 20) as c20, max(clean and age < 7) as c7, max(age < 7) as r7, count(*) as adds, count(*) filter (not clean) as aside from clean group by all),
busy as (select imsi, count(*) as add_days, max(n) as most, arg_max(d, n * 100000 - datediff('day', date '1970-01-01', d)) as day from (select imsi, d, count(distinct imei) as n from clean where clean group by all) group by 1),
top as (select imsi, string_agg(tac, ',' order by n desc, tac) as tacs from (select *, row_number() over (partition by imsi order by n desc, tac) as k from (select imsi, substr(imei, 1, 8) as tac, count(*) as n from pair where c20 group by all)) where k <= 5 group by 1)
select p.imsi, count(*) filter (c30) as imeis_30, count(*) as imeis_30_raw, count(*) filter (c20) as imeis_20, count(distinct substr(imei, 1, 8)) filter (c20) as tacs_20, count(*) filter (c7) as imeis_7,
 count(*) filter (r7) as imeis_7_raw, sum(adds) as adds_30, sum(aside) as adds_set_aside_30, coalesce(any_value(add_days), 0) as add_days_30, coalesce(any_value(most), 0) as max_imeis_one_day_30, any_value(day) as max_day_30, coalesce(any_value(tacs), '') as top_tacs_20
from pair p left join busy using (imsi) left join top using (imsi) group by p.imsi having count(*) >= {floor}"""
query("risk_sim_window", SIM_WINDOW.replace("{floor}", "6"))(lambda t: risk.sim_window(t.events, t.tac, t.multi, AS_OF))
query("risk_imei_lifetime", """,
pair as (select imei, imsi, count(*) as bindings, max(active = 1 and last_change_date is not null) as dated, max(active = 1 and last_change_date is null) as dump from flag where countable = 1 group by all),
num as (select imei, count(distinct msisdn) as numbers from flag where countable = 1 group by 1)
select p.imei, count(*) as sims_ever, sum(bindings) as bindings, count(*) filter (dated) as sims_not_removed_dated, count(*) filter (dump and not dated) as sims_not_removed_dump, any_value(numbers) as numbers_ever
from pair p join num using (imei) group by 1 having count(*) >= 3 or count(*) filter (dated) >= 3""")(lambda t: risk.imei_lifetime(t.flagged, floor=3))
query("risk_distribution", SIM_WINDOW.replace("{floor}", "1").replace("select p.imsi,", ",\nw as (select p.imsi,", 1) + ")\nselect e as edge, count(*) as n from w, (select unnest([1, 2, 5, 10, 20]) as e) where imeis_30 >= e group by 1")(lambda t: risk.risk_distribution(risk.sim_window(t.events, t.tac, t.multi, AS_OF, floor=1), "imeis_30", [1, 2, 5, 10, 20]))
query("number_changes", DQ + EVIDENCE + "\nselect msisdn, count(*) filter (set_aside = 'none') as clean, count(*) as raw from evidence where data_date between date '2026-04-25' - 6 and date '2026-04-25' group by 1")(
    lambda t: risk.number_changes(t.evidence, AS_OF)
)
STAGE = RADIO + """,
stage as (select msisdn, imei, min(f.tac) as tac, min(case when shifted = 1 then 5 when no_handset = 1 or not regexp_full_match(imei, '[0-9]*') then 6 when r.tac is null then 7 else sunset end) as state, min(coalesce(esim, 2)) as esim,
 max(coalesce(umts, 0)) as umts, max(case when device_class = 'IoT / M2M' then 1 else 0 end) as iot, count(*) as bindings from flag f left join radios r on r.tac = f.tac where active = 1 group by all),
asks as (select msisdn, imei, unnest([concat(substr(imei, 1, 8), lpad(cast(cast(substr(imei, 9, 6) as int) + 1 as varchar), 6, '0')), concat(substr(imei, 1, 8), lpad(cast(cast(substr(imei, 9, 6) as int) - 1 as varchar), 6, '0')),
 concat(lpad(cast(cast(substr(imei, 1, 8) as int) + 100 as varchar), 8, '0'), substr(imei, 9, 6)), concat(lpad(cast(cast(substr(imei, 1, 8) as int) - 100 as varchar), 8, '0'), substr(imei, 9, 6))]) as partner from stage where state in (0, 7)),
found as (select a.msisdn, a.imei, min(state) as p_state, case when max(case when esim = 1 then 1 else 0 end) = 1 then 1 else min(esim) end as p_esim, max(umts) as p_umts, max(iot) as p_iot
 from asks a join stage k on k.msisdn = a.msisdn and k.imei = a.partner and k.state in (1, 2, 3) group by all),
used as (select s.msisdn, s.imei, coalesce(p_state, state) as st, state not in (5, 6) as asked, coalesce(p_esim, esim) as es, coalesce(p_iot, iot) as iot, coalesce(p_umts, umts) as umts, bindings, p_state is not null as paired
 from stage s left join found using (msisdn, imei)),
sums as (select msisdn, list(distinct st) as st, coalesce(list(distinct es) filter (asked), []) as es, max(iot) as iot, max(umts) as umts, count(*) as handsets, sum(bindings) as bindings, count(*) filter (paired) as paired from used group by 1),
classed as (select *, case when list_contains(st, 1) then 1 when list_contains(st, 2) then 2 when list_contains(st, 0) or list_contains(st, 7) then 4 when list_contains(st, 3) then 3 else 4 end as sunset from sums),
numbers as (select msisdn, sunset, case when sunset <> 4 then 0 when list_contains(st, 7) then 3 when list_contains(st, 0) then 4 when list_contains(st, 5) then 1 else 2 end as reason,
 case when list_contains(es, 1) then 1 when list_contains(es, 2) or len(es) = 0 then 2 else 0 end as esim, iot, case when sunset = 3 and umts = 0 then 1 else 0 end as gsm_only, handsets, bindings, paired from classed)"""
query("handset_stage", STAGE + "\nselect * from stage")(lambda t: planning.handset_stage(t.flagged, t.radio))
query("number_class", STAGE + "\nselect * from numbers")(lambda t: planning.number_class(planning.handset_stage(t.flagged, t.radio)))


@query("planning_breakdown", STAGE + "\nselect sunset, s.tac, count(distinct msisdn) as numbers, sum(s.bindings) as bindings, count(distinct imei) as handsets from stage s join numbers n using (msisdn) group by all")
def _(t):
    stage = planning.handset_stage(t.flagged, t.radio)
    return planning.breakdown(stage, planning.number_class(stage))


for _most in (64, 2):
    query(f"number_models_{_most}", STAGE + f"\nselect msisdn, array_to_string(list_sort(list(distinct tac))[1:{_most}], ',') as models, count(distinct tac) as n_models from stage where tac <> '' group by 1")(
        lambda t, n=_most: planning.number_models(planning.handset_stage(t.flagged, t.radio), n).select("msisdn", F.array_join("models", ",").alias("models"), "n_models")
    )


@query("planning_class_summary", STAGE + """,
cells as (select msisdn, 'sunset' as measure, sunset as class, reason, bindings from numbers union all select msisdn, 'esim', esim, 0, bindings from numbers),
held as (select measure, class, reason, count(distinct imei) as handsets from cells join (select msisdn, imei from stage) using (msisdn) group by all)
select measure, class, reason, count(*) as numbers, cast(sum(bindings) as bigint) as bindings, any_value(handsets) as handsets from cells join held using (measure, class, reason) group by all""")
def _(t):
    stage = planning.handset_stage(t.flagged, t.radio)
    return planning.class_summary(planning.number_class(stage), stage)


query("planning_summary", STAGE + "\nselect sunset, reason, esim, count(*) as numbers, sum(iot) as iot, sum(gsm_only) as gsm_only from numbers group by all")(lambda t: planning.summary(planning.number_class(planning.handset_stage(t.flagged, t.radio))))
SPELL = """,
now as (select msisdn, imei, max(active) as held, max(last_change_date) as last from flag where countable = 1 group by all),
begun as (select msisdn, imei, min(data_date) as first from ev where label = 'add' group by all), dumped as (select distinct msisdn, imei from snapshot),
spell0 as (select n.msisdn, n.imei, case when d.imei is not null then date '2026-01-25' else first end as start, case when held = 0 then last end as finish, case when d.imei is not null then 1 else 0 end as dump
 from now n left join begun b using (msisdn, imei) left join dumped d using (msisdn, imei)),
spell as (select * from spell0 where start is not null and datediff('day', start, coalesce(finish, date '2026-04-25')) >= 7)"""
SPELLS = SPELL + """,
few as (select * from (select *, count(*) over (partition by msisdn) as n from spell) where n <= 40),
twins as (select distinct a.msisdn, a.imei from few a join few b on a.msisdn = b.msisdn and (b.imei = concat(substr(a.imei, 1, 8), lpad(cast(cast(substr(a.imei, 9, 6) as int) - 1 as varchar), 6, '0'))
 or b.imei = concat(lpad(cast(cast(substr(a.imei, 1, 8) as int) - 100 as varchar), 8, '0'), substr(a.imei, 9, 6)))),
alone as (select * from few anti join twins using (msisdn, imei)),
heavy as (select msisdn from spell group by 1 having count(*) > 40 union select msisdn from alone group by 1 having count(*) > 20),
kept as (select * from alone anti join heavy using (msisdn)),
succ as (select msisdn, imei, next_start, next_imei from (select a.msisdn, a.imei, b.start as next_start, b.imei as next_imei, row_number() over (partition by a.msisdn, a.imei order by b.start, b.imei) as k
 from kept a join kept b on a.msisdn = b.msisdn and b.start > a.start and datediff('day', a.finish, b.start) between -7 and 30 where a.finish is not null) where k = 1),
tenure as (select k.msisdn, k.imei, case when finish is null then 3 when next_imei is not null then 1 else 2 end as outcome, greatest(datediff('day', start, coalesce(next_start, finish, date '2026-04-25')), 0) as days,
 case when dump = 1 then 0 else cast(strftime(start, '%Y%m') as int) end as cohort,
  case when finish is not null and next_imei is not null then cast(strftime(next_start, '%Y%m') as int) else 0 end as month, next_imei from kept k left join succ using (msisdn, imei)
 union all select msisdn, null, 4, 0, 0, 0, null from heavy)"""
spells_of = lambda t: planning.spells(t.events, t.snapshot, t.flagged, AS_OF)
query("spells", SPELL + "\nselect * from spell")(spells_of)
query("spell_events", SPELLS + "\nselect * from tenure")(lambda t: planning.spell_events(spells_of(t), AS_OF))
query("survival", SPELLS + """,
days as (select cohort, days, count(*) filter (outcome = 1) as events, count(*) as ended from tenure where outcome <> 4 group by all),
risk as (select *, sum(ended) over (partition by cohort order by days desc) as at_risk from days),
km as (select *, max(case when events = at_risk then 1 else 0 end) over w as dead, exp(sum(ln(case when events < at_risk then 1 - events / at_risk else 1.0 end)) over w) as p from risk window w as (partition by cohort order by days))
select cohort, days, events, at_risk, round(case when dead = 1 then 0.0 else p end, 6) as share from km where events > 0""")(lambda t: planning.survival(planning.spell_events(spells_of(t), AS_OF)))
query("profile_feed", "\nselect label, count(*) as n, count(distinct msisdn) as numbers, count(distinct imsi) as sims, count(distinct imei) as imeis, min(length(imei)) as shortest, max(length(imei)) as longest from ev group by 1")(
    lambda t: t.events.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("msisdn").alias("numbers"), F.count_distinct("imsi").alias("sims"), F.count_distinct("imei").alias("imeis"), F.min(F.length("imei")).alias("shortest"), F.max(F.length("imei")).alias("longest"))
)
query("imeis_per_number", "\nselect k, count(*) as numbers from (select msisdn, count(distinct imei) as k from cur where active = 1 group by 1) group by 1")(
    lambda t: t.state.where("active = 1").groupBy("msisdn", "imei").agg(F.lit(1).alias("one")).groupBy("msisdn").agg(F.count("one").alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("numbers"))
)
query("catalogue_coverage", "\nselect known, count(*) as bindings, count(distinct tac) as tacs from flag where active = 1 group by 1")(lambda t: t.flagged.where("active = 1").groupBy("known").agg(F.count(F.lit(1)).alias("bindings"), F.count_distinct("tac").alias("tacs")))
query("membership", "\nselect label, s.imei is not null as in_dump, count(*) as n from ev left join snapshot s using (msisdn, imsi, imei) group by 1, 2")(
    lambda t: t.events.join(t.snapshot.withColumn("s", F.lit(True)), ["msisdn", "imsi", "imei"], "left").groupBy("label", F.col("s").isNotNull().alias("in_dump")).agg(F.count(F.lit(1)).alias("n"))
)
