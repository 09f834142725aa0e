"""The binding feed: initial dump, daily events, device catalogue and vendor map.

``derived`` builds the feed from the order tables, so that every query's work grows with them:
a customer is a number, an order line an event, a part a device model. One order in five belongs to
the initial dump. Defects (unknown, short, shifted and unassigned identifiers, SIMs under several
numbers) come from part keys. Four customers share models and five a SIM, so models, handsets and
SIMs grow with the customers; one part in 23 is missing from the catalogue.

``stored`` keeps feed and folded state as Parquet in the shared folder, once a session and table
folder: the log and the current state that every later question reads.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindwell.sources.store import kept

KEY = ["msisdn", "imsi", "imei"]
FIRST_DAY = "2026-01-26"
LAST_DAY = "2026-04-25"
LAST_SEQ = 90
#: The first model's TAC, and how many models there is room for up to the last of eight digits.
FIRST_TAC = 35_100_000
MODELS = 100_000_000 - FIRST_TAC
#: What the catalogue's columns say, by part key.
DEVICE_TYPES = ("Smartphone", "Smartphone", "Mobile Phone/Feature phone", "Tablet", "IoT Device", "Handheld", "Modem", "e-Book", "Wearable", "Vehicle", "Smartphone")
SYSTEMS = (" Android ", "Android", "", "iOS")
REMOVABLE = ("0", "1", "00")
NONREMOVABLE = ("0", "00", "0", "2", "00")
NTN = ("3GPP NTN & TN(GSO)", "No", "Not Known", "Not Known", "3GPP NTN Only (GSO, NGSO)", "no", "Not Known")
BANDS = (
    "5G NR: n1, n78 | 4G: LTE FDD BAND 1, LTE FDD Band 3 | 2G/3G: GSM 900",
    "4G: LTE FDD BAND 3, LTE TDD BAND 40 | 2G/3G: GSM850 (GSM800),WCDMA FDD Band 1",
    "2G/3G: GSM 900,GSM 1800 | Radio Interface: NONE",
    "LPWAN: Cat-NB1,Cat-M1,Cat-NB-LTEFDD LTE FDD BAND 20 | 2G/3G: GSM 900",
    "Radio Interface: NONE",
    "5G NR: n78 | 5G DC BC EN-DC FR1 2B: DC_1A_n78A | 5G NA Options: 5G-2Series,5G-5Series | 4G: LTE FDD BAND 7 | 4G Cat: LTE 12",
    "2G/3G: GSM 900,WCDMA TDD Band A,LTE FDD BAND 61,odd radio | NTN: E-UTRA B255,NR FR1 n256",
    "Radio Interface: CDMA2000/EDGE, Bluetooth, 2.4-2.5 GHz",
    "5G REDCAP: n5 | LPWAN: EC-GSM-IoT | SATELLITE: L-Band | Strange: x",
    "LPWAN: EC-GSM-IoT | Radio Interface: Inmarsat, 802.11b",
    "",
)


@dataclass
class Feed:
    """Event log, dump, active catalogue and vendor map."""

    events: DataFrame
    snapshot: DataFrame
    tac: DataFrame
    vendors: DataFrame


def tac_of(imei) -> F.Column:
    """First eight digits of a 14-digit IMEI, else the empty string."""
    return F.when(F.length(imei) == 14, F.substring(imei, 1, 8)).otherwise(F.lit(""))


def derived(spark: SparkSession, sf_dir: str) -> Feed:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_shipdate")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    part, cust = F.col("l_partkey"), F.col("o_custkey")
    model = (FIRST_TAC + (F.floor(cust / 4) + part % 12 * 100) % MODELS).cast("string")
    serial = F.lpad((cust % 999000 + F.when(part % 24 >= 12, 1).otherwise(0)).cast("string"), 6, "0")
    imei14 = F.concat(model, serial)
    removed = F.col("l_returnflag") == "R"
    day_no = (F.datediff(F.col("l_shipdate").cast("date"), F.lit("1995-01-01").cast("date")) % 90).cast("int")
    raw = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "l_orderkey",
        (9120000000 + cust).cast("long").alias("msisdn"),
        (432110000000000 + F.when(part % 71 == 0, (cust - cust % 5) * 2).otherwise(cust * 2 + F.col("l_suppkey") % 2)).cast("long").alias("imsi"),
        F.when(part % 53 == 0, F.lit("000000"))
        .when(part % 59 == 0, F.substring(imei14, 1, 10))
        .when(part % 61 == 0, F.concat(F.substring(imei14, 2, 13), F.lit("0")))
        .when(part % 67 == 0, F.concat(F.lit("77"), F.substring(imei14, 3, 12)))
        .otherwise(imei14)
        .alias("imei"),
        F.when(removed, "remove").otherwise("add").alias("label"),
        day_no.alias("day_no"),
        ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 2 + F.when(removed, 1).otherwise(0)).alias("ord"),
    )
    events = (
        raw.where(F.col("l_orderkey") % 5 != 0)
        .groupBy(*KEY, "day_no")
        .agg(F.max("ord").alias("ord"))  # its last bit says the label
        .withColumn("label", F.when(F.col("ord").bitwiseAND(F.lit(1)) == 1, "remove").when(F.col("ord").isNotNull(), "add"))
        .select((F.col("day_no") + 1).alias("seq"), F.date_add(F.lit(FIRST_DAY).cast("date"), F.col("day_no")).alias("data_date"), *KEY, tac_of("imei").alias("tac"), "label")
    )
    snapshot = raw.where(F.col("l_orderkey") % 5 == 0).select(*KEY).distinct()
    return Feed(events, snapshot, catalogue(spark, sf_dir), vendor_map(spark))


def stored(spark: SparkSession, sf_dir: str) -> Feed:
    """The feed, its log and dump as tables."""
    feed = derived(spark, sf_dir)
    feed.events = kept(spark, sf_dir, "events", lambda: feed.events)
    feed.snapshot = kept(spark, sf_dir, "snapshot", lambda: feed.snapshot)
    return feed


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The device catalogue: twelve columns a model, one row for each part but one in 23; eight digits have room for ``MODELS`` (64.9 million) of them."""
    p = F.col("p_partkey")
    text = lambda cases: F.element_at(F.array(*map(F.lit, cases)), (p % len(cases) + 1).cast("int"))
    return (
        spark.read.parquet(f"{sf_dir}/part.parquet")
        .where((p % 23 != 0) & (p < MODELS))
        .select(
            (FIRST_TAC + p).cast("string").alias("tac"),
            F.when((p % 50).isin(3, 9), "Maker A Korea").when(p % 50 == 4, "Maker A Vietnam").otherwise(F.col("p_brand")).alias("manufacturer"),
            F.col("p_brand").alias("brandName"),
            F.concat(F.lit("M"), p.cast("string")).alias("modelName"),
            F.when((p % 50).isin(6, 7), F.concat(F.lit("twin phone "), (p % 50).cast("string"))).otherwise(F.col("p_name")).alias("marketingName"),
            text(DEVICE_TYPES).alias("deviceType"),
            text(SYSTEMS).alias("operatingSystem"),
            text(REMOVABLE).alias("removableEUICC"),
            text(NONREMOVABLE).alias("nonremovableEUICC"),
            text(NTN).alias("ntnConnectivity"),
            F.concat(F.lit("0"), (1 + p % 9).cast("string"), F.lit("-Jan-20"), (10 + p % 16).cast("string")).alias("allocationDate"),
            text(BANDS).alias("bandDetails"),
        )
    )


def vendor_map(spark: SparkSession) -> DataFrame:
    """Raw maker spellings and the vendor each stands for."""
    return spark.createDataFrame([("Maker A Korea", "Maker A"), ("Maker A Vietnam", "Maker A")], "raw_manufacturer string, vendor_canonical string")


#: The same feed as DuckDB common table expressions; ``cur`` is the folded state, ``flag`` the state with catalogue flags.
ORACLE = """
raw as (
 select o.o_custkey, l.l_orderkey, l.l_partkey,
  cast(9120000000 + o.o_custkey as bigint) as msisdn,
  cast(432110000000000 + case when l.l_partkey % 71 = 0 then (o.o_custkey - o.o_custkey % 5) * 2 else o.o_custkey * 2 + (l.l_suppkey % 2) end as bigint) as imsi,
  concat(cast(35100000 + (o.o_custkey // 4 + (l.l_partkey % 12) * 100) % 64900000 as varchar),
         lpad(cast(o.o_custkey % 999000 + case when l.l_partkey % 24 >= 12 then 1 else 0 end as varchar), 6, '0')) as imei14,
  case when l.l_returnflag = 'R' then 'remove' else 'add' end as label,
  cast(datediff('day', date '1995-01-01', cast(l.l_shipdate as date)) % 90 as int) as day_no,
  (l.l_orderkey * 8 + l.l_linenumber) * 2 + case when l.l_returnflag = 'R' then 1 else 0 end as ord
 from lineitem l join orders o on l.l_orderkey = o.o_orderkey),
dirty as (
 select *, case when l_partkey % 53 = 0 then '000000'
                when l_partkey % 59 = 0 then substr(imei14, 1, 10)
                when l_partkey % 61 = 0 then concat(substr(imei14, 2), '0')
                when l_partkey % 67 = 0 then concat('77', substr(imei14, 3))
                else imei14 end as imei from raw),
ev as (
 select msisdn, imsi, imei, date '2026-01-26' + day_no as data_date, day_no + 1 as seq, arg_max(label, ord) as label,
  case when length(imei) = 14 then substr(imei, 1, 8) else '' end as tac
 from dirty where l_orderkey % 5 <> 0 group by msisdn, imsi, imei, day_no),
snapshot as (select distinct msisdn, imsi, imei from dirty where l_orderkey % 5 = 0),
tac as (
 select cast(35100000 + p_partkey as varchar) as tac,
  case when p_partkey % 50 in (3, 9) then 'Maker A Korea' when p_partkey % 50 = 4 then 'Maker A Vietnam' else p_brand end as manufacturer,
  p_brand as brandName, concat('M', cast(p_partkey as varchar)) as modelName,
  case when p_partkey % 50 in (6, 7) then concat('twin phone ', p_partkey % 50) else p_name end as marketingName,
  {types} as deviceType, {systems} as operatingSystem, {removable} as removableEUICC, {nonremovable} as nonremovableEUICC, {ntn} as ntnConnectivity,
  concat('0', cast(1 + p_partkey % 9 as varchar), '-Jan-20', cast(10 + p_partkey % 16 as varchar)) as allocationDate, {bands} as bandDetails
 from part where p_partkey % 23 <> 0 and p_partkey < 64900000),
vendor_map as (select 'Maker A Korea' as raw_manufacturer, 'Maker A' as vendor_canonical union all select 'Maker A Vietnam', 'Maker A'),
cur as (
 select msisdn, imsi, imei, case when arg_max(label, seq) = 'add' then 1 else 0 end as active, max(seq) as last_change_seq,
  case when max(seq) = 0 then null else date '2026-01-25' + max(seq) end as last_change_date,
  case when length(imei) = 14 then substr(imei, 1, 8) else '' end as tac
 from (select msisdn, imsi, imei, label, seq from ev union all select msisdn, imsi, imei, 'add', 0 from snapshot) u
 group by msisdn, imsi, imei),
flag as (
 select c.*, case when k.tac is not null then 1 else 0 end as known,
  case when s.t7 is not null and k.tac is null and length(imei) = 14 and right(imei, 1) = '0' then 1 else 0 end as shifted,
  case when length(imei) <> 14 or (k.tac is null and (c.tac = '00000000' or substr(c.tac, 1, 2) not in ({bodies}) or (right(imei, 1) = '0' and s.t7 is not null))) then 1 else 0 end as no_handset,
  case when length(imei) = 14 and regexp_full_match(imei, '[0-9]{{14}}') and imei <> '00000000000000'
        and not (s.t7 is not null and k.tac is null and right(imei, 1) = '0') then 1 else 0 end as countable
 from cur c left join tac k on k.tac = c.tac
 left join (select distinct substr(tac, 2, 7) as t7 from tac) s on s.t7 = substr(imei, 1, 7)),
counted as (select * from flag where active = 1 and no_handset = 0),
dev as (select k.*, coalesce(nullif(v.vendor_canonical, ''), nullif(k.manufacturer, ''), '(unknown TAC)') as vendor
 from tac k left join vendor_map v on v.raw_manufacturer = k.manufacturer)"""


def _case(values: tuple[str, ...]) -> str:
    return f"case p_partkey % {len(values)} " + " ".join(f"when {k} then '{v}'" for k, v in enumerate(values)) + " end"


def oracle(bodies: tuple[str, ...]) -> str:
    """``ORACLE`` with the catalogue's texts and the reporting bodies in it."""
    texts = {"types": DEVICE_TYPES, "systems": SYSTEMS, "removable": REMOVABLE, "nonremovable": NONREMOVABLE, "ntn": NTN, "bands": BANDS}
    return ORACLE.format(bodies=", ".join(f"'{b}'" for b in bodies), **{k: _case(v) for k, v in texts.items()})
