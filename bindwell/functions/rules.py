"""Column rules for identifiers, and the handset flags of a binding table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The reporting bodies whose two digits may begin a TAC.
REPORTING_BODIES = ("00", "01", "10", "30", "33", "35", "44", "45", "49", "50", "51", "52", "53", "54", "86", "91", "98", "99")
UNKNOWN_IMEI = "000000"
#: Models up to which a look-up in the catalogue may be broadcast (about 100 MB a look-up); a larger one is merged, as its
#: hash table would stand whole beside every task.
MOST_BROADCAST = 1_000_000


def look_ups(tac: DataFrame, *tables: DataFrame) -> list[DataFrame]:
    """Tables with a row a model of ``tac``, to be joined: the optimiser broadcasts small ones, and judges by a file's bytes."""
    many = tac.count() > MOST_BROADCAST
    return [table.hint("merge") if many else table for table in tables]


def _looked_up(df: DataFrame, key: Column, values: DataFrame, digits: int, others: int, name: str) -> DataFrame:
    """``df`` with ``name``: whether ``key`` is one of ``values`` (column ``v``), of which ``others`` are not numbers of ``digits`` digits.

    Numbers are looked up as bits of a map, 64 to a row, so the map has no more rows than digits allow (1.6 million for eight)
    and ``df`` is not shuffled, however many values there are. Other texts are joined as they are.
    """
    number = lambda c: F.when((c.try_cast("long") >= 0) & (F.lpad(c.try_cast("long").cast("string"), digits, "0") == c), c.try_cast("long"))
    n = values.select(number(F.col("v")).alias("n")).where("n is not null")
    bits = n.groupBy(F.expr("n div 64").alias("_row")).agg(F.expr("bit_or(shiftleft(1L, cast(n % 64 as int)))").alias("_bits"))
    out = df.withColumn("_n", number(key)).withColumn("_row", F.expr("_n div 64")).join(F.broadcast(bits), "_row", "left")
    found = F.coalesce(F.expr("getbit(_bits, cast(_n % 64 as int)) = 1"), F.lit(False))
    if others:
        texts = values.where(number(F.col("v")).isNull() & F.col("v").isNotNull()).distinct().withColumnRenamed("v", "_text")
        out = out.join(F.broadcast(texts) if others <= MOST_BROADCAST else texts.hint("merge"), key == F.col("_text"), "left")
        found = found | F.col("_text").isNotNull()
    return out.withColumn(name, found).select(*df.columns, name)


def flag_handsets(df: DataFrame, tac: DataFrame) -> DataFrame:
    """Adds known, shifted, no_handset and countable (0/1) to a table with ``imei`` and ``tac``.

    What the catalogue holds is looked up in two maps of bits, of its TACs and of their last seven digits.
    """
    tail = F.substring("tac", 2, 7)
    odd = tac.agg(F.count_if(~F.col("tac").rlike(r"^[0-9]{8}\z")).alias("tacs"), F.count_if(~tail.rlike(r"^[0-9]{7}\z")).alias("tails")).first()
    named = _looked_up(df, F.col("tac"), tac.select(F.col("tac").alias("v")), 8, odd["tacs"], "_known")
    joined = _looked_up(named, F.substring("imei", 1, 7), tac.select(tail.alias("v")), 7, odd["tails"], "_tail")
    whole = F.length("imei") == 14
    known_tac = F.col("_known")
    lost_digit = ~known_tac & F.col("imei").endswith("0") & F.col("_tail")
    shifted = whole & lost_digit
    unassigned = (F.col("tac") == "00000000") | ~F.substring("tac", 1, 2).isin(*REPORTING_BODIES) | lost_digit
    digits = F.col("imei").rlike("^[0-9]{14}$")
    return joined.select(
        *df.columns,
        known_tac.cast("int").alias("known"),
        shifted.cast("int").alias("shifted"),
        (~whole | (~known_tac & unassigned)).cast("int").alias("no_handset"),
        (digits & (F.col("imei") != "0" * 14) & ~shifted).cast("int").alias("countable"),
    )


def countable_rows(df: DataFrame, tac: DataFrame) -> DataFrame:
    """The rows of a table with ``imei`` and ``tac`` that ``flag_handsets`` calls countable.

    An IMEI that ends in another digit than 0 has lost none, so only the rest is looked up in the catalogue.
    """
    whole = df.where(F.col("imei").rlike("^[0-9]{14}$") & (F.col("imei") != "0" * 14))
    doubtful = F.col("imei").endswith("0")
    found = flag_handsets(whole.where(doubtful), tac).where("countable = 1").select(*df.columns)
    return whole.where(~doubtful).unionByName(found)


def counted_tac() -> Column:
    """The TAC under which a flagged row is counted: empty where no handset could carry it."""
    return F.when(F.col("no_handset") == 1, F.lit("")).otherwise(F.col("tac"))


def normal_number(col: Column) -> Column:
    """A phone number in its national form: separators, 00, country code and trunk zero dropped. Null with any other sign."""
    text = col.cast("string")
    digits = F.regexp_replace(text, r"[+ \-.()\u00a0\t]", "")
    digits = F.when((F.length(digits) > 2) & digits.startswith("00"), F.regexp_replace(digits, "^00", "")).otherwise(digits)
    home = digits.startswith("98") & ((F.length(digits) == 12) | ((F.length(digits) == 13) & (F.substring(digits, 3, 1) == "0")))
    digits = F.when(home, F.regexp_replace(digits, "^98", "")).otherwise(digits)
    return F.when(digits.rlike("^[0-9]+$"), F.when((F.length(digits) > 1) & digits.startswith("0"), F.regexp_replace(digits, "^0", "")).otherwise(digits))


def imsi_of_iccid(iccid: Column) -> Column:
    """The SIM number that a card number of this numbering was made from."""
    fits = iccid.rlike("^8998[0-9]{4}000[0-9]{8}$")
    return F.when(fits, F.concat(F.lit("432"), F.substring(iccid, 5, 4), F.substring(iccid, 12, 8)))


def imei_quality(imei: Column) -> Column:
    return F.when(imei.rlike("^[0-9]{14}$"), "well_formed").when(imei == UNKNOWN_IMEI, "unknown").otherwise("malformed")


def enrich_identifiers(df: DataFrame) -> DataFrame:
    """Distinct SIM and handset columns of a binding table, with what their digits say."""
    imsi = F.col("imsi").cast("string")
    return df.select(
        "msisdn", "imsi", "imei",
        F.length(imsi).alias("imsi_digits"),
        F.substring(imsi, 1, 5).alias("network"),
        (F.length(imsi) == 15).alias("imsi_well_formed"),
        imei_quality(F.col("imei")).alias("imei_quality"),
        F.when(F.length(imsi) == 15, F.concat(F.lit("8998"), F.substring(imsi, 4, 4), F.lit("000"), F.substring(imsi, 8, 8))).alias("iccid"),
    )


def mask(col: Column, first: int, last: int) -> Column:
    """All but the first and last characters as stars; short values are all stars."""
    text = col.cast("string")
    hidden = F.length(text) - first - last
    masked = F.concat(F.substring(text, 1, first), F.repeat(F.lit("*"), hidden.cast("int")), F.substring(text, -last, last) if last else F.lit(""))
    return F.when(hidden > 0, masked).otherwise(F.repeat(F.lit("*"), F.length(text)))


def mask_table(df: DataFrame) -> DataFrame:
    """Numbers 3 + 2, SIMs 5 + 4, cards 6 + 4, handsets to their TAC."""
    rules = {"msisdn": (3, 2), "imsi": (5, 4), "imei": (8, 0), "iccid": (6, 4)}
    return df.select([mask(F.col(c), *rules[c]).alias(c) if c in rules else F.col(c) for c in df.columns])


def term_kind(term: Column) -> Column:
    """What a search term of digits can be by its length; other text is a name."""
    size = F.length(term)
    return (
        F.when(~term.rlike("^[0-9]+$"), "text")
        .when(size == 8, "tac")
        .when((size == 10) | (size == 11) | (size == 12), "msisdn")
        .when(size == 14, "imei")
        .when(size == 15, "imsi")
        .otherwise("unknown")
    )


def imsi_range(prefix: Column) -> tuple[Column, Column]:
    """The smallest and largest SIM number with a prefix of 10 to 15 digits."""
    spare = F.lit(15) - F.length(prefix)
    unit = F.pow(F.lit(10), spare).cast("long")
    low = prefix.cast("long") * unit
    return low, low + unit - 1


def model_key(maker: Column, name: Column) -> Column:
    """Maker and name, trimmed, spaces collapsed, lower case."""
    tidy = lambda c: F.lower(F.regexp_replace(F.trim(c), r"\s+", " "))
    return F.concat_ws("|", tidy(maker), tidy(name))
