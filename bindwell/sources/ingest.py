"""Files in and out: dump, daily deltas, catalogue; validation, headers, ledgers and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bindwell.sources.feed import KEY, tac_of

DUMP = "imei string, imsi long, msisdn long"
DELTA = "msisdn long, imsi long, imei string, label string"
#: A file with a larger share of rejected rows is quarantined.
QUARANTINE_SHARE = 0.05


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """The initial dump, columns by name."""
    return spark.read.csv(path, header=True, schema=DUMP, mode="FAILFAST").select(*KEY)


def business_date(name: Column) -> Column:
    """The day in a file's name, yyyyMMdd or yyyy-MM-dd; null without one."""
    digits = F.regexp_replace(F.regexp_extract(name, r"(\d{4}-?\d{2}-?\d{2})", 1), "-", "")
    return F.try_to_date(digits, "yyyyMMdd") if hasattr(F, "try_to_date") else F.to_date(F.try_to_timestamp(digits, F.lit("yyyyMMdd")))


def read_days(spark: SparkSession, path: str) -> DataFrame:
    """Daily files of a folder in one job, each row with the day in its file's name."""
    rows = spark.read.csv(path, header=True, schema=DELTA, mode="FAILFAST")
    return rows.select(business_date(F.col("_metadata.file_name")).alias("data_date"), *KEY, tac_of("imei").alias("tac"), "label")


def assign_sequence(log: DataFrame, days: DataFrame) -> DataFrame:
    """Sequence numbers of arriving days: a loaded date keeps its own, new ones go on from the largest.

    One row a day meets in the window, however many events the days hold.
    """
    loaded = log.groupBy("data_date").agg(F.max("seq").alias("seq"))
    fresh = days.select("data_date").distinct().join(loaded, "data_date", "left_anti")
    last = loaded.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("last"))
    numbered = fresh.crossJoin(F.broadcast(last)).select("data_date", (F.col("last") + F.row_number().over(Window.orderBy("data_date"))).cast("int").alias("seq"))
    return days.join(numbered.unionByName(loaded), "data_date")


def backfill_days(log: DataFrame, days: DataFrame, start: str, end: str) -> DataFrame:
    """The days of a range that are not loaded yet."""
    return days.where(F.col("data_date").between(start, end)).join(log.select("data_date").distinct(), "data_date", "left_anti")


def replace_days(log_path: str, days: DataFrame) -> None:
    """Write days over what the log holds of them, and nothing else (dynamic partition overwrite)."""
    days.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("data_date").parquet(log_path)


def replaced_keys(log: DataFrame, days: DataFrame) -> DataFrame:
    """Bindings that the log holds on days which are about to be replaced: they are folded again, also where the new day lacks them."""
    return log.join(days.select("data_date").distinct(), "data_date", "left_semi").select(*KEY).distinct()


def reconcile_days(log: DataFrame, accepted: DataFrame) -> DataFrame:
    """For each day the rows that were accepted and stored, and whether it is kept. A day whose numbers differ must not be published."""
    count = lambda df, name: df.groupBy("data_date").agg(F.count(F.lit(1)).alias(name))
    both = count(accepted, "accepted").join(count(log, "stored"), "data_date", "full_outer").fillna(0, ["accepted", "stored"])
    return both.withColumn("kept", F.col("accepted") == F.col("stored"))


# Rules in order, and the severity of each; rows with info and warnings alone are kept.
SEVERITIES = {
    "msisdn_not_numeric": "quarantine", "msisdn_length": "quarantine", "imsi_not_numeric": "quarantine", "imsi_length": "quarantine", "imei_not_numeric": "quarantine", "imei_unknown": "info",
    "imei_length": "warning", "label_unknown": "reject", "field_count": "quarantine",
}
_RANK = {"info": 1, "warning": 2, "quarantine": 3, "reject": 4}


def classify_rows(lines: DataFrame) -> DataFrame:
    """Every raw delta line (``value``) with the rules it breaks, its gravest severity and whether it can be loaded."""
    f = F.split("value", ",", -1)
    part = lambda k: F.trim(F.coalesce(F.get(f, F.lit(k)), F.lit("")))
    shape = F.size(f) == 4
    digits = lambda c: c.rlike("^[0-9]+$")
    tests = {
        "msisdn_not_numeric": ~digits(part(0)), "msisdn_length": digits(part(0)) & (F.length(part(0)) != 10), "imsi_not_numeric": ~digits(part(1)), "imsi_length": digits(part(1)) & (F.length(part(1)) != 15),
        "imei_not_numeric": ~digits(part(2)), "imei_unknown": part(2) == "000000", "imei_length": digits(part(2)) & (part(2) != "000000") & (F.length(part(2)) != 14), "label_unknown": ~F.lower(part(3)).isin("add", "remove"),
    }
    broken = [F.when(shape & test, F.lit(name)) for name, test in tests.items()] + [F.when(~shape, F.lit("field_count"))]
    rank = F.create_map(*(x for name, level in SEVERITIES.items() for x in (F.lit(name), F.lit(_RANK[level]))))
    judged = lines.select("value", F.array_compact(F.array(*broken)).alias("rules"))
    worst = F.coalesce(F.array_max(F.transform("rules", lambda r: F.element_at(rank, r))), F.lit(0))
    name = F.element_at(F.array(*(F.lit(x) for x in ("ok", *_RANK))), worst + 1)
    return judged.select("value", F.array_join("rules", ",").alias("rules"), name.alias("severity"), (worst <= _RANK["warning"]).alias("loadable"))


def scan_catalogue(lines: DataFrame, fields: int) -> DataFrame:
    """The structure of a catalogue file's records (``value``; one a line, quoted fields may hold commas): records, those with a
    wrong number of fields, TACs that stand more than once and their records, and the verdict."""
    width = F.size(F.split(F.regexp_replace("value", '"[^"]*"', "q"), ",", -1))
    tac = F.regexp_replace(F.substring_index("value", ",", 1), '"', "")
    rows = lines.where(F.col("value") != "").select(tac.alias("tac"), (width != fields).cast("int").alias("odd"))
    by = rows.groupBy("tac").agg(F.count(F.lit(1)).alias("n"), F.sum("odd").alias("odd"))
    sums = by.agg(
        F.sum("n").alias("records"), F.sum("odd").alias("malformed"), F.count(F.lit(1)).alias("tacs"), F.count_if(F.col("n") > 1).alias("repeated_tacs"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("repeated_records")
    )
    return sums.withColumn("accepted", (F.col("malformed") == 0) & (F.col("repeated_tacs") == 0))


def validate_rows(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted rows and findings of raw delta lines (one column, ``value``).

    Rejected: wrong field count, numbers that are not, unknown labels. Warned: empty, non-digit or
    oddly long IMEIs. A number above 2 ** 63 - 1 is rejected.
    """
    f = F.split("value", ",", -1)
    part = lambda k: F.trim(F.get(f, F.lit(k)))
    number = lambda c: c.rlike("^[0-9]+$") & c.try_cast("long").isNotNull()
    shape = F.size(f) == 4
    rules = (
        ("field_count", "reject", ~shape), ("msisdn_not_numeric", "reject", shape & ~number(part(0))), ("imsi_not_numeric", "reject", shape & ~number(part(1))),
        ("label_unknown", "reject", shape & ~part(3).isin("add", "remove")), ("imei_empty", "warn", shape & (part(2) == "")),
        ("imei_not_digits", "warn", shape & (part(2) != "") & ~part(2).rlike("^[0-9]+$")), ("imei_length", "warn", shape & part(2).rlike("^[0-9]+$") & ~F.length(part(2)).isin(6, 14)),
    )
    found = F.array_compact(F.array(*(F.when(test, F.struct(F.lit(name).alias("rule"), F.lit(level).alias("level"))) for name, level, test in rules)))
    judged = lines.select("value", f.alias("f"), found.alias("found"))
    good = judged.where(~F.exists("found", lambda x: x["level"] == "reject"))
    field = lambda k: F.trim(F.get("f", F.lit(k)))
    accepted = good.select(field(0).cast("long").alias("msisdn"), field(1).cast("long").alias("imsi"), field(2).alias("imei"), field(3).alias("label"))
    return accepted, judged.select("value", F.inline("found"))


def quarantine_summary(findings: DataFrame, lines: DataFrame, samples: int = 3) -> DataFrame:
    """By rule the count, the first lines by value, and whether rejects put the file in quarantine.

    The smallest lines are picked in salted parts first, so that no rule meets whole in one task.
    """
    salted = Window.partitionBy("rule", "salt").orderBy("value")
    parts = findings.withColumn("salt", F.pmod(F.xxhash64("value"), F.lit(64))).withColumn("k", F.row_number().over(salted)).where(F.col("k") <= samples)
    first = parts.withColumn("k", F.row_number().over(Window.partitionBy("rule").orderBy("value"))).where(F.col("k") <= samples)
    shown = first.groupBy("rule").agg(F.array_sort(F.collect_list("value")).alias("samples"), F.min("value").alias("first"))
    total = lines.agg(F.count(F.lit(1)).alias("rows"))
    sums = findings.groupBy("rule", "level").agg(F.count(F.lit(1)).alias("n")).join(shown, "rule").crossJoin(F.broadcast(total))
    return sums.withColumn("quarantined", (F.col("level") == "reject") & (F.col("n") > QUARANTINE_SHARE * F.col("rows")))


def check_headers(spark: SparkSession, path: str, contract: list[str]) -> DataFrame:
    """Each file's header against the contract: missing or moved columns reject, appended ones warn."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"), "value")
    first = lines.groupBy("file").agg(F.min_by("value", "at").alias("header"))
    names = F.transform(F.split("header", ","), lambda c: F.trim(c))
    wanted = F.array(*map(F.lit, contract))
    same = F.slice(names, 1, len(contract)) == wanted
    verdict = F.when(same & (F.size(names) == len(contract)), "ok").when(same, "warn").otherwise("reject")
    return first.select("file", verdict.alias("verdict"), F.array_join(F.array_except(wanted, names), ",").alias("missing"), F.sha2(F.array_join(names, ","), 256).alias("fingerprint"))


def read_catalogue(spark: SparkSession, path: str, version: str) -> DataFrame:
    """A catalogue file (RFC 4180, all text) as rows of a version."""
    return spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"').withColumn("version_id", F.lit(version))


def check_version(catalogue: DataFrame, date_col: str = "allocationDate") -> DataFrame:
    """Rows, distinct and malformed TACs, blank makers and the newest date of a version."""
    date = F.col(date_col) if date_col in catalogue.columns else F.lit(None).cast("string")
    return catalogue.agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("tac").alias("tacs"), F.count_if(~F.col("tac").rlike("^[0-9]{8}$")).alias("malformed"),
        F.count_if(F.coalesce(F.trim("manufacturer"), F.lit("")) == "").alias("blank_maker"), F.max(F.to_date(F.try_to_timestamp(date, F.lit("dd-MMM-yyyy")))).alias("newest"),
    )


def diff_versions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Each TAC of two versions: added, removed, updated or unchanged."""
    columns = sorted(c for c in new.columns if c not in ("tac", "version_id"))
    mark = lambda df, name: df.select("tac", F.sha2(F.to_json(F.struct(*columns)), 256).alias(name))
    both = mark(old, "a").join(mark(new, "b"), "tac", "full_outer")
    kind = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "updated").otherwise("unchanged")
    return both.select("tac", kind.alias("change"))


def dedupe_files(spark: SparkSession, path: str, ledger: DataFrame) -> DataFrame:
    """Files whose content the ledger (sha256) does not know."""
    files = spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))
    return files.join(ledger.select("sha256").distinct(), "sha256", "left_anti")


def export_csv(df: DataFrame, path: str) -> None:
    """CSV in which no text cell can start a formula."""
    safe = lambda c: F.when(F.col(c).rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), F.col(c))).otherwise(F.col(c)).alias(c)
    df.select([safe(c) if kind == "string" else F.col(c) for c, kind in df.dtypes]).write.mode("overwrite").csv(path, header=True)


def export_tables(tables: dict[str, DataFrame], path: str) -> None:
    """Each table as CSV in a folder of its name."""
    for name, df in tables.items():
        export_csv(df, f"{path}/{name}")


def to_parquet(spark: SparkSession, path: str, out: str, schema: str = DELTA) -> None:
    """CSV files as compressed Parquet, each row with its file and batch (the file's folder)."""
    rows = spark.read.csv(path, header=True, schema=schema)
    file = F.col("_metadata.file_path")
    rows.select("*", F.element_at(F.split(file, "/"), -1).alias("fname"), F.element_at(F.split(file, "/"), -2).alias("batch")).write.mode("overwrite").option("compression", "zstd").parquet(out)
