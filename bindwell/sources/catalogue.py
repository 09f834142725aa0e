"""The device catalogue as files and versions: reading, structural scan, the active version, and sources whose last update counts."""

from __future__ import annotations

import datetime as dt

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The columns of a catalogue file, all text, in its order.
COLUMNS = (
    "tac", "manufacturer", "modelName", "marketingName", "brandName", "allocationDate", "lastUpdatedDate", "organisationId", "deviceType", "bluetooth", "nfc", "wlan",
    "authenticatedIMSEmergencyCallSupport", "unauthenticatedIMSEmergencyCallSupport", "imsEmergencyCallWithoutUICC", "removableUICC", "removableEUICC", "nonremovableUICC", "nonremovableEUICC",
    "networkSpecificIdentifier", "ntnConnectivity", "simSlot", "imeiQuantity", "operatingSystem", "oem", "bandDetails",
)
#: Samples of a finding, and characters of a sample.
SAMPLES, SAMPLE_LENGTH = 10, 500
_RECORD = "_record"


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """All records of a catalogue's files: ``COLUMNS`` by name, and ``_record``, the raw text of those with another number of fields.

    Quoted fields may hold commas, doubled quotes and line feeds; a quote inside an unquoted field is
    a sign like any other. A file whose header lacks a column is refused.
    """
    header = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"').columns
    if missing := sorted(set(COLUMNS) - set(header)):
        raise ValueError(f"the header lacks {', '.join(missing)}")
    schema = T.StructType([*(T.StructField(c, T.StringType()) for c in header), T.StructField(_RECORD, T.StringType())])
    rows = spark.read.csv(path, schema=schema, header=True, multiLine=True, quote='"', escape='"', mode="PERMISSIVE", columnNameOfCorruptRecord=_RECORD, enforceSchema=True)
    # all of a record's fields are read: a scan of some columns alone would not count them
    return rows.where(F.length(F.concat_ws("", *map(F.col, header))) >= 0).select(*COLUMNS, _RECORD)


def read_catalogue(spark: SparkSession, path: str, version: int) -> DataFrame:
    """The well-formed records of a version; scan its files first."""
    return read_records(spark, path).where(F.col(_RECORD).isNull()).drop(_RECORD).withColumn("version_id", F.lit(version))


def scan_records(records: DataFrame) -> DataFrame:
    """What a catalogue's records say of its files, one row.

    ``records``, those with another number of fields than the header (``malformed``) with samples, well-formed
    records whose TAC is not eight digits, TACs that stand more than once (``repeated_tacs``, with
    samples), the records that repeat one, and whether the files can be loaded. TACs are summed where
    they are before they are shuffled; samples are the first in order of their text.
    """
    odd = F.col(_RECORD).isNotNull()
    eight = F.col("tac").rlike("^[0-9]{8}$")
    by_tac = records.groupBy(F.when(~odd & eight, F.col("tac")).alias("tac")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(odd).alias("malformed"), F.count_if(~odd & ~F.coalesce(eight, F.lit(False))).alias("not_eight_digits")
    )
    again = F.col("tac").isNotNull() & (F.col("n") > 1)
    sums = by_tac.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("records"), F.coalesce(F.sum("malformed"), F.lit(0)).alias("malformed"), F.coalesce(F.sum("not_eight_digits"), F.lit(0)).alias("not_eight_digits"),
        F.count_if(again).alias("repeated_tacs"), F.coalesce(F.sum(F.when(again, F.col("n") - 1)), F.lit(0)).alias("repeated_records"),
    )
    listed = lambda rows, name: rows.orderBy(name).limit(SAMPLES).agg(F.array_sort(F.collect_list(name)).alias(f"{name}s"))  # noqa: E731  ten rows
    shown = listed(records.where(odd).select(F.substring(_RECORD, 1, SAMPLE_LENGTH).alias("malformed_sample")), "malformed_sample")
    repeated = listed(by_tac.where(again).select(F.col("tac").alias("repeated_sample")), "repeated_sample")
    return sums.crossJoin(F.broadcast(shown)).crossJoin(F.broadcast(repeated)).withColumn("accepted", (F.col("malformed") == 0) & (F.col("repeated_tacs") == 0))


def last_wins(updates: DataFrame, keys: list[str], at: str = "updated_at") -> DataFrame:
    """The rows of an append-only source as its newest updates have them; of updates at the same time the greatest counts."""
    rest = [c for c in updates.columns if c not in (*keys, at)]
    last = F.max(F.struct(at, *rest)).alias("_last")
    return updates.groupBy(*keys).agg(last).select(*keys, *(F.col(f"_last.{c}").alias(c) for c in rest))


def vendor_map(updates: DataFrame) -> DataFrame:
    """Raw maker spellings and the vendor each stands for now; an update to an empty vendor takes a spelling out.

    ``updates``: raw_manufacturer, vendor_canonical, updated_at.
    """
    return last_wins(updates.select("raw_manufacturer", "vendor_canonical", "updated_at"), ["raw_manufacturer"]).where(F.coalesce("vendor_canonical", F.lit("")) != "")


class Versions:
    """Catalogue versions under a folder. Rows of the version folders never change; which one counts is the last row of a pointer table."""

    POINTER = "version_id int, action string, at timestamp"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def load(self, path: str, version: int) -> DataFrame:
        """Scan files and, if they can be loaded, write them as a version; gives the scan."""
        records = read_records(self.spark, path)
        scan = scan_records(records)
        if scan.first()["accepted"]:
            records.drop(_RECORD).write.mode("overwrite").parquet(f"{self.root}/rows/version_id={version}")
            self._point(version, "loaded")
        return scan

    def _point(self, version: int, action: str) -> None:
        row = [(version, action, dt.datetime.now(dt.UTC).replace(tzinfo=None))]
        self.spark.createDataFrame(row, self.POINTER).coalesce(1).write.mode("append").parquet(f"{self.root}/pointer")

    def _pointer(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.POINTER).parquet(f"{self.root}/pointer")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], self.POINTER)

    def present(self) -> list[int]:
        """Versions that are loaded and not dropped: a row a version."""
        last = self._pointer().where("action in ('loaded', 'dropped')").groupBy("version_id").agg(F.max_by("action", "at").alias("action"))
        return sorted(r[0] for r in last.where("action = 'loaded'").collect())

    def active(self) -> int | None:
        """The version that was activated last and is still there."""
        rows = self._pointer().where((F.col("action") == "active") & F.col("version_id").isin(self.present()))
        return rows.agg(F.max_by("version_id", "at")).first()[0]

    def activate(self, version: int) -> None:
        """Make a version the one that counts: one appended row, so readers see the old one or the new one."""
        if version not in self.present():
            raise ValueError(f"there is no version {version}")
        self._point(version, "active")

    def drop(self, version: int) -> None:
        """Take a version out; the active one stays."""
        if version == self.active():
            raise ValueError("the active version can't be dropped")
        self._point(version, "dropped")

    def rows(self, version: int | None = None) -> DataFrame:
        """A version's catalogue, the active one's by default."""
        chosen = self.active() if version is None else version
        if chosen is None or chosen not in self.present():
            raise ValueError("no such version")
        return self.spark.read.parquet(f"{self.root}/rows/version_id={chosen}").withColumn("version_id", F.lit(chosen))


def first_rows(findings: DataFrame, by: str, at: str, samples: int = 3) -> DataFrame:
    """By rule the first places (``at``) and the first rows' ``value``, picked in salted parts first."""
    salted = Window.partitionBy(by, "_salt").orderBy(at)
    parts = findings.withColumn("_salt", F.pmod(F.xxhash64(at), F.lit(64))).withColumn("_k", F.row_number().over(salted)).where(F.col("_k") <= samples)
    first = parts.withColumn("_k", F.row_number().over(Window.partitionBy(by).orderBy(at))).where(F.col("_k") <= samples)
    rows = F.array_sort(F.collect_list(F.struct(at, "value")))
    return first.groupBy(by).agg(F.min(at).alias("first_row"), F.transform(rows, lambda x: x["value"]).alias("samples"))
