"""Tables that later questions read, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: dict[tuple[str, str, str], str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a temporary one only in local mode, as in tests."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bindwell-"))
    return spark.conf.get("spark.checkpoint.dir")


def kept(spark: SparkSession, source: str, name: str, make) -> DataFrame:
    """The table ``name`` that ``make`` derives from the tables at ``source``, written once an application.

    Tables under a path are taken not to change meanwhile; ``forget`` says that they have.
    """
    key = (spark.sparkContext.applicationId, source, name)
    if key not in _WRITTEN:
        path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        make().write.parquet(path, compression="zstd")
        _WRITTEN[key] = path
    return spark.read.parquet(_WRITTEN[key])


def cut(df: DataFrame, name: str) -> DataFrame:
    """``df`` computed once and written as a table of its own, for plans that read it more than once."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept_folder(spark: SparkSession, source: str, name: str, fill) -> str:
    """A folder that ``fill(path)`` has filled from the tables at ``source``, once an application."""
    key = (spark.sparkContext.applicationId, source, name)
    if key not in _WRITTEN:
        path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        fill(path)
        _WRITTEN[key] = path
    return _WRITTEN[key]


def spread(rows: DataFrame, table: DataFrame, *by: str, most: int = 500_000) -> DataFrame:
    """``rows``, which are no more than those of ``table``, by the hash of some columns in parts of about ``most`` rows, so
    that what a task of the next step holds does not grow with the table."""
    parts = -(-table.count() // most)
    return rows.repartition(max(parts, rows.sparkSession.sparkContext.defaultParallelism), *by)


def forget(source: str) -> None:
    """Derive everything from the tables at ``source`` anew when it is next asked for."""
    for key in [k for k in _WRITTEN if k[1] == source]:
        del _WRITTEN[key]
