"""Reliable intermediate results.

Lineage is cut only with ``DataFrame.checkpoint`` (or a written table) in the folder that
``spark.checkpoint.dir`` names, so a lost executor never takes an intermediate result with it.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ids of which a broadcast is made at most (16 MB); beyond, the join is shuffled.
BROADCAST_IDS = 2_000_000


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only in local mode without a configured folder (tests)."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not configured and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(configured or tempfile.mkdtemp(prefix="bindwell-"))
        current = spark.sparkContext.getCheckpointDir()
    return (configured or current).rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def settled(df: DataFrame) -> DataFrame:
    """``cut`` without what the planner has estimated of ``df``: for tables that are made from one another again and again.

    A checkpoint keeps the estimated size of its plan, and a join's is the product of its sides'. Round after round that is a
    number of millions of digits, which fills the driver. A join of such tables is planned by what its sides turn out to be.
    """
    rows, spark = cut(df)._jdf.queryExecution().toRdd(), df.sparkSession
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(rows, df._jdf.schema(), False), spark)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` computed once and kept as a compressed table in the shared folder: for the large ones."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def bounded(ids: DataFrame) -> DataFrame:
    """A stored table of ids, marked for broadcast only if it is counted to be small."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
