"""The current state in three sorted copies, kept up to date by the key ranges that a batch touches.

Each copy is sorted by one key and cut into ranges whose bounds are fixed when it is first written.
A batch writes the ranges it touches anew, beside the old ones; a manifest says which batch wrote
each range last. Readers go by a manifest, so they see a batch whole or not at all, and a batch that
is repeated writes over its own files only. A question about a key reads its ranges, and inside them
the row groups whose statistics fit.
"""

from __future__ import annotations

import datetime as dt
from bisect import bisect_left, bisect_right
from functools import cache, reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bindwell.sources.feed import KEY

#: Which batch wrote each range of each copy last.
Manifest = dict[str, dict[int, int]]
STATE = "msisdn long, imsi long, imei string, tac string, active int, last_change_seq int, last_change_date date"
#: Ranges of a copy. Their bounds are kept on the driver and in a column expression, so they are few.
RANGES = 32


def _tree(column: Column, bounds: list, first: int) -> Column:
    """The number of ``bounds`` up to a value, by halving."""
    if not bounds:
        return F.lit(first)
    middle = len(bounds) // 2
    return F.when(column < F.lit(bounds[middle]), _tree(column, bounds[:middle], first)).otherwise(_tree(column, bounds[middle + 1 :], first + middle + 1))


class Layouts:
    """The copies under a folder."""

    def __init__(self, spark: SparkSession, root: str, ranges: int = RANGES):
        self.spark, self.root, self.ranges = spark, root.rstrip("/"), ranges
        self.bounds = cache(self._bounds)

    def path(self, key: str) -> str:
        return f"{self.root}/by_{key}"

    def _bounds(self, key: str) -> list:
        """The smallest value of every range but the first."""
        kind = {"msisdn": "long", "imsi": "long", "imei": "string"}[key]
        return [r[0] for r in self.spark.read.parquet(f"{self.root}/bounds_{key}").select(F.col("value").cast(kind).alias("value")).orderBy("value").collect()]

    def _fix_bounds(self, state: DataFrame) -> None:
        """Bounds by the keys' distribution, sampled by Spark's range partitioning; they hold from then on."""
        for key in KEY:
            dealt = state.select(key).repartitionByRange(self.ranges, key).groupBy(F.spark_partition_id().alias("p")).agg(F.min(key).alias("value"))
            smallest = dealt.agg(F.min("value").alias("least"))
            rest = dealt.crossJoin(F.broadcast(smallest)).where("value > least")  # a row a range
            rest.select(F.col("value").cast("string").alias("value")).distinct().coalesce(1).write.mode("overwrite").parquet(f"{self.root}/bounds_{key}")
        self.bounds.cache_clear()

    def range_of(self, key: str) -> Column:
        return _tree(F.col(key), self.bounds(key), 0)

    def _write(self, key: str, rows: DataFrame, number: int) -> None:
        others = [k for k in KEY if k != key]
        placed = rows.withColumn("range", self.range_of(key))
        # a range's rows meet in one task, or in some if they are many; rows are derived once, as nothing is sampled
        dealt = placed.hint("rebalance", "range").sortWithinPartitions("range", key, *others)
        dealt.write.mode("overwrite").partitionBy("range").parquet(f"{self.path(key)}/batch={number}")

    def create(self, state: DataFrame, number: int) -> Manifest:
        """Write all copies of a state. The caller publishes the manifest."""
        self._fix_bounds(state)
        for key in KEY:
            self._write(key, state, number)
        return {key: dict.fromkeys(range(len(self.bounds(key)) + 1), number) for key in KEY}

    def update(self, manifest: Manifest, touched: DataFrame, changed: DataFrame, number: int) -> Manifest:
        """Write the ranges that hold ``touched`` keys: their bindings but for the touched ones, and ``changed``.

        Both are stored tables; ``changed`` lacks the touched bindings that are no more. Only the
        numbers of ranges come to the driver.
        """
        after = {}
        found = {key: sorted(r[0] for r in touched.select(self.range_of(key).alias("range")).distinct().collect()) for key in KEY}
        # what stays in a touched range of any copy is told from the touched bindings once
        near = reduce(or_, (self.range_of(key).isin(ids) for key, ids in found.items()))
        self.read("msisdn", manifest).where(near).join(touched.select(*KEY), KEY, "left_anti").write.mode("overwrite").parquet(f"{self.root}/rest/batch={number}")
        rest = self.spark.read.schema(STATE).parquet(f"{self.root}/rest/batch={number}")
        for key, ids in found.items():
            self._write(key, rest.where(self.range_of(key).isin(ids)).unionByName(changed.select(*rest.columns)), number)
            after[key] = manifest[key] | dict.fromkeys(ids, number)
        return after

    def read(self, key: str, manifest: Manifest, ids: list[int] | None = None) -> DataFrame:
        """The copy sorted by ``key``, or some of its ranges, as a manifest has it."""
        by_batch: dict[int, list[int]] = {}
        for number, batch in manifest[key].items():
            if ids is None or number in ids:
                by_batch.setdefault(batch, []).append(number)
        rows = self.spark.read.schema(f"{STATE}, batch long, range int").parquet(self.path(key))
        chosen = [(F.col("batch") == batch) & F.col("range").isin(numbers) for batch, numbers in sorted(by_batch.items())]
        return rows.where(reduce(or_, chosen) if chosen else F.lit(False)).drop("batch", "range")

    def ranges_between(self, key: str, low, high) -> list[int]:
        """The ranges that values from ``low`` to ``high`` lie in."""
        bounds = self.bounds(key)
        return list(range(bisect_right(bounds, low) if low is not None else 0, (bisect_right(bounds, high) if high is not None else len(bounds)) + 1))

    def ranges_below(self, key: str, low, high) -> list[int]:
        """The ranges that values from ``low`` up to, but not, ``high`` lie in."""
        bounds = self.bounds(key)
        return list(range(bisect_right(bounds, low), bisect_left(bounds, high) + 1))


class Journal:
    """What batches have written: one marker a batch, published last.

    A marker lists the batch's days and the ranges of the copies it wrote. Tables that batches add to
    are read as of the newest marked batch of each day.
    """

    MARKER = "batch long, kind string, value string"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _markers(self) -> DataFrame | None:
        from pyspark.errors import AnalysisException

        try:
            return self.spark.read.schema(self.MARKER).parquet(f"{self.root}/ready/*")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def publish(self, number: int, days: list[dt.date], written: Manifest) -> None:
        """Mark a batch as finished: one file, so it is there whole or not at all."""
        rows = [(number, "day", str(d)) for d in days] + [(number, f"range_{key}", str(r)) for key, ranges in written.items() for r, batch in ranges.items() if batch == number]
        self.spark.createDataFrame([*rows, (number, "end", "")], self.MARKER).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/ready/batch_{number}")

    def finished(self, number: int) -> bool:
        markers = self._markers()
        return markers is not None and not markers.where((F.col("batch") == number) & (F.col("kind") == "end")).isEmpty()

    def last(self) -> int | None:
        markers = self._markers()
        return None if markers is None else markers.agg(F.max("batch")).first()[0]

    def manifest(self) -> Manifest | None:
        """The newest batch of each range; a few rows a batch reach the driver."""
        markers = self._markers()
        if markers is None:
            return None
        found: Manifest = {key: {} for key in KEY}
        rows = markers.where(F.col("kind").startswith("range_")).groupBy("kind", "value").agg(F.max("batch").alias("batch"))
        for kind, value, batch in rows.collect():
            found[kind.removeprefix("range_")][int(value)] = batch
        return found if found[KEY[0]] else None

    def days(self) -> DataFrame:
        """(data_date, batch): the newest batch of each day, a row a day."""
        markers = self._markers()
        if markers is None:
            return self.spark.createDataFrame([], "data_date date, batch long")
        return markers.where("kind = 'day'").groupBy(F.col("value").cast("date").alias("data_date")).agg(F.max("batch").alias("batch"))

    def table(self, name: str, schema: str | None = None) -> DataFrame:
        """A table of days: each day as the newest batch that delivered it has it."""
        reader = self.spark.read.schema(f"{schema}, batch long") if schema else self.spark.read
        rows = reader.parquet(f"{self.root}/{name}")
        return rows.join(F.broadcast(self.days()), ["data_date", "batch"], "left_semi").drop("batch")  # a row a day

    def monthly(self, name: str) -> DataFrame:
        """A table of months: each month as the newest batch with a day in it has it."""
        months = self.days().groupBy(F.date_format("data_date", "yyyyMM").cast("int").alias("month")).agg(F.max("batch").alias("batch"))
        return self.spark.read.parquet(f"{self.root}/{name}").join(F.broadcast(months), ["month", "batch"], "left_semi").drop("batch")

    def latest(self, name: str) -> DataFrame:
        """A table that every batch writes whole, as the last one left it."""
        return self.spark.read.parquet(f"{self.root}/{name}").where(F.col("batch") == self.last()).drop("batch")
