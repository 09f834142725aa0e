"""Days as they arrive: a file stream whose batches end as if every day had come on time."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from bindwell.functions.rules import flag_handsets
from bindwell.operators import daily, fold, tac_mart
from bindwell.operators.marts import with_vendor
from bindwell.sources.feed import KEY, tac_of
from bindwell.sources.layouts import STATE, Journal, Layouts

SCHEMA = "seq int, data_date date, msisdn long, imsi long, imei string, tac string, label string"

#: What is derived from the events of each day alone.
DAY_MARTS = {"change_daily": daily.change_daily, "change_summary": daily.change_summary, "sim_changes": daily.sim_changes, "device_changes": daily.device_changes, "multi_number": daily.multi_number_sims}


def _log(journal: Journal) -> DataFrame:
    """The log so far, empty before the first batch."""
    try:
        return journal.table("log", SCHEMA)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return journal.spark.createDataFrame([], SCHEMA)


def _day_steps(tac: DataFrame | None) -> dict:
    """Mart by name, from the events of whole days."""
    if tac is None:
        return DAY_MARTS
    evidence = lambda rows: daily.sim_change_evidence(rows, daily.multi_number_sims(rows), daily.dq_daily(rows, tac))
    return DAY_MARTS | {"dq_daily": lambda rows: daily.dq_daily(rows, tac), "sim_change_evidence": evidence, "tac_day": lambda rows: daily.tac_day(rows, tac)}


def on_days(batch: DataFrame, snapshot: DataFrame, root: str, number: int, tac: DataFrame | None = None, vendors: DataFrame | None = None, marts: bool = True) -> None:
    """Take the days of a batch: log, copies of the state, history of their months, day marts, delivery marts.

    Without ``marts`` the log and the copies are all that is kept.

    Everything is written beside what is there, under the batch's number, and read only once the
    batch's marker is published at the end. So a batch that dies anywhere leaves the tables as they
    were, a repeated one writes the same files again, and the keys that a replaced day had, and its
    new delivery lacks, are still known when it is repeated. Lateness is unbounded, so there is no
    watermark: a newest day is folded onto the state, any other has its touched bindings derived again
    from the whole log. With a catalogue, feed quality, SIM-change evidence, model days and delivery
    marts are kept too.
    """
    spark = batch.sparkSession
    journal, layouts = Journal(spark, root), Layouts(spark, root)
    if journal.finished(number):
        return
    before = _log(journal)
    _stored(batch.select("seq", *KEY, "tac", "label", "data_date"), f"{root}/log/batch={number}", "data_date")
    mine = spark.read.schema(SCHEMA).parquet(f"{root}/log/batch={number}")
    days = sorted(r[0] for r in mine.select("data_date").distinct().collect())  # a row a day
    log = before.where(~F.col("data_date").isin(days)).unionByName(mine)
    manifest = journal.manifest()
    if manifest is None:
        _stored(fold.fold_all(snapshot, log), f"{root}/changed/batch={number}")
        written = layouts.create(spark.read.schema(STATE).parquet(f"{root}/changed/batch={number}"), number)
    else:
        newest = before.agg(F.max("data_date")).first()[0]
        replaced = before.where(F.col("data_date").isin(days))
        _stored(mine.select(*KEY).unionByName(replaced.select(*KEY)).distinct(), f"{root}/touched/batch={number}")
        touched = spark.read.parquet(f"{root}/touched/batch={number}")
        if days and (newest is None or newest < days[0]):
            changed = fold.fold_day(layouts.read("msisdn", manifest).join(touched, KEY, "left_semi"), mine)
        else:
            changed = fold.fold_all(snapshot.join(touched, KEY, "left_semi"), log.join(touched, KEY, "left_semi"))
        _stored(changed, f"{root}/changed/batch={number}")
        written = layouts.update(manifest, touched, spark.read.schema(STATE).parquet(f"{root}/changed/batch={number}"), number)
    if marts:
        for name, step in _day_steps(tac).items():
            _stored(step(mine), f"{root}/{name}/batch={number}", "data_date")
        months = sorted({d.year * 100 + d.month for d in days})
        of_month = log.where(F.date_format("data_date", "yyyyMM").cast("int").isin(months))
        _stored(fold.build_history(of_month), f"{root}/history/batch={number}", "month")
        if tac is not None:
            _delivery_marts(layouts.read("msisdn", written), tac, vendors, root, number)
    journal.publish(number, days, written)


def _stored(df: DataFrame, path: str, *by: str) -> None:
    """A table, by days or months if asked: a day's rows are gathered in a few files, or each task would open one for every day."""
    if "data_date" in by:
        df = df.hint("rebalance", *by)
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def _delivery_marts(state: DataFrame, tac: DataFrame, vendors: DataFrame | None, root: str, number: int) -> None:
    """The models' mart with its sketches, from one read of the state, and what is merged from it."""
    _stored(tac_mart.state_mart(flag_handsets(state, tac)), f"{root}/state_mart/batch={number}")
    mart = state.sparkSession.read.parquet(f"{root}/state_mart/batch={number}")
    devices = with_vendor(tac, vendors if vendors is not None else state.sparkSession.createDataFrame([], "raw_manufacturer string, vendor_canonical string"))
    _stored(tac_mart.dimensions_of(mart, devices), f"{root}/dimension_mart/batch={number}")


def latest(spark: SparkSession, root: str) -> DataFrame | None:
    """State of the newest batch that was finished."""
    manifest = Journal(spark, root).manifest()
    return None if manifest is None else Layouts(spark, root).read("msisdn", manifest)


def stream_days(spark: SparkSession, source: str, snapshot: DataFrame, root: str, tac: DataFrame | None = None, vendors: DataFrame | None = None) -> StreamingQuery:
    """Run over all files that have arrived, then stop; the checkpoint remembers what was taken."""
    events = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    events = events.withColumn("tac", tac_of("imei"))
    return (
        events.writeStream.option("checkpointLocation", f"{root}/offsets")
        .trigger(availableNow=True)
        .foreachBatch(lambda batch, number: on_days(batch, snapshot, root, number, tac, vendors))
        .start()
    )


FOLDED = "msisdn long, imsi long, imei string, active int, last_change_seq int, last_change_date date"


def stateful_fold(statements: DataFrame) -> DataFrame:
    """The current state as a stream: the last statement of each binding is kept as keyed state.

    ``statements`` is a stream of ``SCHEMA``; a row without a day is one of the dump. Order of arrival
    doesn't matter: date, sequence and label decide, and an event beats the dump. In update mode each
    batch gives the bindings it touched as they stand now. State is a row a binding, without a timeout.
    """
    dated = F.col("data_date").isNotNull().cast("int").alias("dated")
    last = F.max(F.struct(dated, F.col("data_date").alias("day"), "seq", "label")).alias("last")
    folded = statements.groupBy(*KEY).agg(last)
    return folded.select(*KEY, (F.col("last.label") == "add").cast("int").alias("active"), F.col("last.seq").alias("last_change_seq"), F.col("last.day").alias("last_change_date"))


#: Keyed state lies on the executors' disks, its memory is bounded, and its rows are not counted at every write.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
}


def stream_state(spark: SparkSession, source: str, root: str, files: int = 1) -> StreamingQuery:
    """Run the stateful fold over all files that have arrived, ``files`` a batch; ``folded`` reads what it has come to."""
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).parquet(source)
    writer = (
        stateful_fold(stream)
        .writeStream.outputMode("update")
        .option("checkpointLocation", f"{root}/offsets")
        .trigger(availableNow=True)
        .foreachBatch(lambda batch, number: _stored(batch, f"{root}/updates/batch={number}"))
    )
    before = {name: spark.conf.get(name, None) for name in STORE}
    try:  # a query takes its settings when it starts, so that the state store is this one's alone
        for name, value in STORE.items():
            spark.conf.set(name, value)
        return writer.start()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def folded(spark: SparkSession, root: str) -> DataFrame:
    """Each binding as its newest batch has it."""
    rows = spark.read.schema(f"{FOLDED}, batch long").parquet(f"{root}/updates")
    last = rows.groupBy(*KEY).agg(F.max_by(F.struct("active", "last_change_seq", "last_change_date"), "batch").alias("last"))
    return last.select(*KEY, tac_of("imei").alias("tac"), "last.active", "last.last_change_seq", "last.last_change_date")


def daily_counts(events: DataFrame, length: str = "1 day", slide: str | None = None, late: str = "7 days") -> DataFrame:
    """Windows of a length over a stream of events, by label; tumbling unless they slide. Events more than ``late`` behind are left out."""
    timed = events.withColumn("at", F.col("data_date").cast("timestamp"))
    return timed.withWatermark("at", late).groupBy(F.window("at", length, slide), "label").agg(F.count(F.lit(1)).alias("n"))


def stream_windows(spark: SparkSession, source: str, root: str, length: str = "1 day", slide: str | None = None, late: str = "7 days", files: int = 1) -> StreamingQuery:
    """Keep windowed counts up to date with all files that have arrived, ``files`` a batch; ``windows`` reads them, ``too_late`` counts what was left out."""
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).parquet(source)
    counts = daily_counts(stream, length, slide, late)
    return (
        counts.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "label", "n")
        .writeStream.outputMode("update")
        .option("checkpointLocation", f"{root}/offsets")
        .trigger(availableNow=True)
        .foreachBatch(lambda batch, number: _stored(batch, f"{root}/windows/batch={number}"))
        .start()
    )


def windows(spark: SparkSession, root: str) -> DataFrame:
    """Each window as its newest batch has it."""
    return spark.read.parquet(f"{root}/windows").groupBy("start", "end", "label").agg(F.max_by("n", "batch").alias("n"))


def too_late(query: StreamingQuery) -> int:
    """Rows of a query's batches that came after the watermark had passed them."""
    return sum(int(operator["numRowsDroppedByWatermark"]) for progress in query.recentProgress for operator in progress["stateOperators"])
