"""Quality figures as runs publish them: computed in chunks of numbers, served from the newest published run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindwell.functions.rules import flag_handsets
from bindwell.operators.daily import HISTORY_CATEGORIES, quality_history_amounts, quality_tests
from bindwell.operators.tac_mart import REGISTERS
from bindwell.sources.feed import KEY
from bindwell.sources.store import cut


def quality_chunks(state: DataFrame, history: DataFrame, tac: DataFrame, run_id: int, chunks: int = 32) -> DataFrame:
    """A run's figures: (run_id, chunk, source, category, bindings, numbers, sims, imeis, periods).

    A chunk holds all bindings of its numbers, so bindings, numbers and periods add up over chunks;
    SIMs and handsets are sketches, which merge. Each chunk's rows depend on its numbers alone.
    """
    now = flag_handsets(state, tac).select(*KEY, *(F.coalesce(test, F.lit(False)).cast("long").alias(name) for name, test in quality_tests().items()))
    parts = _chunked(now, tuple(quality_tests()), "current", chunks).unionByName(_chunked(quality_history_amounts(history), HISTORY_CATEGORIES, "history", chunks))
    return parts.select(F.lit(run_id).cast("long").alias("run_id"), "*")


def _chunked(amounts: DataFrame, categories: tuple[str, ...], source: str, chunks: int) -> DataFrame:
    """Figures of each chunk from a row a binding with the amount of each category in a column.

    Sketches stand side by side, a group a chunk: groups by chunk and category would be too many for
    Spark to keep in memory, which then sorts all rows. The rows are written, as two aggregates read them.
    """
    amounts = cut(amounts, "quality_amounts")
    chunk = F.pmod(F.xxhash64("msisdn"), F.lit(chunks)).cast("int").alias("chunk")
    within = lambda c, value: F.when(F.col(c) > 0, value)
    sketch = lambda c, value: F.hll_sketch_agg(within(c, value), REGISTERS)
    sums = amounts.groupBy(chunk).agg(
        *(F.struct(F.count(within(c, F.lit(1))).alias("bindings"), sketch(c, F.col("imsi").cast("string")).alias("sims"), sketch(c, F.col("imei")).alias("imeis"), F.sum(within(c, F.col(c))).alias("periods")).alias(c) for c in categories)
    )
    each = amounts.groupBy("msisdn").agg(*(F.max(F.col(c) > 0).alias(c) for c in categories))
    numbers = each.groupBy(chunk).agg(F.create_map(*(x for c in categories for x in (F.lit(c), F.count_if(c)))).alias("numbers"))
    cells = F.array(*(F.struct(F.lit(c).alias("category"), F.col(c).alias("figures")) for c in categories))
    rows = sums.select("chunk", F.inline(cells)).join(numbers, "chunk").where("figures.bindings > 0")
    # the state's categories have no amounts
    periods = F.lit(0).cast("long") if source == "current" else F.col("figures.periods")
    return rows.select("chunk", F.lit(source).alias("source"), "category", "figures.bindings", F.element_at("numbers", F.col("category")).alias("numbers"), "figures.sims", "figures.imeis", periods.alias("periods"))


def latest_published(runs: DataFrame, chunks: DataFrame) -> DataFrame:
    """The figures of the newest run that is published and has chunks.

    ``runs``: run_id, as_of, state, updated_at; a run's last row says its state. Other runs' chunks are not read
    where ``chunks`` is partitioned by run.
    """
    state = runs.groupBy("run_id").agg(F.max_by(F.struct("state", "as_of"), "updated_at").alias("last"))
    there = chunks.select("run_id").distinct()
    newest = state.where("last.state = 'published'").join(there, "run_id", "left_semi").agg(F.max("run_id").alias("run_id")).first()["run_id"]
    mine = chunks.where(F.col("run_id") == newest) if newest is not None else chunks.limit(0)
    as_of = state.select("run_id", F.col("last.as_of").alias("as_of"))
    figures = mine.groupBy("run_id", "source", "category").agg(
        F.sum("bindings").alias("bindings"), F.sum("numbers").alias("numbers"), F.hll_sketch_estimate(F.hll_union_agg("sims")).alias("sims"), F.hll_sketch_estimate(F.hll_union_agg("imeis")).alias("imeis"),
        F.sum("periods").alias("periods"),
    )
    return figures.join(F.broadcast(as_of.where(F.col("run_id") == newest)) if newest is not None else as_of, "run_id")  # one row
