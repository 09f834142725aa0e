"""Exact deduplication with a two-pass Bloom filter.

Pass one counts, saturating at two, how many rows hit each place of a Bloom filter. Pass two looks
every row up: a row with a place that only one row hit cannot have a copy and goes straight to the
result. Only the rest are shuffled and grouped on the full digest, so the result is exact whatever
the filter says.

The filter never grows past ``max_bits`` (64 MB at the default), which bounds what is collected and
broadcast. With more rows than that serves well, more rows are shuffled; none is lost.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindwell.llm.store import cut
from bindwell.llm.text import U64, mix

#: Bits of a filter segment, the unit in which partial filters are shuffled and merged.
SEGMENT = 1 << 16
#: Places a task holds before it sends them on.
FLUSH = 4_000_000
#: The white space that does not count: space, tab, line feed, vertical tab, form feed, return.
WHITE_SPACE = " \t\n\x0b\x0c\r"


def filter_places(values: np.ndarray, n_bits: int, n_hashes: int) -> np.ndarray:
    """The places of each unsigned hash, one row of the result for each hash function."""
    first, second = mix(values), mix(values ^ U64(0x5851F42D4C957F2D)) | U64(1)
    return np.stack([(first + U64(k) * second) % U64(n_bits) for k in range(n_hashes)]).astype(np.int64)


def _places(hashes: pd.Series, n_bits: int, n_hashes: int) -> np.ndarray:
    return filter_places(hashes.to_numpy(np.int64).view(U64), n_bits, n_hashes)


def _by_segment(places: list[np.ndarray]) -> pd.DataFrame:
    """Places hit at all and places hit twice, as 16-bit lists by segment."""
    hit, times = np.unique(np.concatenate(places), return_counts=True)
    segment, low = hit >> 16, (hit & (SEGMENT - 1)).astype(np.uint16)
    names, first = np.unique(segment, return_index=True)
    bounds = [*first.tolist(), len(hit)]
    parts = list(zip(bounds, bounds[1:], strict=False))
    return pd.DataFrame({
        "segment": names,
        "once": [low[a:b].tobytes() for a, b in parts],
        "twice": [low[a:b][times[a:b] > 1].tobytes() for a, b in parts],
    })


def repeat_filter(hashes: DataFrame, n_bits: int, n_hashes: int) -> np.ndarray:
    """Bit array of the places that two or more rows of ``hashes`` (one long column) hit."""

    def sketch(frames):
        held, size = [], 0
        for frame in frames:
            held.append(_places(frame.iloc[:, 0], n_bits, n_hashes).ravel())
            size += held[-1].size
            if size >= FLUSH:
                yield _by_segment(held)
                held, size = [], 0
        if size:
            yield _by_segment(held)

    def merge(frames):
        counts: dict[int, np.ndarray] = {}
        for frame in frames:
            for segment, once, twice in frame.itertuples(index=False):
                count = counts.setdefault(segment, np.zeros(SEGMENT, np.uint8))
                once = np.frombuffer(once, np.uint16)
                count[once] = np.minimum(count[once] + 1, 2)
                count[np.frombuffer(twice, np.uint16)] = 2
        for segment, count in counts.items():
            if (count > 1).any():
                yield pd.DataFrame({"segment": [segment], "bits": [zlib.compress(np.packbits(count > 1, bitorder="little").tobytes(), 1)]})

    merged = (
        hashes.mapInPandas(sketch, "segment long, once binary, twice binary")
        .repartition("segment")
        .mapInPandas(merge, "segment long, bits binary")
    )
    bits = np.zeros(n_bits // 8, np.uint8)
    for row in merged.toLocalIterator():
        part = np.frombuffer(zlib.decompress(row["bits"]), np.uint8)
        bits[row["segment"] * (SEGMENT // 8) : (row["segment"] + 1) * (SEGMENT // 8)] = part
    return bits


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    bits_per_row: int = 16,
    max_bits: int = 1 << 29,
    n_hashes: int = 4,
) -> DataFrame:
    """Which rows are equal once white space is deleted, and which row of each group stays.

    Returns for each row: ``id_col``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.
    The longest original text (code points) stays, then the smallest id (a null id last); of rows
    alike in all of that, one. A null text counts as empty, and empty texts are equal. An empty
    table gives an empty result. Other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    digests = cut(
        docs.select(
            F.col(id_col).alias("id"),
            F.length(text).alias("n"),
            F.unhex(F.sha2(F.translate(text, WHITE_SPACE, ""), 256)).alias("sha"),
            F.monotonically_increasing_id().alias("row"),
        )
    )
    wanted = max(1, digests.count()) * bits_per_row
    n_bits = min(-(-wanted // SEGMENT) * SEGMENT, max(SEGMENT, max_bits // SEGMENT * SEGMENT))
    hashed = digests.withColumn("h", F.xxhash64("sha"))
    found = docs.sparkSession.sparkContext.broadcast(repeat_filter(hashed.select("h"), n_bits, n_hashes))

    @F.pandas_udf("boolean")
    def may_repeat(hashes: pd.Series) -> pd.Series:
        places = _places(hashes, n_bits, n_hashes)
        return pd.Series(((found.value[places >> 3] >> (places & 7).astype(np.uint8)) & 1).all(axis=0))

    tagged = hashed.withColumn("maybe", may_repeat("h"))
    alone = tagged.where(~F.col("maybe")).select(
        "id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha"
    )
    maybe = cut(tagged.where("maybe").select("id", "n", "sha", "row"))
    best = F.struct((-F.col("n")).alias("n"), F.col("id").isNull().alias("no_id"), "id", "row")
    groups = cut(maybe.groupBy("sha").agg(F.min(best).alias("best"), F.count(F.lit(1)).alias("group_size")))
    # both sides come from storage: the planner shuffles them for the join and can split a hot group
    grouped = maybe.join(groups, "sha").select(
        "id",
        F.col("best.id").alias("keep_id"),
        "group_size",
        (F.col("best.row") == F.col("row")).alias("kept"),
        "sha",
    )
    return alone.unionByName(grouped).select(
        F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256")
    )
