"""Best-fit packing of token sequences by repeated length patterns.

1. Documents are encoded; only those longer than a sequence are cut. The pieces' lengths give a
   histogram of at most ``max_tokens`` bins: all that the planner sees of the corpus.
2. Patterns of one to three lengths that fill a sequence are enumerated, and non-negative least
   squares fits how often each is repeated so that the histogram is used up. Counts are rounded
   down; what remains of the histogram is packed by best fit decreasing, again as patterns.
3. The plan gives every length a list of slots. A piece takes the slot of its rank among the pieces
   of its length, so placing pieces needs ranks only: counted in each partition, then offset by the
   partitions before it. No document passes through the driver and no sequence through one task.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bindwell.llm.encode import SLICE_BYTES, encoder
from bindwell.llm.store import cut
from bindwell.llm.text import buffers, map_texts, trimmed


def patterns(lengths: np.ndarray, total: int) -> np.ndarray:
    """All sets of up to three of ``lengths`` that add up to ``total``, in descending order, 0 for none."""
    have = np.zeros(total + 1, bool)
    have[lengths] = True
    two = [(a, total - a, 0) for a in lengths if a >= total - a > 0 and have[total - a]]
    three = []
    for a in lengths[lengths < total]:
        b = lengths[(lengths <= a) & (lengths < total - a)]
        c = total - a - b
        good = (c <= b) & have[c]
        three.append(np.stack([np.full(good.sum(), a), b[good], c[good]], axis=1))
    one = [(total, 0, 0)] if have[total] else []
    return np.concatenate([np.array(x, np.int64).reshape(-1, 3) for x in (one, two, *three)])


def fit_counts(shapes: np.ndarray, histogram: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Non-negative least squares: repeats of each pattern, by accelerated projected gradient."""
    if not len(shapes):
        return np.zeros(0)
    bins = len(histogram)

    def apply(x):  # pieces of each length used by the repeats
        used = np.zeros(bins)
        for k in range(shapes.shape[1]):
            used += np.bincount(shapes[:, k], weights=x, minlength=bins)
        used[0] = 0
        return used

    target = histogram.astype(float)
    target[0] = 0
    scale = 1 / np.sqrt(1 + target)  # each bin's error counts in proportion to its noise

    def gradient(x):
        residual = (apply(x) - target) * scale * scale
        residual[0] = 0
        return residual[shapes].sum(axis=1)

    probe = np.ones(len(shapes))
    for _ in range(12):  # largest eigenvalue, for the step
        probe = (apply(probe) * scale * scale)[shapes].sum(axis=1)
        norm = np.linalg.norm(probe)
        probe /= norm
    step = 1 / (1.05 * norm)
    x, y, t = np.zeros(len(shapes)), np.zeros(len(shapes)), 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - step * gradient(y))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def residual_patterns(left: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Best fit decreasing over what is left of a histogram; equal sequences are packed at once."""
    left, total, plan = left.copy(), len(left) - 1, []
    while left.any():
        shape, room = [], total
        used: Counter = Counter()
        while room > 0:
            fits = np.flatnonzero(left[: room + 1] - np.bincount(list(used.elements()), minlength=total + 1)[: room + 1] > 0)
            if not len(fits):
                break
            shape.append(int(fits[-1]))
            used[shape[-1]] += 1
            room -= shape[-1]
        times = min(int(left[k]) // n for k, n in used.items())
        for k, n in used.items():
            left[k] -= n * times
        plan.append((tuple(shape), times))
    return plan


def plan_sequences(histogram: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats) that together hold exactly the pieces of ``histogram`` (bins 0 .. max)."""
    total, left, plan = len(histogram) - 1, histogram.astype(np.int64).copy(), []
    left[0] = 0
    shapes = patterns(np.flatnonzero(left), total)
    wanted = np.floor(fit_counts(shapes, left) + 1e-9).astype(np.int64)
    for k in np.argsort(-wanted, kind="stable"):
        if not wanted[k]:
            break
        shape = tuple(int(x) for x in shapes[k] if x)
        need = Counter(shape)
        times = min(int(wanted[k]), *(int(left[x]) // n for x, n in need.items()))
        if times > 0:
            plan.append((shape, times))
            for x, n in need.items():
                left[x] -= n * times
    return plan + residual_patterns(left)


def slots(plan: list[tuple[tuple[int, ...], int]], total: int):
    """By length, where its slots of each plan entry begin (rank), and their sequence and offset."""
    taken = np.zeros(total + 1, np.int64)
    rows, sequence = [], 0
    for shape, times in plan:
        offset = 0
        for length in shape:
            rows.append((length, taken[length], sequence, offset))
            taken[length] += times
            offset += length
        sequence += times
    rows.sort()
    return np.array(rows, np.int64).reshape(-1, 4)


def piece_table(docs: DataFrame, id_col: str, text_col: str, tokenizer_path: str, end_id: int, max_tokens: int, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Pieces of all documents: id, piece, start, length, crc32 of its ids."""
    schema = T.StructType([
        T.StructField("id", docs.schema[id_col].dataType), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()),
    ])

    def run(batch):
        data, offsets = buffers(batch.column(1))
        raw = data.tobytes()
        row, piece, start, length, crc = [], [], [], [], []
        texts = [raw[a:b] for a, b in zip(offsets, offsets[1:], strict=False)]
        for k, ids in enumerate(encoder(tokenizer_path).encode(texts)):
            ids = np.append(ids, np.uint32(end_id)).astype("<u4")
            first = len(ids) % max_tokens or max_tokens
            cuts = [0, *range(first, len(ids) + 1, max_tokens)]
            for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                row.append(k)
                piece.append(p)
                start.append(a)
                length.append(b - a)
                crc.append(zlib.crc32(ids[a:b].tobytes()))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
            names=schema.names,
        )

    return map_texts(docs, [id_col, text_col], run, schema, caches=True, most=slice_bytes)


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, max_tokens: int = 1024, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Pack all documents into few sequences of at most ``max_tokens`` tokens.

    A document is its ids and ``end_id``; one longer than a sequence is cut into full pieces, of
    which the first may be shorter. Returns for each piece: ``id_col``, ``piece``, ``start`` (ids of
    the document before it), ``length``, ``ids_crc32``, ``sequence_id``, ``offset``; offsets of a
    sequence have no gaps. Null and empty texts are the end id alone; rows that repeat an id are
    packed singly; an empty table gives an empty result. Other columns are not read. ``slice_bytes`` of
    texts are encoded together: more take more memory and less time.
    """
    pieces = cut(piece_table(docs, id_col, text_col, tokenizer_path, end_id, max_tokens, slice_bytes).withColumn("part", F.spark_partition_id()))
    counts = cut(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")))
    histogram = np.zeros(max_tokens + 1, np.int64)
    for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most max_tokens rows
        histogram[row["length"]] = row["n"]
    table = slots(plan_sequences(histogram), max_tokens)  # bounded by max_tokens, not by the documents
    before = counts.select("part", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))

    def ranked(frames):
        seen = np.zeros(max_tokens + 1, np.int64)
        for frame in frames:
            frame["rank"] = frame.groupby("length").cumcount() + seen[frame["length"]]
            seen += np.bincount(frame["length"], minlength=max_tokens + 1)
            yield frame

    def placed(frames):
        keys = table[:, 0] << 42 | table[:, 1]
        for frame in frames:
            rank = (frame["rank"] + frame["before"]).to_numpy()
            slot = np.searchsorted(keys, frame["length"].to_numpy() << 42 | rank, "right") - 1
            yield pd.DataFrame({
                "id": frame["id"], "piece": frame["piece"], "start": frame["start"], "length": frame["length"], "ids_crc32": frame["ids_crc32"],
                "sequence_id": table[slot, 2] + rank - table[slot, 1], "offset": table[slot, 3],
            })

    fields = list(pieces.schema)
    with_rank = T.StructType([*fields, T.StructField("rank", T.LongType())])
    out = T.StructType([*(f for f in fields if f.name != "part"), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    ready = pieces.mapInPandas(trimmed(ranked), with_rank).join(before, ["part", "length"])
    return ready.mapInPandas(trimmed(placed), out).withColumnRenamed("id", id_col)
