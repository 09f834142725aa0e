"""Benchmark decontamination as a prefix-filtered set join.

A benchmark window is the set of its short word shingles. A document contains the window only if it
contains all of them, so for containment 1 the necessary prefix under the rarity order is a single
shingle: the window's rarest one in the corpus. Two passes over the documents, no shuffle of text:

1. count how often each benchmark shingle occurs in the documents (partial sums, then one groupBy);
2. join each document's shingles with the windows' rarest shingles; the prefix token's position
   fixes where the window would begin, which gives the length and positional bounds; the window of
   exactly that many words is then compared whole.

Windows are cut and hashed in tasks and come to the driver as packed arrays, a block of at most
``block_windows`` at a time: some 330 bytes a window while a block's prefixes are chosen (50 MB at the
default), 110 in the table that is broadcast. A larger benchmark takes more passes over the documents,
which are then stored once with a key for each row, by which the passes' hits are merged.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bindwell.llm.store import cut, fresh_path
from bindwell.llm.text import ALNUM, U64, Words, in_batches, map_texts, portions

#: Words of a shingle; a shorter window is one shingle.
SHINGLE = 4
_FILTER = 1 << 20
#: Windows that a task packs into a row.
PART = 25_000
#: The key of a stored row.
_ROW = "__row"


@dataclass
class Windows:
    """Benchmark windows in columns: size in words, whole hash, item, and their shingles' hashes."""

    size: np.ndarray
    whole: np.ndarray
    item: np.ndarray
    shingles: np.ndarray  # one row a window, padded with the last shingle

    def take(self, which) -> Windows:
        return Windows(self.size[which], self.whole[which], self.item[which], self.shingles[which])


def _gram_size(size):
    return np.minimum(size, SHINGLE)


def _windows_of(items: DataFrame, item_col: str, text_col: str, window: int, most: int) -> DataFrame:
    """The items' windows as arrays, at most ``most`` windows a row: names, and of each window its name's place, size, hash and shingles."""
    schema = T.StructType([T.StructField("names", T.ArrayType(T.StringType())), *(T.StructField(c, T.BinaryType()) for c in ("item", "size", "whole", "shingles"))])
    width = max(window - SHINGLE + 1, 1)

    def run(batch):
        words = Words(batch.column(1), ALNUM, lower=True)
        item, size, whole, shingles = [], [], [], []
        for row in np.flatnonzero(words.count):
            n, first = int(words.count[row]), int(words.first[row])
            m = min(n, window)
            g = min(m, SHINGLE)
            at = np.arange(first, first + n - m + 1)
            grams = words.gram_at(np.arange(first, first + n - g + 1), g)
            whole.append(words.gram_at(at, m))
            shingles.append(grams[(at - first)[:, None] + np.minimum(np.arange(width), m - g)])
            size.append(np.full(len(at), m, np.int32))
            item.append(np.full(len(at), row, np.int32))
        if not item:
            return
        item, size, whole, shingles = (np.concatenate(x) for x in (item, size, whole, shingles))
        for k in range(0, len(item), most):
            here = slice(k, k + most)
            rows, place = np.unique(item[here], return_inverse=True)
            names = pa.array([batch.column(0).take(pa.array(rows)).to_pylist()], pa.list_(pa.string()))
            arrays = (place.astype(np.int32), size[here], whole[here], shingles[here])
            yield pa.RecordBatch.from_arrays([names, *(pa.array([x.tobytes()], pa.binary()) for x in arrays)], names=schema.names)

    named = items.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("string").alias("name"), F.col(text_col).alias("text"))
    return map_texts(named, ["name", "text"], run, schema)


def _blocks(items: DataFrame, item_col: str, text_col: str, window: int, block_windows: int):
    """The benchmark's windows in blocks that are small enough to broadcast, each as a list of rows of ``_windows_of``."""
    windows = cut(_windows_of(items, item_col, text_col, window, min(block_windows, PART)))
    held, size = [], 0
    # a partition comes to the driver whole: some rows each
    for row in windows.repartition(-(-windows.count() // 4) or 1).toLocalIterator():
        n = len(row["item"]) // 4
        if held and size + n > block_windows:
            yield held
            held, size = [], 0
        held.append(row)
        size += n
    if held:
        yield held


def _columns(rows: list, window: int) -> tuple[Windows, np.ndarray]:
    names = np.array(sorted({x for r in rows for x in r["names"]}), object)
    number = {x: k for k, x in enumerate(names)}
    joined = lambda c, kind: np.frombuffer(b"".join(r[c] for r in rows), kind)
    item = np.concatenate([np.array([number[x] for x in r["names"]], np.int64)[np.frombuffer(r["item"], np.int32)] for r in rows])
    return Windows(joined("size", np.int32).astype(np.int64), joined("whole", U64), item, joined("shingles", U64).reshape(-1, max(window - SHINGLE + 1, 1))), names


def _lookup(sorted_keys: np.ndarray):
    """(positions, key index) of the hashes that are among ``sorted_keys``; a bit table spares most searches."""
    table = np.zeros(_FILTER, bool)
    table[(sorted_keys & U64(_FILTER - 1)).astype(np.int64)] = True

    def find(hashes):
        at = np.flatnonzero(table[(hashes & U64(_FILTER - 1)).astype(np.int64)])
        if not len(at):
            return at, at
        key = np.searchsorted(sorted_keys, hashes[at])
        key[key == len(sorted_keys)] = 0
        same = sorted_keys[key] == hashes[at]
        return at[same], key[same]

    return find


def _frequencies(docs: DataFrame, text_col: str, shingles: np.ndarray, sizes: list[int]) -> np.ndarray:
    """How often each of the (sorted, distinct) shingle hashes occurs in the documents."""
    keys = docs.sparkSession.sparkContext.broadcast(shingles)

    def run(batches):
        find, counts = _lookup(keys.value), np.zeros(len(keys.value), np.int64)
        for batch in batches:
            for part in portions(batch, 0):
                words = Words(part.column(0), ALNUM, lower=True)
                for n in sizes:
                    _, key = find(words.grams(n)[1])
                    counts += np.bincount(key, minlength=len(counts))
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[seen])], names=["k", "n"])

    out = np.zeros(len(shingles), np.int64)
    counted = in_batches(docs).select(text_col).mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))
    for row in counted.toLocalIterator():
        out[row["k"]] = row["n"]
    keys.destroy()
    return out


def _hits(docs: DataFrame, id_col: str, text_col: str, windows: Windows, names: np.ndarray, merge: bool, carry: tuple[str, ...] = ()) -> DataFrame:
    """For each document its words, hit words and items; with ``merge`` hit ranges and items instead."""
    sizes = sorted(set(_gram_size(windows.size).tolist()))
    shingles = np.unique(windows.shingles)
    often = _frequencies(docs, text_col, shingles, sizes)
    # the rarest shingle of each window (ties by hash) and its place in the window
    width = windows.size - _gram_size(windows.size) + 1
    number = np.searchsorted(shingles, windows.shingles)
    rank = np.empty(len(shingles), np.int64)
    rank[np.lexsort((shingles, often))] = np.arange(len(shingles))
    ranks = np.where(np.arange(windows.shingles.shape[1]) < width[:, None], rank[number], np.iinfo(np.int64).max)
    place = ranks.argmin(axis=1)
    prefix = windows.shingles[np.arange(len(place)), place]
    order = np.argsort(prefix, kind="stable")
    table = docs.sparkSession.sparkContext.broadcast((prefix[order], place[order], windows.take(order), names))
    schema = T.StructType([
        T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
        T.StructField("n_items", T.LongType()), T.StructField("items_sha256", T.StringType()), T.StructField("contaminated", T.BooleanType()),
        *([T.StructField("ranges", T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in "ab"]))), T.StructField("items", T.ArrayType(T.StringType()))] if merge else []),
        *(docs.schema[c] for c in carry),
    ])
    nothing = hashlib.sha256(b"").hexdigest()

    def run(batch):
        keys, place, w, names = table.value
        words = Words(batch.column(batch.num_columns - 1), ALNUM, lower=True)
        distinct, first = np.unique(keys, return_index=True)
        ends = np.append(first[1:], len(keys))
        find = _lookup(distinct)
        begins, which = [], []
        for n in sizes:
            at, hashes = words.grams(n)
            pos, key = find(hashes)
            pos = at[pos]
            many = ends[key] - first[key]
            window = np.repeat(first[key], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            pos = np.repeat(pos, many)
            begin = pos - place[window]
            row = words.row[pos]
            fits = (_gram_size(w.size[window]) == n) & (begin >= words.first[row]) & (begin + w.size[window] <= words.first[row + 1])
            begin, window = begin[fits], window[fits]
            for m in np.unique(w.size[window]):
                mine = np.flatnonzero(w.size[window] == m)
                same = words.gram_at(begin[mine], int(m)) == w.whole[window[mine]]
                begins.append(begin[mine[same]])
                which.append(window[mine[same]])
        begins = np.concatenate(begins) if begins else np.empty(0, np.int64)
        which = np.concatenate(which) if which else np.empty(0, np.int64)
        change = np.zeros(len(words.hash) + 1, np.int64)
        np.add.at(change, begins, 1)
        np.add.at(change, begins + w.size[which], -1)
        hit = np.cumsum(change)[:-1] > 0
        n_hit = np.bincount(words.row[hit], minlength=words.rows)
        rows = words.row[begins]
        n_items, digest = np.zeros(words.rows, np.int64), [nothing] * words.rows
        ranges, items = [[] for _ in range(words.rows)], [[] for _ in range(words.rows)]
        pairs = np.unique(np.stack([rows, w.item[which]]), axis=1) if len(rows) else np.empty((2, 0), np.int64)
        for row in np.unique(pairs[0]):
            found = sorted(names[pairs[1][pairs[0] == row]])
            n_items[row], digest[row] = len(found), hashlib.sha256(",".join(found).encode()).hexdigest()
            items[row] = found
        if merge and len(begins):
            for row, a, m in sorted(set(zip(rows.tolist(), (begins - words.first[rows]).tolist(), w.size[which].tolist(), strict=True))):
                ranges[row].append({"a": a, "b": a + m})
        arrays = [
            batch.column(0), pa.array(words.count, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(n_items, pa.int64()), pa.array(digest),
            pa.array((n_hit > 0) & (20 * n_hit >= words.count)),
        ]
        if merge:
            arrays += [pa.array(ranges, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), pa.array(items, pa.list_(pa.string()))]
        arrays += [batch.column(columns.index(c)) for c in carry]
        yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    columns = [id_col, *(c for c in carry if c not in (id_col, text_col)), text_col]
    return map_texts(docs, columns, run, schema)


def _merged(parts: list[DataFrame], key: str) -> DataFrame:
    """Join of several blocks' hits by the key of a row: hit words are those in the union of the ranges."""
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)

    joined = every.groupBy(key).agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list("ranges"))).alias("ranges"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    # in order of their begin, each range adds what lies beyond the ones before it
    none, beyond = F.lit(0).cast("long"), lambda x, reach: F.greatest(x["b"] - F.greatest(x["a"], reach), F.lit(0))
    step = lambda acc, x: F.struct((acc["n"] + beyond(x, acc["reach"])).alias("n"), F.greatest(acc["reach"], x["b"]).alias("reach"))
    joined = joined.withColumn("n_hit", F.aggregate("ranges", F.struct(none.alias("n"), none.alias("reach")), step, lambda acc: acc["n"]))
    return joined.select(
        key, "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 13,
    block_windows: int = 150_000,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Which words of each document lie in an occurrence of a benchmark window.

    Words are lower-cased (A-Z) runs of letters, digits and non-ASCII characters. A window is
    ``window`` consecutive words of an item; a shorter item with words is one window.
    Returns for each row: ``id_col``, ``n_words``, ``n_hit``, ``n_items``, ``items_sha256``,
    ``contaminated`` (a hit and at least a twentieth of the words hit), then the columns named in
    ``carry``.

    Null or wordless texts have no words and no hits; an item without id or words has no windows;
    items with the same id count once; an empty table or benchmark gives no rows or no hits. Other
    columns are not read. Rows are judged singly, also those without an id or that repeat one. The
    benchmark's size and ``block_windows`` change the number of passes, never the rows.
    """
    blocks = _blocks(benchmark, item_col, item_text_col, window, block_windows)
    block = next(blocks, [])
    more = next(blocks, None)
    if more is None:
        if block:
            windows, names = _columns(block, window)
        else:
            windows, names = Windows(np.empty(0, np.int64), np.empty(0, U64), np.empty(0, np.int64), np.empty((0, 1), U64)), np.empty(0, object)
        return _hits(docs, id_col, text_col, windows, names, merge=False, carry=carry)
    path = fresh_path(docs.sparkSession, "rows")
    columns = dict.fromkeys((id_col, *carry, text_col))
    docs.select(F.monotonically_increasing_id().alias(_ROW), *columns).write.parquet(path)
    rows = docs.sparkSession.read.parquet(path)
    parts: list[DataFrame] = []
    while block:
        windows, names = _columns(block, window)
        parts.append(_hits(rows, _ROW, text_col, windows, names, merge=True))
        block, more = (more or []), next(blocks, None)
    judged = _merged(parts, _ROW).join(rows.select(_ROW, *dict.fromkeys((id_col, *carry))), _ROW)
    return judged.select(id_col, "n_words", "n_hit", "n_items", "items_sha256", "contaminated", *carry)
