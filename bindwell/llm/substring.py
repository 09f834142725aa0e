"""Substring deduplication with a compressed FM-index per shard.

A repeated window of words can only be found where its copies meet. Every window is represented by
its anchor, the five-word run in it with the smallest hash, so equal windows have equal anchors; the
windows of a document fall into segments, runs of windows with one anchor. The steps:

1. anchors of all documents are shuffled (a key, an id and a place each); those that occur once drop out;
2. the documents of the others give their segments' words, shuffled by anchor: a shard is a range of
   anchors, with every segment that may hold copies of its windows and no others;
3. a task builds an FM-index (BWT in a wavelet matrix) over its shard's distinct segments, a bounded
   number of words at a time, and streams the segments' windows through backward search. Windows whose
   matching statistic reaches the window length are repeats; their suffix range tells the smallest id;
4. windows that occur in a document with a smaller id give the word ranges to remove.

An anchor with more than ``most`` places is not gathered: its windows are grouped one by one, summed
before they are shuffled. Documents without anything to remove are never moved.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindwell.llm.fmindex import FMIndex
from bindwell.llm.store import bounded, cut
from bindwell.llm.text import SPACED, U64, Words, map_texts

ANCHOR = 5
#: Words of an index and places of a task's portion.
INDEX_WORDS, INDEX_PLACES = 1_000_000, 200_000


def anchors(words: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segments of all rows: first word of the first window, number of windows, hash of the anchor."""
    size = len(words.hash) - window + 1
    if size <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, U64)
    anchor = min(ANCHOR, window)
    grams = words.gram_at(np.arange(len(words.hash) - anchor + 1), anchor)
    best, at = grams[:size].copy(), np.arange(size)
    for k in range(1, window - anchor + 1):
        less = grams[k : k + size] < best
        best[less] = grams[k : k + size][less]
        at[less] = np.flatnonzero(less) + k
    inside = np.flatnonzero(words.row[:size] == words.row[window - 1 :])
    at, row = at[inside], words.row[inside]
    new = np.ones(len(inside), bool)
    new[1:] = (at[1:] != at[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    return inside[first], np.diff(np.append(first, len(inside))), grams[at[first]]


def _anchor_rows(docs: DataFrame, window: int) -> DataFrame:
    """(key, id, place): ``place`` is the first word in its document times 16 plus the number of windows."""

    def run(batch):
        words = Words(batch.column(1), SPACED, lower=False)
        at, count, key = anchors(words, window)
        row = words.row[at]
        place = (at - words.first[row]) * 16 + count
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column(0).take(pa.array(row)), pa.array(place)], names=["key", "id", "place"])

    return map_texts(docs.where("id is not null"), ["id", "text"], run, "key long, id long, place long")


def _repeated_anchors(rows: DataFrame, most: int) -> DataFrame:
    """(id, place, hot) of the anchors with two places or more; ``hot`` from the place ``most`` on."""

    def emit(ident, place, count):
        return pa.RecordBatch.from_arrays([pa.array(ident), pa.array(place), pa.array(count > most)], names=["id", "place", "hot"])

    def run(batches):
        key, ident, place = (np.empty(0, np.int64) for _ in range(3))
        for batch in batches:
            key, ident, place = (np.append(a, batch.column(k).to_numpy()) for k, a in enumerate((key, ident, place)))
            if not len(key) or len(key) <= most and key[0] == key[-1]:
                continue
            # the last key may go on, unless it is over the limit already
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            count = np.diff(np.append(first, len(key)))
            size = np.repeat(count, count)
            end = first[-1] if count[-1] <= most else len(key)
            keep = np.flatnonzero(size[:end] > 1)
            yield emit(ident[keep], place[keep], size[keep])
            if end == len(key):  # the rest of a hot key goes on as hot
                hot_key = key[-1]
                key, ident, place = np.array([hot_key] * (most + 1)), np.full(most + 1, -1), np.full(most + 1, -1)
            else:
                key, ident, place = key[end:], ident[end:], place[end:]
        if len(key):
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            count = np.diff(np.append(first, len(key)))
            size = np.repeat(count, count)
            keep = np.flatnonzero(size > 1)
            yield emit(ident[keep], place[keep], size[keep])

    ordered = rows.repartition("key").sortWithinPartitions("key")
    return ordered.mapInArrow(run, "id long, place long, hot boolean").where("place >= 0")


def _packed(docs: DataFrame) -> DataFrame:
    """(id, th, packed): texts as zstandard frames, for the way through a shuffle."""

    def run(batch):
        pack = zstandard.ZstdCompressor(level=3).compress
        packed = pa.array([pack(x.as_buffer()) for x in batch.column(2)], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed], names=["id", "th", "packed"])

    return map_texts(docs, ["id", "th", "text"], run, "id long, th long, packed binary")


def _unpacked(column: pa.Array) -> pa.Array:
    unpack = zstandard.ZstdDecompressor().decompress
    return pa.array([unpack(x.as_buffer()) for x in column], pa.binary()).cast(pa.string())


def _words_of(text: pa.Scalar) -> list[bytes]:
    """The words of a text; bytes are cut at the same ASCII white space as ``SPACED`` says."""
    return text.as_buffer().to_pybytes().split()


def _with_text(docs: DataFrame, lists: DataFrame, keys: list[str]) -> DataFrame:
    """Documents that have a list, with it. Others' texts are not moved while the ids are few."""
    ids = cut(lists.select(F.col("id").alias("__id")).distinct())
    some = docs.join(bounded(ids), docs["id"] == F.col("__id"), "left_semi")
    return _packed(some).join(lists, keys)


def _segments(docs: DataFrame, repeated: DataFrame, window: int, single: bool) -> DataFrame:
    """(key, id, th, start, words): the words of repeated segments, by anchor.

    With ``single`` (id, th, key, start) of each of their windows, the key being the window's own hash.
    """
    lists = repeated.groupBy("id").agg(F.collect_list("place").alias("list"))

    def run(batch):
        words = Words(_unpacked(batch.column(3)), SPACED, lower=False)
        at, count, key = anchors(words, window)
        own = words.row[at]
        offsets = batch.column(2).offsets.to_numpy()
        wanted = batch.column(2).values.to_numpy()[offsets[0] : offsets[-1]]
        row = np.repeat(np.arange(words.rows), np.diff(offsets))
        # rows that repeat an id have each other's places too: only a row's own segments count
        mine = np.stack([own, (at - words.first[own]) * 16 + count], axis=1)
        keep = np.flatnonzero(_among(mine, np.stack([row, wanted], axis=1)))
        at, count, key, own = at[keep], count[keep], key[keep], own[keep]
        if single:
            shift = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            at, own = np.repeat(at, count) + shift, np.repeat(own, count)
            key = words.gram_at(at, window)
        columns = [pa.array(key.view(np.int64)), batch.column(0).take(pa.array(own)), batch.column(1).take(pa.array(own)), pa.array(at - words.first[own])]
        if not single:
            columns.append(pa.array([words.span(int(a), int(n) + window - 1) for a, n in zip(at, count, strict=True)], pa.binary()))
        yield pa.RecordBatch.from_arrays(columns, names=["key", "id", "th", "start", "words"][: len(columns)])

    schema = "key long, id long, th long, start long" + ("" if single else ", words binary")
    return map_texts(_with_text(docs, lists, ["id"]), ["id", "th", "list", "packed"], run, schema)


def _among(pairs: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which of ``pairs`` (row, place) are among ``wanted``."""
    size = int(max(pairs[:, 1].max(initial=0), wanted[:, 1].max(initial=0))) + 1
    return np.isin(pairs[:, 0] * size + pairs[:, 1], wanted[:, 0] * size + wanted[:, 1])


def covered_windows(keys, ids, contents: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, window) of the windows of each place's words that a place with a smaller id has too.

    Places with the same key can share windows. Distinct words are indexed once, with their smallest
    id; words that are alone under their key need no index.
    """
    frame = pd.DataFrame({"key": keys, "words": contents, "id": ids})
    number = frame.groupby(["key", "words"], sort=False).ngroup().to_numpy()
    distinct = np.unique(number, return_index=True)[1]
    smallest = np.full(len(distinct), np.iinfo(np.int64).max)
    np.minimum.at(smallest, number, ids)
    words = Words(pa.array([contents[k] for k in distinct], pa.binary()).cast(pa.string()), SPACED, lower=False)
    n_windows = words.count - window + 1
    first_window = np.concatenate(([0], np.cumsum(n_windows)))
    best = np.repeat(smallest, n_windows)
    key_of = np.asarray(keys)[distinct]
    shared = np.unique(key_of, return_inverse=True, return_counts=True)
    several = np.flatnonzero(shared[2][shared[1]] > 1)
    if len(several):
        chosen = np.zeros(words.rows, bool)
        chosen[several] = True
        own = np.flatnonzero(chosen[words.row])
        owner = words.row[own]
        place = np.arange(len(own)) + np.searchsorted(several, owner)  # a separator after each segment
        codes = np.zeros(len(own) + len(several) + 1, np.int32)
        codes[place] = np.unique(words.hash[own], return_inverse=True)[1] + 1
        by_place = np.full(len(codes), len(distinct), np.int32)  # segments in order of their smallest id
        order = np.argsort(smallest, kind="stable")
        by_place[place] = np.argsort(order, kind="stable")[owner]
        index = FMIndex(codes, window, by_place)
        inner = own - words.first[owner]
        begins = inner < n_windows[owner]
        at, which = place[begins], (first_window[owner] + inner)[begins]
        reach, low, high = index.matching_statistics(codes, at + window - 1, window)
        above = np.flatnonzero(reach == window)
        if len(above):
            least = index.least_owner(low[above], high[above])
            best[which[above]] = smallest[order[least]]
    windows = n_windows[number]
    owner = np.repeat(np.arange(len(number)), windows)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    less = best[first_window[number[owner]] + inner] < np.asarray(ids)[owner]
    return owner[less], inner[less]


def _cold_ranges(segments: DataFrame, window: int) -> DataFrame:
    """(id, th, a, b): word ranges of repeated windows, from the indexes of the shards."""

    def ranges(frame: pd.DataFrame) -> pd.DataFrame:
        owner, inner = covered_windows(frame["key"].to_numpy(), frame["id"].to_numpy(), frame["words"].tolist(), window)
        if not len(owner):
            return pd.DataFrame({"id": [], "th": [], "a": [], "b": []}, dtype="int64")
        new = np.append(True, (owner[1:] != owner[:-1]) | (inner[1:] != inner[:-1] + 1))
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(owner)) - 1
        own = owner[first]
        start = frame["start"].to_numpy()[own]
        return pd.DataFrame({"id": frame["id"].to_numpy()[own], "th": frame["th"].to_numpy()[own], "a": start + inner[first], "b": start + inner[last] + window})

    def run(frames):
        held, n_words, n_places = [], 0, 0
        for frame in frames:
            held.append(frame)
            n_words += int(frame["words"].map(len).sum()) // 6
            n_places += len(frame)
            if n_words < INDEX_WORDS and n_places < INDEX_PLACES:
                continue
            whole = pd.concat(held, ignore_index=True)
            last = int((whole["key"] != whole["key"].iat[-1]).sum())  # the last key may go on
            if last:
                yield ranges(whole.iloc[:last].reset_index(drop=True))
            held = [whole.iloc[last:]]
            n_words, n_places = int(held[0]["words"].map(len).sum()) // 6, len(held[0])
        if held:
            yield ranges(pd.concat(held, ignore_index=True))

    return segments.repartition("key").sortWithinPartitions("key").mapInPandas(run, "id long, th long, a long, b long")


def _hot_ranges(hot: DataFrame, window: int) -> DataFrame:
    """(id, th, a, b) of windows grouped one by one; only sums are shuffled with a hot window's key."""
    hot = cut(hot)
    least = cut(hot.groupBy("key").agg(F.min("id").alias("least")))
    return hot.join(least, "key").where("least < id").select("id", "th", F.col("start").alias("a"), (F.col("start") + window).alias("b"))


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, most: int = 50_000) -> DataFrame:
    """Remove the words of every window that also starts in a document with a smaller id.

    Words are white-space separated, unchanged. Windows are judged on the input. Ids are integers.
    Returns for each row: ``id_col``, ``n_words``, ``n_removed``, ``kept_sha256`` (of the kept words
    joined by one space). Null and empty texts have no words; texts shorter than ``window`` lose
    none. A row without an id loses nothing and takes nothing from others; rows with the same id
    take nothing from each other. An empty table gives an empty result. Other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    mine = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))

    def digest(words: list[bytes]) -> str:
        return hashlib.sha256(b" ".join(words)).hexdigest()

    def whole(batch):
        words = [_words_of(x) for x in batch.column(2)]
        counts = pa.array([len(w) for w in words], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), counts, pa.array([digest(w) for w in words], pa.string())], names=["id", "th", "n_words", "all"])

    def kept(batch):
        removed, rest = [], []
        for ranges, text in zip(batch.column(2), _unpacked(batch.column(3)), strict=True):
            words = _words_of(text)
            change = np.zeros(len(words) + 1, np.int64)
            np.add.at(change, ranges.values.field(0).to_numpy(), 1)
            np.add.at(change, ranges.values.field(1).to_numpy(), -1)
            stays = np.cumsum(change)[:-1] == 0
            removed.append(len(words) - int(stays.sum()))
            rest.append(digest([words[k] for k in np.flatnonzero(stays)]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(rest, pa.string())], names=["id", "th", "n_removed", "rest"])

    every = map_texts(mine, ["id", "th", "text"], whole, "id long, th long, n_words long, all string")
    repeated = cut(_repeated_anchors(_anchor_rows(mine, window), most))
    ranges = _cold_ranges(_segments(mine, repeated.where("not hot"), window, single=False), window)
    hot = repeated.where("hot")
    if not hot.isEmpty():
        ranges = ranges.unionByName(_hot_ranges(_segments(mine, hot, window, single=True), window))
    lists = ranges.distinct().groupBy("id", "th").agg(F.collect_list(F.struct("a", "b")).alias("list"))
    changed = map_texts(_with_text(mine, cut(lists), ["id", "th"]), ["id", "th", "list", "packed"], kept, "id long, th long, n_removed long, rest string")
    joined = every.join(changed.distinct(), ["id", "th"], "left")
    return joined.select(
        F.col("id").alias(id_col), "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("rest", "all").alias("kept_sha256")
    )
