"""Periodic runs of words, found on a grammar.

Re-Pair turns word ids into a grammar: in each round every pair of neighbouring symbols that is more
frequent than the pairs it overlaps becomes a nonterminal, in all texts of a slice at once; when no
pair repeats, what is left is paired up into a balanced tree. Each run lies whole in the expansion of
the lowest node that spans it and crosses the boundary between that node's two parts. So for each
nonterminal, at one of its places, the runs across its boundary are computed once: periods whose
words agree across the boundary are extended to both sides by comparing blocks of 2, 4, 8.. words.
Runs are then translated to all places where the nonterminal is derived; of intervals with the same
period the maximal ones stay, and of equal intervals the smallest period.

A text without a word sequence of half the least run length that stands in it twice has no run and needs no grammar.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from bindwell.llm.text import SPACED, U64, Words, map_texts, mix

#: Pairs of a nonterminal and a period that are looked at together.
PIECE = 2_000_000
#: Word text of a slice; a longer text is a slice of its own.
SLICE = 2 << 20


class Grammar:
    """Nonterminals of a sequence of word ids cut into documents, with every place where they are derived.

    ``node``, ``place``, ``size`` and ``left`` list the derivation's inner nodes: which nonterminal,
    the first word, the number of words and those of the left part.
    """

    def __init__(self, ids: np.ndarray, doc: np.ndarray):
        self.symbols = int(ids.max(initial=-1)) + 1
        self.node, self.place, self.size, self.left = [], [], [], []
        symbol, place = ids.astype(np.int64), np.arange(len(ids))
        size, doc = np.ones(len(ids), np.int64), np.asarray(doc)
        while (chosen := self._frequent(symbol, doc)) is not None:
            symbol, place, size, doc = self._replaced(symbol, place, size, doc, *chosen)
        while len(chosen := self._neighbours(doc)):
            names = np.arange(self.symbols, self.symbols + len(chosen))
            symbol, place, size, doc = self._replaced(symbol, place, size, doc, chosen, names)
        self.node, self.place, self.size, self.left = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (self.node, self.place, self.size, self.left))

    def _frequent(self, symbol, doc):
        """Where pairs that are more frequent than their neighbours stand, and the nonterminals to put there."""
        if len(symbol) < 2:
            return None
        pair = symbol[:-1] * self.symbols + symbol[1:] if self.symbols < 1 << 31 else np.unique(np.stack([symbol[:-1], symbol[1:]]), axis=1, return_inverse=True)[1]
        inside = doc[:-1] == doc[1:]
        kinds, kind, count = np.unique(pair[inside], return_inverse=True, return_counts=True)
        rank = np.zeros(len(pair) + 2, np.int64)  # 0 for what can't be chosen; places are shifted by one
        by_count = np.argsort(np.argsort(count, kind="stable"), kind="stable") + 1
        rank[1:-1][inside] = np.where(count > 1, by_count, 0)[kind]
        if not rank.any():
            return None
        # in "aaa" the pair overlaps itself: every other place of such a streak counts
        same = np.zeros(len(pair), bool)
        same[1:] = inside[1:] & inside[:-1] & (pair[1:] == pair[:-1])
        start = np.maximum.accumulate(np.where(same, 0, np.arange(len(pair))))
        rank[1:-1][(np.arange(len(pair)) - start) % 2 == 1] = 0
        at = np.flatnonzero((rank[1:-1] > rank[:-2]) & (rank[1:-1] > rank[2:]))
        names = np.unique(pair[at], return_inverse=True)[1] + self.symbols
        return at, names

    @staticmethod
    def _neighbours(doc):
        """Every other neighbour within each document."""
        if len(doc) < 2:
            return np.empty(0, np.int64)
        new = np.append(True, doc[1:] != doc[:-1])
        start = np.maximum.accumulate(np.where(new, np.arange(len(doc)), 0))
        even = (np.arange(len(doc)) - start) % 2 == 0
        return np.flatnonzero(even[:-1] & (doc[:-1] == doc[1:]))

    def _replaced(self, symbol, place, size, doc, at, names):
        self.node.append(names)
        self.place.append(place[at])
        self.left.append(size[at])
        self.symbols = int(names.max()) + 1
        symbol, size = symbol.copy(), size.copy()
        symbol[at] = names
        size[at] += size[at + 1]
        self.size.append(size[at])
        stays = np.ones(len(symbol), bool)
        stays[at + 1] = False
        return symbol[stays], place[stays], size[stays], doc[stays]


class Blocks:
    """How far two places of a sequence agree, forwards and backwards, by the names of its blocks of 2^k symbols."""

    def __init__(self, ids: np.ndarray, longest: int):
        self.names, self.n = [ids.astype(np.int32)], len(ids)
        while (width := 1 << len(self.names)) <= min(longest, self.n):
            last = self.names[-1].astype(np.int64)
            both = last[: self.n - width + 1] * (self.n + 1) + last[width // 2 : self.n - width // 2 + 1]
            self.names.append(np.unique(both, return_inverse=True)[1].astype(np.int32))

    def ahead(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Symbols from ``a`` and from ``b`` > ``a`` on that agree."""
        reach = np.zeros(len(a), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            names = self.names[k]
            fits = b + reach < len(names)
            x, y = np.where(fits, a + reach, 0), np.where(fits, b + reach, 0)
            reach += (fits & (names[x] == names[y])).astype(np.int64) << k
        return reach

    def back(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Symbols up to ``a`` and up to ``b`` > ``a``, themselves included, that agree."""
        reach = np.zeros(len(a), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            names, width = self.names[k], 1 << k
            fits = a - reach - width + 1 >= 0
            x, y = np.where(fits, a - reach - width + 1, 0), np.where(fits, b - reach - width + 1, 0)
            reach += (fits & (names[x] == names[y])).astype(np.int64) << k
        return reach


def _across(ids, blocks, first, middle, end, least):
    """(nonterminal, start, length, period) of the runs across the boundary ``middle`` of each expansion [first, end)."""
    found = []
    size = end - first
    for side in ("right", "left"):
        periods = np.minimum(end - middle if side == "right" else middle - first, size // 2)
        bounds = np.concatenate(([0], np.cumsum(periods)))
        begin = 0
        while begin < len(first):
            stop = max(int(np.searchsorted(bounds, bounds[begin] + PIECE, "right")) - 1, begin + 1)
            which = np.repeat(np.arange(begin, stop), periods[begin:stop])
            q = np.arange(bounds[begin], bounds[stop]) - bounds[which] + 1
            a = middle[which] - (1 if side == "right" else q)  # word a and word a + q must agree
            hit = np.flatnonzero(ids[a] == ids[a + q])
            which, q, a = which[hit], q[hit], a[hit]
            reach = np.minimum(blocks.ahead(a, a + q), end[which] - a - q)
            back = np.minimum(blocks.back(a, a + q), a - first[which] + 1)
            agree = reach + back - 1
            run = np.flatnonzero((agree >= q) & (agree + q >= least))
            found.append(np.stack([which[run], a[run] - back[run] + 1, agree[run] + q[run], q[run]]))
            begin = stop
    return np.concatenate(found, axis=1) if found else np.empty((4, 0), np.int64)


def maximal_runs(ids: np.ndarray, doc: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all maximal runs of ``least`` words or more and two periods or more, by start and period.

    ``ids`` are dense ids of the words of some documents one after the other, ``doc`` their documents' numbers.
    """
    grammar = Grammar(ids, doc)
    big = np.flatnonzero(grammar.size >= least)
    if not len(big):
        return (np.empty(0, np.int64),) * 3
    node, place, size, left = (x[big] for x in (grammar.node, grammar.place, grammar.size, grammar.left))
    order = np.argsort(node, kind="stable")
    node, place, size, left = node[order], place[order], size[order], left[order]
    once = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
    times = np.diff(np.append(once, len(node)))
    first = place[once]
    which, start, length, period = _across(ids, Blocks(ids, int(size.max())), first, first + left[once], first + size[once], least)
    if not len(which):
        return (np.empty(0, np.int64),) * 3
    # translate to every place of the nonterminal
    many = times[which]
    run = np.repeat(np.arange(len(which)), many)
    nth = np.arange(len(run)) - np.repeat(np.cumsum(many) - many, many)
    start = (start - first[which])[run] + place[once[which[run]] + nth]
    length, period = length[run], period[run]
    end = start + length
    # maximal intervals of each period
    order = np.lexsort((-end, start, period))
    start, end, period = start[order], end[order], period[order]
    level = np.cumsum(np.append(True, period[1:] != period[:-1])) * (len(ids) + 1)
    reach = np.maximum.accumulate(end + level)
    keep = np.append(True, (end + level)[1:] > reach[:-1])
    start, end, period = start[keep], end[keep], period[keep]
    # the smallest period of equal intervals
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    keep = np.append(True, (start[1:] != start[:-1]) | (end[1:] != end[:-1]))
    start, end, period = start[keep], end[keep], period[keep]
    order = np.lexsort((period, start))
    return start[order], (end - start)[order], period[order]


def _suspects(words: Words, least: int) -> np.ndarray:
    """Rows with a sequence of half of ``least`` words that stands in them twice."""
    n = max(1, (least + 1) // 2)
    at, grams = words.grams(n)
    if not len(at):
        return np.empty(0, np.int64)
    rows = words.row[at]
    keys = mix(grams + rows.astype(U64) * U64(0x9E3779B97F4A7C15))
    order = np.argsort(keys, kind="stable")
    again = np.flatnonzero(keys[order][1:] == keys[order][:-1])
    return np.unique(rows[order[again]])


def runs_of_slice(words: Words, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start in the row, length, period) of the runs of all texts of a slice."""
    suspects = _suspects(words, least)
    if not len(suspects):
        return (np.empty(0, np.int64),) * 4
    count = words.count[suspects]
    own = np.arange(count.sum()) + np.repeat(words.first[suspects] - (np.cumsum(count) - count), count)
    ids = np.unique(words.hash[own], return_inverse=True)[1]
    start, length, period = maximal_runs(ids, np.repeat(suspects, count), least)
    row = np.repeat(suspects, count)[start] if len(start) else np.empty(0, np.int64)
    return row, own[start] - words.first[row] if len(start) else start, length, period


def _collapsed(text: bytes, runs: list[tuple[int, int, int]]) -> bytes:
    """The words of ``text`` but for those that a run holds after its first period, joined by one space."""
    said = text.split()
    if runs:
        change = np.zeros(len(said) + 1, np.int64)
        for start, length, period in runs:
            change[start + period] += 1
            change[start + length] -= 1
        said = [said[k] for k in np.flatnonzero(np.cumsum(change)[:-1] == 0)]
    return b" ".join(said)


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 12) -> DataFrame:
    """The periodic runs of each text, and the text with each run cut to its first period.

    Words are separated by ASCII white space and compared by 64-bit hashes. A run is a maximal stretch
    of at least ``least`` words and twice its smallest period. Returns for each row: ``id_col``,
    ``n_words``, ``runs`` (array of start, length, period; by start, then period) and ``collapsed``.

    Null, empty and blank texts have no words, no runs and an empty ``collapsed``; rows are
    independent, so repeated rows and ids give repeated results; an empty table gives an empty
    result. A text is read whole, in one task, with about 150 bytes of memory a word. Other columns
    are not read.
    """
    run_type = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
    schema = T.StructType([
        T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(run_type)), T.StructField("collapsed", T.StringType()),
    ])

    def find(batch):
        words = Words(batch.column(1), SPACED, lower=False)
        row, start, length, period = runs_of_slice(words, least)
        order = np.lexsort((period, start, row))
        row, start, length, period = row[order], start[order], length[order], period[order]
        offsets = np.searchsorted(row, np.arange(words.rows + 1))
        lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.StructArray.from_arrays([pa.array(x) for x in (start, length, period)], names=["start", "length", "period"]))
        texts = []
        for k, text in enumerate(batch.column(1)):
            mine = slice(offsets[k], offsets[k + 1])
            texts.append(_collapsed(text.as_buffer().to_pybytes() if text.is_valid else b"", list(zip(start[mine], length[mine], period[mine], strict=True))))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words.count), lists, pa.array(texts, pa.binary()).cast(pa.string())], names=schema.names)

    return map_texts(docs, [id_col, text_col], find, schema, most=SLICE)
