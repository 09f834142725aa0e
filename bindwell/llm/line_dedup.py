"""Fuzzy line deduplication with SimHash by blocks.

Lines are normalised (lower case, digits as 0, other signs as spaces); equal normalised lines are one
node from the start, however often they occur. Lines that share a join key are candidates, are then
filtered by their sketches and verified by edit similarity. Of each connected group the first
occurrence stays.

The rows that are sorted by key carry size and sketch, so all pairs of a key with few lines are filtered where
they meet and nothing else is joined. Of a key with more lines each meets the key's first one there, later the one
that shares most keys with others; what is still in different components is compared in cells of bounded size, with the
lines' words beside them: a cell gives links, and no more of them than it has lines.

* SimHash by blocks: the distinct words of a line are dealt by hash to the blocks of its size band, and
  a word votes on the bits of its own block's SimHash only. An edit so leaves all blocks alone but those
  of the words it touches, where a SimHash of the whole line would change a few bits in many of its
  blocks. The pigeonhole of the parity-sketch join says how many blocks two near lines have in common
  and which of them are needed as join keys: one more than the blocks that may change.
* Small sets: lines of up to eight distinct words are also found by their set and by their set without
  each of its words, as blocks of one or two common words say little.
* Lines that differ in spaces only share the key of their signs.

Lines with a tenth of their words replaced, added or left out share a key for sure while that is few
words (three replaced words or six added ones), beyond it with high probability. Lines that differ in
many words by a letter each may have the edit similarity and share no key.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_left
from collections import Counter
from itertools import chain
from os.path import commonprefix

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bindwell.llm.bloom import Bloom
from bindwell.llm.dedup_exact import SEGMENT, filter_places, repeat_filter
from bindwell.llm.graph import components
from bindwell.llm.jaccard import Rule, Sketches, all_keys, parity_sketches
from bindwell.llm.store import BROADCAST_IDS, settled, written
from bindwell.llm.text import ALNUM, LOWER, U64, Words, in_batches, map_texts, mix, trimmed

#: Bits of a block's SimHash.
BITS = 64
#: Edit similarity of linked lines, as a fraction: at most a tenth of the longer line differs.
NUM, DEN = 9, 10
#: Sets of up to ``SMALL`` words have keys of their own, from ``LEAST`` on those of the blocks; from ``PARTS`` on also without each word.
SMALL, LEAST, PARTS = 8, 8, 4
#: Blocks that may change at least, for sets that have blocks.
CHANGED = 6
#: Bits of the parity sketch of a word set: two numbers.
PARITY = 128
#: Lines of a key of which all pairs are compared where they meet, and rows that are looked at together there.
FEW, TOGETHER = 32, 1 << 16
#: Bytes of pairs of lines that are compared together.
PAIR_BYTES = 24 << 20
#: Bits of the filter of repeated keys for each key, and at most (64 MB).
KEY_BITS, MOST_BITS = 16, 1 << 29
#: Ids that are broadcast as such (about 20 MB at the driver); more are looked up in a filter of bounded size first.
FEW_IDS = 200_000
#: Pairs that are handled together, and lines of a cell that meet the others together.
PAIRS, ROWS = 2000, 64
#: Lines of a piece of a large group.
CELL = 1024
#: Pairs of cells that are compared together.
TOGETHER_PAIRS = 8000
#: Logarithm of the ratio of a class of lengths to the next: lines that link are in one class or in neighbours.
LENGTHS = 1.0001 * math.log(DEN / NUM)

#: Lines of more characters are compared singly; characters of lines that are compared together.
LONG, CELLS = 3000, 1_000_000
#: Edits that can be told from a band whose places are the bits of one number; kinds of characters that are looked up.
NARROW, KINDS = 31, 64

_TABLE = np.where(ALNUM, LOWER, 0x20).astype(np.uint8)
_TABLE[0x41:0x5B] = np.arange(0x61, 0x7B)
_TABLE[0x30:0x3A] = 0x30
_NORMAL = bytes(_TABLE)
_BYTE = np.arange(256)
#: Classes of characters by their first byte; 0 for the bytes that follow it.
_CLASS = np.select([_BYTE < 0x40, _BYTE < 0x80, _BYTE < 0xC0], [33 + (_BYTE >> 4), 1 + _BYTE % 32, 0], 40 + _BYTE % 24)
#: The bits of a byte as the bytes of a number, and how many of these can be summed.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view("<u8").ravel()
_RUN = 254


def normalise(line: bytes) -> bytes:
    return b" ".join(line.translate(_NORMAL).split())


class LineRule(Rule):
    """Word sets of lines: similar as sets, or a word apart (two words that become one are three differences)."""

    def __init__(self):
        super().__init__(4, 5)

    def differences(self, total):
        return np.maximum(super().differences(total), 3)

    def changed(self, total):
        """All differences while they are few; of large sets half of them, and more with high probability."""
        d = np.maximum(super().differences(total), 2)
        return np.minimum(d, np.maximum(CHANGED, d // 2))

    def largest(self, n):
        return n * 9 // 8

    def prints(self, tokens, begins):
        return simhashes(tokens, begins)


def simhashes(tokens: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """SimHash of each group of tokens, which stand together from ``begins`` on, as unsigned 64-bit numbers.

    Every token votes on every bit; bits of the group's parity decide ties. Groups of up to four are
    counted by logic on whole numbers.
    """
    votes, parity = mix(tokens ^ U64(0x6A09E667F3BCC909)), mix(tokens ^ U64(0x9FB21C651E98DF25))
    count = np.diff(np.append(begins, len(tokens)))
    out = np.empty(len(begins), U64)
    for n in range(1, 5):
        of = np.flatnonzero(count == n)
        v, t = ([x[begins[of] + k] for k in range(n)] for x in (votes, parity))
        if n == 1:
            out[of] = v[0]
        elif n == 2:
            out[of] = v[0] & v[1] | (v[0] | v[1]) & (t[0] ^ t[1])
        elif n == 3:
            out[of] = v[0] & v[1] | (v[0] | v[1]) & v[2]
        else:
            both, some, both_, some_ = v[0] & v[1], v[0] | v[1], v[2] & v[3], v[2] | v[3]
            three, two = both & some_ | both_ & some, both | both_ | some & some_
            out[of] = three | two & (t[0] ^ t[1] ^ t[2] ^ t[3])
    more = np.flatnonzero(count > 4)
    if len(more):
        take = np.repeat(begins[more] - np.cumsum(count[more]) + count[more], count[more]) + np.arange(count[more].sum())
        out[more] = _majorities(votes[take], parity[take], np.cumsum(count[more]) - count[more])
    return out


def _majorities(votes: np.ndarray, parity: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The same for groups of any size: votes are summed eight to a number, a byte each, over runs of at most 254 tokens."""
    ties = np.bitwise_xor.reduceat(parity, begins).view(np.uint8).reshape(-1, 8)
    count = np.diff(np.append(begins, len(votes)))
    runs = -(-count // _RUN)
    owner = np.repeat(np.arange(len(begins)), runs)
    run_first = np.cumsum(runs) - runs
    at = begins[owner] + (np.arange(len(owner)) - run_first[owner]) * _RUN
    ones = np.empty((len(begins), BITS), bool)
    for k in range(BITS // 8):
        sums = np.add.reduceat(_SPREAD[(votes >> U64(8 * k)).astype(np.uint8)], at).view(np.uint8).reshape(-1, 8)
        sums = np.add.reduceat(sums, run_first, axis=0, dtype=np.int32)
        ones[:, 8 * k : 8 * k + 8] = 2 * sums + np.unpackbits(ties[:, k, None], axis=1, bitorder="little") > count[:, None]
    return np.packbits(ones, axis=1, bitorder="little").view("<u8").ravel()


def line_keys(tokens: np.ndarray, rows: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, row) of word sets in order of row: keys of their blocks, and of small sets whole and without a word."""
    n = np.bincount(rows, minlength=n_rows)
    some = np.flatnonzero(n)
    each = mix(tokens ^ U64(0x3C6EF372FE94F82B))
    whole = np.zeros(n_rows, U64)
    if len(some):
        whole[some] = np.add.reduceat(each, (np.cumsum(n) - n)[some])
    large = n[rows] >= LEAST
    small = np.flatnonzero((n > 0) & (n <= SMALL))
    less = np.flatnonzero((n[rows] >= PARTS) & (n[rows] <= SMALL))
    key, owner = all_keys(tokens[large], rows[large], n_rows, LineRule())
    sums = np.concatenate((whole[small], whole[rows[less]] - each[less]))
    return np.concatenate((key, mix(sums ^ U64(0xBB67AE8584CAA73B)))), np.concatenate((owner, small, rows[less]))


#: What ``Words.gram_at`` starts from for one word.
_ONE = 0xA0761D6478BD642F * 0xE7037ED1A0B428DB & 0xFFFFFFFFFFFFFFFF


def word_sets(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word hashes of every row, in order of row: those of ``shingle_sets`` for single words."""
    hashes, rows = words.hash, words.row
    code = rows.astype(U64) << U64(40) | hashes >> U64(24)
    order = np.argsort(code)
    code, hashes, rows = code[order], hashes[order], rows[order]
    same, other = code[1:] == code[:-1], hashes[1:] != hashes[:-1]
    if words.rows >> 24 or (same & other).any():  # the code does not tell all of them apart
        order = np.lexsort((words.hash, words.row))
        hashes, rows = words.hash[order], words.row[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
    return mix(hashes[new] + U64(_ONE)), rows[new]


def sketches_of(tokens: np.ndarray, rows: np.ndarray, n_rows: int) -> np.ndarray:
    """The parity sketch of every row's tokens: each flips one bit."""
    bit = rows * PARITY + (mix(tokens ^ U64(0xD1B54A32D192ED03)) & U64(PARITY - 1)).astype(np.int64)
    flips = np.bincount(bit, minlength=n_rows * PARITY).astype(np.uint8) & 1
    return np.packbits(flips).view(np.int64).reshape(n_rows, 2)


def _split(text: str | None) -> list[bytes]:
    return [normalise(line) for line in (text or "").encode().split(b"\n")]


def _node(line: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(line, digest_size=8).digest(), "little", signed=True)


def _lines(docs: DataFrame) -> DataFrame:
    """The distinct lines with words of each slice of documents: (node, words, n, size, s0, s1, keys, places).

    The node is a 64-bit digest of the normalised line ``words``, ``n`` its number of distinct words, ``size`` that of its characters,
    ``s0`` and ``s1`` their sketch; ``places`` are (id, line, th) of its occurrences in the slice.
    """
    place = T.StructType([T.StructField(c, T.LongType()) for c in ("id", "line", "th")])
    schema = T.StructType([
        T.StructField("node", T.LongType()), T.StructField("words", T.StringType()), T.StructField("n", T.LongType()), T.StructField("size", T.LongType()), T.StructField("s0", T.LongType()), T.StructField("s1", T.LongType()),
        T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("places", T.ArrayType(place)),
    ])

    def listed(values: pa.Array, owner: np.ndarray, rows: int) -> pa.ListArray:
        ends = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=rows))))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values.take(pa.array(np.argsort(owner, kind="stable"))))

    def run(batch):
        known: dict[bytes, int] = {}
        row, number, which = [], [], []
        for k, text in enumerate(batch.column(2).to_pylist()):
            for j, line in enumerate(_split(text)):
                if line:
                    row.append(k)
                    number.append(j)
                    which.append(known.setdefault(line, len(known)))
        tokens, rows = word_sets(Words(pa.array(list(known), pa.binary()), ALNUM, lower=False))
        sketch = sketches_of(tokens, rows, len(known))
        n = np.bincount(rows, minlength=len(known))
        key, owner = line_keys(tokens, rows, len(known))
        signs = np.array([_node(b"signs " + x.replace(b" ", b"")) for x in known], np.int64).view(U64)
        key, owner = np.concatenate((key, signs)), np.concatenate((owner, np.arange(len(known))))
        at, words = pa.array(row, pa.int64()), pa.array(list(known), pa.binary()).cast(pa.string())
        places = pa.StructArray.from_arrays([batch.column(0).take(at), pa.array(number, pa.int64()), batch.column(1).take(at)], ["id", "line", "th"])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([_node(x) for x in known], pa.int64()), words, pa.array(n, pa.int64()), pc.utf8_length(words).cast(pa.int64()),
                pa.array(sketch[:, 0]), pa.array(sketch[:, 1]), listed(pa.array(key.view(np.int64)), owner, len(known)), listed(places, np.array(which, np.int64), len(known)),
            ],
            names=schema.names,
        )

    return map_texts(docs.where("id is not null"), ["id", "th", "text"], run, schema)


def edits_by_words(a: list[str], b: list[str]) -> int:
    """A number of edits that surely turns one line's words into the other's: exact where few words changed.

    Words that stand once in either line and in the same order in both stay; what is between them is
    replaced as a whole.
    """
    head = len(commonprefix([a, b]))
    a, b = a[head:], b[head:]
    tail = len(commonprefix([a[::-1], b[::-1]]))
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    often_a, often_b = Counter(a), Counter(b)
    at = {w: j for j, w in enumerate(b)}
    both = [(i, at[w]) for i, w in enumerate(a) if often_a[w] == 1 and often_b.get(w) == 1]
    ends, last, before = [], [], {}  # longest run of places that increase in both
    for i, j in both:
        k = bisect_left(ends, j)
        before[i] = last[k - 1] if k else None
        ends[k : k + 1], last[k : k + 1] = [j], [i]
    kept, i = [], last[-1] if last else None
    while i is not None:
        kept.append((i, at[a[i]]))
        i = before[i]
    size = lambda words: sum(map(len, words)) + len(words)  # noqa: E731  each with a space
    edits, x, y = 0, 0, 0
    for i, j in [*reversed(kept), (len(a), len(b))]:
        edits += max(size(a[x:i]), size(b[y:j]))
        x, y = i + 1, j + 1
    return edits


def edits_within(a: str, b: str, most: int) -> bool:
    """Whether the edit distance is at most ``most``: a column of the table at a time, its steps as the bits of two numbers."""
    head = len(commonprefix([a, b]))
    a, b = a[head:], b[head:]
    tail = len(commonprefix([a[::-1], b[::-1]]))
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not a or not b:
        return max(len(a), len(b)) <= most
    places: dict[str, int] = {}
    for k, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << k
    every, top, score = (1 << len(a)) - 1, 1 << (len(a) - 1), len(a)
    up, down = every, 0
    for k, c in enumerate(b):
        same = places.get(c, 0)
        zero = (((same & up) + up) ^ up) | same | down
        right_up, right_down = down | (every & ~(zero | up)), up & zero
        score += bool(right_up & top) - bool(right_down & top)
        if score - (len(b) - k - 1) > most:
            return False
        right_up, right_down = (right_up << 1 | 1) & every, (right_down << 1) & every
        up, down = right_down | (every & ~(zero | right_up)), right_up & zero
    return score <= most


def narrow_within(a: list[str], b: list[str], most: np.ndarray, words: int = 1) -> np.ndarray:
    """Whether the edit distance of each pair is at most its ``most``, which is at most 32 ``words`` - 1.

    A row of each pair's band is the steps between its places, as bits of two numbers of 64 ``words`` bits (Hyyro 2003). Where the
    longer line has a character of the shorter one is a bit each as well, looked up by characters if there are few kinds of them.
    """
    width, both = 64 * words, [(x, y) if len(x) >= len(y) else (y, x) for x, y in zip(a, b, strict=True)]
    k, count = width // 2 - 1, len(both)
    longer, shorter = (np.array([len(p[c]) for p in both]) for c in (0, 1))
    codes = [np.array([p[c].ljust(int(size.max()), "\0") for p in both]).view(np.uint32).reshape(count, -1) for c, size in ((0, longer), (1, shorter))]
    blocks = (width - 1 - k + codes[0].shape[1] + k) // 64 + words + 2
    kinds = np.unique(codes[1])
    few = len(kinds) <= KINDS
    kind = np.uint8 if few else np.uint32
    columns = np.full((count, 64 * blocks), np.iinfo(kind).max, kind)  # stands for no character
    inside = np.arange(codes[0].shape[1]) < longer[:, None]
    if few:
        codes = [np.searchsorted(kinds, codes[0]).astype(kind) + (np.isin(codes[0], kinds, invert=True) * 128).astype(kind), np.searchsorted(kinds, codes[1]).astype(kind)]
    columns[:, width - 1 - k : width - 1 - k + codes[0].shape[1]] = np.where(inside, codes[0], np.iinfo(kind).max)
    if few:
        table = np.empty((count, len(kinds), blocks), U64)
        for x in range(len(kinds)):
            table[:, x] = np.packbits(columns == kind(x), axis=1, bitorder="little").view("<u8")
        table, rows = table.ravel(), np.ascontiguousarray(codes[1].T).astype(np.int64) * blocks + np.arange(count) * (len(kinds) * blocks)
    up, down = np.zeros((words, count), U64), np.zeros((words, count), U64)
    for place in range(width - 1 - k, width):
        up[place >> 6] |= U64(1) << U64(place & 63)
    edits, some, out = np.minimum(longer, k), shorter > 0, longer <= most
    stay, done, every, one, top, inner, least = np.arange(count), np.empty(count, np.int64), np.arange(count), U64(1), U64(63), int(longer.min()) - k, int(shorter.min())
    for i in range(codes[1].shape[1]):
        if i >= least and i & 31 == 0 and (left := np.count_nonzero(shorter > i)) <= 0.9 * len(stay):  # go on with pairs that are not through
            done[stay], on = edits, np.flatnonzero(shorter > i)
            stay, up, down, edits, longer, shorter, every = stay[on], up[:, on], down[:, on], edits[on], longer[on], shorter[on], every[:left]
            if few:
                rows[i:, :left] = rows[i:, on]
            else:
                columns, codes[1] = columns[on], codes[1][on]
            count, inner, least = left, int(longer.min()) - k, int(shorter.min())
        if few:
            at = rows[i, :count] + (i >> 6)
            same = table.take(at if words == 1 else at + np.arange(words)[:, None]).reshape(words, count)
            if i & 63:
                same >>= U64(i & 63)
                beyond = table.take(at + 1 if words == 1 else at + np.arange(1, words + 1)[:, None]).reshape(words, count)
                beyond <<= U64(64 - (i & 63))
                same |= beyond
        else:
            same = np.ascontiguousarray(np.packbits(columns[:, i : i + width] == codes[1][:, i, None], axis=1, bitorder="little").view("<u8").T)
        flat = same & up
        if words == 1:
            flat += up
        else:
            sums, carry = flat.copy(), False
            flat += up
            for w in range(words):
                more = flat[w] < sums[w]
                flat[w] += carry
                carry = more | carry & (flat[w] == 0)
        flat ^= up
        flat |= same
        flat |= down
        right_up, right_down = flat | up, flat & up
        np.invert(right_up, out=right_up)
        right_up |= down
        if i < inner:  # the band ends within all longer lines
            step = 1 - (flat[-1] >> top).view(np.int64)
        else:
            last = i + k - longer  # places by which the band reaches beyond the longer line's end
            place = np.clip(width - 2 - last, 0, width - 1)
            w, bit = place >> 6, (place & 63).astype(U64)
            step = (right_up[w, every] >> bit & one).astype(np.int64) - (right_down[w, every] >> bit & one).astype(np.int64)
            step = np.where(last < 0, 1 - (flat[-1] >> top).view(np.int64), step)
        edits += step if i < least else np.where(i < shorter, step, 0)
        if words > 1:
            low = flat[1:] << top
        flat >>= one
        if words > 1:
            flat[:-1] |= low
        down = flat & right_up
        flat |= right_up
        np.invert(flat, out=flat)
        flat |= right_down
        up = flat
    done[stay] = edits
    return np.where(some, done <= most, out)


def between(a: str, b: str) -> tuple[str, str]:
    """What is left of two lines without what they begin and end with alike."""
    x, y = (np.frombuffer(line.encode("utf-32-le"), np.uint32) for line in (a, b))
    n = min(len(x), len(y))
    other = np.flatnonzero(x[:n] != y[:n])
    head = int(other[0]) if len(other) else n
    other = np.flatnonzero(x[len(x) - n + head :] != y[len(y) - n + head :])
    tail = n - head - 1 - int(other[-1]) if len(other) else n - head
    return a[head : len(a) - tail], b[head : len(b) - tail]


def lengths_near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether numbers of characters allow a link: what one line has more is at least so many edits."""
    return DEN * np.abs(x - y) <= (DEN - NUM) * np.maximum(x, y)


def letters_apart(a: list[str], b: list[str]) -> np.ndarray:
    """A number of edits that each pair needs at least: an edit takes one character away and adds one at most, so counts of characters tell."""

    def counts(lines: list[str]) -> np.ndarray:
        data = [x.encode() for x in lines]
        row = np.repeat(np.arange(len(data)), np.fromiter(map(len, data), np.int64, len(data)))
        sign = _CLASS[np.frombuffer(b"".join(data), np.uint8)]
        return np.bincount(row * 64 + sign, minlength=len(data) * 64).reshape(-1, 64)[:, 1:]

    out = np.empty(len(a), np.int64)
    for k in range(0, len(a), PAIRS):
        more = counts(a[k : k + PAIRS]) - counts(b[k : k + PAIRS])
        out[k : k + PAIRS] = np.maximum(np.maximum(more, 0).sum(axis=1), np.maximum(-more, 0).sum(axis=1))
    return out


def alike(a: list[str], b: list[str]) -> np.ndarray:
    """Whether each pair of lines has the edit similarity: counts of letters first, then bands for lines of like lengths together; long ones singly, by words first."""
    size = np.array([max(len(x), len(y)) for x, y in zip(a, b, strict=True)], np.int64)
    most = size * (DEN - NUM) // DEN
    least = letters_apart(a, b)
    out = least <= most
    rest, inner = np.flatnonzero(out), {}
    for k in rest:
        inner[k] = x, y = between(a[k], b[k])
        size[k] = max(len(x), len(y))
    for k in rest[size[rest] > LONG]:
        out[k] = edits_by_words(a[k].split(" "), b[k].split(" ")) <= most[k] or edits_within(*inner[k], int(most[k]))
    rest = rest[(size[rest] > most[rest]) & (size[rest] <= LONG)]
    words = most // (NARROW + 1) + 1
    rest = rest[np.lexsort((size[rest], words[rest]))]
    while len(rest):
        wide = int(np.searchsorted(words[rest], words[rest[0]], "right"))
        some = max(1, min(wide, int(np.searchsorted(np.arange(1, wide + 1) * size[rest[:wide]], CELLS))))
        now, rest = rest[:some], rest[some:]
        out[now] = narrow_within([inner[k][0] for k in now], [inner[k][1] for k in now], most[now], int(words[now[0]]))
    return out


def sets_near(a: list[str], b: list[str]) -> np.ndarray:
    """Whether sketches of twice as many bits as a line has words allow a link; those of up to 64 words have been compared by then."""
    out, rule = np.ones(len(a), bool), LineRule()
    large = [k for k, (x, y) in enumerate(zip(a, b, strict=True)) if max(x.count(" "), y.count(" ")) >= PARITY // 2]
    for k in range(0, len(large), PAIRS):
        some = large[k : k + PAIRS]
        lines = [x[k].encode() for x in (a, b) for k in some]
        tokens, rows = word_sets(Words(pa.array(lines, pa.binary()), ALNUM, lower=False))
        n, left = np.bincount(rows, minlength=len(lines)), np.arange(len(some))
        sketches = Sketches(parity_sketches(tokens, rows, n, PARITY))
        out[some] = rule.near(sketches.apart(left, sketches, left + len(some)), n[: len(some)] + n[len(some) :])
    return out


def links_of(a: list[str], b: list[str]) -> np.ndarray:
    """Whether each pair of lines is a link."""
    out = sets_near(a, b)
    some = np.flatnonzero(out)
    out[some] = alike([a[k] for k in some], [b[k] for k in some])
    return out


def _texts(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, words) of a stored table of nodes. Beyond FEW_IDS of them, lines that a filter does not let through are not moved."""
    mine = lines.select("node", "words")
    if wanted.count() <= FEW_IDS:
        return settled(mine.join(F.broadcast(wanted), "node", "left_semi").groupBy("node").agg(F.min("words").alias("words")))
    held = Bloom.of(wanted.select(F.col("node").alias("key")))
    maybe = F.pandas_udf(lambda nodes: pd.Series(held.has(nodes.to_numpy(np.int64).view(U64))), "boolean")
    return settled(mine.where(maybe("node")).groupBy("node").agg(F.min("words").alias("words")).join(wanted, "node", "left_semi"))


def _verified(lines: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs whose lines have the edit similarity. Only the words of lines in pairs are moved."""
    pairs = settled(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    texts = _texts(lines, settled(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()))
    ends = [texts.select(F.col("node").alias(c), F.col("words").alias(f"w{c}")) for c in "ab"]

    def run(batches):
        some, size = [], 0
        for batch in chain(batches, [None]):
            if batch is not None:
                some.append(batch)
                size += batch.nbytes
            if some and (batch is None or size >= PAIR_BYTES):
                table = pa.Table.from_batches(some)
                links = links_of(table["wa"].to_pylist(), table["wb"].to_pylist())
                yield from table.select(["a", "b"]).filter(pa.array(links)).to_batches()
                some, size = [], 0

    linked = in_batches(pairs.join(ends[0], "a").join(ends[1], "b").select("a", "b", "wa", "wb")).mapInArrow(trimmed(run), "a long, b long")
    return settled(linked.distinct())


def _repeated_keys(lines: DataFrame) -> DataFrame:
    """(key, id, n, size, s0, s1) of each line and key, without most of the keys that stand once: two keys that share a place of the filter stay."""
    keys = lines.select(F.explode("keys").alias("key"))
    wanted = max(1, lines.agg(F.sum(F.size("keys"))).first()[0] or 0) * KEY_BITS
    n_bits = min(-(-wanted // SEGMENT) * SEGMENT, MOST_BITS)
    held = lines.sparkSession.sparkContext.broadcast(repeat_filter(keys, n_bits, 1))

    def run(batches):
        bits = held.value
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(0)
            key = lists.flatten().to_numpy()
            places = filter_places(key.view(U64), n_bits, 1)[0]
            some = np.flatnonzero(bits[places >> 3] >> (places & 7).astype(np.uint8) & 1)
            of = pa.array(np.repeat(np.arange(batch.num_rows), pc.list_value_length(lists).to_numpy())[some])
            yield pa.RecordBatch.from_arrays([pa.array(key[some]), *(c.take(of) for c in batch.columns[1:])], names=["key", "id", "n", "size", "s0", "s1"])

    return lines.select("keys", F.col("node").alias("id"), "n", "size", "s0", "s1").mapInArrow(trimmed(run), "key long, id long, n long, size long, s0 long, s1 long")


def _shared(lines: DataFrame) -> DataFrame:
    """What meets at the keys: (key, id, hub, n, size, s0, s1) of the lines of keys with more than FEW, and without a key the pairs (id, hub) that sizes and sketches allow.

    The pairs are all those of a key's lines if these are few, else those of each with the key's smallest.
    """
    rule = LineRule()

    def run(batches):
        held, large = [np.empty(0, np.int64)] * 6, False  # rows of the last key, which may go on; of a large one the first and the last row alone

        def met(columns: list[np.ndarray], known: int) -> pa.RecordBatch:
            """Of rows of whole keys; the first ``known`` have been given already as lines of a large key."""
            key, ident, n, chars, *sketch = columns
            start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            size = np.diff(np.append(start, len(key)))
            group = np.repeat(np.arange(len(start)), size)
            big = size > FEW
            big[0] |= known > 0
            ends = (start + size)[group]
            first, second = [], []

            def fits(x, y):
                low, high = np.minimum(n[x], n[y]), np.maximum(n[x], n[y])
                apart = sum(np.bitwise_count(s[x] ^ s[y]).astype(np.int64) for s in (c.view(U64) for c in sketch))
                fit = np.flatnonzero((low * rule.den >= high * rule.num) & rule.near(apart, low + high) & lengths_near(chars[x], chars[y]))
                first.append(x[fit])
                second.append(y[fit])

            x, apart = np.flatnonzero(~big[group]), 1
            while len(x := x[x + apart < ends[x]]):
                fits(x, x + apart)
                apart += 1
            many = np.flatnonzero(big[group])
            many = many[many >= known]
            hub = start[group[many]]
            fits(hub[hub != many], many[hub != many])
            a, b = ident[np.concatenate(first)], ident[np.concatenate(second)]
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
            none = pa.nulls(len(pairs), pa.int64())
            both = zip([none, pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), none, none, none, none], [key[many], ident[many], ident[hub], *(c[many] for c in columns[2:])], strict=True)
            return pa.RecordBatch.from_arrays([pa.concat_arrays([x, pa.array(y)]) for x, y in both], names=["key", "id", "hub", "n", "size", "s0", "s1"])

        def several():
            some, size = [], 0
            for batch in batches:
                some.append([c.to_numpy() for c in batch.columns])
                size += batch.num_rows
                if size >= TOGETHER:
                    yield some
                    some, size = [], 0
            yield some

        for some in several():
            columns = [np.concatenate(c) for c in zip(held, *some, strict=True)]
            key, ident = columns[:2]
            if not len(key):
                continue
            once = np.append(True, (key[1:] != key[:-1]) | (ident[1:] != ident[:-1]))  # a line that stands in several slices
            known = len(held[0]) if large else 0
            key, *_ = columns = [c[once] for c in columns]
            last = int(np.searchsorted(key, key[-1]))
            large = len(key) - last > FEW or large and last == 0
            done = len(key) if large else last
            if done:
                yield met([c[:done] for c in columns], known)
            held = [np.append(c[last : last + 1], c[max(last + 1, len(c) - 1) :]) if large else c[last:] for c in columns]
        if len(held[0]) and not large:
            yield met(held, 0)

    return _repeated_keys(lines).repartition("key").sortWithinPartitions("key", "id").mapInArrow(trimmed(run), "key long, id long, hub long, n long, size long, s0 long, s1 long")


def _mixed(members: DataFrame, found: DataFrame) -> DataFrame:
    """``members`` with their ``component``, of the keys whose members are not all in one; of keys with the same members one."""
    labelled = members.drop("component").join(found, F.col("id") == F.col("node"), "left").withColumn("component", F.coalesce("component", "id")).drop("node")
    labelled = settled(labelled)
    sets = labelled.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.bit_xor(F.xxhash64("id")).alias("set"), F.count(F.lit(1)).alias("size"))
    mixed = sets.where("x <> y").groupBy("set", "size").agg(F.min("key").alias("key")).select("key")
    return settled(labelled.join(mixed, "key", "left_semi"))


def _middle_pairs(members: DataFrame) -> DataFrame:
    """Pairs (a, b) of each key's member that shares most keys with others and those of other components, if sizes and sketches allow them."""
    rule = LineRule()
    shared = members.groupBy("id").agg(F.count(F.lit(1)).alias("shared"))
    best = F.max_by(F.struct("id", "component", "n", "size", "s0", "s1"), F.struct("shared", -F.col("id")))
    hubs = members.join(shared, "id").groupBy("key").agg(best.alias("h"))
    apart = sum((F.bit_count(F.col(s).bitwiseXOR(F.col(f"h.{s}"))) for s in ("s0", "s1")), F.lit(0))
    total, low, high = F.col("n") + F.col("h.n"), F.least("n", "h.n"), F.greatest("n", "h.n")
    most = F.greatest(F.floor(total * (rule.den - rule.num) / (rule.den + rule.num)), F.lit(3))
    lengths = DEN * F.abs(F.col("size") - F.col("h.size")) <= (DEN - NUM) * F.greatest("size", "h.size")
    pairs = members.join(hubs, "key").where(lengths & (F.col("component") != F.col("h.component")) & (low * rule.den >= high * rule.num) & (apart <= most))
    return pairs.select(F.col("h.id").alias("a"), F.col("id").alias("b"))


def _cell_pairs(cell: pa.Table) -> np.ndarray:
    """Pairs (rows of a cell) of lines that sizes, lengths and sketches allow, and that share a key and are of different components.

    Lines of the cell's own piece of those that meet all meet those of its own piece of all.
    """
    rule = LineRule()
    ident, n, chars, home, meets, piece, label = (cell[c].to_numpy() for c in ("id", "n", "size", "home", "meets", "piece", "component"))
    s0, s1 = (cell[c].to_numpy().view(U64) for c in ("s0", "s1"))
    left, right = np.flatnonzero(meets == cell["i"][0].as_py()), np.flatnonzero(piece == cell["j"][0].as_py())
    found = [np.empty((0, 2), np.int64)]
    for k in range(0, len(left), ROWS):
        x, y = left[k : k + ROWS, None], right[None, :]
        apart = (np.bitwise_count(s0[x] ^ s0[y]) + np.bitwise_count(s1[x] ^ s1[y])).astype(np.int64)
        fit = rule.near(apart, n[x] + n[y]) & (label[x] != label[y]) & (home[x] | home[y]) & lengths_near(chars[x], chars[y])
        fit &= (meets[y] < 0) | (ident[x] < ident[y])  # two that meet all meet once
        fit &= np.minimum(n[x], n[y]) * rule.den >= np.maximum(n[x], n[y]) * rule.num
        u, v = np.nonzero(fit)
        found.append(np.stack([left[k + u], right[v]], axis=1))
    pairs = np.concatenate(found)
    if not len(pairs):
        return pairs
    rows, at = np.unique(pairs, return_inverse=True)
    keys = [frozenset(x) for x in cell["keys"].take(pa.array(rows)).to_pylist()]
    return pairs[[not keys[x].isdisjoint(keys[y]) for x, y in at.reshape(-1, 2).tolist()]]


def _cell_links(batches):
    """Links (a, b) between the components of cells, whose rows stand together: as many as join them, no more.

    Pairs of several cells are compared together; once linked, components are one.
    """
    joined: dict[int, int] = {}
    waiting, size, rest, read = [], 0, [], 0

    def root(x: int) -> int:
        while (up := joined.get(x, x)) != x:
            joined[x] = joined.get(up, up)
            x = up
        return x

    def links() -> pa.RecordBatch:
        table = pa.concat_tables(waiting)
        a, b = ([root(x) for x in table[c].to_pylist()] for c in ("ca", "cb"))
        table = table.filter(pa.array(np.array(a, np.int64) != np.array(b, np.int64)))
        found = []
        hit = table.filter(pa.array(links_of(table["wa"].to_pylist(), table["wb"].to_pylist())))
        for x, y, of_x, of_y in zip(*(hit[c].to_pylist() for c in ("a", "b", "ca", "cb")), strict=True):
            if (of_x := root(of_x)) != (of_y := root(of_y)):
                joined[of_x] = of_y
                found.append((x, y))
        a, b = zip(*found, strict=True) if found else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    for batch in chain(batches, [None]):
        if batch is not None:
            rest.append(batch)
            read += batch.nbytes
        if not rest or batch is not None and read < PAIR_BYTES:
            continue
        table = pa.Table.from_batches(rest).combine_chunks()
        label = np.stack([table[c].to_numpy().astype(np.int64) for c in ("hub", "length", "i", "j")])
        starts = [0, *(np.flatnonzero((label[:, 1:] != label[:, :-1]).any(axis=0)) + 1).tolist()]
        ends = [*starts[1:], table.num_rows] if batch is None else starts[1:]  # the last cell may go on
        for first, end in zip(starts, ends, strict=False):
            cell = table.slice(first, end - first)
            pairs = _cell_pairs(cell)
            for k in range(0, len(pairs), PAIRS):
                x, y = (pa.array(side) for side in pairs[k : k + PAIRS].T)
                ends_of = [cell.select(["id", "component", "words"]).take(side) for side in (x, y)]
                waiting.append(pa.table([c for columns in zip(*(e.columns for e in ends_of), strict=True) for c in columns], names=["a", "b", "ca", "cb", "wa", "wb"]))
                size += len(x)
                if size >= TOGETHER_PAIRS:
                    yield links()
                    waiting, size = [], 0
        rest = [] if batch is None else table.slice(starts[-1]).to_batches()
        read = sum(x.nbytes for x in rest)
    if waiting:
        yield links()


def _cells(lines: DataFrame, members: DataFrame) -> DataFrame:
    """Links (a, b) between lines of one key and of different components.

    The lines of the keys of one hub are a group; those of a hub with more than CELL are dealt by their length, in classes of a
    tenth, and a class and the next shorter one are a group. Lines of its largest component meet the others only: those are dealt into pieces of about CELL by the hash of their
    id, and so are all lines, and every piece of the others and every piece of all meet in a cell, so no group is held whole.
    """
    mine = settled(members.groupBy("hub", "id").agg(F.collect_set("key").alias("keys"), *(F.first(c).alias(c) for c in ("n", "size", "s0", "s1", "component"))))
    many = mine.join(mine.groupBy("hub").agg((F.count(F.lit(1)) > CELL).alias("many")), "hub")
    own = F.floor(F.log(F.greatest("size", F.lit(1)).cast("double")) / LENGTHS)
    own = F.when(F.col("many"), own).otherwise(F.lit(0).cast("long"))
    classes = F.when(F.col("many"), F.array(own, own + 1)).otherwise(F.array(own))
    near = many.select("hub", "id", "component", own.alias("own"), F.explode(classes).alias("length"))
    near = near.select("hub", "length", "id", "component", (F.col("own") == F.col("length")).alias("home"))
    counts = near.groupBy("hub", "length", "component").agg(F.count(F.lit(1)).alias("lines"), F.max("home").alias("home"))
    largest = F.max(F.struct("lines", "component"))
    sizes = counts.groupBy("hub", "length").agg(F.sum("lines").alias("lines"), largest.alias("most"), F.max("home").alias("home"))
    sizes = sizes.where(F.col("home") & (F.col("lines") > F.col("most.lines")))
    pieces = [F.ceil(x / CELL).cast("int").alias(c) for x, c in ((F.col("lines"), "pieces"), (F.col("lines") - F.col("most.lines"), "others"))]
    dealt = near.join(sizes.select("hub", "length", F.col("most.component").alias("largest"), *pieces), ["hub", "length"])
    piece = lambda count: F.pmod(F.xxhash64("id"), F.col(count)).cast("int")
    dealt = dealt.withColumn("piece", piece("pieces")).withColumn("meets", F.when(F.col("component") == F.col("largest"), F.lit(-1)).otherwise(piece("others")))
    each = lambda c, cell: F.transform(F.sequence(F.lit(0), F.col(c) - 1), cell)
    row = each("others", lambda x: F.struct(x.alias("i"), F.col("piece").alias("j")))
    column = F.when(F.col("meets") >= 0, each("pieces", lambda x: F.struct(F.col("meets").alias("i"), x.alias("j")))).otherwise(F.array().cast("array<struct<i:int,j:int>>"))
    spread = dealt.select("hub", "length", "id", "home", "meets", "piece", F.explode(F.array_union(row, column)).alias("cell"))
    spread = settled(spread.select("hub", "length", "id", "home", "meets", "piece", "cell.*"))
    texts = _texts(lines, settled(spread.select(F.col("id").alias("node")).distinct())).select(F.col("node").alias("id"), "words")
    tasks = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, much work: not to be put into few tasks
    cell = ["hub", "length", "i", "j"]
    rows = spread.join(mine, ["hub", "id"]).join(texts, "id").repartition(tasks, *cell).sortWithinPartitions(*cell)
    return settled(in_batches(rows).mapInArrow(trimmed(_cell_links), "a long, b long"))


def _linked(lines: DataFrame) -> DataFrame:
    """(node, component) of the lines with links."""
    shared = written(_shared(lines), "shared")
    links = _verified(lines, shared.where("key is null").select(F.col("id").alias("a"), F.col("hub").alias("b")))
    found = settled(components(links))
    members = _mixed(shared.where("key is not null"), found)
    if members.isEmpty():
        return found
    more = _verified(lines, _middle_pairs(members))
    if not more.isEmpty():
        links = links.union(more)
        found = settled(components(links))
        members = _mixed(members, found)
    new = _cells(lines, members)
    return found if new.isEmpty() else settled(components(links.union(new)))


def _places(lists: DataFrame, name: str) -> DataFrame:
    """A stored table of (id, th, ``name``: line numbers), marked for broadcast if all its numbers are counted to be few."""
    size = lists.agg((F.count(F.lit(1)) * 4 + F.coalesce(F.sum(F.size(name)), F.lit(0))).alias("size")).first()["size"]
    return F.broadcast(lists) if size <= BROADCAST_IDS else lists


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts without the lines that repeat, exactly or nearly, a line that stays.

    Lines end with a line feed. Of each group of linked lines the occurrence with the smallest id,
    then line number, stays. Lines without words always stay. Ids are integers. Returns for each row:
    ``id_col``, ``n_lines``, ``n_removed``, ``text`` (of the lines that stay). Null texts are empty, which
    is one line. A row without an id is left as it is; rows that repeat an id and a text are
    treated alike. An empty table gives an empty result. Other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    mine = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))
    lines = written(_lines(mine), "lines")  # a line stands once a slice that has it
    found = _linked(lines)

    # lines that occur once and have no links are in no group
    every = lines.groupBy("node").agg(F.min(F.array_min("places")).alias("first"), F.sum(F.size("places")).alias("times"))
    linked = every.join(found, "node", "left").where("times > 1 or component is not null")
    linked = settled(linked.select("node", F.coalesce("component", "node").alias("group"), "first"))
    stays = linked.groupBy("group").agg(F.min("first").alias("stays"))
    repeated = linked.select("node", "group").join(stays, "group").select("node", "stays")
    again = lines.select("node", "places").join(repeated, "node").select(F.explode("places").alias("at"), "stays").where(F.col("at") != F.col("stays")).select("at.*")
    lists = _places(settled(again.groupBy("id", "th").agg(F.array_sort(F.collect_set("line")).alias("gone"))), "gone")

    joined = mine.join(lists, ["id", "th"], "left")
    parts = F.split("text", "\n")
    left = F.array_join(F.filter(parts, lambda _, k: ~F.array_contains("gone", k.cast("long"))), "\n")
    return joined.select(
        F.col("id").alias(id_col),
        F.size(parts).cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_removed"),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(left).alias("text"),
    )
