"""Phrase collocation mining with stripes.

A stripe belongs to a prefix: an associative counter from the next word to how often it follows. The
empty prefix's stripe counts the words, a word's stripe the pairs it begins, a pair's stripe the
triples. An element of a stripe (prefix, next word, count) is also the total of the longer prefix it
spells, so one table of stripes holds the extensions of a phrase, the frequency of every part it can
be cut into, and, as a maximum over its longer phrases, what subsumes it.

Tasks sum the stripes of a slice of texts before they are shuffled and stripes are merged element by
element. The table grows level by level: a phrase can only be frequent if the phrases it begins and
ends with are, so the next level counts below frequent elements alone, which a Bloom filter of
bounded size lets through (what it lets through in error is not frequent and drops out when counted).
A frequent prefix's stripe is dealt to many tasks by the hash of the next word, and Spark's aggregation
adds up the elements, so that no stripe is ever held whole.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bindwell.llm.bloom import Bloom
from bindwell.llm.store import written
from bindwell.llm.text import U64, Words, map_texts, mix

_BYTES = np.arange(256, dtype=np.uint8)
_BREAK = np.isin(_BYTES, [*b".,;:!?", 10, 11, 12, 13])
#: Words are runs of anything but space, tab and the characters that end a piece.
PIECE_WORDS = ~(_BREAK | np.isin(_BYTES, [0x20, 9]))
#: Prefixes whose stripes are dealt to many tasks, and to how many: the most frequent ones.
HOT, DEALT = 4096, 64
#: Text bytes whose stripes a task sums up before it sends them on.
SLICE = 6 << 20
#: Salts over which a language's phrases are ranked before the whole language is.
SALTS = 64


def _seed(lang: str) -> int:
    return zlib.crc32(lang.encode())


def _key(seeds: np.ndarray, hashes: list[np.ndarray]) -> np.ndarray:
    """One hash of a language and some words, for filters and for sorting; never the identity of a phrase."""
    total = mix(seeds.astype(U64) + U64(len(hashes)))
    for h in hashes:
        total = mix(total * U64(0xE7037ED1A0B428DB) + h)
    return total


class _Slice:
    """The words of a slice of texts with their language, and which of them the next word of a piece follows."""

    def __init__(self, batch: pa.RecordBatch):
        self.words = words = Words(batch.column(1), PIECE_WORDS, lower=True)
        langs = batch.column(0).dictionary_encode()
        self.names = langs.dictionary.to_pylist()
        self.lang = np.asarray(langs.indices.to_numpy(zero_copy_only=False))[words.row]
        seeds = np.array([_seed(x) for x in self.names], np.int64)
        self.seed = seeds[self.lang] if len(seeds) else np.empty(0, np.int64)
        breaks = np.concatenate(([0], np.cumsum(_BREAK[words.data])))
        after = words.row[1:] == words.row[:-1]
        self.followed = after & (breaks[words.start[1:]] == breaks[words.end[:-1]]) if len(words.start) else np.empty(0, bool)

    def hashes(self, at: np.ndarray, n: int) -> list[np.ndarray]:
        return [self.words.hash[at + k] for k in range(n)]

    def runs(self, n: int) -> np.ndarray:
        """Where ``n`` words follow each other in a piece."""
        size = len(self.words.hash) - n + 1
        if size <= 0:
            return np.empty(0, np.int64)
        ok = np.ones(size, bool)
        for k in range(n - 1):
            ok &= self.followed[k : k + size]
        return np.flatnonzero(ok)

    def langs_of(self, at: np.ndarray) -> pa.Array:
        return pa.array(self.names, pa.string()).take(pa.array(self.lang[at]))


def _strings(words: Words, at: np.ndarray) -> pa.Array:
    """The words at ``at`` as strings."""
    size = words.end[at] - words.start[at]
    offsets = np.concatenate(([0], np.cumsum(size)))
    place = np.arange(offsets[-1]) + np.repeat(words.start[at] - offsets[:-1], size)
    return pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(words.data[place])]).cast(pa.string())


def _grouped(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Order that brings equal rows together (by the first two columns) and where a new row begins in it."""
    order = np.lexsort((columns[1], columns[0]))
    new = np.zeros(len(order), bool)
    new[:1] = True
    for column in columns:
        sorted_column = column[order]
        new[1:] |= sorted_column[1:] != sorted_column[:-1]
    return order, np.flatnonzero(new)


def _word_counts(texts: DataFrame) -> DataFrame:
    """(lang, h1, word, n): the empty prefix's stripe, with its total as the row without a word."""

    def run(batch):
        part = _Slice(batch)
        order, first = _grouped([part.lang, part.words.hash])
        counts = np.diff(np.append(first, len(order)))
        at = order[first]
        totals = np.bincount(part.lang, minlength=len(part.names))
        names = pa.array(part.names, pa.string())
        yield pa.RecordBatch.from_arrays([part.langs_of(at), pa.array(part.words.hash[at].view(np.int64)), _strings(part.words, at), pa.array(counts)], names=["lang", "h1", "word", "n"])
        yield pa.RecordBatch.from_arrays([names, pa.array(np.zeros(len(names), np.int64)), pa.nulls(len(names), pa.string()), pa.array(totals)], names=["lang", "h1", "word", "n"])

    return map_texts(texts, ["lang", "text"], run, "lang string, h1 long, word string, n long", most=SLICE).groupBy("lang", "h1", "word").agg(F.sum("n").alias("n"))


def _stripes(texts: DataFrame, length: int, frequent: Bloom, hot: np.ndarray) -> DataFrame:
    """(lang, h1.., part, next, n): stripes of the prefixes of ``length`` - 1 words in each slice; ``next`` and ``n`` are arrays."""
    prefix = [f"h{k}" for k in range(1, length)]

    def run(batch):
        part = _Slice(batch)
        known = frequent.has(_key(part.seed[: max(len(part.seed) - length + 2, 0)], part.hashes(np.arange(max(len(part.seed) - length + 2, 0)), length - 1)))
        at = part.runs(length)
        at = at[known[at] & known[at + 1]]
        words = part.hashes(at, length)
        key = _key(part.seed[at], words[:-1])
        dealt = np.where(_among(key, hot), words[-1] % U64(DEALT), U64(0))
        order, first = _grouped([mix(key + dealt), words[-1], part.lang[at], dealt, *words[:-1]])
        counts = np.diff(np.append(first, len(order)))
        at, dealt, words = at[order[first]], dealt[order[first]], [w[order[first]] for w in words]
        new = np.zeros(len(at), bool)
        new[:1] = True
        for column in (part.lang[at], dealt, *words[:-1]):
            new[1:] |= column[1:] != column[:-1]
        begin = np.flatnonzero(new)
        offsets = pa.array(np.append(begin, len(at)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (words[-1].view(np.int64), counts)]
        columns = [part.langs_of(at[begin]), *(pa.array(w[begin].view(np.int64)) for w in words[:-1]), pa.array(dealt[begin].astype(np.int32)), *lists]
        yield pa.RecordBatch.from_arrays(columns, names=["lang", *prefix, "part", "next", "n"])

    schema = f"lang string, {', '.join(f'{p} long' for p in prefix)}, part int, next array<long>, n array<long>"
    return map_texts(texts, ["lang", "text"], run, schema, most=SLICE)


def _among(values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which of ``values`` are among the sorted ``wanted``."""
    if not len(wanted):
        return np.zeros(len(values), bool)
    return wanted[np.minimum(np.searchsorted(wanted, values), len(wanted) - 1)] == values


def _merged(stripes: DataFrame, length: int) -> DataFrame:
    """(lang, h1.., n): stripes merged element by element. Dealing by prefix serves the sums too, so stripes move once."""
    prefix = [f"h{k}" for k in range(1, length)]
    dealt = stripes.repartition("lang", *prefix, "part")
    elements = dealt.select("lang", *prefix, "part", F.explode(F.arrays_zip("next", "n")).alias("e"))
    return elements.select("lang", *prefix, "part", F.col("e.next").alias(f"h{length}"), F.col("e.n").alias("n")).groupBy("lang", *prefix, "part", f"h{length}").agg(F.sum("n").alias("n")).drop("part")


def _keys_of(level: DataFrame, length: int) -> DataFrame:
    """(key): the hash under which filters know the level's phrases."""
    columns = [f"h{k}" for k in range(1, length + 1)]

    def run(batches):
        for batch in batches:
            seeds = np.array([_seed(x) for x in batch.column(0).to_pylist()], np.int64)
            hashes = [c.to_numpy(zero_copy_only=False).view(U64) for c in batch.columns[1:]]
            yield pa.RecordBatch.from_arrays([pa.array(_key(seeds, hashes).view(np.int64))], names=["key"])

    return level.select("lang", *columns).mapInArrow(run, "key long")


def _levels(texts: DataFrame, longest: int, least: int) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, f) of all phrases of 1 to ``longest`` words with f >= ``least``; the word level as it is."""
    words = written(_word_counts(texts).where((F.col("n") >= least) | F.col("word").isNull()), "phrase_words")
    level, tables = words.where("word is not null"), []
    for length in range(1, longest + 1):
        if length > 1:
            frequent = Bloom.of(_keys_of(level, length - 1))
            top = level.orderBy(F.desc("n"), "lang", *[f"h{k}" for k in range(1, length)]).limit(HOT)
            hot = np.sort(np.array([r[0] for r in _keys_of(top, length - 1).collect()], np.int64).view(U64))
            level = written(_merged(_stripes(texts, length, frequent, hot), length).where(F.col("n") >= least), f"phrase_stripes{length}")
            frequent.destroy()
        tables.append(level.select("lang", F.array(*[f"h{k}" for k in range(1, length + 1)]).alias("phrase"), F.col("n").alias("f")))
    every = tables[0]
    for table in tables[1:]:
        every = every.unionByName(table)
    return every, words


def _parts(length: Column) -> Column:
    """Every contiguous part of two words or more that is shorter than ``phrase``."""
    sizes = F.sequence(F.lit(2), length - 1)
    return F.flatten(F.transform(sizes, lambda m: F.transform(F.sequence(F.lit(1), length - m + 1), lambda at: F.slice("phrase", at, m))))


def _scored(phrases: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates with ``l``, ``r`` and ``score`` of their lowest-scoring cut."""
    cuts = candidates.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.size("phrase") - 1)).alias("k"))
    cuts = cuts.select("*", F.expr("slice(phrase, 1, k)").alias("left"), F.expr("slice(phrase, k + 1, size(phrase) - k)").alias("right"))
    part = lambda side, name: phrases.select("lang", F.col("phrase").alias(side), F.col("f").alias(name))
    both = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
    wide = lambda c: F.col(c).cast("decimal(15,0)")
    exact = both.select("lang", "phrase", "a", "k", "l", "r", (F.lit(1_000_000).cast("decimal(7,0)") * (wide("a") * wide("a"))).alias("over"), (wide("l") * wide("r")).alias("under"))
    cut = F.min(F.struct(F.expr("over div under").alias("score"), "k", "l", "r")).alias("cut")
    return exact.groupBy("lang", "phrase", "a").agg(cut).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def _spelled(candidates: DataFrame, words: DataFrame) -> DataFrame:
    """Candidates with their words in place of hashes."""
    spelling = words.where("word is not null").select("lang", F.col("h1").alias("h"), "word")
    each = candidates.select("lang", "phrase", F.posexplode("phrase").alias("at", "h")).join(spelling, ["lang", "h"])
    spelled = each.groupBy("lang", "phrase").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("ws"))
    return candidates.join(spelled.select("lang", F.col("phrase"), F.array_join(F.col("ws.word"), " ").alias("spelled")), ["lang", "phrase"])


def mine_phrases(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    longest: int = 3,
    least: int = 10,
    top: int = 2000,
    subsumed_pct: int = 50,
) -> DataFrame:
    """The strongest collocations of each language.

    Words are lower-cased (A-Z), separated by spaces and tabs, in pieces that ``.,;:!?`` and line
    ends separate. A phrase of 2 to ``longest`` words with a frequency ``a`` of ``least`` or more is
    scored by its weakest cut, floor(1000000 a a / (l r)), exactly for counts below 10^15; it drops
    out if a longer phrase that contains it has ``subsumed_pct`` per cent of its frequency.

    Returns ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n`` (words of the language), ``score``:
    the first ``top`` of each language by score, then frequency (descending), then the phrase's bytes.

    A null language is ``und``; null and empty texts have no words; rows that repeat count as often as
    they stand; ids are not used; an empty table gives an empty result. Other columns are not read.
    Phrases are told apart by one 64-bit hash for each word.
    """
    texts = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    phrases, words = _levels(texts, longest, least)
    candidates = phrases.where(F.size("phrase") > 1).withColumnRenamed("f", "a")
    longer = candidates.where(F.size("phrase") > 2).select("lang", F.explode(_parts(F.size("phrase"))).alias("phrase"), F.col("a").alias("f"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = candidates.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < subsumed_pct * F.col("a"))).drop("longer")
    scored = written(_spelled(_scored(phrases, kept), words), "phrases_scored")
    order = [F.desc("score"), F.desc("a"), F.asc("spelled")]
    # the best of each salt first, so that no task sorts a whole language
    salted = scored.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    salted = salted.withColumn("place", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("place") <= top)
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    totals = words.where("word is null").select("lang", F.col("n").alias("n_words"))
    return ranked.join(F.broadcast(totals) if totals.count() <= 100_000 else totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), F.col("spelled").alias("phrase"), "a", "l", "r", F.col("n_words").alias("n"), F.col("score").cast("long").alias("score")
    )
