"""Language identification: sparse multinomial logistic regression on character n-grams.

Features are hashed n-grams of one to three characters of the lower-cased text (other characters
than letters count as one space), with TF-IDF values: the n-gram's share of the text's n-grams times
its inverse document frequency. Weights are trained by follow-the-regularised-leader with elastic-net
penalties, which leaves most of them zero; a temperature fitted on a held-back part of the sample
calibrates the probabilities.

The classifier is fitted on at most ``max_train`` labelled rows, the ones with the smallest hash of
their id. As term frequency is a share, a text's score is the mean of one weight vector an n-gram, so
prediction reads whole texts of any length in one pass, without a table of their n-grams.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bindwell.llm.text import buffers, forget, in_batches, portions, trimmed

ORDERS = (1, 2, 3)
UNKNOWN = "und"


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """By code point: its lower case (one character) or a space, and whether it is a letter."""
    lower = np.full(0x110000, 0x20, np.uint32)
    letter = np.zeros(0x110000, bool)
    for code in range(0x110000):
        c = chr(code)
        if c.isalpha():
            small = c.lower()
            lower[code] = ord(small) if len(small) == 1 else code
            letter[code] = True
    return lower, letter


@dataclass
class Grams:
    """Hashed n-grams of a slice of texts: feature and row of each, letters by row."""

    feature: np.ndarray
    row: np.ndarray
    letters: np.ndarray
    rows: int


def grams(column: pa.Array, bits: int) -> Grams:
    data, offsets = buffers(column)
    rows = len(offsets) - 1
    lower, letter = _tables()
    codes = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    begins = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[offsets]
    row = np.repeat(np.arange(rows, dtype=np.int32), np.diff(begins))
    is_letter = letter[codes]
    letters = np.bincount(row[is_letter], minlength=rows)
    codes = lower[codes]
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 0x20) | (codes[:-1] != 0x20) | (row[1:] != row[:-1])
    codes, row = codes[keep], row[keep]
    features, owners = [], []
    for n in ORDERS:
        size = len(codes) - n + 1
        if size <= 0:
            continue
        h = np.full(size, n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
        for k in range(n):
            h = (h ^ codes[k : k + size]) * np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(15)
        same = row[:size] == row[n - 1 :]
        features.append((h >> np.uint32(32 - bits))[same])
        owners.append(row[:size][same])
    if not features:
        return Grams(np.empty(0, np.uint32), np.empty(0, np.int32), letters, rows)
    return Grams(np.concatenate(features), np.concatenate(owners), letters, rows)


@dataclass
class Model:
    """Languages, weights of each feature (IDF included) and language, biases, temperature."""

    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    bits: int

    def scores(self, g: Grams) -> np.ndarray:
        total = np.maximum(np.bincount(g.row, minlength=g.rows), 1)
        sums = [np.bincount(g.row, weights=self.weights[k][g.feature], minlength=g.rows) for k in range(len(self.languages))]
        return (np.array(sums).reshape(len(self.languages), g.rows) / total).T + self.bias

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        g = grams(column, self.bits)
        if not self.languages:
            return [UNKNOWN] * g.rows, np.zeros(g.rows)
        p = softmax(self.scores(g) / self.temperature)
        best = p.argmax(axis=1)
        known = g.letters > 0
        names = [self.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
        return names, np.where(known, p[np.arange(g.rows), best], 0.0)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def counts(column: pa.Array, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The n-grams of each text and how often each stands in it."""
    g = grams(column, bits)
    both, n = np.unique(g.row.astype(np.int64) << bits | g.feature, return_counts=True)
    ends = np.searchsorted(both, np.arange(g.rows + 1) << bits)
    feature = (both & ((1 << bits) - 1)).astype(np.uint32)
    return [(feature[a:b], n[a:b].astype(np.uint32)) for a, b in zip(ends, ends[1:], strict=False)]


def fit(
    texts: list[tuple[np.ndarray, np.ndarray]], labels: list[str], bits: int = 18, epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-3, scale: float = 20.0
) -> Model:
    """Train on a sample of texts' n-gram ``counts``; every fifth text is held back for the temperature."""
    languages = sorted(set(labels))
    if not languages:
        return Model([], np.zeros((0, 1 << bits)), np.zeros(0), 1.0, bits)
    number = {x: k for k, x in enumerate(languages)}
    rows = [(feature, count / max(1, int(count.sum()))) for feature, count in texts]
    df = np.zeros(1 << bits)
    for feature, _ in rows:
        df[feature] += 1
    idf = (np.log((1 + len(rows)) / (1 + df)) + 1) * scale
    n = len(languages)
    z, squares = np.zeros(((1 << bits) + 1, n)), np.zeros(((1 << bits) + 1, n))

    def weights(at):
        zz = z[at]
        shrunk = np.sign(zz) * np.maximum(np.abs(zz) - l1, 0)
        return -shrunk / ((beta + np.sqrt(squares[at])) / alpha + l2)

    train = [k for k in range(len(rows)) if k % 5 or len(rows) < 10]
    held = [k for k in range(len(rows)) if not k % 5 or len(rows) < 10]
    bias_at = 1 << bits
    for epoch in range(epochs):
        for k in np.random.default_rng(epoch).permutation(train):
            feature, share = rows[k]
            at = np.append(feature, bias_at)
            value = np.append(share * idf[feature], 1.0)
            w = weights(at)
            p = softmax(value @ w)
            p[number[labels[k]]] -= 1
            g = value[:, None] * p
            sigma = (np.sqrt(squares[at] + g * g) - np.sqrt(squares[at])) / alpha
            z[at] += g - sigma * w
            squares[at] += g * g
    full = weights(np.arange((1 << bits) + 1))
    model = Model(languages, np.ascontiguousarray((full[:-1] * idf[:, None]).T.astype(np.float32)), full[-1], 1.0, bits)
    logits = np.array([model.weights[:, rows[k][0]].astype(np.float64) @ rows[k][1] + model.bias for k in held])
    truth = np.array([number[labels[k]] for k in held])
    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
    loss = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(truth)), truth], 1e-12)).mean() for t in grid]
    model.temperature = float(grid[int(np.argmin(loss))])
    return model


def train(docs: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", max_train: int = 4000, max_bytes: int = 64 << 20, bits: int = 18, **options) -> Model:
    """Fit on the at most ``max_train`` rows that are ``usable`` and have the smallest hash of their id.

    Tasks count the n-grams of the whole texts; the counts, eight bytes for each n-gram that a text has,
    come to the driver in that order until ``max_bytes`` of them are there.
    """
    labelled = docs.where(usable & F.col(label_col).isNotNull())
    order = [F.xxhash64(F.col(id_col).cast("string")), F.col(id_col)]
    chosen = labelled.select(F.col(id_col).alias("__id")).orderBy(*order).limit(max_train).distinct()
    # the chosen ids are at most max_train, so the broadcast is bounded
    joined = labelled.join(F.broadcast(chosen), F.col(id_col) == F.col("__id"), "left_semi").where(F.col(text_col).isNotNull())
    wanted = joined.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(label_col).cast("string").alias("label"))
    place = ["h", "id", "th", "label"]  # rows that repeat an id come in one order
    wanted = wanted.select(F.xxhash64(F.col("id").cast("string")).alias("h"), "id", F.xxhash64("text").alias("th"), "label", "text")
    schema = T.StructType([*wanted.schema.fields[:4], T.StructField("feature", T.BinaryType()), T.StructField("n", T.BinaryType())])

    def run(batches):
        for batch in batches:
            for part in portions(batch, 4, 1 << 20):
                found = counts(part.column(4), bits)
                yield pa.RecordBatch.from_arrays([*part.columns[:4], *(pa.array([x[k].tobytes() for x in found], pa.binary()) for k in (0, 1))], names=schema.names)

    sample, used = [], 0
    for row in in_batches(wanted).mapInArrow(trimmed(run), schema).orderBy(*place).toLocalIterator():
        used += len(row["feature"]) + len(row["n"])
        if len(sample) == max_train or sample and used > max_bytes:
            break
        sample.append(row)
    sample.sort(key=lambda r: (str(r["id"]), r["th"], r["label"]))
    return fit([(np.frombuffer(r["feature"], np.uint32), np.frombuffer(r["n"], np.uint32)) for r in sample], [r["label"] for r in sample], bits, **options)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """The language of every whole text.

    Returns for each row: ``id_col``, ``lang_pred``, ``score`` (calibrated probability, 0 to 1) and
    the columns named in ``carry``. A text that is null or has no letter is ``und`` with score 0, as
    is every text if the sample had no labels. Rows that repeat are judged singly; an empty table
    gives an empty result. Other columns are not read.
    """
    columns = [id_col, *(c for c in carry if c not in (id_col, text_col)), text_col]
    schema = T.StructType([docs.schema[id_col], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), *(docs.schema[c] for c in carry)])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        forget()
        for batch in batches:
            for part in portions(batch, len(columns) - 1, 1 << 20):
                names, score = shared.value.predict(part.column(len(columns) - 1))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(names, pa.string()), pa.array(score, pa.float64()), *(part.column(columns.index(c)) for c in carry)], names=schema.names
                )

    return in_batches(docs).select(*columns).mapInArrow(trimmed(run), schema)
