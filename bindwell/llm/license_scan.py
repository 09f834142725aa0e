"""Fuzzy search for short licence notices.

A notice may differ from its wording by at most ``k`` character edits. Cut into ``k + 1`` pieces,
one piece at least survives unchanged (pigeonhole), so an Aho-Corasick search for the pieces finds
every candidate place; the regex library's bounded-error matching then verifies the place and says
where the notice stands and with how many edits. A place without edits is the exact occurrence.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from bindwell.llm.text import ALNUM, LOWER, map_texts

#: The phrases and labels of the contract, whose unedited places are counted.
BASE = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
#: Further notices that the fuzzy search looks for, as normalised words.
NOTICES = (
    ("gnu general public license", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("mozilla public license", "mpl"),
    ("eclipse public license", "epl"),
    ("redistribution and use in source and binary forms", "bsd"),
    ("permission is hereby granted free of charge", "mit"),
    ("permission to use copy modify and or distribute", "isc"),
    ("creative commons attribution", "cc-by"),
    ("dedicated to the public domain", "public-domain"),
    ("all rights reserved", "all-rights-reserved"),
)
_WORD_BYTES = np.where(ALNUM, np.arange(256), 0x20).astype(np.uint8)
_TO_WORDS = bytes(_WORD_BYTES[LOWER])


def normalised(text: bytes) -> str:
    """Lower-cased words, each with one space before and after."""
    return " " + " ".join(x.decode("utf-8", "replace") for x in text.translate(_TO_WORDS).split()) + " "


def pieces(phrase: str, edits: int) -> list[tuple[int, str]]:
    """The phrase cut into ``edits + 1`` pieces of about the same length, with their places."""
    cuts = [len(phrase) * k // (edits + 1) for k in range(edits + 2)]
    return [(a, phrase[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def edits_for(phrase: str, letters_per_edit: int) -> int:
    """Edits that a phrase of this length may have: one for every so many characters."""
    return len(phrase) // letters_per_edit


@cache
def _machine(notices: tuple, letters_per_edit: int):
    import ahocorasick
    import regex

    seeds: dict[str, list[tuple[int, int]]] = {}
    checks = []
    for k, (phrase, label) in enumerate(notices):
        edits = edits_for(phrase, letters_per_edit)
        for at, piece in pieces(phrase, edits):
            seeds.setdefault(piece, []).append((k, at))
        checks.append((phrase, label, edits, regex.compile(f"(?e)(?<= )(?:{regex.escape(phrase)}){{e<={edits}}}(?= )")))
    machine = ahocorasick.Automaton()
    for piece, owners in seeds.items():
        machine.add_word(piece, (len(piece), owners))
    machine.make_automaton()
    return machine, checks


def find_notices(text: str, notices: tuple, letters_per_edit: int) -> list[tuple[str, int, int, int, int]]:
    """(label, first character, end, edits, notice) of each notice in normalised ``text``."""
    machine, checks = _machine(notices, letters_per_edit)
    places: dict[int, list[int]] = {}
    for end, (length, owners) in machine.iter(text):
        for k, at in owners:
            places.setdefault(k, []).append(end - length + 1 - at)
    found = []
    for k, begins in places.items():
        phrase, label, edits, pattern = checks[k]
        region: list[int] = []
        regions: list[list[int]] = []
        for begin in sorted(set(begins)):
            a, b = max(0, begin - edits - 1), min(len(text), begin + len(phrase) + edits + 1)
            if region and a <= region[1]:
                region[1] = b
            else:
                region = [a, b]
                regions.append(region)
        for a, b in regions:
            for m in pattern.finditer(text, a, b, overlapped=False):
                found.append((label, m.start(), m.end(), sum(m.fuzzy_counts), k))
    return sorted(found, key=lambda x: (x[1], x[2], x[4]))


def exact_places(text: str, notices: tuple, letters_per_edit: int, n: int) -> list[tuple[int, int]]:
    """(place, notice) of every unedited occurrence of the first ``n`` notices, overlapping ones too."""
    machine, _ = _machine(notices, letters_per_edit)
    found = []
    for end, (length, owners) in machine.iter(text):
        for k, at in owners:
            begin = end - length + 1
            if k < n and at == 0 and text.startswith(f" {notices[k][0]} ", begin - 1) and begin > 0:
                found.append((begin, k))
    return found


def scan_licenses(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    base: Iterable[tuple[str, str]] = BASE,
    notices: Iterable[tuple[str, str]] = NOTICES,
    letters_per_edit: int = 12,
) -> DataFrame:
    """The licence notices of each document, with spans in words and edits.

    Returns for each row: ``id_col``, ``n_words`` and ``spans``, an array of (label, base,
    first_word, last_word, edits, score, found) ordered by place: ``base`` marks the unedited
    places of a base phrase; ``score`` is one less the edits' share of the notice.

    A null, empty or wordless text has no words and no spans; repeated rows are scanned singly; an
    empty table gives an empty result. Other columns are not read.
    """
    base, every = tuple(base), (*base, *notices)
    schema = T.StructType([
        T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_words", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([
            T.StructField("label", T.StringType()), T.StructField("base", T.BooleanType()), T.StructField("first_word", T.LongType()),
            T.StructField("last_word", T.LongType()), T.StructField("edits", T.IntegerType()), T.StructField("score", T.DoubleType()), T.StructField("found", T.StringType()),
        ]))),
    ])
    kind = pa.list_(pa.struct([
        ("label", pa.string()), ("base", pa.bool_()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int32()), ("score", pa.float64()), ("found", pa.string()),
    ]))

    def one(raw: bytes):
        text = normalised(raw)
        n_words = text.count(" ") - 1 if len(text) > 2 else 0
        exact = exact_places(text, every, letters_per_edit, len(base))
        held = [(every[k][1], True, b, b + len(every[k][0]), 0, k) for b, k in exact]
        at = {(b, k) for b, k in exact}
        held += [(label, False, a, b, edits, k) for label, a, b, edits, k in find_notices(text, every, letters_per_edit) if (a, k) not in at]
        spans, at, first = [], 0, -1
        for label, is_base, a, b, edits, k in sorted(held, key=lambda x: (x[2], x[3], x[5])):
            first += text.count(" ", at, a)  # spans come in order of place: words are counted once
            at = a
            spans.append({
                "label": label, "base": is_base, "first_word": first, "last_word": first + text.count(" ", a, b), "edits": edits,
                "score": max(0.0, 1 - edits / len(every[k][0])), "found": text[a:b],
            })
        return n_words, spans

    def run(batch):
        rows = [one((x or "").encode()) for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], kind)], names=schema.names)

    return map_texts(docs, [id_col, text_col], run, schema)
