"""Token ids by the tokenizers library, with a bounded cache of what it says of single words.

Most words of a corpus recur, so asking the library once a word and task is several times faster
than encoding every text. A text is cut only where its tokens cannot span the cut:

* ``lead``: byte-level BPE whose pre-tokenizer gives a single space to the word after it. A cut
  before a space that has other characters than white space on both sides is always a boundary.
* ``drop``: BPE whose pre-tokenizer drops white space; any space is a boundary. Lower-casing A-Z
  first changes nothing, as the tokenizer lower-cases all.
* ``whole``: any other tokenizer; texts are encoded whole.

Control strings such as an end-of-text mark are ordinary text (``encode_special_tokens``).
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable
from functools import cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from bindwell.llm.text import FORGET

#: Runs of letters, and other words, that a worker keeps twice over (recent and older ones) and the longest kept; all bound its memory.
CACHE_RUNS, CACHE_WORDS, CACHE_LENGTH = 60_000, 20_000, 40
#: Bytes of the texts that are encoded together: words that recur among them are handled once.
SLICE_BYTES = 3 << 20
_BETWEEN = re.compile(rb"(?<=[^\x00-\x20]) (?=[^\x00-\x20])")
#: Words with white space or a control character at an end, and empty ones.
_ODD = r"^[\x00-\x20]|[\x00-\x20]$|^$"
#: White space beyond ASCII, and marks that some rules take for it.
_WIDE_SPACE = re.compile("[\x85\xa0 ᠎ -‏    ⁠　﻿]")
_WIDE_BYTES = (b"\xc2", b"\xe1", b"\xe2", b"\xe3", b"\xef")
#: One or two lines' ends of plain letters (ASCII and Latin-1), each with a full stop or comma at most.
_LETTERS = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+"
_PLAIN = f"^(?P<run>{_LETTERS})(?P<mark>[.,]?)(?:(?P<line>\n)(?P<next>{_LETTERS})(?P<last>[.,]?))?$"
_PIECES = 5


def rule_of(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    steps = json.dumps([spec.get("normalizer"), spec.get("pre_tokenizer")])
    pre = spec.get("pre_tokenizer") or {}
    if spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex"):
        return "lead"
    if '"Lowercase"' in steps and '"Removed"' in steps and '"invert": true' in steps and '"ByteLevel"' in steps:
        return "drop"
    return "whole"


class Recent(dict):
    """A dictionary that forgets, a generation at a time, what was not asked for lately."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.older = most, {}

    def values_of(self, keys: list[bytes], learn: Callable[[list[bytes]], list[bytes]]) -> list[bytes]:
        """Values of distinct keys; ``learn`` gives those of the keys that are not known."""
        if len(self) > self.most:
            self.older = dict(self)
            self.clear()
        values, new = list(map(self.get, keys)), []
        for k, value in enumerate(values):
            if value is None:
                value = self.older.get(keys[k])
                if value is None:
                    new.append(k)
                else:
                    values[k] = self[keys[k]] = value
        for k, value in zip(new, learn([keys[k] for k in new]) if new else [], strict=True):
            values[k] = value
            if len(keys[k]) <= CACHE_LENGTH:
                self[keys[k]] = value
        return values


class Ragged:
    """Rows of ids of any length, one after the other."""

    def __init__(self, ids: np.ndarray, size: np.ndarray):
        self.ids, self.size, self.start = ids, size, np.cumsum(size) - size

    @staticmethod
    def of(values: list[bytes]) -> Ragged:
        return Ragged(np.frombuffer(b"".join(values), "<u4"), np.fromiter(map(len, values), np.int64, len(values)) // 4)

    def take(self, rows: np.ndarray) -> Ragged:
        size = self.size[rows]
        shift = self.start[rows] - (np.cumsum(size) - size)
        return Ragged(self.ids[np.repeat(shift, size) + np.arange(size.sum())], size)

    def joined(self, offsets: np.ndarray) -> Ragged:
        """Rows ``offsets[k]`` to ``offsets[k + 1]`` as one row."""
        ends = np.append(self.start, len(self.ids))[offsets]
        return Ragged(self.ids, np.diff(ends))

    def rows(self) -> list[np.ndarray]:
        return [self.ids[a : a + n] for a, n in zip(self.start.tolist(), self.size.tolist(), strict=True)]


class Encoder:
    """Encodes texts to 32-bit ids; one for each worker."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.rule = rule_of(path)
        self.space = " " if self.rule == "lead" else ""
        self.words, self.runs = Recent(CACHE_WORDS), Recent(CACHE_RUNS)
        #: the model alone: what it is given is one pre-token each
        self.bare = Tokenizer(self.tokenizer.model)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None) or ""
        vocabulary = self.tokenizer.get_vocab()
        #: characters that each token stands for
        self.sizes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.sizes[list(vocabulary.values())] = [len(t.removesuffix(suffix)) for t in vocabulary]
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        #: the library's own stand-in characters for bytes, by the bytes of a text read as Latin-1
        self.stand_in = {k: level.pre_tokenize_str(chr(k))[0][0] for k in range(0x20, 0x7F)}
        self.stand_in |= {k: level.pre_tokenize_str(chr(k))[0][0][-1] for k in range(0x80, 0xC0)}  # the second byte of U+0080 to U+00BF
        self.stand_in |= {0xC3: level.pre_tokenize_str("\xc3")[0][0][0]}
        marks = [b".", b",", b"\n"]
        self.marks = dict(zip([b"", *marks], [b"", *self._ask(marks)], strict=True))

    def _ask(self, texts: list[bytes]) -> list[bytes]:
        """The library's ids of whole texts."""
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]

    def _learn_runs(self, runs: list[bytes]) -> list[bytes]:
        """Ids of marks, and of runs of letters: each is one pre-token, so the model is asked for all of them at once."""
        letters = [r for r in runs if r not in self.marks]
        text = b"\n".join(letters)
        if self.rule == "drop":
            text = text.decode().lower().encode()
        parts = text.decode("latin-1").translate(self.stand_in).split("\n") if letters else []
        found = np.array(self.bare.encode_batch_fast([parts], is_pretokenized=True, add_special_tokens=False)[0].ids, "<u4")
        # tokens cover their run without gaps: the characters tell where each run's tokens end
        ends = np.searchsorted(np.cumsum(self.sizes[found]), np.cumsum([len(p) for p in parts]), "right")
        ids, ends = found.tobytes(), (4 * ends).tolist()
        learnt = dict(zip(letters, (ids[a:b] for a, b in pairwise([0, *ends])), strict=True))
        return [self.marks[r] if r in self.marks else learnt[r] for r in runs]

    def _of_words(self, words: pa.Array, space: str) -> Ragged:
        """Ids of distinct words with ``space`` before each: plain ones from their pieces, others by asking."""
        found = pc.extract_regex(words, _PLAIN)
        plain = pc.is_valid(found).to_numpy(zero_copy_only=False)
        run, *others = found.filter(pc.is_valid(found)).flatten()
        if space:
            run = pc.binary_join_element_wise(space, run, "")
        coded = pa.concat_arrays([run, *others]).dictionary_encode()
        pieces = self.runs.values_of(coded.dictionary.cast(pa.binary()).to_pylist(), self._learn_runs)
        hard = [space.encode() + w for w in words.filter(pa.array(~plain)).cast(pa.binary()).to_pylist()]
        table = np.full((len(words), _PIECES), len(pieces) + len(hard))  # the last is empty
        table[plain] = coded.indices.to_numpy().reshape(_PIECES, -1).T
        table[~plain, 0] = len(pieces) + np.arange(len(hard))
        of_pieces = Ragged.of([*pieces, *self.words.values_of(hard, self._ask), b""])
        return of_pieces.take(table.ravel()).joined(np.arange(len(words) + 1) * _PIECES)

    def _of_lists(self, lists: pa.ListArray) -> list[np.ndarray]:
        """Ids of texts that are cut into words; the first of each has no space before it."""
        offsets = lists.offsets.to_numpy()
        coded = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        offsets = offsets - offsets[0]
        which, known = coded.indices.to_numpy(), self._of_words(coded.dictionary, self.space)
        if self.space:
            heads = coded.dictionary.take(pa.array(which[offsets[:-1]])).dictionary_encode()
            first = self._of_words(heads.dictionary, "")
            which = which.copy()
            which[offsets[:-1]] = len(known.size) + heads.indices.to_numpy()
            known = Ragged(np.concatenate((known.ids, first.ids)), np.concatenate((known.size, first.size)))
        return known.take(which).joined(offsets).rows()

    def _cut(self, texts: list[bytes]) -> tuple[pa.ListArray, np.ndarray]:
        """The texts' words, and which texts have white space next to a space: it isn't always a boundary there."""
        column = pa.array(texts, pa.string())
        lists = pc.split_pattern(pc.ascii_lower(column) if self.rule == "drop" else column, " ")
        odd = np.zeros(len(texts), bool)
        if self.rule == "lead":
            coded = lists.values.dictionary_encode()
            strange = pc.match_substring_regex(coded.dictionary, _ODD).to_numpy(zero_copy_only=False)
            places = np.flatnonzero(strange[coded.indices.to_numpy()])
            odd[np.searchsorted(lists.offsets.to_numpy(), places, "right") - 1] = True
        return lists, odd

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """The library's ids of each text."""
        whole = [self.rule == "whole" or self.rule == "lead" and any(x in t for x in _WIDE_BYTES) and bool(_WIDE_SPACE.search(t.decode())) for t in texts]
        out = dict(zip(np.flatnonzero(whole).tolist(), (np.frombuffer(x, "<u4") for x in self._ask([t for t, w in zip(texts, whole, strict=True) if w])), strict=True))
        rest = np.flatnonzero(~np.array(whole, bool))
        if len(rest):
            lists, odd = self._cut([texts[k] for k in rest])
            if not odd.all():
                out.update(zip(rest[~odd].tolist(), self._of_lists(lists.filter(pa.array(~odd)) if odd.any() else lists), strict=True))
            if odd.any():
                parts = [_BETWEEN.split(texts[k]) for k in rest[odd]]
                out.update(zip(rest[odd].tolist(), self._of_lists(pa.array(parts, pa.list_(pa.string()))), strict=True))
        return [out[k] for k in range(len(texts))]


@cache
def encoder(path: str) -> Encoder:
    """The worker's encoder, which keeps its words from task to task."""
    return Encoder(path)


FORGET.append(encoder.cache_clear)
