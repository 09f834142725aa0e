"""Chat formatting in budgeted windows.

A conversation is cut into windows of whole turns. Prefix sums of the turns' token counts say how
far a window reaches; each window repeats the system turn and as much recent history as fits its
share, and only the assistant turns that are new in it are targets, so each is learnt once.

The template is ``<s>`` and, for every turn, ``[INST]role[/INST]text</s>``. Control strings inside
a role or text get a backslash after their first character and backslashes are doubled, which
``unescape`` reverses, so a text can neither end its turn nor begin another.

Turns are sorted and streamed: a task holds one window and its history, however long a conversation.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bindwell.llm.encode import encoder

_CONTROL = re.compile(r"<(?=/?s>)|\[(?=/?INST\])")
_ESCAPED = re.compile(r"\\(\\?)")
_BATCH = 512


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0] + "\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def format_turn(role: str, text: str) -> str:
    return f"[INST]{escape(role)}[/INST]{escape(text)}</s>"


def parse_window(text: str) -> list[tuple[str, str, int, int]]:
    """(role, text, first character, end) of each turn; the range is that of the escaped text."""
    turns, at = [], len("<s>")
    if not text.startswith("<s>"):
        raise ValueError("a window begins with <s>")
    while at < len(text):
        middle = text.index("[/INST]", at)
        end = text.index("</s>", middle)
        first = middle + len("[/INST]")
        turns.append((unescape(text[at + len("[INST]") : middle]), unescape(text[first:end]), first, end))
        at = end + len("</s>")
    return turns


class Windows:
    """Windows of one conversation, made as its turns arrive."""

    def __init__(self, budget: int, history: int, history_turns: int, lead: int):
        self.lead = lead  # tokens of what every window begins with
        self.budget, self.history, self.history_turns = budget, history, history_turns
        self.system: tuple | None = None
        self.past: deque = deque(maxlen=history_turns)  # (index, role, text, tokens before it, tokens)
        self.new: list[tuple] = []
        self.total = self.index = self.number = self.used = 0

    def _repeated(self) -> list[tuple]:
        """The system turn and the longest run of turns before the window that its share allows."""
        past = [t for t in self.past if self.system is None or t[0] != self.system[0]]
        sums = [t[3] for t in past]
        cut = bisect_left(sums, self.total - self.history)
        return ([self.system] if self.system and self.index else []) + past[cut:]

    def add(self, role: str, text: str, tokens: int):
        """Take one turn; gives the window that it closes, if any."""
        done = None
        if self.new and self.used + tokens > self.budget:
            done = self.close()
        turn = (self.index, role, text, self.total, tokens)
        if not self.new:
            self.before = self._repeated()
            while len(self.before) > 1 and self.lead + sum(t[4] for t in self.before) + tokens > self.budget:
                self.before.pop(1 if self.system else 0)
            self.used = self.lead + sum(t[4] for t in self.before)
        if self.index == 0 and role == "system":
            self.system = turn
        self.new.append(turn)
        self.used += tokens
        self.total += tokens
        self.index += 1
        return done

    def close(self):
        """The window as (number, text, turn indices, targets as flat character ranges)."""
        text, turns, targets = "<s>", [], []
        fresh = self.new[0][0]
        for index, role, content, _, _ in [*self.before, *self.new]:
            piece = format_turn(role, content)
            if index >= fresh and role == "assistant":
                targets += [len(text) + len(piece) - len("</s>") - len(escape(content)), len(text) + len(piece) - len("</s>")]
            text += piece
            turns.append(index)
        row = (self.number, text, turns, targets)
        self.past.extend(self.new)
        self.new = []
        self.number += 1
        return row


def format_conversations(
    turns: DataFrame,
    tokenizer_path: str,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    budget: int = 1024,
    history: int = 256,
    history_turns: int = 8,
) -> DataFrame:
    """Training windows of all conversations.

    Returns for each window: ``conv_col``, ``window``, ``text``, ``turns`` (index of every turn in it),
    ``targets`` (flat list of character ranges under the loss mask), ``n_tokens`` (of the window's text as
    it stands). The turns' counts and that of the beginning add up to ``budget`` at most, and signs that
    meet where turns are joined make no more tokens than they do apart, so ``n_tokens`` is in it too; only
    a turn longer than ``budget`` is a larger window, with at most one repeated turn. Turns come in order of ``turn_col``,
    then role and text (nulls first); null roles and texts are empty; null ids are one conversation;
    an empty table gives an empty result. Other columns are not read.
    """
    kind = turns.schema[conv_col].dataType
    schema = T.StructType([
        T.StructField(conv_col, kind), T.StructField("window", T.LongType()), T.StructField("text", T.StringType()),
        T.StructField("turns", T.ArrayType(T.LongType())), T.StructField("targets", T.ArrayType(T.LongType())), T.StructField("n_tokens", T.LongType()),
    ])

    def batch_of(rows, conv_type):
        types = [conv_type, pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        counts = pa.array([len(ids) for ids in encoder(tokenizer_path).encode([r[2].encode() for r in rows])], pa.int64())
        return pa.RecordBatch.from_arrays([*(pa.array([r[k] for r in rows], t) for k, t in enumerate(types)), counts], names=schema.names)

    def run(batches):
        current, windows, out, conv_type = object(), None, [], None
        lead = len(encoder(tokenizer_path).encode([b"<s>"])[0])
        for batch in batches:
            conv_type = batch.column(0).type
            for k in range(0, batch.num_rows, _BATCH):
                part = batch.slice(k, _BATCH)
                rows = [(c, role or "", text or "") for c, role, text in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True)]
                counts = encoder(tokenizer_path).encode([format_turn(role, text).encode() for _, role, text in rows])
                for (conv, role, text), ids in zip(rows, counts, strict=True):
                    if conv != current or windows is None:
                        if windows is not None:
                            out.append((current, *windows.close()))
                        current, windows = conv, Windows(budget, history, history_turns, lead)
                    done = windows.add(role, text, len(ids))
                    if done:
                        out.append((current, *done))
                if len(out) >= 64:
                    yield batch_of(out, conv_type)
                    out = []
        if windows is not None:
            out.append((current, *windows.close()))
        if out:
            yield batch_of(out, conv_type)

    wanted = turns.select(conv_col, role_col, text_col, F.col(turn_col).alias("__turn"))
    ordered = wanted.repartition(conv_col).sortWithinPartitions(conv_col, "__turn", role_col, text_col)
    return ordered.select(conv_col, role_col, text_col).mapInArrow(run, schema)


def read_back(windows: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """What the windows say, parsed from their text: digests of the turns and of the targets."""
    schema = T.StructType([
        T.StructField(conv_col, windows.schema[conv_col].dataType), T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()),
        T.StructField("loss_chars", T.LongType()), T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType()),
    ])

    def run(batches):
        current, state, out, conv_type = object(), None, [], None

        def result():
            n, turns, chars, loss, formatted = state
            return (current, n, turns.hexdigest(), chars, loss.hexdigest(), formatted)

        def batch_of(rows):
            types = [conv_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=schema.names)

        for batch in batches:
            conv_type = batch.column(0).type
            for conv, text, indices, targets in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if conv != current or state is None:
                    if state is not None:
                        out.append(result())
                    current, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for index, (role, content, _, _) in zip(indices, parse_window(text), strict=True):
                    if index == state[0]:
                        state[1].update(f"{role}\n{content}\n".encode())
                        state[0] += 1
                for a, b in zip(targets[::2], targets[1::2], strict=True):
                    content = unescape(text[a:b])
                    state[2] += len(content)
                    state[3].update(content.encode())
                state[4] += len(text)
            if len(out) >= 1000:
                yield batch_of(out)
                out = []
        if state is not None:
            out.append(result())
        if out:
            yield batch_of(out)

    ordered = windows.repartition(conv_col).sortWithinPartitions(conv_col, "window")
    return ordered.select(conv_col, "text", "turns", "targets").mapInArrow(run, schema)
