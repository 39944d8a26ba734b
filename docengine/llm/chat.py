"""Operator 4, chat formatting: columnar byte assembly of conversations.

A turn becomes ``<|im_start|>role\\ntext<|im_end|>\\n``. For a batch of turns the lengths of all segments, their
cumulative offsets and the scatter indices are computed in numpy, and headers and contents are copied into one
preallocated buffer, which becomes the data buffer of the resulting Arrow column as it is.

Control strings start with ``<|``. Inside texts and roles every ``<``, backslashes, ``|`` gets one more backslash before
the bar, so no control string is left and taking it away restores the text. In roles a backslash and a line break are
escaped as well, because a line break ends the header.

A conversation is read in order of turn, then role and text (for repeated turns), nulls first. Null roles and texts are
empty; a null conv_id is a conversation of its own. The loss mask covers the escaped bytes of assistant texts.
Conversations are laid out by conv_id and sorted by Spark; a worker streams over its rows and holds one batch, so one
conversation may have any number of turns: it comes out in several parts, in order.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

START, END = "<|im_start|>", "<|im_end|>"
LEARNT = "assistant"
PARTS = "conv_id long, part long, formatted string, loss_start array<long>, loss_len array<long>"


def escape(a: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(a, r"<(\\*)\|", r"<\1\\|")


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def escape_role(a: pa.Array) -> pa.Array:
    return escape(pc.replace_substring(pc.replace_substring(a, "\\", "\\\\"), "\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role), flags=re.S)


def _bytes_of(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and the data bytes of a string column without nulls."""
    a = a.cast(pa.large_string())
    offsets = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    data = np.frombuffer(a.buffers()[2], np.uint8) if a.buffers()[2] is not None else np.empty(0, np.uint8)
    return offsets, data


def _copy(out: np.ndarray, at: np.ndarray, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
    """Copy segments data[start : start + size] to out[at :], all at once, by scatter indices."""
    total = int(size.sum())
    if total:
        within = np.arange(total) - np.repeat(np.cumsum(size) - size, size)
        out[np.repeat(at, size) + within] = data[np.repeat(start, size) + within]


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of formatted turns in one buffer, with each turn's offset and its text's place in it."""
    n = len(roles)
    role_at, role_data = _bytes_of(escape_role(roles))
    text_at, text_data = _bytes_of(escape(texts))
    role_n, text_n = np.diff(role_at), np.diff(text_at)
    fixed = [np.frombuffer(x.encode(), np.uint8) for x in (START, "\n", END + "\n")]
    size = role_n + text_n + sum(map(len, fixed))
    at = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(int(at[-1]), np.uint8)
    zero = np.zeros(n, np.int64)
    text_to = at[:-1] + len(fixed[0]) + role_n + len(fixed[1])
    for data, start, length, to in (
        (fixed[0], zero, zero + len(fixed[0]), at[:-1]),
        (role_data, role_at[:-1], role_n, at[:-1] + len(fixed[0])),
        (fixed[1], zero, zero + len(fixed[1]), text_to - len(fixed[1])),
        (text_data, text_at[:-1], text_n, text_to),
        (fixed[2], zero, zero + len(fixed[2]), text_to + text_n),
    ):
        _copy(out, to, data, start, length)
    return out, at, text_to, text_n


def format_chats(turns: DataFrame) -> DataFrame:
    """Formatted conversations: (conv_id, part, formatted, loss_start, loss_len), parts of one conversation in order and
    in one partition. The loss places are bytes within the part."""
    small_batches(turns.sparkSession)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, part = object(), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_pylist()
            out, at, text_to, text_n = assemble(batch.column(2), batch.column(3))
            learnt = np.array(pc.equal(batch.column(2), LEARNT))
            cut = [0, *(i for i in range(1, len(ids)) if ids[i] != ids[i - 1]), len(ids)]
            parts, starts, lens = [], [], []
            for a, b in zip(cut, cut[1:], strict=False):
                part = part + 1 if ids[a] == before else 0
                before = ids[a]
                parts.append(part)
                mine = a + np.flatnonzero(learnt[a:b])
                starts.append(text_to[mine] - at[a])
                lens.append(text_n[mine])
            offsets = pa.py_buffer(at[cut].astype(np.int64))
            formatted = pa.LargeStringArray.from_buffers(len(parts), offsets, pa.py_buffer(out))
            yield pa.RecordBatch.from_arrays([pa.array([ids[a] for a in cut[:-1]], pa.int64()), pa.array(parts, pa.int64()), formatted.cast(pa.string()), pa.array(starts, pa.list_(pa.int64())), pa.array(lens, pa.list_(pa.int64()))], names=["conv_id", "part", "formatted", "loss_start", "loss_len"])

    return rows.mapInArrow(run, PARTS)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted part, unescaped."""
    out = []
    for x in formatted.split(START)[1:]:
        if not x.endswith(END + "\n"):
            raise ValueError("a turn isn't closed")
        role, text = x[: -len(END) - 1].split("\n", 1)
        out.append((unescape_role(role), unescape(text)))
    return out


def digests(parts: DataFrame) -> DataFrame:
    """What the formatted conversations hold, read back from them: turns, their digest, and the text under the loss mask.
    The parts of a conversation follow each other, so digests grow as the rows stream by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list = []

        def done() -> tuple:
            conv, n, turns, loss_n, loss, chars = state
            return conv, n, turns.hexdigest(), loss_n, loss.hexdigest(), chars

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

        for batch in batches:
            rows = []
            for conv, part, formatted, starts, lens in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part == 0:
                    if state:
                        rows.append(done())
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in read_turns(formatted):
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode())
                raw = formatted.encode()
                for at, size in zip(starts, lens, strict=True):
                    text = unescape(raw[at : at + size].decode())
                    state[3] += len(text)
                    state[4].update(text.encode())
                state[5] += len(formatted)
            if rows:
                yield batch_of(rows)
        if state:
            yield batch_of([done()])

    return parts.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
