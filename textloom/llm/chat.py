"""Chat formatting by columnar byte assembly.

Turns are sorted over the whole table by conversation and turn, in ranges, so a conversation of any length is spread
over tasks. A task takes turns batch by batch and lays out five segments for each: opening mark, role, end of role,
text, closing mark. Segment lengths give cumulative offsets, offsets give scatter indices, and marks and contents are
copied in runs into one preallocated buffer that becomes an Arrow string column.

Output has a row for each run of turns of a conversation that a batch holds: most conversations are one row, long
ones several, in order of (task, part).

Escaping. A control string in a role or text gets a backslash after its first character; one that has backslashes
there already gets one more. Unescaping takes one away. So no control string is left inside a turn, and every text
can be had back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm._arrays import lean


@dataclass(frozen=True)
class Template:
    """Marks around turns, other strings that no text may hold bare, and the roles whose texts count for the loss."""

    open: str = "<|im_start|>"
    role_end: str = "<|im_sep|>"
    close: str = "<|im_end|>"
    reserved: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>")
    loss_roles: tuple[str, ...] = ("assistant",)

    def pattern(self) -> str:
        """First character, backslashes, and the rest of a control string, for RE2 and Python alike."""
        every = sorted({self.open, self.role_end, self.close, *self.reserved}, key=len, reverse=True)
        firsts = "".join(sorted({re.escape(c[0]) for c in every}))
        return rf"([{firsts}])(\\*)({'|'.join(re.escape(c[1:]) for c in every)})"

    def escape(self, texts: pa.Array) -> pa.Array:
        return pc.replace_substring_regex(texts, self.pattern(), r"\1\\\2\3")

    def unescape(self, text: str) -> str:
        return re.sub(self.pattern(), lambda m: m[1] + m[2][1:] + m[3], text)


#: Bytes of turns that are assembled at once.
_RUN = 4_000_000


def _copy(out: np.ndarray, to: np.ndarray, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> None:
    """out[to : to + length] = data[start : start + length] for each segment, through scatter indices."""
    if not len(lengths):
        return
    within = np.arange(lengths.sum(), dtype=np.int64) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[np.repeat(to, lengths) + within] = data[np.repeat(starts, lengths) + within]


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(texts.buffers()[2] or b"", np.uint8), offsets


def _assemble(conv: np.ndarray, roles: pa.Array, texts: pa.Array, template: Template) -> tuple[np.ndarray, pa.Array, list, list]:
    """Turns in order to rows: (first turn of each row, formatted strings, loss span starts, loss span ends in bytes)."""
    loss = np.isin(np.array(roles.to_pylist(), object), template.loss_roles)
    roles, texts = template.escape(roles), template.escape(texts)
    (role_data, role_at), (text_data, text_at) = _bytes_of(roles), _bytes_of(texts)
    marks = [np.frombuffer(m.encode(), np.uint8) for m in (template.open, template.role_end, template.close)]
    n = len(texts)
    lengths = np.empty((n, 5), np.int64)
    lengths[:, 0], lengths[:, 2], lengths[:, 4] = (len(m) for m in marks)
    lengths[:, 1], lengths[:, 3] = np.diff(role_at), np.diff(text_at)
    ends = np.cumsum(lengths.ravel()).reshape(n, 5)
    starts = ends - lengths
    out = np.empty(int(ends[-1, 4]) if n else 0, np.uint8)
    for k, mark in zip((0, 2, 4), marks, strict=True):
        out[(starts[:, k][:, None] + np.arange(len(mark))).ravel()] = np.tile(mark, n)
    for k, data, at in ((1, role_data, role_at), (3, text_data, text_at)):
        _copy(out, starts[:, k], data, at[:-1], lengths[:, k])
    first = np.flatnonzero(np.concatenate(([True], conv[1:] != conv[:-1]))) if n else np.zeros(0, np.int64)
    offsets = np.append(starts[first, 0], len(out))
    rows = pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(out)])
    of = np.searchsorted(first, np.arange(n), "right") - 1
    span_starts, span_ends = starts[:, 3] - offsets[of], ends[:, 3] - offsets[of]
    cut = [(a, b) for a, b in zip(first, np.append(first[1:], n), strict=True)]
    return first, rows, [span_starts[a:b][loss[a:b]].tolist() for a, b in cut], [span_ends[a:b][loss[a:b]].tolist() for a, b in cut]


def format_chats(turns: DataFrame, conv_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text", template: Template = Template()) -> DataFrame:
    """(conv_id, task, part, n_turns, formatted, loss_starts, loss_ends): runs of whole turns of each conversation.

    A conversation is its rows in the order of (task, part), joined with nothing between. loss spans are byte ranges
    of `formatted` that hold the escaped texts of loss roles. Turns are in order of turn, nulls first; turns that tie
    are in order of role and text. Null roles and texts are empty. Rows with a null conversation are a conversation.
    Repeated rows are turns of their own. Other columns aren't carried; an empty table gives an empty result.
    """
    cols = [F.col(conv_column).alias("conv"), F.col(turn_column).alias("turn"), F.coalesce(F.col(role_column), F.lit("")).alias("role"), F.coalesce(F.col(text_column), F.lit("")).alias("text")]
    order = ["conv", "turn", "role", "text"]
    ranged = turns.select(*cols).withColumn("h", F.xxhash64("role", "text")).repartitionByRange("conv", "turn", "role", "h").sortWithinPartitions(*order)
    kind = ranged.schema["conv"].dataType.simpleString()

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = 0
        for b in batches:
            size = np.cumsum(pc.binary_length(b.column(2)).to_numpy(zero_copy_only=False).astype(np.int64))
            cuts = np.unique(np.concatenate(([0], np.flatnonzero(np.diff(size // _RUN)) + 1, [b.num_rows])))
            for a, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                own = b.slice(a, e - a)
                codes = own.column(0).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                first, rows, los, his = _assemble(codes, own.column(1), own.column(2), template)
                n = np.diff(np.append(first, e - a))
                yield pa.RecordBatch.from_arrays(
                    [own.column(0).take(pa.array(first)), own.column(3).take(pa.array(first)), pa.array(part + np.arange(len(first)), pa.int64()), pa.array(n, pa.int64()), rows.cast(pa.string()), pa.array(los, pa.list_(pa.int64())), pa.array(his, pa.list_(pa.int64()))],
                    [conv_column, "task", "part", "n_turns", "formatted", "loss_starts", "loss_ends"],
                )
                part += len(first)

    schema = f"`{conv_column}` {kind}, task int, part bigint, n_turns bigint, formatted string, loss_starts array<bigint>, loss_ends array<bigint>"
    return ranged.select("conv", "role", "text", F.spark_partition_id().alias("task")).mapInArrow(lean(f), schema)


def read_turns(formatted: str, template: Template = Template()) -> list[tuple[str, str]]:
    """The (role, text) turns that a formatted string holds."""
    out = []
    for turn in formatted.split(template.close)[:-1]:
        role, _, text = turn[len(template.open) :].partition(template.role_end)
        out.append((template.unescape(role), template.unescape(text)))
    return out


def digest_chats(formatted: DataFrame, conv_column: str = "conv_id", template: Template = Template()) -> DataFrame:
    """A row for each conversation: n_turns, and digests of its turns and of its text under the loss mask, read back from the output.

    turns_sha256 is of role, newline, text, newline for each turn. A SHA-256 needs its bytes in order, so a
    conversation's rows go to one task, which holds one row of them at a time.
    """
    kind = formatted.schema[conv_column].dataType.simpleString()

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, out = None, []

        def closed() -> tuple:
            return (state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5])

        for b in batches:
            for conv, text, los, his in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if state is None or conv != state[0]:
                    if state:
                        out.append(closed())
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, content in read_turns(text, template):
                    state[1] += 1
                    state[2].update(f"{role}\n{content}\n".encode())
                raw = text.encode()
                for lo, hi in zip(los, his, strict=True):
                    content = template.unescape(raw[lo:hi].decode())
                    state[3] += len(content)
                    state[4].update(content.encode())
                state[5] += len(text)
            if len(out) >= 1000:
                yield batch(out)
                out = []
        if state:
            out.append(closed())
        if out:
            yield batch(out)

    names = [conv_column, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    arrow = formatted.sparkSession.createDataFrame([], f"`{conv_column}` {kind}").toArrow().schema.field(0).type

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (arrow, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    parts = formatted.repartition(conv_column).sortWithinPartitions(conv_column, "task", "part")
    return parts.select(conv_column, "formatted", "loss_starts", "loss_ends").mapInArrow(lean(f), f"`{conv_column}` {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
