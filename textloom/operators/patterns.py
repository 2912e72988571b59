"""Texts and lines that hold any of many literal patterns, as a semi-join or with the patterns they hold.

An index has each pattern under one of its runs of eight bytes, the one that is rarest in a sample of the texts (which
changes how long a search takes, not what it finds); shorter patterns are under all their bytes. A task slides an
eight-byte window over its texts, asks a bitmap and then the sorted runs, and compares the few patterns that are under
a run it finds, byte by byte. So each text is read once for an index, however many patterns it has, texts don't shuffle,
and no pattern meets texts by a word that all of them have.

An index has a bounded number of patterns and bytes; of more patterns than that there are several, each broadcast and
asked in a scan of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from textloom.operators.lines import number_lines
from textloom.sources.staging import stage

#: Patterns of an index, and their bytes: what is sent to each task and held by the driver.
INDEX_PATTERNS, INDEX_BYTES = 1 << 18, 1 << 25
#: Texts, and bytes of each, whose runs are counted to tell rare ones; bits of a bitmap at most; windows looked at together.
SAMPLE_TEXTS, SAMPLE_BYTES, BITMAP_BITS, STEP = 1000, 1 << 14, 24, 1 << 20
RUN = 8
#: Found lines that are sent at a time.
ROWS = 1 << 16


def _windows(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number; data has RUN bytes of padding."""
    return np.ndarray((max(len(data) - RUN, 0),), "<u8", data, strides=(1,))


def _slots(codes: np.ndarray, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


@dataclass
class Runs:
    """Patterns of at least `size` bytes under a run of theirs: its first `size` bytes count."""

    size: int
    codes: np.ndarray  # sorted, each once
    first: np.ndarray  # where the entries of each code begin, and an end
    pattern: np.ndarray  # of each entry the number of the pattern and the place of the run in it
    place: np.ndarray

    def __post_init__(self):
        self.bits = min(len(self.codes).bit_length() + 10, BITMAP_BITS)  # a small bitmap stays in the processor's cache
        self.bitmap = np.zeros(1 << self.bits, bool)
        self.bitmap[_slots(self.codes, self.bits)] = True
        self.mask = np.uint64((1 << 8 * self.size) - 1)

    def __getstate__(self):
        return self.size, self.codes, self.first, self.pattern, self.place

    def __setstate__(self, state):
        self.size, self.codes, self.first, self.pattern, self.place = state
        self.__post_init__()


class Index:
    """Distinct patterns without an empty one, as bytes; with fold A-Z match a-z and the other way round."""

    def __init__(self, patterns: list[bytes], fold: bool = False, sample: bytes = b""):
        self.patterns, self.fold = [p.lower() for p in patterns] if fold else patterns, fold
        seen, counts = np.unique(_windows(_padded(sample.lower() if fold else sample)), return_counts=True)
        entries: dict[int, list[tuple[int, int, int]]] = {}
        for i, p in enumerate(self.patterns):
            if len(p) < RUN:
                entries.setdefault(len(p), []).append((int.from_bytes(p, "little"), i, 0))
                continue
            codes = _windows(np.frombuffer(p + b"\0", np.uint8))
            at = np.minimum(np.searchsorted(seen, codes), max(len(seen) - 1, 0))
            often = np.where(seen[at] == codes, counts[at], 0) if len(seen) else np.zeros(len(codes))
            k = int(np.argmin(often))
            entries.setdefault(RUN, []).append((int(codes[k]), i, k))
        self.runs = []
        for size, rows in entries.items():
            rows.sort()
            codes, first = np.unique(np.array([r[0] for r in rows], np.uint64), return_index=True)
            self.runs.append(Runs(size, codes, np.append(first, len(rows)), np.array([r[1] for r in rows]), np.array([r[2] for r in rows])))

    def found(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
        """(text, pattern), repeated ones too, of texts that lie one after another between offsets in padded bytes."""
        if self.fold:
            data = data + ((data >= 65) & (data <= 90)) * np.uint8(32)
        raw = data.tobytes()
        every = _windows(data)
        for start in range(0, len(every), STEP):
            part = every[start : start + STEP]
            for runs in self.runs:
                codes = part & runs.mask
                near = np.flatnonzero(runs.bitmap[_slots(codes, runs.bits)])
                at = np.minimum(np.searchsorted(runs.codes, codes[near]), len(runs.codes) - 1)
                sure = runs.codes[at] == codes[near]
                places, at = near[sure] + start, at[sure]
                texts = np.searchsorted(offsets, places, "right") - 1
                for place, k, text in zip(places.tolist(), at.tolist(), texts.tolist(), strict=True):
                    for e in range(runs.first[k], runs.first[k + 1]):
                        i = int(runs.pattern[e])
                        begin = place - int(runs.place[e])
                        end = begin + len(self.patterns[i])
                        if begin >= offsets[text] and end <= offsets[text + 1] and raw[begin:end] == self.patterns[i]:
                            yield text, i


def _padded(data: bytes) -> np.ndarray:
    return np.frombuffer(data + b"\0" * RUN, np.uint8)


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The padded bytes of the texts and their offsets; a null is empty."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2].slice(offsets[0], offsets[-1] - offsets[0]).to_pybytes() if texts.buffers()[2] else b""
    return _padded(data), offsets - offsets[0]


def indexes(patterns: DataFrame, texts: DataFrame, ignore_case: bool = False) -> Iterator[Index]:
    """Indexes of the distinct patterns in a one-column table, by texts like those of another; nulls and empty ones are left out."""
    rows = stage(patterns.toDF("p").filter("p <> ''").distinct().select("p", F.octet_length("p").alias("n")), "patterns")
    most = rows.agg(F.count("*").alias("n"), F.sum("n").alias("b"), F.max("n").alias("longest")).first()
    if most.longest is not None and most.longest > INDEX_BYTES // 2:
        raise ValueError(f"a pattern has more than {INDEX_BYTES // 2} bytes")
    blocks = max(-(-2 * most.n // INDEX_PATTERNS), -(-2 * (most.b or 0) // INDEX_BYTES), 1) if most.n > INDEX_PATTERNS or (most.b or 0) > INDEX_BYTES else min(most.n, 1)
    sample = b"\n".join(bytes(r[0]) for r in texts.toDF("t").filter("t is not null").select(F.substring(F.encode("t", "UTF-8"), 1, SAMPLE_BYTES)).limit(SAMPLE_TEXTS).collect()) if blocks else b""
    for k in range(blocks):
        block = rows.filter(F.pmod(F.xxhash64("p"), F.lit(blocks)) == k).select(F.col("p").cast("binary")).collect()
        yield Index([bytes(r[0]) for r in block], ignore_case, sample)


def holds(index: Index, text: Column, spark) -> Column:
    """Whether a text holds a pattern of the index, which is broadcast; false for null."""
    sent = spark.sparkContext.broadcast(index)

    @F.arrow_udf("boolean")
    def ask(texts: pa.Array) -> pa.Array:
        out = np.zeros(len(texts), bool)
        out[[t for t, _ in sent.value.found(*bytes_of(texts))]] = True
        return pa.array(out)

    return ask(text)


def texts_with_pattern(docs: DataFrame, patterns: DataFrame, text_column: str = "text", ignore_case: bool = False, without: bool = False) -> DataFrame:
    """The rows whose text holds a pattern of the one-column table, or holds none. An empty pattern is in every text but null.

    ignore_case is that of A-Z. Null patterns are none; a null text holds none. Without patterns no text has one.
    """
    text = F.col(f"`{text_column}`")
    if not patterns.toDF("p").filter("p = ''").isEmpty():
        return docs.filter(text.isNull() if without else text.isNotNull())
    asked = [holds(index, text, docs.sparkSession) for index in indexes(patterns, docs.select(text), ignore_case)]
    if without:
        return docs.filter(~reduce(Column.__or__, asked)) if asked else docs
    out = docs.filter(asked[0]) if asked else docs.filter(F.lit(False))
    for k in range(1, len(asked)):
        out = out.unionAll(docs.filter(asked[k] & ~reduce(Column.__or__, asked[:k])))
    return out


def lines_with_pattern(docs: DataFrame, patterns: DataFrame, text_column: str = "text", ignore_case: bool = False, invert: bool = False) -> DataFrame:
    """A row for each line that holds a pattern, or holds none: as search_lines() of as many fixed patterns.

    Whole texts are searched, and only the lines that are found become rows.
    """
    lines = number_lines(docs, text_column)
    if not patterns.toDF("p").filter("p = ''").isEmpty():
        return lines.filter(F.lit(not invert))
    text = F.col(f"`{text_column}`")
    single = patterns.toDF("p").filter(~F.contains("p", F.lit("\n")))
    sent = [docs.sparkSession.sparkContext.broadcast(index) for index in indexes(single, docs.select(text), ignore_case)]
    if not sent:
        return lines.filter(F.lit(invert))
    names = lines.columns

    def found(asked: list[Broadcast]) -> DataFrame:
        """The lines that the last of the indexes finds and no other does; with invert those that none finds."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, texts = bytes_of(batch.column(batch.num_columns - 1))
                starts = line_starts(data, texts)
                if not len(starts):
                    continue
                ends, hits = np.append(starts[1:], texts[-1]), np.zeros((2, len(starts)), bool)
                for k, index in enumerate(asked):
                    hits[int(k + 1 == len(asked) and not invert), [line for line, _ in index.value.found(data, np.append(starts, texts[-1]))]] = True
                every = np.flatnonzero(~hits[0] if invert else hits[1] & ~hits[0])
                ends = ends - (data[ends - 1] == 10)
                for a in range(0, len(every), ROWS):
                    some = every[a : a + ROWS]
                    rows = np.searchsorted(texts, starts[some], "right") - 1
                    number = some - np.searchsorted(starts, texts[rows]) + 1
                    line = pa.array([data[b:e].tobytes() for b, e in zip(starts[some].tolist(), ends[some].tolist(), strict=True)], pa.binary())
                    kept = batch.select(list(range(batch.num_columns - 1))).take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(number), pa.array(starts[some] - texts[rows]), line.view(pa.string())], names=names)

        keep = [F.col(f"`{c}`") for c in docs.columns if c != text_column]
        return docs.select(*keep, text).mapInArrow(run, lines.schema)

    if invert:
        return found(sent)
    return reduce(DataFrame.unionAll, [found(sent[: k + 1]) for k in range(len(sent))])


def line_starts(data: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Where the lines begin of texts that lie one after another between offsets in padded bytes; none begins at a text's end."""
    after = np.flatnonzero(data[: texts[-1]] == 10) + 1
    return np.unique(np.concatenate((texts[:-1][np.diff(texts) > 0], after[after < texts[-1]])))


def pattern_hits(docs: DataFrame, patterns: DataFrame, text_column: str = "text", ignore_case: bool = False) -> DataFrame:
    """The table's columns but the text, and pattern: a row for each text and each pattern it holds, once. Empty patterns have no row.

    With ignore_case patterns are given with A-Z in lower case.
    """
    keep = [c for c in docs.columns if c != text_column]
    name = "pattern"
    while name.lower() in {c.lower() for c in keep}:
        name += "_"
    out = docs.select(*(F.col(f"`{c}`") for c in keep), F.lit("").alias(name)).filter(F.lit(False))
    for index in indexes(patterns, docs.select(F.col(f"`{text_column}`")), ignore_case):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = sorted(set(sent.value.found(*bytes_of(batch.column(batch.num_columns - 1)))))
                rows = batch.select(list(range(batch.num_columns - 1))).take(pa.array([t for t, _ in found], pa.int64()))
                names = pa.array([sent.value.patterns[i].decode() for _, i in found], pa.string())
                yield pa.RecordBatch.from_arrays([*rows.columns, names], names=[*keep, name])

        rows = docs.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text_column}`"))
        out = out.unionAll(rows.mapInArrow(run, StructType([*rows.schema.fields[:-1], StructField(name, StringType())])))
    return out
