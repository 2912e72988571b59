"""Bloom filters over 64-bit hashes, built by Spark in segments and broadcast as one bitmap of bounded size.

A filter has two bits' worth of knowledge a position: hit, and hit more than once. Tasks send the positions
that their rows hit, segment by segment; what a task sends of one hot value is one position, however many
rows have it.

Where hashes are too many for one such bitmap, `repeated` deals them out by parts of the hash space, each small enough
for a filter of its own within a task, and collects only those that were hit twice: the broadcast filter is then
over these, so its bits a hash stay the same. Should they too be too many, it says "maybe" more often, and what follows
is as right as before, with more rows to look at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm._arrays import lean, mix
from textloom.llm._staging import stage

#: Positions in a segment, and the most bits of a filter: 2**28 bits are 32 MiB, whatever the input's size.
SEGMENT_BITS = 1 << 20
MAX_BITS = 1 << 28
_PROBES = 2
#: Hashes of a part that has a filter of its own.
RANGE_ROWS = 1 << 20
_FLUSH = 2_000_000


def filter_bits(rows: int, most: int = MAX_BITS) -> int:
    """A power of two of at least 16 bits a row, within the bound."""
    bits = SEGMENT_BITS
    while bits < min(16 * rows, most):
        bits *= 2
    return bits


def positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The bit positions of each hash, a row for each probe."""
    h = hashes.astype(np.uint64, copy=False)
    return np.stack([mix(h + np.uint64(k * 0x5851F42D4C957F2D)) & np.uint64(bits - 1) for k in range(_PROBES)]).astype(np.int64)


def build(hashes: DataFrame, bits: int, least: int, hashed: Callable[[pa.RecordBatch], np.ndarray] | None = None) -> np.ndarray:
    """Bitmap of the positions hit at least once (least=1) or twice (least=2) by the one long column of `hashes`.

    With `hashed`, which gives a batch's hashes, the table may have any columns; thus no second Python process works beside.

    The distinct probes of one hash count once each, so a value that occurs once marks no position as hit twice
    by itself. Nulls are skipped. The result has bits / 8 bytes.
    """

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def rows(found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            at, n = np.unique(np.concatenate(found), return_counts=True)
            cut = np.searchsorted(at, np.arange(0, bits + 1, SEGMENT_BITS))
            own = [k for k in range(len(cut) - 1) if cut[k] < cut[k + 1]]
            for k in own:
                part, twice = at[cut[k] : cut[k + 1]] % SEGMENT_BITS, n[cut[k] : cut[k + 1]] > 1
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part[~twice].astype("<u4").tobytes()], pa.binary()), pa.array([part[twice].astype("<u4").tobytes()], pa.binary())], ["segment", "once", "twice"])

        for b in batches:
            h = b.column(0).drop_null().to_numpy(zero_copy_only=False) if hashed is None else hashed(b)
            p = positions(h, bits)
            p[1, p[1] == p[0]] = -1
            held.append(p[p >= 0])
            if sum(map(len, held)) > _FLUSH:
                yield from rows(held)
                held = []
        if held:
            yield from rows(held)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, np.ndarray] = {}
        for b in batches:
            for k, once, twice in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                c = seen.setdefault(k, np.zeros(SEGMENT_BITS, np.uint8))
                one, two = np.frombuffer(once, "<u4"), np.frombuffer(twice, "<u4")
                c[one] = np.minimum(c[one] + 1, 2)
                c[two] = 2
        for k, c in seen.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.packbits(c >= least, bitorder="little").tobytes()], pa.binary())], ["segment", "bitmap"])

    parts = hashes.mapInArrow(lean(sent), "segment int, once binary, twice binary").repartition(min(bits // SEGMENT_BITS, 64), "segment")
    out = np.zeros(bits // 8, np.uint8)
    step = SEGMENT_BITS // 8
    for r in parts.mapInArrow(lean(merged), "segment int, bitmap binary").toLocalIterator():
        out[r.segment * step : (r.segment + 1) * step] = np.frombuffer(r.bitmap, np.uint8)
    return out


def repeated(hashes: DataFrame, rows: int) -> np.ndarray:
    """A bitmap, to be asked by maybe(), in which all values are found that occur twice in the one long column of `hashes`.

    `rows` says how many there are; with 16 bits for each the bitmap is that of their positions hit twice, beyond the
    bound that of the values possibly hit twice.
    """
    if 16 * rows <= MAX_BITS:
        return build(hashes, filter_bits(rows), 2)

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a task sends a value twice at most a batch, however many rows have it
        for b in batches:
            h, n = np.unique(b.column(0).drop_null().to_numpy(zero_copy_only=False), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((h, h[n > 1])))], ["h"])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(2 * RANGE_ROWS, np.uint8), np.zeros(2 * RANGE_ROWS, np.uint8)
        held = []
        for b in batches:
            h = b.column(0).to_numpy()
            p = positions(h, 8 * len(once))[0]
            own, n = np.unique(p, return_counts=True)
            seen = (once[own >> 3] >> (own & 7).astype(np.uint8)) & 1
            both = own[(n > 1) | (seen == 1)]
            np.bitwise_or.at(once, own >> 3, np.uint8(1) << (own & 7).astype(np.uint8))
            np.bitwise_or.at(twice, both >> 3, np.uint8(1) << (both & 7).astype(np.uint8))
            held.append(np.unique(h))
        for h in held:
            p = positions(h, 8 * len(once))[0]
            yield pa.RecordBatch.from_arrays([pa.array(h[((twice[p >> 3] >> (p & 7).astype(np.uint8)) & 1) == 1])], ["h"])

    ranges = -(-rows // RANGE_ROWS)
    dealt = hashes.mapInArrow(lean(sent), "h bigint").repartition(ranges, "h")
    twice = stage(dealt.mapInArrow(lean(found), "h bigint").distinct(), "twice")
    return build(twice, filter_bits(twice.count()), 1)


def maybe(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the filter may hold each hash."""
    p = positions(hashes, len(bitmap) * 8)
    return ((bitmap[p >> 3] >> (p & 7).astype(np.uint8)) & 1).all(axis=0)


def flagged(df: DataFrame, hash_column: str, name: str, bitmap: Broadcast) -> DataFrame:
    """The table with a boolean column that says whether the filter may hold the row's hash (null: false)."""
    from pyspark.sql import types as T

    @F.pandas_udf(T.BooleanType())
    def probe(h):
        import pandas as pd

        known = h.notna().to_numpy()
        out = np.zeros(len(h), bool)
        out[known] = maybe(bitmap.value, h[known].astype("int64").to_numpy())
        return pd.Series(out)

    return df.withColumn(name, probe(F.col(hash_column)))
