"""Array kernels for text inside a task: spans of words and 64-bit hashes of them, without a Python loop per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS = np.ones(1, np.uint64)
_INVERSES = np.ones(1, np.uint64)

#: Bytes of text that are worked on at once; a longer text is worked on alone.
BLOCK = 200_000


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWERS, _INVERSES
    if len(_POWERS) < n:
        size = max(n, BLOCK + 1)
        with np.errstate(over="ignore"):
            for name, base in (("_POWERS", _BASE), ("_INVERSES", _INVERSE)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                globals()[name] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS, _INVERSES


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of the public splitmix64 generator)."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def distinct(x: np.ndarray) -> np.ndarray:
    """The sorted distinct values."""
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def prefix_sums(units: np.ndarray) -> np.ndarray:
    """Sums of a polynomial over the first units, from none to all."""
    sums = np.zeros(len(units) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((units.astype(np.uint64) + np.uint64(1)) * _powers(len(units) + 1)[0][: len(units)], out=sums[1:])
    return sums


def span_sums(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The polynomial over units[start:end] of each span, shifted back to position 0; spans of one length differ as their units do."""
    with np.errstate(over="ignore"):
        return (sums[ends] - sums[starts]) * _powers(len(sums))[1][starts]


def hash_spans(units: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of units[start:end] for each span: prefix sums of a polynomial, shifted back to position 0."""
    with np.errstate(over="ignore"):
        return mix(span_sums(prefix_sums(units), starts, ends) + mix((ends - starts).astype(np.uint64)))


def blocks(texts: pa.Array, most: int = BLOCK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of rows of a string array with no nulls: (first row, their UTF-8 bytes, offsets of the rows in them)."""
    texts = texts.cast(pa.large_string())
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def ascii_lower(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z in lower case and all others as they are."""
    return data + ((data >= 65) & (data <= 90)) * np.uint8(32)


def space_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words between the bytes 0x20 and 0x09-0x0D: starts, ends and the row of each."""
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.zeros(len(data) + 1, bool)  # a row's first byte starts a word even where the row before ends in one
    edge[offsets] = True
    before = np.concatenate(([False], inside))[: len(data)]
    after = np.concatenate((inside[1:], [False])) if len(data) else inside
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of `width` words; with fewer words the whole run; without words nothing."""
    for _, data, offsets in blocks(texts):
        low = ascii_lower(data)
        starts, ends, rows = space_words(low, offsets)
        words = hash_spans(low, starts, ends)
        bounds = np.searchsorted(rows, np.arange(len(offsets)))
        with np.errstate(over="ignore"):
            rolled = np.zeros(max(0, len(words) - width + 1), np.uint64)
            for k in range(width):
                rolled = rolled * np.uint64(_BASE) + words[k : k + len(rolled)]
        rolled = mix(rolled)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= width:
                yield distinct(rolled[a : b - width + 1])
            elif b > a:
                with np.errstate(over="ignore"):
                    whole = np.full(1, b - a, np.uint64)
                    for w in words[a:b]:
                        whole = whole * np.uint64(_BASE) + w
                yield mix(mix(whole))
            else:
                yield np.zeros(0, np.uint64)


def lean(f):
    """The function of a task over batches, which gives memory back at its end, as Spark keeps Python workers for later tasks."""

    def run(batches):
        try:
            yield from f(batches)
        finally:
            import ctypes

            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
            if trim:
                trim(0)

    return run
