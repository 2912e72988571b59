"""Files of any size, read by tasks in byte ranges that end where lines do.

A range has the lines that begin in it: its task passes over the rest of a line that began before, and reads on to the
end of its own last line. So a task holds a range and a line, whatever the size of the file, and the pieces of a file
are what operators/splits.py searches. Nothing is read to list the ranges, as sizes are known from the listing.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from textloom.functions.matching import Match
from textloom.operators.splits import search_pieces
from textloom.sources.files import CHUNK
from textloom.sources.staging import stage

#: Bytes of a range, and bytes read at a time to find the end of a line.
RANGE_BYTES, STEP = 1 << 24, 1 << 16
#: The most bytes of a range and its last line: a value of a row must be smaller than 2 GB.
MOST_BYTES = (1 << 31) - (1 << 20)
_BOM = b"\xef\xbb\xbf"
_KEYS = ("root_idx", "root", "path", "explicit")


class LineTooLong(ValueError):
    """A line that no value of a row can hold."""


def byte_ranges(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """A row for each range of the files (rows of list_files): root_idx, root, path, explicit, piece, start, stop.

    Ranges are dealt out to tasks by file and number, so one large file is read by all tasks. Empty files have none.
    """
    if not 1 <= range_bytes <= MOST_BYTES // 2:
        raise ValueError(f"ranges have 1 to {MOST_BYTES // 2} bytes")
    rows = files.filter("kind = 'file' and size > 0").select(*_KEYS, "size", F.explode(F.expr(f"sequence(0L, (size - 1) div {range_bytes}L)")).alias("piece"))
    rows = rows.select(*_KEYS, "piece", (F.col("piece") * range_bytes).alias("start"), F.least((F.col("piece") + 1) * range_bytes, F.col("size")).alias("stop"))
    return rows.repartition(*_KEYS, "piece")


def _line_end(f, at: int) -> int:
    """The place behind the first line feed at or after `at`; the end of the file if there is none."""
    f.seek(at)
    while step := f.read(STEP):
        if (k := step.find(b"\n")) >= 0:
            return at + k + 1
        at += len(step)
    return at


def lines_of(path: str, start: int, stop: int) -> tuple[bytes, int]:
    """The lines that begin in a range of a file, and where the first does; a mark of byte order at its start isn't counted."""
    with open(path, "rb") as f:
        bom = len(_BOM) if f.read(len(_BOM)) == _BOM else 0
        first = _line_end(f, start - 1) if start else 0
        if first >= stop:
            return b"", first - bom
        last = _line_end(f, stop - 1)
        if last - first > MOST_BYTES:
            raise LineTooLong(f"{path}: a line from a range at byte {start} on has more than {MOST_BYTES - (stop - start)} bytes")
        f.seek(max(first, bom))
        return f.read(last - max(first, bom)), max(first - bom, 0)


def _each(ranges: DataFrame, column: str, kind: str, of) -> DataFrame:
    """The ranges with a column that `of` makes of (path, start, stop, the row as a dict), a row at a time; files that can't be read are left out."""
    names = ranges.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {n: batch.column(n)[k].as_py() for n in ("root", "path", "explicit", "start", "stop", *extra)}
                try:
                    value = of(row["root"] if row["explicit"] else os.path.join(row["root"], row["path"]), row["start"], row["stop"], row)
                except OSError:
                    continue
                yield pa.RecordBatch.from_arrays([*batch.slice(k, 1).columns, pa.array([value], types[kind])], names=[*names, column])

    extra, types = [n for n in ("limit",) if n in names], {"binary": pa.binary(), "long": pa.int64()}
    return ranges.mapInArrow(run, StructType([*ranges.schema.fields, *StructType.fromDDL(f"{column} {kind}").fields]))


def first_nuls(ranges: DataFrame) -> DataFrame:
    """(root_idx, path, binary_offset) of the files that have a NUL: where the first is."""

    def nul(path: str, start: int, stop: int, _: dict) -> int | None:
        with open(path, "rb") as f:
            bom = len(_BOM) if f.read(len(_BOM)) == _BOM else 0
            f.seek(start)
            while start < stop and (step := f.read(min(STEP, stop - start))):
                if (k := step.find(b"\0")) >= 0:
                    return start + k - bom
                start += len(step)
        return None

    found = _each(ranges, "nul", "long", nul).filter("nul is not null")
    return found.groupBy("root_idx", "path").agg(F.min("nul").alias("binary_offset"))


def with_limits(ranges: DataFrame, mode: str = "auto") -> DataFrame:
    """The ranges with binary_offset, convert and limit, by what the mode (as of files.decoded) makes of a file's first NUL.

    Bytes from limit on aren't read: the piece of CHUNK bytes with the first NUL goes, and all after it.
    """
    if mode not in ("auto", "none", "convert", "quit"):
        raise ValueError(f"unknown mode {mode!r}")
    convert = F.col("explicit") if mode == "auto" else F.lit(mode == "convert")
    if mode == "none":
        return ranges.select("*", F.lit(None).cast("long").alias("binary_offset"), convert.alias("convert"), F.lit(None).cast("long").alias("limit"))
    nuls = stage(first_nuls(ranges), "nuls")
    limit = F.when(~convert, F.expr(f"binary_offset div {CHUNK}") * CHUNK)
    return ranges.join(nuls, ["root_idx", "path"], "left").select(*(ranges[c] for c in ranges.columns), "binary_offset", convert.alias("convert"), limit.alias("limit"))


def read_ranges(ranges: DataFrame, text: str = "text") -> DataFrame:
    """The ranges, as with_limits makes them, with the text of their lines; one row at a time is in a task's memory.

    A file is cut off at the last whole line before its limit. Where its NULs are converted, each ends a line.
    """

    def read(path: str, start: int, stop: int, row: dict) -> bytes:
        data, first = lines_of(path, start, stop)
        if row["limit"] is not None and first + len(data) > row["limit"]:
            data = data[: data.rfind(b"\n", 0, max(row["limit"] - first, 0)) + 1]
        return data

    rows = _each(ranges, text, "binary", read)
    raw = F.col(text).cast("string")
    return rows.withColumn(text, F.when(F.col("convert") & F.col("binary_offset").isNotNull(), F.replace(raw, F.lit("\0"), F.lit("\n"))).otherwise(raw))


def search_files(files: DataFrame, match: Match, mode: str = "auto", before: int = 0, after: int = 0, max_count: int | None = None, passthru: bool = False, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(root_idx, path, line_no, byte_offset, line, kind, after, group_id): what a search of files (rows of list_files)
    emits, each read in ranges. Lines that end in NULs can't be cut at, so null_data is refused."""
    if match.null_data:
        raise ValueError("ranges end where lines do, which NULs don't tell")
    ranges = stage(with_limits(byte_ranges(files, range_bytes), mode), "ranges")
    return search_pieces(ranges, match, ["root_idx", "path"], "piece", "text", before, after, max_count, passthru, read_ranges)
