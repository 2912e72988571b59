"""Search in pieces of long texts: line numbers, offsets, context and limits are those of the whole texts.

Pieces are cut at line starts, so each line is whole in one piece. A piece is searched by itself; what it can't know is
added up from the pieces before it: lines, bytes, matches and emitted lines are counted by piece, and exclusive prefix
sums of the counts, worked out in two levels so that no task gets all pieces of a long text, are joined back. Lines near
a cut that are context of matches beyond it are found by a few flags a piece: which of the neighbours' lines match.

Texts don't shuffle where pieces are read by tasks (sources/ranges.py): counts meet the ranges before they are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from textloom.functions.matching import Match
from textloom.operators.lines import byte_offset, emitted, line_array, trimmed_end
from textloom.operators.patterns import ROWS, bytes_of, line_starts
from textloom.sources.staging import stage

#: Pieces of a text whose counts one task adds up.
BLOCK = 1024
_PIECE, _TEXT = "tl_piece", "tl_text"


def cut_lines(docs: DataFrame, text_column: str = "text", chunk: int = 1 << 24) -> DataFrame:
    """The rows with the text cut at line starts into pieces of about `chunk` characters, numbered from 0 as `piece`.

    A line longer than that is whole in one piece. Texts without a character, and nulls, have no piece.
    """
    if chunk < 1:
        raise ValueError("chunk is at least 1")
    keep = [c for c in docs.columns if c != text_column]
    kept = docs.select(*(F.col(f"`{c}`") for c in keep))
    schema = StructType([*kept.schema.fields, StructField("piece", IntegerType()), StructField(text_column, StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, texts = bytes_of(batch.column(batch.num_columns - 1))
            starts = line_starts(data, texts)
            if not len(starts):
                continue
            rows = np.searchsorted(texts, starts, "right") - 1
            # a line is in the piece of the character that it begins with; bytes 10xxxxxx begin none
            sizes = np.add.reduceat((data[: texts[-1]] & 0xC0) != 0x80, starts, dtype=np.int64)
            chars = np.cumsum(sizes) - sizes
            pieces = (chars - chars[np.searchsorted(starts, texts[rows])]) // chunk
            first = np.flatnonzero(np.concatenate(([True], (rows[1:] != rows[:-1]) | (pieces[1:] != pieces[:-1]))))
            for a in range(0, len(first), ROWS):
                some = first[a : a + ROWS]
                begin = np.append(starts[some], starts[first[a + ROWS]] if a + ROWS < len(first) else texts[-1])
                # pieces lie one after another as the texts do
                part = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(some), [None, pa.py_buffer((begin - begin[0]).tobytes()), pa.py_buffer(data[begin[0] : begin[-1]].tobytes())])
                whole = batch.select(list(range(batch.num_columns - 1))).take(pa.array(rows[some]))
                yield pa.RecordBatch.from_arrays([*whole.columns, pa.array(pieces[some].astype(np.int32)), part.cast(pa.binary()).view(pa.string())], names=schema.names)

    return docs.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text_column}`")).mapInArrow(run, schema)


def prefix_sums(rows: DataFrame, keys: list[str], order: str, values: list[str]) -> DataFrame:
    """(keys, order, before_<value> ...): of each row the sums of the values of its key's rows before it.

    `order` is a number of 0 and up, each once a key. Blocks of BLOCK numbers are added up first, then within each, so a
    key's rows never all meet in one task.
    """
    marked = rows.select(*keys, order, *values, F.expr(f"`{order}` div {BLOCK}").alias("tl_block"))
    sums = marked.groupBy(*keys, "tl_block").agg(*(F.sum(v).alias(v) for v in values))
    over = Window.partitionBy(*keys).orderBy("tl_block").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(*keys, "tl_block", *(F.coalesce(F.sum(v).over(over), F.lit(0)).alias(f"tl_base_{v}") for v in values))
    inner = Window.partitionBy(*keys, "tl_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    within = marked.select(*keys, order, "tl_block", *(F.coalesce(F.sum(v).over(inner), F.lit(0)).alias(f"tl_in_{v}") for v in values))
    on = [within[k].eqNullSafe(bases[k]) for k in keys] + [within["tl_block"] == bases["tl_block"]]
    joined = within.join(bases, on)
    return joined.select(*(within[k] for k in keys), within[order], *((F.col(f"tl_base_{v}") + F.col(f"tl_in_{v}")).cast("long").alias(f"before_{v}") for v in values))


def _rejoined(rows: DataFrame, other: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """The rows with the other's columns, by keys that may be null, and piece."""
    renamed = other.select(*(F.col(k).alias(f"tl_k{i}") for i, k in enumerate(keys)), *(c for c in other.columns if c not in keys))
    on = [rows[k].eqNullSafe(renamed[f"tl_k{i}"]) for i, k in enumerate(keys)]
    return rows.join(renamed, on, how).drop(*(f"tl_k{i}" for i in range(len(keys))))


def _flags(lines: Column, match: Match) -> Column:
    """Of each line, whether it matches."""
    return F.transform(lines, lambda x: F.coalesce(match(trimmed_end(x, match.crlf)), F.lit(False)))


def _counted(pieces: DataFrame, keys: list[str], match: Match, before: int, after: int) -> DataFrame:
    """A staged row for each piece that has lines: its counts, and which lines at its ends match, which is of use to its neighbours."""
    # empty texts, which have no lines, go first: a filter by the lines would work them out twice
    rows = pieces.filter(F.col(_TEXT) != "").select(*keys, _flags(line_array(F.col(_TEXT), match.null_data), match).alias("flags"), F.octet_length(_TEXT).cast("long").alias("bytes"))
    hits = F.size(F.filter("flags", lambda x: x)).cast("long")
    ends = (F.slice("flags", 1, before) if before else _none()), (F.slice("flags", F.greatest(F.size("flags") - after + 1, F.lit(1)), after) if after else _none())
    rows = rows.select(*keys, F.size("flags").cast("long").alias("lines_"), "bytes", hits.alias("hits"), F.lit(1).cast("long").alias("one"), ends[0].alias("head"), ends[1].alias("tail"))
    return stage(rows, "pieces")


def _none() -> Column:
    return F.array().cast("array<boolean>")


def _neighbours(counted: DataFrame, keys: list[str], before: int, after: int) -> DataFrame:
    """Of each piece, whether the up to `after` lines before it and the up to `before` lines behind it match.

    A piece has a line at least, so they are in that many neighbours, and each piece sends its ends to those only.
    """
    text = keys[:-1]
    here = counted.select(*keys, F.col("before_one").alias("n"))
    far = [F.struct((F.col("before_one") + d).alias("to"), F.lit(-d).alias("d"), F.col("tail").alias("part")) for d in range(1, after + 1)]
    far += [F.struct((F.col("before_one") - d).alias("to"), F.lit(d).alias("d"), F.col("head").alias("part")) for d in range(1, before + 1)]
    sent = counted.select(*text, F.explode(F.array(*far)).alias("x")).select(*text, "x.*")
    got = sent.groupBy(*text, F.col("to").alias("n")).agg(F.sort_array(F.collect_list(F.struct("d", "part"))).alias("parts"))
    lines = lambda keep: F.flatten(F.transform(F.filter("parts", keep), lambda p: p["part"]))
    lead, trail = lines(lambda p: p["d"] < 0), lines(lambda p: p["d"] > 0)
    got = got.select(*text, "n", (F.slice(lead, F.greatest(F.size(lead) - after + 1, F.lit(1)), after) if after else lead).alias("lead"), (F.slice(trail, 1, before) if before else trail).alias("trail"))
    return _rejoined(here, got, [*text, "n"], "left").drop("n")


def search_pieces(pieces: DataFrame, match: Match, keys: list[str], piece: str = "piece", text_column: str = "text", before: int = 0, after: int = 0, max_count: int | None = None, passthru: bool = False, read: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """search_events() of texts that come in pieces: keys, line_no, byte_offset, line, kind, after, group_id.

    Each text is what its pieces, in order of `piece` (a number, each once), are one after another; keys tell texts apart
    and may be null. A piece ends where a line does. With `read`, pieces are rows without text that it turns into rows
    with it; it is asked once, or twice if context, a limit or passthru is asked for. Empty and null pieces add nothing.
    """
    load = read or (lambda p: p)
    names = [*keys, piece]

    def texts(p: DataFrame, *more: str) -> DataFrame:
        return load(p).select(*names, F.coalesce(F.col(f"`{text_column}`"), F.lit("")).alias(_TEXT), *more)

    if max_count == 0:
        pieces = pieces.filter(F.lit(False))
    if before or after or passthru or max_count is not None:
        counted = _counted(texts(pieces), names, match, before, after)
        known = stage(_rejoined(counted, prefix_sums(counted, keys, piece, ["lines_", "bytes", "hits", "one"]), names), "sums")
        info = known.select(*names, "before_lines_", "before_bytes", "before_hits", "hits")
        if before or after:
            info = _rejoined(info, _neighbours(known, names, before, after), names).withColumns({c: F.coalesce(c, _none()) for c in ("lead", "trail")})
        else:
            info = info.withColumns({c: _none() for c in ("lead", "trail")})
        rows = texts(_rejoined(pieces, stage(info, "info"), names), "before_lines_", "before_bytes", "before_hits", "lead", "trail")
    else:
        rows = texts(pieces).withColumns({c: _none() for c in ("lead", "trail")})

    lead = F.size("lead")
    rows = rows.select(*rows.columns, line_array(F.col(_TEXT), match.null_data).alias("own"))
    rows = rows.select(*rows.columns, F.concat("lead", _flags(F.col("own"), match), "trail").alias("flags"))
    rows = rows.select(*rows.columns, F.filter(F.transform("flags", lambda x, i: F.when(x, i + 1)), lambda x: x.isNotNull()).alias("all"))
    hits = F.col("all")
    if max_count is not None:  # matches among the lines before the piece are the last of those counted before it
        left = F.greatest(max_count - F.col("before_hits") + F.size(F.filter("all", lambda n: n <= lead)), F.lit(0))
        hits = F.slice(F.col("all"), F.lit(1), left.cast("int"))
    rows = rows.select(*rows.columns, hits.alias("hits_"))
    if passthru:
        every = F.transform("flags", lambda _, i: F.struct((i + 1).cast("long").alias("line_no"), F.when(F.array_contains("hits_", i + 1), "match").otherwise("context").alias("kind"), F.lit(False).alias("after")))
    else:
        every = emitted(F.col("flags"), F.col("hits_"), before, after)
    mine = F.filter(every, lambda e: (e["line_no"] > lead) & (e["line_no"] <= lead + F.size("own")))
    at = lambda e: e["line_no"] - lead
    out = F.transform(mine, lambda e: F.struct(at(e).alias("n"), byte_offset(F.col(_TEXT), at(e), match.null_data).alias("offset"), F.get("own", (at(e) - 1).cast("int")).alias("line"), e["kind"].alias("kind"), e["after"].alias("after")))
    found = stage(rows.select(*names, F.size("own").cast("long").alias("lines_"), F.octet_length(_TEXT).cast("long").alias("bytes"), out.alias("events")).withColumn("emitted", F.size("events").cast("long")), "events")

    sums = prefix_sums(found.select(*names, "lines_", "bytes", "emitted"), keys, piece, ["lines_", "bytes", "emitted"])
    placed = _rejoined(found.filter("emitted > 0").select(*names, "events"), sums, names).select(*keys, "before_lines_", "before_bytes", "before_emitted", F.posexplode("events").alias("i", "e"))
    number = F.col("before_lines_") + F.col("e.n")
    return placed.select(
        *keys, number.alias("line_no"), (F.col("before_bytes") + F.col("e.offset")).alias("byte_offset"), F.col("e.line").alias("line"), F.col("e.kind").alias("kind"), F.col("e.after").alias("after"),
        (number - F.col("before_emitted") - F.col("i") - 1).alias("group_id"),
    )


def count_pieces(pieces: DataFrame, match: Match, keys: list[str], text_column: str = "text", include_zero: bool = False, occurrences: bool = False) -> DataFrame:
    """(keys, matches): count_lines() of texts that come in pieces; counts are added up before they shuffle."""
    from textloom.operators.lines import count_lines

    counts = count_lines(pieces.select(*keys, F.col(f"`{text_column}`").alias("text")), match, "text", include_zero, occurrences)
    return counts.groupBy(*keys).agg(F.sum("matches").alias("matches"))
