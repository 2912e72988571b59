"""Search of texts as they arrive: the same line operators on a stream of whole texts, or of texts in pieces."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from textloom.functions.matching import Match
from textloom.operators.lines import count_lines, search_lines, trimmed_end


def follow_table(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int = 100) -> DataFrame:
    """A stream of the rows of Parquet files that are added to a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def search_stream(texts: DataFrame, match: Match, text_column: str = "text") -> DataFrame:
    """The stream of matching lines; it has no state, as a row holds a whole text."""
    return search_lines(texts, match, text_column)


def count_by_window(texts: DataFrame, match: Match, time_column: str, window: str = "5 minutes", delay: str = "10 minutes", text_column: str = "text") -> DataFrame:
    """Matching lines by window of time; rows later than the delay are left out."""
    counted = count_lines(texts.withWatermark(time_column, delay), match, text_column)
    return counted.groupBy(F.window(time_column, window).alias("window")).agg(F.sum("matches").alias("matches"))


@dataclass
class _Followed:
    """What is kept of a text between its pieces: pieces that came too early, a line without its end, where it begins,
    the lines before it that are wanted as context, and lines whose own context isn't known yet."""

    next: int = 0
    early: dict[int, tuple[str, bool]] = field(default_factory=dict)
    tail: str = ""
    line_no: int = 0
    offset: int = 0
    lead: list[str] = field(default_factory=list)
    waiting: list[tuple[int, int, str]] = field(default_factory=list)
    ended: bool = False

    def add(self, before: int, after: int) -> Iterator[tuple[int, int, str, list[str], list[str]]]:
        """(line_no, byte_offset, line, up to `after` lines before it, up to `before` lines behind it) of lines that are now known."""
        while self.next in self.early and not self.ended:
            text, self.ended = self.early.pop(self.next)
            self.next += 1
            lines = (self.tail + text).split("\n")
            self.tail = lines.pop()
            if self.ended and self.tail:
                lines.append(self.tail)
            for line in lines:
                self.line_no += 1
                self.waiting.append((self.line_no, self.offset, line))
                self.offset += len(line.encode()) + 1
            held = 0 if self.ended else before
            done = max(len(self.waiting) - held, 0)
            for k in range(done):
                number, offset, line = self.waiting[k]
                yield number, offset, line, list(self.lead), [x for _, _, x in self.waiting[k + 1 : k + 1 + before]]
                self.lead = [*self.lead, line][-after:] if after else []
            del self.waiting[:done]


def follow_pieces(pieces: DataFrame, match: Match, key: str, piece: str = "piece", text_column: str = "text", last: str = "last", before: int = 0, after: int = 0) -> DataFrame:
    """search_events() of texts that arrive in pieces: key, line_no, byte_offset, line, kind, after.

    A text is what its pieces, numbered from 0, are one after another; they may be cut anywhere, also inside a line, and
    come in any order. Its rows come as soon as they are known, the last when the piece does whose `last` is true; pieces
    behind that one, a piece that has come already, and one without a number add nothing. Kept of a text are its number and place, a line's
    beginning, some lines of context, and pieces that came early. Tables of pieces are search_pieces()'s.
    """
    names = "line_no long, byte_offset long, line string, lead array<string>, trail array<string>"
    own = pieces.select(F.col(f"`{key}`").alias("key"), F.col(f"`{piece}`").cast("long").alias("piece"), F.coalesce(F.col(f"`{text_column}`"), F.lit("")).alias("text"), F.coalesce(F.col(f"`{last}`"), F.lit(False)).alias("last")).filter("piece is not null")
    kind = own.schema["key"].dataType.simpleString()

    def known(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = pickle.loads(state.get[0]) if state.exists else _Followed()
        for b in batches:
            kept.early.update({n: (t, bool(z)) for n, t, z in zip(b["piece"], b["text"], b["last"], strict=True) if n >= kept.next and not kept.ended})
        rows = [(keys[0], *row) for row in kept.add(before, after)]
        if kept.ended:
            kept = _Followed(ended=True)  # of a text that is over nothing else is kept
        state.update((pickle.dumps(kept),))
        yield pd.DataFrame(rows, columns=["key", "line_no", "byte_offset", "line", "lead", "trail"])

    rows = own.groupBy("key").applyInPandasWithState(known, f"key {kind}, {names}", "kept binary", "append", GroupStateTimeout.NoTimeout)
    hit = lambda line: match(trimmed_end(line, match.crlf))
    late, soon = F.exists("lead", hit), F.exists("trail", hit)
    rows = rows.select("*", hit(F.col("line")).alias("hit"), late.alias("late"), soon.alias("soon")).filter("hit or late or soon")
    return rows.select(F.col("key").alias(key), "line_no", "byte_offset", "line", F.when(F.col("hit"), "match").otherwise("context").alias("kind"), (~F.col("hit") & F.col("late")).alias("after"))
