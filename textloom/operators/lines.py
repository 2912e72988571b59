"""Lines of texts, and the lines that a search emits, without a shuffle: everything about a text happens in its row.

Results have the table's columns but the text, and columns of their own. Names of these that the table has already get
underscores appended. Bytes that aren't UTF-8 are characters of their own to a search (functions/rawbytes.py), and lines
come back with the bytes they had.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.matching import Match, count_of, first_column, spans
from textloom.functions.rawbytes import armoured, raw_length, restored


def line_array(text: Column, null_data: bool = False) -> Column:
    """The text's lines without their ends; no line after a final end, none for null or empty."""
    end = "\0" if null_data else "\n"
    parts = F.split(F.coalesce(text, F.lit("")), end)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def byte_offset(text: Column, line_no: Column, null_data: bool = False) -> Column:
    """The offset in bytes of a line: computed where it is asked for, so only for the lines that are left."""
    end = "\0" if null_data else "\n"
    count = (line_no - 1).cast("int")
    return F.when(count == 0, F.lit(0).cast("long")).otherwise(raw_length(F.call_function("substring_index", text, F.lit(end), count)).cast("long") + 1)


def trimmed_end(line: Column, crlf: bool) -> Column:
    """What of a line is matched: without one carriage return if lines may end in it."""
    return F.regexp_replace(line, r"\r\z", "") if crlf else line


def let(value: Column, body) -> Column:
    """body(value) with the value computed once a row, also where the body asks for it once for each element of an array."""
    return F.transform(F.array(value), body)[0]


def exploded(rows: DataFrame, kept: list[str], array: Column | str, at: str, name: str) -> DataFrame:
    """A row for each element. The outer form and the filter after it keep the optimizer from filtering rows by the array's size before it, which would compute the array twice."""
    return rows.select(*kept, F.posexplode_outer(array).alias(at, name)).filter(F.col(name).isNotNull())


def started(docs: DataFrame, text_column: str) -> DataFrame:
    """The text as tl_text, and the other columns under names that nothing here has."""
    keep = [c for c in docs.columns if c != text_column]
    return docs.select(*(F.col(f"`{c}`").alias(f"tl_{i}") for i, c in enumerate(keep)), armoured(F.col(f"`{text_column}`")).alias("tl_text"))


def own(rows: DataFrame) -> list[str]:
    return [c for c in rows.columns if c.startswith("tl_") and c[3:].isdigit()]


def finished(docs: DataFrame, text_column: str, rows: DataFrame, *columns: Column) -> DataFrame:
    """The other columns by their names again, and the given columns under names that the table doesn't have."""
    keep = [c for c in docs.columns if c != text_column]
    out = rows.select(*own(rows), *columns)
    taken, names = {c.lower() for c in keep}, []
    for name in out.columns[len(keep) :]:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        names.append(name)
    return out.toDF(*keep, *names)


def candidates(docs: DataFrame, match: Match, text_column: str, every: bool = False) -> DataFrame:
    """The started rows, without texts that surely have no matching line unless every one is asked for."""
    if every or match.document(F.lit("")) is None:
        return started(docs, text_column)
    if match.literals() is not None:  # bytes are compared, at the scan
        return started(docs.filter(match.document(F.col(f"`{text_column}`"))), text_column)
    return started(docs, text_column).filter(match.document(F.col("tl_text")))


def number_lines(docs: DataFrame, text_column: str = "text", null_data: bool = False, offsets: bool = True) -> DataFrame:
    """A row for each line: the table's columns but the text, line_no, byte_offset and line."""
    rows = started(docs, text_column)
    rows = exploded(rows, [*own(rows), "tl_text"], line_array(F.col("tl_text"), null_data), "at", "line")
    number = (F.col("at") + 1).cast("long")
    return finished(docs, text_column, rows, number.alias("line_no"), *[byte_offset(F.col("tl_text"), number, null_data).alias("byte_offset")] * offsets, restored(F.col("line")).alias("line"))


def _found(docs: DataFrame, match: Match, text_column: str) -> DataFrame:
    """Matching lines: tl_text, line_no, line and what of it is matched."""
    rows = candidates(docs, match, text_column)
    rows = exploded(rows, [*own(rows), "tl_text"], line_array(F.col("tl_text"), match.null_data), "at", "line")
    rows = rows.filter(match(trimmed_end(F.col("line"), match.crlf)))
    return rows.select(*own(rows), "tl_text", (F.col("at") + 1).cast("long").alias("line_no"), "line")


def search_lines(docs: DataFrame, match: Match, text_column: str = "text", offsets: bool = True, column: bool = False) -> DataFrame:
    """A row for each matching line: the table's columns but the text, line_no, byte_offset, line, and column if asked for."""
    rows = _found(docs, match, text_column)
    at = byte_offset(F.col("tl_text"), F.col("line_no"), match.null_data).alias("byte_offset")
    first = first_column(match, trimmed_end(F.col("line"), match.crlf)).alias("column")
    return finished(docs, text_column, rows, F.col("line_no"), *[at] * offsets, restored(F.col("line")).alias("line"), *[first] * column)


def _matched(lines: Column, match: Match, most: int | None) -> Column:
    """Numbers of the matching lines, of the first `most` of them only."""
    hit = F.filter(F.transform(lines, lambda x, i: F.when(match(trimmed_end(x, match.crlf)), i + 1)), lambda x: x.isNotNull())
    return hit if most is None else F.slice(hit, 1, most)


def emitted(lines: Column, hits: Column, before: int, after: int) -> Column:
    """array<struct<line_no, kind, after>>: matches and the context lines around them, each line once.

    After-context comes first: a line within `after` of the match before it is that match's; other lines are
    before-context of the next.
    """
    row = lambda n, kind, late: F.struct(n.cast("long").alias("line_no"), F.lit(kind).alias("kind"), F.lit(late).alias("after"))
    none = F.array().cast("array<struct<line_no:bigint,kind:string,after:boolean>>")
    run = lambda lo, hi, kind, late: F.when(hi >= lo, F.transform(F.sequence(lo, F.greatest(lo, hi)), lambda n: row(n, kind, late))).otherwise(none)

    def around(hit: Column, k: Column) -> Column:
        last = F.when(k > 0, F.get(hits, k - 1) + after).otherwise(0)
        next_ = F.coalesce(F.get(hits, k + 1), F.size(lines) + 1)
        lead = run(F.greatest(hit - before, last + 1), hit - 1, "context", False) if before else none
        tail = run(hit + 1, F.least(hit + after, next_ - 1), "context", True) if after else none
        return F.concat(lead, F.array(row(hit, "match", False)), tail)

    return F.flatten(F.transform(hits, around))


def search_events(docs: DataFrame, match: Match, text_column: str = "text", before: int = 0, after: int = 0, max_count: int | None = None, passthru: bool = False) -> DataFrame:
    """A row for each emitted line: the table's columns but the text, line_no, byte_offset, line, kind, after, group_id.

    With max_count only the first that many matching lines are matches. passthru emits every line, others than
    matches as context; with max_count 0 it emits nothing. group_id tells the runs of neighbouring lines of a text
    apart: it is the number of lines left out before the run.
    """
    rows = with_events(candidates(docs, match, text_column, passthru), match, before, after, max_count, passthru)
    rows = exploded(rows, [*own(rows), "tl_text", "tl_lines"], "tl_events", "tl_at", "e")
    number = F.col("e.line_no")
    return finished(docs, text_column, rows, number.alias("line_no"), byte_offset(F.col("tl_text"), number, match.null_data).alias("byte_offset"), restored(F.get("tl_lines", number.cast("int") - 1)).alias("line"), F.col("e.kind").alias("kind"), F.col("e.after").alias("after"), (number - F.col("tl_at") - 1).alias("group_id"))


def with_events(rows: DataFrame, match: Match, before: int, after: int, max_count: int | None, passthru: bool) -> DataFrame:
    """The started rows with tl_lines and tl_events, the lines that are emitted: without passthru none of texts without a match."""
    if max_count == 0:
        rows = rows.filter(F.lit(False))
    kept = own(rows)
    rows = rows.select(*kept, "tl_text", line_array(F.col("tl_text"), match.null_data).alias("tl_lines"))
    rows = rows.select("*", _matched(F.col("tl_lines"), match, max_count).alias("tl_hits"))
    if passthru:
        every = F.transform("tl_lines", lambda _, i: F.struct((i + 1).cast("long").alias("line_no"), F.when(F.array_contains("tl_hits", i + 1), "match").otherwise("context").alias("kind"), F.lit(False).alias("after")))
    else:
        every = emitted(F.col("tl_lines"), F.col("tl_hits"), before, after)
    return rows.select(*kept, "tl_text", "tl_lines", every.alias("tl_events"))


def search_spans(docs: DataFrame, match: Match, text_column: str = "text", max_count: int | None = None) -> DataFrame:
    """A row for each match in a line: the table's columns but the text, line_no, occ, s, e, text, column, byte_offset, line_offset, line.

    An inverted line is one whole match, without a column.
    """
    if max_count is None:
        rows = _found(docs, match, text_column)
    else:
        rows = with_events(candidates(docs, match, text_column), match, 0, 0, max_count, False)
        rows = exploded(rows, [*own(rows), "tl_text", "tl_lines"], "tl_events.line_no", "at", "line_no").withColumn("line", F.get("tl_lines", F.col("line_no").cast("int") - 1))
    body = trimmed_end(F.col("line"), match.crlf)
    found = spans(match, body) if not match.invert else F.array(F.struct(F.lit(0).alias("s"), raw_length(body).alias("e"), restored(body).alias("text")))
    rows = rows.select(*own(rows), "line_no", byte_offset(F.col("tl_text"), F.col("line_no"), match.null_data).alias("line_offset"), "line", found.alias("found"))
    rows = exploded(rows, [*own(rows), "line_no", "line_offset", "line"], "found", "at", "m")
    column = F.lit(None).cast("int") if match.invert else F.col("m.s") + 1
    return finished(docs, text_column, rows, F.col("line_no"), (F.col("at") + 1).alias("occ"), F.col("m.s").alias("s"), F.col("m.e").alias("e"), F.col("m.text").alias("text"), column.alias("column"), (F.col("line_offset") + F.col("m.s")).alias("byte_offset"), F.col("line_offset"), restored(F.col("line")).alias("line"))


def nested_context(docs: DataFrame, match: Match, text_column: str = "text", before: int = 0, after: int = 0, max_count: int | None = None) -> DataFrame:
    """A row for each matching line with its context: line_no, byte_offset, line, column, before_lines and after_lines.

    The lines between two matches are shared out: first after-context of the earlier, then before-context of the later.
    """
    rows = candidates(docs, match, text_column)
    keep = own(rows)
    rows = rows.select(*keep, "tl_text", line_array(F.col("tl_text"), match.null_data).alias("tl_lines"))
    rows = rows.select("*", _matched(F.col("tl_lines"), match, max_count).alias("tl_hits"))
    strip = lambda x: restored(F.regexp_replace(x, r"\r\z", ""))

    def around(hit: Column, k: Column) -> Column:
        last = F.when(k > 0, F.get("tl_hits", k - 1) + after).otherwise(0)
        next_ = F.coalesce(F.get("tl_hits", k + 1), F.size("tl_lines") + 1)
        low = F.greatest(hit - before, last + 1)
        late = F.slice("tl_lines", hit + 1, F.greatest(F.least(F.lit(after), next_ - 1 - hit), F.lit(0)))
        return F.struct(hit.cast("long").alias("line_no"), F.transform(F.slice("tl_lines", F.greatest(low, F.lit(1)), F.greatest(hit - low, F.lit(0))), strip).alias("before_lines"), F.transform(late, strip).alias("after_lines"))

    rows = exploded(rows, [*keep, "tl_text", "tl_lines"], F.transform("tl_hits", around), "at", "x")
    line = F.get("tl_lines", F.col("x.line_no").cast("int") - 1)
    column = F.coalesce(first_column(match, trimmed_end(line, match.crlf)), F.lit(0))
    return finished(docs, text_column, rows, F.col("x.line_no").alias("line_no"), byte_offset(F.col("tl_text"), F.col("x.line_no"), match.null_data).alias("byte_offset"), strip(line).alias("line"), column.alias("column"), F.col("x.before_lines").alias("before_lines"), F.col("x.after_lines").alias("after_lines"))


def _counts(match: Match, text: Column, most: int | None = None) -> tuple[Column, Column]:
    """Matching lines of a text, of the first `most` of them, and matches in them; inverted lines have none."""
    if most is None and (pattern := match.in_text()) is not None:
        # matches don't cross lines, so the whole text is asked at once; for lines a match takes the rest of its line along
        every = F.coalesce(text, F.lit(""))
        return F.regexp_count(every, F.lit(rf"(?:{pattern})[^\n]*")).cast("long"), F.regexp_count(every, F.lit(pattern)).cast("long")
    hits = F.filter(F.transform(line_array(text, match.null_data), lambda x: trimmed_end(x, match.crlf)), lambda x: match(x))
    hits = hits if most is None else F.slice(hits, 1, most)
    return F.size(hits).cast("long"), F.aggregate(hits, F.lit(0).cast("long"), lambda n, x: n + count_of(match, x))


def count_lines(docs: DataFrame, match: Match, text_column: str = "text", include_zero: bool = False, occurrences: bool = False, max_count: int | None = None) -> DataFrame:
    """The table's columns but the text, and matches: matching lines of each text, or matches in them; zeros are left out.

    An inverted line counts as one match.
    """
    rows = candidates(docs, match, text_column, include_zero)
    lines, matches = _counts(match, F.col("tl_text"), max_count)
    each = (matches if occurrences and not match.invert else lines).alias("matches")
    rows = rows.select(*own(rows), each)
    return finished(docs, text_column, rows if include_zero else rows.filter("matches > 0"), F.col("matches"))


def texts_with_match(docs: DataFrame, match: Match, text_column: str = "text", without: bool = False) -> DataFrame:
    """The rows, but for the text, that have a matching line, or have none."""
    rows = candidates(docs, match, text_column, without)
    if (pattern := match.in_text()) is not None:
        some = F.coalesce(F.col("tl_text").rlike(pattern), F.lit(False))
    else:
        some = F.exists(line_array(F.col("tl_text"), match.null_data), lambda x: match(trimmed_end(x, match.crlf)))
    return finished(docs, text_column, rows.filter(~some if without else some))


def run_stats(docs: DataFrame, match: Match, text_column: str = "text") -> DataFrame:
    """One row: matches, matched_lines, texts_with_match, texts_searched, bytes_searched. Inverted lines add no matches."""
    lines, matches = _counts(match, armoured(F.col(f"`{text_column}`")))
    per = docs.select(lines.alias("n"), (F.lit(0).cast("long") if match.invert else matches).alias("m"), F.coalesce(F.octet_length(F.col(f"`{text_column}`")), F.lit(0)).cast("long").alias("b"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return per.agg(zero(F.sum("m")).alias("matches"), zero(F.sum("n")).alias("matched_lines"), zero(F.sum((F.col("n") > 0).cast("long"))).alias("texts_with_match"), F.count("*").alias("texts_searched"), zero(F.sum("b")).alias("bytes_searched"))
