"""What a search prints, as rows: plain lines, JSON messages, and a folder of text files."""

from __future__ import annotations

import os
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from textloom.functions.matching import Match, spans
from textloom.functions.rawbytes import raw_length, restored
from textloom.operators.lines import byte_offset, candidates, exploded, let, trimmed_end, with_events

#: Bytes of a text of which a NUL makes all of it binary.
CHUNK = 1 << 16


def trimmed(line: Column) -> Column:
    """Without ASCII white space at the start."""
    return F.regexp_replace(line, r"^[ \t\n\x0B\f\r]+", "")


def limited(text: Column, most: int | None, matches: Column | None = None, only_matching: bool = False, context: Column | None = None, preview: bool = False, later: Column | None = None) -> Column:
    """The text, or a note in its place if it is long: a line of `most` bytes or more with its end, a match of more than that.

    matches is how many the line has, where they were looked for; context whether it is a context line. With preview the
    first `most` characters, as readers see them, stay, and the note says how many matches come `later(bytes shown)`.
    """
    if most is None:
        return text
    long = F.octet_length(text) + (0 if only_matching else 1) > most
    known = matches is not None and not only_matching
    if preview:
        shown = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"(\X)"), F.lit(1)), 1, most), "")
        more = later(F.octet_length(shown)) if later is not None else None
        rest = F.lit(" [... omitted end of long line]")
        if more is not None:
            rest = F.when(matches == 0, rest).otherwise(F.concat(F.lit(" [... "), more.cast("string"), F.when(more == 1, " more match]").otherwise(" more matches]")))
        return F.when(long, F.concat(shown, rest)).otherwise(text)
    plain = F.lit("[Omitted long matching line]") if context is None else F.when(context, "[Omitted long context line]").otherwise("[Omitted long matching line]")
    note = F.when(matches == 0, plain).otherwise(F.concat(F.lit("[Omitted long line with "), matches.cast("string"), F.lit(" matches]"))) if known else plain
    return F.when(long, note).otherwise(text)


def standard(events: DataFrame, path: Column, line_number: bool = True, column: Column | None = None, offset: Column | None = None, with_path: bool = True, match_separator: str = ":", context_separator: str = "-", null: bool = False, text: Column | None = None) -> DataFrame:
    """The events with `row`: path, line number, column and offset, each with a separator after it, and the text."""
    kind = F.col("kind") if "kind" in events.columns else F.lit("match")
    sep = F.when(kind == "match", match_separator).otherwise(context_separator)
    parts = []
    if with_path:
        parts += [path.cast("string"), F.lit("\0") if null else sep]
    if line_number:
        parts += [F.col("line_no").cast("string"), sep]
    if column is not None:
        parts.append(F.when(kind == "match", F.coalesce(F.concat(column.cast("string"), sep), F.lit(""))).otherwise(""))
    if offset is not None:
        parts += [offset.cast("string"), sep]
    return events.withColumn("row", F.concat(*parts, F.col("line") if text is None else text))


@dataclass(frozen=True)
class Printing:
    """How matches are printed. gap is the row between lines that don't follow each other; None leaves it out."""

    with_path: bool = True
    heading: bool = False
    line_number: bool = True
    column: bool = False
    offset: bool = False
    only_matching: bool = False
    vimgrep: bool = False
    trim: bool = False
    max_columns: int | None = None
    preview: bool = False
    color: bool = False
    null: bool = False
    match_separator: str = ":"
    context_separator: str = "-"
    gap: str | None = "--"
    before: int = 0
    after: int = 0
    max_count: int | None = None
    passthru: bool = False


#: What is put around paths, numbers and matches in colour.
RESET, PATH, NUMBER, MATCH = "\x1b[0m", "\x1b[35m", "\x1b[32m", "\x1b[1m\x1b[31m"


def _painted(text: Column, color: str, on: bool) -> Column:
    return F.concat(F.lit(RESET + color), text, F.lit(RESET)) if on else text


def _painted_matches(line: Column, found: Column) -> Column:
    """The line with its matches in colour."""
    raw = line.cast("binary")
    part = lambda lo, hi: F.substring(raw, lo + 1, hi - lo).cast("string")
    step = lambda acc, m: F.struct(m["e"].alias("at"), F.concat(acc["out"], part(acc["at"], m["s"]), F.when(m["e"] > m["s"], _painted(m["text"], MATCH, True)).otherwise("")).alias("out"))
    return F.aggregate(found, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], part(acc["at"], F.octet_length(line))))


def printed(docs: DataFrame, match: Match, path_column: str = "path", text_column: str = "text", how: Printing = Printing(), binary_offset: str | None = None, convert: Column | None = None, observe: dict[str, Observation] | None = None) -> DataFrame:
    """(path, seq, kind, row): the rows that a search prints of each text, in order of seq, built in the text's own row.

    kind is match, context, gap, heading, notice or between: the row that parts this text's rows from those of a text
    before it, left out before the first. Vimgrep and only_matching give a row for each match, only_matching the whole
    of an inverted line. binary_offset is a column with the place of a text's first NUL; where `convert` is true such a
    text gives a notice that it matches instead of its lines from the NUL on, or instead of all if it is within the
    first CHUNK bytes; elsewhere its lines are followed by a warning. Null and empty texts print nothing. `observe` has
    observations that the rows' own job fills: "searched" (texts, bytes), "found" (texts, lines, matches) and "printed"
    (bytes, parting_bytes, parting_rows).
    """
    offset = F.col(f"`{binary_offset}`").cast("long") if binary_offset else F.lit(None).cast("long")
    docs = docs.select(F.col(f"`{path_column}`").cast("string").alias("path"), offset.alias("nul"), (F.lit(False) if convert is None else convert).alias("convert"), F.col(f"`{text_column}`").alias("text"))
    size = F.coalesce(F.octet_length("text").cast("long"), F.lit(0))
    searched = F.when(F.col("convert"), size).otherwise(F.least(size, F.coalesce("nul", size)))
    if observe:
        docs = docs.observe(observe["searched"], F.count("*").alias("texts"), F.coalesce(F.sum(searched), F.lit(0)).alias("bytes"))
    rows = with_events(candidates(docs, match, "text", how.passthru), match, how.before, how.after, how.max_count, how.passthru).toDF("path", "nul", "convert", "text", "lines", "events")
    each_match = how.only_matching or how.vimgrep
    look = each_match or how.column or how.color or (how.max_columns is not None and how.preview) or observe is not None

    def line_of(lines: Column, e: Column) -> Column:
        line = F.get(lines, e["line_no"].cast("int") - 1)
        body = trimmed_end(line, match.crlf)
        hit = e["kind"] == "match"
        found = F.when(hit, spans(match, body)).otherwise(spans(Match(()), body)) if look and not match.invert else F.array().cast("array<struct<s:int,e:int,text:string>>")
        return F.struct(e["line_no"].alias("line_no"), hit.alias("hit"), restored(line).alias("line"), byte_offset(F.col("text"), e["line_no"], match.null_data).alias("at"), found.alias("found"))

    def row_of(x: Column, m: Column | None) -> Column:
        """The row of a line, or of one of its matches."""
        sep = F.when(x["hit"], how.match_separator).otherwise(how.context_separator)
        own = F.lit(0) if m is None else m["s"]
        parts = []
        if how.with_path and not how.heading:
            parts += [_painted(F.col("path"), PATH, how.color), F.lit("\0") if how.null else sep]
        if how.line_number:
            parts += [_painted(x["line_no"].cast("string"), NUMBER, how.color), sep]
        first = F.get(x["found"], 0)["s"] if m is None else m["s"]
        if how.column or how.vimgrep:
            parts.append(F.coalesce(F.concat((first + 1).cast("string"), sep), F.lit("")))
        if how.offset:
            parts += [(x["at"] + own).cast("string"), sep]
        whole = how.only_matching and m is not None
        text = m["text"] if whole else x["line"]
        cut = F.octet_length(text) - F.octet_length(trimmed(text)) if how.trim else F.lit(0)
        text = trimmed(text) if how.trim else text
        marks = F.array(F.struct(F.lit(0).alias("s"), F.octet_length(text).alias("e"), text.alias("text"))) if whole else F.transform(F.filter(x["found"], lambda f: f["s"] >= cut), lambda f: F.struct((f["s"] - cut).alias("s"), (f["e"] - cut).alias("e"), f["text"].alias("text")))
        shown = _painted_matches(text, marks) if how.color else text
        if how.max_columns is not None:
            later = (lambda n: F.size(F.filter(x["found"], lambda f: f["s"] - cut >= n))) if look else None
            noted = limited(text, how.max_columns, F.size(x["found"]) if look else None, whole, ~x["hit"], how.preview, later)
            shown = F.when(noted == text, shown).otherwise(noted)
        parts.append(shown)
        return F.struct(F.when(x["hit"], "match").otherwise("context").alias("kind"), F.concat(*parts).alias("row"))

    one = lambda kind, text: F.array(F.struct(F.lit(kind).alias("kind"), text.alias("row")))
    none = F.array().cast("array<struct<kind:string,row:string>>")

    def block(found: Column, i: Column, x: Column) -> Column:
        body = F.array(row_of(x, None))
        if each_match and not match.invert:
            body = F.when(x["hit"], F.transform(x["found"], lambda m: row_of(x, m))).otherwise(body)
        if (how.before or how.after) and how.gap is not None:
            apart = (i > 0) & (x["line_no"] != F.get(found, i - 1)["line_no"] + 1)
            body = F.concat(F.when(apart, one("gap", F.lit(how.gap))).otherwise(none), body)
        return body

    rows = rows.select("path", "nul", "convert", "text", let(F.struct("lines", "events"), lambda b: F.transform(b["events"], lambda e: line_of(b["lines"], e))).alias("found"))
    early = F.col("convert") & (F.col("nul") < CHUNK)
    held = F.filter("found", lambda x: F.coalesce(~F.col("convert") | (~early & (x["at"] + F.octet_length(x["line"]) + 1 <= F.col("nul"))), F.lit(True)))
    matched = F.exists("found", lambda x: x["hit"])
    rows = rows.select("path", "nul", "convert", matched.alias("matched"), held.alias("found"))
    if observe:
        hits = F.filter("found", lambda x: x["hit"])
        total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
        rows = rows.observe(observe["found"], F.count_if("matched").alias("texts"), total(F.size(hits)).alias("lines"), total(F.aggregate(hits, F.lit(0), lambda n, x: n + F.size(x["found"]))).alias("matches"))
    prefix = F.concat("path", F.lit(": ")) if how.with_path else F.lit("")
    what = F.when(F.col("convert"), "binary file matches").otherwise("WARNING: stopped searching binary file after match")
    notice = F.concat(prefix, what, F.lit(' (found "\\0" byte around offset '), F.col("nul").cast("string"), F.lit(")"))
    between = one("between", F.lit("") if how.heading else F.lit(how.gap)) if how.heading or ((how.before or how.after) and how.gap is not None) else none
    heading = F.when(F.size("found") > 0, one("heading", F.concat(_painted(F.col("path"), PATH, how.color), F.lit("\0" if how.null else "")))).otherwise(none) if how.heading and how.with_path else none
    every = F.concat(between, heading, let(F.col("found"), lambda found: F.flatten(F.transform(found, lambda x, i: block(found, i, x)))), F.when(F.col("nul").isNotNull() & F.col("matched"), one("notice", notice)).otherwise(none))
    rows = rows.select("path", let(every, lambda r: F.when(F.exists(r, lambda x: x["kind"] != "between"), r)).alias("rows"))
    rows = exploded(rows, ["path"], "rows", "seq", "r").select("path", F.col("seq").cast("long").alias("seq"), "r.kind", "r.row")
    if observe:
        long, parts = raw_length(F.col("row")).cast("long") + 1, F.col("kind") == "between"
        rows = rows.observe(observe["printed"], F.coalesce(F.sum(F.when(~parts, long)), F.lit(0)).alias("bytes"), F.coalesce(F.sum(F.when(parts, long)), F.lit(0)).alias("parting_bytes"), F.count_if(parts).alias("parting_rows"))
    return rows


def shows_path(paths: list[str], with_filename: bool | None = None, vimgrep: bool = False) -> bool:
    """Whether rows show their path: not of a search of one path that is no directory, unless asked for."""
    if with_filename is not None:
        return with_filename
    return vimgrep or len(paths) != 1 or not os.path.exists(paths[0]) or os.path.isdir(paths[0])


def json_text(text: Column) -> Column:
    """The text as a JSON string: control characters in short form or with lower-case hexadecimals, all else as it is."""
    out = text
    for c, short in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r")):
        out = F.replace(out, F.lit(c), F.lit(short))
    rare = out
    for code in (*range(9), 11, 12, *range(14, 32)):
        rare = F.replace(rare, F.lit(chr(code)), F.lit({8: "\\b", 12: "\\f"}.get(code, f"\\u{code:04x}")))
    return F.concat(F.lit('"'), F.when(text.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F]"), rare).otherwise(out), F.lit('"'))


def _data(text: Column) -> Column:
    """A JSON object of a text, or of its bytes in base64 if it isn't UTF-8."""
    return F.when(F.is_valid_utf8(text), F.concat(F.lit('{"text":'), json_text(text), F.lit("}"))).otherwise(F.concat(F.lit('{"bytes":"'), F.replace(F.base64(text.cast("binary")), F.lit("\r\n"), F.lit("")), F.lit('"}')))


_ELAPSED = '{"secs":0,"nanos":0,"human":"0.000000s"}'


def json_events(docs: DataFrame, match: Match, path_column: str = "path", text_column: str = "text", before: int = 0, after: int = 0, max_count: int | None = None, passthru: bool = False, binary_offset: str | None = None) -> DataFrame:
    """(path, line_no, json): begin, match, context and end messages of each text with any, built in the text's own row.

    begin and end have line numbers before and after all. binary_offset is a column with the place of a text's first
    NUL: bytes searched end there. Times are 0, as a text has no time of its own. Inverted matches have no submatches,
    their context has. Null and empty texts have no messages; texts of one path have messages each for itself.
    """
    offset = F.col(f"`{binary_offset}`").cast("long") if binary_offset else F.lit(None).cast("long")
    docs = docs.select(F.col(f"`{path_column}`").cast("string").alias("path"), offset.alias("nul"), F.col(f"`{text_column}`").alias("text"))
    rows = with_events(candidates(docs, match, "text", passthru), match, before, after, max_count, passthru).toDF("path", "nul", "text", "lines", "events")
    end = "\0" if match.null_data else "\n"
    lookup = replace(match, invert=False)

    def message(lines: Column, e: Column) -> Column:
        line = F.get(lines, e["line_no"].cast("int") - 1)
        at = byte_offset(F.col("text"), e["line_no"], match.null_data)
        full = F.concat(restored(line), F.when(at + raw_length(line) < raw_length(F.col("text")), end).otherwise(""))
        hit = e["kind"] == "match"
        none = F.array().cast("array<struct<s:int,e:int,text:string>>")
        found = F.when(hit != F.lit(match.invert), spans(lookup, trimmed_end(line, match.crlf))).otherwise(none)
        return F.struct(e["line_no"].alias("line_no"), hit.alias("hit"), e["kind"].alias("kind"), full.alias("full"), at.alias("at"), found.alias("found"))

    def text_of(x: Column) -> Column:
        subs = F.array_join(F.transform(x["found"], lambda m: F.concat(F.lit('{"match":'), _data(m["text"]), F.lit(',"start":'), m["s"].cast("string"), F.lit(',"end":'), m["e"].cast("string"), F.lit("}"))), ",")
        parts = ['{"type":"', x["kind"], '","data":{"path":', F.col("shown"), ',"lines":', _data(x["full"]), ',"line_number":', x["line_no"].cast("string"), ',"absolute_offset":', x["at"].cast("string"), ',"submatches":[', subs, "]}}"]
        return F.struct(x["line_no"].alias("line_no"), F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts)).alias("json"))

    total = lambda array, each: F.aggregate(array, F.lit(0).cast("long"), lambda n, x: n + each(x))
    rows = rows.select("path", "nul", raw_length(F.col("text")).cast("long").alias("size"), _data(F.col("path")).alias("shown"), let(F.struct("lines", "events"), lambda b: F.transform(b["events"], lambda e: message(b["lines"], e))).alias("found"))
    rows = rows.select("path", "nul", "size", "shown", total("found", lambda x: x["hit"].cast("long")).alias("lines"), total("found", lambda x: F.when(x["hit"], F.size(x["found"])).otherwise(0)).alias("matches"), F.transform("found", text_of).alias("json"))
    begin = F.concat(F.lit('{"type":"begin","data":{"path":'), F.col("shown"), F.lit("}}"))
    bytes_printed = F.octet_length(begin) + 1 + total("json", lambda x: F.octet_length(x["json"]) + 1)
    searched = F.least("size", F.coalesce("nul", "size"))
    number = lambda c: c.cast("string")
    last = [
        F.lit('{"type":"end","data":{"path":'), F.col("shown"), F.lit(',"binary_offset":'), F.coalesce(number(F.col("nul")), F.lit("null")), F.lit(f',"stats":{{"elapsed":{_ELAPSED},"searches":1,"searches_with_match":'), F.when(F.col("lines") > 0, "1").otherwise("0"),
        F.lit(',"bytes_searched":'), number(searched), F.lit(',"bytes_printed":'), number(bytes_printed), F.lit(',"matched_lines":'), number(F.col("lines")), F.lit(',"matches":'), number(F.col("matches")), F.lit("}}}"),
    ]
    row = lambda n, json: F.array(F.struct(F.lit(n).cast("long").alias("line_no"), json.alias("json")))
    every = F.concat(row(0, begin), F.col("json"), row(1 << 62, F.concat(*last)))
    return exploded(rows, ["path"], F.when(F.size("json") > 0, every), "at", "m").select("path", "m.line_no", "m.json")


def json_summary(docs: DataFrame, match: Match, messages: DataFrame, text_column: str = "text", binary_offset: str | None = None) -> DataFrame:
    """One row, (json): the summary of a run, from what was searched and the messages of json_events. Times are 0."""
    text, nul = F.col(f"`{text_column}`"), F.col(f"`{binary_offset}`") if binary_offset else F.lit(None)
    size = F.coalesce(F.octet_length(text).cast("long"), F.lit(0))
    searched = docs.agg(F.count("*").alias("searches"), F.sum(F.least(size, F.coalesce(nul.cast("long"), size))).alias("bytes_searched"))
    parsed = F.from_json("json", "data struct<stats: struct<searches_with_match: bigint, bytes_printed: bigint, matched_lines: bigint, matches: bigint>>")
    ends = messages.filter(F.col("json").startswith('{"type":"end"')).select(parsed.alias("j")).select("j.data.stats.*")
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    found = ends.agg(*(zero(c).alias(c) for c in ("searches_with_match", "bytes_printed", "matched_lines", "matches")))
    elapsed = '{"human":"0.000000s","nanos":0,"secs":0}'
    names = ("matched_lines", "matches", "searches", "searches_with_match")
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    parts = [F.lit(f'{{"data":{{"elapsed_total":{elapsed},"stats":{{"bytes_printed":'), number("bytes_printed"), F.lit(',"bytes_searched":'), number("bytes_searched"), F.lit(f',"elapsed":{elapsed}')]
    parts += [x for c in names for x in (F.lit(f',"{c}":'), number(c))]
    return searched.withColumn("one", F.lit(1)).join(found.withColumn("one", F.lit(1)), "one").select(F.concat(*parts, F.lit('}},"type":"summary"}')).alias("json"))


def write_rows(rows: DataFrame, path: str, column: str = "row") -> None:
    """The rows' texts as lines of text files."""
    rows.select(F.col(column).alias("value")).write.text(path)
