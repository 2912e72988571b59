"""Registered queries over the driver's tables, each with the DuckDB SQL that says what it returns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions.filetypes import Types
from textloom.functions.matching import Match
from textloom.operators import lines as L
from textloom.operators import paths as P
from textloom.operators import patterns as N
from textloom.operators import sinks as S
from textloom.operators import splits as X
from textloom.sources.staging import stage

_LINES = """lines AS (
    SELECT doc_id, line_no, line, CAST(coalesce(sum(strlen(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS byte_offset
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, CAST(generate_subscripts(string_split(text, chr(10)), 1) AS BIGINT) AS line_no, len(string_split(text, chr(10))) AS n FROM {table})
    WHERE NOT (line = '' AND line_no = n))"""


def _with(select: str, table: str = "documents") -> str:
    return f"WITH {_LINES.format(table=table)} {select}"


def _docs(spark: SparkSession, sf_dir: str, table: str = "documents", key: str = "doc_id", text: str = "text") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(F.col(key), F.col(text).alias("text"))


_Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _search(name: str, match: Match, condition: str) -> None:
    """A search of documents for lines that meet the condition."""
    _Q[name] = lambda spark, sf: L.search_lines(_docs(spark, sf), match)
    _SQL[name] = _with(f"SELECT doc_id, line_no, byte_offset, line FROM lines WHERE {condition}")


_search("search_literal", Match(("the",)), "contains(line, 'the')")
_search("search_regex", Match((r"[a-z]+tion\b.*\.$",)), r"regexp_matches(line, '[a-z]+tion\b.*\.$')")
_search("search_ignore_case_unicode", Match(("é",), case="ignore"), "regexp_matches(line, '(?i)é')")
_search("search_smart_case", Match(("que",), case="smart"), "regexp_matches(line, '(?i)que')")
_search("search_smart_case_upper", Match(("Que",), case="smart"), "contains(line, 'Que')")
_search("search_fixed_metachars", Match((".",), fixed=True), "contains(line, '.')")
_search("search_multi_pattern", Match(("ción", "heit", "tion$")), "regexp_matches(line, '(?:ción)|(?:heit)|(?:tion$)')")
_search("search_word", Match(("the",), word=True), r"regexp_matches(line, '(^|[^\pL\p{Nd}_])the([^\pL\p{Nd}_]|$)')")
_search("search_line_regexp", Match((r"[A-ZÑÉÜÖÄ].*\.",), line=True), r"regexp_full_match(line, '[A-ZÑÉÜÖÄ].*\.')")
_search("search_invert", Match(("e",), invert=True), "NOT contains(line, 'e')")
_search("search_unicode_class", Match((r"\p{Greek}|\p{Lu}{3,}",)), r"regexp_matches(line, '\p{Greek}|\p{Lu}{3,}')")
_search("search_empty_pattern", Match(("",)), "true")
_search("search_no_literal", Match((r"\w{5}\s+\w{5}\s+\w{5}",)), r"regexp_matches(line, '\w{5}\s+\w{5}\s+\w{5}')")

_THE = Match(("the",))
_EN = Match((r"\bth\w+",), case="ignore")
_RX = r"(?i)\bth\w+"

_Q["lines_numbered"] = lambda spark, sf: L.number_lines(_docs(spark, sf))
_SQL["lines_numbered"] = _with("SELECT doc_id, line_no, byte_offset, line FROM lines")

_Q["count_lines"] = lambda spark, sf: L.count_lines(_docs(spark, sf), _THE)
_SQL["count_lines"] = _with("SELECT doc_id, count(*) AS matches FROM lines WHERE contains(line, 'the') GROUP BY doc_id")
_Q["count_include_zero"] = lambda spark, sf: L.count_lines(_docs(spark, sf), _THE, include_zero=True)
_SQL["count_include_zero"] = _with("SELECT d.doc_id, count(l.line) AS matches FROM documents d LEFT JOIN lines l ON d.doc_id = l.doc_id AND contains(l.line, 'the') GROUP BY d.doc_id")
_Q["count_matches"] = lambda spark, sf: L.count_lines(_docs(spark, sf), _EN, occurrences=True)
_SQL["count_matches"] = _with(rf"SELECT doc_id, CAST(sum(len(regexp_extract_all(line, '{_RX}'))) AS BIGINT) AS matches FROM lines WHERE regexp_matches(line, '{_RX}') GROUP BY doc_id")
_Q["files_with_matches"] = lambda spark, sf: L.texts_with_match(_docs(spark, sf), _EN)
_SQL["files_with_matches"] = _with(f"SELECT DISTINCT doc_id FROM lines WHERE regexp_matches(line, '{_RX}')")
_Q["files_without_match"] = lambda spark, sf: L.texts_with_match(_docs(spark, sf), _EN, without=True)
_SQL["files_without_match"] = _with(f"SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM lines WHERE regexp_matches(line, '{_RX}'))")
_Q["quiet_any"] = lambda spark, sf: L.texts_with_match(_docs(spark, sf), _THE).limit(1).agg((F.count("*") > 0).alias("found"), F.when(F.count("*") > 0, 0).otherwise(1).alias("exit_code"))
_SQL["quiet_any"] = _with("SELECT count(*) > 0 AS found, CASE WHEN count(*) > 0 THEN 0 ELSE 1 END AS exit_code FROM lines WHERE contains(line, 'the')")
_Q["max_count_2"] = lambda spark, sf: L.search_events(_docs(spark, sf), _THE, max_count=2).select("doc_id", "line_no", "byte_offset", "line")
_SQL["max_count_2"] = _with("SELECT doc_id, line_no, byte_offset, line FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS k FROM lines WHERE contains(line, 'the')) WHERE k <= 2")
_Q["column_first"] = lambda spark, sf: L.search_lines(_docs(spark, sf), Match(("ción",)), column=True)
_SQL["column_first"] = _with("SELECT doc_id, line_no, byte_offset, line, CAST(strlen(left(line, strpos(line, 'ción') - 1)) + 1 AS INTEGER) AS \"column\" FROM lines WHERE contains(line, 'ción')")

_PIECES = rf"""pieces AS (
    SELECT l.doc_id, l.line_no, l.byte_offset AS line_offset, l.line, i AS occ, regexp_extract_all(l.line, '{_RX}') AS ms, string_split(regexp_replace(l.line, '{_RX}', chr(1), 'g'), chr(1)) AS gaps
    FROM lines l, unnest(generate_series(1, len(regexp_extract_all(l.line, '{_RX}')))) AS u(i) WHERE regexp_matches(l.line, '{_RX}')),
spans AS (SELECT doc_id, line_no, line_offset, line, CAST(occ AS INTEGER) AS occ, ms[occ] AS text,
    CAST(list_sum(list_transform(gaps[1:occ], lambda x: strlen(x))) + coalesce(list_sum(list_transform(ms[1:occ - 1], lambda x: strlen(x))), 0) AS INTEGER) AS s FROM pieces)"""
_Q["only_matching"] = lambda spark, sf: L.search_spans(_docs(spark, sf), _EN).select("doc_id", "line_no", "occ", "s", "e", "text", "column", "byte_offset")
_SQL["only_matching"] = _with("SELECT doc_id, line_no, occ, s, CAST(s + strlen(text) AS INTEGER) AS e, text, s + 1 AS \"column\", line_offset + s AS byte_offset FROM spans").replace(" SELECT doc_id, line_no, occ", f", {_PIECES} SELECT doc_id, line_no, occ", 1)
_Q["vimgrep"] = lambda spark, sf: L.search_spans(_docs(spark, sf), _EN).select("doc_id", F.concat_ws(":", F.col("doc_id"), F.col("line_no"), F.col("column"), F.col("line")).alias("row"))
_SQL["vimgrep"] = _with("SELECT doc_id, concat_ws(':', doc_id, line_no, s + 1, line) AS row FROM spans").replace(" SELECT doc_id, concat_ws", f", {_PIECES} SELECT doc_id, concat_ws", 1)

_NEAR = """m AS (SELECT *, contains(line, 'ther') AS hit FROM lines),
near AS (SELECT *, last_value(CASE WHEN hit THEN line_no END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev,
    first_value(CASE WHEN hit THEN line_no END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next FROM m),
ev AS (SELECT doc_id, line_no, byte_offset, line, CASE WHEN hit THEN 'match' ELSE 'context' END AS kind, NOT hit AND coalesce(line_no - prev <= 2, false) AS "after"
    FROM near WHERE hit OR line_no - prev <= 2 OR next - line_no <= 1)"""
_Q["context_before_after"] = lambda spark, sf: L.search_events(_docs(spark, sf), Match(("ther",)), before=1, after=2).drop("group_id")
_SQL["context_before_after"] = _with("SELECT * FROM ev").replace(" SELECT * FROM ev", f", {_NEAR} SELECT * FROM ev")
# texts cut into pieces of 1,000 characters or the line that is longer, each searched by itself
_Q["split_search"] = lambda spark, sf: X.search_pieces(X.cut_lines(_docs(spark, sf), chunk=1000), _EN, ["doc_id"]).select("doc_id", "line_no", "byte_offset", "line")
_SQL["split_search"] = _with(f"SELECT doc_id, line_no, byte_offset, line FROM lines WHERE regexp_matches(line, '{_RX}')")
_Q["split_context"] = lambda spark, sf: X.search_pieces(X.cut_lines(_docs(spark, sf), chunk=1000), Match(("ther",)), ["doc_id"], before=1, after=2).drop("group_id")
_SQL["split_context"] = _SQL["context_before_after"]
_Q["split_counts"] = lambda spark, sf: X.count_pieces(X.cut_lines(_docs(spark, sf), chunk=1000), _EN, ["doc_id"], occurrences=True)
_SQL["split_counts"] = _SQL["count_matches"]
_Q["context_gap_groups"] = lambda spark, sf: L.search_events(_docs(spark, sf), Match(("ther",)), before=1, after=2).groupBy("doc_id", "group_id").agg(F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"), F.sum((F.col("kind") == "match").cast("long")).alias("matches"))
_SQL["context_gap_groups"] = _with("SELECT doc_id, group_id, min(line_no) AS first_line, max(line_no) AS last_line, count(*) FILTER (kind = 'match') AS matches FROM (SELECT *, line_no - row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS group_id FROM ev) GROUP BY ALL").replace(" SELECT doc_id, group_id", f", {_NEAR} SELECT doc_id, group_id", 1)
_Q["passthru"] = lambda spark, sf: L.search_events(_docs(spark, sf), _THE, passthru=True).select("doc_id", "line_no", "byte_offset", "line", "kind")
_SQL["passthru"] = _with("SELECT doc_id, line_no, byte_offset, line, CASE WHEN contains(line, 'the') THEN 'match' ELSE 'context' END AS kind FROM lines")
_Q["match_nested_context"] = lambda spark, sf: L.nested_context(_docs(spark, sf), Match(("ther",)), before=1, after=2).select("doc_id", "line_no", "byte_offset", "line", "column", F.array_join("before_lines", "|").alias("before_lines"), F.array_join("after_lines", "|").alias("after_lines"))
_SQL["match_nested_context"] = _with("""SELECT x.doc_id, x.line_no, x.byte_offset, x.line, CAST(strlen(left(x.line, strpos(x.line, 'ther') - 1)) + 1 AS INTEGER) AS "column",
    coalesce(string_agg(e.line, '|' ORDER BY e.line_no) FILTER (e.line_no < x.line_no), '') AS before_lines, coalesce(string_agg(e.line, '|' ORDER BY e.line_no) FILTER (e.line_no > x.line_no), '') AS after_lines
    FROM ev x LEFT JOIN near e ON NOT e.hit AND e.doc_id = x.doc_id AND ((coalesce(e.line_no - e.prev <= 2, false) AND e.prev = x.line_no) OR (NOT coalesce(e.line_no - e.prev <= 2, false) AND e.next - e.line_no <= 1 AND e.next = x.line_no))
    WHERE x.kind = 'match' GROUP BY ALL""").replace(" SELECT x.doc_id", f", {_NEAR} SELECT x.doc_id", 1)
_Q["max_columns"] = lambda spark, sf: L.search_lines(_docs(spark, sf), _THE).select("doc_id", "line_no", S.limited(F.col("line"), 200).alias("text"))
_SQL["max_columns"] = _with("SELECT doc_id, line_no, CASE WHEN strlen(line) + 1 > 200 THEN '[Omitted long matching line]' ELSE line END AS text FROM lines WHERE contains(line, 'the')")
_Q["trim"] = lambda spark, sf: L.search_lines(_docs(spark, sf).withColumn("text", F.regexp_replace("text", "\n", "\n \t")), _THE).select("doc_id", "line_no", S.trimmed(F.col("line")).alias("text"))
_SQL["trim"] = _with("SELECT doc_id, line_no, ltrim(line, ' ' || chr(9)) AS text FROM lines WHERE contains(line, 'the')", "(SELECT doc_id, replace(text, chr(10), chr(10) || ' ' || chr(9)) AS text FROM documents)")
_Q["standard_format"] = lambda spark, sf: S.standard(L.search_events(_docs(spark, sf), Match(("ther",)), before=1, after=2), F.col("doc_id"), offset=F.col("byte_offset")).select("row")
_SQL["standard_format"] = _with("SELECT concat(doc_id, p, line_no, p, byte_offset, p, line) AS row FROM (SELECT *, CASE WHEN kind = 'match' THEN ':' ELSE '-' END AS p FROM ev)").replace(" SELECT concat", f", {_NEAR} SELECT concat", 1)
_Q["json_events"] = lambda spark, sf: S.json_events(_docs(spark, sf), _EN, "doc_id")
_JSON = f"""{_PIECES}, msgs AS (
    SELECT s.doc_id, s.line_no, count(*) AS n, concat('{{"type":"match","data":{{"path":{{"text":"', s.doc_id, '"}},"lines":{{"text":', CAST(to_json(s.line || CASE WHEN s.line_offset + strlen(s.line) < strlen(d.text) THEN chr(10) ELSE '' END) AS VARCHAR),
        '}},"line_number":', s.line_no, ',"absolute_offset":', s.line_offset, ',"submatches":[', string_agg(concat('{{"match":{{"text":', CAST(to_json(s.text) AS VARCHAR), '}},"start":', s.s, ',"end":', s.s + strlen(s.text), '}}'), ',' ORDER BY s.occ), ']}}}}') AS json
    FROM spans s JOIN documents d USING (doc_id) GROUP BY s.doc_id, s.line_no, s.line, s.line_offset, d.text),
ends AS (SELECT doc_id, count(*) AS lines, CAST(sum(n) AS BIGINT) AS matches, CAST(sum(strlen(json) + 1) AS BIGINT) + strlen(concat('{{"type":"begin","data":{{"path":{{"text":"', doc_id, '"}}}}}}')) + 1 AS printed FROM msgs GROUP BY doc_id)"""
_SQL["json_events"] = _with("""SELECT CAST(doc_id AS VARCHAR) AS path, line_no, json FROM msgs
    UNION ALL SELECT CAST(doc_id AS VARCHAR), 0, concat('{"type":"begin","data":{"path":{"text":"', doc_id, '"}}}') FROM ends
    UNION ALL SELECT CAST(doc_id AS VARCHAR), 4611686018427387904, concat('{"type":"end","data":{"path":{"text":"', doc_id, '"},"binary_offset":null,"stats":{"elapsed":{"secs":0,"nanos":0,"human":"0.000000s"},"searches":1,"searches_with_match":1,"bytes_searched":',
        strlen(text), ',"bytes_printed":', printed, ',"matched_lines":', lines, ',"matches":', matches, '}}}') FROM ends JOIN documents USING (doc_id)""").replace(" SELECT CAST(doc_id AS VARCHAR) AS path", f", {_JSON} SELECT CAST(doc_id AS VARCHAR) AS path", 1)
_Q["json_summary"] = lambda spark, sf: S.json_summary(_docs(spark, sf), _EN, S.json_events(_docs(spark, sf), _EN, "doc_id"))
_SQL["json_summary"] = _with("""SELECT concat('{"data":{"elapsed_total":{"human":"0.000000s","nanos":0,"secs":0},"stats":{"bytes_printed":', (SELECT CAST(sum(printed) AS BIGINT) FROM ends), ',"bytes_searched":', (SELECT CAST(sum(strlen(text)) AS BIGINT) FROM documents),
    ',"elapsed":{"human":"0.000000s","nanos":0,"secs":0},"matched_lines":', (SELECT CAST(sum(lines) AS BIGINT) FROM ends), ',"matches":', (SELECT CAST(sum(matches) AS BIGINT) FROM ends), ',"searches":', (SELECT count(*) FROM documents), ',"searches_with_match":', (SELECT count(*) FROM ends), '}},"type":"summary"}') AS json""").replace(" SELECT concat('{\"data\"", f", {_JSON} SELECT concat('{{\"data\"", 1)
_Q["heading_gaps"] = lambda spark, sf: S.printed(_docs(spark, sf), Match(("ther",)), "doc_id", how=S.Printing(heading=True, column=True, offset=True, before=1, after=2))
_SQL["heading_gaps"] = _with("""SELECT CAST(doc_id AS VARCHAR) AS path, row_number() OVER (PARTITION BY doc_id ORDER BY n, line_no, k) - 1 AS seq, kind, row FROM (
    SELECT DISTINCT doc_id, 0 AS n, 0 AS line_no, 0 AS k, 'between' AS kind, '' AS row FROM ev UNION ALL SELECT DISTINCT doc_id, 1, 0, 0, 'heading', CAST(doc_id AS VARCHAR) FROM ev
    UNION ALL SELECT doc_id, 2, line_no, 0, 'gap', '--' FROM (SELECT *, lag(line_no) OVER (PARTITION BY doc_id ORDER BY line_no) AS last FROM ev) WHERE line_no <> last + 1
    UNION ALL SELECT doc_id, 2, line_no, 1, kind, concat(line_no, p, CASE WHEN kind = 'match' THEN concat(strlen(left(line, strpos(line, 'ther') - 1)) + 1, p) ELSE '' END, byte_offset, p, line) FROM (SELECT *, CASE WHEN kind = 'match' THEN ':' ELSE '-' END AS p FROM ev))""").replace(" SELECT CAST(doc_id AS VARCHAR) AS path, row_number", f", {_NEAR} SELECT CAST(doc_id AS VARCHAR) AS path, row_number", 1)
_Q["run_stats"] = lambda spark, sf: L.run_stats(_docs(spark, sf), _EN)
_SQL["run_stats"] = _with(f"SELECT CAST(sum(len(regexp_extract_all(line, '{_RX}'))) AS BIGINT) AS matches, count(*) FILTER (regexp_matches(line, '{_RX}')) AS matched_lines, count(DISTINCT doc_id) FILTER (regexp_matches(line, '{_RX}')) AS texts_with_match, (SELECT count(*) FROM documents) AS texts_searched, (SELECT CAST(sum(strlen(text)) AS BIGINT) FROM documents) AS bytes_searched FROM lines")
_Q["crlf_anchor"] = lambda spark, sf: L.search_lines(_docs(spark, sf).withColumn("text", F.regexp_replace("text", "\n", "\r\n")), Match((r"s\.$",), crlf=True))
_SQL["crlf_anchor"] = _with(r"SELECT doc_id, line_no, byte_offset, line FROM lines WHERE regexp_matches(regexp_replace(line, '\r$', ''), 's\.$')", "(SELECT doc_id, replace(text, chr(10), chr(13) || chr(10)) AS text FROM documents)")
_Q["null_records"] = lambda spark, sf: L.search_lines(_docs(spark, sf).withColumn("text", F.replace("text", F.lit("."), F.lit("\0"))), Match(("^The",), null_data=True)).select("doc_id", "line_no", "line")
_SQL["null_records"] = "SELECT doc_id, line_no, line FROM (SELECT doc_id, unnest(string_split(text, '.')) AS line, CAST(generate_subscripts(string_split(text, '.'), 1) AS BIGINT) AS line_no FROM documents) WHERE regexp_matches(line, '(?m)^The')"


def _first_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The first lines of test items, as a table of patterns."""
    return spark.read.parquet(f"{sf}/benchmark.parquet").select(F.substring_index("text", "\n", 1).alias("p")).filter("p <> ''")


_Q["pattern_table_semi"] = lambda spark, sf: N.texts_with_pattern(_docs(spark, sf), _first_lines(spark, sf)).select("doc_id")
_SQL["pattern_table_semi"] = "SELECT DISTINCT doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM (SELECT DISTINCT string_split(text, chr(10))[1] AS p FROM benchmark) b WHERE p <> '' AND contains(d.text, p))"
_Q["pattern_table_hits"] = lambda spark, sf: N.pattern_hits(_docs(spark, sf), _first_lines(spark, sf))
_SQL["pattern_table_hits"] = "SELECT doc_id, p AS pattern FROM documents d JOIN (SELECT DISTINCT string_split(text, chr(10))[1] AS p FROM benchmark) b ON p <> '' AND contains(d.text, p)"
_Q["pattern_table_lines"] = lambda spark, sf: N.lines_with_pattern(_docs(spark, sf), _first_lines(spark, sf).select(F.substring("p", 1, 12)))
_SQL["pattern_table_lines"] = _with("SELECT doc_id, line_no, byte_offset, line FROM lines WHERE EXISTS (SELECT 1 FROM (SELECT DISTINCT left(string_split(text, chr(10))[1], 12) AS p FROM benchmark) b WHERE p <> '' AND contains(line, p))")


def _paths(spark: SparkSession, sf: str) -> DataFrame:
    """Documents at paths made of their columns; some are hidden, some in directories of other names."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ext = F.element_at(F.array(*map(F.lit, ("txt", "md", "py", "rs", "LOG"))), (F.pmod("doc_id", F.lit(5)) + 1).cast("int"))
    name = F.concat(F.when(F.pmod("doc_id", F.lit(11)) == 0, ".").otherwise(""), F.col("doc_id"), F.lit("."), ext)
    return docs.select("doc_id", "text", F.concat_ws("/", "source", "lang", name).alias("path"))


def _mixed_depths(spark: SparkSession, sf: str) -> DataFrame:
    """The same at depths of 1, 2 and 3: without both directories, without the first, or with both."""
    parts = F.split("path", "/")
    drop = F.lit(2) - F.pmod("doc_id", F.lit(3)).cast("int")
    return _paths(spark, sf).withColumn("path", F.array_join(F.slice(parts, drop + 1, F.size(parts)), "/"))


_PATH_SQL = "p AS (SELECT doc_id, text, concat_ws('/', source, lang, concat(CASE WHEN doc_id % 11 = 0 THEN '.' ELSE '' END, doc_id, '.', ['txt', 'md', 'py', 'rs', 'LOG'][doc_id % 5 + 1])) AS path FROM documents)"
_BARE = "doc_id % 11 <> 0"


def _files(name: str, condition: str, **options) -> None:
    _Q[name] = lambda spark, sf: P.select_files(_paths(spark, sf), **{k: v(spark) if callable(v) else v for k, v in options.items()}).select("doc_id", "path")
    _SQL[name] = f"WITH {_PATH_SQL} SELECT doc_id, path FROM p WHERE {condition}"


_files("files_listing", _BARE)
_files("hidden", "true", show_hidden=True)
# what a glob or a type takes in is shown though hidden
_files("glob_filter", "(path LIKE '%.md' OR path LIKE '%/en/%.py') AND NOT path LIKE 'src1/%'", globs=["*.md", "**/en/*.py", "!/src1/"])
_files("iglob_filter", "path LIKE '%.LOG'", iglobs=["*.log"])
_files("type_filter", "(path LIKE '%.py' OR path LIKE '%.rs')", types=lambda _: Types().select("py").select("rust"))
_files("type_not", _BARE + " AND NOT path LIKE '%.md'", types=lambda _: Types().negate("markdown"))
_Q["max_depth_mixed"] = lambda spark, sf: P.select_files(_mixed_depths(spark, sf), max_depth=2).select("doc_id", "path")
_SQL["max_depth_mixed"] = f"WITH {_PATH_SQL}, q AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN string_split(path, '/')[3] WHEN 1 THEN regexp_replace(path, '^[^/]*/', '') ELSE path END AS path FROM p) SELECT doc_id, path FROM q WHERE {_BARE} AND doc_id % 3 < 2"
_files("max_filesize", _BARE + " AND strlen(text) <= 1024", max_size=1024)


def _ignore_rules(spark: SparkSession) -> DataFrame:
    files = [("gitignore", "", "*.py\nfr/\n!keep.py\n# a comment\n/src2\n"), ("ignore", "src3", "*\n!*/\n!*.md\n"), ("rgignore", "src4/en", "!*.py\n"), ("explicit", "", "*.txt\n")]
    return P.rules_of(spark.createDataFrame(files, "source string, dir string, content string"))


_files("ignore_rules", _BARE + """ AND NOT (path LIKE '%/fr/%') AND NOT path LIKE 'src2/%' AND
    CASE WHEN path LIKE 'src3/%' THEN path LIKE '%.md' WHEN path LIKE 'src4/en/%.py' THEN true WHEN path LIKE '%.py' THEN false WHEN path LIKE '%.txt' THEN false ELSE true END""", rules=_ignore_rules)


def _sorted(name: str, sql: str, descending: bool) -> None:
    # sorted by ranges; a row's rank is its place in its range plus the sizes of the ranges before. Ranges are drawn
    # from samples that differ from one evaluation to the next, so both sides read what one evaluation has written
    def f(spark: SparkSession, sf: str) -> DataFrame:
        rows = _paths(spark, sf).select("path", F.split("path", "/").alias("parts"))
        ranged = rows.repartitionByRange(*[F.col("parts").desc() if descending else F.col("parts").asc()]).sortWithinPartitions(F.col("parts").desc() if descending else F.col("parts").asc())
        ranged = ranged.select("path", F.spark_partition_id().alias("task"), (F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)).alias("at"))
        ranged = stage(ranged, "ranged")
        sizes = ranged.groupBy("task").agg(F.count("*").alias("n"))
        before = sizes.select("task", F.coalesce(F.sum("n").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
        return ranged.join(F.broadcast(before), "task").select("path", (F.col("base") + F.col("at") + 1).cast("long").alias("rank"))

    _Q[name] = f
    _SQL[name] = f"WITH {_PATH_SQL} SELECT path, row_number() OVER (ORDER BY {sql}) AS rank FROM p"


_sorted("sort_path", "string_split(path, '/')", False)
_sorted("sortr_path", "string_split(path, '/') DESC", True)



def _other(name: str, table: str, key: str, text: str, match: Match, condition: str) -> None:
    _Q[name] = lambda spark, sf: L.search_lines(_docs(spark, sf, table, key, text), match).select(F.col(key).alias("key"), "line_no", "line")
    _SQL[name] = _with(f"SELECT doc_id AS key, line_no, line FROM lines WHERE {condition}", f"(SELECT row_number() OVER () AS r, {key} AS doc_id, {text} AS text FROM {table})").replace("SELECT doc_id, line_no, line, CAST", "SELECT doc_id, line_no, line, CAST")


_other("html_search", "pages", "page_id", "html", Match(("<title>[^<]*</title>",)), "regexp_matches(line, '<title>[^<]*</title>')")
_other("chat_search", "conversations", "conv_id", "text", Match(("que", "the"), word=True), r"regexp_matches(line, '(^|[^\pL\p{Nd}_])(que|the)([^\pL\p{Nd}_]|$)')")
_other("props_search", "events", "event_id", "props", Match((r'"k": 2\d',)), r"""regexp_matches(line, '"k": 2\d')""")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
