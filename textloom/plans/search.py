"""The library's verbs: search, files with a match, counts, lists of files, and a stream of matches.

Each takes either paths, which are listed and read, or any table with a key and a text column.
"""

from __future__ import annotations

import os
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark import Accumulator
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from textloom.functions.filetypes import Types
from textloom.functions.globs import choice
from textloom.functions.matching import Match
from textloom.functions.scalars import pattern_lines
from textloom.operators import lines as L
from textloom.operators import paths as P
from textloom.operators import sinks as K
from textloom.operators.splits import count_pieces
from textloom.sources import files as S
from textloom.sources import ranges as R


class Unsupported(ValueError):
    """An option that this library doesn't have, on purpose."""


#: The user's own ignore file is found as git finds it.
LOOK_UP = "git"
#: Files from this size on are read in ranges, by as many tasks, where what is asked for allows it.
LARGE_BYTES = 1 << 26
#: Options that are refused with a message instead of being ignored.
REFUSED = ("replace", "multiline", "multiline_dotall", "pcre2", "encoding", "search_zip", "sort_created")


@dataclass(frozen=True)
class Options:
    """How to search. Case: smart beats ignore; line beats word. A max_count of None is no limit.

    unrestricted is how often `-u` is given: 1 leaves out ignore files, 2 shows hidden files too, 3 converts binary ones.
    global_ignore is the user's own ignore file: a path, None for none, or by default the one that git's configuration
    names. pattern_files add a pattern for each of their lines. Options of REFUSED raise Unsupported when they are given.
    """

    fixed_strings: bool = False
    ignore_case: bool = False
    smart_case: bool = False
    word_regexp: bool = False
    line_regexp: bool = False
    invert_match: bool = False
    crlf: bool = False
    null_data: bool = False
    before_context: int = 0
    after_context: int = 0
    max_count: int | None = None
    passthru: bool = False
    hidden: bool = False
    no_ignore: bool = False
    no_ignore_vcs: bool = False
    no_ignore_dot: bool = False
    no_ignore_exclude: bool = False
    no_ignore_global: bool = False
    no_ignore_files: bool = False
    no_ignore_parent: bool = False
    no_require_git: bool = False
    unrestricted: int = 0
    ignore_files: tuple[str, ...] = ()
    global_ignore: str | None = LOOK_UP
    globs: tuple[str, ...] = ()
    iglobs: tuple[str, ...] = ()
    types: tuple[str, ...] = ()
    types_not: tuple[str, ...] = ()
    type_definitions: tuple[str, ...] = ()
    max_depth: int | None = None
    max_filesize: int | None = None
    follow: bool = False
    one_file_system: bool = False
    binary: str = "auto"
    pattern_files: tuple[str, ...] = ()
    replace: str | None = None
    multiline: bool = False
    multiline_dotall: bool = False
    pcre2: bool = False
    encoding: str | None = None
    search_zip: bool = False
    sort_created: bool = False

    def __post_init__(self):
        for name in REFUSED:
            if getattr(self, name):
                raise Unsupported(f"{name} is not supported")
        for level, name, value in ((1, "no_ignore", True), (2, "hidden", True), (3, "binary", "convert")):
            if self.unrestricted >= level:
                object.__setattr__(self, name, value)

    def match(self, pattern: str | list[str] | tuple[str, ...] | None) -> Match:
        """The line predicate; without any pattern, as of an empty pattern file, nothing matches."""
        patterns = () if pattern is None else (pattern,) if isinstance(pattern, str) else tuple(pattern)
        for path in self.pattern_files:
            with open(path, encoding="utf-8", errors="surrogateescape", newline="") as f:
                patterns += tuple(pattern_lines(f.read()))
        case = "smart" if self.smart_case else "ignore" if self.ignore_case else "sensitive"
        return Match(patterns, self.fixed_strings, case, self.word_regexp and not self.line_regexp, self.line_regexp, self.invert_match, self.crlf, self.null_data)

    def _types(self) -> Types | None:
        if not (self.types or self.types_not):
            return None
        out = Types()
        for d in self.type_definitions:
            out.add(d)
        for t in self.types:
            out.select(t)
        for t in self.types_not:
            out.negate(t)
        return out


def files(spark: SparkSession, paths: list[str], options: Options = Options(), listed: Accumulator | None = None) -> DataFrame:
    """(root_idx, root, path, depth, explicit, size, mtime, atime, kind): the files that a search of the paths would open.

    Globs go before ignore rules, these before types, and what one of them takes in is shown though hidden. Directories
    that are left out aren't listed; `listed` counts those that are.
    """
    every = S.list_files(spark, paths, options.follow, options.one_file_system, options.max_depth, _pruning(options), listed)
    found = every.filter("kind = 'file'")
    if options.max_filesize is not None:
        found = found.filter(F.col("explicit") | (F.col("size") <= options.max_filesize))
    return found.select("root_idx", "root", "path", "depth", "explicit", "size", "mtime", "atime", "kind")


def _pruning(options: Options) -> S.Pruning:
    types = options._types()
    own = S.global_ignore_path(os.environ) if options.global_ignore == LOOK_UP else options.global_ignore
    return S.Pruning(
        _sources(options), not options.no_require_git, not options.no_ignore_parent and not options.no_ignore, tuple(t for t in map(S.content_of, options.ignore_files) if t is not None), S.content_of(own) if own else None,
        tuple((g.regex, not g.whitelist, g.directories_only) for g in choice(list(options.globs), list(options.iglobs))), tuple(types.globs()) if types else (), bool(types and types.requires()), options.hidden,
    )


def _sources(options: Options) -> tuple[str, ...]:
    """Sources of ignore rules that count; given files have a switch of their own."""
    off = set()
    if options.no_ignore or options.no_ignore_vcs:
        off |= {*P.GIT_SOURCES}
    if options.no_ignore or options.no_ignore_dot:
        off |= {"ignore", "rgignore"}
    off |= {"exclude"} if options.no_ignore_exclude else set()
    off |= {"global"} if options.no_ignore_global else set()
    off |= {"explicit"} if options.no_ignore_files else set()
    return tuple(s for s in P.SOURCES if s not in off)


def errors(spark: SparkSession, paths: list[str], options: Options = Options()) -> DataFrame:
    """(path, message) of what couldn't be listed."""
    return S.list_files(spark, paths, options.follow, options.one_file_system, options.max_depth, _pruning(options)).filter("kind = 'error'").select("path", "message")


def sorted_files(found: DataFrame, by: str = "path", descending: bool = False) -> DataFrame:
    """Files in order: by path, component by component, in the order of roots, or all descending; or by time of modification or access, those without last."""
    if by == "path":
        parts = F.split("path", "/")
        return found.orderBy(parts.desc()) if descending else found.orderBy("root_idx", parts)
    if by in ("modified", "accessed"):
        time = "mtime" if by == "modified" else "atime"
        return found.orderBy(F.desc_nulls_first(time) if descending else F.asc_nulls_last(time), "root_idx", "path")
    raise Unsupported(f"no order by {by}")


def _large(source: DataFrame | tuple[SparkSession, list[str]], options: Options) -> DataFrame | None:
    """The files that are read in ranges, None if there are none."""
    if isinstance(source, DataFrame) or options.null_data:
        return None
    large = files(*source, options).filter(F.col("size") >= LARGE_BYTES)
    return None if large.isEmpty() else large


def _texts(source: DataFrame | tuple[SparkSession, list[str]], options: Options, whole: bool = False, binary: bool = False, small: bool = False) -> DataFrame:
    """The table, or the (path, text) of files. whole: without files whose search stopped at a NUL; binary: with nul and
    convert; small: without those that are read in ranges."""
    if isinstance(source, DataFrame):
        return source
    spark, paths = source
    mode = "none" if options.null_data else options.binary
    found = files(spark, paths, options)
    rows = S.decoded(S.read_files(found.filter(F.col("size") < LARGE_BYTES) if small else found), mode)
    convert = F.col("explicit") if mode == "auto" else F.lit(mode == "convert")
    nul = F.lit(None).cast("long") if mode == "none" else F.col("binary_offset")
    rows = rows.select("path", "text", nul.alias("nul"), convert.alias("convert"))
    if whole:
        rows = rows.filter(F.col("nul").isNull() | F.col("convert"))
    return rows if binary else rows.select("path", "text")


def printed(source, pattern, options: Options = Options(), how: K.Printing | None = None) -> DataFrame:
    """(path, seq, kind, row): what a search prints, with notices of binary files; paths show unless one file is searched."""
    how = how or K.Printing(with_path=isinstance(source, DataFrame) or K.shows_path(source[1]))
    how = replace(how, before=options.before_context, after=options.after_context, max_count=options.max_count, passthru=options.passthru)
    if isinstance(source, DataFrame):
        return K.printed(source, options.match(pattern), how=how)
    return K.printed(_texts(source, options, binary=True), options.match(pattern), how=how, binary_offset="nul", convert=F.col("convert"))


@dataclass(frozen=True)
class Figures:
    """What a run searched and printed. seconds is the time from when it began to be asked for rows until it ended."""

    matches: int
    matched_lines: int
    texts_with_match: int
    texts_searched: int
    bytes_printed: int
    bytes_searched: int
    seconds: float

    def lines(self) -> list[str]:
        """The figures as a summary's lines; all of the time is spent searching."""
        names = ("matches", "matched lines", "files contained matches", "files searched", "bytes printed", "bytes searched")
        counts = (self.matches, self.matched_lines, self.texts_with_match, self.texts_searched, self.bytes_printed, self.bytes_searched)
        return ["", *(f"{n} {name}" for n, name in zip(counts, names, strict=True)), f"{self.seconds:.6f} seconds spent searching", f"{self.seconds:.6f} seconds total"]


def printed_with_figures(source, pattern, act: Callable[[DataFrame], object], options: Options = Options(), how: K.Printing | None = None) -> tuple[object, Figures]:
    """What `act` (one action, such as a write) makes of the rows of printed(), and the run's figures.

    The figures are observed by the job that gives the rows, so nothing is searched twice.
    """
    how = how or K.Printing(with_path=isinstance(source, DataFrame) or K.shows_path(source[1]))
    how = replace(how, before=options.before_context, after=options.after_context, max_count=options.max_count, passthru=options.passthru)
    seen = {name: Observation() for name in ("searched", "found", "printed")}
    began = time.monotonic()
    if isinstance(source, DataFrame):
        rows = K.printed(source, options.match(pattern), how=how, observe=seen)
    else:
        rows = K.printed(_texts(source, options, binary=True), options.match(pattern), how=how, binary_offset="nul", convert=F.col("convert"), observe=seen)
    out = act(rows)
    searched, found, wrote = (seen[n].get for n in ("searched", "found", "printed"))
    parting = wrote["parting_bytes"] - (wrote["parting_bytes"] // wrote["parting_rows"] if wrote["parting_rows"] else 0)  # not before the first
    return out, Figures(found["matches"], found["lines"], found["texts"], searched["texts"], wrote["bytes"] + parting, searched["bytes"], time.monotonic() - began)


def json_messages(source, pattern, options: Options = Options()) -> DataFrame:
    """(path, line_no, json): a search's messages; the run's summary is sinks.json_summary of them."""
    nul = None if isinstance(source, DataFrame) else "nul"
    return K.json_events(_texts(source, options, binary=True), options.match(pattern), "path", "text", options.before_context, options.after_context, options.max_count, options.passthru, nul)


def search(source: DataFrame | tuple[SparkSession, list[str]], pattern: str | list[str], options: Options = Options()) -> DataFrame:
    """A row for each matching line, with its context: keys, line_no, byte_offset, line, column, before_lines, after_lines."""
    return L.nested_context(_texts(source, options), options.match(pattern), "text", options.before_context, options.after_context, options.max_count)


def events(source, pattern, options: Options = Options()) -> DataFrame:
    """A row for each line that would be printed; files may be of any size, and large ones are searched by many tasks."""
    large, how = _large(source, options), (options.before_context, options.after_context, options.max_count, options.passthru)
    out = L.search_events(_texts(source, options, small=large is not None), options.match(pattern), "text", *how)
    if large is None:
        return out
    return out.unionByName(R.search_files(large, options.match(pattern), options.binary, *how).select(*out.columns))


def files_with_match(source, pattern, options: Options = Options(), without: bool = False) -> DataFrame:
    """Texts with a matching line, or without. A file that a NUL stopped is listed for a match before it, and never as without."""
    return L.texts_with_match(_texts(source, options, whole=without), options.match(pattern), "text", without)


def count_matches(source, pattern, options: Options = Options(), include_zero: bool = False, occurrences: bool = False) -> DataFrame:
    """Matching lines of each text, or matches in them; files that a NUL stopped are left out. Large files are counted by many tasks."""
    large = _large(source, options) if options.max_count is None else None
    out = L.count_lines(_texts(source, options, whole=True, small=large is not None), options.match(pattern), "text", include_zero, occurrences, options.max_count)
    if large is None:
        return out
    ranges = R.with_limits(R.byte_ranges(large), options.binary).filter(F.col("limit").isNull())
    counts = count_pieces(R.read_ranges(ranges), options.match(pattern), ["root_idx", "path"], "text", include_zero, occurrences)
    return out.unionByName(counts.select(*out.columns))


def search_stream(source, pattern, on_match: Callable[[object], bool], options: Options = Options()) -> bool:
    """Calls on_match with each row of search() until it returns False; whether it never did.

    A partition is searched while the rows of the one before are handed out. When on_match says False or raises, what
    still runs is cancelled, and the partitions after it aren't begun.
    """
    spark = (source if isinstance(source, DataFrame) else source[0].range(0)).sparkSession
    context, group = spark.sparkContext, f"textloom-{uuid.uuid4().hex}"
    rows = search(source, pattern, options)
    outer = {k: context.getLocalProperty(k) for k in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel")}
    context.setJobGroup(group, "search until told to stop", interruptOnCancel=True)
    whole = False
    try:
        for row in rows.toLocalIterator(prefetchPartitions=True):
            if on_match(row) is False:
                return False
        whole = True
        return True
    finally:
        for k, v in outer.items():
            context.setLocalProperty(k, v)
        if not whole:
            context.cancelJobGroup(group)


def any_match(source, pattern, options: Options = Options()) -> bool:
    """Whether any text has a matching line: partitions are searched in growing shares until one is found."""
    return not L.texts_with_match(_texts(source, options), options.match(pattern), "text").isEmpty()
