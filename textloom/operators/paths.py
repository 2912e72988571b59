"""Which files are searched: hidden files, globs, types, depth, size and ignore rules, as conditions on a table of paths."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.filetypes import Types
from textloom.functions.globs import Glob, GlobError, ancestors, choice, override, parse_ignore_line
from textloom.functions.rules import GIT_SOURCES, SOURCES, Judge, Place, RuleSet

#: Ignore rules, and repositories, that each task gets at most; more are joined by directory.
BROADCAST_RULES = 50_000
RULES = "source string, dir string, prefix string, idx int, regex string, whitelist boolean, directories_only boolean"


def rules_of(files: DataFrame) -> DataFrame:
    """Rule rows from (source, dir, prefix, content) rows of ignore files: one for each line that is a glob.

    A file with a line that can't be read has no rules at all.
    dir is the file's directory below the root. For files above the root it is empty and prefix is the way from their
    directory to the root, with a slash at its end; the column may be missing.
    """
    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for source, where, prefix, content in zip(b["source"], b["dir"], b["prefix"], b["content"], strict=True):
                try:
                    globs = [parse_ignore_line(line) for line in (content or "").removeprefix("\ufeff").split("\n")]
                except GlobError:
                    continue
                rows += [(source, where, prefix, i, g.regex, g.whitelist, g.directories_only) for i, g in enumerate(globs) if g]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in RULES.split(", ")])

    prefix = F.col("prefix") if "prefix" in files.columns else F.lit("").alias("prefix")
    return files.select("source", "dir", prefix, "content").mapInPandas(f, RULES)


VERDICTS = "ignored_above boolean, hidden_above boolean, own boolean"


def with_verdicts(files: DataFrame, rules: DataFrame, path_column: str = "path", sources: tuple[str, ...] = SOURCES, repositories: DataFrame | None = None, globs: list[Glob] = ()) -> DataFrame:
    """The files with `verdict`, a struct of ignored_above, hidden_above and own, by rules of directories above them.

    A rule of a directory is matched with the path below that directory. In a source the innermost directory with a
    match decides, by its last rule that matches; of sources the strongest that decides. own is that of the file: true
    takes it in, false ignores it. A directory that is ignored, or hidden and not taken in, is so with all that is in
    it; globs decide directories before rules do. Given repositories' (dir, prefix), rules of GIT_SOURCES count for what
    is inside one only, and those of directories above the nearest one don't; global ones have no place.

    Up to BROADCAST_RULES rules are sent to the tasks, which judge each directory once; more are joined by directory.
    """
    own = rules.filter(F.col("source").isin(*sources))
    few = own.limit(BROADCAST_RULES + 1).collect()
    near = [] if repositories is None else repositories.select("dir", "prefix").distinct().limit(BROADCAST_RULES + 1).collect()
    if max(len(few), len(near)) > BROADCAST_RULES:
        return _joined(files, own, path_column, sources, repositories, list(globs))
    sent = files.sparkSession.sparkContext.broadcast(([tuple(r) for r in few], [tuple(r) for r in near]))
    chosen, require = [(g.regex, not g.whitelist, g.directories_only) for g in globs], repositories is not None

    @F.pandas_udf(VERDICTS)
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        judged = Judge(_places(*sent.value), sources, require, RuleSet(chosen) if chosen else None)
        for paths in batches:
            yield pd.DataFrame([(None, None, None) if p is None else judged(p) for p in paths], columns=["ignored_above", "hidden_above", "own"], dtype=object)

    return files.withColumn("verdict", judge(F.col(path_column)))


def _places(rules: list[tuple], repositories: list[tuple]) -> list[Place]:
    """Places from rows of RULES and (dir, prefix) of repositories."""
    places: dict[tuple[str, str], Place] = {}
    globs: dict[tuple[str, str, str], list] = {}
    for source, where, prefix, idx, regex, white, only in rules:
        globs.setdefault((where, prefix, source), []).append((idx, regex, white, only))
    for (where, prefix, source), found in globs.items():
        places.setdefault((where, prefix), Place(where, prefix)).sets[source] = RuleSet(g[1:] for g in sorted(found))
    for where, prefix in repositories:
        places.setdefault((where, prefix), Place(where, prefix)).repository = True
    return list(places.values())


def _joined(files: DataFrame, own: DataFrame, path_column: str, sources: tuple[str, ...], repositories: DataFrame | None, globs: list[Glob]) -> DataFrame:
    """with_verdicts() for any number of rules: each distinct directory and path is judged once, then paths meet their directories."""
    paths = files.select(F.col(path_column).alias("file")).filter("file is not null").distinct()
    parents = lambda c: F.slice(ancestors(c), 1, F.size(F.split(c, "/")) - 1)
    met = paths.select("file", F.explode(parents(F.col("file"))).alias("entry"))
    entries = paths.select(F.col("file").alias("entry"), F.lit(False).alias("is_dir")).unionByName(met.select("entry", F.lit(True).alias("is_dir")).distinct())
    rank = F.create_map(*(F.lit(x) for i, s in enumerate(sources) for x in (s, i)))
    ranked = own.withColumn("rank", F.element_at(rank, F.col("source")))
    above = entries.select("entry", "is_dir", F.explode(F.concat(F.array(F.lit("")), parents(F.col("entry")))).alias("dir")).join(ranked.select("dir").distinct(), "dir", "left_semi")
    hits = above.join(ranked, "dir").filter((~F.col("directories_only") | F.col("is_dir")) & F.expr("concat(prefix, if(dir = '', entry, substring(entry, length(dir) + 2))) rlike regex"))
    if repositories is not None:
        level = F.length("dir") - F.length("prefix")
        holds = entries.select("entry", "is_dir", F.explode(F.concat(F.array(F.lit("")), parents(F.col("entry")))).alias("dir"))
        nearest = holds.join(repositories.select("dir", "prefix").distinct(), "dir").groupBy("entry", "is_dir").agg(F.max(level).alias("repository"))
        hits = hits.join(nearest, ["entry", "is_dir"], "left").filter(~F.col("source").isin(*GIT_SOURCES) | (F.col("repository").isNotNull() & ((F.col("source") == "global") | (level >= F.col("repository")))))
    per = hits.groupBy("entry", "is_dir", "rank").agg(F.max_by("whitelist", F.struct(F.length("dir") - F.length("prefix"), "idx")).alias("whitelist"))
    per = per.groupBy("entry", "is_dir").agg(F.min_by("whitelist", "rank").alias("says"))
    said = entries.join(per, ["entry", "is_dir"], "left")
    name = F.element_at(F.split("entry", "/"), -1)
    directory = F.coalesce(override(F.col("entry"), globs, F.lit(True)), F.col("says"))
    dirs = said.filter("is_dir").select("entry", F.coalesce(~directory, F.lit(False)).alias("ignored"), (name.startswith(".") & ~name.isin(".", "..") & ~F.coalesce(directory, F.lit(False))).alias("hidden"))
    inside = met.join(dirs, "entry").groupBy("file").agg(F.bool_or("ignored").alias("ignored"), F.bool_or("hidden").alias("hidden"))
    out = files.join(said.filter("not is_dir").select(F.col("entry").alias("tl_file"), "says"), F.col(path_column) == F.col("tl_file"), "left")
    out = out.join(inside.withColumnRenamed("file", "tl_dir_of"), F.col(path_column) == F.col("tl_dir_of"), "left")
    no = lambda c: F.coalesce(c, F.lit(False))
    return out.select(*(files[c] for c in files.columns), F.struct(no("ignored").alias("ignored_above"), no("hidden").alias("hidden_above"), F.col("says").alias("own")).alias("verdict"))


def hidden_name(name: Column) -> Column:
    return name.startswith(".") & ~name.isin(".", "..")


def hidden(path: Column) -> Column:
    """Whether the file or a directory above it has a name that starts with a dot."""
    return F.exists(F.split(path, "/"), hidden_name)


def depth(path: Column) -> Column:
    return F.size(F.split(path, "/"))


def select_files(files: DataFrame, path_column: str = "path", show_hidden: bool = False, globs: list[str] | None = None, iglobs: list[str] | None = None, types: Types | None = None, max_depth: int | None = None, max_size: int | None = None, size: Column | None = None, rules: DataFrame | None = None, sources: tuple[str, ...] = SOURCES, repositories: DataFrame | None = None) -> DataFrame:
    """The files that are searched. Globs go before ignore rules, these before types, and hidden files come last: what a
    glob, a rule or a type takes in is shown though hidden. Of a directory that is left out nothing is searched."""
    path, columns = F.col(path_column), files.columns
    chosen = choice(globs or [], iglobs or [])
    keep = F.lit(True)
    if max_depth is not None:
        keep = keep & (depth(path) <= max_depth)
    if max_size is not None:
        keep = keep & ((F.octet_length("text") if size is None else size) <= max_size)
    files = files.filter(keep)
    own = F.lit(None).cast("boolean")
    if rules is not None:
        files = with_verdicts(files, rules, path_column, sources, repositories, chosen)
        ignored, hides, own = F.col("verdict.ignored_above"), F.col("verdict.hidden_above"), F.col("verdict.own")
    else:
        above = F.slice(ancestors(path), 1, F.size(F.split(path, "/")) - 1)
        says = lambda d: override(d, chosen, F.lit(True))
        ignored = F.exists(above, lambda d: F.coalesce(~says(d), F.lit(False))) if chosen else F.lit(False)
        hides = F.exists(above, lambda d: hidden_name(F.element_at(F.split(d, "/"), -1)) & ~F.coalesce(says(d), F.lit(False))) if chosen else F.exists(F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1), hidden_name)
    glob = override(path, chosen, F.lit(False))
    kind = types.says(path) if types is not None else F.lit(None).cast("boolean")
    shown = F.lit(True) if show_hidden else ~hidden_name(F.element_at(F.split(path, "/"), -1)) | F.coalesce(own, F.lit(False)) | F.coalesce(kind, F.lit(False))
    passes = F.coalesce(own, F.lit(True)) & (types.keeps(path) if types is not None else F.lit(True)) & shown
    if any(not g.whitelist for g in chosen):
        passes = F.lit(False)  # what globs take is all there is
    out = ~ignored & F.coalesce(glob, passes)
    return files.filter(out if show_hidden else out & ~hides).select(*columns)
