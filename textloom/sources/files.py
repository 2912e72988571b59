"""Files of directory trees as a table, listed and read by tasks.

Paths are those of a file system that every executor has mounted. Directories are listed level by level, a level at a
time by all tasks; contents are read by the tasks that search them. Spark's own file listing isn't used, as it leaves
out names that start with `_` or `.`.
"""

from __future__ import annotations

import os
import re
import stat
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import pandas as pd
from pyspark import Accumulator
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.globs import GlobError, parse_ignore_line
from textloom.functions.rules import REMEMBERED, SOURCES, Place, RuleSet, verdict
from textloom.sources.staging import staging_path

FILES = "root_idx int, root string, path string, depth int, explicit boolean, size bigint, mtime double, atime double, kind string, device bigint, message string"
#: Bytes that are read of a file at a time; a NUL takes the whole of such a piece with it.
CHUNK = 1 << 16
#: Names of ignore files and the sources of their rules.
IGNORE_FILES = {".rgignore": "rgignore", ".ignore": "ignore", ".gitignore": "gitignore"}
#: What makes a directory a repository.
REPOSITORY = (".git", ".jj")


def _row(idx: int, root: str, full: str, follow: bool, device: int | None, explicit: bool, above: frozenset) -> tuple:
    """What is at a path; `kind` is file, dir, other or error."""
    shown = os.path.relpath(full, root) if full != root else (os.path.basename(root) if explicit else "")
    depth = 0 if full == root else shown.count("/") + 1
    try:
        st = os.stat(full) if follow or explicit or full == root else os.lstat(full)
    except OSError as e:
        return idx, root, shown, depth, explicit, None, None, None, "error", device, f"{shown}: {e.strerror}"
    if stat.S_ISDIR(st.st_mode):
        kind, message = "dir", None
        if follow and full != root and (st.st_dev, st.st_ino) in above:
            kind, message = "error", f"{shown}: file system loop found"
    else:
        kind, message = ("file" if stat.S_ISREG(st.st_mode) or (explicit and not stat.S_ISLNK(st.st_mode)) else "other"), None
    return idx, root, shown, depth, explicit, st.st_size, st.st_mtime, st.st_atime, kind, st.st_dev, message


@dataclass(frozen=True)
class Pruning:
    """What a walk leaves out, a directory with all that is in it before it is listed.

    sources: of ignore rules that count; parents: also of directories above the roots; explicit and global_text: the
    contents of given ignore files and of the user's own; globs, types: (regular expression, whether it takes in,
    directories only), and whether entries that none matches stay out; hidden: whether hidden entries are shown.
    """

    sources: tuple[str, ...] = SOURCES
    require_git: bool = True
    parents: bool = True
    explicit: tuple[str, ...] = ()
    global_text: str | None = None
    globs: tuple[tuple[str, bool, bool], ...] = ()
    types: tuple[tuple[str, bool, bool], ...] = ()
    requires_type: bool = False
    hidden: bool = False


class _Walk:
    """A task's view of a walk: the rules of each directory are read once."""

    def __init__(self, pruning: Pruning):
        self.pruning = pruning
        self.globs, self.types = RuleSet(pruning.globs), RuleSet(pruning.types)
        self.requires_glob = any(take for _, take, _ in pruning.globs)
        given = {"explicit": _rule_set("\n".join(pruning.explicit)), "global": _rule_set(pruning.global_text or "")}
        self.given = {k: v for k, v in given.items() if v is not None}
        self.places: dict[str, Place] = {}

    def place(self, directory: str) -> Place:
        if directory not in self.places:
            if len(self.places) > REMEMBERED:
                self.places.clear()
            out = Place(directory.rstrip("/"), repository=any(os.path.lexists(os.path.join(directory, name)) for name in REPOSITORY))
            texts = {source: content_of(os.path.join(directory, name)) for name, source in IGNORE_FILES.items()}
            texts["exclude"] = exclude_of(directory) if out.repository else None
            out.sets = {source: rules for source, text in texts.items() if text is not None and (rules := _rule_set(text)) is not None}
            self.places[directory] = out
        return self.places[directory]

    def chosen(self, root: str, nodes: list[str], path: str, name: str, is_dir: bool) -> bool:
        """Whether an entry is searched, or listed; nodes are the directories above it that matter, the outermost first."""
        white = False
        shown = os.path.relpath(path, root)
        said = self.globs.match(shown, is_dir)
        if said is None and self.requires_glob and not is_dir:
            return False
        if said is None:
            places = [*(self.place(d) for d in reversed(nodes)), Place(root.rstrip("/"), sets=self.given)]
            said = verdict(places, path, is_dir, self.pruning.sources, self.pruning.require_git)
            white = said is True
            if said is not False and not is_dir and self.pruning.types:
                kind = self.types.match(shown, False)
                said = kind if kind is not None else False if self.pruning.requires_type else said
                white = white or kind is True
        else:
            white = said
        return said is not False and (white or self.pruning.hidden or not name.startswith("."))


def _rule_set(text: str) -> RuleSet | None:
    """The rules of an ignore file, None if it has none or a line of it can't be read."""
    try:
        globs = [parse_ignore_line(line) for line in text.removeprefix("\ufeff").split("\n")]
    except GlobError:
        return None
    return RuleSet((g.regex, g.whitelist, g.directories_only) for g in globs if g) if any(globs) else None


def _nodes_above(root: str) -> list[str]:
    """The directories above a root that have rules or are repositories, the outermost first."""
    out, here = [], os.path.dirname(root)
    while root != here:
        if any(os.path.lexists(os.path.join(here, name)) for name in (*IGNORE_FILES, *REPOSITORY)):
            out.append(here)
        root, here = here, os.path.dirname(here)
    return out[::-1]


def list_files(spark: SparkSession, roots: list[str], follow: bool = False, one_file_system: bool = False, max_depth: int | None = None, pruning: Pruning | None = None, listed: Accumulator | None = None) -> DataFrame:
    """A row for each entry under the roots; a root that is a file is explicit, a missing one an error row.

    Roots that overlap list their files twice. Symbolic links are `other` unless followed; broken ones and loops are
    errors. With pruning, what is left out has no row, and a directory that is left out isn't listed; each directory's
    row has the few directories above it whose rules its task reads. `listed` counts the directories that were listed.
    """
    first = [(i, r, r, _nodes_above(os.path.abspath(r)) if pruning and pruning.parents else []) for i, r in enumerate(map(os.path.normpath, roots))]
    names = [c.split()[0] for c in FILES.split(", ")]
    schema = FILES + ", nodes array<string>"

    def table(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[*names, "nodes"]).astype({"size": "Int64", "device": "Int64"})

    def roots_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield table([(*_row(i, r, r, True, None, not os.path.isdir(r), frozenset()), n) for i, r, n in zip(b["root_idx"], b["root"], b["nodes"], strict=True)])

    def inside(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        walk = _Walk(pruning) if pruning else None
        for b in batches:
            for i, root, path, device, nodes in zip(b["root_idx"], b["root"], b["path"], b["device"], b["nodes"], strict=True):
                here = os.path.join(root, path) if path else root
                above = set()
                at = here
                while follow and len(at) >= len(root):
                    st = os.stat(at)
                    above.add((st.st_dev, st.st_ino))
                    at = os.path.dirname(at)
                nodes = list(nodes)
                if listed is not None:
                    listed.add(1)
                try:
                    with os.scandir(here) as found:
                        entries = sorted(found, key=lambda e: e.name)
                except OSError as e:
                    rows = [(i, root, path, path.count("/") + 1, False, None, None, None, "error", device, f"{path}: {e.strerror}", [])]
                else:
                    if walk:
                        top = os.path.abspath(root)
                        full = os.path.join(top, path) if path else top
                        if any(e.name in IGNORE_FILES or e.name in REPOSITORY for e in entries):
                            nodes.append(full)
                        entries = [e for e in entries if walk.chosen(top, nodes, os.path.join(full, e.name), e.name, _is_dir(e, follow))]
                    rows = [(*_row(i, root, os.path.join(here, e.name), follow, device, False, frozenset(above)), nodes) for e in entries]
                    rows = [r for r in rows if not (one_file_system and r[8] == "dir" and r[9] != device)]
                yield table(rows)

    path = staging_path(spark, "tree")

    def level(rows: DataFrame, depth: int) -> DataFrame:
        rows.write.parquet(f"{path}/level={depth}")
        return spark.read.schema(schema).parquet(f"{path}/level={depth}")

    depth = 0
    rows = level(spark.createDataFrame(first, "root_idx int, root string, path string, nodes array<string>").mapInPandas(roots_of, schema), 0)
    while (max_depth is None or depth < max_depth) and not (dirs := rows.filter("kind = 'dir'")).isEmpty():
        depth += 1
        rows = level(dirs.repartition(spark.sparkContext.defaultParallelism, "root_idx", "path").mapInPandas(inside, schema), depth)
    every = spark.read.schema(schema).option("basePath", path).parquet(*(f"{path}/level={k}" for k in range(depth + 1)))
    return every.select(*names).filter("depth > 0 or kind <> 'dir'")


def _is_dir(entry: os.DirEntry, follow: bool) -> bool:
    try:
        return entry.is_dir(follow_symlinks=follow)
    except OSError:
        return False


def read_files(files: DataFrame, content: str = "content") -> DataFrame:
    """The files with their contents, read by the tasks that go on with them; what can't be read is null."""

    @F.pandas_udf("binary")
    def read(roots: pd.Series, paths: pd.Series, explicit: pd.Series) -> pd.Series:
        out = []
        for r, p, e in zip(roots, paths, explicit, strict=True):
            try:
                with open(r if e else os.path.join(r, p), "rb") as f:
                    out.append(f.read())
            except OSError:
                out.append(None)
        return pd.Series(out, dtype=object)

    return files.filter("kind = 'file'").withColumn(content, read("root", "path", "explicit"))


def content_of(path: str) -> str | None:
    try:
        with open(path, encoding="utf-8", errors="replace") as f:
            return f.read()
    except OSError:
        return None


#: An assignment of the user's own ignore file in a git configuration, in any section; the first in a file counts.
_EXCLUDES_FILE = re.compile(r'^\s*excludesfile\s*=\s*"?\s*(\S+?)\s*"?\s*$', re.I | re.M)


def global_ignore_path(environment: Mapping[str, str]) -> str | None:
    """The user's own ignore file, by HOME and XDG_CONFIG_HOME: what ~/.gitconfig names, else what git/config in the
    configuration folder does, else git/ignore there. A tilde is the home folder, wherever it stands."""
    home, folder = environment.get("HOME", ""), environment.get("XDG_CONFIG_HOME", "")
    folder = folder or (os.path.join(home, ".config") if home else "")
    for config in [os.path.join(home, ".gitconfig")] * bool(home) + [os.path.join(folder, "git", "config")] * bool(folder):
        if named := _EXCLUDES_FILE.search(content_of(config) or ""):
            return named[1].replace("~", home) if home else named[1]
    return os.path.join(folder, "git", "ignore") if folder else None


def exclude_of(directory: str) -> str | None:
    """A repository's info/exclude; where .git is a file, as in a worktree, that of the directory that it names."""
    git = os.path.join(directory, ".git")
    if os.path.lexists(git) and not os.path.isdir(git):
        text = (content_of(git) or "").strip()
        if not text.startswith("gitdir:"):
            return None
        git = os.path.join(directory, text.removeprefix("gitdir:").strip())
    return content_of(os.path.join(git, "info", "exclude"))


def without_bom(content: Column) -> Column:
    bom = F.lit(bytearray(b"\xef\xbb\xbf"))
    return F.when(F.substring(content, 1, 3) == bom, F.substring(content, 4, 1 << 30)).otherwise(content)


def decoded(files: DataFrame, mode: str = "auto", content: str = "content") -> DataFrame:
    """The files with `text` and `binary_offset`, the place of the first NUL.

    Modes: "none" takes NULs as they are; "convert" makes each a line end; "quit" drops the piece of CHUNK bytes with
    the first NUL and all after it, back to the last whole line; "auto" converts explicit files and quits the others.
    "slice" and "slice_convert" ask the first CHUNK bytes only and leave all other NULs: a NUL there drops the whole
    text, or, converting, is told but stays what it is.
    """
    if mode not in ("auto", "none", "convert", "quit", "slice", "slice_convert"):
        raise ValueError(f"unknown mode {mode!r}")
    raw = without_bom(F.col(content)).cast("string")
    out = files.withColumn("text", raw)
    at = F.instr("text", "\0")
    before = F.octet_length(F.substring("text", F.lit(1), at - 1))
    out = out.withColumn("binary_offset", F.when(at > 0, before.cast("long")))
    if mode == "none":
        return out
    if mode.startswith("slice"):
        out = out.withColumn("binary_offset", F.when(F.col("binary_offset") < CHUNK, F.col("binary_offset")))
        return out if mode == "slice_convert" else out.withColumn("text", F.when(F.col("binary_offset").isNull(), F.col("text")).otherwise(""))
    converted = F.replace("text", F.lit("\0"), F.lit("\n"))
    kept = F.decode(F.substring(F.encode("text", "UTF-8"), F.lit(1), (F.floor(F.col("binary_offset") / CHUNK) * CHUNK).cast("int")), "UTF-8")
    quit_ = F.when(F.instr(kept, "\n") > 0, F.concat(F.regexp_replace(kept, r"\n[^\n]*\z", ""), F.lit("\n"))).otherwise("")
    chosen = {"convert": converted, "quit": quit_, "auto": F.when(F.col("explicit"), converted).otherwise(quit_)}[mode]
    return out.withColumn("text", F.when(F.col("binary_offset").isNotNull(), chosen).otherwise(F.col("text")))
