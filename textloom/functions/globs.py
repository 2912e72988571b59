"""Globs of ignore files and of file lists as regular expressions in Java's dialect.

Syntax: `?` and `*` stay within a path segment, `**` as a whole segment crosses them, `[..]` and `[!..]` are sets,
`{a,b}` alternatives, a backslash quotes. In an ignore file `#` starts a comment, `!` takes a path back in, a trailing
`/` means directories only, and a pattern with no other `/` applies at any depth.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


class GlobError(ValueError):
    """A glob that can't be read."""


@dataclass(frozen=True)
class Glob:
    regex: str
    whitelist: bool = False
    directories_only: bool = False
    text: str = ""


def glob_regex(glob: str, ignore_case: bool = False) -> str:
    """The whole-path regular expression of a glob."""
    out, i, depth = [], 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**", i) and (i == 0 or glob[i - 1] == "/") and (i + 2 == len(glob) or glob[i + 2] == "/"):
            if i + 2 == len(glob):
                out.append(".*")
                i += 2
            else:  # also no segment at all
                out.append("(?:.*/)?")
                i += 3
        elif c == "*":
            while glob[i + 1 : i + 2] == "*":
                i += 1
            out.append("[^/]*")
            i += 1
        elif c == "?":
            out.append("[^/]")
            i += 1
        elif c == "[" and (m := re.match(r"\[([!^]?)(\]?(?:\\.|[^\]\\])*)\]", glob[i:])):
            out.append(f"[{'^' if m[1] else ''}{_set(m[2])}]")
            i += len(m[0])
        elif c == "{":
            out.append("(?:")
            depth, i = depth + 1, i + 1
        elif c == "}" and depth:
            out.append(")")
            depth, i = depth - 1, i + 1
        elif c == "," and depth:
            out.append("|")
            i += 1
        elif c == "\\":
            if i + 1 == len(glob):
                raise GlobError(f"trailing backslash in {glob!r}")
            out.append(re.escape(glob[i + 1]))
            i += 2
        else:
            out.append(re.escape(c))
            i += 1
    if depth:
        raise GlobError(f"unclosed brace in {glob!r}")
    return f"(?d{'iu' if ignore_case else ''})^(?:{''.join(out)})\\z"


def _set(members: str) -> str:
    body = re.sub(r"\\(.)", r"\1", members)
    return re.sub(r"([\\\[\]^&~])", r"\\\1", body)


def parse_ignore_line(line: str, ignore_case: bool = False) -> Glob | None:
    """The glob of an ignore file's line; None for blank lines and comments, GlobError for what can't be read."""
    line = line.rstrip("\r\n").strip()
    if not line or line.startswith("#"):
        return None
    return parse_glob(line, ignore_case)


def parse_glob(text: str, ignore_case: bool = False) -> Glob:
    body, white = text, False
    if body.startswith(("\\!", "\\#")):
        body = body[1:]
    elif body.startswith("!"):
        body, white = body[1:], True
    only = body.endswith("/") and len(body) > 1
    body = body.rstrip("/") if only else body
    if body.startswith("/"):
        body = body[1:]
    elif "/" not in body:
        body = f"**/{body}"
    if body.endswith("/**"):
        body += "/*"
    return Glob(glob_regex(body, ignore_case), white, only, text)


def ancestors(path: Column) -> Column:
    """The path's directories from the outermost on, and the path itself."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def override(path: Column, globs: list[Glob], is_dir: Column) -> Column:
    """What `-g` globs say of an entry: true takes it in, false (globs with `!`) leaves it out; the last match decides, null if none matches."""
    out = F.lit(None).cast("boolean")
    for g in globs:
        hit = path.rlike(g.regex)
        out = F.when(hit & is_dir if g.directories_only else hit, F.lit(not g.whitelist)).otherwise(out)
    return out


def choice(globs: list[str], iglobs: list[str] = ()) -> list[Glob]:
    """The globs of a user's choice in their order, those that ignore case last."""
    return [parse_glob(g) for g in globs] + [parse_glob(g, ignore_case=True) for g in iglobs]
