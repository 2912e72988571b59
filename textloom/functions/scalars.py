"""Small values that options and output are made of: sizes, separators, durations, pattern files and exit codes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_size(text: str) -> int:
    """Bytes of "10", "10K", "2M" or "1G"; suffixes are powers of 1024 and upper-case."""
    m = re.fullmatch(r"(\d+)([KMG]?)", text)
    if not m:
        raise ValueError(f"not a size: {text!r}")
    out = int(m[1]) << {"": 0, "K": 10, "M": 20, "G": 30}[m[2]]
    if out >= 1 << 63:
        raise ValueError(f"too large: {text!r}")
    return out


def unescape_separator(text: str) -> str:
    r"""A separator with \0 \\ \r \n \t and \xZZ read; other backslashes stay."""
    plain = {"0": "\0", "\\": "\\", "r": "\r", "n": "\n", "t": "\t"}
    return re.sub(r"\\(?:x([0-9A-Fa-f]{2})|([0\\rnt]))", lambda m: chr(int(m[1], 16)) if m[1] else plain[m[2]], text)


def pattern_lines(content: str) -> list[str]:
    """Patterns of a pattern file: one a line, without carriage returns; an empty line is the pattern that matches all."""
    lines = content.split("\n")
    return [line.removesuffix("\r") for line in (lines[:-1] if lines[-1] == "" else lines)]


def human_duration(seconds: Column) -> Column:
    return F.concat(F.format_number(seconds, 6), F.lit("s"))


def exit_code(matched: Column, errors: Column, quiet: bool = False) -> Column:
    """0 for a match, 1 for none, 2 for errors; errors come first unless quiet."""
    hit = F.when(matched, 0)
    return (hit.when(errors > 0, 2) if quiet else F.when(errors > 0, 2).when(matched, 0)).otherwise(1)


def ascii_fold(text: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def preview(text: Column, most: int) -> Column:
    """The first `most` characters as users see them, by user-perceived characters, and a note of what is left out."""
    cluster = F.regexp_extract_all(text, F.lit(r"(\X)"), F.lit(1))
    return F.when(F.size(cluster) > most, F.concat(F.array_join(F.slice(cluster, 1, most), ""), F.lit(" [... omitted end of long line]"))).otherwise(text)
