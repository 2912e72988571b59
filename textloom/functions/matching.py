"""Line predicates as Spark expressions: patterns, case modes, whole words and lines, inversion."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.rawbytes import has_standins, raw_length, restored
from textloom.functions.regex import literal, plain_literal, translate

_WORD = r"[\p{L}\p{Nd}_]"
#: Noncharacters that mark matches inside a line, and what stands for them in a line that has them: as many bytes.
_OPEN, _CLOSE = "\ufdd0", "\ufdd1"
_MARKS, _STANDINS = "\ufdd0\ufdd1", "\ufdd2\ufdd3"


@dataclass(frozen=True)
class Match:
    """What a line must match: any of the patterns. case is "sensitive", "ignore" or "smart"."""

    patterns: tuple[str, ...]
    fixed: bool = False
    case: str = "sensitive"
    word: bool = False
    line: bool = False
    invert: bool = False
    crlf: bool = False
    null_data: bool = False

    def __post_init__(self):
        if self.case not in ("sensitive", "ignore", "smart"):
            raise ValueError(f"unknown case mode {self.case!r}")

    def ignores_case(self) -> bool:
        if self.case != "smart":
            return self.case == "ignore"
        letters = [c for p in self.patterns for c in (p if self.fixed else translate(p).letters)]
        return bool(letters) and not any(c.isupper() for c in letters)

    def java(self) -> str:
        """One pattern in Java's dialect for one line without its end."""
        return self._java(self.null_data)

    def _java(self, many_lines: bool) -> str:
        if not self.patterns:
            return r"(?!)"  # matches nowhere
        fold = self.ignores_case()
        each = [f"(?{self._fold()}:{literal(p)})" if self._folded_literal(p) and fold else literal(p) if self.fixed else translate(p if not many_lines else f"(?m:{p})", fold).java for p in self.patterns]
        body = "|".join(f"(?:{x})" for x in each)
        if self.line:
            return rf"(?dm:^(?:{body})$)" if many_lines else rf"^(?:{body})\z"
        if self.word:
            return f"(?<!{_WORD})(?>{body})(?!{_WORD})"  # the first way to match at a place decides
        return body

    def _folded_literal(self, pattern: str) -> bool:
        return self.fixed or self._fold() == "i" and plain_literal(pattern) is not None

    def _fold(self) -> str:
        """How literals ignore case: as ASCII if all patterns are plain ASCII texts, else as Unicode."""
        plain = all((p if self.fixed else plain_literal(p)) is not None and p.isascii() for p in self.patterns)
        return "i" if plain else "iu"

    def in_text(self) -> str | None:
        """A pattern that finds in a whole text what each line has, if there is one: matches never hold a newline, nor nothing."""
        if self.invert or self.crlf or self.null_data or not self.patterns or not self.never_empty():
            return None
        if any("\n" in p if self.fixed else (t := translate(p)).can_newline or r"\A" in p or r"\z" in p for p in self.patterns):
            return None
        return self._java(True)

    def needed(self) -> tuple[tuple[str, ...], bool] | None:
        """Texts one of which a matching line holds, and whether they are compared in lower case; None if there are none such."""
        fold = self.ignores_case()
        if self.fixed and not fold:
            found, folds = [(p,) for p in self.patterns], False
        else:
            parsed = [translate(re.escape(p) if self.fixed else p, fold) for p in self.patterns]
            found, folds = [t.need for t in parsed], any(t.folds for t in parsed)
        every = tuple(dict.fromkeys(x for n in found for x in n))
        if not every or not all(found) or "" in every or len(every) > 16 or (folds and not all(x.isascii() for x in every)):
            return None
        return tuple(x.lower() for x in every) if folds else every, folds

    def literals(self) -> tuple[str, ...] | None:
        """The texts one of which a matching line holds, if matching is no more than that."""
        if not self.patterns or self.word or self.line or self.ignores_case():
            return None
        found = [p if self.fixed and p else plain_literal(p) for p in self.patterns]
        return None if None in found or "" in found else tuple(found)

    def matches_all(self) -> bool:
        return "" in self.patterns and not (self.word or self.line)

    def never_empty(self) -> bool:
        """Whether each match surely has a character."""
        return all(len(p) if self.fixed else translate(p).least for p in self.patterns) or not self.patterns

    def plain(self, text: Column) -> Column:
        """Whether a line matches, before inversion; without patterns none does."""
        if not self.patterns:
            return F.lit(False)
        if self.matches_all():
            return F.lit(True)
        if (texts := self.literals()) is not None:
            out = F.contains(text, F.lit(texts[0]))
            for t in texts[1:]:
                out = out | F.contains(text, F.lit(t))
            return out
        return text.rlike(self.java())

    def __call__(self, text: Column) -> Column:
        return ~self.plain(text) if self.invert else self.plain(text)

    def document(self, text: Column) -> Column | None:
        """A condition that every document with a matching line meets, to filter whole texts at the scan; None if there is none."""
        if self.invert or self.matches_all():
            return None
        out = None
        if (needed := self.needed()) is not None:
            texts, folds = needed
            whole = F.lower(text) if folds else text
            out = reduce(Column.__or__, (F.contains(whole, F.lit(t)) for t in texts))
        if self.literals() is None and (pattern := self.in_text()) is not None:
            hit = text.rlike(pattern)
            out = hit if out is None else out & hit
        return out


_NO_SPANS = "array<struct<s:int,e:int,text:string>>"


def spans(match: Match, line: Column) -> Column:
    """array<struct<s, e, text>>: the line's matches left to right, as half-open byte ranges.

    Matches don't overlap; an empty match where the one before ends is left out. Inverted lines have none. Of a line
    with stand-ins for bytes that aren't UTF-8 the ranges and texts are those of the bytes.
    """
    if match.invert or not match.patterns:
        return F.array().cast(_NO_SPANS)
    raw = F.encode(line, "UTF-8")
    place = lambda at: raw_length(F.decode(F.substring(raw, F.lit(1), at), "UTF-8")).cast("int")
    return F.transform(
        F.array(_spans(match, line)),
        lambda found: F.when(has_standins(line), F.transform(found, lambda m: F.struct(place(m["s"]).alias("s"), place(m["e"]).alias("e"), restored(m["text"]).alias("text")))).otherwise(found),
    )[0]


def _spans(match: Match, line: Column) -> Column:
    """spans() in the line as it stands."""
    if match.never_empty():
        return _spans_between(match, line)
    # empty matches leave nothing to cut at, so matches are marked, in a line without such marks; none is inside a character of two units
    marked = F.regexp_replace(F.translate(line, _MARKS, _STANDINS), rf"(?![\uDC00-\uDFFF])(?:{match.java()})", f"{_OPEN}$0{_CLOSE}")
    state = lambda at, out: F.struct(at.cast("int").alias("at"), out.alias("out"))
    size = len(_CLOSE.encode())

    def step(acc: Column, part: Column) -> Column:
        n = F.octet_length(F.substring_index(part, _CLOSE, 1))
        end = (acc["at"] + n).cast("int")
        touches = (n == 0) & (F.size(acc["out"]) > 0) & (F.get(acc["out"], F.size(acc["out"]) - 1)["e"] == acc["at"])
        return state(acc["at"] + F.octet_length(part) - size, F.when(touches, acc["out"]).otherwise(F.concat(acc["out"], F.array(F.struct(acc["at"].alias("s"), end.alias("e"))))))

    def of(parts: Column) -> Column:
        return F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), state(F.octet_length(parts[0]), F.array().cast("array<struct<s:int,e:int>>")), step)["out"]

    found = F.transform(F.array(F.split(marked, _OPEN)), of)[0]  # the split is done once
    raw = F.encode(line, "UTF-8")
    return F.transform(found, lambda m: F.struct(m["s"].alias("s"), m["e"].alias("e"), F.decode(F.substring(raw, m["s"] + 1, m["e"] - m["s"]), "UTF-8").alias("text")))


def _spans_between(match: Match, line: Column) -> Column:
    """spans() of matches that are never empty: what lies between matches and the matches themselves take turns."""
    pattern = f"({match.java()})"
    pairs = F.zip_with(F.split(line, pattern), F.regexp_extract_all(line, F.lit(pattern), F.lit(1)), lambda gap, text: F.struct(gap.alias("gap"), text.alias("text")))
    state = lambda at, out: F.struct(at.cast("int").alias("at"), out.alias("out"))

    def step(acc: Column, p: Column) -> Column:
        s = (acc["at"] + F.octet_length(p["gap"])).cast("int")
        e = (s + F.octet_length(p["text"])).cast("int")
        return F.when(p["text"].isNull(), acc).otherwise(state(e, F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e"), p["text"].alias("text"))))))

    return F.aggregate(pairs, state(F.lit(0), F.array().cast(_NO_SPANS)), step)["out"]


def count_of(match: Match, line: Column) -> Column:
    """The number of a line's matches; 0 for inverted lines."""
    if match.never_empty() and not match.invert:
        return F.regexp_count(line, F.lit(match.java()))
    return F.size(_spans(match, line)) if match.patterns and not match.invert else F.lit(0)


def first_column(match: Match, line: Column) -> Column:
    """The 1-based byte of the first match; null for inverted lines."""
    if match.invert:
        return F.lit(None).cast("int")
    if match.literals() is not None and len(match.literals()) == 1:
        before = F.substring(line, F.lit(1), F.instr(line, match.literals()[0]) - 1)
    else:
        before = F.regexp_extract(line, rf"(?s)\A(.*?)(?-s:{match.java()})", 1)
    return (raw_length(before) + 1).cast("int")
