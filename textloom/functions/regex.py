"""RE2 syntax to the dialect of Spark's regular expressions (java.util.regex), by a parser.

Patterns keep RE2's meaning: `$` is the text's end unless (?m), `.` and line ends know only newline, `\\s` has no
vertical tab, word boundaries are ASCII, case folding is Unicode's, POSIX classes and script names work, and what RE2
rejects (lookaround, backreferences, possessive repeats, large counts) is rejected here.
"""

from __future__ import annotations

import re
from dataclasses import dataclass


class PatternError(ValueError):
    """A pattern that RE2 syntax doesn't have."""


#: POSIX classes as members of a Java class.
POSIX = {
    "alnum": "0-9A-Za-z", "alpha": "A-Za-z", "ascii": r"\x00-\x7F", "blank": r"\t ", "cntrl": r"\x00-\x1F\x7F", "digit": "0-9", "graph": "!-~",
    "lower": "a-z", "print": " -~", "punct": r"!-/:-@\[-`{-~", "space": r"\t\n\x0B\f\r ", "upper": "A-Z", "word": "0-9A-Za-z_", "xdigit": "0-9A-Fa-f",
}
#: Perl classes as members of a Java class.
PERL = {"d": "0-9", "s": r"\t\n\f\r ", "w": "0-9A-Za-z_"}
_SIMPLE = {"a": r"\x07", "f": r"\f", "t": r"\t", "n": r"\n", "r": r"\r", "v": r"\x0B"}
_MOST = 1000
_WORD = "[0-9A-Za-z_]"
_BOUNDARY = f"(?:(?<!{_WORD})(?={_WORD})|(?<={_WORD})(?!{_WORD}))"
_NO_BOUNDARY = f"(?:(?<!{_WORD})(?!{_WORD})|(?<={_WORD})(?={_WORD}))"
_META = set(r"\.+*?()|[]{}^$&-~#")


@dataclass
class _Flags:
    i: bool = False
    m: bool = False
    s: bool = False
    U: bool = False


def literal(text: str) -> str:
    """A pattern that matches just this text."""
    return "".join(_char(ord(c)) for c in text)


def _char(code: int) -> str:
    c = chr(code)
    if c in _META:
        return "\\" + c
    return c if c.isprintable() and code < 0x10000 else f"\\x{{{code:X}}}"


def _known(c: str, fold: bool) -> str | None:
    """The character as a match holds it, in lower case if case is ignored; None for letters with more than two forms or beyond ASCII."""
    if not fold or c.lower() == c.upper():
        return c
    return c.lower() if c.isascii() and c.lower() not in "ks" else None


def _longest(runs: list) -> tuple[str, ...] | None:
    """Of what follows each other in a pattern, texts or choices of texts, that whose shortest text is longest."""
    choices = [(r,) if isinstance(r, str) else r for r in runs if r]
    return max(choices, key=lambda c: min(map(len, c)), default=None)


def _either(needs: list) -> tuple[str, ...] | None:
    """Texts one of which any of some alternatives holds; not more than a few."""
    if None in needs or sum(map(len, needs)) > 16:
        return None
    return tuple(dict.fromkeys(x for n in needs for x in n))


def _bounded(atoms: list[str]) -> list[str]:
    """Atoms in a row, with word boundaries beside a plain word character shortened to a look at the other side."""
    out = list(atoms)
    for i, a in enumerate(atoms):
        if a == _BOUNDARY:
            before, after = atoms[i - 1] if i else "", atoms[i + 1] if i + 1 < len(atoms) else ""
            if re.fullmatch(r"[0-9A-Za-z_]|\(\?iu:[a-jl-rt-zA-JL-RT-Z]\)", after):
                out[i] = f"(?<!{_WORD})"
            elif re.fullmatch(r"[0-9A-Za-z_]|\(\?iu:[a-jl-rt-zA-JL-RT-Z]\)", before):
                out[i] = f"(?!{_WORD})"
    return out


class _Parser:
    def __init__(self, pattern: str):
        self.p, self.at, self.named = pattern, 0, 0
        #: What the pattern says about literals: for smart case, and for a required literal.
        self.letters: list[str] = []
        self.can_newline = self.at_ends = False
        #: The least length of a match of what was read last, and texts one of which it holds, in lower case if case is ignored.
        self.least, self.need = 0, None
        self.folds = False

    def fail(self, why: str) -> PatternError:
        return PatternError(f"{why} at {self.at} in {self.p!r}")

    def peek(self, n: int = 1) -> str:
        return self.p[self.at : self.at + n]

    def alternation(self, flags: _Flags, depth: int) -> str:
        if depth > 1000:
            raise self.fail("nesting too deep")
        flags, parts, least, runs = _Flags(**vars(flags)), [[]], [0], [[""]]
        while self.at < len(self.p) and self.peek() != ")":
            if self.peek() == "|":
                self.at += 1
                parts.append([])
                least.append(0)
                runs.append([""])
                continue
            self.need = None
            atom = self.atom(flags, depth)
            if atom is not None:
                need, at = self.need, self.at
                parts[-1].append(self.repeats(atom, flags))
                least[-1] += self.least
                if isinstance(need, str) and self.at == at:  # just this text
                    runs[-1][-1] += need
                elif self.least:
                    runs[-1] += [need if isinstance(need, tuple) else (need,) if need else "", ""]
                else:
                    runs[-1] += [""] if atom not in (_BOUNDARY, _NO_BOUNDARY) else []
        self.least = min(least)
        self.need = _either([_longest(r) for r in runs])
        return "|".join("".join(_bounded(x)) for x in parts)

    def repeats(self, atom: str, flags: _Flags) -> str:
        """The atom with its repeat; a repeat of a repeat is an error, as in RE2."""
        seen = False
        while True:
            m = re.match(r"[*+?]|\{(\d+)(,(\d*))?\}", self.p[self.at :])
            if not m:
                return atom
            if seen:
                raise self.fail("repeat of a repeat")
            if m[1] is not None:
                low, high = int(m[1]), int(m[3]) if m[3] else None
                if low > _MOST or (high or 0) > _MOST or (high is not None and high < low):
                    raise self.fail("bad repeat count")
            self.least *= 0 if m[0] in "*?" else 1 if m[0] == "+" else int(m[1])
            self.at += len(m[0])
            lazy = self.peek() == "?"
            self.at += lazy
            if self.peek() == "+":
                raise self.fail("possessive repeat")
            atom, seen = f"{atom}{m[0]}{'?' if lazy != flags.U else ''}", True

    def atom(self, flags: _Flags, depth: int) -> str | None:
        c = self.peek()
        if c in "*+?":
            raise self.fail("nothing to repeat")
        if c == "(":
            return self.group(flags, depth)
        self.least = 1
        if c == "[":
            return self.set(flags)
        self.at += 1
        if c in "^$":
            self.least = 0
            self.at_ends |= not flags.m
        if c == ".":
            self.can_newline |= flags.s
            return "(?s:.)" if flags.s else r"[^\n]"
        if c == "^":
            return "(?:^)" if not flags.m else "(?m:^)"
        if c == "$":
            return r"\z" if not flags.m else "(?dm:$)"
        if c == "\\":
            return self.escape(flags)
        return self.single(ord(c), flags)

    def single(self, code: int, flags: _Flags) -> str:
        self.letters.append(chr(code))
        self.can_newline |= code == 10
        self.folds |= flags.i
        self.need = _known(chr(code), flags.i)
        return f"(?iu:{_char(code)})" if flags.i and chr(code).lower() != chr(code).upper() else _char(code)

    def group(self, flags: _Flags, depth: int) -> str | None:
        m = re.match(r"\(\?P?<([A-Za-z_]\w*)>|\(\?([imsU]*)(?:-([imsU]+))?([:)])|\((?!\?)", self.p[self.at :])
        if not m or (m[4] == ")" and not (m[2] or m[3])):
            raise self.fail("unknown group")
        self.at += len(m[0])
        if m[4]:
            own = flags if m[4] == ")" else _Flags(**vars(flags))
            for names, on in ((m[2], True), (m[3] or "", False)):
                for f in names:
                    setattr(own, f, on)
            if m[4] == ")":
                return None
            inner = "(?:" + self.alternation(own, depth + 1)
        else:
            inner = "(" + self.alternation(flags, depth + 1)
        if self.peek() != ")":
            raise self.fail("missing )")
        self.at += 1
        return inner + ")"

    def number(self) -> int | None:
        m = re.match(r"x\{([0-9A-Fa-f]+)\}|x([0-9A-Fa-f]{2})|([0-7]{3}|0[0-7]{0,2})", self.p[self.at :])
        if not m:
            return None
        self.at += len(m[0])
        code = int(m[1] or m[2], 16) if m[1] or m[2] else int(m[3], 8)
        if code > 0x10FFFF:
            raise self.fail("no such code point")
        return code

    def unicode_class(self) -> str:
        """The class of \\p or \\P at hand, as a member of a Java class."""
        m = re.match(r"([pP])(?:\{(\^?)(\w+)\}|(\w))", self.p[self.at :])
        if not m:
            raise self.fail("bad Unicode class")
        self.at += len(m[0])
        name, no = m[3] or m[4], (m[1] == "P") != bool(m[2])
        self.can_newline |= no or name in ("Any", "Common") or (len(name) <= 2 and name[0] == "C")
        if name == "Any":
            return r"\x{0}-\x{10FFFF}" if not no else "&&[^\\x{0}-\\x{10FFFF}]"
        return f"\\{'P' if no else 'p'}{{{name if len(name) <= 2 else 'Is' + name}}}"

    def escape(self, flags: _Flags) -> str:
        c = self.peek()
        if not c:
            raise self.fail("trailing backslash")
        if c == "Q":
            end = self.p.find("\\E", self.at)
            text = self.p[self.at + 1 : end if end >= 0 else None]
            self.least = 0 if len(text) < 2 else len(text) - 1  # its last character may be repeated not at all
            self.at = len(self.p) if end < 0 else end + 2
            out = "".join(self.single(ord(x), flags) for x in text) or "(?:)"
            known = [_known(x, flags.i) for x in text]
            self.need = None if None in known else "".join(known)
            return out  # a repeat after it takes its last character, as in RE2
        if c in "pP":
            inner = self.unicode_class()
            return f"(?iu:[{inner}])" if flags.i else f"[{inner}]"
        if c.lower() in PERL:
            self.at += 1
            self.can_newline |= c in "sDW"
            return f"[{'^' if c.isupper() else ''}{PERL[c.lower()]}]"
        if c in "bBAz":
            self.at += 1
            self.least = 0
            self.at_ends |= c in "Az"
            return {"b": _BOUNDARY, "B": _NO_BOUNDARY, "A": r"\A", "z": r"\z"}[c]
        return self.single(self.escaped(), flags)

    def escaped(self) -> int:
        """The code point of an escape for one character."""
        c = self.peek()
        if c in _SIMPLE:
            self.at += 1
            return ord({"a": "\a", "f": "\f", "t": "\t", "n": "\n", "r": "\r", "v": "\v"}[c])
        code = self.number()
        if code is not None:
            return code
        if not c or c.isalnum() or ord(c) > 127:
            raise self.fail("unknown escape")
        self.at += 1
        return ord(c)

    def set(self, flags: _Flags) -> str:
        self.at += 1
        no = self.peek() == "^"
        self.at += no
        out, first = [], True
        while first or self.peek() != "]":
            if self.at >= len(self.p):
                raise self.fail("missing ]")
            first = False
            if m := re.match(r"\[:(\^?)(\w+):\]", self.p[self.at :]):
                if m[2] not in POSIX:
                    raise self.fail("unknown class")
                self.at += len(m[0])
                self.can_newline |= bool(m[1]) or m[2] in ("ascii", "cntrl", "space")
                out.append(f"[{m[1]}{POSIX[m[2]]}]")
                continue
            if self.peek() == "\\" and self.p[self.at + 1 : self.at + 2] in tuple("pPdDsSwW"):
                self.at += 1
                c = self.peek()
                if c in "pP":
                    out.append(self.unicode_class())
                else:
                    self.at += 1
                    self.can_newline |= c in "sDW"
                    out.append(f"[{'^' if c.isupper() else ''}{PERL[c.lower()]}]")
                continue
            low = high = self.member()
            if self.peek() == "-" and self.p[self.at + 1 : self.at + 2] not in ("]", ""):
                self.at += 1
                high = self.member()
                if high < low:
                    raise self.fail("bad range")
                out.append(f"\\x{{{low:X}}}-\\x{{{high:X}}}")
                self.letters += [chr(low), chr(high)]
            else:
                out.append(f"\\x{{{low:X}}}")
                self.letters.append(chr(low))
            self.can_newline |= low <= 10 <= high
        self.at += 1
        self.can_newline |= no
        body = f"[{'^' if no else ''}{''.join(out)}]"
        return f"(?iu:{body})" if flags.i else body

    def member(self) -> int:
        if self.peek() == "\\":
            self.at += 1
            return self.escaped()
        c = self.peek()
        self.at += 1
        return ord(c)


@dataclass(frozen=True)
class Pattern:
    """A translated pattern: Java syntax, the literal characters it names, whether a match may hold a newline, its least length and what it needs."""

    java: str
    letters: tuple[str, ...]
    can_newline: bool
    least: int
    #: Whether it has anchors at the text's ends, which mean something else in a text of many lines.
    at_ends: bool = False
    #: Texts one of which each match holds, if any are known; they are compared in lower case if `folds`.
    need: tuple[str, ...] = ()
    folds: bool = False


def translate(pattern: str, ignore_case: bool = False) -> Pattern:
    """RE2 syntax to Java's; PatternError for what RE2 rejects."""
    p = _Parser(pattern)
    java = p.alternation(_Flags(i=ignore_case), 0)
    if p.at < len(pattern):
        raise p.fail("unmatched )")
    return Pattern(java, tuple(p.letters), p.can_newline, p.least, p.at_ends, p.need or (), p.folds)


def plain_literal(pattern: str) -> str | None:
    """The text that a pattern without any syntax stands for, else None."""
    return None if not pattern or set(pattern) & set(r"\.+*?()|[]{}^$") else pattern
