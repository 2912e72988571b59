"""Ignore rules and file choices judged in tasks: a directory once, by the rules that hold in it, and its entries one by one."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

#: Sources of ignore rules, the strongest first.
SOURCES = ("rgignore", "ignore", "gitignore", "exclude", "global", "explicit")
#: Sources that count only inside a repository.
GIT_SOURCES = ("gitignore", "exclude", "global")
#: Directories whose verdicts a task remembers.
REMEMBERED = 1 << 16

_FORM = re.compile(r"\(\?d(iu)?\)\^\(\?:(.*)\)\\z", re.S)
_NAME = re.compile(r"\(\?:\.\*/\)\?((?:\\.|[^\\\[\](){}.*+?^$|])+)", re.S)
_ENDING = re.compile(r"\(\?:\.\*/\)\?\[\^/\]\*((?:\\.|[^\\\[\](){}.*+?^$|])+)", re.S)


def python_regex(java: str) -> re.Pattern:
    """A glob's regular expression (globs.glob_regex) in Python's dialect."""
    fold, body = _FORM.fullmatch(java).groups()
    return re.compile(rf"(?:{body})\Z", re.I if fold else 0)


class RuleSet:
    """Globs in their order, each with a value: of those that match a path, the last decides.

    Globs that are a name, or a name's ending after a `*`, are looked up, so many of them cost no more than few.
    """

    def __init__(self, globs: Iterable[tuple[str, bool, bool]]):
        self.names: dict[str, list[tuple[int, bool, bool]]] = {}
        self.endings: dict[str, list[tuple[int, bool, bool]]] = {}
        self.others: list[tuple[int, bool, bool, re.Pattern]] = []
        for i, (regex, value, only) in enumerate(globs):
            fold, body = _FORM.fullmatch(regex).groups()
            for table, form in ((self.names, _NAME), (self.endings, _ENDING)):
                if not fold and (m := form.fullmatch(body)) and "/" not in m[1]:
                    table.setdefault(re.sub(r"\\(.)", r"\1", m[1], flags=re.S), []).append((i, value, only))
                    break
            else:
                self.others.append((i, value, only, python_regex(regex)))
        self.sizes = sorted({len(e) for e in self.endings})

    def match(self, path: str, is_dir: bool) -> bool | None:
        """The value of the last glob that matches, None if none does."""
        name = path[path.rfind("/") + 1 :]
        best, out = -1, None
        found = [self.names.get(name, ())] + [self.endings.get(name[-n:], ()) for n in self.sizes if n <= len(name)]
        for i, value, only in (x for rules in found for x in rules):
            if i > best and (is_dir or not only):
                best, out = i, value
        for i, value, only, regex in reversed(self.others):
            if i < best:
                break
            if (is_dir or not only) and regex.match(path):
                return value
        return out


@dataclass
class Place:
    """A directory that has rules or is a repository. Paths in it are matched by what follows `where`, after `prefix`."""

    where: str
    prefix: str = ""
    sets: dict[str, RuleSet] = field(default_factory=dict)
    repository: bool = False

    @property
    def level(self) -> int:
        return len(self.where) - len(self.prefix)

    def match(self, source: str, entry: str, is_dir: bool) -> bool | None:
        rules = self.sets.get(source)
        return rules.match(self.prefix + (entry[len(self.where) + 1 :] if self.where else entry), is_dir) if rules else None


def verdict(places: list[Place], entry: str, is_dir: bool, sources: tuple[str, ...] = SOURCES, require_git: bool = True) -> bool | None:
    """What rules say of an entry: True takes it in, False ignores it, None if none matches.

    places are those above the entry, the innermost first. In a source the innermost with a match decides, of sources
    the strongest. With require_git, GIT_SOURCES count inside repositories only, and but for global rules not those of
    directories above the nearest one.
    """
    nearest = max((p.level for p in places if p.repository), default=None)
    for source in sources:
        gated = require_git and source in GIT_SOURCES
        if gated and nearest is None:
            continue
        for place in places:
            if gated and source != "global" and place.level < nearest:
                continue
            said = place.match(source, entry, is_dir)
            if said is not None:
                return said
    return None


class Judge:
    """Verdicts of paths below places that are all known; a directory is judged once and remembered for what is in it.

    globs are a user's choice, which goes before the rules: True takes an entry in, False leaves it out.
    """

    def __init__(self, places: Iterable[Place], sources: tuple[str, ...], require_git: bool, globs: RuleSet | None = None):
        self.places: dict[str, list[Place]] = {}
        for p in places:
            self.places.setdefault(p.where, []).append(p)
        self.sources, self.require_git, self.globs = sources, require_git, globs
        self.known: dict[str, tuple[bool, bool, list[Place]]] = {}

    def _own(self, directory: str) -> list[Place]:
        return sorted(self.places.get(directory, []), key=lambda p: -p.level)

    def says(self, places: list[Place], entry: str, is_dir: bool) -> bool | None:
        said = self.globs.match(entry, is_dir) if self.globs else None
        return verdict(places, entry, is_dir, self.sources, self.require_git) if said is None else said

    def inside(self, directory: str) -> tuple[bool, bool, list[Place]]:
        """Whether a directory, or one above it, is ignored, and hidden, and the places that hold in it."""
        if directory in self.known:
            return self.known[directory]
        out = False, False, self._own("")
        for k in [*_slashes(directory), len(directory)] if directory else []:
            here = directory[:k]
            if here not in self.known:
                if len(self.known) > REMEMBERED:
                    self.known.clear()
                ignored, hidden, places = out
                said = self.says(places, here, True)
                name = here[here.rfind("/") + 1 :]
                self.known[here] = ignored or said is False, hidden or (name.startswith(".") and name not in (".", "..") and said is not True), self._own(here) + places
            out = self.known[here]
        return out

    def __call__(self, path: str) -> tuple[bool, bool, bool | None]:
        """(ignored, hidden, own) of a file: what holds for its directory, and what its own rules say."""
        ignored, hidden, places = self.inside(path[: max(path.rfind("/"), 0)])
        return ignored, hidden, verdict(places, path, False, self.sources, self.require_git)


def _slashes(path: str) -> Iterator[int]:
    at = path.find("/")
    while at >= 0:
        yield at
        at = path.find("/", at + 1)
