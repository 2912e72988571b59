"""One page's HTML as template tokens and text blocks."""

from __future__ import annotations

import re
from functools import lru_cache
from hashlib import blake2b
from html import unescape

#: Zones of text: what markup says isn't the article, what it says nothing about, what it names content, and the article.
ASIDE, OTHER, CONTENT, MAIN = 0, 1, 2, 3
#: Of an element only: beside the article, unless it is in it.
HEADER = -1

#: Elements inside a block of text. A line break is a blank of its block.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label map mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements of which nothing is text of the page, wherever in a block they stand. Of the first, content isn't markup.
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
SKIPPED = RAW | frozenset("button select svg canvas audio video datalist".split())
#: Elements, and words of classes, ids and roles, that hold menus, notices, forms, comments and the like.
ASIDES = frozenset("nav aside footer form menu dialog head noscript template object".split())
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising alert alertdialog banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies disqus footer gdpr "
    "login masthead menu menubar modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promotion recommended related replies reply respond search "
    "share sharing sidebar signin signup skip social sponsor sponsored subscribe subscription toolbar topbar widget widgets".split()
)
CONTENT_WORDS = frozenset("article content main story".split())
_TITLED = frozenset("article content entry post story".split())
#: What a head holds; anything else ends it.
_IN_HEAD = frozenset("base link meta noscript script style template title".split())
#: Words that say an element is without what the next word names.
_WITHOUT = frozenset("no without has with hide".split())
#: What an open element of the key's kind ends at, if it is the innermost one.
_CLOSED_BY_OWN = frozenset("li dt dd tr td th option p".split())
_PHRASING = frozenset(("p", "h1", "h2", "h3", "h4", "h5", "h6"))
#: Elements that an article isn't in, so they are closed where one starts.
_LEFT_OPEN = frozenset("nav header footer form ul ol li dl dt dd p h1 h2 h3 h4 h5 h6 table tbody thead tr td th".split())
#: An end tag doesn't close what is outside these, unless it is a section's.
_BARRIERS = frozenset("article main td th table".split())
_SECTIONS = frozenset("article main body html section aside nav header footer table".split())

_TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|[!?][^>]*+(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"<]*+"|'[^'<]*+')*+>|[^>]*+(?:>|\Z)))""", re.S)
_NAMES = re.compile(r"""\b(class|id|role|itemprop)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""", re.I)
_RAW_END = {tag: re.compile(rf"</{tag}\b[^>]*+(?:>|\Z)", re.I) for tag in SKIPPED}


def _hash(*parts: object) -> int:
    return int.from_bytes(blake2b("\x1f".join(map(str, parts)).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


@lru_cache(1 << 14)
def _role(parent: int, tag: str, attributes: str) -> tuple[int, int]:
    """An element's role (by its place, name and classes), and the zone that its markup says."""
    said = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _NAMES.finditer(attributes)}
    kinds, roles = re.split("[^a-z]+", said.get("class", "").lower()), said.get("role", "").lower().split()
    names = kinds + re.split("[^a-z]+", said.get("id", "").lower())
    words = {w for before, w in zip(["", *names], names) if before not in _WITHOUT}.union(roles)
    zone = OTHER
    if tag in ASIDES or (words & ASIDE_WORDS and tag not in ("html", "body", "main")):
        zone = ASIDE
    elif tag in ("article", "main") or "main" in roles or "article" in roles or said.get("itemprop", "").lower() == "articlebody":
        zone = MAIN
    elif words & CONTENT_WORDS and tag in ("div", "section", "td"):
        zone = CONTENT
    elif tag == "header" or ("header" in words and tag in ("div", "section", "table", "tr", "td") and not words & _TITLED):
        zone = HEADER
    return _hash(parent, tag, *sorted(set(kinds))), zone


def read_page(html: str) -> tuple[list[int], list[int], list[int], list[int], list[int], list[str]]:
    """(tokens; and of each text block its place in them, zone, code points, code points in links, and text).

    Tokens are 64-bit hashes: of a start or end tag with its role, and of a text block with its place. Any text is
    read: open elements end with the page, end tags of nothing are passed over.
    """
    tokens: list[int] = []
    at: list[int] = []
    zones: list[int] = []
    chars: list[int] = []
    linked: list[int] = []
    texts: list[str] = []
    stack: list[tuple[str, int, int]] = [("", 0, OTHER)]  # open elements: name, role, zone
    run: list[str] = []
    in_link, link_chars = False, 0

    def flush() -> None:
        nonlocal link_chars
        text = " ".join(unescape("".join(run)).split())
        if text:
            at.append(len(tokens))
            zones.append(stack[-1][2])
            chars.append(len(text))
            linked.append(min(link_chars, len(text)))
            texts.append(text)
            tokens.append(_hash(stack[-1][1], "text", text))
        run.clear()
        link_chars = 0

    place, end = 0, len(html)
    while place < end:
        m = _TAG.search(html, place)
        piece = html[place : m.start() if m else end]
        if piece:
            run.append(piece)
            link_chars += len(piece) * in_link
        if not m:
            break
        place, name = m.end(), (m[2] or "").lower()
        if not name:
            continue
        _, parent, zone = stack[-1]
        if name in INLINE:
            if name == "br":
                run.append(" ")
            elif name == "a":
                in_link = not m[1]
            tokens.append(_role(parent, m[1] + name, "")[0])
            continue
        if name in SKIPPED and not m[1]:
            ended = _RAW_END[name].search(html, place)
            tokens.append(_role(parent, name, "")[0])
            place = ended.end() if ended else end if name in RAW else place
            continue
        flush()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == name:
                    tokens.append(~stack[k][1])
                    del stack[k:]
                    in_link = False
                    break
                if stack[k][0] in _BARRIERS and name not in _SECTIONS:
                    break
            continue
        if name == "body":
            del stack[2 if stack[1:] and stack[1][0] == "html" else 1 :]
        elif name in ("article", "main"):
            while stack[-1][0] in _LEFT_OPEN:
                stack.pop()
        elif stack[-1][0] in _PHRASING and name not in VOID or stack[-1][0] == name and name in _CLOSED_BY_OWN or stack[-1][0] == "head" and name not in _IN_HEAD:
            stack.pop()
        _, parent, zone = stack[-1]
        role, said = _role(parent, name, m[3])
        tokens.append(role)
        if name not in VOID:
            if said == HEADER:
                said = OTHER if zone == MAIN else ASIDE
            stack.append((name, role, ASIDE if ASIDE in (zone, said) else max(zone, said)))
    flush()
    return tokens, at, zones, chars, linked, texts
