"""Code points of text blocks, their classes, and the spans that a byte-level BPE's splitting pattern makes of them."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Classes of code points.
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
#: The code points with the Unicode property White_Space.
WHITE_SPACE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
#: What may follow an apostrophe to make a piece of its own.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of each code point, in the Unicode version that the tokenizers library knows.

    `regex` proposes letters and numbers; those that Python's own tables don't have yet are asked of the library.
    """
    import unicodedata

    import regex
    from tokenizers.pre_tokenizers import ByteLevel

    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    out, split = np.zeros(0x110000, np.uint8), ByteLevel(add_prefix_space=False).pre_tokenize_str
    for kind, pattern, same in ((LETTER, r"\p{L}", "a"), (NUMBER, r"\p{N}", "1")):
        for c in regex.findall(pattern, every):
            if unicodedata.category(c) != "Cn" or len(split(same + c)) == 1:
                out[ord(c)] = kind
    out[list(WHITE_SPACE)] = SPACE
    return out


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[str, np.ndarray, np.ndarray]:
    """The rows' text as one string, its code points and the rows' offsets in them; bytes that aren't UTF-8 read as U+FFFD."""
    raw = data.tobytes()
    try:
        text = raw.decode()
        leads = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=leads[1:])
        at = leads[offsets]
    except UnicodeDecodeError:
        rows = [raw[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        text, at = "".join(rows), np.cumsum([0, *map(len, rows)])
    return text, np.frombuffer(text.encode("utf-32-le"), np.uint32), at


def bpe_words(points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where words start, by the public splitting pattern of byte-level BPE vocabularies, each row on its own.

    A word is a run of letters, of numbers or of other marks, with one blank before it; a contraction after an
    apostrophe that starts a word; or white space, whose last character stays apart if text follows.
    """
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes()[points]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    first = first[:n]
    start = first.copy()
    start[1:] |= kind[1:] != kind[:-1]
    after = np.flatnonzero(~first & (kind != SPACE) & np.concatenate(([False], kind[:-1] == SPACE)))
    start[after - 1] = True
    start[after[points[after - 1] == 0x20]] = False
    mark = np.flatnonzero(start & (points == 0x27))
    if len(mark):
        stop = offsets[np.searchsorted(offsets, mark, "right")]
        padded = np.concatenate((points, np.zeros(3, np.uint32)))
        for tail in CONTRACTIONS:
            hit = mark[mark + len(tail) < stop]
            for k, c in enumerate(tail):
                hit = hit[padded[hit + 1 + k] == ord(c)]
            start[hit + 1] = False
            over = hit + 1 + len(tail)
            start[over[over < n]] = True
    return np.flatnonzero(start)
