"""Texts that aren't UTF-8, made so that expressions on strings treat each stray byte as one character.

A byte that is in no well-formed sequence is stood in for by a character of its own, from the last 128 of Unicode; it
matches what any unknown character matches. Lengths and places are told in the bytes of the text as it was, and what is
returned is the text as it was. Well-formed texts, all but a few, pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Well-formed sequences of several bytes, a character a byte, without those of the stand-ins.
_SEQUENCE = (
    "[Â-ß][\u0080-¿]|à[ -¿][\u0080-¿]|[á-ìîï][\u0080-¿]{2}|í[\u0080-\u009f][\u0080-¿]"
    "|ð[\u0090-¿][\u0080-¿]{2}|[ñ-ó][\u0080-¿]{3}|ô(?:[\u0080-\u008e][\u0080-¿]{2}|\u008f[\u0080-½][\u0080-¿])"
)
#: A stand-in's bytes but the last: of bytes below 0xC0 the last is the byte itself, of the others it is 0x40 less.
_LOW, _HIGH = "ô\u008f¾", "ô\u008f¿"
_STANDIN = r"[\x{10FF80}-\x{10FFFF}]"
_OPEN, _CLOSE = "Ā", "ā"


def _chars(text: Column) -> Column:
    """The bytes as characters."""
    return F.decode(text.cast("binary"), "ISO-8859-1")


def _bytes(chars: Column) -> Column:
    return F.encode(chars, "ISO-8859-1").cast("string")


def has_standins(text: Column) -> Column:
    """Whether a text has stand-ins, or characters that look like them: a comparison of bytes."""
    return F.contains(text, F.expr("cast(X'F48FBE' as string)")) | F.contains(text, F.expr("cast(X'F48FBF' as string)"))


def armoured(text: Column) -> Column:
    """The text with stand-ins for the bytes that aren't UTF-8; well-formed texts as they are."""
    marked = F.replace(F.regexp_replace(_chars(text), f"({_SEQUENCE})|([\u0080-ÿ])", f"$1{_OPEN}$2{_CLOSE}"), F.lit(_OPEN + _CLOSE), F.lit(""))
    parts = F.split(marked, _OPEN)

    def standing(part: Column) -> Column:
        code = F.ascii(part)
        return F.concat(F.when(code < 0xC0, F.concat(F.lit(_LOW), F.substring(part, 1, 1))).otherwise(F.concat(F.lit(_HIGH), F.call_function("chr", code - 0x40))), F.substring(part, F.lit(3), F.length(part)))

    whole = F.transform(F.array(parts), lambda p: F.concat(p[0], F.array_join(F.transform(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), standing), "")))[0]
    return F.when(F.is_valid_utf8(text) & ~has_standins(text), text).otherwise(_bytes(whole))


def restored(text: Column) -> Column:
    """The bytes that an armoured text stands for."""
    low = F.regexp_replace(_chars(text), f"{_LOW}([\u0080-¿])", "$1")
    parts = F.split(low, _HIGH)
    high = lambda part: F.concat(F.call_function("chr", F.ascii(part) + 0x40), F.substring(part, F.lit(2), F.length(part)))
    whole = F.transform(F.array(parts), lambda p: F.concat(p[0], F.array_join(F.transform(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), high), "")))[0]
    return F.when(has_standins(text), _bytes(whole)).otherwise(text)


def raw_length(text: Column) -> Column:
    """The bytes of what an armoured text stands for."""
    size = F.octet_length(text)
    return F.when(has_standins(text), size - 3 * F.regexp_count(text, F.lit(_STANDIN))).otherwise(size)
