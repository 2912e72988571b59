"""Texts that aren't UTF-8: places, columns and offsets are those of the bytes."""

import base64
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from textloom.functions.matching import Match
from textloom.functions.rawbytes import armoured, raw_length, restored
from textloom.operators import lines as L
from textloom.operators import sinks as K

PARTS = [b"th", b"th3", b" ", b"\n", b"a", b"\xff", b"\xc3\xa9", b"\xe2\x82\xac", b"\xe2\x82", b"\xf0\x9f\x98\x80", b"\x80", b"\xf4\x8f\xbe\xbf", b"\xf4\x8f\xbf\xbf", b"\xed\xa0\x80"]


def texts(spark, rows):
    df = spark.createDataFrame([(k, bytearray(r)) for k, r in enumerate(rows)], "k int, b binary")
    return df.select("k", F.col("b").cast("string").alias("text"))


def some(n=150, seed=2):
    rng = random.Random(seed)
    return [b"\xff\xfe th3", b"", "é th".encode(), *(b"".join(rng.choice(PARTS) for _ in range(rng.randrange(1, 25))) for _ in range(n))]


def test_there_and_back(spark):
    rows = some(400)
    got = texts(spark, rows).withColumn("a", armoured(F.col("text"))).select("k", F.is_valid_utf8("a").alias("ok"), restored(F.col("a")).cast("binary").alias("back"), raw_length(F.col("a")).alias("n")).collect()
    assert all(r.ok and bytes(r.back) == rows[r.k] and r.n == len(rows[r.k]) for r in got) and len(got) == len(rows)
    one = texts(spark, [b"a\xffb\xc3"]).select(F.length(armoured(F.col("text"))).alias("n")).first()
    assert one.n == 4  # each stray byte is one character


def expected(rows, pattern):
    out = []
    for k, text in enumerate(rows):
        at = 0
        lines = text.split(b"\n")
        for n, line in enumerate(lines[:-1] if lines[-1] == b"" else lines, 1):
            hits = [m for m in re.finditer(pattern, line)]
            out += [(k, n, o, m.start(), m.end(), m[0], at + m.start(), line) for o, m in enumerate(hits, 1)]
            at += len(line) + 1
    return out


@pytest.mark.parametrize(("patterns", "fixed", "python"), [(("th",), True, b"th"), (("th[0-9]?",), False, b"th[0-9]?"), (("3?",), False, b"3?"), (("th", "a"), True, b"th|a")])
def test_spans_are_as_of_bytes(spark, patterns, fixed, python):
    rows, match = some(), Match(patterns, fixed)
    found = L.search_spans(texts(spark, rows), match).select("k", "line_no", "occ", "s", "e", F.col("text").cast("binary").alias("t"), "byte_offset", F.col("line").cast("binary").alias("line")).collect()
    got = sorted((r.k, r.line_no, r.occ, r.s, r.e, bytes(r.t), r.byte_offset, bytes(r.line)) for r in found)
    if patterns == ("3?",):  # empty matches fall between characters, which bytes don't know, so full ones are compared
        got, want = ([(*x[:2], *x[3:]) for x in rows_ if x[3] < x[4]] for rows_ in (got, expected(rows, python)))
        assert got == sorted(want)
    else:
        assert got == expected(rows, python)
    want = {}
    for k, n, _, s, *_ in expected(rows, python):
        want.setdefault((k, n), s + 1)
    if patterns != ("3?",):
        rows_ = L.search_lines(texts(spark, rows), match, column=True).select("k", "line_no", "column").collect()
        assert {(r.k, r.line_no): r.column for r in rows_} == want


def test_a_stray_byte_is_a_character(spark):
    df = texts(spark, [b"a\xffb", b"a\xe2\x82b", b"\xff\xfe th3"])
    assert [r.k for r in L.search_lines(df, Match((r"^a.b$",))).collect()] == [0]
    assert [r.k for r in L.search_lines(df, Match((r"^a..b$",))).collect()] == [1]
    assert [r.k for r in L.search_lines(df, Match((r"^\W+th",))).collect()] == [2]
    got = L.search_spans(df, Match((r"th\d",))).first()
    assert (got.s, got.e, got.column, got.byte_offset) == (3, 6, 4, 3)


def test_events_context_and_json(spark):
    rows = some(60, 5)
    df = texts(spark, rows)
    got = L.search_events(df, Match(("th",)), before=1).select("k", "line_no", "byte_offset", F.col("line").cast("binary").alias("line")).collect()
    for r in got:
        assert rows[r.k][r.byte_offset :].split(b"\n")[0] == bytes(r.line) == rows[r.k].split(b"\n")[r.line_no - 1]
    nested = L.nested_context(df, Match(("th",)), before=1).select("k", "line_no", F.transform("before_lines", lambda x: x.cast("binary")).alias("b")).collect()
    assert all([bytes(x) for x in r.b] == [x.removesuffix(b"\r") for x in rows[r.k].split(b"\n")[r.line_no - 2 : r.line_no - 1]][: len(r.b)] for r in nested if r.line_no > 1)
    data = lambda d: d["text"].encode() if "text" in d else base64.b64decode(d["bytes"])
    messages = [json.loads(r.json) for r in K.json_events(df, Match(("th",)), "k").filter("line_no > 0").collect()]
    matches = [m["data"] for m in messages if m["type"] == "match"]
    assert matches
    for m in matches:
        line = data(m["lines"])
        assert rows[int(m["path"]["text"])][m["absolute_offset"] :].startswith(line)
        assert [(x["start"], x["end"]) for x in m["submatches"]] == [x.span() for x in re.finditer(b"th", line)]
        assert all(line[x["start"] : x["end"]] == data(x["match"]) for x in m["submatches"])
    ends = {m["data"]["path"]["text"]: m["data"]["stats"]["bytes_searched"] for m in messages if m["type"] == "end"}
    assert ends and all(n == len(rows[int(k)]) for k, n in ends.items())


def test_colour_and_printing(spark):
    df = texts(spark, [b"\xff\xfe th3 x"])
    row = K.printed(df, Match(("th",)), "k", how=K.Printing(color=True, column=True, line_number=False, with_path=False)).select(F.col("row").cast("binary").alias("r")).first()
    assert bytes(row.r) == b"4:\xff\xfe " + (K.RESET + K.MATCH).encode() + b"th" + K.RESET.encode() + b"3 x"
