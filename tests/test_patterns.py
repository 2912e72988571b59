"""Many patterns at once, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from textloom.functions.matching import Match
from textloom.operators import lines as L
from textloom.operators import patterns as P

TEXTS = ["Something. Thing.", "foo bar", "so foo ba", "someone two threefold", "one twos three", "at 42 %", "no first line", "", None, "a  b", "café", "a.b c", "xa.b.cd", "AAAAaaaaAAAA", "x" * 3000 + "needle in it" + "y" * 50, "ends in 12345678", "123456789"]
PATTERNS = ["Thing.", "foo ba", "one two three", "42 %", None, "  ", "é", "a.b.c", "needle in it", "ENDS IN", "12345678", "123456789", "aaaaaaaa", "\n", "e\nf"]


def tables(spark, texts=TEXTS, patterns=PATTERNS):
    return spark.createDataFrame(list(enumerate(texts)), "k int, text string").repartition(3), spark.createDataFrame([(p,) for p in patterns], "p string")


def expected(texts, patterns, fold=False):
    low = (lambda x: x and "".join(c.lower() if c.isascii() else c for c in x)) if fold else (lambda x: x)
    return {(k, low(p)) for k, t in enumerate(texts) for p in patterns if t is not None and p and low(p) in low(t)}


@pytest.mark.parametrize(("fold", "most"), [(False, 1 << 18), (True, 1 << 18), (False, 4), (True, 2)])
def test_hits_and_semi_join(spark, monkeypatch, fold, most):
    monkeypatch.setattr(P, "INDEX_PATTERNS", most)
    docs, patterns = tables(spark)
    want = expected(TEXTS, PATTERNS, fold)
    got = [tuple(r) for r in P.pattern_hits(docs, patterns, ignore_case=fold).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    keys = lambda df: sorted(r.k for r in df.collect())
    assert keys(P.texts_with_pattern(docs, patterns, ignore_case=fold)) == sorted({k for k, _ in want})
    assert keys(P.texts_with_pattern(docs, patterns, ignore_case=fold, without=True)) == sorted(set(range(len(TEXTS))) - {k for k, _ in want})


def test_random_patterns(spark, monkeypatch):
    monkeypatch.setattr(P, "STEP", 37)
    monkeypatch.setattr(P, "SAMPLE_TEXTS", 3)
    rng = random.Random(3)
    texts = ["".join(rng.choice("abé\n ") for _ in range(rng.randrange(60))) for _ in range(80)]
    patterns = list({"".join(rng.choice("abé ") for _ in range(rng.randrange(1, 14))) for _ in range(150)})
    docs, table = tables(spark, texts, patterns)
    assert {tuple(r) for r in P.pattern_hits(docs, table).collect()} == expected(texts, patterns)


def test_lines(spark):
    texts = ["one\ntwo é\n\nthree", "é\né", None, "two"]
    docs, patterns = tables(spark, texts, ["two", "é", "thr"])
    match = Match(("two", "é", "thr"), fixed=True)
    assert sorted(map(tuple, P.lines_with_pattern(docs, patterns).collect())) == sorted(map(tuple, L.search_lines(docs, match).collect()))
    inverted = Match(("two", "é", "thr"), fixed=True, invert=True)
    assert sorted(map(tuple, P.lines_with_pattern(docs, patterns, invert=True).collect())) == sorted(map(tuple, L.search_lines(docs, inverted).collect()))


def test_no_and_empty_patterns(spark):
    docs, patterns = tables(spark)
    assert P.texts_with_pattern(docs, patterns.limit(0)).count() == 0 == P.pattern_hits(docs, patterns.limit(0)).count()
    assert P.texts_with_pattern(docs, patterns.limit(0), without=True).count() == len(TEXTS)
    empty = patterns.union(spark.createDataFrame([("",)], "p string"))
    assert P.texts_with_pattern(docs, empty).count() == len(TEXTS) - 1 and P.texts_with_pattern(docs, empty, without=True).count() == 1
    assert P.texts_with_pattern(docs.limit(0), patterns).count() == 0


def test_a_hundred_thousand_patterns(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("etaoinshr") for _ in range(rng.randrange(2, 9))) for _ in range(3000)]
    patterns = list({"the " + " ".join(rng.choice(words) for _ in range(4)) for _ in range(100_000)})
    texts = [" ".join(["the"] * 3 + [rng.choice(words) for _ in range(300)] + ["the"]) for _ in range(200)]
    planted = {k: rng.choice(patterns) for k in range(0, 200, 7)}
    texts = [f"{t} {planted[k]}" if k in planted else t for k, t in enumerate(texts)]
    docs, table = tables(spark, texts, patterns)
    found = P.texts_with_pattern(docs, table)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "SortMergeJoin" not in plan
    assert {r.k for r in found.collect()} >= set(planted)
    hits = {tuple(r) for r in P.pattern_hits(docs, table).collect()}
    assert hits >= set(planted.items()) and all(p in texts[k] for k, p in hits)


def test_clashing_names(spark):
    docs, patterns = tables(spark)
    rows = P.pattern_hits(docs.withColumn("pattern", F.lit("own")), patterns)
    assert rows.columns == ["k", "pattern", "pattern_"] and rows.count() == len(expected(TEXTS, PATTERNS))


@pytest.mark.parametrize(("fold", "most"), [(False, 1 << 18), (True, 3)])
def test_lines_are_found_in_whole_texts(spark, monkeypatch, fold, most):
    monkeypatch.setattr(P, "INDEX_PATTERNS", most)
    monkeypatch.setattr(P, "ROWS", 2)
    texts = [*TEXTS, "\n\nThing.\n", "e\nfoo ba\n\nx é", "foo\n ba", "\n", "42 %"]
    docs, patterns = tables(spark, texts, PATTERNS)
    docs = docs.withColumn("line", F.lit("own"))
    match = dict(fixed=True, case="ignore") if fold else dict(fixed=True)
    every = tuple(p for p in PATTERNS if p and "\n" not in p)
    for invert in (False, True):
        found = P.lines_with_pattern(docs, patterns, ignore_case=fold, invert=invert)
        want = L.search_lines(docs, Match(every, invert=invert, **match))
        assert found.columns == want.columns
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
        assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()  # lines that aren't found never are rows
    raw = docs.limit(1).select("k", F.expr("cast(X'61ff0a0afe54' as string)").alias("text"))
    row = P.lines_with_pattern(raw, patterns.limit(0).union(spark.createDataFrame([("T",)], "p string"))).selectExpr("line_no", "byte_offset", "cast(line as binary) as b").collect()
    assert [(r.line_no, r.byte_offset, bytes(r.b)) for r in row] == [(3, 4, b"\xfeT")]
