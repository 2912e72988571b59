"""Translated patterns mean in Spark what they mean in RE2, with DuckDB's RE2 as the judge."""

import duckdb
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.functions.matching import Match, spans
from textloom.functions.regex import PatternError, translate

TEXTS = ["foo", "foo\n", "a\rb", " ", "x\r\ny", "x\ny", "a\x0bb", "\n", "abc1", "é", "É", "ſ", "s", "S", "éa", "a&&b", "a[b]", "[", "a", "aa", "ab", "", "Ωmega", "a-b", "a]b", "K", "1.5", "A_b", "x{2}", "(a)", "straße"]
PATTERNS = [
    r"foo$", r"a.b", r"^.$", r"(?m)x$", r"\s", r"\v", r"[[:alpha:]]", r"\p{Greek}", r"(?i)é", r"(?i)s", r"\ba", r"[a&&b]", r"[a[b]]", r"(?P<n>a)", r"(?U)a+", r"\w", r"\pN", r"\Qa&&b\E", r"a|", r"(?i)k",
    r"[^a]", r"(?s)a.b", r"\Aa\z", r"[a-]", r"[]a]", r"x\{2\}", r"(?i:ab)c|d", r"[\d.]+", r"[^\W_]", r"\x{e9}", r"a{,2}", r"(?i)[a-k]", r"[[:^alpha:]]", r"\PL", r"$", r"\B", r"(|a)b", r"(?i)a(?-i)b",
]
REFUSED = [r"a++", r"\1", r"(?=b)", r"\h", r"x{1001}", r"(?x)a", r"a**", "(a", "a)", "[z-a]", "a{2,1}", "*a", "\\"]


def judged(pattern, texts):
    con = duckdb.connect()
    return [con.execute("SELECT regexp_matches(?, ?)", [t, pattern]).fetchone()[0] for t in texts]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_same_matches(spark, pattern):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")
    got = [r.m for r in df.select("i", F.col("t").rlike(translate(pattern).java).alias("m")).orderBy("i").collect()]
    assert got == judged(pattern, TEXTS)


@pytest.mark.parametrize("pattern", REFUSED)
def test_refused(pattern):
    with pytest.raises(PatternError):
        translate(pattern)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text("ab.*+?|()^$[]\\dsé ", max_size=8))
def test_random_patterns(spark, pattern):
    try:
        expected = judged(pattern, TEXTS[:12])
    except duckdb.Error:
        with pytest.raises(PatternError):
            translate(pattern)
        return
    df = spark.createDataFrame(list(enumerate(TEXTS[:12])), "i int, t string")
    assert [r.m for r in df.select("i", F.col("t").rlike(translate(pattern).java).alias("m")).orderBy("i").collect()] == expected


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text("abkt.*+?|()^$[]\\dsb\n ", max_size=8), st.booleans(), st.sampled_from(["", "word", "line"]))
def test_whole_texts_say_what_lines_say(spark, pattern, fold, how):
    """A text's condition holds wherever a line matches, and its counts are those of its lines."""
    from textloom.operators.lines import _counts

    try:
        translate(pattern)
    except PatternError:
        return
    m = Match((pattern,), case="ignore" if fold else "sensitive", word=how == "word", line=how == "line")
    texts = [*TEXTS, "ab\nkt\nK a", "a\n\nb", "tab\tkb\n", "\nb", "a b\nab", "KA\nkat b"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    lines = F.filter(F.split("t", "\n"), lambda x: m(x))
    if m.document(F.col("t")) is not None:
        assert not df.filter((F.size(lines) > 0) & ~m.document(F.col("t"))).collect()
    if m.in_text() is not None:
        n, every = _counts(m, F.col("t"))
        rows = df.select("t", n.alias("n"), every.alias("m"), F.size(lines).alias("lines"), F.aggregate(lines, F.lit(0), lambda s, x: s + F.size(spans(m, x))).alias("spans")).collect()
        assert [r for r in rows if (r.n, r.m) != (r.lines, r.spans)] == []


@pytest.mark.parametrize(("patterns", "fold", "word", "text", "found"), [
    (("foo", "foobar"), False, True, "foobar", []), (("foobar", "foo"), False, True, "foobar foo", [(0, 6), (7, 10)]), (("k",), True, False, "k K \u212a", [(0, 1), (2, 3)]),
    (("k", "é"), True, False, "K \u212a", [(0, 1), (2, 5)]), (("b", "a*"), False, False, "a\ufdd0b a", [(0, 1), (4, 5), (6, 7)]), (("a",), False, False, "\ufdd0a\ufdd1a", [(3, 4), (7, 8)]), ((), False, False, "a", []), (("\U0001F600b",), False, False, "\U0001F600\U0001F600b", [(4, 9)]),
])
def test_spans_of_modes(spark, patterns, fold, word, text, found):
    from textloom.functions.matching import first_column

    m = Match(patterns, case="ignore" if fold else "sensitive", word=word)
    row = spark.createDataFrame([(text,)], "t string").select(spans(m, F.col("t")).alias("x"), m(F.col("t")).alias("hit"), first_column(m, F.col("t")).alias("c")).first()
    got = [(x.s, x.e) for x in row.x if x.e > x.s]
    assert got == found and row.hit is bool(found) and all(text.encode()[x.s : x.e].decode() == x.text for x in row.x)
    assert not found or row.c == found[0][0] + 1


@pytest.mark.parametrize(("pattern", "text", "expected"), [("a*", "aaa", [(0, 3)]), ("a*", "baac", [(0, 0), (1, 3), (4, 4)]), ("b", "éb b", [(2, 3), (4, 5)]), ("^a|b", "aab", [(0, 1), (2, 3)]), ("", "ab", [(0, 0), (1, 1), (2, 2)])])
def test_spans(spark, pattern, text, expected):
    row = spark.createDataFrame([(text,)], "t string").select(spans(Match((pattern,)), F.col("t")).alias("x")).first()
    assert [(x.s, x.e) for x in row.x] == expected
