"""Texts in pieces and files in ranges: what is found is what is found in the whole."""

import os
import random

import pytest
from pyspark.sql import functions as F

from textloom.functions.matching import Match
from textloom.operators import lines as L
from textloom.operators import splits as X
from textloom.plans import search as P
from textloom.sources import files as S
from textloom.sources import ranges as R

ROW = ("line_no", "byte_offset", "line", "kind", "after", "group_id")


def some_text(rng, n):
    return "".join(rng.choice(["the é\n", "x the y\n", "\n", "abc", "the\r\n", "long " * 20]) for _ in range(n))


def rows(df, *keys):
    return sorted(map(repr, df.select(*keys, *ROW).collect()))


@pytest.mark.parametrize("how", [{}, {"before": 2, "after": 1}, {"max_count": 3, "after": 2}, {"before": 3, "max_count": 2}, {"passthru": True}, {"max_count": 0}])
def test_pieces_are_as_the_whole(spark, how):
    rng = random.Random(4)
    texts = [some_text(rng, n) for n in (1, 5, 30, 90)] + ["", None, "\n", "\n\n", "the"]
    docs = spark.createDataFrame([*enumerate(texts), (None, some_text(rng, 20))], "k int, text string")
    match = Match(("the",))
    want = rows(L.search_events(docs, match, **how), "k")
    for chunk in (1, 50) if how in ({}, {"before": 2, "after": 1}) else (50,):
        pieces = X.cut_lines(docs, chunk=chunk)
        assert rows(X.search_pieces(pieces, match, ["k"], **how), "k") == want


def test_pieces_inverted(spark):
    docs, match = spark.createDataFrame([(1, some_text(random.Random(8), 60))], "k int, text string"), Match(("the",), invert=True)
    assert rows(X.search_pieces(X.cut_lines(docs, chunk=60), match, ["k"]), "k") == rows(L.search_events(docs, match), "k")


def test_one_text_in_1_2_and_50_pieces(spark):
    lines = [f"line {k} é" + ("the" if k % 7 == 0 else "") for k in range(5000)]
    text = "\n".join(lines) + "\n"
    docs = spark.createDataFrame([("a", text)], "path string, text string")
    want = [(k + 1, len("".join(x + "\n" for x in lines[:k]).encode()), x) for k, x in enumerate(lines) if x.endswith("the")]
    for pieces in (1, 2, 50):
        cut = X.cut_lines(docs, chunk=-(-len(text) // pieces))
        assert cut.count() == pieces
        got = X.search_pieces(cut, Match(("the",)), ["path"]).select("line_no", "byte_offset", "line").orderBy("line_no").collect()
        assert [tuple(r) for r in got] == want
        assert [tuple(r) for r in X.count_pieces(cut, Match(("e",)), ["path"], occurrences=True).collect()] == [("a", text.count("e"))]


def test_pieces_put_together_are_the_text(spark):
    rng = random.Random(6)
    texts = [some_text(rng, 40) for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    for chunk in (1, 33, 1000):
        cut = X.cut_lines(docs, chunk=chunk).orderBy("k", "piece").collect()
        assert ["".join(r.text for r in cut if r.k == k) for k in range(20)] == texts
        assert all(r.text.endswith("\n") for r, next_ in zip(cut, cut[1:]) if r.k == next_.k)


def test_prefix_sums_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(X, "BLOCK", 4)
    rng = random.Random(1)
    data = [(k, i, rng.randrange(9)) for k in ("a", None) for i in range(23)]
    got = {(r.k, r.i): r.before_v for r in X.prefix_sums(spark.createDataFrame(data, "k string, i long, v long"), ["k"], "i", ["v"]).collect()}
    assert got == {(k, i): sum(v for k2, j, v in data if k2 == k and j < i) for k, i, _ in data}


@pytest.fixture
def tree(tmp_path):
    rng = random.Random(1)
    (tmp_path / "a").write_text(some_text(rng, 200), encoding="utf-8", newline="")
    (tmp_path / "bom").write_text("﻿" + some_text(rng, 200), encoding="utf-8", newline="")
    (tmp_path / "empty").write_text("")
    (tmp_path / "one").write_text("the" * 500)
    (tmp_path / "nul").write_bytes((some_text(rng, 6000) + "\0the\n" + some_text(rng, 50)).encode())
    return tmp_path


@pytest.mark.parametrize("mode", ["auto", "convert", "none", "quit"])
def test_ranges_are_as_whole_files(spark, tree, mode):
    files, match = S.list_files(spark, [str(tree)]), Match(("the",))
    for how, size in (({}, 300), ({"before": 2, "after": 1, "max_count": 5}, 1 << 14)):
        whole = S.decoded(S.read_files(files), mode).select("root_idx", "path", "text")
        assert rows(R.search_files(files, match, mode, range_bytes=size, **how), "root_idx", "path") == rows(L.search_events(whole, match, **how), "root_idx", "path")


def test_tiny_ranges(spark, tree):
    files = S.list_files(spark, [str(tree)]).filter("path <> 'nul'")
    want = rows(L.search_events(S.decoded(S.read_files(files)).select("path", "text"), Match(("the",))), "path")
    assert rows(R.search_files(files, Match(("the",)), range_bytes=3), "path") == want


def test_a_file_above_2_gb(spark, tmp_path):
    size = (1 << 31) + (1 << 27)
    with open(tmp_path / "big", "wb") as f:  # 64 KiB lines of holes, so it takes next to no disk
        f.write(b"first\n")
        for at in range(1 << 16, size, 1 << 22):
            f.seek(at)
            f.write(b"\n")
        f.seek(size)
        f.write(b"\nneedle\n")
    files = S.list_files(spark, [str(tmp_path)])
    ranges = R.with_limits(R.byte_ranges(files, 1 << 26), "none")
    assert ranges.count() == -(-(size + 8) // (1 << 26))
    got = R.search_files(files, Match(("needle",)), "none", range_bytes=1 << 26).select("line_no", "byte_offset", "line").collect()
    assert [tuple(r) for r in got] == [(len(range(1 << 16, size, 1 << 22)) + 3, size + 1, "needle")]


def test_verbs_read_large_files_in_ranges(spark, tree, monkeypatch):
    want = {}
    for limit in (1 << 26, 500):
        monkeypatch.setattr(P, "LARGE_BYTES", limit)
        source = (spark, [str(tree)])
        got = (rows(P.events(source, "the", P.Options(after_context=1)), "path"), sorted(map(tuple, P.count_matches(source, "the", include_zero=True).collect())), sorted(map(tuple, P.count_matches(source, "the", P.Options(binary="convert"), occurrences=True).collect())))
        assert got == want.setdefault("whole", got) and all(got)


def test_lines_too_long_are_refused(tmp_path, monkeypatch):
    (tmp_path / "x").write_bytes(b"a" * 100 + b"\n")
    monkeypatch.setattr(R, "MOST_BYTES", 50)
    with pytest.raises(R.LineTooLong):
        R.lines_of(os.path.join(tmp_path, "x"), 0, 10)
    with pytest.raises(ValueError):
        R.byte_ranges(None, 0)


def test_slice_rule(spark, tmp_path):
    inside, outside = b"a\n" * 10 + b"\0b\n", b"a\n" * (1 << 15) + b"\0b\n"
    (tmp_path / "inside").write_bytes(inside)
    (tmp_path / "outside").write_bytes(outside)
    files = S.read_files(S.list_files(spark, [str(tmp_path)]))
    got = {r.path: r for r in S.decoded(files, "slice").collect()}
    assert (got["inside"].text, got["inside"].binary_offset) == ("", 20)
    assert (got["outside"].text, got["outside"].binary_offset) == (outside.decode(), None)
    got = {r.path: r for r in S.decoded(files, "slice_convert").collect()}
    assert (got["inside"].text, got["inside"].binary_offset) == (inside.decode(), 20)
    assert got["outside"].binary_offset is None
    assert S.decoded(files, "slice").filter(F.col("text").contains("b")).count() == 1


def test_stray_bytes_and_long_characters_are_kept_by_cuts(spark):
    docs = spark.createDataFrame([(1, bytearray("é€𝄞\n".encode() * 9 + b"a\xff\xfe\nend")), (2, None), (3, bytearray(b"\n\n")), (4, bytearray(b""))], "k int, b binary").selectExpr("k", "cast(b as string) as text")
    cut = X.cut_lines(docs, chunk=5).selectExpr("k", "piece", "cast(text as binary) as b").orderBy("k", "piece").collect()
    whole = {}
    for r in cut:
        whole[r.k] = whole.get(r.k, b"") + bytes(r.b)
    assert whole == {1: "é€𝄞\n".encode() * 9 + b"a\xff\xfe\nend", 3: b"\n\n"}
    assert [r.piece for r in cut if r.k == 1] == list(range(9))  # a line goes to the piece of its first character: 0, 4, 8, 12 ... of chunks of 5


def test_neighbours_get_no_lines(spark):
    # what reaches a piece from its neighbours is a few flags, however long their lines are, and a cut reads its text once
    docs = spark.createDataFrame([(1, "the " * 300 + "\nx\n" + "y" * 900 + "\nthe\n")], "k int, text string")
    counted = X._counted(X.cut_lines(docs, chunk=100).withColumnRenamed("text", "tl_text"), ["k", "piece"], Match(("the",)), 1, 2)
    assert dict(counted.dtypes)["head"] == dict(counted.dtypes)["tail"] == "array<boolean>"
    assert "Generate" not in X.cut_lines(docs, chunk=100)._jdf.queryExecution().executedPlan().toString()
