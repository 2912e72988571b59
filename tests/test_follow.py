"""Streams of texts in pieces: any cut, and any order, gives the rows of the whole."""

import random

import pytest

from textloom.functions.matching import Match
from textloom.operators import lines as L
from textloom.streaming.follow import follow_pieces, follow_table

SCHEMA = "k string, piece long, text string, last boolean"


def whole(spark, texts, match, before, after):
    df = spark.createDataFrame(list(texts.items()), "k string, text string")
    return sorted(map(tuple, L.search_events(df, match, before=before, after=after).drop("group_id").collect()))


def cut(rng, texts):
    """Micro-batches of pieces, cut anywhere and shuffled, some of them sent twice."""
    rows = []
    for k, t in texts.items():
        at = sorted(rng.randrange(len(t) + 1) for _ in range(rng.randrange(6)))
        parts = [t[a:b] for a, b in zip([0, *at], [*at, len(t)], strict=True)]
        rows += [(k, n, p, n == len(parts) - 1) for n, p in enumerate(parts)]
    rows += rng.sample(rows, len(rows) // 4)
    rng.shuffle(rows)
    return [rows[i::4] for i in range(4)]


@pytest.mark.parametrize(("before", "after"), [(0, 0), (2, 1), (0, 3)])
def test_any_cut_gives_the_rows_of_the_whole(spark, tmp_path, before, after):
    rng = random.Random(before * 7 + after)
    texts = {f"t{i}": "".join(rng.choice(["the é\n", "x\n", "\n", "abc", "the\r\n", "q "]) for _ in range(rng.randrange(40))) for i in range(8)} | {"empty": "", "one": "the", "end": "the\n"}
    match = Match(("the",))
    schema = spark.createDataFrame([], SCHEMA).schema
    source = str(tmp_path / "in")
    spark.createDataFrame([], SCHEMA).write.parquet(source)
    rows = follow_pieces(follow_table(spark, source, schema, 1), match, "k", before=before, after=after)
    name = f"pieces_{before}_{after}"
    query = rows.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        for batch in cut(rng, texts):
            spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(source)
            query.processAllAvailable()
    finally:
        query.stop()
    assert sorted(map(tuple, spark.table(name).collect())) == whole(spark, texts, match, before, after)


def test_rows_come_as_soon_as_they_are_known(spark, tmp_path):
    schema = spark.createDataFrame([], SCHEMA).schema
    source = str(tmp_path / "in")
    spark.createDataFrame([], SCHEMA).write.parquet(source)
    rows = follow_pieces(follow_table(spark, source, schema, 1), Match(("x",)), "k", before=1)
    query = rows.writeStream.format("memory").queryName("soon").start()
    seen = []
    try:
        for piece in (("a", 0, "one x\ntw", False), ("a", 1, "o\nthree x\n", False), ("a", 3, "late x", True), (None, 0, "x", True), ("a", None, "x", True), ("a", 2, None, False), ("a", 4, "x\n", False)):
            spark.createDataFrame([piece], SCHEMA).coalesce(1).write.mode("append").parquet(source)
            query.processAllAvailable()
            seen.append(sorted(r.line_no for r in spark.table("soon").filter("k = 'a'").collect()))
    finally:
        query.stop()
    assert seen == [[], [1, 2], [1, 2], [1, 2], [1, 2], [1, 2, 3, 4], [1, 2, 3, 4]]
    assert [(r.line_no, r.byte_offset, r.kind) for r in spark.table("soon").filter("k = 'a'").orderBy("line_no").collect()] == [(1, 0, "match"), (2, 6, "context"), (3, 10, "match"), (4, 18, "match")]
    assert spark.table("soon").filter("k is null").count() == 1

