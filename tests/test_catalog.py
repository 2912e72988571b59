"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import os

import duckdb
import pytest

from textloom.plans.catalog import oracle_sql, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query(spark, duck, name):
    df = queries()[name](spark, SF)
    columns = sorted(df.columns)
    result = duck.execute(oracle_sql()[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    expected = sorted(repr(tuple(r[names.index(c)] for c in columns)) for r in result.fetchall())
    assert sorted(repr(tuple(r)) for r in df.select(columns).collect()) == expected


@pytest.mark.parametrize("block", [4096, 2])
def test_short_patterns(spark, duck, tmp_path, monkeypatch, block):
    from textloom.operators import patterns

    monkeypatch.setattr(patterns, "INDEX_PATTERNS", block)
    items = ["Thing.\nmore", "foo ba", "one two three\nx", "42 %", "\nno first line", None, "  ", "é", "a.b.c"]
    texts = ["Something. Thing.", "foo bar", "so foo ba", "someone two threefold", "one twos three", "at 42 %", "no first line", "", None, "a  b", "café", "a.b c", "xa.b.cd"]
    spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    sql = oracle_sql()["pattern_table_semi"]
    for name in ("benchmark", "documents"):
        sql = sql.replace(f"FROM {name}", f"FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = {r.doc_id for r in queries()["pattern_table_semi"](spark, str(tmp_path)).collect()}
    assert got == {r[0] for r in duck.execute(sql).fetchall()} == {0, 1, 2, 3, 5, 9, 10, 12}


def test_max_depth_keeps_and_drops(spark):
    every = queries()["files_listing"](spark, SF).count()
    kept = [r.path.count("/") + 1 for r in queries()["max_depth_mixed"](spark, SF).collect()]
    assert set(kept) == {1, 2} and 0 < len(kept) < every


def test_ignore_rules_any_number(spark, monkeypatch):
    from textloom.operators import paths

    def plan_and_rows(broadcast):
        monkeypatch.setattr(paths, "BROADCAST_RULES", broadcast)
        df = queries()["ignore_rules"](spark, SF)
        return df._jdf.queryExecution().optimizedPlan().toString(), sorted(map(tuple, df.collect()))

    (few, rows), (many, same) = plan_and_rows(50_000), plan_and_rows(1)
    assert "Join" not in few and "Join" in many
    assert rows == same and rows


@pytest.mark.parametrize("name", ["sort_path", "sortr_path"])
def test_ranks_over_many_ranges(spark, duck, tmp_path, name):
    docs = spark.range(30_000).selectExpr("id as doc_id", "'' as text", "concat('src', id % 7) as source", "if(id % 5 = 0, null, 'en') as lang")
    docs.repartition(6).write.parquet(f"{tmp_path}/documents.parquet")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sorted((r["rank"], r.path) for r in queries()[name](spark, str(tmp_path)).collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = sorted((r, p) for p, r in duck.execute(oracle_sql()[name].replace("FROM documents", f"FROM '{tmp_path}/documents.parquet/*.parquet'")).fetchall())
    assert got == want
