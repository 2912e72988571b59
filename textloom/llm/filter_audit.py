"""An audit of how filters interact: what each removes at each place of each order in which they can be applied.

The orders of the filters form a trie: from a node, one edge for each filter that isn't applied yet. The trie is walked
depth first. A node holds the documents that survive, persisted, and its children are filtered from it; as the
survivors depend on which filters were applied and not on their order, nodes of one set of filters are one state, worked
out once: 2^n states stand for the trie's nodes, and at most n + 1 of them are persisted at a time. Each edge's
removals are counted over the survivors it starts from, by part, pre-aggregated before the counts shuffle.

What filters need from the texts is worked out in one scan; survivors are rows of a few bytes.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm._staging import join_groups, stage, staging_path

#: White space between words: the bytes 0x20 and 0x09-0x0D.
_SPACE = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MOST_FILTERS = 7


def text_failures(text: Column) -> dict[str, Column]:
    """Conditions on one text (null: empty) that fail it. A: under 200 words; B: fewer than half of the words are
    distinct; C: more than 2 of 100 code points are A-Z; D: it holds one of ``#$%&*|``. Case counts. A text without
    words fails A alone."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, _SPACE), lambda w: w != "")
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * (F.length(text) - F.length(F.translate(text, UPPER, ""))) > 2 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def flag_failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, A, B, C, D, E, good, toxic) of each document, staged: which filters it fails, and its labels.

    E fails a text that equals that of any smaller doc_id, wherever it stands and whether or not it is removed. Null
    texts count as empty, null sources as the empty string. A null doc_id is smaller than none and has no label; equal
    ids don't fail each other. A document is good if any of its labels has quality 1, toxic if any has toxic 1.
    """
    text = F.coalesce("text", F.lit(""))
    fails = [c.alias(k) for k, c in text_failures(F.col("text")).items()]
    flags = stage(docs.select(F.coalesce("source", F.lit("")).alias("part"), F.col("doc_id").alias("id"), F.unhex(F.sha2(text, 256)).alias("digest"), *fails), "flags")
    groups = stage(flags.groupBy("digest").agg(F.count("*").alias("n"), F.min("id").alias("first")).filter("n > 1"), "copies")
    met = join_groups(flags, groups, "digest", "n", flags.count())
    marks = labels.groupBy(F.col("doc_id").alias("id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    marked = met.join(marks.filter("good or toxic"), "id", "left")
    yes = {c: F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")}
    return stage(marked.select("part", *"ABCD", F.coalesce(F.col("id") > F.col("first"), F.lit(False)).alias("E"), *yes.values()), "failures")


def _edges(flags: DataFrame, filters: str) -> DataFrame:
    """(part, state, filter, survivors, removed, good, toxic) for each state (a set of applied filters, in the order of
    `filters`) and each filter not in it: the documents that survive the state, and of these what the filter removes."""
    found: set[frozenset] = set()
    path = staging_path(flags.sparkSession, "edges")

    def visit(done: frozenset, survivors: DataFrame) -> None:
        left = [f for f in filters if f not in done]
        if not left or done in found:
            return
        survivors = survivors.persist(StorageLevel.MEMORY_AND_DISK)
        removed = [F.struct(F.lit(f).alias("filter"), F.count_if(f).alias("removed"), F.count_if(F.col(f) & F.col("good")).alias("good"), F.count_if(F.col(f) & F.col("toxic")).alias("toxic")) for f in left]
        counts = survivors.groupBy("part").agg(F.count("*").alias("survivors"), F.array(*removed).alias("edges"))
        found.add(done)
        counts.select("part", F.lit("".join(f for f in filters if f in done)).alias("state"), "survivors", F.inline("edges")).write.mode("append").parquet(path)
        for f in left:
            visit(done | {f}, survivors.filter(~F.col(f)))
        survivors.unpersist()

    visit(frozenset(), flags)
    return flags.sparkSession.read.schema("part string, state string, survivors long, filter string, removed long, good long, toxic long").parquet(path)


def audit_orders(flags: DataFrame, filters: str = "ABCDE") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): for each part
    and each order of the filters, a row for each step, with zeros where nothing is left.

    `flags` has a boolean column for each filter (one letter each), part, good and toxic, as `flag_failures` makes them.
    kept: documents left after the step; removed: those it removes; redundant: those that fail its filter and were
    removed before; unique_fails: those that fail no other filter; good_lost and toxic_lost: of the removed; shapley:
    what the filter removes, summed over all orders, at whatever step. An empty table has no part and gives no rows.
    """
    if not 1 <= len(filters) <= MOST_FILTERS or len(set(filters)) != len(filters):
        raise ValueError(f"one to {MOST_FILTERS} different filters, a letter each")
    spark, n = flags.sparkSession, len(filters)
    fails = [F.struct(F.lit(f).alias("filter"), F.count_if(f).alias("fails"), F.count_if(F.expr(" and ".join([f, *(f"not {g}" for g in filters if g != f)]))).alias("unique_fails")) for f in filters]
    whole = stage(flags.groupBy("part").agg(F.array(*fails).alias("fails")).select("part", F.inline("fails")), "fails")
    edges = _edges(flags, filters)

    # how many orders take a filter after just the filters of a state
    before = F.length("state")
    orders = F.element_at(F.array(*(F.lit(factorial(k) * factorial(n - 1 - k)) for k in range(n))), before + 1)
    counted = whole.join(edges, ["part", "filter"], "left")
    by_filter = counted.groupBy("part", "filter").agg(
        F.first("fails").alias("fails"), F.first("unique_fails").alias("unique_fails"), F.coalesce(F.sum(F.col("removed") * orders), F.lit(0)).alias("shapley"),
        F.map_from_entries(F.collect_list(F.when(F.col("state").isNotNull(), F.struct("state", F.struct("survivors", "removed", "good", "toxic"))))).alias("at"),
    )

    steps = [("".join(o), k + 1, f, "".join(g for g in filters if g in o[:k])) for o in permutations(filters) for k, f in enumerate(o)]
    places = spark.createDataFrame(steps, "filter_order string, step int, filter string, state string")
    got = lambda name: F.coalesce(F.col(f"met.{name}"), F.lit(0)).cast("long")
    rows = by_filter.join(F.broadcast(places), "filter").withColumn("met", F.try_element_at("at", F.col("state")))
    return rows.select(
        "part", "filter_order", "step", (got("survivors") - got("removed")).alias("kept"), got("removed").alias("removed"), (F.col("fails") - got("removed")).alias("redundant"),
        "unique_fails", got("good").alias("good_lost"), got("toxic").alias("toxic_lost"), "shapley",
    )


def oracle_sql() -> str:
    """The same in SQL, straight from the conditions: what is left of each part after each prefix of each order."""
    return r"""
        WITH t AS (
            SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
                   list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
                   min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first
            FROM documents),
        marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
        f AS (
            SELECT t.part, coalesce(m.good, false) AS good, coalesce(m.toxic, false) AS toxic,
                   {'A': len(words) < 200, 'B': 100 * len(list_distinct(words)) < 50 * len(words),
                    'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text),
                    'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(t.doc_id > first, false)} AS c
            FROM t LEFT JOIN marks m ON t.doc_id = m.doc_id),
        g AS (SELECT part, good, toxic, concat(CASE WHEN c.A THEN 'A' ELSE '' END, CASE WHEN c.B THEN 'B' ELSE '' END, CASE WHEN c.C THEN 'C' ELSE '' END,
                     CASE WHEN c.D THEN 'D' ELSE '' END, CASE WHEN c.E THEN 'E' ELSE '' END) AS fails FROM f),
        n AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (toxic) AS n_toxic FROM g GROUP BY ALL),
        letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
        orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS o FROM letters a, letters b, letters c, letters d, letters e
                   WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
        steps AS (SELECT o, k, o[k] AS x, o[1 : k - 1] AS earlier FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS k)),
        r AS (SELECT part, o AS filter_order, k::int AS step, x,
                     coalesce(sum(n) FILTER (NOT regexp_matches(fails, '[' || earlier || x || ']')), 0) AS kept,
                     coalesce(sum(n) FILTER (contains(fails, x) AND translate(fails, earlier, '') = fails), 0) AS removed,
                     coalesce(sum(n) FILTER (contains(fails, x) AND translate(fails, earlier, '') <> fails), 0) AS redundant,
                     coalesce(sum(n) FILTER (fails = x), 0) AS unique_fails,
                     coalesce(sum(n_good) FILTER (contains(fails, x) AND translate(fails, earlier, '') = fails), 0) AS good_lost,
                     coalesce(sum(n_toxic) FILTER (contains(fails, x) AND translate(fails, earlier, '') = fails), 0) AS toxic_lost
              FROM n, steps GROUP BY ALL)
        SELECT part, filter_order, step, kept::bigint AS kept, removed::bigint AS removed, redundant::bigint AS redundant, unique_fails::bigint AS unique_fails,
               good_lost::bigint AS good_lost, toxic_lost::bigint AS toxic_lost, (sum(removed) OVER (PARTITION BY part, x))::bigint AS shapley
        FROM r"""
