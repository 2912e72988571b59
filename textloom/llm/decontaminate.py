"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

Words are runs of letters and digits, lower-cased. A seed hashes some words of a short window and ignores the
others, by a fixed mask, so a substituted word that falls on an ignored place changes nothing. Seeds at all places
of the documents join those of the test items. Around each hit the windows of WINDOW words that hold the seed are
compared word by word, aligned with the item. Places of a document that have the same words around them are compared
once, as are those of an item, so words repeated many times are little work; an item contaminates a document when a window of both agrees in at
least MATCHED words.

Any window of 13 words with up to 2 substitutions holds one of the masks on unchanged words, whichever words were
substituted (`misses` counts the exceptions: none), so no such window is missed. Items of fewer words are compared
whole and may differ in a fifth of their words, those of fewer than 5 in none. Their mask takes every q-th word, q
being one more than the substitutions allowed, from each of the first q places: the words of one such place must be
unchanged, as substitutions can't fall on all of them.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm._staging import fresh, stage

#: Words of a compared window, and how many of them must agree: 80 %.
WINDOW, MATCHED = 13, 11
#: Fixed masks for windows of 13 words: the places that count.
MASKS = ((0, 1, 2, 3, 4, 7), (0, 3, 5, 7, 8, 9))
#: The most seeds of items that are broadcast at once; more items are taken in blocks.
BLOCK_SEEDS = 1 << 18


def misses(masks: tuple[tuple[int, ...], ...] = MASKS, window: int = WINDOW, substitutions: int = WINDOW - MATCHED) -> int:
    """How many choices of substituted places leave no mask unchanged anywhere in the window."""
    placed = [frozenset(s + k for k in m) for m in masks for s in range(window - max(m))]
    return sum(not any(p.isdisjoint(c) for p in placed) for c in combinations(range(window), substitutions))


def _word_hashes(text: str) -> Column:
    """Hashes of the lower-cased runs of letters and digits."""
    words = F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def _seed(mask: tuple[int, ...]) -> Column:
    """The seed at place i of the word hashes w; null where the mask doesn't fit."""
    return F.when(F.col("i") + max(mask) < F.size("w"), F.xxhash64(*(F.get("w", F.col("i") + k) for k in mask)))


def _placed(rows: DataFrame, *keep: str) -> DataFrame:
    return rows.select(*keep, "w", F.posexplode_outer("w").alias("i", "word"))


def _items(benchmark: DataFrame, id_column: str, text_column: str) -> DataFrame:
    rows = benchmark.select(F.col(id_column).alias("item_id"), F.col(text_column).alias("text"))
    rows = rows.select(F.xxhash64("item_id", "text").alias("item"), "item_id", _word_hashes("text").alias("w")).dropDuplicates(["item"])
    spare = F.size("w") - F.ceil(F.size("w") * 0.8).cast("int")  # words of a short item that may differ
    short = F.size("w") < WINDOW
    step = F.when(short, spare + 1).otherwise(0)
    return rows.filter(F.size("w") > 0).withColumn("step", step).withColumn("count", F.when(short, F.floor(F.size("w") / (spare + 1)).cast("int")).otherwise(0))


#: Words on both sides of a place that windows around it may hold.
REACH = WINDOW - 1


def _around(place: str) -> Column:
    """The words within REACH of a place of the word hashes w, null beyond the text's ends; the place itself is entry REACH."""
    return F.transform(F.sequence(F.lit(-REACH), F.lit(REACH)), lambda r: F.get("w", F.col(place) + r))


def _item_seeds(items: DataFrame, mask: tuple[int, ...], step: int, count: int) -> DataFrame:
    """(seed, hits): hits are the items that have the seed, the words around it, and in how many places it has these.

    Of short items hits have the place too, and the whole item as words. Words repeated many times have few surroundings.
    """
    rows = _placed(items.filter((F.col("step") == step) & (F.col("count") == count)), "item")
    if step:
        rows = rows.filter(F.col("i") < step)
    rows = rows.select(_seed(mask).alias("seed"), "item", (F.col("i") if step else F.lit(0)).alias("j"), (F.col("w") if step else _around("i")).alias("iw")).filter("seed is not null")
    return rows.groupBy("seed", "item", "j", "iw").agg(F.count("*").alias("m")).groupBy("seed").agg(F.collect_list(F.struct("item", "j", "iw", "m")).alias("hits"))


def _windows(span: int) -> tuple[Column, Column]:
    """Which words agree around a hit, and the most that do in a window that holds it and lies in both texts."""
    back = WINDOW - span
    same = F.transform(F.sequence(F.lit(REACH - back), F.lit(2 * REACH)), lambda p: F.coalesce(F.get("w", p) == F.get("iw", p), F.lit(False)).cast("int"))
    best = [F.lit(0)]
    for a in range(back + 1):
        ends = [F.get(c, F.lit(p)).isNotNull() for c in ("w", "iw") for p in (REACH - a, REACH - a + WINDOW - 1)]
        best.append(F.when(reduce(Column.__and__, ends), F.aggregate(F.slice("same", back - a + 1, WINDOW), F.lit(0), lambda x, y: x + y)).otherwise(0))
    return same, F.greatest(*best)


def _whole() -> tuple[Column, Column]:
    """Which words agree when a short item is laid over the document at the hit, and how many; 0 where it doesn't fit."""
    first = REACH - F.col("j")
    same = F.transform(F.sequence(F.lit(0), F.size("iw") - 1), lambda r: F.coalesce(F.get("w", first + r) == F.get("iw", r), F.lit(False)).cast("int"))
    fits = F.get("w", first).isNotNull() & F.get("w", first + F.size("iw") - 1).isNotNull()
    return same, F.when(fits, F.aggregate("same", F.lit(0), lambda x, y: x + y)).otherwise(0)


def _of_family(k: int):
    return lambda hit: F.struct(F.lit(k).alias("k"), hit["item"].alias("item"), hit["j"].alias("j"), hit["iw"].alias("iw"), hit["m"].alias("m"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_id_column: str = "item_id", item_text_column: str = "text", row_key: bool = False) -> DataFrame:
    """(doc_id, item_id, matched_words, hits, first_word) for each document and item that contaminates it.

    matched_words are those that agree in the best window (of 13 words, or of the whole of a short item), hits the
    seeds whose windows qualify, first_word the least place in the document of one. Null and empty texts and items
    match nothing; items of fewer than 5 words match where all of them follow each other. Repeated items count once; documents that share an id, null included, give
    one row an item. With row_key, rows of different texts are kept apart by xxhash64(id, text) in a column row_key.
    Other columns aren't carried. Empty tables give an empty result.
    """
    docs = docs.select(F.col(id_column).alias("id"), F.xxhash64(id_column, text_column).alias("row_key"), _word_hashes(text_column).alias("w"))
    items = stage(_items(benchmark, item_id_column, item_text_column), "items")
    sizes = {(r["step"], r["count"]): r["words"] for r in items.groupBy("step", "count").agg(F.sum(F.size("w")).alias("words")).collect()}
    families = [(m, 0, 0) for m in MASKS if (0, 0) in sizes or not sizes] + [(tuple(range(0, q * n, q)), q, n) for q, n in sorted(sizes) if q]
    parts = max(1, -(-sum(n * (1 if q else len(MASKS)) for (q, _), n in sizes.items()) // BLOCK_SEEDS))
    scored = [_whole() if q else _windows(max(mask) + 1) for mask, q, _ in families]
    of = lambda values: reduce(lambda when, kv: when.when(F.col("k") == kv[0], kv[1]), enumerate(values[1:], 1), F.when(F.col("k") == 0, values[0]))

    def part_of(part: int) -> DataFrame:
        own = items.filter(F.pmod("item", F.lit(parts)) == part)
        # places that have a seed of an item, those of one document with the same words around them as one
        rows, some = _placed(docs, "id", "row_key"), []
        tables = [_item_seeds(own, *family).toDF(f"seed{k}", f"hits{k}") for k, family in enumerate(families)]
        for k, (mask, *_) in enumerate(families):
            rows = rows.withColumn(f"seed{k}", _seed(mask)).join(F.broadcast(tables[k].select(f"seed{k}", F.lit(True).alias(f"has{k}"))), f"seed{k}", "left")
            some.append(F.col(f"has{k}"))
        rows = rows.filter(F.coalesce(*some)).select("id", "row_key", *(F.when(h, F.col(f"seed{k}")).alias(f"seed{k}") for k, h in enumerate(some)), "i", _around("i").alias("around"))
        rows = rows.groupBy("id", "row_key", *(f"seed{k}" for k in range(len(families))), "around").agg(F.count("*").alias("n"), F.min("i").alias("i"))
        for k in range(len(families)):
            rows = rows.join(F.broadcast(tables[k]), f"seed{k}", "left")
        nothing = F.array().cast("array<struct<k:int,item:bigint,j:int,iw:array<bigint>,m:bigint>>")
        every = F.concat(*(F.coalesce(F.transform(F.col(f"hits{k}"), _of_family(k)), nothing) for k in range(len(families))))
        hits = rows.select("id", "row_key", F.col("around").alias("w"), "i", "n", F.explode(every).alias("hit")).select("id", "row_key", "w", "i", "n", "hit.*")
        hits = hits.join(F.broadcast(own.select("item", "item_id", F.size("w").alias("words"))), "item")
        hits = hits.withColumn("same", of([s for s, _ in scored])).withColumn("matched", of([m for _, m in scored]))
        enough = F.when(F.col("words") >= WINDOW, MATCHED).otherwise(F.ceil(F.col("words") * 0.8))
        return hits.filter(F.col("matched") >= enough).select("id", "row_key", "item_id", "matched", "i", (F.col("n") * F.col("m")).alias("n"))

    keys = [F.col("id").alias(id_column), *[F.col("row_key")] * row_key, F.col("item_id")]
    hits = reduce(DataFrame.unionByName, map(part_of, range(parts)))
    return hits.groupBy(*keys).agg(F.max("matched").alias("matched_words"), F.sum("n").alias("hits"), F.min("i").alias("first_word"))


def remove_leaks(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that no item contaminates."""
    leak = fresh(docs, "tl_leak")
    leaks = stage(find_leaks(docs, benchmark, id_column, text_column, row_key=True).select(F.col("row_key").alias(leak)).distinct(), "leaks")
    if leaks.count() <= BLOCK_SEEDS:
        leaks = F.broadcast(leaks)
    return docs.join(leaks, F.xxhash64(F.col(f"`{id_column}`"), F.col(f"`{text_column}`")) == F.col(leak), "left_anti")
