"""URL filters: fixed host and path rules first, else association rules that Spark's FP-growth mines from labels.

A URL's tokens are the labels of its host, the segments of its path without digits-only ones, and the names of its
query's fields, each with a letter that says which. From labelled URLs FP-growth mines combinations of tokens that
occur with the item "bad". Of tokens that occur in the same URLs one is mined. Pruned are rules below the bounds of
support, of lift over the share of bad URLs, and of certainty, by which chance alone explains the lift; and rules that
add tokens to another without a higher confidence. The rules left are an inverted index under their rarest token, in
buckets by a hash of it: a URL's tokens look up rules there, and a rule fires when all its tokens are among the URL's.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm._staging import stage

#: Fixed rules: verdict, host, path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
BAD = "=bad"
#: Rules up to this many are an index that each row asks in place; more are joined by token.
BROADCAST_RULES = 10_000
#: Buckets of the index.
BUCKETS = 1024


@dataclass(frozen=True)
class Mining:
    """Bounds for mined rules: least share and number of labelled URLs that a rule covers, least lift of its confidence
    over the share of bad URLs and deviations of chance above that share, least confidence, most tokens."""

    support: float = 0.002
    least: int = 20
    lift: float = 1.2
    deviations: float = 2.0
    confidence: float = 0.0
    tokens: int = 4


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and for what has no ``://``."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    rest = F.coalesce(F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url))), F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), upper, upper.lower()), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fixed_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Name (like ``net/``) and verdict of the longest rule that fits, null if none does: its host or a subdomain, and its path's start."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # later ones are longer and win
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, what).otherwise(verdict)
    return name, verdict


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """The distinct tokens of a URL; none for null."""
    kind = lambda letter, parts: F.transform(F.filter(parts, lambda x: (x != "") & ~x.rlike(r"^\d+(\.\w+)?$")), lambda x: F.concat(F.lit(letter), x))
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^?#]*\?([^#]*)", 1)
    fields = F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1))
    return F.array_distinct(F.concat(kind("h:", F.split(host, r"\.")), kind("p:", F.split(path, "/")), kind("q:", fields)))


def _mined_tokens(rows: DataFrame, least: int) -> DataFrame:
    """The baskets with those tokens only that occur in `least` of them, one for each set of tokens that occur in the same baskets.

    Tokens that always come together would otherwise double the itemsets with each of them. How many tokens are left
    is bounded by the tokens of a URL over the support, so they are broadcast.
    """
    each = rows.select("basket", "bad", F.explode("tokens").alias("token"))
    seen = each.groupBy("token").agg(F.count("*").alias("n"), F.sum(F.xxhash64("basket").bitwiseAND(F.lit((1 << 40) - 1)).cast("decimal(38,0)")).alias("sum")).filter(F.col("n") >= least)
    kept = seen.groupBy("n", "sum").agg(F.min("token").alias("token")).select("token")
    return each.join(F.broadcast(kept), "token").groupBy("basket").agg(F.first("bad").alias("bad"), F.collect_list("token").alias("tokens"))


def mine_rules(labelled: DataFrame, mining: Mining = Mining()) -> DataFrame:
    """(antecedent, confidence, rarest) from (tokens, bad): pruned rules, each with its rarest token.

    bad is true or false; rows with null tokens count as without any. An empty table, one of fewer than `least` rows,
    and one without bad rows give no rules. Repeated rows count as often as they occur; ties of rarity: the first token.
    """
    from pyspark.ml.fpm import FPGrowth

    spark = labelled.sparkSession
    rows = stage(labelled.select(F.monotonically_increasing_id().alias("basket"), "bad", F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens")), "baskets")
    n, bad = rows.agg(F.count("*"), F.coalesce(F.sum(F.col("bad").cast("long")), F.lit(0))).first()
    if n < mining.least or not bad:
        return spark.createDataFrame([], "antecedent array<string>, confidence double, rarest string")
    base, support = bad / n, max(mining.support, mining.least / n)
    # a rule is counted with "bad" among its items, so its bound of support is the least number of bad URLs that its lift allows
    confidence = max(mining.confidence, base * mining.lift)
    items = _mined_tokens(rows, max(1, int(support * n))).select(F.when(F.col("bad"), F.concat("tokens", F.array(F.lit(BAD)))).otherwise(F.col("tokens")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, support * confidence), minConfidence=min(1.0, confidence)).fit(items)
    freq = stage(model.freqItemsets.select(F.sort_array("items").alias("antecedent"), F.col("freq").alias("covers")), "itemsets")
    rules = model.associationRules.filter((F.col("consequent")[0] == BAD) & (F.size("antecedent") <= mining.tokens)).select(F.sort_array("antecedent").alias("antecedent"), "confidence")
    certain = F.col("confidence") >= base + mining.deviations * F.sqrt(F.lit(base * (1 - base)) / F.col("covers"))
    rules = stage(rules.join(freq, "antecedent").filter((F.col("covers") >= support * n - 1e-6) & certain).select("antecedent", "confidence"), "rules")
    # a rule meets the rules within it by its own subsets, of which there are fewer than 2 ** tokens
    subsets = F.transform(F.expr("sequence(1, shiftleft(1, size(antecedent)) - 2)"), lambda m: F.filter("antecedent", lambda _, i: F.call_function("shiftright", m, i).bitwiseAND(F.lit(1)) == 1))
    inner = rules.filter(F.size("antecedent") > 1).select("antecedent", "confidence", F.explode(subsets).alias("inner"))
    wider = inner.join(rules.select(F.col("antecedent").alias("inner"), F.col("confidence").alias("of_inner")), "inner").filter("of_inner >= confidence").select("antecedent").distinct()
    rules = rules.join(wider, "antecedent", "left_anti")
    counts = freq.filter(F.size("antecedent") == 1).select(F.col("antecedent")[0].alias("token"), F.col("covers").alias("freq"))
    each = rules.select("antecedent", "confidence", F.explode("antecedent").alias("token")).join(counts, "token")
    return stage(each.groupBy("antecedent").agg(F.max("confidence").alias("confidence"), F.min_by("token", F.struct("freq", "token")).alias("rarest")), "index")


def _fires(rules: DataFrame, tokens: Column) -> Column:
    """Whether a rule of a small index has all its tokens among these."""
    bucket = lambda t: F.pmod(F.xxhash64(t), F.lit(BUCKETS)).cast("int")
    found = {r["b"]: r["rules"] for r in rules.groupBy(bucket(F.col("rarest")).alias("b")).agg(F.collect_list(F.struct(F.col("rarest").alias("t"), F.col("antecedent").alias("a"))).alias("rules")).collect()}
    if not found:
        return F.lit(False)
    text = json.dumps([[{"t": r["t"], "a": list(r["a"])} for r in found.get(k, [])] for k in range(BUCKETS)])
    index = F.from_json(F.lit(text), "array<array<struct<t:string,a:array<string>>>>")  # a constant of the plan
    return F.exists(tokens, lambda t: F.exists(F.get(index, bucket(t)), lambda r: (r["t"] == t) & (F.size(F.array_except(r["a"], tokens)) == 0)))


def filter_urls(pages: DataFrame, labelled: DataFrame, id_column: str = "page_id", url_column: str = "url", mining: Mining = Mining()) -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row of pages; `labelled` has url and a boolean bad.

    rule names the fixed rule that decides, if any; else it is null and the verdict is the mined rules': "block" when
    one fires, "allow" otherwise. Null URLs and such without ``://`` have an empty host and path, no tokens, and are
    allowed. Without labels, or with null ones only, nothing is mined. Ties, repeated rows and null ids are rows like
    others; other columns aren't carried.
    """
    url = F.col("url")
    host, path = host_and_path(url)
    tokens = url_tokens(url, host, path)
    rules = mine_rules(labelled.select("url", "bad").filter("bad is not null and url is not null").select(tokens.alias("tokens"), "bad"), mining)
    rows = pages.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{url_column}`").alias("url"))
    rows = rows.select("id", host.alias("host"), path.alias("path"), tokens.alias("tokens"))
    if rules.count() <= BROADCAST_RULES:
        fired = rows.withColumn("fired", _fires(rules, F.col("tokens")))
    else:
        index = rules.select(F.col("rarest").alias("token"), "antecedent")
        each = rows.select("tokens").distinct().select("tokens", F.explode("tokens").alias("token"))
        hit = stage(each.join(index, "token").filter(F.size(F.array_except("antecedent", "tokens")) == 0).select("tokens").distinct().withColumn("fired", F.lit(True)), "fired")
        fired = rows.join(hit, "tokens", "left")
    name, verdict = fixed_rule(F.col("host"), F.col("path"))
    mined = F.when(F.col("fired"), "block").otherwise("allow")
    return fired.select(F.col("id").alias(id_column), "host", "path", name.alias("rule"), F.coalesce(verdict, mined).alias("verdict"))
