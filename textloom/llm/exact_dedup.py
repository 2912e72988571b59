"""Exact dedup in two passes over a Bloom filter of text hashes.

The first pass sets, for each row's 64-bit hash, positions in a filter that tells "hit" from "hit more than once".
The second pass looks each row up: a row whose positions weren't all hit twice has no equal, keeps its place and
passes straight through. Only the others shuffle, by the SHA-256 of their text, which decides.

The filter has 16 bits a row up to 32 MiB; of more rows than that makes, it has 16 bits for each hash that filters of
parts of the hash space found possibly repeated, so what shuffles stays in proportion to what repeats. Sizes of groups
are pre-aggregated before they shuffle, and rows meet large groups by broadcast, so no task gets a hot group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm._bloom import flagged, repeated
from textloom.llm._staging import ascii_lower, fresh, join_groups, stage


def mark_duplicates(df: DataFrame, order_column: str = "doc_id", text_column: str = "text", keep: list[str] | None = None, normalise=ascii_lower) -> DataFrame:
    """The rows (columns `keep`, by default all) with keep_id, group_size, kept and text_sha256.

    Texts are equal when their normalised forms are: by default A-Z lower-cased and nothing else, null as empty.
    Of equal texts the row with the largest order value stays, nulls being less than all values; of rows that tie
    for it, exactly one. keep_id is that row's order value, null if all are null. Names of the four columns that `keep`
    has already get underscores appended. An empty table gives an empty result.
    """
    text: Column = normalise(F.col(f"`{text_column}`"))
    keep = df.columns if keep is None else keep
    carried = df.select(*(f"`{c}`" for c in keep))
    keep_id, group_size, kept, sha = (fresh(carried, n) for n in ("keep_id", "group_size", "kept", "text_sha256"))
    h, maybe, row, order, top = (fresh(df, n) for n in ("tl_hash", "tl_maybe", "tl_row", "tl_order", "tl_top"))
    rows = df.count()
    bitmap = df.sparkSession.sparkContext.broadcast(repeated(df.select(F.xxhash64(text).alias(h)), rows))

    probed = flagged(df.withColumn(h, F.xxhash64(text)), h, maybe, bitmap)
    full = [F.col(f"`{c}`") for c in keep] + [F.col(f"`{order_column}`").alias(order), F.sha2(text, 256).alias(sha)]
    alone = probed.filter(~F.col(maybe)).select(*full)
    others = stage(probed.filter(F.col(maybe)).select(*full, F.monotonically_increasing_id().alias(row)), "repeated")

    # nulls are least; of rows with one order value, the one that was written first stays
    best = F.max(F.struct(F.col(order).isNotNull().alias("has"), F.col(order).alias("v"), (-F.col(row)).alias("r"))).alias(top)
    groups = others.groupBy(sha).agg(F.count("*").alias(group_size), best).filter(F.col(group_size) > 1)
    groups = stage(groups.select(sha, group_size, F.col(f"{top}.v").alias(keep_id), (-F.col(f"{top}.r")).alias(top)), "groups")
    met = join_groups(others, groups, sha, group_size, rows)

    names = [F.col(f"`{c}`") for c in keep]
    in_group = met.select(*names, F.when(F.col(group_size).isNull(), F.col(order)).otherwise(F.col(keep_id)).alias(keep_id), F.coalesce(group_size, F.lit(1)).cast("long").alias(group_size), (F.col(top).isNull() | (F.col(top) == F.col(row))).alias(kept), F.col(sha))
    return in_group.unionByName(alone.select(*names, F.col(order).alias(keep_id), F.lit(1).cast("long").alias(group_size), F.lit(True).alias(kept), F.col(sha)))
