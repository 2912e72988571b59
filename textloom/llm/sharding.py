"""Sharding by bytes: a minimax contiguous partition over ordered atomic groups, in DataFrame and SQL functions only.

Rows with equal texts are one atomic group. Groups are ordered: those above half an even share first, from the largest
on, then the others by class of text size, large texts first, and by a hash of the text. A key of 63 bits says where
in this order a group is. The shards are runs of the ordered groups, cut so that the largest shard is as small as any
such cut allows.

The sizes of all groups needn't be in one place for that. Units are ranges of the order, at first 65,536 at most; over
their running totals, a table of bounded size, SQL functions binary-search the smallest capacity for which a greedy
pass, which fills a shard until the next unit would overflow it, needs no more shards than there are. Under that
capacity the cuts are evened out: each shard gets the smallest capacity that is feasible for what is left. Units at
which any of these passes, or that with a byte less, starts a shard are split into smaller ranges, and so on until
these are single groups. Then a finer split can't move a cut any more, so the capacity is the smallest over groups.

A row's shard follows from its key. Its slot in the shard is its rank in a part of the shard plus the sizes of the
parts before it; parts are chosen by a hash of the row, so a hot group's rows spread over many.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.llm._staging import stage

#: Bits of a key: of the class of a text's size, and of its hash. Bits of the first units, and of a split. Parts of a shard for slots.
CLASS_BITS, HASH_BITS, UNIT_BITS, SPLIT_BITS, PARTS = 5, 58, 16, 6, 256
ROW_BYTES = 16
#: A position in an array of running totals is found in this many halvings.
_HALVINGS = 24


def _key(size: Column, text: Column) -> Column:
    """Large texts first: class 0 has texts of 2**31 bytes and more."""
    level = F.least(F.floor(F.log2(size)), F.lit((1 << CLASS_BITS) - 1)).cast("long")
    return F.shiftleft(F.lit((1 << CLASS_BITS) - 1) - level, HASH_BITS).bitwiseOR(F.shiftrightunsigned(F.xxhash64(text), 64 - HASH_BITS))


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _reach(totals: Column, most: Column) -> Column:
    """How many of the units, whose running totals these are, lie within `most`."""

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"] + 1) / 2).cast("int")
        fits = F.get(totals, mid - 1) <= most
        return F.when(s["lo"] >= s["hi"], s).otherwise(F.struct(F.when(fits, mid).otherwise(s["lo"]).alias("lo"), F.when(fits, s["hi"]).otherwise(mid - 1).alias("hi")))

    start = F.struct(F.lit(0).cast("int").alias("lo"), F.size(totals).cast("int").alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(_HALVINGS)), start, halve)["lo"]


def _total(totals: Column, units: Column) -> Column:
    """The bytes of the first so many units."""
    return F.when(units > 0, F.get(totals, units - 1)).otherwise(F.lit(0).cast("long"))


def _starts(totals: Column, first: Column, capacity: Column, shards: Column) -> Column:
    """Where a greedy pass from the unit `first` on starts shards, `shards` of them at most, and where it stops after them."""
    step = lambda at, _: F.concat(at, F.array(_reach(totals, _total(totals, F.element_at(at, -1)) + capacity)))
    none = F.array(first.cast("int"))
    return F.aggregate(F.sequence(F.lit(1), shards), none, lambda at, k: F.when(F.element_at(at, -1) >= F.size(totals), at).otherwise(step(at, k)))


def minimax_capacity(totals: Column, first: Column, shards: Column) -> Column:
    """The smallest capacity with which a greedy pass over the units from `first` on needs no more than `shards` shards."""
    span = lambda lo, hi: F.struct(lo.cast("long").alias("lo"), hi.cast("long").alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = s["lo"] + F.floor((s["hi"] - s["lo"]) / 2).cast("long")
        enough = lambda m: F.element_at(_starts(totals, first, m, shards), -1) >= F.size(totals)
        return F.when(s["lo"] >= s["hi"], s).otherwise(_let(mid, lambda m: F.when(enough(m), span(s["lo"], m)).otherwise(span(m + 1, s["hi"]))))

    left = F.get(totals, F.size(totals) - 1) - _total(totals, first)
    return F.aggregate(F.sequence(F.lit(1), F.lit(63)), span(F.ceil(left / shards).cast("long"), left), halve)["hi"]


def _even_starts(totals: Column, shards: int) -> Column:
    """Where shards start when each has the smallest capacity that is feasible for the units that are left."""

    def step(at: Column, k: Column) -> Column:
        here = F.element_at(at, -1)
        capacity = minimax_capacity(totals, here, F.lit(shards) - k)
        return F.when(here >= F.size(totals), at).otherwise(F.concat(at, F.array(_let(capacity, lambda c: _reach(totals, _total(totals, here) + c)))))

    return F.aggregate(F.sequence(F.lit(0), F.lit(shards - 1)), F.array(F.lit(0).cast("int")), step)


def _ordered(units: DataFrame) -> DataFrame:
    """One row from (pos, lo, bits, bytes, groups): the units in order as arrays, with their running totals."""
    running = Window.orderBy("pos", "lo").rowsBetween(Window.unboundedPreceding, 0)  # of a table of bounded size
    rows = units.withColumn("total", F.sum("bytes").over(running)).agg(F.array_sort(F.collect_list(F.struct("pos", "lo", "bits", "several", "total"))).alias("units"))
    return stage(rows.select("units", F.col("units.total").alias("totals")), "units")


def _units(rows: DataFrame, bits: Column | int) -> DataFrame:
    """Units that are ranges of keys with equal leading bits: (pos, lo, bits, bytes, several)."""
    low = 63 - (F.lit(bits) if isinstance(bits, int) else bits)
    keyed = rows.select("key", "size", low.cast("int").alias("low")).select("key", "size", "low", F.expr("shiftleft(shiftright(key, low), low)").alias("lo"))
    return keyed.groupBy("lo", "low").agg(F.sum("size").alias("bytes"), (F.min("key") < F.max("key")).alias("several")).select(F.col("lo").alias("pos"), "lo", (63 - F.col("low")).alias("bits"), "bytes", "several")


def _cuts(rows: DataFrame, shards: int) -> tuple[list[int], list[tuple[int, int]]]:
    """From (key, size): the keys at which shards start, and the (key, shard) of the large groups, which come first."""
    units = stage(_units(rows, UNIT_BITS), "cells")
    total = units.agg(F.sum("bytes")).first()[0]
    if total is None:
        return [], []
    # a group above half an even share can only be in a unit above it, of which there are 2 * shards at most
    over = [r["lo"] for r in units.filter(F.col("bytes") * 2 * shards > total).select("lo").collect()]
    own = rows.filter(F.expr(f"shiftleft(shiftright(key, {63 - UNIT_BITS}), {63 - UNIT_BITS})").isin(over)) if over else rows.limit(0)
    large = stage(own.groupBy(F.col("key").alias("lo")).agg(F.sum("size").alias("bytes")).filter(F.col("bytes") * 2 * shards > total), "large")
    rest = rows.join(F.broadcast(large.select(F.col("lo").alias("key"))), "key", "left_anti")
    first = large.select((-F.col("bytes")).alias("pos"), "lo", F.lit(63).alias("bits"), "bytes", F.lit(False).alias("several"))
    units = stage(_units(rest, UNIT_BITS), "cells") if not large.isEmpty() else units
    while True:
        ordered = _ordered(first.unionByName(units))
        bounds = stage(ordered.select("*", minimax_capacity(F.col("totals"), F.lit(0), F.lit(shards)).alias("capacity"), _even_starts(F.col("totals"), shards).alias("even")), "capacity")
        at = F.array_union(F.array_union(*(_starts(F.col("totals"), F.lit(0), F.col("capacity") - less, F.lit(shards)) for less in (0, 1))), "even")
        coarse = bounds.select(F.explode(F.filter(F.transform(at, lambda i: F.get("units", i)), lambda u: u["several"])).alias("u")).select("u.lo", "u.bits").collect()
        if not coarse:
            break
        # what is in a coarse unit goes over to units of more leading bits
        held = reduce(Column.__or__, (F.col("key").between(r["lo"], r["lo"] + (1 << (63 - r["bits"])) - 1) for r in coarse))
        bits = reduce(lambda when, r: when.when(F.col("key").between(r["lo"], r["lo"] + (1 << (63 - r["bits"])) - 1), min(63, r["bits"] + SPLIT_BITS)), coarse, F.when(F.lit(False), 0))
        finer = _units(rest.filter(held), bits)
        same = reduce(Column.__or__, ((F.col("lo") == r["lo"]) & (F.col("bits") == r["bits"]) for r in coarse))
        units = stage(units.filter(~same).unionByName(finer), "cells")
    row = bounds.select(F.transform(F.filter("even", lambda i: i < F.size("units")), lambda i: F.get("units", i)).alias("starts")).first()
    starts = [(r["pos"], r["lo"]) for r in row["starts"]]
    groups = [((r["pos"], r["lo"]), r["lo"]) for r in first.collect()]
    return [lo for pos, lo in starts if pos >= 0], [(lo, sum(s <= place for s in starts) - 1) for place, lo in groups]


def shard_by_bytes(docs: DataFrame, shards: int = 40, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row for each row of docs: the id, size, text_crc32, law, shard, slot, grown_shard.

    size is the UTF-8 bytes of the text (null: none) plus 16; text_crc32 is of the text's UTF-8 bytes, 0 for null;
    law is "bytes": the sizes of shards are near equal, as far as groups allow. Rows of one text, null being empty,
    share a shard. Slots are gapless from 0 in each shard. grown_shard is null: this law says nothing of one more
    shard. Null, tied and repeated ids and repeated rows get slots of their own; of rows that are wholly alike either
    may get either slot. Other columns aren't carried. An empty table gives an empty result.
    """
    text = F.coalesce(F.col(f"`{text_column}`"), F.lit(""))
    size = (F.octet_length(text).cast("long") + ROW_BYTES).alias("size")
    rows = docs.select(F.col(f"`{id_column}`").alias("id"), size, F.crc32(text).cast("long").alias("crc"), text.alias("text"))
    rows = stage(rows.select("id", "size", "crc", _key(F.col("size"), F.col("text")).alias("key"), F.pmod(F.xxhash64("id", "crc", "size"), F.lit(PARTS)).cast("int").alias("part")), "sizes")

    starts, large = _cuts(rows.select("key", "size"), shards)
    # of the other groups, a shard is the number of starts at or before the key, after the shards of large groups alone
    begun = len({shard for _, shard in large}) - 1
    shard = F.size(F.filter(F.array(*map(F.lit, starts)), lambda k: k <= F.col("key"))) + begun if starts else F.lit(begun)
    shard = reduce(lambda out, kv: F.when(F.col("key") == kv[0], kv[1]).otherwise(out), large, shard)
    placed = rows.withColumn("shard", shard.cast("int"))

    parts = placed.groupBy("shard", "part").agg(F.count("*").alias("rows"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("shard", "part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("base"))
    rank = F.row_number().over(Window.partitionBy("shard", "part").orderBy("id", "crc", "size"))
    slotted = placed.withColumn("rank", rank).join(F.broadcast(parts), ["shard", "part"])
    return slotted.select(F.col("id").alias(id_column), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("rank") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
