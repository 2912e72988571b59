"""N-gram Jaccard join: documents whose sets of word n-grams are similar, by a grouped prefix join.

Method. A document's set is the distinct hashes of its runs of `width` words. Documents with one and the same
set are one class. Two classes can only be similar if each owns few n-grams that no other class has, so:

1. Over a quarter of the hash space, n-grams that a single class owns are counted; a class that owns more of
   them than the threshold lets differ has no partner and is left out. This is exact, not an estimate.
2. For the other classes, n-grams are ordered from rare to common; a class's prefix is as many of its rarest as
   must hold one n-gram of any partner. Classes with identical prefix and size are one group.
3. Groups that share a prefix n-gram are candidates. First each group meets only its neighbour in an n-gram's
   list, which is enough to link most of a large set of near copies; the members are expanded and verified, and
   components built. Then all pairs of different components that share a prefix n-gram are expanded and
   verified. Pairs within one component need no verification, so a set of near copies isn't squared, and no
   link between components is lost. Pairs are listed for n-grams of up to LIST classes, which bounds their number
   by the input's. Classes that share n-grams of more are gathered in clusters, whose blocks are compared with one
   another as matrices; of these only links that join components come out.

Shuffles move n-gram hashes of a quarter of the space once, and of the left-over classes once; text never moves.

No task gets a hot key. N-grams that are frequent in a bounded sample of classes are dealt into parts; lists of a
common prefix n-gram are cut into parts whose ends are linked; blocks meet in a grid; and rows of hot classes and
components meet what is known of them by broadcast. The sample changes no result, only where rows go.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm._arrays import lean, mix, shingle_sets
from textloom.llm._bloom import build, filter_bits, flagged, maybe
from textloom.llm._graph import components, merged
from textloom.llm._staging import fresh, join_groups, small, stage

#: The most classes of an n-gram for which pairs are listed; classes and n-grams of a block of a cluster.
LIST, BLOCK_CLASSES, BLOCK_GRAMS = 64, 256, 1 << 18
#: Texts that are sampled for frequent n-grams, in expectation; the share of them that makes one frequent; parts of its rows.
SAMPLE_TEXTS, FREQUENT, PARTS = 10_000, 500, 64
#: The most rows of a list of neighbours before it is cut into parts; blocks on a side of a grid's cell.
NEIGHBOURS, GRID = 50_000, 8

_SAMPLE = np.uint64(3)  # hashes whose two lowest bits are 0: a quarter


def _class_id(s: np.ndarray) -> int:
    """64 bits that stand for a set: sums over its members, mixed with its size."""
    with np.errstate(over="ignore"):
        a, b = mix(s ^ np.uint64(0x243F6A8885A308D3)).sum(dtype=np.uint64), (mix(s) | np.uint64(1)).prod(dtype=np.uint64)
        return int(mix(np.array([a ^ mix(np.array([b + np.uint64(len(s))], np.uint64))[0]], np.uint64)).view(np.int64)[0])


def _group_id(n: int, prefix: np.ndarray) -> int:
    """64 bits that stand for a size and a sequence of prefix n-grams."""
    with np.errstate(over="ignore"):
        spread = mix(prefix.view(np.uint64) + np.arange(1, len(prefix) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        return int(mix(np.array([spread.sum(dtype=np.uint64) + np.uint64(n)], np.uint64)).view(np.int64)[0])


def _sets(b: pa.RecordBatch, column: str, width: int) -> Iterator[np.ndarray]:
    return shingle_sets(b.column(b.schema.get_field_index(column)).fill_null(""), width)


def _features(docs: DataFrame, width: int) -> DataFrame:
    """For each row: id, class, size of the set and a hash of the raw text."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cid, n = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            for i, s in enumerate(_sets(b, "text", width)):
                cid[i], n[i] = _class_id(s), len(s)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cid), pa.array(n), b.column(2)], ["id", "cid", "n", "th"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "text", F.xxhash64("text").alias("th")).mapInArrow(lean(f), f"id {kind}, cid bigint, n bigint, th bigint")


def _members(docs: DataFrame, width: int, part: str, wanted=None, frequent: frozenset[int] = frozenset()) -> DataFrame:
    """(h, cid, n, salt) for the n-grams of each class, once a task.

    part: "quarter" has a quarter of the n-grams, of h and cid only; "all" has those of the classes that `wanted`, a
    filter of text hashes, may hold. salt deals the classes of frequent n-grams into parts, from 1 on; it is 0 for others.
    """
    quarter = part == "quarter"

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        often = np.array(sorted(frequent), np.int64)
        for b in batches:
            if wanted is not None:
                b = b.filter(pa.array(maybe(wanted.value, b.column(1).to_numpy(zero_copy_only=False))))
            hs, cids, ns, held = [], [], [], 0
            for s in _sets(b, "text", width):
                if not len(s) or (cid := _class_id(s)) in done:
                    continue
                done.add(cid)
                own = s[(s & _SAMPLE) == 0] if quarter else s
                hs.append(own)
                cids.append(np.full(len(own), cid, np.int64))
                ns.append(np.full(len(own), len(s), np.int32))
                held += len(own)
                if held > 200_000:
                    yield out(hs, cids, ns, often)
                    hs, cids, ns, held = [], [], [], 0
            if held:
                yield out(hs, cids, ns, often)

    def out(hs, cids, ns, often: np.ndarray) -> pa.RecordBatch:
        h, cid = np.concatenate(hs).view(np.int64), np.concatenate(cids)
        if quarter:
            return pa.RecordBatch.from_pydict({"h": h, "cid": cid})
        salt = np.where(np.isin(h, often), 1 + cid % PARTS, 0) if len(often) else np.zeros(len(h), np.int64)
        return pa.RecordBatch.from_pydict({"h": h, "cid": cid, "n": np.concatenate(ns), "salt": salt.astype(np.int32)})

    return docs.select("text", F.xxhash64("text").alias("th")).mapInArrow(lean(f), "h bigint, cid bigint" + ("" if quarter else ", n int, salt int"))


def _frequent(docs: DataFrame, width: int, rows: int, wanted) -> frozenset[int]:
    """N-grams that many classes of a bounded sample hold; at most FREQUENT for each n-gram of a text."""
    some = docs.select("text").filter(F.pmod(F.xxhash64(F.lit(7), "text"), F.lit(1 << 20)) < max(1, (SAMPLE_TEXTS << 20) // max(1, rows)))
    grams = _members(some, width, "all", wanted).select("h", "cid").distinct()
    least = max(2 * PARTS, SAMPLE_TEXTS // FREQUENT)
    return frozenset(r["h"] for r in grams.groupBy("h").count().filter(F.col("count") > least).select("h").toLocalIterator())


def _prefixes(listed: DataFrame, percent: int) -> DataFrame:
    """(cid, n, toks, prefix, gid, first) from each class's shared n-grams with their frequencies.

    toks are the shared n-grams; a class's other n-grams are its own and rarer than all of these. prefix are the
    shared n-grams in its prefix, and first is the position of their first in the class's order.
    """

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = []
            for cid, n, pairs in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                own = pairs.values
                df, h = own.field(0).to_numpy(), own.field(1).to_numpy().view(np.uint64)
                lone, length = n - len(h), n * (100 - percent) // 100 + 1
                if length <= lone:
                    continue
                pre = h[np.lexsort((h, df))[: length - lone]].view(np.int64)
                gid = cid if lone else _group_id(n, pre)
                got.append((cid, n, np.sort(h).astype("<u8").tobytes(), pre.tolist(), gid, lone))
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got, strict=True), (pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.int64(), pa.int32()), strict=True)], ["cid", "n", "toks", "prefix", "gid", "first"])

    return listed.mapInArrow(lean(f), "cid bigint, n int, toks binary, prefix array<bigint>, gid bigint, first int")


def _verified(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Those of the distinct class pairs (a, b) whose sets are similar, by exact intersection of the shared n-grams."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, c, na, nb, ta, tb = (b.column(i).to_pylist() for i in range(6))
            good = []
            for i in range(len(a)):
                both = np.concatenate((np.frombuffer(ta[i], "<u8"), np.frombuffer(tb[i], "<u8")))
                both.sort()
                same = int((both[1:] == both[:-1]).sum())
                good.append(100 * same >= percent * (na[i] + nb[i] - same))
            keep = np.flatnonzero(good)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep)), b.column(1).take(pa.array(keep))], ["a", "b"])

    sets = lambda k: classes.select(F.col("cid").alias(k), F.col("n").alias(f"n{k}"), F.col("toks").alias(f"t{k}"))
    return stage(pairs.join(sets("a"), "a").join(sets("b"), "b").select("a", "b", "na", "nb", "ta", "tb").mapInArrow(lean(f), "a bigint, b bigint"), "links")


def _matrix_links(x: pa.StructArray, y: pa.StructArray, percent: int) -> list[tuple[int, int]]:
    """Links between the classes of two blocks, only such as join components that aren't joined yet."""
    part = lambda v: (v.field(0).to_numpy(), v.field(1).to_numpy(), v.field(2).to_numpy(), [np.frombuffer(t, "<u8") for t in v.field(3).to_pylist()])
    (cx, px, nx, tx), (cy, py, ny, ty) = part(x), part(y)
    common = np.intersect1d(np.concatenate(tx), np.concatenate(ty))
    same = np.zeros((len(cx), len(cy)), np.float32)
    for k in range(0, len(common), 4096):
        piece = common[k : k + 4096]
        same += _incidence(tx, piece) @ _incidence(ty, piece).T
    similar = 100 * same >= percent * (nx[:, None] + ny[None, :] - same) - 1e-3
    up: dict[int, int] = {}

    def find(c: int) -> int:
        while up.get(c, c) != c:
            c = up[c]
        return c

    out = []
    for i, j in zip(*np.nonzero(similar & (px[:, None] != py[None, :])), strict=True):
        a, b = find(int(px[i])), find(int(py[j]))
        if a != b:
            up[a] = b
            out.append((int(cx[i]), int(cy[j])))
    return out


def _incidence(sets: list[np.ndarray], grams: np.ndarray) -> np.ndarray:
    out = np.zeros((len(sets), len(grams)), np.float32)
    for row, s in zip(out, sets, strict=True):
        s = s[(s >= grams[0]) & (s <= grams[-1])]
        at = np.searchsorted(grams, s)
        row[at[grams[at] == s]] = 1
    return out


def _block_links(members: DataFrame, percent: int) -> DataFrame:
    """(a, b): links that join all components of (cluster, cid, comp, n, toks) that links between its classes join.

    A cluster is cut by size of set, as only sets of near sizes can be similar, and by hash into blocks of bounded
    size; each block meets the blocks of its own size and the next. A row holds a block, not a pair of classes.
    """
    members = members.withColumn("size", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / percent if percent < 100 else 2.0))).cast("int"))
    sizes = stage(members.groupBy("cluster", "size").agg(F.expr(f"cast(ceil(greatest(count(*) / {BLOCK_CLASSES}, sum(n) / {BLOCK_GRAMS})) as int)").alias("blocks")), "sizes")
    blocks = members.join(small(sizes), ["cluster", "size"]).withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")))
    blocks = stage(blocks.groupBy("cluster", "size", "block").agg(F.first("blocks").alias("blocks"), F.collect_list(F.struct("cid", "comp", "n", "toks")).alias("rows")), "blocks")
    # two sizes meet in a grid: a cell has up to GRID blocks of either; a block goes to all cells of its row or column
    other = lambda step, name: sizes.select("cluster", (F.col("size") - step).alias("size"), F.col("blocks").alias(name))
    around = blocks.join(small(other(1, "above")), ["cluster", "size"], "left").join(small(other(-1, "below")), ["cluster", "size"], "left")
    cells, place = lambda n: F.ceil(n / GRID).cast("int"), F.floor(F.col("block") / GRID).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), cells(F.col(n)) - 1))
    left = [around.filter(f"{n} is not null").select("cluster", "size", F.lit(step).alias("step"), place.alias("x"), every(n).alias("y"), "block", "rows") for step, n in ((0, "blocks"), (1, "above"))]
    right = [around.filter(f"{n} is not null").select("cluster", (F.col("size") - step).alias("size"), F.lit(step).alias("step"), every(n).alias("x"), place.alias("y"), F.col("block").alias("block2"), F.col("rows").alias("rows2")) for step, n in ((0, "blocks"), (1, "below"))]
    met = left[0].unionByName(left[1]).join(right[0].unionByName(right[1]), ["cluster", "size", "step", "x", "y"]).filter("step = 1 or block <= block2").select("rows", "rows2")

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x, y in zip(b.column(0), b.column(1), strict=True):
                x, y = x.values, y.values
                links = _matrix_links(x, y, percent)
                if links:
                    yield pa.RecordBatch.from_pydict({"a": [a for a, _ in links], "b": [c for _, c in links]})

    return stage(met.mapInArrow(lean(f), "a bigint, b bigint"), "links")


def _possible(n1: str, n2: str, p1: str, p2: str, percent: int) -> Column:
    """Whether sizes, and positions of a shared n-gram, leave enough n-grams for the threshold."""
    most = f"(least({p1}, {p2}) + least({n1} - {p1}, {n2} - {p2}))"
    return F.expr(f"100L * least({n1}, {n2}) >= {percent}L * greatest({n1}, {n2}) and {100 + percent}L * {most} >= {percent}L * ({n1} + {n2})")


def ngram_links(docs: DataFrame, id_column: str, text_column: str, width: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """(members, labels): members (id, cid, n) has a row for each row of docs, labels (node, comp) a component for each linked class.

    Two texts link when 100 * |intersection| >= percent * |union| of their sets. Words are runs of anything but
    ASCII white space, A-Z lower-cased. Null and empty texts, and texts without words, have an empty set (n = 0)
    and link with nothing. Rows with equal sets are one class; repeated rows and null ids are members like others.
    """
    if not 0 < percent <= 100 or width < 1:
        raise ValueError("percent must be in 1..100 and width at least 1")
    docs = docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").alias("text"))
    members = stage(_features(docs, width), "members")
    owned = _members(docs, width, "quarter").groupBy("h").agg(F.min("cid").alias("cid"), F.max("cid").alias("other")).filter("cid = other").groupBy("cid").agg(F.count("*").alias("owned"))
    per_class = members.filter("n > 0").groupBy("cid").agg(F.max("n").alias("n"), F.min("th").alias("th"))
    open_classes = stage(per_class.join(owned, "cid", "left").filter(f"coalesce(owned, 0) <= floor(n * {100 - percent} / 100)").select("th"), "open")
    wanted = docs.sparkSession.sparkContext.broadcast(build(open_classes, filter_bits(open_classes.count()), 1))
    often = _frequent(docs, width, members.count(), wanted)
    grams = _members(docs, width, "all", wanted, often).repartition("h", "salt").dropDuplicates(["h", "salt", "cid"])
    # any order of n-grams serves that is the same for all classes: frequent ones come last, without being counted
    df = F.when(F.col("salt") > 0, F.lit(1 << 40)).otherwise(F.count("*").over(Window.partitionBy("h", "salt")))
    shared = grams.withColumn("df", df).filter("df > 1")
    listed = shared.groupBy("cid").agg(F.max("n").alias("n"), F.collect_list(F.struct("df", "h")).alias("own"))
    classes = stage(_prefixes(listed, percent), "classes")
    groups = classes.groupBy("gid").agg(F.min("n").alias("n"), F.min("first").alias("first"), F.min(F.struct("cid", "prefix")).alias("one"))
    postings = stage(groups.select("gid", "n", "first", F.posexplode("one.prefix").alias("at", "h")).select("h", "gid", "n", (F.col("first") + F.col("at")).alias("at")), "postings")

    one = small(stage(groups.select("gid", F.col("one.cid").alias("cid")), "groups"))
    near = _neighbours(postings).filter(_possible("n0", "n", "at0", "at", percent)).select("gid0", "gid").distinct()
    near = near.join(one.toDF("gid0", "a"), "gid0").join(one.toDF("gid", "b"), "gid").select("a", "b")
    inside = classes.select(F.lag("cid").over(Window.partitionBy("gid").orderBy("cid")).alias("a"), F.col("cid").alias("b")).filter("a is not null")
    first = _verified(near.unionByName(inside), classes, percent)
    labels = components(first)

    placed = stage(classes.select("gid", "cid").join(small(labels).withColumnRenamed("node", "cid"), "cid", "left"), "placed")
    expanded = stage(postings.join(small(placed), "gid").select("h", "cid", F.coalesce("comp", "cid").alias("comp"), "n", "at"), "expanded")
    lists = expanded.groupBy("h").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("classes"), F.min("cid").alias("lead")).filter("x < y").select("h", "classes", "lead")
    mixed = stage(join_groups(expanded, stage(lists, "lists"), "h", "classes", expanded.count()).filter("classes is not null"), "mixed")
    left = mixed.filter(F.col("classes") <= LIST).drop("classes", "lead")
    right = left.select("h", *(F.col(c).alias(f"{c}0") for c in ("cid", "comp", "n", "at")))
    across = left.join(right, "h").filter("comp0 < comp").filter(_possible("n0", "n", "at0", "at", percent)).select(F.col("cid0").alias("a"), F.col("cid").alias("b")).distinct()
    second = _verified(across, classes, percent)
    long = mixed.filter(F.col("classes") > LIST)
    clusters = components(long.select("lead", "cid"))
    third = _block_links(long.select("cid", "comp").distinct().join(small(clusters).toDF("cid", "cluster"), "cid").join(classes.select("cid", "n", "toks"), "cid"), percent)
    more = second.unionByName(third)
    return members, merged(labels, more) if not more.isEmpty() else labels


def _neighbours(postings: DataFrame) -> DataFrame:
    """(gid0, n0, at0, gid, n, at): groups that follow each other in an n-gram's list by size; long lists are cut into parts, whose first rows follow each other too."""
    total = postings.count()
    most = min(NEIGHBOURS, max(LIST, total // 512))
    long = stage(postings.groupBy("h").agg(F.count("*").alias("rows")).filter(F.col("rows") > most), "long")
    dealt = join_groups(postings, long, "h", "rows", total)
    dealt = dealt.withColumn("part", F.when(F.col("rows").isNull(), 0).otherwise(F.pmod(F.xxhash64("gid"), F.ceil(F.col("rows") / most))).cast("int"))

    def follow(rows: DataFrame, *key: str) -> DataFrame:
        order = Window.partitionBy(*key).orderBy("n", "gid")
        return rows.select("gid", "n", "at", *(F.lag(c).over(order).alias(f"{c}0") for c in ("gid", "n", "at"))).filter("gid0 is not null")

    heads = dealt.filter("rows is not null").groupBy("h", "part").agg(F.min(F.struct("n", "gid", "at")).alias("head")).select("h", "head.*")
    return follow(dealt, "h", "part").unionByName(follow(heads, "h"))


def _in_classes(members: DataFrame, labels: DataFrame, best: Column) -> DataFrame:
    """(cid, class_rows, comp_rows, best) for the classes with words: sizes of class and component in rows, and the least `best` of the component's rows.

    Rows are added up by class before components are, so a hot class or component is a few rows wherever it meets others.
    """
    own = stage(members.filter("n > 0").groupBy("cid").agg(F.count("*").alias("class_rows"), F.min(best).alias("low")), "own")
    own = stage(own.join(small(labels).withColumnRenamed("node", "cid"), "cid", "left").withColumn("comp", F.coalesce("comp", "cid")), "labelled")
    comps = stage(own.groupBy("comp").agg(F.count("*").alias("of_classes"), F.sum("class_rows").alias("comp_rows"), F.min("low").alias("best")), "comps")
    return stage(join_groups(own, comps, "comp", "of_classes", own.count()).select("cid", "class_rows", "comp_rows", "best"), "known")


def ngram_components(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """A row for each row of docs: the id, n_shingles and component_id, the least id reachable by links, its own included.

    Ties, repeated rows and repeated ids are kept as rows; a null id stays null and never is a least id unless its
    whole component has none; an empty table gives an empty result. Other columns aren't carried.
    """
    members, labels = ngram_links(docs, id_column, text_column, width, percent)
    known = _in_classes(members, labels, F.col("id")).select("cid", "class_rows", F.col("best").alias("low"))
    met = join_groups(members, known, "cid", "class_rows", members.count())
    return met.select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("low", "id")).otherwise(F.col("id")).alias("component_id"))


def drop_near_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, with all their columns, without those that have a near copy of a lesser id in their component.

    Of each component of linked texts one row stays: that with the least id, nulls last; of rows that tie, any one.
    Texts without words link with nothing, so all rows that have none stay.
    """
    members, labels = ngram_links(docs, id_column, text_column, width, percent)
    key, maybe_gone, stays, rows = (fresh(docs, n) for n in ("tl_key", "tl_maybe", "tl_stays", "tl_rows"))
    known = _in_classes(members, labels, F.struct(F.col("id").isNull(), F.col("id"), "th"))
    several = stage(known.filter("comp_rows > 1").select("cid", "class_rows", F.col("best.id").alias("stay_id"), F.col("best.th").alias("stay_th")), "several")
    # what goes is told by id and text hash; the row that stays is kept from going, and of its repetitions one stays
    going = join_groups(members, several, "cid", "class_rows", members.count()).filter("class_rows is not null")
    same = F.col("id").eqNullSafe(F.col("stay_id")) & (F.col("th") == F.col("stay_th"))
    marked = stage(going.select(F.xxhash64("id", "th").alias(key), same.alias(stays)).groupBy(key).agg(F.max(stays).alias(stays), F.count("*").alias(rows)), "going")
    gone = stage(marked.filter(~F.col(stays) | (F.col(rows) > 1)).select(key), "gone")
    wanted = docs.sparkSession.sparkContext.broadcast(build(gone, filter_bits(gone.count()), 1))
    own = [F.col(f"`{c}`") for c in docs.columns]
    keyed = flagged(docs.withColumn(key, F.xxhash64(F.col(f"`{id_column}`"), F.xxhash64(F.col(f"`{text_column}`")))), key, maybe_gone, wanted)
    sure = keyed.filter(~F.col(maybe_gone)).select(*own)
    asked = join_groups(keyed.filter(F.col(maybe_gone)), marked, key, rows, members.count())
    left = asked.filter(F.col(stays).isNull() | (F.col(stays) & (F.col(rows) == 1))).select(*own)
    repeated = asked.filter(F.col(stays) & (F.col(rows) > 1)).dropDuplicates([key]).select(*own)
    return sure.unionByName(left).unionByName(repeated)
