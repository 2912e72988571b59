"""Collocations: phrases of up to a few words whose words come together more often than their parts do apart.

Phrases are counted by naming pairs, level by level. Texts are packed into blocks, each a sequence of numbers with the
table of what they stand for. Level 1 counts the distinct words of each block; frequent words get gapless ids, which are
joined back to the blocks once. From then on each level counts the distinct pairs of adjacent phrases of each block. A
pair is written as the ids of its words, which says exactly what it is, so no later name is joined back to the blocks. A
phrase that is frequent has frequent parts, so nothing frequent is lost where a part is not. A name is thus a row
(left, right, id, n): left and right name the phrase without its last and without its first word, and by them each
phrase finds the counts of the parts of its cuts, and the phrases that contain it.

Blocks are dealt in the order of their languages to a number of tasks that doesn't grow with the input, so that a
language meets in few of them, and a task adds up its phrases and hashes, as many as it may hold, before it sends them.
What shuffles are thus distinct pairs to be counted, which are many, mostly of a few parts and sent when a task holds
2^20, then rows of longer phrases, at most one a task for each unless a task finds more than it may hold, and hashes of
those, to be counted before. Only pairs go on whose two parts, and later whose hash, may be
frequent by Bloom filters of bounded size, which are asked anew at each level. Filters and hashes only save rows:
phrases are counted by what they are. Blocks have some 2^21 words and are handed on in parts of some 2^18, so that no
process holds more than that at a time; only a piece (words between marks), which may be longer, is never cut.
As tasks have added up, Spark doesn't do so again before the shuffle, where its tables took an executor's memory.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm._arrays import lean, mix
from textloom.llm._bloom import build, filter_bits, maybe
from textloom.llm._staging import small, stage

#: Words of a block, bytes of text worked on at a time, and words of all blocks begun (one a language) before they are written.
BLOCK_WORDS, SLICE, OPEN_WORDS = 1 << 21, 1 << 20, 1 << 22
#: Words of a part of a block, once its words have ids, and parts that are read and sent to Python at a time.
PART, BATCH = 1 << 18, 4
#: Parquet looks at the size of its pages and row groups after each row, not after 100, as a row has up to some megabytes.
_LARGE = {"parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1", "parquet.block.size.row.check.min": "1"}
#: Tasks that blocks are dealt to (or twice the cores, if that is more), the fewest words of one, and rows that a task holds before it adds them up (of pairs twice as many).
TASKS, TASK_WORDS, HELD = 12, 1 << 19, 1 << 19
#: Pairs of a block that are worked on, and sent, at a time.
ROWS = 1 << 16
#: Parts of a language whose best phrases are found apart before they meet.
PARTS = 64
#: Marks that end a piece, all read as ".", which then is in no word.
_MARKS = bytes.maketrans(b",;:!?\n\x0b\x0c\r", b"." * 9)

_WORDS = "block long, lang string, total long, size int, seq binary, word array<string>, n array<int>"
_NAMED = pa.schema([("block", pa.int64()), ("lang", pa.string()), ("size", pa.int32()), ("seq", pa.binary())])
_NAMED_DDL = "block long, lang string, size int, seq binary"


class _Numbers(dict):
    """Numbers words from 1 as they come; 0 is the end of a piece."""

    def __init__(self) -> None:
        super().__init__({b".": 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _slices(text: bytes) -> Iterator[bytes]:
    """The text in parts that end where a piece does."""
    at = 0
    while len(text) - at > SLICE:
        cut = text.rfind(b".", at, at + SLICE) + 1 or text.find(b".", at + SLICE) + 1 or len(text)
        yield text[at:cut]
        at = cut
    yield text[at:] if at else text


def _words(block_words: int, open_words: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        made, schema = TaskContext.get().partitionId() << 32, None
        begun: dict[str, tuple[_Numbers, list[np.ndarray]]] = {}
        size: Counter[str] = Counter()

        def written(langs: list[str]) -> Iterator[pa.RecordBatch]:
            nonlocal made
            for lang in langs:
                numbers, parts = begun.pop(lang)
                del size[lang]
                seq = np.concatenate(parts)
                counts = np.bincount(seq, minlength=len(numbers)).astype(np.int32)[1:]
                if len(counts):
                    words = pa.array(list(numbers)[1:], pa.binary()).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array([made]), pa.array([lang]), pa.array([int(counts.sum(dtype=np.int64))]), *_packed(seq), _lists(words), _lists(pa.array(counts))], schema=schema)
                    made += 1

        schema = pa.schema([("block", pa.int64()), ("lang", pa.string()), ("total", pa.int64()), ("size", pa.int32()), ("seq", pa.binary()), ("word", pa.list_(pa.string())), ("n", pa.list_(pa.int32()))])
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                # bytes.lower changes A-Z only, and after the marks only blanks and tabs are white space to bytes.split
                for part in _slices(text.as_buffer().to_pybytes().translate(_MARKS)):
                    numbers, parts = begun.setdefault(lang, (_Numbers(), []))
                    words = part.lower().replace(b".", b" . ").split()
                    words.append(b".")
                    parts.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
                    size[lang] += len(words)
                    if size[lang] >= block_words:
                        yield from written([lang])
                    elif size.total() >= open_words:
                        yield from written(list(begun))
        yield from written(list(begun))

    return run


def _lists(values: pa.Array) -> pa.Array:
    """One row with all values."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _packed(seq: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """A sequence of numbers as (its length, its compressed bytes), a row."""
    return pa.array([len(seq)], pa.int32()), pa.array([pa.compress(seq.tobytes(), codec="zstd", asbytes=True)], pa.binary())


def _parts(seq: np.ndarray, most: int) -> list[np.ndarray]:
    """The sequence in parts of at most `most` numbers that end where a piece does; a longer piece is a part of its own."""
    ends = np.append(np.flatnonzero(seq == 0) + 1, len(seq))
    parts, at = [], 0
    while at < len(seq):
        k = np.searchsorted(ends, at + most, "right")
        cut = int(ends[k - 1]) if k and ends[k - 1] > at else int(ends[k])
        parts.append(seq[at:cut])
        at = cut
    return parts


def _unpacked(rows: pa.RecordBatch | pa.Table, k: int = 0) -> np.ndarray:
    size = rows.column("size")[k].as_py()
    return np.frombuffer(pa.decompress(rows.column("seq")[k].as_buffer(), 4 * size, codec="zstd"), np.int32)


def _keys(seq: np.ndarray, place: np.ndarray, size: int) -> list[np.ndarray]:
    """The phrases of `size` words that begin at the places as columns of numbers, two words each; of an odd size the last overlaps the one before."""
    return [seq[place + k].astype(np.int64) << 32 | seq[place + k + 1].astype(np.int64) for k in [*range(0, size - 1, 2)] + [size - 2] * (size % 2)]


def _words_of(keys: list[np.ndarray], size: int) -> list[np.ndarray]:
    """The words of phrases, a column each, from their keys."""
    words = [keys[-1] & 0xFFFFFFFF if k == size - 1 else keys[k // 2] >> 32 if k % 2 == 0 else keys[k // 2] & 0xFFFFFFFF for k in range(size)]
    return [w.astype(np.int32) for w in words]


def _summed(keys: list[np.ndarray], n: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """(distinct keys in order, the sum of n, by default 1, of each)."""
    if len(keys) == 1 and n is None:
        keys = [np.sort(keys[0])]
    else:
        order = np.lexsort(keys) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
        keys, n = [k[order] for k in keys], None if n is None else n[order]
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    first = np.flatnonzero(new)
    sums = np.diff(first, append=len(new)) if n is None else np.add.reduceat(n, first) if len(first) else n
    return [k[first] for k in keys], sums


def _added(counts: Iterator[tuple[list[np.ndarray], np.ndarray]], most: int) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """The (keys, n) of blocks, added up whenever `most` rows are held and sent if over half of them are left, in slices of at most ROWS."""
    held: list[tuple[list[np.ndarray], np.ndarray]] = []

    def added() -> tuple[list[np.ndarray], np.ndarray]:
        sums = held[0] if len(held) == 1 else _summed([np.concatenate(k) for k in zip(*(k for k, _ in held), strict=True)], np.concatenate([n for _, n in held]))
        held.clear()
        return sums

    def sent() -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
        keys, n = added()
        for a in range(0, len(n), ROWS):
            yield [k[a : a + ROWS] for k in keys], n[a : a + ROWS]

    for keys, n in counts:
        held.append((keys, n))
        if sum(len(n) for _, n in held) >= most:
            held.append(added())
            if len(held[0][1]) > most // 2:
                yield from sent()
    if held:
        yield from sent()


def _renamed(part: int):
    """A block's sequence, in parts, with the numbers of known words replaced by their ids, and 0 for the others."""

    def run(blocks: pa.Table, known: pa.Table) -> pa.Table:
        if not blocks.num_rows or not known.num_rows:
            return _NAMED.empty_table()
        seq = _unpacked(blocks)
        ids = np.zeros(max(int(seq.max(initial=0)), int(known.column("code").to_numpy().max())) + 1, np.int32)
        ids[known.column("code").to_numpy()] = known.column("id").to_numpy()
        out = ids[seq]
        out = out[(out > 0) | np.concatenate(([False], out[:-1] > 0))]  # one 0 is as good as many
        block, lang = blocks.column("block")[0].as_py(), blocks.column("lang")[0].as_py()
        rows = [pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([lang], pa.string()), *_packed(p)], schema=_NAMED) for p in _parts(out, part)]
        return pa.Table.from_batches(rows, _NAMED)

    return run


def _hash2(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64))


def _pair_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(mix(left) + right)


def _hashes(batch: pa.RecordBatch) -> np.ndarray:
    """Hashes of phrases, whose words are the columns, as _places() has them."""
    words = [c.to_numpy() for c in batch.columns]
    h = [_hash2(x, y) for x, y in pairwise(words)]
    while len(h) > 1:
        h = [_pair_hash(x, y) for x, y in pairwise(h)]
    return h[0]


def _some(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(0, bool), *(maybe(bits, hashes[a : a + ROWS]) for a in range(0, len(hashes), ROWS))])


def _pairs(seq: np.ndarray) -> np.ndarray:
    """The places of words that another follows; 0 is no word."""
    return np.flatnonzero((seq[:-1] > 0) & (seq[1:] > 0))


def _places(seq: np.ndarray, frequent: list[Broadcast]) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash) of the phrases whose two parts, of a word less, may be frequent; given filters of the frequent phrases
    of 2, 3 and more words the phrases are longer than theirs by a word."""
    place = _pairs(seq)
    hashes = np.zeros(len(place), np.uint64)
    for a in range(0, len(place), ROWS):
        at = place[a : a + ROWS]
        hashes[a : a + ROWS] = _hash2(seq[at], seq[at + 1])
    for bits in frequent:
        some = _some(bits.value, hashes)
        next_ = np.flatnonzero(some[1:] & some[:-1] & (place[1:] == place[:-1] + 1))
        place, hashes = place[next_], _pair_hash(hashes[next_], hashes[next_ + 1])
    return place, hashes


def _count_hashes(frequent: list[Broadcast]):
    """Of a task's blocks, the hashes of phrases whose two parts may be frequent: (h, n)."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (h,), n in _added((_summed([_places(_unpacked(batch, k), frequent)[1].astype(np.int64)]) for batch in batches for k in range(batch.num_rows)), HELD):
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n)], ["h", "n"])

    return run


def _count_phrases(size: int, frequent: list[Broadcast], promising: Broadcast | None):
    """Of a task's blocks, the distinct phrases of `size` words that may be frequent: (their words' ids, n)."""
    names = [*_ids(1, size), "n"]

    def counted(seq: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        if promising is None:
            place = _pairs(seq)
        else:
            place, hashes = _places(seq, frequent)
            place = place[_some(promising.value, hashes)]
        return _summed(_keys(seq, place, size))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, n in _added((counted(_unpacked(batch, k)) for batch in batches for k in range(batch.num_rows)), HELD if size > 2 else 2 * HELD):
            yield pa.RecordBatch.from_arrays([*map(pa.array, _words_of(keys, size)), pa.array(n.astype(np.int64))], names)

    return run


def _ids(first: int, last: int) -> list[str]:
    """The columns of a phrase's words, from one to another."""
    return [f"w{k}" for k in range(first, last + 1)]


@contextmanager
def _few_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs that run meanwhile read and send `rows` rows at a time, as theirs are large; what the session had is set again."""
    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
    before = {name: spark.conf.get(name) for name in names}
    try:
        for name in names:
            spark.conf.set(name, str(rows))
        yield
    finally:
        for name in names:
            spark.conf.set(name, before[name])


def _numbered(rows: DataFrame) -> DataFrame:
    """The rows with a gapless number from 1 as id."""
    rows = stage(rows.select(F.monotonically_increasing_id().alias("at"), *rows.columns), "unnumbered").withColumn("task", F.shiftright("at", 33))
    sizes = rows.groupBy("task").agg(F.count("*").alias("n"))
    before = sizes.select("task", F.coalesce(F.sum("n").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return rows.join(F.broadcast(before), "task").select((F.col("base") + F.col("at").bitwiseAND((1 << 33) - 1) + 1).alias("id"), *(c for c in rows.columns if c not in ("at", "task")))


def _dealt(blocks: DataFrame) -> tuple[int, DataFrame]:
    """(the number of tasks, the task of each block): equal shares of all words, in the order of languages."""
    whole = max(1, blocks.agg(F.sum("total")).first()[0] or 0)
    tasks = min(max(TASKS, 2 * blocks.sparkSession.sparkContext.defaultParallelism), -(-whole // TASK_WORDS))
    before = F.coalesce(F.sum("total").over(Window.orderBy("lang", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # a row a block of some 2^21 words, in one task
    return tasks, small(stage(blocks.select("lang", "block", "total").select("block", F.floor(before * tasks / whole).cast("int").alias("task")), "dealt"))


def mine_phrases(docs: DataFrame, text_column: str = "text", lang_column: str = "lang", longest: int = 4, least: int = 30, overlap: int = 80, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first `top` phrases of 2 to `longest` words.

    Texts (null: empty) are lower-cased in A-Z, split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and these at blanks and tabs
    into words. A null language counts as `und`. n: word occurrences of the language; a: occurrences of the phrase
    within pieces, overlaps included, at least `least`. A cut after the first k words gives l and r, the occurrences of
    its two parts, and the score 2,000,000 a / (l + r), rounded down; the lowest score counts, of equal ones the least k.
    Phrases inside a longer one with at least `overlap` percent of their occurrences are left out. Ordered by score and
    a, descending, and the phrase in byte order. Arithmetic is exact. An empty table gives no rows.
    """
    if not 2 <= longest <= 16 or least < 1 or not 0 < overlap <= 100:
        raise ValueError("2 to 16 words, at least one occurrence, and an overlap of 1 to 100 percent")
    texts = docs.select(F.coalesce(F.col(f"`{lang_column}`"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text_column}`"), F.lit("")).cast("binary").alias("text"))
    blocks = stage(texts.mapInArrow(_words(BLOCK_WORDS, OPEN_WORDS), _WORDS), "words", **_LARGE)
    totals = stage(blocks.groupBy("lang").agg(F.sum("total").alias("total")), "totals")
    counted = blocks.select("lang", F.inline(F.arrays_zip("word", "n"))).groupBy("lang", "word").agg(F.sum("n").alias("a"))
    none = F.array().cast("array<long>")
    names = stage(_numbered(counted.filter(F.col("a") >= least).select("lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "a", none.alias("heads"), none.alias("tails"))).withColumn("w1", F.col("id").cast("int")), "names")
    if names.count() >= 1 << 31:
        raise ValueError("2^31 frequent words or more")
    known = blocks.select("block", "lang", F.posexplode("word").alias("at", "phrase")).join(names.select("lang", "phrase", "w1"), ["lang", "phrase"])
    known = known.select(F.col("block").alias("of"), (F.col("at") + 1).cast("long").alias("code"), F.col("w1").alias("id"))
    named = blocks.select("block", "lang", "size", "seq").groupBy("block").cogroup(known.groupBy("of")).applyInArrow(_renamed(PART), _NAMED_DDL)
    # blocks of one language share phrases, which their task adds up before it sends them
    tasks, dealt = _dealt(blocks)
    blocks = stage(named.join(dealt, "block").repartitionById(tasks, "task").select("size", "seq"), "named", compression="none", **_LARGE)

    found, frequent, promising, send = [], [], None, docs.sparkSession.sparkContext.broadcast
    for size in range(2, longest + 1):
        words = _ids(1, size)
        counts = blocks.mapInArrow(_count_phrases(size, list(frequent), promising), ", ".join(f"{w} int" for w in words) + ", n long")
        phrases = counts.repartition(*words).groupBy(*words).agg(F.sum("n").alias("a")).filter(F.col("a") >= least)
        with _few_rows(docs.sparkSession, BATCH):
            phrases = stage(phrases.withColumn("id", F.monotonically_increasing_id()), "frequent")
        left = names.select(*words[:-1], F.col("id").alias("left"), "lang", F.col("phrase").alias("head"), F.concat("heads", F.array("a")).alias("heads"))
        right = names.select(*(F.col(w).alias(v) for w, v in zip(words[:-1], words[1:], strict=True)), F.col("id").alias("right"), "last", F.concat("tails", F.array("a")).alias("tails"))
        longer = phrases.join(left, words[:-1]).join(right, words[1:])
        longer = stage(longer.select("id", *words, "left", "right", "lang", F.concat_ws(" ", "head", "last").alias("phrase"), "last", "a", "heads", "tails"), "names")
        if size > 2:
            found.append(_outlasting(names, longer, overlap))
        names = longer
        if size < longest:
            frequent.append(send(build(phrases.select(*words), filter_bits(phrases.count()), 1, _hashes)))
            likely = blocks.mapInArrow(_count_hashes(list(frequent)), "h long, n long").repartition("h").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
            with _few_rows(docs.sparkSession, BATCH):
                likely = stage(likely.select("h"), "promising")
            promising = send(build(likely, filter_bits(likely.count()), 1))
    found.append(names)

    phrases = found[0].select("lang", "phrase", "a", "heads", "tails")
    for more in found[1:]:
        phrases = phrases.unionByName(more.select("lang", "phrase", "a", "heads", "tails"))
    # heads[k - 1] are the occurrences of the first k words, tails[k - 1] those of the last k
    cut = "struct((cast(a as decimal(20, 0)) * 2000000) div (h + tails[size(tails) - 1 - i]) as score, i as k, h as l, tails[size(tails) - 1 - i] as r)"
    scored = phrases.select("lang", "phrase", "a", F.expr(f"array_min(transform(heads, (h, i) -> {cut}))").alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    best = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    salted = scored.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*best))).filter(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(small(totals), "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


def _outlasting(names: DataFrame, longer: DataFrame, overlap: int) -> DataFrame:
    """Phrases but those that a phrase of one word more covers.

    A phrase of several words more can't cover what none of one word more does: the one between is as frequent at least.
    """
    over = longer.select(F.explode(F.array("left", "right")).alias("id"), F.col("a").alias("most")).groupBy("id").agg(F.max("most").alias("most"))
    covered = F.col("most").cast("decimal(20, 0)") * 100 >= F.col("a").cast("decimal(20, 0)") * overlap
    return names.join(over, "id", "left").filter(F.col("most").isNull() | ~covered)


def oracle_sql() -> str:
    """The same in SQL for the default parameters, all n-grams counted as strings."""
    return r"""
        WITH t AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
        p AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM t),
        w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda v: v <> '') AS ws FROM p),
        grams AS (SELECT lang, k, array_to_string(g, ' ') AS phrase FROM (
            SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: ws[i : i + k - 1])) AS g FROM w, (SELECT unnest([1, 2, 3, 4]) AS k))),
        f AS (SELECT lang, k, phrase, count(*) AS a FROM grams GROUP BY ALL),
        n AS (SELECT lang, sum(a) AS n FROM f WHERE k = 1 GROUP BY lang),
        c AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND a >= 30),
        cuts AS (SELECT c.lang, c.phrase, c.k AS size, c.a, x.k AS cut, x.a AS l, y.a AS r, (2000000::hugeint * c.a) // (x.a + y.a) AS score
                 FROM c JOIN f x ON x.lang = c.lang AND x.k < c.k AND x.phrase = array_to_string(c.ws[1 : x.k], ' ')
                        JOIN f y ON y.lang = c.lang AND y.k = c.k - x.k AND y.phrase = array_to_string(c.ws[x.k + 1 : c.k], ' ')),
        scored AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase, size ORDER BY score, cut) = 1),
        covered AS (SELECT DISTINCT s.lang, s.phrase FROM c b, (SELECT unnest([2, 3]) AS m), (SELECT unnest([1, 2, 3]) AS i), c s
                    WHERE i + m - 1 <= b.k AND m < b.k AND s.lang = b.lang AND s.k = m AND s.phrase = array_to_string(b.ws[i : i + m - 1], ' ') AND 100 * b.a >= 80 * s.a),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM scored ANTI JOIN covered USING (lang, phrase))
        SELECT lang, rank, phrase, a::bigint AS a, l::bigint AS l, r::bigint AS r, n::bigint AS n, score::bigint AS score FROM ranked JOIN n USING (lang) WHERE rank <= 2000"""
