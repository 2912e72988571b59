"""BPE encoding and decoding with a table of distinct words.

Encoding. Tasks split texts into words. The most frequent words of a bounded sample are encoded once and
broadcast as a table of bounded size, sorted by a 64-bit hash of the word; which words it holds changes no
result. Positions of all other words are sent by word, so that each distinct word is encoded once, in order of
words, and its ids join back to the documents by position. What is sent of a document is a code for each word of
the table, in about two bytes.

Decoding. Rows are taken in blocks. The distinct ids of a block join the table of (id, piece), which is broadcast, as a
vocabulary's size doesn't grow with the data. A broadcast join keeps the order of rows, so a task has the pieces of a
block after its rows, without a shuffle, and puts them together at their positions; that they do come in order, and
all of them, is checked.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm._arrays import blocks, hash_spans, lean
from textloom.llm._codepoints import bpe_words, code_points
from textloom.llm._staging import fresh, stage

#: Rows of the sample that proposes words for the broadcast table, and words that it holds at most, both in expectation.
SAMPLE_ROWS = 32_768
TABLE_WORDS = 1 << 19
_BLOCK = 400_000
_ROWS = 500  # rows that are put together at once
_DECODED = 1_000_000  # bytes of ids that are decoded together, or those of one row
_RARE = -1  # codes: a word of the table, a word that isn't in it, or -2 - id for a special token


def default_path() -> str:
    from public_tokenizers import path

    return path("byte_bpe_50k.json")


def _byte_characters() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class Specials:
    """The special tokens of a vocabulary, all of it that splitting needs: tasks that only split don't load the rest."""

    def __init__(self, ids: dict[str, int]):
        self.special = ids
        self.pattern = re.compile("|".join(map(re.escape, sorted(ids, key=len, reverse=True)))) if ids else None


class Vocabulary:
    """A byte-level BPE vocabulary file of the tokenizers library; its model and its pieces are loaded where they are asked for."""

    def __init__(self, path: str):
        self._path, spec = path, self._spec(path)
        if spec["model"]["type"] != "BPE" or spec["normalizer"] or (spec["pre_tokenizer"] or {}).get("type") != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space") or not spec["pre_tokenizer"].get("use_regex", True):
            raise ValueError("only byte-level BPE vocabularies without a normalizer or a prefix space are known here")
        added = spec["added_tokens"]
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added):
            raise ValueError("special tokens that take white space or words with them aren't known here")
        self.specials = Specials({t["content"]: t["id"] for t in added})
        self._to = _byte_characters()

    @staticmethod
    def _spec(path: str) -> dict:
        with open(path, encoding="utf-8") as f:
            return json.load(f)

    @cached_property
    def pieces(self) -> dict[int, bytes]:
        """Bytes by id, special tokens included."""
        back = {c: bytes([b]) for b, c in enumerate(self._to)}
        return {i: b"".join(back[c] for c in piece) for piece, i in self._spec(self._path)["model"]["vocab"].items()} | {i: content.encode() for content, i in self.specials.special.items()}

    @cached_property
    def _model(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self._path).model

    def text_of(self, ids: np.ndarray) -> str:
        """The text of ids; those that it doesn't have stand for nothing."""
        return b"".join([self.pieces.get(i, b"") for i in ids.tolist()]).decode("utf-8", "replace")

    def encode_word(self, word: str) -> np.ndarray:
        return np.array([t.id for t in self._model.tokenize("".join([self._to[b] for b in word.encode()]))], "<u4")


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """values[start : start + length] of each span, one after another."""
    ends = np.cumsum(lengths)
    return values[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)]


def _split(texts: pa.Array, vocab: Specials) -> Iterator[tuple]:
    """For runs of rows: (first row, number of rows, text, starts, ends, hashes, rows, special id or -1) of their words."""
    for first, data, offsets in blocks(texts, _BLOCK):
        text, points, at = code_points(data, offsets)
        cuts, special = at, {}
        if vocab.pattern and (found := [*vocab.pattern.finditer(text)]):
            row_ends = at[1:]
            found = [m for m in found if row_ends[np.searchsorted(row_ends, m.start(), "right")] >= m.end()]
            special = {m.start(): vocab.special[m[0]] for m in found}
            cuts = np.unique(np.concatenate((at, [m.start() for m in found], [m.end() for m in found]))).astype(np.int64)
        starts = bpe_words(points, cuts)
        ends = np.append(starts[1:], len(points))
        ids = np.full(len(starts), -1, np.int64)
        if special:
            where = np.searchsorted(starts, [*special])
            keep = np.ones(len(starts), bool)
            for w, (s, i) in zip(where, special.items(), strict=True):
                stop = cuts[np.searchsorted(cuts, s, "right")]
                inner = slice(w + 1, np.searchsorted(starts, stop))
                keep[inner], ids[w], ends[w] = False, i, stop
            starts, ends, ids = starts[keep], ends[keep], ids[keep]
        yield first, len(offsets) - 1, text, starts, ends, hash_spans(points, starts, ends), np.searchsorted(at, starts, "right") - 1, ids


class WordTable:
    """Encoded words, found by hash; frequent words have the smaller codes."""

    def __init__(self, words: pa.Array, ids: pa.Array):
        hashes = [hash_spans(points, at[:-1], at[1:]) for _, data, offsets in blocks(words) for _, points, at in [code_points(data, offsets)]]
        every = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.codes = np.argsort(every).astype(np.int32)
        self.hashes = every[self.codes]
        packed = ids.to_pylist()
        self.lengths = np.array([len(b) // 4 for b in packed], np.int32)
        self.starts = np.cumsum(self.lengths, dtype=np.int64) - self.lengths
        self.ids = np.frombuffer(b"".join(packed), "<u4")

    def find(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.full(len(hashes), _RARE, np.int32)
        import pandas as pd

        each, distinct = pd.factorize(hashes)
        at = np.minimum(np.searchsorted(self.hashes, distinct), len(self.hashes) - 1)
        return np.where(self.hashes[at] == distinct, self.codes[at], _RARE).astype(np.int32)[each]


def _pack(codes: np.ndarray) -> bytes:
    """Codes as varints of 7 bits a byte: 0 for a rare word, even numbers for the table's, odd ones for special tokens."""
    c = codes.astype(np.int64)
    v = np.where(c >= 0, 2 * c + 2, np.where(c == _RARE, 0, 2 * (-2 - c) + 1))
    bytes_of = 1 + (v >= 1 << 7).astype(np.int64) + (v >= 1 << 14) + (v >= 1 << 21) + (v >= 1 << 28)
    ends = np.cumsum(bytes_of)
    out = np.zeros(ends[-1] if len(ends) else 0, np.uint8)
    for k in range(5):
        more = bytes_of > k
        out[(ends - bytes_of + k)[more]] = ((v[more] >> (7 * k)) & 127) | ((bytes_of[more] > k + 1) << 7)
    return out.tobytes()


def _unpack(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8).astype(np.int64)
    ends = np.flatnonzero(b < 128)
    starts = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends
    v = np.zeros(len(ends), np.int64)
    for k in range(5):
        at = starts + k
        more = at <= ends
        v[more] |= (b[at[more]] & 127) << (7 * k)
    return np.where(v == 0, _RARE, np.where(v % 2 == 0, v // 2 - 1, -2 - v // 2))


def _sample_words(docs: DataFrame, path: str) -> DataFrame:
    """(word, n) of a bounded sample of the rows."""
    rows, specials = max(1, docs.count()), vocabulary(path).specials
    if rows > SAMPLE_ROWS:
        docs = docs.filter(F.pmod(F.xxhash64("k1", "k2"), F.lit(1 << 20)) < int((1 << 20) * SAMPLE_ROWS / rows))

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pandas as pd

        seen: dict[str, int] = {}
        for b in batches:
            for _, _, text, starts, ends, hashes, _, ids in _split(b.column(0), specials):
                own = ids < 0
                each, _ = pd.factorize(hashes[own])
                n, one = np.bincount(each), np.unique(each, return_index=True)[1]
                for s, e, k in zip(starts[own][one].tolist(), ends[own][one].tolist(), n.tolist(), strict=True):
                    seen[text[s:e]] = seen.get(text[s:e], 0) + k
            if len(seen) > 200_000:
                yield pa.RecordBatch.from_pydict({"word": [*seen], "n": [*seen.values()]})
                seen = {}
        yield pa.RecordBatch.from_pydict({"word": pa.array([*seen], pa.string()), "n": pa.array([*seen.values()], pa.int64())})

    return docs.select("text").mapInArrow(lean(f), "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _encode_words(words: DataFrame, path: str) -> DataFrame:
    """The rows with the ids of each row's word; neighbours with one word are encoded together."""
    others = [f for f in words.schema if f.name != "word"]

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, ids, vocab = None, b"", vocabulary(path)
        for b in batches:
            out = []
            for w in b.column(b.num_columns - 1).to_pylist():
                if w != last:
                    last, ids = w, vocab.encode_word(w).tobytes()
                out.append(ids)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], [*b.schema.names, "ids"])

    schema = ", ".join([*(f"{c.name} {c.dataType.simpleString()}" for c in others), "word string", "ids binary"])
    return words.select(*(c.name for c in others), "word").mapInArrow(lean(f), schema)


def _word_table(docs: DataFrame, path: str, most: int) -> WordTable:
    words = stage(_sample_words(docs, path), "words")
    sizes = sorted(words.groupBy(F.floor(F.log2("n")).alias("size")).count().collect(), reverse=True)
    # the frequent words whole, and of the size that doesn't fit as a whole a share by hash
    taken, total = F.lit(False), 0
    for size, n in sizes:
        share = min(n, most - total) / n
        taken = taken | ((F.floor(F.log2("n")) == size) & (F.pmod(F.xxhash64("word"), F.lit(1 << 20)) < int(share * (1 << 20))))
        total += n
        if total >= most:
            break
    rows = _encode_words(words.filter(taken), path).toArrow().sort_by([("n", "descending"), ("word", "ascending")])
    return WordTable(rows["word"], rows["ids"])


class _Split:
    """The rows of a table keyed for encoding, the broadcast word table, and the positions of words that it lacks."""

    def __init__(self, docs: DataFrame, id_column: str, text_column: str, path: str, table_words: int):
        id_, text = F.col(f"`{id_column}`"), F.coalesce(F.col(f"`{text_column}`"), F.lit(""))
        # rows find their rare words again by id and text hash: 44 bits of it beside an integer id, else all of it
        whole = isinstance(docs.schema[id_column].dataType, (T.LongType, T.IntegerType, T.ShortType, T.ByteType))
        k1 = F.coalesce(id_.cast("long"), F.lit(-1)) if whole else F.xxhash64(id_)
        k2 = F.when(id_.isNotNull() & F.lit(whole), F.shiftrightunsigned(F.xxhash64(text), 20)).otherwise(F.xxhash64(text))
        self.docs = docs.select(id_.alias("id"), text.alias("text"), k1.alias("k1"), k2.alias("k2"))
        self.kind = self.docs.schema["id"].dataType.simpleString()
        table: Broadcast[WordTable] = docs.sparkSession.sparkContext.broadcast(_word_table(self.docs, path, table_words))
        self.table = table
        specials = vocabulary(path).specials

        def codes(texts: pa.Array) -> Iterator[tuple]:
            for first, n, text, starts, ends, hashes, rows, ids in _split(texts, specials):
                found = table.value.find(hashes)
                found[ids >= 0] = (-2 - ids[ids >= 0]).astype(np.int32)
                yield first, n, text, starts, ends, found, rows

        def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                k1, k2 = b.column(0).to_numpy(), b.column(1).to_numpy()
                for first, _, text, starts, ends, found, rows in codes(b.column(2)):
                    at = np.flatnonzero(found == _RARE)
                    if len(at):
                        row = rows[at]
                        words = [text[s:e] for s, e in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
                        yield pa.RecordBatch.from_pydict({"k1": k1[first + row], "k2": k2[first + row], "at": (at - np.searchsorted(rows, row)).astype(np.int32), "word": words})

        self.codes = codes
        lone = self.docs.select("k1", "k2", "text").mapInArrow(lean(rare), "k1 bigint, k2 bigint, at int, word string").repartition("word").sortWithinPartitions("word")
        #: (k1, k2, at, word, ids) of each position of a word that isn't in the table.
        self.rare = _encode_words(lone, path)


def encode(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", tokenizer: str | None = None, table_words: int = TABLE_WORDS, decoded: str | None = None, lookup: bool = False) -> DataFrame:
    """A row for each row of docs: the id and `ids`, the token ids as little-endian unsigned 32-bit integers.

    Ids are those of the tokenizers library's encode with add_special_tokens=False: special tokens that a text
    holds are found in it. Null and empty texts have no ids (empty bytes). Null, tied and repeated ids and
    repeated rows are encoded like others; other columns aren't carried; an empty table gives an empty result.

    With `decoded`, a column of that name has what decode() makes of the ids: the same, in fewer Python processes. With
    `lookup` as well the pieces are looked up in the vocabulary that a process has at hand, which takes one less again.
    """
    path = tokenizer or default_path()
    split = _Split(docs, id_column, text_column, path, table_words)
    docs, table, kind, codes = split.docs, split.table, split.kind, split.codes

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            packed: list[bytes] = []
            for _, n, _, _, _, found, rows in codes(b.column(3)):
                cut = np.searchsorted(rows, np.arange(n + 1))
                packed += [_pack(found[s:e]) for s, e in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(packed, pa.binary())], ["k1", "k2", "id", "codes"])

    # rows that are wholly alike have one key, so what is collected is a set
    joined = split.rare.groupBy("k1", "k2").agg(F.collect_set(F.struct("at", "ids")).alias("rare"))
    base = docs.select("k1", "k2", "id", "text").mapInArrow(lean(coded), f"k1 bigint, k2 bigint, id {kind}, codes binary")

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for b in (whole_batch.slice(k, _ROWS) for k in range(0, whole_batch.num_rows, _ROWS)):
                ids = [_join(table.value, codes, extra or ()) for codes, extra in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
                columns = [b.column(0), pa.array([x.tobytes() for x in ids], pa.binary())]
                if lookup:
                    columns.append(pa.array([vocabulary(path).text_of(x) for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, [id_column, "ids", *[decoded] * lookup])

    rows, out = base.join(joined, ["k1", "k2"], "left").select("id", "codes", "rare"), T.StructType([T.StructField(id_column, split.docs.schema["id"].dataType), T.StructField("ids", T.BinaryType())])
    if not decoded or lookup:
        return rows.mapInArrow(lean(filled), out.add(decoded, T.StringType()) if lookup else out)
    return _pieced(rows.mapInArrow(lean(lambda batches: _blocked(filled(batches), 1)), _block_type(out)), out, decoded, path)


def count_tokens(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", tokenizer: str | None = None, table_words: int = TABLE_WORDS) -> DataFrame:
    """(id, n_tokens) for each row of docs: how many ids encode() gives its text, without putting them in order.

    Null and empty texts have 0. Null, tied and repeated ids and repeated rows are counted like others; other columns
    aren't carried; an empty table gives an empty result.
    """
    split = _Split(docs, id_column, text_column, tokenizer or default_path(), table_words)
    table, codes = split.table, split.codes

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total = np.zeros(b.num_rows, np.int64)
            for first, n, _, _, _, found, rows in codes(b.column(3)):
                each = np.ones(len(found), np.int64)  # a special token is one
                each[found >= 0] = table.value.lengths[found[found >= 0]]
                each[found == _RARE] = 0
                total[first : first + n] = np.bincount(rows, each, n)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(total)], ["k1", "k2", "id", "known"])

    base = split.docs.select("k1", "k2", "id", "text").mapInArrow(lean(known), f"k1 bigint, k2 bigint, id {split.kind}, known bigint")
    rare = split.rare.select("k1", "k2", F.expr("octet_length(ids) div 4").alias("n")).groupBy("k1", "k2").agg(F.sum("n").alias("more"))
    # rows that are alike have one key, under which the rare words of all of them were added up
    alike = split.docs.groupBy("k1", "k2").agg(F.count("*").alias("alike")).filter("alike > 1")
    each = rare.join(alike, ["k1", "k2"], "left").select("k1", "k2", F.expr("more div coalesce(alike, 1L)").alias("more"))
    return base.join(each, ["k1", "k2"], "left").select(F.col("id").alias(id_column), F.expr("known + coalesce(more, 0L)").alias("n_tokens"))


def _join(table: WordTable, codes: bytes, rare) -> np.ndarray:
    """A document's ids from its codes, with those of its rare words put in at their positions."""
    c = _unpack(codes)
    known, own = c >= 0, {}
    for at in np.flatnonzero(c < _RARE).tolist():
        own[at] = np.array([-2 - c[at]], "<u4")
    for e in rare:
        own[e["at"]] = np.frombuffer(e["ids"], "<u4")
    lengths, starts = np.zeros(len(c), np.int64), np.zeros(len(c), np.int64)
    lengths[known], starts[known] = table.lengths[c[known]], table.starts[c[known]]
    for at, ids in own.items():
        lengths[at] = len(ids)
    ends = np.cumsum(lengths)
    out = np.zeros(ends[-1] if len(ends) else 0, "<u4")
    given = np.repeat(known, lengths)
    out[given] = _gather(table.ids, starts[known], lengths[known])
    for at, ids in own.items():
        out[ends[at] - len(ids) : ends[at]] = ids
    return out


#: The most bytes of a vocabulary's pieces that are broadcast.
PIECE_BYTES = 64 << 20


def piece_table(spark: SparkSession, path: str) -> DataFrame:
    """(token, piece): the bytes of each id of a vocabulary."""
    pieces = vocabulary(path).pieces
    if sum(map(len, pieces.values())) > PIECE_BYTES:
        raise ValueError(f"the vocabulary's pieces have more than {PIECE_BYTES} bytes")
    return spark.createDataFrame(pa.table({"token": pa.array(pieces.keys(), pa.int64()), "piece": pa.array(pieces.values(), pa.binary())}))


def decode(encoded: DataFrame, ids_column: str = "ids", name: str = "decoded", tokenizer: str | None = None) -> DataFrame:
    """The table with the text that each row's ids stand for, special tokens included, in a column `name`.

    Null and no ids give an empty text; ids outside the vocabulary stand for nothing. Bytes that make no UTF-8 decode
    to U+FFFD. Repeated rows and null ids are rows like others; an empty table gives an empty result. A name that the
    table has already gets underscores appended.
    """
    at, path = encoded.columns.index(ids_column), tokenizer or default_path()
    plain = encoded.toDF(*(f"c{i}" for i in range(len(encoded.columns))))
    return _pieced(plain.mapInArrow(lean(lambda batches: _blocked(batches, at)), _block_type(encoded.schema)), encoded.schema, fresh(encoded, name), path)


def _block_type(rows: T.StructType) -> T.StructType:
    row = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(rows)])
    return T.StructType([T.StructField("rows", T.ArrayType(row)), T.StructField("ids_at", T.IntegerType()), T.StructField("of", T.LongType()), T.StructField("token", T.LongType())])


def _blocked(batches: Iterator[pa.RecordBatch], ids_at: int) -> Iterator[pa.RecordBatch]:
    """Blocks of rows: (rows, ids_at, of, token), a row for each of the `of` distinct ids of a block, the first with its rows."""
    for b in batches:
        row = pa.StructArray.from_arrays(b.columns, [f"c{i}" for i in range(b.num_columns)])
        packed = b.column(ids_at).fill_null(b"")
        size = np.cumsum(pc.binary_length(packed).to_numpy(zero_copy_only=False).astype(np.int64))
        cuts = np.unique(np.concatenate((np.arange(0, b.num_rows, _ROWS), np.flatnonzero(np.diff(size // _DECODED)) + 1, [b.num_rows])))
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            tokens = np.unique(np.concatenate([_ids(x) for x in packed.slice(lo, hi - lo).to_pylist()]))
            more = max(0, len(tokens) - 1)
            held = pa.ListArray.from_arrays(pa.array([0, hi - lo], pa.int32()), row.slice(lo, hi - lo))
            held = pa.concat_arrays([held, pa.nulls(more, held.type)])
            n = 1 + more
            yield pa.RecordBatch.from_arrays([held, pa.array([ids_at] * n, pa.int32()), pa.array([len(tokens)] + [0] * more, pa.int64()), pa.array(tokens.astype(np.int64) if len(tokens) else [None], pa.int64())], ["rows", "ids_at", "of", "token"])


def _pieced(blocks: DataFrame, rows: T.StructType, name: str, path: str) -> DataFrame:
    """The rows of blocks with their texts, once the blocks' ids have met their pieces."""
    names = [*rows.names, name]
    pieces = blocks.join(F.broadcast(piece_table(blocks.sparkSession, path)), "token", "left").select("rows", "of", "token", "piece", "ids_at")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids_at, most, tokens, found = None, 0, 0, [], []

        def out() -> pa.RecordBatch:
            known = np.concatenate([*tokens, np.zeros(0, np.int64)])
            if len(known) != most or (known[1:] <= known[:-1]).any():
                raise RuntimeError("pieces came out of order")
            data, starts, lengths = _spans(found)
            fields = block.flatten()
            at = [np.searchsorted(known, _ids(x or b"")) for x in fields[ids_at].to_pylist()]
            texts = [_gather(data, starts[i], lengths[i]).tobytes().decode("utf-8", "replace") for i in at]
            return pa.RecordBatch.from_arrays([*fields, pa.array(texts, pa.string())], names)

        for b in batches:
            first = b.column(0).is_valid().to_numpy(zero_copy_only=False)
            cuts = np.unique([0, *np.flatnonzero(first), b.num_rows]).tolist()
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if first[lo]:
                    if block is not None:
                        yield out()
                    block, ids_at, most, tokens, found = b.column(0)[lo].values, b.column(4)[lo].as_py(), b.column(1)[lo].as_py(), [], []
                own = b.slice(lo, hi - lo)
                tokens.append(own.column(2).drop_null().to_numpy())
                found.append(own.column(3).filter(own.column(2).is_valid()))
        if block is not None:
            yield out()

    return pieces.mapInArrow(lean(joined), T.StructType([*rows.fields, T.StructField(name, T.StringType())]))


def _ids(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed[: len(packed) // 4 * 4], "<u4")


def _spans(pieces: list[pa.Array]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of binary arrays together, and where each of their values starts and how long it is; null is empty."""
    every = pa.concat_arrays([p.fill_null(b"") for p in pieces]) if pieces else pa.array([], pa.binary())
    offsets = np.frombuffer(every.buffers()[1], np.int32)[every.offset : every.offset + len(every) + 1].astype(np.int64) if len(every) else np.zeros(1, np.int64)
    return np.frombuffer(every.buffers()[2] or b"", np.uint8), offsets[:-1], np.diff(offsets)
