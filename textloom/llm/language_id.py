"""Language ID by unigram models of pieces, summed over all segmentations.

Pieces are those of a fixed public vocabulary. A language gives each piece a probability, and a word's probability is
the sum over all ways to cut it into pieces of the products of their probabilities, which a forward pass over the
word's characters computes. A text's score for a language is the sum over its words; words are runs of letters in
lower case with the vocabulary's word mark before them.

Training is expectation maximisation: forward and backward passes over the words of labelled texts give the expected
number of times each piece is used. It starts from equal probabilities. What reaches the driver is a number for each
piece and language.

Tasks score each distinct word of a block of texts once, the words of a block together, in numpy. Runs of characters
that no piece begins with aren't looked at further.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm._arrays import blocks, hash_spans, lean, prefix_sums, span_sums
from textloom.llm._codepoints import LETTER, classes
from textloom.llm._staging import fresh, stage

#: Labelled rows that are fitted on at most, chosen by a hash of the row; rounds of training.
FIT_ROWS, ROUNDS = 20_000, 3
#: The probability of a character that no piece covers, and what is added to each expected count.
_LONE, _SMOOTH = 1e-7, 0.01
_MARK = 0x2581
_BLOCK = 400_000
_ROWS = 500  # rows that are predicted, and sent, at once
#: Units of a run of letters above which it is scored in windows; places after which sums are scaled again.
_LONG, _RESCALE = 1024, 8
#: Units of a window, and of the context on both sides, in which a long run of letters is learned from.
_WINDOW, _CONTEXT = 256, 64
#: Units of a word up to which training multiplies probabilities, lifted by a constant a unit that cancels; longer ones add logarithms.
_PLAIN, _LIFT = 40, 1e6
#: Units of a word up to which its score is summed without scaling, units of such words summed together, and words that a task remembers.
_SHORT, _UNITS, _KNOWN = 24, 100_000, 100_000
#: Bits of a slot in the tables of what pieces begin with, and the odd number that spreads sums over them.
_SLOTS, _SPREAD = 17, np.uint64(0x9E3779B97F4A7C15)
#: The fewest letters of a text from which its fit to a language is told, and the fitted rows that say what is usual, in expectation.
FIT_LETTERS, USUAL_ROWS = 20, 2_000


def default_path() -> str:
    from public_tokenizers import path

    return path("piece_bpe_32k.model")


class Pieces:
    """The vocabulary's pieces by hash; those with other characters than letters and the word mark are left out."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        every = {model.id_to_piece(i).lower() for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
        self.words = sorted(p for p in every if p and all(c == chr(_MARK) or c.isalpha() for c in p))
        lengths = np.array([*map(len, self.words)], np.int64)
        ends = np.cumsum(lengths)
        units = np.frombuffer("".join(self.words).encode("utf-32-le"), np.uint32)
        hashes = hash_spans(units, ends - lengths, ends)
        self.order = np.argsort(hashes)
        self.hashes, self.longest = hashes[self.order], int(lengths.max())
        self.lengths = np.append(lengths, 1)  # the last is for characters without a piece
        #: By length: the sums of pieces in order, their numbers, and by slot 1 if a longer piece may begin so, 2 if it may be a piece.
        self.runs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        sums = prefix_sums(units)
        for k in range(1, self.longest + 1):
            number = np.flatnonzero(lengths >= k)
            run, flags = span_sums(sums, (ends - lengths)[number], (ends - lengths)[number] + k), np.zeros(1 << _SLOTS, np.uint8)
            whole = lengths[number] == k
            flags[_slots(run[~whole])] |= 1
            flags[_slots(run[whole])] |= 2
            order = np.argsort(run[whole])
            self.runs.append((run[whole][order], number[whole][order], flags))

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each piece, or -1."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.order[at], -1)

    def find_runs(self, sums: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of runs of one length, by their sums: (those that are pieces, their numbers, whether a longer piece may begin with each)."""
        run, number, flags = self.runs[length - 1]
        flag = flags[_slots(sums)]
        maybe = np.flatnonzero(flag & 2) if len(run) else np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(run, sums[maybe]), len(run) - 1)
        is_piece = run[at] == sums[maybe]
        return maybe[is_piece], number[at[is_piece]], (flag & 1).astype(bool)


def _slots(sums: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (sums * _SPREAD) >> np.uint64(64 - _SLOTS)


@lru_cache(2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


@dataclass(frozen=True)
class Model:
    path: str
    langs: tuple[str, ...]
    log_prior: np.ndarray
    chance: np.ndarray  # of a piece in a language; the last row is for characters without a piece
    usual: np.ndarray | None = None  # by language: mean and deviation of the log probability a letter of labelled texts


def _words(texts: pa.Array) -> Iterator[tuple]:
    """For runs of rows: (first row, number of rows, code points, starts, ends, rows); a word's first unit is the mark."""
    for first, data, offsets in blocks(texts, _BLOCK):
        raw = data.tobytes()
        low = [raw[a:b].decode("utf-8", "replace").lower() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        joined = np.frombuffer((" " + " ".join(low) + " ").encode("utf-32-le"), np.uint32).copy()
        at = np.cumsum([1, *(len(t) + 1 for t in low)])
        letter = classes()[joined] == LETTER
        edge = np.flatnonzero(np.diff(letter.astype(np.int8)))
        starts, ends = edge[0::2], edge[1::2] + 1  # the unit before the first letter becomes the mark
        joined[starts] = _MARK
        yield first, len(offsets) - 1, joined, starts, ends, np.searchsorted(at, starts + 1, "right") - 1


def _lattice(units: np.ndarray, vocab: Pieces) -> np.ndarray:
    """For words of one length: the piece that ends at each unit with each length, by (word, unit, length - 1); -1 where there is none."""
    n, length = units.shape
    flat = units.ravel()
    most = min(vocab.longest, length)
    out = np.full((n, length, most), -1, np.int32)
    base = np.arange(n)[:, None] * length
    for k in range(1, most + 1):
        starts = (base + np.arange(length - k + 1)[None, :]).ravel()
        out[:, k - 1 :, k - 1] = vocab.find(hash_spans(flat, starts, starts + k)).reshape(n, -1)
    # a character that no one-character piece covers stands alone
    out[:, :, 0][out[:, :, 0] < 0] = len(vocab.words)
    return out


def _advance(sums: np.ndarray, lattice: np.ndarray, chance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward sums carried over the units of a lattice, and the log of what they were divided by, by (word, language).

    `sums` is by (word, start, slot, language): a ring of places, of which the last of its slots is the place before
    the first unit. Every few places a ring is divided by its largest sum, so nothing underflows at any length.
    """
    n, length, most = lattice.shape
    ring, scale = sums.shape[2], np.zeros((n, chance.shape[1]))
    for j in range(length):
        new = np.zeros((n, sums.shape[1], chance.shape[1]))
        for k in range(1, most + 1):
            number = lattice[:, j, k - 1]
            has = np.flatnonzero(number >= 0)  # few of the longer runs are pieces
            if len(has):
                new[has] += sums[has, :, (j - k) % ring] * chance[number[has]][:, None, :]
        sums[:, :, j % ring] = new
        if j % _RESCALE == _RESCALE - 1:
            top = sums.max(axis=(1, 2))
            top[top == 0] = 1
            sums /= top[:, None, None, :]
            scale += np.log(top)
    return sums, scale


def _groups(units: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words of one length together: (their numbers, their units)."""
    lengths = ends - starts
    for length in np.unique(lengths):
        own = np.flatnonzero(lengths == length)
        for k in range(0, len(own), max(1, 100_000 // int(length))):
            some = own[k : k + max(1, 100_000 // int(length))]
            yield some, units[starts[some][:, None] + np.arange(length)]


def _log(x: np.ndarray) -> np.ndarray:
    return np.log(np.maximum(x, 1e-300))


def _run_score(units: np.ndarray, chance: np.ndarray, vocab: Pieces) -> np.ndarray:
    """Log probability by language of one long run of letters, summed over all segmentations as for a short word.

    The forward pass is linear, so windows of the run are worked on side by side: each from every place before it
    that a piece can reach back to, which gives a matrix, and the matrices are applied one after another.
    """
    ring, langs = vocab.longest, chance.shape[1]
    lattice = _lattice(units[None, :], vocab)[0]
    width = max(ring, int(np.sqrt(len(lattice))))
    lead = len(lattice) % width
    state = np.zeros((1, 1, ring, langs))
    state[0, 0, ring - 1] = 1
    state, scale = _advance(state, lattice[None, :lead], chance)
    at, total = np.roll(state[0, 0], -lead, axis=0), scale[0]  # slots in order of places
    windows = lattice[lead:].reshape(-1, width, ring)
    for k in range(0, len(windows), 256):
        own = windows[k : k + 256]
        unit = np.broadcast_to(np.eye(ring)[None, :, :, None], (len(own), ring, ring, langs)).copy()
        moves, scales = _advance(unit, own, chance)
        moves = np.roll(moves, -width, axis=2)
        for move, log in zip(moves, scales, strict=True):
            at = np.einsum("ql,qrl->rl", at, move)
            top = at.max(axis=0)
            top[top == 0] = 1
            at, total = at / top, total + log + np.log(top)
    return _log(at[-1]) + total


def word_scores(units: np.ndarray, starts: np.ndarray, ends: np.ndarray, model: Model) -> np.ndarray:
    """Log probabilities by (word, language)."""
    out, vocab = np.zeros((len(starts), len(model.langs))), pieces(model.path)
    long = ends - starts > _LONG
    for i in np.flatnonzero(long):
        out[i] = _run_score(units[starts[i] : ends[i]], model.chance, vocab)
    few = ends - starts <= _SHORT
    rest = np.flatnonzero(~long & ~few)
    for own, rows in _groups(units, starts[rest], ends[rest]):
        ring = min(vocab.longest, rows.shape[1])
        state = np.zeros((len(own), 1, ring, len(model.langs)))
        state[:, 0, -1] = 1
        state, scale = _advance(state, _lattice(rows, vocab), model.chance)
        out[rest[own]] = _log(state[:, 0, (rows.shape[1] - 1) % ring]) + scale
    short = np.flatnonzero(few)
    short = short[np.argsort(starts[short] - ends[short], kind="stable")]  # longest first
    part = np.cumsum(ends[short] - starts[short]) // _UNITS
    sums, lifted = prefix_sums(units), model.chance * (_LIFT ** vocab.lengths)[:, None]
    for own in np.split(short, np.flatnonzero(np.diff(part)) + 1) if len(short) else ():
        out[own] = _short_scores(sums, starts[own], ends[own] - starts[own], lifted, vocab)
    return out


def _short_scores(sums: np.ndarray, starts: np.ndarray, lengths: np.ndarray, lifted: np.ndarray, vocab: Pieces) -> np.ndarray:
    """Log probabilities by (word, language) of short words, longest first, from the prefix sums of their units.

    Probabilities are lifted by a constant a unit, so that products stay in the range of numbers.
    """
    most = int(lengths[0])
    many = np.searchsorted(-lengths, -np.arange(most + 1))  # words of more units than that, which are the first
    place = np.repeat(np.arange(most), many[:-1])
    word = np.concatenate([np.arange(n) for n in many[:-1]])
    edges = []  # by length of a piece: words, numbers, and where those that begin at each place are
    for k in range(1, min(vocab.longest, most) + 1):
        at = starts[word] + place
        has, number, longer = vocab.find_runs(span_sums(sums, at, at + k), k)
        if k == 1:  # a character that no piece covers stands alone
            every = np.full(len(word), len(vocab.words))
            every[has] = number
            has, number = slice(None), every
        edges.append((word[has], number, np.searchsorted(place[has], np.arange(most + 1))))
        longer &= lengths[word] - place > k
        word, place = word[longer], place[longer]
    out = np.zeros((len(starts), lifted.shape[1]))
    state = [np.ones(out.shape)]
    for j in range(most):
        _, number, cut = edges[0]
        new = state[j][: many[j]] * lifted[number[cut[j] : cut[j + 1]]]
        for k in range(2, min(len(edges), j + 1) + 1):
            has, number, cut = edges[k - 1]
            a, b = cut[j + 1 - k], cut[j + 2 - k]
            if a < b:
                own = has[a:b]
                new[own] += state[j + 1 - k].take(own, axis=0) * lifted.take(number[a:b], axis=0)
        state.append(new)
        out[many[j + 1] : many[j]] = _log(new[many[j + 1] :]) - (j + 1) * np.log(_LIFT)
    return out


def _learned_spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(word, start, end, core start, core end): words whole, longer ones as windows with context, whose cores make up the word."""
    cores = np.maximum(1, -(-(ends - starts) // _WINDOW))
    word = np.repeat(np.arange(len(starts)), cores)
    at = np.arange(len(word)) - np.repeat(np.cumsum(cores) - cores, cores)
    lo = starts[word] + at * _WINDOW
    hi = np.minimum(lo + _WINDOW, ends[word])
    return word, np.maximum(lo - _CONTEXT, starts[word]), np.minimum(hi + _CONTEXT, ends[word]), lo, hi


def _expected(units: np.ndarray, starts: np.ndarray, ends: np.ndarray, weights: np.ndarray, langs: np.ndarray, chance: np.ndarray, vocab: Pieces) -> np.ndarray:
    """Expected uses by (piece, language) of words that each have a weight and a language."""
    out = np.zeros(chance.shape)
    word, first, last, lo, hi = _learned_spans(starts, ends)
    with np.errstate(divide="ignore"):
        logs = np.log(chance)
    for own, rows in _groups(units, first, last):
        lattice, lang, weight = _lattice(rows, vocab), langs[word[own]], weights[word[own]]
        n, length, most = lattice.shape
        short = length <= _PLAIN  # products of so few don't leave the range of numbers
        add, times, one, zero = (np.add, np.multiply, 1.0, 0.0) if short else (np.logaddexp, np.add, 0.0, -np.inf)
        lift = _LIFT ** np.arange(1, most + 1) if short else np.zeros(most)
        edges = [(j, k, has, times((chance if short else logs)[lattice[has, j, k - 1], lang[has]], lift[k - 1])) for j in range(length) for k in range(1, min(most, j + 1) + 1) if len(has := np.flatnonzero(lattice[:, j, k - 1] >= 0))]
        ahead, behind = np.full((n, length + 1), zero), np.full((n, length + 1), zero)
        ahead[:, 0] = behind[:, length] = one
        for j, k, has, value in edges:
            ahead[has, j + 1] = add(ahead[has, j + 1], times(ahead[has, j + 1 - k], value))
        for j, k, has, value in reversed(edges):
            behind[has, j + 1 - k] = add(behind[has, j + 1 - k], times(behind[has, j + 1], value))
        for j, k, has, value in edges:
            begin = first[own[has]] + j + 1 - k
            has, value = (x[(begin >= lo[own[has]]) & (begin < hi[own[has]])] for x in (has, value))
            use = times(times(ahead[has, j + 1 - k], value), behind[has, j + 1])
            share = use / ahead[has, length] if short else np.exp(use - ahead[has, length])
            np.add.at(out, (lattice[has, j, k - 1], lang[has]), share * weight[has])
    return out


def train(docs: DataFrame, text_column: str = "text", lang_column: str = "lang", path: str | None = None, fit_rows: int = FIT_ROWS, rounds: int = ROUNDS) -> Model:
    """A model of the languages of the rows whose label isn't null; `fit_rows` of them are expected in the sample at most.

    Without labelled rows the model has no languages. Null and empty texts and texts without letters teach nothing but
    their language's share; repeated rows count as often as they occur and are sampled together. Runs of letters of
    over 256 units are learned from in windows of that size, each with 64 units of context on both sides.
    """
    path = path or default_path()
    every = [F.col(f"`{c.name}`") for c in docs.schema if not isinstance(c.dataType, (T.MapType, T.VariantType))]
    rows = docs.filter(F.col(lang_column).isNotNull() & F.col(text_column).isNotNull()).select(F.col(lang_column).alias("lang"), F.col(text_column).alias("text"), F.pmod(F.xxhash64(*every), F.lit(1 << 20)).alias("chosen"))
    per_lang = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs, total = tuple(sorted(per_lang)), sum(per_lang.values())
    if total > fit_rows:
        rows = rows.filter(F.col("chosen") < int((1 << 20) * fit_rows / total))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pandas as pd

        for b in batches:
            lang = np.array([langs.index(x) for x in b.column(0).to_pylist()], np.int64)
            for first, _, units, starts, ends, of in _words(b.column(1)):
                key = hash_spans(units, starts, ends) + lang[first + of].astype(np.uint64)
                each, _ = pd.factorize(key)
                if not len(each):
                    continue
                one = np.unique(each, return_index=True)[1]
                words = [units[s:e].tobytes().decode("utf-32-le") for s, e in zip(starts[one].tolist(), ends[one].tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict({"k": pa.array(lang[first + of[one]], pa.int32()), "word": words, "n": pa.array(np.bincount(each), pa.int64())})

    words = stage(rows.select("lang", "text").mapInArrow(lean(counted), "k int, word string, n bigint").groupBy("k", "word").agg(F.sum("n").alias("n")), "fit-words")
    vocab_size = len(pieces(path).words)
    chance = np.full((vocab_size + 1, len(langs)), 1 / (vocab_size + 1))
    chance[-1] = _LONE
    for _ in range(rounds if langs else 0):
        now = words.sparkSession.sparkContext.broadcast(chance)

        def expected(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            out = np.zeros(now.value.shape)
            for b in batches:
                text = b.column(1).to_pylist()
                units = np.frombuffer("".join(text).encode("utf-32-le"), np.uint32)
                ends = np.cumsum([*map(len, text)], dtype=np.int64)
                starts = ends - np.array([*map(len, text)], np.int64)
                out += _expected(units, starts, ends, b.column(2).to_numpy().astype(float), b.column(0).to_numpy().astype(np.int64), now.value, pieces(path))
            piece, lang = np.nonzero(out)
            yield pa.RecordBatch.from_pydict({"piece": pa.array(piece, pa.int32()), "k": pa.array(lang, pa.int32()), "uses": out[piece, lang]})

        found = words.mapInArrow(lean(expected), "piece int, k int, uses double").groupBy("piece", "k").agg(F.sum("uses").alias("uses")).toArrow()
        uses = np.full(chance.shape, _SMOOTH)
        uses[found["piece"].to_numpy(), found["k"].to_numpy()] += found["uses"].to_numpy()
        chance = uses / uses.sum(axis=0)
        chance[-1] = _LONE
    prior = np.log(np.array([per_lang[x] for x in langs], float) / max(1, total)) if langs else np.zeros(0)
    model = Model(path, langs, prior, chance)
    fitted = min(total, fit_rows)
    some = rows.filter(F.pmod(F.xxhash64("chosen", "text"), F.lit(1 << 20)) < (USUAL_ROWS << 20) // max(1, fitted)) if fitted > USUAL_ROWS else rows
    return replace(model, usual=_usual(some.select("lang", "text"), model)) if langs else model


def _usual(rows: DataFrame, model: Model) -> np.ndarray:
    """Mean and deviation, by language, of the log probability a letter of the fitted texts under their own language."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(shared.value)
        for b in batches:
            own = np.array([*map(scorer.model.langs.index, b.column(0).to_pylist())], np.int64)
            for first, letters, total in scorer.totals(b.column(1)):
                at = np.flatnonzero(letters >= FIT_LETTERS)
                yield pa.RecordBatch.from_pydict({"k": pa.array(own[first + at], pa.int32()), "x": total[at, own[first + at]] / letters[at]})

    found = rows.mapInArrow(lean(f), "k int, x double").groupBy("k").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd")).collect()
    out = np.tile([0.0, np.inf], (len(model.langs), 1))  # a language without such texts rejects nothing
    for r in found:
        out[r["k"]] = r["mean"], max(r["sd"], 0.05)
    return out


class _Scorer:
    """Scores texts block by block; words that it has seen lately are looked up."""

    def __init__(self, model: Model):
        self.model = model
        self.known, self.scores = np.zeros(0, np.uint64), np.zeros((0, len(model.langs)))  # hashes of words in order

    def _table(self, hashes: np.ndarray, units: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Log probabilities by (word, language) of distinct words."""
        at = np.searchsorted(self.known, hashes)
        seen = np.append(self.known, np.uint64(0))[at] == hashes
        seen &= at < len(self.known)
        out, new = np.empty((len(hashes), len(self.model.langs))), np.flatnonzero(~seen)
        out[seen] = self.scores[at[seen]]
        if len(new):
            out[new] = word_scores(units, starts[new], ends[new], self.model)
            if len(self.known) + len(new) > _KNOWN:  # the words of this block stay
                known, scores = hashes, out
            else:
                known, scores = np.concatenate([self.known, hashes[new]]), np.concatenate([self.scores, out[new]])
            order = np.argsort(known)
            self.known, self.scores = known[order], scores[order]
        return out

    def totals(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For runs of rows: (first row, letters of each, log probabilities by row and language)."""
        import pandas as pd

        m = self.model
        for first, n, units, starts, ends, of in _words(texts):
            if not len(starts):
                yield first, np.zeros(n), np.zeros((n, len(m.langs)))
                continue
            each, hashes = pd.factorize(hash_spans(units, starts, ends))
            one = np.empty(len(hashes), np.int64)
            one[each[::-1]] = np.arange(len(each))[::-1]
            table = self._table(hashes, units, starts[one], ends[one])
            total = np.stack([np.bincount(of, table[each, k], n) for k in range(len(m.langs))], axis=1)
            yield first, np.bincount(of, ends - starts - 1, n), total


def predict(docs: DataFrame, model: Model, text_column: str = "text", keep: list[str] | None = None, fit: bool = False) -> DataFrame:
    """The rows (columns `keep`, by default all) with lang_pred and score, and with `fit` a column of that name.

    score is the language's share of probability, 0 to 1. Texts that are null or have no letters are `und` with score
    0, and so is every text if the model has no languages. Languages that tie: the first by name. fit says how usual
    the text's log probability a letter is among labelled texts of its language, in standard deviations from their
    mean; null for texts of fewer than FIT_LETTERS letters. Names that the table has already get underscores appended.
    An empty table gives an empty result.
    """
    keep = docs.columns if keep is None else keep
    shared = docs.sparkSession.sparkContext.broadcast(model)
    carried = docs.select(*(F.col(f"`{c}`") for c in keep))
    names = [fresh(carried, n) for n in ("lang_pred", "score", "fit")[: 3 if fit else 2]]

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        scorer = _Scorer(m)
        for b in (whole.slice(k, _ROWS) for whole in batches for k in range(0, whole.num_rows, _ROWS)):
            lang, score, usual = np.full(b.num_rows, "und", object), np.zeros(b.num_rows), np.full(b.num_rows, np.nan)
            for first, letters, total in scorer.totals(b.column(at).fill_null("")) if m.langs else ():
                has = np.flatnonzero(letters)
                weighed = total[has] + m.log_prior
                share = np.exp(weighed - weighed.max(axis=1, keepdims=True))
                share /= share.sum(axis=1, keepdims=True)
                best = weighed.argmax(axis=1)
                lang[first + has], score[first + has] = np.array(m.langs, object)[best], share[np.arange(len(has)), best]
                mean, deviation = m.usual[best].T
                usual[first + has] = np.where(letters[has] >= FIT_LETTERS, (total[has, best] / letters[has] - mean) / deviation, np.nan)
            found = [pa.array(lang, pa.string()), pa.array(score), pa.array(usual, from_pandas=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *found[: len(names)]], [*keep, *names])

    rows, at = carried, keep.index(text_column) if text_column in keep else len(keep)
    if at == len(keep):  # a text that is kept isn't sent twice
        rows = docs.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text_column}`").alias(fresh(docs, "tl_text")))
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), f"`{names[0]}` string", *(f"`{n}` double" for n in names[1:])])
    return rows.mapInArrow(lean(f), schema)
