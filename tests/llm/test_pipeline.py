"""The pipeline's rows against stages written plainly in Python, with nulls, empty and long texts, ties and repeated rows."""

import collections
import random
import re
from functools import lru_cache

import numpy as np
import regex

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def in_a_language(rows, model, least_score, least_fit, letters_told):
    """Rows whose text has letters, a language with enough of the probability, and letters that are usual in it."""
    from textloom.llm.language_id import pieces

    number, longest = {w: i for i, w in enumerate(pieces(model.path).words)}, pieces(model.path).longest

    @lru_cache(None)
    def score(word):
        sums, log = [np.ones(len(model.langs))], np.zeros(len(model.langs))
        for j in range(1, len(word) + 1):
            total = np.zeros(len(model.langs))
            for i in range(max(0, j - longest), j):
                at = number.get(word[i:j], len(number) if j - i == 1 else None)
                if at is not None:
                    total = total + sums[i] * model.chance[at]
            sums.append(total)
            if j % 8 == 0:  # scaled, as products of many leave the range of numbers
                top = sums[-1]
                sums, log = [s / top if k > j - longest else s for k, s in enumerate(sums)], log + np.log(top)
        return log + np.log(sums[-1])

    out = []
    for r in rows:
        words = regex.findall(r"\p{L}+", (r[1] or "").lower())
        letters = sum(map(len, words))
        if not letters:
            continue
        total = sum(score("▁" + w) for w in words)
        weighed = total + model.log_prior
        best = weighed.argmax()
        share = 1 / np.exp(weighed - weighed[best]).sum()
        mean, deviation = model.usual[best]
        if share >= least_score and (letters < letters_told or (total[best] / letters - mean) / deviation >= least_fit):
            out.append(r)
    return out


def one_of_equal(rows):
    best = {}
    for r in rows:
        key = (r[1] or "").translate(LOWER)
        if key not in best or (r[0] is not None and (best[key][0] is None or r[0] > best[key][0])):
            best[key] = r
    return [*best.values()]


def one_of_near(rows, width=5, percent=80):
    sets = []
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", r[1].translate(LOWER))
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * (len(a) + len(b) - len(a & b)):
                up[find(i)] = find(j)
    best = {}
    for i, r in enumerate(rows):
        root = find(i)
        if root not in best or (best[root][0] is None, best[root][0]) > (r[0] is None, r[0]):
            best[root] = r
    return [*best.values()]


def without_leaks(rows, items):
    """Rows in which no window of 13 words of an item has 11 of its words at their places; items of the fixture are no shorter."""
    number = collections.defaultdict(lambda: len(number))
    words = lambda t: np.array([number[w] for w in re.findall(r"\w+", (t or "").lower())], int)
    tests, out = [words(t) for t in items], []
    for r in rows:
        own, hit = words(r[1]), False
        for item in tests:
            same = own[:, None] == item[None, :]
            for a in range(len(item) - 12):
                n = len(own) - 12
                if n > 0 and (sum(same[q : n + q, a + q].astype(int) for q in range(13)) >= 11).any():
                    hit = True
        if not hit:
            out.append(r)
    return out


def fixture(spark, folder):
    rng = random.Random(8)
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()]
    bench = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").orderBy("item_id").limit(6).collect()]
    clean = [r for r in rows if r[1] and 60 < len(r[1].split()) < 400]
    row = lambda i, t, lang=None: (i, t, lang, None, None)
    passage = re.findall(r"\w+", bench[0][1])[:13]
    passage[4] = passage[9] = "zzzz"
    planted = " ".join([*clean[3][1].split()[:20], *passage, *clean[4][1].split()[:20]])
    near = clean[5][1].split()
    near[len(near) // 2] = "zzzz"
    words = [w for r in clean for w in r[1].split()]
    rows += [
        row(9000, None), row(9001, ""), row(9002, "12 ! 34"), row(None, " ".join(rng.sample(words, 80))), row(None, None), row(9003, clean[0][1].upper()),
        row(9004, " ".join(near)), row(9005, planted), row(9006, "жщъыэ " * 40), row(9007, " ".join(rng.choices(words, k=30_000))), (None, "", None, None, None),
        clean[1], clean[1], row(9008, "a" * 5000), row(9009, clean[2][1].split()[0]),
    ]
    bench += [bench[1], (None, None), (7000, "")]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, bench


def test_pipeline_by_brute_force(spark, tmp_path):
    import corpus_pipeline
    from public_tokenizers import path
    from tokenizers import Tokenizer

    from textloom.llm.language_id import FIT_LETTERS, train

    rows, bench = fixture(spark, tmp_path)
    items = [t for _, t in bench if t]
    assert min(len(re.findall(r"\w+", t)) for t in items) >= 13
    model = train(spark.read.parquet(f"{tmp_path}/documents.parquet"), "text", "lang")
    taken = in_a_language(rows, model, corpus_pipeline.LEAST_SCORE, corpus_pipeline.LEAST_FIT, FIT_LETTERS)
    apart = one_of_equal(taken)
    lone = one_of_near(apart)
    left = without_leaks(lone, items)
    ids_of = lambda some: {r[0] for r in some}
    # each stage decides something here, and the planted rows go where they should
    assert {9000, 9001, 9002, 9006} <= ids_of(rows) - ids_of(taken) and len(apart) < len(taken) and len(lone) < len(apart) and len(left) < len(lone)
    assert 9004 in ids_of(apart) - ids_of(lone) and 9005 in ids_of(lone) - ids_of(left) and {None, 9007} <= ids_of(left)

    tok = Tokenizer.from_file(path("byte_bpe_50k.json"))
    tok.no_truncation()
    tok.no_padding()
    expected = collections.Counter()
    for r in left:
        ids = tok.encode(r[1], add_special_tokens=False).ids
        expected[r[0], len(ids), np.array(ids, "<u4").tobytes(), tok.decode(ids, skip_special_tokens=False)] += 1
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_tokens", "ids", "decoded"]
    found = collections.Counter((r.doc_id, r.n_tokens, bytes(r.ids), r.decoded) for r in got.collect())
    assert sorted({str(k[0]) for k in found - expected}) == [] and sorted({str(k[0]) for k in expected - found}) == []


def test_pipeline_of_nothing(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_tokens", "ids", "decoded"] and out.count() == 0
