"""License near misses, HTML extraction, phrase mining and the filter audit, against hand-written and brute-force results."""

import collections
import html as H
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

# -- 7: license scans


def licenses(spark, *texts):
    from textloom.llm.license_scan import scan_licenses

    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = collections.defaultdict(set)
    for r in scan_licenses(df).collect():
        out[r.doc_id].add((r.license, r.rule))
    return [out[k] for k in range(len(texts))]


def test_mit_and_mit_0_are_told_apart(spark):
    grant = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so'
    notice = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    warranty = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'
    mit = f"{grant}, subject to the following conditions:\n\n{notice}\n\n{warranty}"
    filler = " ".join("This sentence is of nothing known." for _ in range(3000))
    got = licenses(
        spark, mit, mit.replace("permission notice shall", "permission notice (including the next paragraph) shall"), f"{grant}.\n\n{warranty}", f"{grant}, subject to the following conditions:\n\n{filler}\n\n{warranty}",
        f"{grant}, subject to the following conditions:\n\nA rule of our own here.\n\n{warranty}", f"{grant}.", notice, f"{grant}.\n{filler}\n{warranty}",
    )
    assert got[0] == got[1] == {("MIT", "mit-full-text")}
    assert got[2] == {("MIT-0", "mit-0-text")}
    assert got[3] == {("MIT", "mit-grant")}  # 3,000 sentences lie between
    assert got[4] == {("MIT", "mit-terms")}
    assert got[5] == got[7] == {("MIT-0", "mit-0-grant")}
    assert got[6] == set()


@pytest.mark.parametrize(("between", "whole"), [(0, True), (8, True), (9, False)])
def test_a_rule_skips_few_sentences(spark, between, whole):
    s = ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."]
    s += ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."]
    text = f"{s[0]} {s[1]} {' '.join('Some other words.' for _ in range(between))} {s[2]}"
    assert licenses(spark, text)[0] == ({("BSD-2-Clause", "bsd-2-clause-text")} if whole else {("BSD", "bsd-conditions")})


# -- 11: HTML extraction


def extract(spark, pages, **how):
    from textloom.llm.html_extract import extract_main_text

    df = spark.createDataFrame([(k, u, h) for k, (u, h) in enumerate(pages)], "page_id long, url string, html string")
    return {r.page_id: r for r in extract_main_text(df, **how).collect()}


def test_markup_says_what_is_the_article(spark):
    cases = [
        ("<html><head><title>t</title><style>p{}</style></head><body><nav><a href=x>menu</a></nav><article><h1>Head &amp; more</h1><p>One\n  two&nbsp;three<p>Four <b>bold</b>er<br>five</article><footer>foot</footer>", "Head & more\nOne two three\nFour bolder five"),
        ("<body><header>Site</header><main><p>a<script>var x='</p>';</script>b</p><aside>side</aside><form><p>mail</form><section class='comments'><article><p>I agree</p></article></section><p>c</main>", "ab\nc"),
        ("<article><p>text <button>Share</button> goes on</p><div class='ad-box'>buy</div><div id='cookie-notice'>cookies</div><p>end</p></article>", "text goes on\nend"),
        ("plain text, no tags", "plain text, no tags"),
        ("", ""),
        (None, ""),
        ("<nav><a>only menu</a></nav>", ""),
        ("<article><p>a &lt;b&gt; &#233;&#x20AC; &unknown; &am</p><!-- <p>no</p> --><p> </p></article>", "a <b> é€ &unknown; &am"),
        ("<p>unclosed <nav><ul><li><a>x</a><article><p>kept</article><p>tail", "kept"),
        ("<article><ul><li>one<li>two</ul><table><tr><td>c1<td>c2</table><blockquote>q</blockquote>loose</article>", "one\ntwo\nc1\nc2\nq\nloose"),
        ("<article>a < b and c > d<p x='1>2'>e</p></article></article></div>", "a < b and c > d\ne"),
        ("<body class='no-sidebar'><div class='content'><p>in</p></div><div class='related'>x</div>", "in"),
    ]
    got = extract(spark, [(None, h) for h, _ in cases])
    assert [got[k].text for k in range(len(cases))] == [t for _, t in cases]
    assert all(got[k].n_chars == len(t) for k, (_, t) in enumerate(cases))


def test_a_host_s_template_says_it_where_markup_does_not(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    pages, want = [], []
    for k in range(12):
        paragraphs = [" ".join(word() for _ in range(30)) for _ in range(rng.randrange(1, 5))]
        menu = "".join(f"<div><a href=/{word()}>{word()}</a></div>" for _ in range(rng.randrange(3, 7)))
        html = f"<html><body><div class=x1>Our Site</div><div class=x2>{menu}</div><div class=x3>{''.join(f'<p>{p}</p>' for p in paragraphs)}</div><div class=x4>All rights, 2020</div></body></html>"
        pages.append((f"http://h.example.com/{k}", html))
        want.append("\n".join(paragraphs))
    got = extract(spark, pages)
    assert [got[k].text for k in range(12)] == want
    # the same article on each page of a host isn't its template
    copies = [(f"http://c.example.com/{k}", "<body><div class=x3><p>the same text</p><p>on all pages</p></div></body>") for k in range(9)]
    assert {r.text for r in extract(spark, copies).values()} == {"the same text\non all pages"}


def test_constant_text_inside_articles(spark):
    pages = [(f"http://h.example.com/{k}", f"<body><article><p>{' '.join(f'w{k}x{j}' for j in range(40))}</p><p>Read this in our paper.</p></article></body>") for k in range(10)]
    assert all(r.text == " ".join(f"w{k}x{j}" for j in range(40)) for k, r in extract(spark, pages).items())
    few = extract(spark, pages[:4])
    assert all(r.text.endswith("\nRead this in our paper.") for r in few.values())


def test_html_rows_and_names(spark):
    from textloom.llm.html_extract import extract_main_text

    rows = [(1, "http://a/x", "<p>a</p>", "own"), (1, "http://a/x", "<p>a</p>", "own"), (None, None, None, None), (3, "nohost", "<article>" + "<p>long text</p>" * 20_000 + "</article>", "own")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = extract_main_text(df)
    assert got.columns == ["page_id", "url", "html", "text", "text_", "n_chars"] and got.count() == 4
    assert {r.page_id: r.n_chars for r in got.collect()} == {1: 1, None: 0, 3: 20_000 * 10 - 1}
    assert extract_main_text(df.limit(0)).count() == 0


def test_html_query(spark):
    from textloom.llm.queries import op11_html_extract

    sf = "/root/testdata/sf0.001"
    pages = {p.page_id: p.html for p in spark.read.parquet(f"{sf}/pages.parquet").collect()}

    def plain(h):
        body = h[h.index("<article>") + 9 : h.index("</article>")]
        return "\n".join(x for x in (" ".join(H.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split(r"</?p>|</?h1>", body)) if x)

    got = op11_html_extract(spark, sf).collect()
    assert {r.page_id: (r.text, r.n_chars) for r in got} == {k: (plain(h), len(plain(h))) for k, h in pages.items()}


# -- 12: phrases


def brute_phrases(rows, longest=4, least=30, overlap=80, top=2000):
    count, total = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = [w for w in re.split("[\x20\x09]+", piece) if w]
            total[lang] += len(words)
            for k in range(1, longest + 1):
                count.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    kept = {p: a for p, a in count.items() if len(p[1]) > 1 and a >= least}
    covered = {(lang, g[i : i + k]) for (lang, g), b in kept.items() for k in range(2, len(g)) for i in range(len(g) - k + 1) if 100 * b >= overlap * count[lang, g[i : i + k]]}
    out = []
    for (lang, g), a in kept.items():
        if (lang, g) not in covered:
            score, _, left, right = min((2_000_000 * a // (count[lang, g[:k]] + count[lang, g[k:]]), k, count[lang, g[:k]], count[lang, g[k:]]) for k in range(1, len(g)))
            out.append((lang, score, a, " ".join(g), left, right))
    result = set()
    for lang in {o[0] for o in out}:
        ranked = sorted((o for o in out if o[0] == lang), key=lambda o: (-o[1], -o[2], o[3].encode()))
        result |= {(lang, n, p, a, left, right, total[lang], score) for n, (_, score, a, p, left, right) in enumerate(ranked[:top], 1)}
    return result


def phrase_rows(seed=3, n=150):
    rng = random.Random(seed)
    words = ["New", "york", "City", "of", "the", "é", "É", "a-b", "x"]
    rows = [(rng.choice(["en", "de", None, "und"]), "".join(rng.choice([*words, "new york city", "of the"]) + rng.choice([" ", " ", " ", "\t", ". ", ",", "\n", "  "]) for _ in range(rng.randrange(80)))) for _ in range(n)]
    return [*rows, ("en", None), ("en", ""), (None, "  ...  "), ("en", "x x x x x x x x " * 400), ("en", "la " * 3000), *rows[:9]]


def test_phrases_of_any_length_meet_blocks_once(spark, monkeypatch):
    from textloom.llm import phrases as P

    rng = random.Random(12)
    rows = [("en", " ".join(rng.choice("a b c d é".split()) for _ in range(400)) + ", " + "u v w x y z. " * 9) for _ in range(12)]
    joined, cogroup = [], type(spark.range(1).groupBy("id")).cogroup
    monkeypatch.setattr(type(spark.range(1).groupBy("id")), "cogroup", lambda self, other: joined.append(1) or cogroup(self, other))
    monkeypatch.setattr(P, "BLOCK_WORDS", 700)
    df = spark.createDataFrame(rows, "lang string, text string")
    got = {tuple(r) for r in P.mine_phrases(df, longest=6, least=5).collect()}
    assert got == brute_phrases(rows, 6, 5) and any(len(r[2].split()) == 6 for r in got)
    assert len(joined) == 1  # names of words only are joined back to the blocks: once, not once a level


@pytest.mark.parametrize(("least", "overlap", "top", "block"), [(30, 80, 2000, 1 << 21), (5, 50, 7, 100), (2, 100, 2000, 1)])
def test_phrases(spark, monkeypatch, least, overlap, top, block):
    from textloom.llm import phrases as P

    monkeypatch.setattr(P, "BLOCK_WORDS", block)
    monkeypatch.setattr(P, "ROWS", 13)
    rows = phrase_rows()
    df = spark.createDataFrame([(*r, "own", "own") for r in rows], "lang string, text string, id string, phrase string").repartition(3)
    got = P.mine_phrases(df, least=least, overlap=overlap, top=top)
    found = [tuple(r) for r in got.collect()]
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and len(found) == len(set(found))
    assert set(found) == brute_phrases(rows, 4, least, overlap, top)


def test_phrases_of_nothing(spark):
    from textloom.llm.phrases import mine_phrases

    df = spark.createDataFrame([("en", None), (None, "one two")], "lang string, text string")
    assert mine_phrases(df).count() == 0 == mine_phrases(df.limit(0)).count()
    with pytest.raises(ValueError):
        mine_phrases(df, longest=1)


def test_phrase_scores_are_exact(spark):
    # counts whose product with 2,000,000 passes 64 bits, through the query's own expression
    cut = "(cast(a as decimal(20, 0)) * 2000000) div (h + t)"
    a, h, t = 4_611_686_018_427_387_903, 4_611_686_018_427_387_904, 4_611_686_018_427_387_903
    got = spark.createDataFrame([(a, h, t)], "a long, h long, t long").select(F.expr(cut).alias("s")).first().s
    assert got == 2_000_000 * a // (h + t)


def test_long_pieces_and_slices(spark, monkeypatch):
    from textloom.llm import phrases as P

    monkeypatch.setattr(P, "SLICE", 50)
    rows = [("en", "one two three four five six seven eight nine ten. " * 40), ("en", "no marks at all in this one " * 60)]
    assert {tuple(r) for r in P.mine_phrases(spark.createDataFrame(rows, "lang string, text string")).collect()} == brute_phrases(rows)


# -- 13: filter audit


def brute_audit(docs, labels):
    first = {}
    for d, t, _ in docs:
        if d is not None:
            first[t or ""] = min(first.get(t or "", d), d)
    good, toxic = {d for d, q, _ in labels if q == 1}, {d for d, _, x in labels if x == 1}
    rows = collections.defaultdict(list)
    for d, text, source in docs:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0d]+", t)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": d is not None and d > first.get(t, d)}
        rows[source or ""].append(({k for k, v in fails.items() if v}, d is not None and d in good, d is not None and d in toxic))
    out, orders = [], ["".join(o) for o in itertools.permutations("ABCDE")]
    for part, own in rows.items():
        shapley = collections.Counter()
        each = []
        for order in orders:
            left = own
            for k, f in enumerate(order, 1):
                gone = [r for r in left if f in r[0]]
                left = [r for r in left if f not in r[0]]
                shapley[f] += len(gone)
                fail = sum(f in r[0] for r in own)
                each.append((f, (part, order, k, len(left), len(gone), fail - len(gone), sum(r[0] == {f} for r in own), sum(r[1] for r in gone), sum(r[2] for r in gone))))
        out += [(*row, shapley[f]) for f, row in each]
    return sorted(out)


def audit_rows():
    rng = random.Random(9)
    texts = [" ".join(rng.choice(["word", "Word", "other", "x#", "é", "ABC"]) + str(rng.randrange(rng.choice([3, 400]))) for _ in range(rng.choice([3, 150, 230]))) for _ in range(40)]
    docs = [(k, rng.choice([*texts, None, ""]), rng.choice(["s1", "s2", None, ""])) for k in range(120)]
    docs += [docs[5], docs[5], (None, docs[7][1], "s1"), (None, None, "only"), (500, "x " * 100_000, "long")]
    labels = [(rng.randrange(140), rng.choice([0, 1, None]), rng.choice([0, 1])) for _ in range(90)] + [(None, 1, 1)]
    return docs, labels


def test_filter_audit(spark):
    from textloom.llm.filter_audit import audit_orders, flag_failures

    docs, labels = audit_rows()
    df = spark.createDataFrame([(*r, "own") for r in docs], "doc_id long, text string, source string, part string")
    got = audit_orders(flag_failures(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    assert sorted(map(tuple, got.collect())) == brute_audit(docs, labels)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_filter_audit_of_few_filters_and_no_rows(spark):
    from textloom.llm.filter_audit import audit_orders, flag_failures

    flags = spark.createDataFrame([("p", True, False, True, False), ("p", True, True, False, True), ("q", False, False, False, False)], "part string, A boolean, B boolean, good boolean, toxic boolean")
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in audit_orders(flags, "AB").collect()}
    assert got["p", "AB", 1] == (0, 2, 0, 1, 1, 1, 3) and got["p", "AB", 2] == (0, 0, 1, 0, 0, 0, 1) and got["p", "BA", 2] == (0, 1, 1, 1, 1, 0, 3)
    assert got["q", "AB", 2] == (1, 0, 0, 0, 0, 0, 0) and len(got) == 8
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert audit_orders(flag_failures(none, spark.createDataFrame([], "doc_id long, quality int, toxic int"))).count() == 0
    with pytest.raises(ValueError):
        audit_orders(flags, "AA")


# -- what reaches Python, and what tasks send


def test_a_kept_text_goes_to_python_once(spark, monkeypatch):
    from textloom.llm import language_id as L

    df = spark.createDataFrame([(k, f"some words of text number {k}", "en") for k in range(1200)], "doc_id long, text string, lang string").coalesce(1)
    model, sent, plain = L.train(df), [], type(df).mapInArrow
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, schema, *a, **b: sent.append((self.columns, f)) or plain(self, f, schema, *a, **b))
    rows = L.predict(df, model, fit=True).collect()
    columns, f = sent[-1]
    assert columns == ["doc_id", "text", "lang"] and {r.text for r in rows} == {r.text for r in df.collect()} and {r.lang_pred for r in rows} == {"en"}
    assert [b.num_rows for b in f(df.toArrow().combine_chunks().to_batches())] == [500, 500, 200]  # in small batches, however large those that come
    alone = L.predict(df, model, keep=["doc_id"])
    assert sent[-1][0] == ["doc_id", "tl_text"] and alone.columns == ["doc_id", "lang_pred", "score"]


def test_splitting_needs_no_vocabulary():
    import pickle

    from textloom.llm.bpe import Vocabulary, default_path

    vocab = Vocabulary(default_path())
    assert not {"pieces", "_model", "_text"} & vars(vocab).keys()
    assert len(pickle.dumps(vocab.specials)) < 10_000 and vocab.specials.pattern.fullmatch("<|endoftext|>")
    assert vocab.text_of(vocab.encode_word("word")) == "word"


def test_pipeline_sends_small_batches(spark):
    import corpus_pipeline as C

    before = spark.conf.get(C._BATCH)
    try:
        for rows, after in ((10_000, C.BATCH_ROWS), (0, C.BATCH_ROWS), (7, 7)):
            spark.conf.set(C._BATCH, rows)
            C.tokenize(spark, spark.createDataFrame([(1, "a b")], "doc_id long, text string"), "")
            assert int(spark.conf.get(C._BATCH)) == after
    finally:
        spark.conf.set(C._BATCH, before)


def test_phrases_are_added_up_before_they_are_sent(spark, monkeypatch):
    from textloom.llm import phrases as P

    sent, counted = spark.sparkContext.accumulator(0), P._count_phrases

    def observed(*args):
        f = counted(*args)

        def run(batches):
            for b in f(batches):
                sent.add(b.num_rows * (args[0] > 2))
                yield b

        return run

    monkeypatch.setattr(P, "_count_phrases", observed)
    monkeypatch.setattr(P, "BLOCK_WORDS", 100)
    rows = [(lang, f"{lang} one two three four. " * 20) for lang in ("en", "de") for _ in range(100)]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    got = {tuple(r) for r in P.mine_phrases(df).collect()}
    assert got == brute_phrases(rows)
    assert sent.value == 2 * (3 + 2)  # a row for each phrase of three words or four, not one for each of its 100 blocks


def test_words_are_scored_without_looking_at_every_run(monkeypatch):
    import numpy as np

    from textloom.llm import language_id as L

    rng, path = random.Random(5), L.default_path()
    vocab, chance = L.pieces(path), np.random.default_rng(5)
    chance = chance.random((len(vocab.words) + 1, 3))
    model = L.Model(path, ("x", "y", "z"), np.zeros(3), chance / chance.sum(axis=0))
    words = ["▁" + "".join(rng.choice("abcdefghijklmnopqrstuvwxyzé漢") for _ in range(rng.randrange(1, 30))) for _ in range(3000)]
    words += ["▁größe", "▁international", "▁" + "e" * 23, "▁" + "e" * 24, "▁" + "e" * 40, "▁漢漢漢"]
    units = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    ends = np.cumsum([*map(len, words)])
    starts, looked, plain = ends - np.array([*map(len, words)]), [], L.hash_spans
    monkeypatch.setattr(L, "hash_spans", lambda u, a, b: looked.append(len(a)) or plain(u, a, b))
    if one := getattr(L, "span_sums", None):
        monkeypatch.setattr(L, "span_sums", lambda s, a, b: looked.append(len(a)) or one(s, a, b))
    short = np.array([len(w) <= 24 for w in words])
    got = L.word_scores(units, starts[short], ends[short], model)
    runs = sum(min(vocab.longest, len(w) - k) for w in words if len(w) <= 24 for k in range(len(w)))
    assert sum(looked) < runs / 2
    monkeypatch.setattr(L, "_SHORT", 0, raising=False)  # one run at a time, with sums that are scaled
    assert np.allclose(got, L.word_scores(units, starts[short], ends[short], model), rtol=1e-12)
    monkeypatch.undo()
    monkeypatch.setattr(L, "_UNITS", 50)  # words summed in many parts, beside long ones
    whole = L.word_scores(units, starts, ends, model)
    assert np.allclose(whole[short], got, rtol=1e-12) and np.isfinite(whole).all()
    monkeypatch.setattr(L, "_KNOWN", 10)
    texts, scorer = [" ".join(w[1:] for w in words[k : k + 7]) for k in range(0, 70, 7)], L._Scorer(model)
    both = [np.concatenate([t for _, _, t in scorer.totals(L.pa.array(some))]) for some in (texts[:6], texts[3:], texts)]
    assert np.allclose(np.concatenate([both[0], both[1][3:]]), both[2], rtol=1e-12)


def test_a_task_sends_what_its_blocks_share_once():
    import numpy as np

    from textloom.llm import phrases as P

    keys = [np.arange(10), np.arange(10) * 3]
    same = list(P._added(((keys, np.full(10, 2)) for _ in range(100)), 25))
    assert sum(len(n) for _, n in same) == 10 and all((n == 200).all() for _, n in same)  # not once every 25 rows
    other = list(P._added((([np.arange(10) + 10 * k], np.ones(10, int)) for k in range(100)), 25))
    assert sorted(np.concatenate([k[0] for k, _ in other])) == list(range(1000)) and max(len(n) for _, n in other) <= 34
    assert list(P._added(iter([]), 25)) == []


def test_a_language_meets_in_few_tasks_however_large_the_input(spark, monkeypatch):
    from textloom.llm import phrases as P

    monkeypatch.setattr(P, "TASK_WORDS", 1000)
    most = max(P.TASKS, 2 * spark.sparkContext.defaultParallelism)
    for blocks in (20, 200):
        rows = [("abcd"[k % 4], k, 1000) for k in range(4 * blocks)]
        tasks, dealt = P._dealt(spark.createDataFrame(rows, "lang string, block long, total long"))
        got = {r.block: r.task for r in dealt.collect()}
        assert tasks == most and set(got) == set(range(4 * blocks)) and set(got.values()) == set(range(tasks))
        for k in range(4):
            assert len({got[b] for b in range(k, 4 * blocks, 4)}) <= tasks / 4 + 2
    assert P._dealt(spark.createDataFrame([], "lang string, block long, total long"))[0] == 1
    rows = [(lang, f"{lang} one two three four. " * 20) for lang in "abcd" for _ in range(100)]
    monkeypatch.setattr(P, "BLOCK_WORDS", 100)
    assert {tuple(r) for r in P.mine_phrases(spark.createDataFrame(rows, "lang string, text string")).collect()} == brute_phrases(rows)


def test_parts_of_a_block_end_where_pieces_do():
    import numpy as np

    from textloom.llm import phrases as P

    rng = random.Random(8)
    for most in (1, 5, 40, 10_000):
        seq = np.array([x for _ in range(60) for x in [*range(1, rng.choice([2, 4, 9, 90])), 0]], np.int32)
        parts = P._parts(seq, most)
        assert np.array_equal(np.concatenate(parts), seq) and all(p[-1] == 0 for p in parts)
        assert all(len(p) <= most or (p[:-1] > 0).all() for p in parts)  # only a single piece is longer
    assert P._parts(np.zeros(0, np.int32), 5) == [] and len(P._parts(np.arange(1, 50, dtype=np.int32), 5)) == 1


def test_phrases_hold_little_at_a_time(spark, monkeypatch):
    import textloom.llm._bloom as B
    from textloom.llm import phrases as P

    chained, before_shuffles = [], []
    large = [spark.sparkContext.accumulator(0) for _ in range(3)]
    batch, part = getattr(P, "BATCH", 4), 60

    def observed(make):
        def made(*args):
            f = make(*args)

            def run(batches):
                def seen():
                    for b in batches:
                        large[0].add(1)
                        large[1].add(b.num_rows > batch)
                        large[2].add(sum(n > part for n in b.column("size").to_pylist()))
                        yield b

                yield from f(seen())

            return run

        return made

    def staged(df, label, *args, stage=P.stage, **kw):
        if label in ("frequent", "promising"):
            plan = df._jdf.queryExecution().executedPlan().toString()
            before_shuffles.append("HashAggregate" in plan[plan.rindex("Exchange") :])
        return stage(df, label, *args, **kw)

    def mapped(self, *args, f=type(spark.range(1)).mapInArrow, **kw):
        chained.append(self._jdf.queryExecution().optimizedPlan().toString().split("\n")[0].startswith("MapInArrow"))
        return f(self, *args, **kw)

    for name in ("_count_phrases", "_count_hashes"):
        monkeypatch.setattr(P, name, observed(getattr(P, name)))
    monkeypatch.setattr(P, "stage", staged)
    monkeypatch.setattr(P, "PART", part, raising=False)
    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", mapped)
    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
    session = [spark.conf.get(n) for n in names]
    rows = [(lang, f"{lang} one two three four, of the five. " * 20) for lang in ("en", "de") for _ in range(100)]
    got = {tuple(r) for r in P.mine_phrases(spark.createDataFrame(rows, "lang string, text string")).collect()}
    assert got == brute_phrases(rows) and [spark.conf.get(n) for n in names] == session
    assert large[0].value > 0 == large[1].value == large[2].value  # neither a whole block nor all of a task's rows at once
    assert chained and not any(chained)  # one Python process a task, not two
    assert len(before_shuffles) == 5 and not any(before_shuffles)  # tasks have added up: no table in the JVM for it again
    assert B.build(spark.createDataFrame([(1, 2)], "w1 int, w2 int"), P.filter_bits(1), 1, P._hashes).any()
