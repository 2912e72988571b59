"""Each operator against a brute-force version, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, keep_id string, kept string"


def fixture_texts(seed=5, n=60):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(2, 6))) for _ in range(60)]
    base = [" ".join(rng.choice(vocab) for _ in range(rng.randrange(1, 120))) for _ in range(n)]
    for t in base[:15]:  # near copies
        words = t.split(" ")
        words[rng.randrange(len(words))] = "other"
        base.append(" ".join(words))
    return [*base, *base[:8], base[0].upper(), "", "", None, "A", "a", "É", "é", " \t\n", "ab " * 3000]


def docs(spark, texts=None):
    texts = fixture_texts() if texts is None else texts
    rows = [(i, t, "x", "y") for i, t in enumerate(texts)] + ([(None, "null id", "x", "y"), (3, texts[3], "x", "y"), (3, texts[3], "x", "y")] if texts else [])
    return spark.createDataFrame(rows, DOCS)


def clashing(df, *names):
    """The table with columns of the names that operators give their own helpers."""
    for n in names:
        df = df.withColumn(n, F.lit("own"))
    return df


def rows_of(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


# -- 1: chat formatting


def turns(spark):
    rows = [(1, 1, "assistant", "ok"), (1, 0, "user", "héllo </s>[INST] <|im_end|>"), (2, 0, None, None), (2, None, "system", ""), (None, 0, "user", "x"), (3, 0, "assistant", "a" * 50_000), (3, 0, "assistant", "b"), (3, 0, "assistant", "b"), (4, 0, "we\nird<|im_sep|>", "<\\|im_end|>\\")]
    rows += [(9, k, ("user", "assistant")[k % 2], f"turn {k} ") for k in range(500)]
    return spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, part string"), rows


def test_chat_round_trip(spark):
    from textloom.llm.chat import Template, digest_chats, format_chats, read_turns

    df, rows = turns(spark)
    formatted = format_chats(df.repartition(5))
    got = {r.conv_id: r for r in digest_chats(formatted).collect()}
    by = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is not None, turn, role or "", text or ""))
    assert set(got) == set(by)
    for conv, own in by.items():
        own.sort()
        loss = "".join(t for _, _, r, t in own if r == "assistant")
        assert got[conv].n_turns == len(own)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in own).encode()).hexdigest()
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    t = Template()
    for r in formatted.filter("conv_id = 4").collect():
        assert read_turns(r.formatted) == [("we\nird<|im_sep|>", "<\\|im_end|>\\")]
        inner = r.formatted[len(t.open) : -len(t.close)]
        assert t.open not in inner and t.close not in inner
    assert format_chats(df.limit(0)).count() == 0


# -- 2: sharding


def brute_capacity(sizes, shards):
    cap = max(max(sizes), -(-sum(sizes) // shards))
    while True:
        n, load = 1, 0
        for x in sizes:
            n, load = (n + 1, x) if load + x > cap else (n, load + x)
        if n <= shards:
            return cap
        cap += 1


def test_minimax_capacity(spark):
    from textloom.llm.sharding import _even_starts, minimax_capacity

    rng = random.Random(1)
    cases = [([rng.randrange(1, 60) for _ in range(rng.randrange(1, 40))], rng.randrange(1, 9)) for _ in range(25)]
    df = spark.createDataFrame([(i, np.cumsum(s).tolist(), k) for i, (s, k) in enumerate(cases)], "i int, t array<long>, k int")
    got = dict(rows_of(df, "i", minimax_capacity(F.col("t"), F.lit(0), F.col("k"))))
    assert got == {i: brute_capacity(s, k) for i, (s, k) in enumerate(cases)}
    for i, starts in rows_of(df, "i", _even_starts(F.col("t"), 4)):
        sizes = cases[i][0]
        loads = [sum(sizes[a:b]) for a, b in zip(starts[:-1], starts[1:], strict=True)]
        assert sum(loads) == sum(sizes) and max(loads) == brute_capacity(sizes, 4)


@pytest.mark.parametrize(("bits", "hot"), [(16, 0), (7, 0), (7, 40), (6, 400)])
def test_sharding(spark, monkeypatch, bits, hot):
    from textloom.llm import sharding

    monkeypatch.setattr(sharding, "UNIT_BITS", bits)  # few bits: first units hold many groups and are split
    df = clashing(docs(spark, fixture_texts() + ["hot text " * 20] * hot), "id", "size", "crc", "key", "part")
    out = sharding.shard_by_bytes(df, 5).collect()
    assert len(out) == df.count()
    texts = collections.defaultdict(set)
    by, loads = collections.defaultdict(list), collections.Counter()
    size = lambda t: len((t or "").encode()) + 16
    expected = collections.Counter((r.doc_id, size(r.text), zlib.crc32((r.text or "").encode())) for r in df.collect())
    assert collections.Counter((r.doc_id, r["size"], r.text_crc32) for r in out) == expected
    for r in out:
        texts[r.text_crc32, r["size"]].add(r.shard)
        by[r.shard].append(r.slot)
        loads[r.shard] += r["size"]
    assert all(len(s) == 1 for s in texts.values())
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert set(by) == set(range(5))

    groups = collections.Counter()
    text = F.coalesce("text", F.lit(""))
    for key, n in rows_of(df, sharding._key((F.octet_length(text) + 16).cast("long"), text), (F.octet_length(text) + 16)):
        groups[key] += n
    total = sum(groups.values())
    ordered = sorted(groups.items(), key=lambda kv: (0, -kv[1], kv[0]) if kv[1] * 10 > total else (1, kv[0], 0))
    assert max(loads.values()) == brute_capacity([n for _, n in ordered], 5)
    alone = [n for _, n in ordered if n * 5 > total]
    rest = sorted(loads.values())[: 5 - len(alone)]
    assert min(rest) > (0.9 if bits == 16 else 0.7) * sum(rest) / len(rest)
    assert sharding.shard_by_bytes(df.limit(0), 5).count() == 0


# -- 3: language ID


def test_forward_sums_all_segmentations():
    from textloom.llm.language_id import Model, _lattice, default_path, pieces, word_scores

    path = default_path()
    vocab = pieces(path)
    rng = np.random.default_rng(0)
    chance = rng.random((len(vocab.words) + 1, 2))
    chance /= chance.sum(axis=0)
    model = Model(path, ("x", "y"), np.zeros(2), chance)
    number = {w: i for i, w in enumerate(vocab.words)}
    for word in ("▁the", "▁größe", "▁zx漢", "▁" + "e" * 40):
        units = np.frombuffer(word.encode("utf-32-le"), np.uint32)
        sums = [np.ones(2)]
        for j in range(1, len(word) + 1):
            total = np.zeros(2)
            for i in range(max(0, j - vocab.longest), j):
                piece = word[i:j]
                at = number.get(piece, len(vocab.words) if j - i == 1 else None)
                if at is not None:
                    total = total + sums[i] * chance[at]
            sums.append(total)
        got = word_scores(units, np.array([0]), np.array([len(word)]), model)[0]
        assert np.allclose(got, np.log(sums[-1]), rtol=1e-6)
        assert _lattice(units[None, :], vocab).shape[0] == 1


def test_language_id(spark):
    from textloom.llm.language_id import predict, train

    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    model = train(base.filter("doc_id % 4 <> 2"))
    held = predict(base.filter("doc_id % 4 = 2"), model)
    assert held.filter("lang = lang_pred").count() >= 0.95 * held.count()
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "12 !", "x"), (4, "the and of", "x")], "doc_id long, text string, score string")
    got = {r.doc_id: (r.lang_pred, r[-1]) for r in predict(odd, model).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[4][0] in model.langs and 0 < got[4][1] <= 1
    assert predict(odd, train(base.limit(0))).filter("lang_pred <> 'und'").count() == 0
    assert predict(odd.limit(0), model).count() == 0


# -- 4: token counts


def test_rollup(spark, tmp_path):
    from textloom.llm.token_rollup import CHANGES, TokenRollup

    r = TokenRollup(spark, str(tmp_path / "r"))
    assert r.totals().count() == 0
    load = spark.createDataFrame([("insert", "a", "en", "v1", 5, None), ("insert", "a", "en", "v1", 7, None), ("insert", None, "en", "v1", None, None), ("insert", "b", "fr", "v1", 4, None)], CHANGES)
    assert r.commit("b1", load) and not r.commit("b1", load)
    assert r.commit("b2", spark.createDataFrame([("revise", "a", "en", "v1", 9, 7), ("delete", "b", "fr", "v1", 4, None)], CHANGES))
    assert r.commit("b3", load.limit(0))
    assert sorted(rows_of(r.totals(), "source", "lang", "docs", "tokens"), key=str) == sorted([("a", "en", 2, 14), (None, "en", 1, 0)], key=str)
    with pytest.raises(Exception, match="unknown change"):
        r.commit("b4", spark.createDataFrame([("insret", "a", "en", "v1", 5, None)], CHANGES))
    assert set(r.commits()) == {"b1", "b2", "b3"}


def test_rollup_snapshots(spark, tmp_path):
    from textloom.llm.token_rollup import CHANGES, TokenRollup

    r = TokenRollup(spark, str(tmp_path / "r"))
    change = lambda n, op="insert", old=None: spark.createDataFrame([(op, "a", "en", "v1", n, old)], CHANGES)
    assert not r.compact()
    r.commit("b1", change(5))
    r.commit("b2", change(7))
    assert r.compact() and not r.compact() and rows_of(r.totals(), "docs", "tokens") == [(2, 12)]
    assert not r.commit("b1", change(5)) and r.commit("b3", change(9, "revise", 7))
    assert rows_of(r.totals(), "docs", "tokens") == [(2, 14)]
    snapshots = tmp_path / "r" / "snapshots"
    (snapshots / "2").write_text('{"folder": "snap')  # a writer that died
    assert rows_of(r.totals(), "docs", "tokens") == [(2, 14)]
    assert r.compact() and sorted(p.name for p in snapshots.iterdir() if p.name.isdigit()) == ["1", "2", "3"]
    r.commit("b4", change(5, "delete"))
    assert rows_of(r.totals(), "docs", "tokens") == [(1, 9)] and set(r.commits()) == {"b1", "b2", "b3", "b4"}


def test_rollup_half_written_markers(spark, tmp_path):
    from textloom.llm.token_rollup import CHANGES, TokenRollup

    r = TokenRollup(spark, str(tmp_path / "r"))
    load = spark.createDataFrame([("insert", "a", "en", "v1", 5, None)], CHANGES)
    markers = tmp_path / "r" / "commits"
    markers.mkdir(parents=True)
    for name, text in (("b1", ""), ("b2", "b2-0123"), ("b2~1", "")):
        (markers / name).write_text(text)
    assert r.commits() == {} and r.totals().count() == 0
    assert r.commit("b1", load) and not r.commit("b1", load)
    assert r.commit("b2", load) and not r.commit("b2", load)
    assert set(r.commits()) == {"b1", "b2"} and rows_of(r.totals(), "docs", "tokens") == [(2, 10)]

    # a writer that was only slow: its marker comes first then, and the batch still counts once
    signed = tmp_path / "r" / "deltas" / ("b1-" + "0" * 32)
    (tmp_path / "r" / "deltas" / r.commits()["b1"]).rename(signed)
    (markers / "b1").write_text(signed.name)
    assert rows_of(r.totals(), "docs", "tokens") == [(2, 10)]


def test_token_counts_query(spark):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    from textloom.llm.queries import op4_token_counts

    sf = "/root/testdata/sf0.001"
    tok = Tokenizer.from_file(path("byte_bpe_50k.json"))
    toxic = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").filter("toxic = 1").collect()}
    expected = collections.defaultdict(lambda: [0, 0])
    for d in spark.read.parquet(f"{sf}/documents.parquet").collect():
        if d.doc_id in toxic:
            continue
        text = "\n".join(dict.fromkeys(d.text.split("\n")))
        for name, n in (("byte_bpe_50k@1", len(tok.encode(text, add_special_tokens=False).ids)), ("words@1", len(re.findall(r"[^ \t\n\x0b\f\r]+", text)))):
            expected[d.source, d.lang, name][0] += 1
            expected[d.source, d.lang, name][1] += n
    assert {r[:3]: r[3:] for r in rows_of(op4_token_counts(spark, sf), "source", "lang", "tokenizer", "docs", "tokens")} == {k: tuple(v) for k, v in expected.items()}


# -- 5: exact dedup


@pytest.mark.parametrize(("bits", "few"), [(1 << 28, 200_000), (1 << 8, 0)])
def test_exact_dedup(spark, monkeypatch, bits, few):
    from textloom.llm import _bloom, _staging
    from textloom.llm.exact_dedup import mark_duplicates

    monkeypatch.setattr(_bloom, "MAX_BITS", bits)  # few bits: filters of parts of the hash space
    monkeypatch.setattr(_bloom, "RANGE_ROWS", 64)
    monkeypatch.setattr(_staging, "BROADCAST_ROWS", few or 1)
    df = docs(spark, fixture_texts() + ["Hot"] * 200)
    out = mark_duplicates(df, keep=["doc_id", "kept"])
    assert out.columns[:2] == ["doc_id", "kept"] and out.columns[-2] == "kept_"
    got = out.collect()
    groups = collections.defaultdict(list)
    for r in df.collect():
        groups[(r.text or "").translate(LOWER)].append(r.doc_id)
    assert len(got) == df.count()
    by = collections.defaultdict(list)
    for r in got:
        by[r.text_sha256].append(r)
    assert len(by) == len(groups)
    for text, ids in groups.items():
        own = by[hashlib.sha256(text.encode()).hexdigest()]
        top = max((i for i in ids if i is not None), default=None)
        assert {(r.keep_id, r.group_size) for r in own} == {(top, len(ids))}
        assert sum(r["kept_"] for r in own) == 1 and next(r.doc_id for r in own if r["kept_"]) == top
    assert mark_duplicates(df.limit(0)).count() == 0


def test_exact_dedup_clashing_names(spark):
    from textloom.llm.exact_dedup import mark_duplicates

    df = clashing(docs(spark), "tl_hash", "tl_maybe", "tl_row", "tl_order", "tl_top", "group_size", "dotted.name")
    out = mark_duplicates(df)
    assert out.columns == [*df.columns, "keep_id_", "group_size_", "kept_", "text_sha256"] and out.count() == df.count()


# -- 6: n-gram Jaccard join


def shingles(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize(("width", "percent", "longest"), [(3, 90, 64), (5, 80, 64), (2, 60, 2)])
def test_ngram_components(spark, monkeypatch, width, percent, longest):
    from textloom.llm import ngram_join

    monkeypatch.setattr(ngram_join, "LIST", longest)  # short lists: most pairs are found in blocks
    if longest == 2:  # everything is dealt into parts
        from textloom.llm import _staging

        for name, value in {"BLOCK_CLASSES": 4, "GRID": 2, "NEIGHBOURS": 3, "PARTS": 2, "SAMPLE_TEXTS": 500, "FREQUENT": 100}.items():
            monkeypatch.setattr(ngram_join, name, value)
        monkeypatch.setattr(_staging, "BROADCAST_ROWS", 1)
    df = docs(spark)
    rows = [(r.doc_id, shingles(r.text, width)) for r in df.collect()]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, (_, a) in enumerate(rows):
        for j in range(i):
            b = rows[j][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                up[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min((x for x in (low.get(find(i)), d) if x is not None), default=None)
    expected = collections.Counter((d, len(s), low[find(i)] if s else d) for i, (d, s) in enumerate(rows))
    out = ngram_join.ngram_components(df, width=width, percent=percent)
    assert collections.Counter(rows_of(out, "doc_id", "n_shingles", "component_id")) == expected
    if width == 5:
        kept = rows_of(ngram_join.drop_near_copies(df, width=width, percent=percent), "doc_id", "text")
        groups = collections.Counter(find(i) for i, (_, s) in enumerate(rows) if s)
        assert len(kept) == len(groups) + sum(not s for _, s in rows)
        assert {low[g] for g in groups} <= {d for d, _ in kept}


def test_near_copies_clashing_names(spark):
    from textloom.llm.ngram_join import drop_near_copies

    df = docs(spark)
    more = clashing(df, "id", "cid", "n", "th", "tl_key", "tl_maybe", "tl_stays", "tl_rows", "class_rows", "dotted.name")
    out = drop_near_copies(more)
    assert out.columns == more.columns and out.count() == drop_near_copies(df).count()


def test_ngram_empty(spark):
    from textloom.llm.ngram_join import drop_near_copies, ngram_components

    assert ngram_components(docs(spark, []).limit(0)).count() == 0
    lone = spark.createDataFrame([(1, None), (2, ""), (3, "a b c d e f")], "doc_id long, text string")
    assert sorted(rows_of(ngram_components(lone, width=3, percent=90), "doc_id", "n_shingles", "component_id")) == [(1, 0, 1), (2, 0, 2), (3, 4, 3)]
    assert drop_near_copies(lone).count() == 3


# -- 7: license scans


def test_license_scan(spark):
    from textloom.llm.license_scan import _STARTERS, SENTENCES, TRIGGER, normalised, scan_licenses

    assert all(re.search(TRIGGER, s) for s in SENTENCES.values()) and len(set(map(normalised, SENTENCES.values()))) == len(SENTENCES)
    assert not [(k, x) for k, s in SENTENCES.items() for x in _STARTERS if f" {x} " in s]  # a wrapped line can't start with one
    s = SENTENCES
    cases = [
        (1, f"Some text.\n{s['mit-ref']}\nMore."), (2, f"{s['apache2-long']}\n{s['apache2-obtain']}\n\n{s['apache2-warranty']}"), (3, f"{s['apache2-long']} {s['apache2-warranty']}"),
        (4, f"{s['mit-grant'].replace(' ', chr(10))} {s['mit-notice'].upper()}"), (5, "a license is not a rule."), (6, None), (7, ""), (8, f"no full stop before\n{s['cc-by-nc4']} {s['cc-by-nc4']}"),
    ]
    df = spark.createDataFrame([(i, t, "x") for i, t in cases], "doc_id long, text string, rule string")
    got = {(r.doc_id, r.rule, r.matches) for r in scan_licenses(df).collect()}
    assert got == {(1, "mit-reference", 1), (2, "apache-2.0-header", 1), (3, "apache-2.0-notice", 1), (4, "mit-text", 1), (8, "cc-by-nc-4.0-reference", 2)}
    assert scan_licenses(df.limit(0)).count() == 0


LEAD = {"bare": "", "indented": "    ", "hash": "# ", "slashes": "// ", "star": " * ", "dashes": "-- ", "semicolon": ";; ", "no space": "#", "quoted": "> # ", "batch": ":: "}


@pytest.mark.parametrize("width", [10_000, 60])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_license_every_rule(spark, width, end):
    import textwrap

    from textloom.llm.license_scan import RULES, SENTENCES, oracle_sql, scan_licenses

    rows, expected = [], set()

    def add(lines, rule):
        rows.append((len(rows), end.join(lines)))
        expected.add((len(rows) - 1, rule, 1))

    cases = [(seq, rule) for rule, _, seq in RULES]
    assert set(SENTENCES) == {k for seq, _ in cases for k in seq}
    for seq, rule in cases:
        for lead in LEAD.values():
            # a notice without a full stop, an empty line, and the sentences with empty lines between
            lines = ["Copyright 2024 X"]
            for k in seq:
                lines += ["", *textwrap.wrap(SENTENCES[k], width)]
            add([(lead + x).rstrip() for x in [*lines, "", "import os"]], rule)
        one = " ".join(SENTENCES[k] for k in seq)
        if all(SENTENCES[k][-1] in ".:" for k in seq):  # others end at an empty line only
            add([f"/* {one}*/", "int x"], rule)
            add([f"<!-- {one}-->", "<p>"], rule)
            add([f'"""{one}"""', "import os"], rule)
    rows += [(None, rows[0][1]), (None, rows[0][1]), (7, "word. " * 200_000 + rows[-1][1])]  # null and repeated rows, a long text
    out = scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.rule, r.matches) for r in out} == expected | {(None, cases[0][1], 1), (7, cases[-1][1], 1)} and sum(r.doc_id is None for r in out) == 2

    import duckdb

    documents = pa.table({"doc_id": pa.array([i for i, _ in rows], pa.int64()), "text": [t for _, t in rows]})
    con = duckdb.connect()
    con.register("documents", documents)
    assert sorted(con.sql(oracle_sql()).fetchall(), key=str) == sorted(map(tuple, out), key=str)


def test_license_pieces(spark):
    from textloom.llm.license_scan import SENTENCES, scan_licenses

    s = SENTENCES
    first, second = s["gpl-grant"].split(": ")
    cases = [
        (1, f"{first}: No. {second}"), (2, f"{first}:"), (3, second), (4, f"{s['mit-grant']}\n{first}:\n{s['mit-notice']}"), (5, f"{s['gpl-grant']} {s['gpl-grant']}"),
        (6, f"{s['gpl-grant']} See below. {s['gpl-warranty']}"),
    ]
    got = {(r.doc_id, r.rule, r.matches) for r in scan_licenses(spark.createDataFrame(cases, "doc_id long, text string")).collect()}
    assert got == {(4, "mit-text", 1), (5, "gpl-3.0-grant", 2), (6, "gpl-3.0-header", 1)}


# -- 8: URL filters

URLS = [
    None, "", "no scheme/a", "http://", "https://A.Example.NET/en/x?q#f", "http://example.net", "http://example.net/", "http://example.net/en", "http://x.example.net/en/", "http://badexample.net/de/1",
    "http://Example.com/de/5", "http://m.example.com/de", "http://fr.org/fr/1", "http://org/fr/", "http://net?x=/en/", "http://a.net#b", "ftp://É.NET/en/", "x://y://z/de/", "http://example.com?a/de/", "http://spam.example.org/en/12?utm=1",
]


def test_url_rules(spark):
    from textloom.llm.url_filter import RULES, filter_urls

    def brute(url):
        _, sep, rest = (url or "").partition("://")
        if not sep:
            return "", "", None, "allow"
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.translate(LOWER)
        fits = [(h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits, key=lambda x: len(x[0]), default=(None, "allow"))
        return host, path, rule, verdict

    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS)] + [(None, URLS[4], "h")], "page_id long, url string, host string")
    labels = spark.createDataFrame([], "url string, bad boolean")
    got = {(r.page_id, *r[1:]) for r in filter_urls(df, labels).collect()}
    assert got == {(i, *brute(u)) for i, u in [*enumerate(URLS), (None, URLS[4])]}
    assert filter_urls(df.limit(0), labels).count() == 0


def url_tokens(url):
    _, sep, rest = (url or "").partition("://")
    if not sep:
        return frozenset()
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    query = re.match(r"[^?#]*\?([^#]*)", url)
    parts = [*(("h:", x) for x in host.translate(LOWER).split(".")), *(("p:", x) for x in path.split("/")), *(("q:", x.partition("=")[0]) for x in (query[1].split("&") if query else []))]
    return frozenset(k + x for k, x in parts if x and not re.fullmatch(r"\d+(\.\w+)?", x))


def mined(urls, mining):
    """Rules by brute force over all combinations of tokens: antecedent to confidence."""
    import itertools

    n, bad = len(urls), sum(b for _, b in urls)
    covers, hits, same = collections.Counter(), collections.Counter(), collections.defaultdict(list)
    for i, (u, _) in enumerate(urls):
        for t in url_tokens(u):
            same[t].append(i)
    together = collections.defaultdict(list)  # tokens of the same URLs
    for t, where in same.items():
        together[tuple(where)].append(t)
    kept = {min(ts) for ts in together.values()}
    for u, b in urls:
        for k in range(1, mining.tokens + 1):
            for c in itertools.combinations(sorted(url_tokens(u) & kept), k):
                covers[c] += 1
                hits[c] += b
    base = bad / n
    good = {c: hits[c] / covers[c] for c in covers if covers[c] >= max(mining.least, mining.support * n - 1e-6) and hits[c] / covers[c] >= max(base * mining.lift, base + mining.deviations * (base * (1 - base) / covers[c]) ** 0.5)}
    return {c: x for c, x in good.items() if not any(set(d) < set(c) and good[d] >= x for d in good)}


@pytest.mark.parametrize("few", [10_000, 0])
def test_url_mining(spark, monkeypatch, few):
    from textloom.llm import url_filter
    from textloom.llm.url_filter import Mining, filter_urls, host_and_path, mine_rules, url_tokens as column

    monkeypatch.setattr(url_filter, "BROADCAST_RULES", few)  # 0: rules are joined by token
    rng = random.Random(3)
    urls = [(f"http://{rng.choice('abc')}.{rng.choice(['casino', 'good', 'so-so'])}.io/{rng.choice(['win', 'read', 'x'])}/{k}{rng.choice(['', '?ref=1', '?id=2&ref=3'])}", 0) for k in range(400)]
    urls = [(u, int(rng.random() < (0.9 if "casino" in u and "win" in u else 0.5 if "so-so" in u else 0.1))) for u, _ in urls]
    labelled = spark.createDataFrame([(u, bool(b)) for u, b in urls] + [(None, True), ("http://x.io/", None)], "url string, bad boolean")
    mining = Mining(support=0.02, least=5)
    host, path = host_and_path(F.col("url"))
    rules = {tuple(r.antecedent): r.confidence for r in mine_rules(labelled.dropna().select(column(F.col("url"), host, path).alias("tokens"), "bad"), mining).collect()}
    expected = mined(urls, mining)
    assert expected and {k: round(v, 9) for k, v in rules.items()} == {k: round(v, 9) for k, v in expected.items()}
    pages = [(i, u) for i, (u, _) in enumerate(urls[:60])] + [(100, None), (101, "http://casino.io/win/" + "a/" * 20_000), (102, "http://casino.net/win/"), (5, urls[5][0])]
    got = {(r.page_id, r.rule, r.verdict) for r in filter_urls(spark.createDataFrame(pages, "page_id long, url string"), labelled, mining=mining).collect()}
    fires = lambda u: any(set(c) <= url_tokens(u) for c in expected)
    assert got == {(i, "net/" if i == 102 else None, "block" if i == 102 or fires(u) else "allow") for i, u in pages}


# -- 9: decontamination


def test_masks_miss_nothing():
    from textloom.llm.decontaminate import misses

    assert misses() == 0


@pytest.mark.parametrize("block", [1 << 18, 60])
def test_leaks(spark, monkeypatch, block):
    from textloom.llm import decontaminate as D

    monkeypatch.setattr(D, "BLOCK_SEEDS", block)
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    items = [[word() for _ in range(n)] for n in (13, 40, 20, 5, 9, 11, 4, 30, 1, 2, 3, 7, 12)]
    bench = [(i, " ".join(w)) for i, w in enumerate(items)] + [(1, " ".join(items[1])), (20, None), (21, "")]
    filler = lambda n: [word() for _ in range(n)]
    rows = []
    for i, w in enumerate(items):
        for k in range(5):  # k substituted words
            cut = list(w)
            for at in rng.sample(range(len(cut)), min(k, len(cut))):
                cut[at] = "zzzz"
            rows.append((100 * i + k, ", ".join(filler(6) + cut + filler(5)).upper(), "x"))
    rows += [(5000, " ".join(items[1][7:20]), "x"), (5001, " ".join(items[1][7:19]), "x"), (5002, None, "x"), (5003, "", "x"), (None, " ".join(items[2]), "x"), (7, " ".join(filler(3000)), "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    out = D.find_leaks(df, spark.createDataFrame(bench, "item_id long, text string"))

    def matched(doc, item):
        width = min(13, len(item)) if len(item) >= 13 else len(item)
        best = 0
        for off in range(-len(item), len(doc)):
            for a in range(len(item) - width + 1):
                if 0 <= off + a and off + a + width <= len(doc):
                    best = max(best, sum(doc[off + a + q] == item[a + q] for q in range(width)))
        return best if best >= (11 if len(item) >= 13 else -(-len(item) * 4 // 5)) else 0

    expected = {(d, i, m) for d, t, _ in rows for i, w in enumerate(items) if (m := matched(re.findall(r"\w+", (t or "").lower()), w))}
    assert set(rows_of(out, "doc_id", "item_id", "matched_words")) == expected
    clean = D.remove_leaks(df, spark.createDataFrame(bench, "item_id long, text string"))
    bad = {d for d, _, _ in expected}
    assert sorted(map(str, (d for d, *_ in rows_of(clean, "doc_id")))) == sorted(str(d) for d, *_ in rows if d not in bad) and clean.columns == df.columns
    assert D.find_leaks(df, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert D.find_leaks(df.limit(0), spark.createDataFrame(bench, "item_id long, text string")).count() == 0


# -- 10: BPE


@pytest.mark.parametrize("words", [1 << 19, 40])
def test_bpe(spark, words):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    from textloom.llm.bpe import count_tokens, decode, encode

    tok = Tokenizer.from_file(path("byte_bpe_50k.json"))
    rng = random.Random(4)
    alphabet = list("ab'sStremvlld  \n\t 12.,!?éñß漢字  ́²Ⅷ_😀 \r​　") + ["<|endoftext|>"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(400)] + fixture_texts()
    df = docs(spark, texts)
    got = decode(encode(df.repartition(3), table_words=words), name="text_back")
    expected = collections.Counter((r.doc_id, np.array(tok.encode(r.text or "", add_special_tokens=False).ids, "<u4").tobytes(), r.text or "") for r in df.collect())
    assert collections.Counter((i, bytes(x), t) for i, x, t in rows_of(got, "doc_id", "ids", "text_back")) == expected
    counts = collections.Counter((i, len(x) // 4) for i, x, _ in expected.elements())
    assert collections.Counter(rows_of(count_tokens(df, table_words=words), "doc_id", "n_tokens")) == counts
    for lookup in (False, True):
        same = encode(df, table_words=words, decoded="text_back", lookup=lookup)
        assert sorted(rows_of(same, "doc_id", "ids", "text_back"), key=str) == sorted(rows_of(got, "doc_id", "ids", "text_back"), key=str)
    twice = decode(got.filter("doc_id = 5").withColumn("row", F.lit(1)).withColumn("dotted.name", F.lit("x")), name="text_back")
    assert twice.columns == ["doc_id", "ids", "text_back", "row", "dotted.name", "text_back_"]
    assert rows_of(twice, "text_back_") == [(texts[5],)]
    odd = spark.createDataFrame([(1, None), (2, b""), (3, b"\xff\xff\xff\x7f\x41\x00\x00\x00\x01")], "k int, ids binary")
    assert sorted(rows_of(decode(odd), "k", "decoded")) == [(1, ""), (2, ""), (3, tok.decode([65], skip_special_tokens=False))]
    assert encode(df.limit(0)).count() == 0 and decode(encode(df.limit(0))).count() == 0


# -- the pipeline


def test_pipeline(spark):
    import corpus_pipeline

    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    now = base
    for name, f in corpus_pipeline.STAGES[:-1]:
        after = f(spark, now, "/root/testdata/sf0.001")
        assert after.columns == base.columns, name
        assert after.count() <= now.count()
        now = after
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert sorted(rows_of(out, "doc_id", "decoded")) == sorted(rows_of(now, "doc_id", "text"))
