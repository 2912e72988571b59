"""Lines, context, files and binary rules on small inputs, against plain Python."""

import os
import random

import pytest

from textloom.functions.filetypes import Types
from textloom.functions.globs import parse_glob
from textloom.functions.matching import Match
from textloom.operators import lines as L
from textloom.plans import search as S


def texts(spark, *rows):
    return spark.createDataFrame(list(enumerate(rows)), "k int, text string")


def test_lines_of_any_text(spark):
    random.seed(3)
    rows = ["".join(random.choice("a\n\r\0é") for _ in range(random.randrange(12))) for _ in range(60)] + ["", "\n", "\n\n"]
    for parts in (1, 7):
        got = {(r.k, r.line_no): (r.byte_offset, r.line) for r in L.number_lines(texts(spark, *rows).repartition(parts)).collect()}
        expected = {}
        for k, t in enumerate(rows):
            at = 0
            for n, line in enumerate(t.split("\n")[: -1 if t.endswith("\n") or not t else None], 1):
                expected[k, n] = (at, line)
                at += len(line.encode()) + 1
        assert got == expected


def test_null_and_empty_tables(spark):
    df = spark.createDataFrame([(1, None), (2, "")], "k int, text string")
    m = Match(("a",))
    assert L.search_lines(df, m).count() == L.search_events(df, m, before=1).count() == L.search_spans(df, m).count() == 0
    assert L.count_lines(df, m, include_zero=True).count() == 2
    assert L.run_stats(df.limit(0), m).first().texts_searched == 0


@pytest.mark.parametrize(("before", "after", "most"), [(0, 0, None), (1, 2, None), (3, 0, 2), (2, 2, 1), (0, 5, 3)])
def test_context_is_a_partition(spark, before, after, most):
    random.seed(before * 10 + after)
    rows = ["\n".join(random.choice("xxxm") for _ in range(random.randrange(1, 25))) for _ in range(80)]
    got = {}
    for r in L.search_events(texts(spark, *rows), Match(("m",)), before=before, after=after, max_count=most).collect():
        got.setdefault(r.k, {})[r.line_no] = (r.kind, r.after)
    for k, t in enumerate(rows):
        hits = [i for i, x in enumerate(t.split("\n"), 1) if x == "m"][:most]
        want = {}
        for n in range(1, t.count("\n") + 2):
            prev, next_ = max([h for h in hits if h < n], default=None), min([h for h in hits if h > n], default=None)
            if n in hits:
                want[n] = ("match", False)
            elif prev and n - prev <= after:
                want[n] = ("context", True)
            elif next_ and next_ - n <= before:
                want[n] = ("context", False)
        assert got.get(k, {}) == want


def test_max_count_zero_and_passthru(spark):
    df = texts(spark, "a\nb\na")
    assert L.search_events(df, Match(("a",)), max_count=0, passthru=True).count() == 0
    assert [r.kind for r in L.search_events(df, Match(("a",)), passthru=True).orderBy("line_no").collect()] == ["match", "context", "match"]


@pytest.mark.parametrize(
    ("glob", "path", "hit"),
    [("*.md", "a/b.md", True), ("/*.md", "a/b.md", False), ("a/**", "a/b/c", True), ("a/**", "a", False), ("**/a", "x/a", True), ("**/a", "a", True), ("a/**/b", "a/b", True), ("a/**/b", "a/x/y/b", True), ("[!a].c", "b.c", True), ("[!a].c", "a.c", False), ("{x,y}.c", "q/y.c", True), ("a?c", "a/c", False), ("\\!x", "!x", True), ("\\#x", "#x", True), ("[a", "[a", True), ("foo*bar", "foo/bar", False)],
)
def test_globs(spark, glob, path, hit):
    from pyspark.sql import functions as F

    assert spark.createDataFrame([(path,)], "p string").select(F.col("p").rlike(parse_glob(glob).regex)).first()[0] is hit


def test_types(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(p,) for p in ("main.rs", "main.c", "note.txt", ".bashrc", "sub/deep.rs", "x.foo")], "p string")
    keep = lambda t: {r.p for r in df.filter(t.keeps(F.col("p"))).collect()}
    assert keep(Types().select("rust")) == {"main.rs", "sub/deep.rs"}
    assert keep(Types().add("foo:*.foo").select("foo").select("c")) == {"x.foo", "main.c"}
    assert keep(Types().negate("rust")) == {"main.c", "note.txt", ".bashrc", "x.foo"}
    with pytest.raises(ValueError, match="unknown type"):
        keep(Types().clear("rust").select("rust"))


@pytest.fixture
def tree(tmp_path):
    for path, content in {
        "a.txt": b"alpha needle one\nplain line\nneedle two needle three\n", "sub/b.txt": b"sub needle\n", "c.txt": b"no match\n", "git.txt": b"needle\n", "dot.txt": b"needle\n", "rgi.txt": b"needle\n",
        ".gitignore": b"git.txt\n", ".ignore": b"dot.txt\n", ".rgignore": b"rgi.txt\n!.shown\n", ".hid": b"needle\n", ".shown": b"needle\n", "_u/u.txt": b"needle\r\n", "bin.dat": b"x needle\0y needle\n", "bom.txt": b"\xef\xbb\xbfneedle\n",
    }.items():
        (tmp_path / path).parent.mkdir(exist_ok=True)
        (tmp_path / path).write_bytes(content)
    (tmp_path / ".git").mkdir()
    os.symlink("a.txt", tmp_path / "link.txt")
    return str(tmp_path)


def test_tree(spark, tree):
    paths = lambda **o: {r.path for r in S.files(spark, [tree], S.Options(**o)).collect()}
    base = {"a.txt", "sub/b.txt", "c.txt", "_u/u.txt", "bin.dat", "bom.txt", ".shown"}
    assert paths() == base
    assert paths(no_ignore=True) == base - {".shown"} | {"git.txt", "dot.txt", "rgi.txt"}
    # globs go before ignore rules
    assert paths(globs=("*.txt", "!c.txt")) == base - {"bin.dat", "c.txt", ".shown"} | {"git.txt", "dot.txt", "rgi.txt"}
    assert paths(follow=True) == base | {"link.txt"}
    assert paths(max_depth=1) == base - {"sub/b.txt", "_u/u.txt"}
    assert paths(max_filesize=11) == {"sub/b.txt", "c.txt", "_u/u.txt", "bom.txt", ".shown"}


def test_outer_ignore_rules(spark, tree, tmp_path):
    (tmp_path / ".git/info").mkdir()
    (tmp_path / ".git/info/exclude").write_text("c.txt\n")
    (tmp_path / "own.ignore").write_text("bom.txt\n")
    paths = lambda root, **o: {r.path for r in S.files(spark, [root], S.Options(**o)).collect()}
    found = paths(tree, ignore_files=(f"{tree}/own.ignore",))
    assert "c.txt" not in found and "bom.txt" not in found and "a.txt" in found
    assert "c.txt" in paths(tree, no_ignore_exclude=True)
    (tmp_path / ".ignore").write_text("/sub/b.txt\n")
    assert paths(f"{tree}/sub") == set() and paths(f"{tree}/sub", no_ignore_parent=True) == {"b.txt"}
    order = [r.path for r in S.sorted_files(S.files(spark, [tree], S.Options(globs=("*.txt",))), descending=True).collect()]
    assert order == sorted(order, key=lambda p: p.split("/"), reverse=True)


def test_repositories(spark, tmp_path):
    for path, text in {
        "a/.gitignore": "x.txt\n", "a/x.txt": "", "a/y.txt": "", "a/sub/x.txt": "", "a/sub/y.txt": "", "a/.git/info/exclude": "/sub/y.txt\n",
        "a/.git/worktrees/w/info/exclude": "/sub/y.txt\n", "w/.git": f"gitdir: {tmp_path}/a/.git/worktrees/w\n", "w/.gitignore": "z.txt\n", "w/x.txt": "", "w/z.txt": "", "w/sub/y.txt": "",
        "a/in/.jj/m": "", "a/in/x.txt": "", "a/in/.gitignore": "q.txt\n", "a/in/q.txt": "", "plain/.gitignore": "x.txt\n", "plain/x.txt": "", ".gitignore": "y.txt\n", "own": "z.txt\nq.txt\n",
    }.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    paths = lambda *roots, **o: {f"{r.root[len(str(tmp_path)) + 1 :]}:{r.path}" for r in S.files(spark, [f"{tmp_path}/{x}".rstrip("/") for x in roots], S.Options(**o)).collect()}
    inner = {"a/y.txt", "a/in/x.txt", "w/x.txt", "plain/x.txt", "own"}
    # a folder of several repositories, one a worktree, one inside another; rules outside repositories don't count
    assert paths("") == {f":{x}" for x in inner}
    # a directory of a repository, and roots of which some are repositories
    assert paths("a/sub") == set() and paths("a/in") == {"a/in:x.txt"}
    assert paths("a/sub", no_ignore_parent=True) == {"a/sub:x.txt", "a/sub:y.txt"}
    assert paths("a", "plain", "w") == {"a:y.txt", "a:in/x.txt", "plain:x.txt", "w:x.txt"}
    assert paths("a/in", "plain", no_require_git=True) == set()
    # the user's own rules count in repositories only
    assert paths("w", "plain", global_ignore=f"{tmp_path}/a/.gitignore") == {"plain:x.txt"}


def test_scalars(spark):
    from pyspark.sql import functions as F

    from textloom.functions import scalars as C

    assert [C.parse_size(x) for x in ("7", "2K", "1M", "3G")] == [7, 2048, 1 << 20, 3 << 30]
    assert C.unescape_separator(r"a\t\x41\0\q") == "a\tA\0\\q"
    assert C.pattern_lines("a\r\n\nb\n") == ["a", "", "b"]
    for bad in ("7k", "", "9999999999G"):
        with pytest.raises(ValueError):
            C.parse_size(bad)
    row = spark.range(1).select(C.preview(F.lit("e\u0301bc"), 2).alias("p"), C.exit_code(F.lit(True), F.lit(1)).alias("e"), C.exit_code(F.lit(True), F.lit(1), True).alias("q"), C.exit_code(F.lit(False), F.lit(0)).alias("n")).first()
    assert row.p.startswith("e\u0301b [") and (row.e, row.q, row.n) == (2, 0, 1)


def test_search_tree(spark, tree):
    hits = {(r.path, r.line_no, r.column) for r in S.search((spark, [tree]), "needle").collect()}
    assert hits == {("a.txt", 1, 7), ("a.txt", 3, 1), ("sub/b.txt", 1, 5), ("_u/u.txt", 1, 1), ("bom.txt", 1, 1), (".shown", 1, 1)}
    explicit = S.search((spark, [f"{tree}/bin.dat", f"{tree}/none"]), "needle")
    assert [(r.line_no, r.line) for r in explicit.orderBy("line_no").collect()] == [(1, "x needle"), (2, "y needle")]
    assert S.errors(spark, [f"{tree}/none"]).count() == 1
    seen = []
    S.search_stream((spark, [tree]), "needle", lambda r: seen.append(r) or len(seen) < 2)
    assert len(seen) == 2


def test_options(spark, tmp_path):
    for name in S.REFUSED:
        with pytest.raises(S.Unsupported, match=name):
            S.Options(**{name: True})
    o = S.Options(unrestricted=3)
    assert (o.no_ignore, o.hidden, o.binary) == (True, True, "convert") and not S.Options(unrestricted=1).hidden
    (tmp_path / "patterns").write_bytes(b"foo\r\nb.r\n")
    (tmp_path / "none").write_bytes(b"")
    df = texts(spark, "a foo", "bxr", "no")
    assert {r.k for r in S.search(df, None, S.Options(pattern_files=(f"{tmp_path}/patterns",))).collect()} == {0, 1}
    assert S.search(df, None, S.Options(pattern_files=(f"{tmp_path}/none",))).count() == 0


def test_binary_files(spark, tmp_path):
    from textloom.operators import sinks as K

    late = b"x needle\n" * 8000 + b"\0" + b"y needle\n"
    for name, content in {"early.dat": b"x needle\0y needle\n", "late.dat": late, "text.txt": b"z needle\n", "nothing.dat": b"a\0b\n"}.items():
        (tmp_path / name).write_bytes(content)
    tree = (spark, [str(tmp_path)])
    assert {r.path: r.matches for r in S.count_matches(tree, "needle").collect()} == {"text.txt": 1}
    assert {r.path for r in S.files_with_match(tree, "needle", without=True).collect()} == set()
    assert {r.path for r in S.files_with_match(tree, "needle").collect()} == {"text.txt", "late.dat"}
    rows = {r.path: r.row for r in S.printed(tree, "needle").filter("kind = 'notice'").collect()}
    assert rows == {"late.dat": 'late.dat: WARNING: stopped searching binary file after match (found "\\0" byte around offset 72000)'}
    shown = S.printed((spark, [f"{tmp_path}/early.dat"]), "needle").collect()
    assert [(r.kind, r.row) for r in shown] == [("notice", 'binary file matches (found "\\0" byte around offset 8)')]
    long = S.printed((spark, [f"{tmp_path}/late.dat"]), "needle").collect()
    assert len(long) == 8001 and long[-1].kind == "notice" and S.count_matches((spark, [f"{tmp_path}/late.dat"]), "needle").first().matches == 8001
    ends = {r.path: r.json for r in S.json_messages((spark, [f"{tmp_path}/early.dat", f"{tmp_path}/text.txt"]), "needle").filter("json like '{\"type\":\"end%'").collect()}
    assert '"binary_offset":8,' in ends["early.dat"] and '"bytes_searched":8,' in ends["early.dat"] and '"binary_offset":null,' in ends["text.txt"]
    assert K.shows_path([str(tmp_path)]) and not K.shows_path([f"{tmp_path}/text.txt"]) and K.shows_path(["a", "b"]) and K.shows_path([f"{tmp_path}/text.txt"], vimgrep=True)


def test_printed(spark):
    from textloom.operators import sinks as K

    df = spark.createDataFrame([("p", "  one needle\ngap\n\nneedle needle tail tail\nx")], "path string, text string")
    rows = lambda m=Match(("needle",)), **o: [r.row for r in K.printed(df, m, how=K.Printing(**o)).filter("kind <> 'between'").orderBy("seq").collect()]
    assert rows(column=True) == ["p:1:7:  one needle", "p:4:1:needle needle tail tail"]
    assert rows(heading=True, null=True) == ["p\0", "1:  one needle", "4:needle needle tail tail"]
    assert rows(only_matching=True, offset=True) == ["p:1:6:needle", "p:4:18:needle", "p:4:25:needle"]
    assert rows(vimgrep=True, trim=True) == ["p:1:7:one needle", "p:4:1:needle needle tail tail", "p:4:8:needle needle tail tail"]
    assert rows(after=1, with_path=False) == ["1:  one needle", "2-gap", "--", "4:needle needle tail tail", "5-x"]
    assert rows(after=1, gap=None, with_path=False)[2].startswith("4:") and rows(before=1, gap="", with_path=False)[1] == ""
    assert rows(max_columns=13, with_path=False) == ["1:  one needle", "4:[Omitted long matching line]"]
    assert rows(max_columns=13, column=True, with_path=False)[1] == "4:1:[Omitted long line with 2 matches]"
    assert rows(max_columns=13, column=True, preview=True, with_path=False)[1] == "4:1:needle needle [... 0 more matches]"
    assert rows(max_columns=5, column=True, preview=True, with_path=False)[1] == "4:1:needl [... 1 more match]"
    assert rows(max_columns=2, after=1, line_number=False, with_path=False)[1] == "[Omitted long context line]"
    assert rows(color=True)[0] == "\x1b[0m\x1b[35mp\x1b[0m:\x1b[0m\x1b[32m1\x1b[0m:  one \x1b[0m\x1b[1m\x1b[31mneedle\x1b[0m"
    assert rows(Match(("e",), invert=True), only_matching=True) == ["p:2:gap", "p:3:", "p:5:x"]
    assert [(r.text, r.column) for r in L.search_spans(df, Match(("e",), invert=True)).collect()] == [("gap", None), ("", None), ("x", None)]


def test_json_strings_and_offsets(spark):
    import json

    from textloom.operators import sinks as K

    text = "".join(map(chr, range(1, 34))).replace("\n", "") + '\\"\x7fé\u2028</b>needle'
    df = spark.createDataFrame([("p", text), ("p", "needle\r\nlast needle"), ("q", None), ("r", "")], "path string, text string")
    out = [r.json for r in K.json_events(df, Match(("needle",))).collect()]
    assert any("\\u001f" in x and "\\u000b" in x and "</b>" in x for x in out) and not any("\\u001F" in x for x in out)
    messages = [json.loads(x) for x in out]
    assert [m["type"] for m in messages].count("begin") == [m["type"] for m in messages].count("end") == 2
    lines = [m["data"]["lines"]["text"] for m in messages if m["type"] == "match"]
    assert sorted(lines) == sorted([text, "needle\r\n", "last needle"])
    end = next(m["data"]["stats"] for m in messages if m["type"] == "end" and m["data"]["stats"]["matched_lines"] == 2)
    own = [x for x, m in zip(out, messages, strict=True) if m["type"] == "match" and m["data"]["lines"]["text"] != text]
    begin = next(x for x, m in zip(out, messages, strict=True) if m["type"] == "begin")
    assert end["bytes_printed"] == sum(len(x.encode()) + 1 for x in [begin, *own]) and end["bytes_searched"] == 19
    summary = json.loads(K.json_summary(df, Match(("needle",)), K.json_events(df, Match(("needle",)))).first().json)
    assert list(summary) == ["data", "type"] and summary["data"]["stats"]["searches"] == 4 and summary["data"]["stats"]["matches"] == 3
    turned = [json.loads(r.json) for r in K.json_events(df, Match(("last",), invert=True), after=1).collect()]
    assert [m["data"]["submatches"] for m in turned if m["type"] == "context"] == [[{"match": {"text": "last"}, "start": 0, "end": 4}]]


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, 2, 3, "l", "k", "x a\nb a")], "k int, line_no int, byte_offset int, line string, tl_text string, text string")
    m = Match(("a",))
    for out in (L.number_lines(df), L.search_lines(df, m, column=True), L.search_events(df, m, after=1), L.search_spans(df, m), L.nested_context(df, m)):
        assert out.columns[:5] == df.columns[:5] and {"line_no_", "byte_offset_", "line_"} <= set(out.columns)
        row = out.first()
        assert (row.k, row.line_no, row.line, row.tl_text) == (1, 2, "l", "k") and row.line_ in ("x a", "a")
    assert L.count_lines(df, m).columns == [*df.columns[:5], "matches"] and L.texts_with_match(df, m).columns == df.columns[:5]


def test_ignore_file_with_a_bad_line(spark):
    from textloom.operators import paths as P

    files = spark.createDataFrame([("ignore", "", "*.a\nfoo\\ \n"), ("gitignore", "", "*.b\n")], "source string, dir string, content string")
    assert [r.source for r in P.rules_of(files).collect()] == ["gitignore"]


def test_sort_by_time(spark, tree):
    os.utime(f"{tree}/a.txt", (1, 500))
    os.utime(f"{tree}/c.txt", (2, 400))
    found = S.files(spark, [tree], S.Options(globs=("a.txt", "c.txt")))
    order = lambda by, **o: [r.path for r in S.sorted_files(found, by, **o).collect()]
    assert order("accessed") == order("modified", descending=True) == ["a.txt", "c.txt"] and order("modified") == ["c.txt", "a.txt"]


def test_stream(spark, tmp_path):
    from textloom.streaming.follow import follow_table, search_stream

    df = texts(spark, "a\nb", "b", "a")
    df.write.parquet(str(tmp_path / "in"))
    q = search_stream(follow_table(spark, str(tmp_path / "in"), df.schema), Match(("a",))).writeStream.format("memory").queryName("found").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.k, r.line_no) for r in spark.table("found").collect()) == [(0, 1), (2, 1)]
