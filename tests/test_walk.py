"""Walks that leave directories out before they are listed, and rules in any number."""

import random

import pytest
from pyspark.sql import functions as F

from textloom.functions.globs import parse_ignore_line
from textloom.functions.rules import Judge, Place, RuleSet
from textloom.operators import paths as P
from textloom.plans import search as S


def make(top, files):
    for path, text in files.items():
        (top / path).parent.mkdir(parents=True, exist_ok=True)
        (top / path).write_text(text)


def test_what_is_left_out_is_not_listed(spark, tmp_path):
    make(tmp_path, {".gitignore": "node_modules/\n*.log\n", ".git/HEAD": "", ".git/objects/aa/x": "", "a.py": "", "src/b.py": "", "src/x.log": "", "docs/.ignore": "old\n", "docs/old/deep/er/c.md": "", "docs/d.md": "", ".cache/k/v": ""})
    make(tmp_path, {f"node_modules/p{k}/lib/m{k}.js": "" for k in range(30)})
    for options, found, directories in (
        (S.Options(), {"a.py", "src/b.py", "docs/d.md"}, 3),  # the root, src, docs
        (S.Options(globs=("!src",)), {"a.py", "docs/d.md"}, 2),
        (S.Options(max_depth=1), {"a.py"}, 1),
        (S.Options(no_ignore=True), {"a.py", "src/b.py", "src/x.log", "docs/d.md", "docs/old/deep/er/c.md"} | {f"node_modules/p{k}/lib/m{k}.js" for k in range(30)}, 3 + 3 + 61),
        (S.Options(hidden=True, no_ignore_vcs=True, globs=("!node_modules", "!.git")), {".gitignore", "a.py", "src/b.py", "src/x.log", "docs/.ignore", "docs/d.md", ".cache/k/v"}, 5),
    ):
        listed = spark.sparkContext.accumulator(0)
        rows = S.files(spark, [str(tmp_path)], options, listed).collect()
        assert {r.path for r in rows} == found and listed.value == directories


def test_order_of_choices(spark, tmp_path):
    make(tmp_path, {".ignore": "*.md\n!.shown\nout/\n", "a.md": "", "b.py": "", ".c.py": "", ".shown": "", "out/d.md": "", ".dir/e.py": "", "keep.txt": ""})
    paths = lambda **o: {r.path for r in S.files(spark, [str(tmp_path)], S.Options(**o)).collect()}
    assert paths() == {"b.py", ".shown", "keep.txt"}
    assert paths(types=("py",)) == {"b.py", ".c.py"}  # what a type takes in is shown though hidden, what rules ignore isn't
    assert paths(types=("markdown",)) == set()
    assert paths(globs=("*.md",)) == {"a.md"}  # globs go before rules, but a directory that rules ignore isn't listed
    assert paths(globs=("*.md", "out/")) == {"a.md", "out/d.md"}
    assert paths(globs=("!*.py",), types_not=("txt",)) == {".shown"}
    assert paths(iglobs=("*.PY", "!.DIR"), globs=(".dir/",)) == {"b.py", ".c.py"}


def test_tables_choose_as_walks_do(spark, tmp_path):
    make(tmp_path, {".ignore": "*.md\n!.shown\nout/\n", "sub/.ignore": "!keep.md\n/x\n", "a.md": "", "b.py": "", ".c.py": "", ".shown": "", "out/d.md": "", ".dir/e.py": "", "sub/keep.md": "", "sub/x/y": "", "sub/z/x/q.py": "", "sub/z/.h/r.md": ""})
    every = [str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*") if p.is_file()]
    table = spark.createDataFrame([(p,) for p in every], "path string")
    rules = P.rules_of(spark.createDataFrame([("ignore", "", "*.md\n!.shown\nout/\n"), ("ignore", "sub", "!keep.md\n/x\n")], "source string, dir string, content string"))
    for most in (50_000, 1):
        for globs in ([], ["*.md", "out/"], [".dir/", "*.py"]):
            for hidden in (False, True) if not globs else (False,):
                P.BROADCAST_RULES, before = most, P.BROADCAST_RULES
                try:
                    got = {r.path for r in P.select_files(table, show_hidden=hidden, globs=globs, rules=rules).collect()}
                finally:
                    P.BROADCAST_RULES = before
                walked = {r.path for r in S.files(spark, [str(tmp_path)], S.Options(globs=tuple(globs), hidden=hidden)).collect()}
                assert got == walked, (most, globs, hidden)


def test_rule_sets_as_regular_expressions():
    rng = random.Random(7)
    lines = [rng.choice(["", "!"]) + rng.choice(["a", "b.c", "*.c", "*.tar.gz", "/a", "a/b", "**/d", "d/", "[ab]*", "x?", "é.txt", "*b*"]) for _ in range(60)]
    paths = ["/".join(rng.choice(["a", "b", "b.c", "d", "x1", "y.tar.gz", "é.txt", "q.c"]) for _ in range(rng.randrange(1, 4))) for _ in range(300)]
    for n in (1, 5, 60):
        globs = [parse_ignore_line(x) for x in lines[:n]]
        rules = RuleSet((g.regex, g.whitelist, g.directories_only) for g in globs)
        one = [(g, RuleSet([(g.regex, True, False)])) for g in globs]
        for p in paths:
            for is_dir in (False, True):
                hits = [g.whitelist for g, r in one if r.match(p, False) and (is_dir or not g.directories_only)]
                assert rules.match(p, is_dir) == (hits[-1] if hits else None)


def test_ten_thousand_rules(spark):
    rng = random.Random(2)
    names = [f"n{k}" for k in range(20_000)]
    ignored = set(rng.sample(names, 10_000))
    rules = P.rules_of(spark.createDataFrame([("ignore", "", "\n".join(sorted(ignored)) + "\n"), ("ignore", "d1", "!n1\n!n2\n")], "source string, dir string, content string"))
    paths = [f"d{k % 7}/{rng.choice(names)}/{n}" if k % 3 else f"d{k % 7}/{n}" for k, n in enumerate(names)]
    got = {r.path for r in P.select_files(spark.createDataFrame([(p,) for p in paths], "path string"), rules=rules).collect()}

    def kept(path):
        back = {"n1", "n2"} if path.startswith("d1/") else set()
        return not any(part in ignored and part not in back for part in path.split("/"))

    assert got == {p for p in paths if kept(p)} and 0 < len(got) < len(paths)


def test_a_directory_is_judged_once(monkeypatch):
    from textloom.functions import rules as R

    asked = []
    real = R.verdict
    monkeypatch.setattr(R, "verdict", lambda places, entry, is_dir, *a: asked.append(entry) or real(places, entry, is_dir, *a))
    judge = Judge([Place("", sets={"ignore": RuleSet([(parse_ignore_line("x").regex, False, False)])})], R.SOURCES, False)
    assert [judge(f"a/b/c/f{k}") for k in range(50)] == [(False, False, None)] * 50
    assert judge("a/x/y") == (True, False, None) and len(asked) == 3 + 50 + 2


def test_bad_bytes_in_names_and_null_paths(spark):
    table = spark.createDataFrame([("a",), (None,), ("",)], "path string")
    rules = P.rules_of(spark.createDataFrame([("ignore", "", "b\n")], "source string, dir string, content string"))
    assert {r.path for r in P.select_files(table, rules=rules).collect()} >= {"a"}
    with pytest.raises(S.Unsupported):
        S.sorted_files(table, "size")
    assert P.select_files(table.filter(F.lit(False)), rules=rules).count() == 0
