"""Figures of a run, early stops and the user's own ignore file."""

import time

import pytest
from pyspark.sql import functions as F

from textloom.operators import lines as L
from textloom.operators import sinks as K
from textloom.plans import search as S
from textloom.sources.files import global_ignore_path


def rows_of(rows):
    return [r.row for r in sorted(rows.collect(), key=lambda r: (r.path, r.seq))]


@pytest.mark.parametrize("how", [K.Printing(), K.Printing(heading=True, column=True), K.Printing(only_matching=True), K.Printing(line_number=False, with_path=False)])
def test_figures_are_of_the_rows_own_job(spark, how):
    texts = ["the a\nb the the\nc", "nothing", None, "", "é the\n\nx", "x\nthe\ny\nthe"]
    df = spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "path string, text string").repartition(3)
    found, figures = S.printed_with_figures(df, "the", lambda rows: rows.collect(), S.Options(after_context=1), how)
    stats = L.run_stats(df, S.Options().match("the")).first()
    assert (figures.matches, figures.matched_lines, figures.texts_with_match, figures.texts_searched, figures.bytes_searched) == (stats.matches, stats.matched_lines, stats.texts_with_match, stats.texts_searched, stats.bytes_searched)
    out = [r.row for r in sorted(found, key=lambda r: (r.path, r.seq))]
    assert out == rows_of(S.printed(df, "the", S.Options(after_context=1), how))
    first = next(iter(out), None) if found and min(found, key=lambda r: (r.path, r.seq)).kind == "between" else None
    assert figures.bytes_printed == sum(len(x.encode()) + 1 for x in out) - (len(first.encode()) + 1 if first is not None else 0)
    assert figures.seconds > 0 and figures.lines()[1:3] == [f"{stats.matches} matches", f"{stats.matched_lines} matched lines"] and figures.lines()[0] == "" and len(figures.lines()) == 9


def test_figures_of_files_and_of_nothing(spark, tmp_path):
    (tmp_path / "a").write_text("needle\nx\n")
    (tmp_path / "b").write_bytes(b"needle\n\0needle\n")
    written, figures = S.printed_with_figures((spark, [str(tmp_path)]), "needle", lambda rows: rows.count())
    assert written == 1 and (figures.matched_lines, figures.texts_searched, figures.texts_with_match) == (1, 2, 1)
    none, figures = S.printed_with_figures(spark.createDataFrame([], "path string, text string"), "x", lambda rows: rows.count())
    assert none == 0 and (figures.matches, figures.bytes_printed, figures.bytes_searched, figures.texts_searched) == (0, 0, 0, 0)


def test_a_callback_stops_what_runs(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def slow(k):
        read.add(1)
        time.sleep(0.02)
        return f"needle {k}"

    docs = spark.range(0, 400, 1, 100).select("id", slow("id").alias("text"))
    seen = []
    assert S.search_stream(docs, "needle", lambda row: seen.append(row) or len(seen) < 3) is False
    assert len(seen) == 3
    until = time.time() + 20
    while spark.sparkContext.statusTracker().getActiveJobsIds() and time.time() < until:
        time.sleep(0.1)
    assert not spark.sparkContext.statusTracker().getActiveJobsIds()
    after = read.value
    time.sleep(0.5)
    assert read.value == after < 40  # of 400 texts
    assert spark.sparkContext.getLocalProperty("spark.jobGroup.id") is None and spark.range(5).count() == 5


def test_a_stream_to_its_end(spark):
    docs = spark.range(0, 12, 1, 4).select("id", F.concat(F.lit("needle "), F.col("id")).alias("text"))
    seen = []
    assert S.search_stream(docs, "needle", seen.append) is True and len(seen) == 12
    with pytest.raises(ZeroDivisionError):
        S.search_stream(docs, "needle", lambda _: 1 / 0)
    assert S.any_match(docs, "needle 7") and not S.any_match(docs, "hay")


def test_global_ignore_file(spark, tmp_path, monkeypatch):
    home, other = tmp_path / "home", tmp_path / "xdg"
    for d in (home / ".config" / "git", other / "git"):
        d.mkdir(parents=True)
    where = lambda **e: global_ignore_path(e)
    assert where() is None
    assert where(HOME=str(home)) == f"{home}/.config/git/ignore" and where(HOME=str(home), XDG_CONFIG_HOME=str(other)) == f"{other}/git/ignore"
    (other / "git" / "config").write_text("[core]\n\texcludesFile = ~/mine\n")
    assert where(HOME=str(home), XDG_CONFIG_HOME=str(other)) == f"{home}/mine" and where(HOME=str(home)) == f"{home}/.config/git/ignore"
    (home / ".gitconfig").write_text('[user]\nname = x\n[core]\n  EXCLUDESFILE = "/abs/own"\n  excludesfile = /second\n')
    assert where(HOME=str(home), XDG_CONFIG_HOME=str(other)) == "/abs/own"

    tree = tmp_path / "tree"
    (tree / ".git").mkdir(parents=True)
    for name in ("a.txt", "b.log"):
        (tree / name).write_text("x")
    (home / ".gitconfig").write_text(f"[core]\nexcludesfile = {home}/own\n")
    (home / "own").write_text("*.log\n")
    monkeypatch.setenv("HOME", str(home))
    monkeypatch.delenv("XDG_CONFIG_HOME", raising=False)
    paths = lambda **o: {r.path for r in S.files(spark, [str(tree)], S.Options(**o)).collect()}
    assert paths() == {"a.txt"} and paths(no_ignore_global=True) == paths(global_ignore=None) == {"a.txt", "b.log"}
