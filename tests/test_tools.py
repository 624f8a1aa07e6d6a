"""Baselines, edits, import graphs, blame, settings, reports and the command line, on small cases."""

import json
import sqlite3

from pyspark.sql import functions as F

from twinsift import __main__ as cli
from twinsift.operators import baseline, edits, modules, reports
from twinsift.sources import changes, settings

ENDS = "ord bigint, file1 string, name1 string, hash1 string, file2 string, name2 string, hash2 string"


def _pairs(spark, rows):
    return spark.createDataFrame(rows, ENDS)


def test_baseline_passes(spark, tmp_path):
    known = _pairs(spark, [
        (0, "a/x.py", "f", "1", "a/y.py", "g", "2"),  # same places and names
        (1, "a/x.py", "p", "3", "a/y.py", "q", "4"),  # renamed functions
        (2, "b/x.py", "f", "5", "b/y.py", "g", "6"),  # renamed files
        (3, "c/x.py", "f", "7", "d/y.py", "g", "8"),  # moved to another folder, names kept
        (4, "e/x.py", "f", "9", "e/y.py", "g", "9"),  # moved, but both hashes equal: gone
    ])
    now = _pairs(spark, [
        (10, "a/y.py", "g", "20", "a/x.py", "f", "10"), (11, "a/x.py", "r", "3", "a/y.py", "s", "4"), (12, "b/v.py", "f", "5", "b/w.py", "g", "6"),
        (13, "k/x.py", "f", "7", "l/y.py", "g", "8"), (14, "m/x.py", "f", "9", "n/z.py", "g", "9"), (15, "a/x.py", "f", "1", "a/y.py", "g", "2"),
    ])
    found = {(r["clone"], r["record"]) for r in baseline.matches(now, known).collect()}
    assert found == {(10, 0), (11, 1), (12, 2), (13, 3)}
    assert {r.ord for r in baseline.unknown_clones(now, known).collect()} == {14, 15}
    baseline.record(known, str(tmp_path / "b"))
    again = baseline.load(spark, str(tmp_path / "b"))
    assert again.count() == 5
    dirty = spark.createDataFrame([("e/y.py",)], "file string")
    assert {r.ord for r in baseline.pruned(again, now).collect()} == {0, 1, 2, 3}
    assert {r.ord for r in baseline.pruned(again, now, dirty).collect()} == {0, 1, 2, 3, 4}
    assert baseline.matches(now.limit(0), known).count() == 0


def test_edits(spark):
    files = spark.createDataFrame([("a", "one two\nthree\n"), ("b", "same"), ("c", "0123456789")], "file string, content string")
    plan = spark.createDataFrame([("a", 8, 13, "drei"), ("a", 0, 3, "eins"), ("a", 14, 14, "end"), ("c", 0, 5, "x"), ("c", 4, 6, "y")], "file string, start int, end int, new string")
    out = {r.file: (r.content, r.refused) for r in edits.apply_edits(files, plan).collect()}
    assert out == {"a": ("eins two\ndrei\nend", False), "b": ("same", False), "c": ("0123456789", True)}
    assert [(r.file, r.start) for r in edits.colliding_edits(plan).collect()] == [("c", 4)]
    patch = {r.file: r.patch for r in edits.patches(files, plan).collect()}
    assert set(patch) == {"a"} and "+drei\n+end\n\\ No newline" in patch["a"]
    lines = [(r.line, r.start, r.length) for r in edits.line_offsets(files).where("file = 'a'").orderBy("line").collect()]
    assert lines == [(1, 0, 8), (2, 8, 6)]
    text = "aé€😀b"
    got = [spark.range(1).select(edits.char_column(F.lit(text), F.lit(n)).alias("c")).first().c for n in range(len(text.encode()) + 1)]
    assert got == [len(text.encode()[:n].decode(errors="ignore")) for n in range(len(text.encode()) + 1)]


def test_import_graph(spark):
    imports = spark.createDataFrame([("a", "b.c.x"), ("a", "os"), ("b.c", "d"), ("d", "e"), ("e", "b.c")], "module string, imported string")
    known = spark.createDataFrame([(m,) for m in ("a", "b", "b.c", "d", "e")], "module string")
    edges = modules.resolved_edges(imports, known)
    assert {(r.src, r.dst) for r in edges.collect()} == {("a", "b.c"), ("b.c", "d"), ("d", "e"), ("e", "b.c")}
    assert {(r.dst, r.hops) for r in modules.reachable(edges).where("src = 'a'").collect()} == {("b.c", 1), ("d", 2), ("e", 3)}
    new = spark.createDataFrame([("d", "a"), ("a", "d"), ("a", "a")], "src string, dst string")
    assert {(r.src, r.dst) for r in modules.closes_cycle(edges, new).collect()} == {("d", "a"), ("a", "a")}


def test_blame(spark):
    a, b = "a" * 40, "b" * 40
    text = [f"{a} 1 1 1", "author Ann", "author-time 100", "summary one", "\tauthor-time 999", f"{b} 2 2 1", "author Bo", "author-time 300", "summary two", "\ty", f"{a} 3 3", "\tz"]
    rows = changes.latest_commit(spark.createDataFrame([("k", n, x) for n, x in enumerate(text)], "blame string, ln int, line string")).collect()
    assert [tuple(r) for r in rows] == [("k", "b" * 8, "Bo", 300, "two")]
    assert changes.git_files("/", "--exec=x") == [] and changes.git_value("/proc", "head") is None


def test_coverage_of_branches(spark, tmp_path):
    path = str(tmp_path / "cov")
    with sqlite3.connect(path) as db:
        db.executescript("create table file (id integer, path text); create table arc (file_id integer, fromno integer, tono integer); insert into file values (1, 'a.py'); insert into arc values (1, -1, 1), (1, 1, 2), (1, 2, -1);")
    assert sorted(r.line for r in changes.read_coverage_sqlite(spark, path).collect()) == [1, 2]


def test_settings(tmp_path):
    assert settings.load_settings(str(tmp_path))["threshold"] == 0.9
    (tmp_path / "pyproject.toml").write_text("[project]\nname = 'x'\n")
    path = settings.init_settings(str(tmp_path))
    assert path.endswith("pyproject.toml") and settings.load_section(path)["min_lines"] == 8
    (tmp_path / "own.toml").write_text("threshold = 0.5\n")
    assert settings.load_settings(str(tmp_path), str(tmp_path / "own.toml"))["threshold"] == 0.5
    (tmp_path / "bad.toml").write_text("= =")
    assert settings.load_section(str(tmp_path / "bad.toml")) == {}


BODY = "    total = 0\n    for r in rows:\n        if r > 1:\n            total += r\n        else:\n            total -= 1\n    print(total)\n    return total\n"


def test_command_line(spark, tmp_path, capsys):
    for name in "ab":
        (tmp_path / f"{name}.py").write_text(f"def {name}1(rows):\n{BODY}")
    out = tmp_path / "out" / "r.json"
    assert cli.main(["scan", str(tmp_path), "--format", "json", "--output", str(out), "--fail"]) == 1
    report = json.loads(out.read_text())
    assert len(report["clones"]) == 1 and report["clones"][0]["similarity"] == 1.0 and report["stats"]["sloc"] == 18
    for form, sign in (("text", "100.0%"), ("github", "::warning file="), ("markdown", "| SLOC | 18 |")):
        cli.main(["scan", str(tmp_path), "--format", form])
        assert sign in capsys.readouterr().out
    sarif = tmp_path / "r.sarif"
    cli.main(["scan", str(tmp_path), "--format", "sarif", "--output", str(sarif)])
    assert json.loads(sarif.read_text())["runs"][0]["results"][0]["level"] == "error"
    page = tmp_path / "r.html"
    cli.main(["scan", str(tmp_path), "--format", "html", "--output", str(page)])
    assert '<div class="pair"><b>100.0%' in page.read_text()


def test_pair_texts(spark):
    row = spark.createDataFrame([("test_a", "x\ny", "test_b", "x\nz"), ("load_a", "p", "load_b", "p")], "n string, a string, m string, b string")
    out = [r.s for r in row.select(reports.suggestion("n", "a", "m", "b").alias("s")).collect()]
    assert "parametrize" in out[0] and "2 varying" in out[0] and "_shared_load" in out[1]
    assert "-y\n+z" in row.select(reports.clone_diff("n", "a", "m", "b").alias("d")).first().d


def test_shared_module_lies_in_the_lowest_common_folder(spark):
    rows = [("a/b/x.py", "a/c/y.py"), ("a/b/x.py", "a/b/x.py"), ("x.py", "a/y.py"), ("a/b/c/x.py", "a/b/y.py"), ("ab/x.py", "a/y.py"), ("/a/x.py", "/a/y.py"), ("../a/x.py", "a/y.py"), (None, "a/y.py")]
    df = spark.createDataFrame(rows, "p string, q string")
    found = [r.f for r in df.select(modules.common_folder("p", "q").alias("f")).collect()]
    assert found == ["a", "a/b", "", "a/b", "", "", "", None]
    names = {name: df.limit(1).select(modules.shared_module("p", "q", name).alias("f")).first().f for name in ("x.py", "../../x", "class.py", "no name", "")}
    assert names == {"x.py": "a/x.py", "../../x": "a/x.py", "class.py": "a/_common.py", "no name": "a/_common.py", "": "a/_common.py"}
