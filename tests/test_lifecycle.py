"""Paths in two systems, baseline files, candidates with a budget, annotations, filters and warnings."""

import json

import pytest
from pyspark.sql import functions as F

from twinsift.functions import annotations, paths
from twinsift.operators import baseline, candidates, checks, lifecycle, similarity
from twinsift.sources import changes, code


def test_roots_and_offsets():
    assert paths.root_text("c:\\a\\.\\b/") == "C:/a/b" and paths.root_text("/") == "/" and paths.root_text(".") == "" and paths.root_text("a//b") == "a/b"
    assert paths.path_offset("/r/app", "/r") == "app" and paths.path_offset("/r", "/r/") == "" and paths.path_offset("/rx", "/r") is None and paths.path_offset("/a", "/") == "a"
    assert paths.target_offsets("/r/app", "/r", "/r/lib") == ("app", "lib")


def test_coordinates_by_basis(spark):
    rows = spark.createDataFrame([(x,) for x in ("app/m.py", "m.py", "/r/app/n.ipynb#cell_2", "../../x.py", "C:\\q.py", None)], "p string")
    got = lambda basis, strip=False: [tuple(r.c)[1:] for r in rows.select(paths.coordinates("p", "/r/app", "/r", basis, strip).alias("c")).collect()]
    assert got("auto")[:3] == [("m.py", "app/m.py", "m.py"), ("m.py", "app/m.py", "m.py"), ("n.ipynb#cell_2", "app/n.ipynb#cell_2", "n.ipynb#cell_2")]
    assert got("target")[0] == ("app/m.py", "app/app/m.py", "app/m.py") and got("repo")[1] == (None, "m.py", "m.py")
    assert got("auto")[3] == (None, None, "../../x.py") and got("auto")[4] == (None, None, "C:/q.py") and got("auto")[5] == (None, None, None)
    assert got("auto", True)[2][0] == "n.ipynb"
    same = [tuple(r.c)[1:] for r in rows.select(paths.coordinates("p", "/r", "/r").alias("c")).collect()]
    assert same[1] == ("m.py", "m.py", "m.py")
    assert rows.where(paths.equivalent(F.lit("x/app/m.py"), F.col("p"), "/r/app", "/r")).count() == 2
    with pytest.raises(ValueError):
        paths.coordinates("p", "/r", "/r", "other")


def test_paths_of_git_in_the_target(spark):
    ranges = spark.createDataFrame([("app/a.py", 1, 2), ("lib/b.py", 3, 4)], "file string, lo int, hi int")
    found = {tuple(r) for r in paths.ranges_by_basis(ranges, "/r", "/r/app").collect()}
    assert found == {("repo", "app/a.py", 1, 2), ("repo", "lib/b.py", 3, 4), ("target", "a.py", 1, 2)}
    units = spark.createDataFrame([(1, "a.py")], "id int, file string")
    assert paths.unit_ranges(units, paths.ranges_by_basis(ranges, "/r", "/r/app"), "target").count() == 1
    assert paths.worktree_paths(ranges, "/r", "/elsewhere").count() == 0


def test_settings_are_not_trusted(spark):
    assert [lifecycle.safe_int(x) for x in (3, "4", True, 0, "x", None, float("inf"))] == [3, 4, None, None, None, None, None]
    assert [lifecycle.safe_frequency(x) for x in (0.5, "1", 0, 2, "nan", True)] == [0.5, 1.0, None, None, None, None]
    assert lifecycle.safe_bool("Yes") and not lifecycle.safe_bool("off") and lifecycle.safe_units(10**12) == 10**9 and lifecycle.safe_units(-1) == 0
    assert lifecycle.safe_least_corpus(None) == 30 and lifecycle.safe_least_corpus("x", True) == 4 and lifecycle.safe_hash("A" * 64) == "a" * 64 and lifecycle.safe_hash("zz") is None
    counts = spark.createDataFrame([("a", "3"), ("a", "9"), ("b", "-1"), ("c", "x"), (None, "1")], "key string, df string")
    assert [tuple(r) for r in lifecycle.frequencies(counts, 5).collect()] == [("a", 5)]


def test_keys_on_file(spark):
    for key in (("a", "b"), ("a", ("b", 1)), "plain", "t:x", "[x", 7, 2.5, True, False):
        assert lifecycle.key_value(lifecycle.key_text(key)) == key
    assert lifecycle.key_value('["old", "form"]') == ("old", "form") and lifecycle.key_value("i:x") == "i:x"
    assert lifecycle.key_value("t:" + "[" * 30 + "]" * 30) == "t:" + "[" * 30 + "]" * 30
    row = spark.createDataFrame([(["If", "VAR"],)], "t array<string>").select(lifecycle.key_text_column("t")).first()
    assert row[0] == lifecycle.key_text(["If", "VAR"])


def test_baselines_of_any_version(spark, tmp_path):
    old = tmp_path / "old.json"
    old.write_text(json.dumps(["a.py:f <===> b/c.py:g", "no print"]))
    found = lifecycle.read_file(spark, f"file://{old}")
    assert found.version == "1.0" and [(r.file1, r.name1, r.file2, r.name2) for r in found.records.collect()] == [("a.py", "f", "b/c.py", "g")]
    new = tmp_path / "new.json"
    clone = {"file1": "a.py", "name1": "f", "hash1": "h", "unit2": {"file": "b.py", "name": "g", "structural_hash": "k"}}
    saved = {"total_units": 50, "bag_of_tokens": "true", "shingle_frequencies": {"t:[\"x\"]": 99, "bad": -3}}
    new.write_text(json.dumps({"version": "1.5", "path_basis": "repo_relative", "target": "app", "clones": [clone, 5], "corpus_calibration": saved}, indent=1))
    found = lifecycle.read_file(spark, f"file://{new}")
    assert (found.version, found.basis, found.target) == ("1.5", "repo_relative", "app") and found.calibration["bag_of_tokens"]
    assert [r.hash2 for r in found.records.collect()] == ["k"] and [tuple(r) for r in found.frequencies.collect()] == [('t:["x"]', 50)]


def test_calibrations_that_do_not_fit():
    saved = {"bag_of_tokens": True, "max_index_frequency": 0.3, "excludes": ["b", "a"], "scope": "app"}
    assert lifecycle.is_compatible(saved, {**saved, "excludes": ["a", "b"], "total_units": 9})
    assert lifecycle.setting_mismatch(saved, {**saved, "max_index_frequency": 0.2}) == "max_index_frequency"
    assert lifecycle.setting_mismatch({**saved, "config_hash": "0" * 64}, saved) == "config_hash"
    fresh = lifecycle.refreshed(saved, "lib", "repo_relative")
    assert fresh["scope"] == "lib" and fresh["version"] == lifecycle.VERSION and lifecycle.setting_mismatch(fresh, {**saved, "scope": "lib"}) is None


ENDS = "ord bigint, file1 string, name1 string, hash1 string, file2 string, name2 string, hash2 string"


def test_pruning_counts_and_rewrites(spark):
    known = spark.createDataFrame([(0, "a.py", "f", "1", "b.py", "g", "2"), (1, "c.py", "f", "3", "d.py", "g", "4"), (2, "e.py", "f", "5", "h.py", "g", "6")], ENDS)
    clones = spark.createDataFrame([(0, "new/b.py", "g", "2", "new/a.py", "f", "1")], ENDS)
    dirty = spark.createDataFrame([("app/d.py",)], "file string")
    kept, result = lifecycle.prune(lifecycle.BaselineFile(known, target="/r/app"), clones, dirty, repo="/r")
    assert tuple(result) == (1, 1, 1)
    rows = {r.ord: (r.file1, r.file2, r.state) for r in kept.collect()}
    assert rows == {0: ("new/a.py", "new/b.py", "retained"), 1: ("c.py", "d.py", "dirty")}
    assert lifecycle.detected_basis(clones, "new") == "repo_relative" and lifecycle.detected_basis(clones, "app") == "target_relative"
    prints = spark.createDataFrame([("a.py:f <===> b.py:g",), ("3 <===> 4",)], "fingerprint string")
    assert [r.ord for r in lifecycle.without_known_prints(known, prints).collect()] == [2]


def test_novel_shingles_have_a_budget(spark):
    rows = [("a", k) for k in range(4)] + [("b", k) for k in range(3, 6)] + [("known", 7), ("known", 8), ("stop", 1), ("stop", 9)]
    index = spark.createDataFrame(rows, "shingle string, id int")
    saved = spark.createDataFrame([("known", 2)], "shingle string, df int")
    stop = spark.createDataFrame([("stop",)], "shingle string")
    pairs = lambda **more: {tuple(r) for r in candidates.candidate_pairs(index, 10, 9, stop, saved, 10, **more).collect()}
    assert len(pairs()) == 6 + 3 + 1 and pairs(budget=6) == {(a, b) for a in range(4) for b in range(a + 1, 4)} | {(7, 8)} and pairs(budget=0) == {(7, 8)}
    changed = spark.createDataFrame([(0,), (7,)], "id int")
    assert pairs(changed=changed) == {(0, 1), (0, 2), (0, 3), (7, 8)}
    assert candidates.stop_shingles(spark, [("x", "y")]).count() == 31


def test_identical_units_keep_their_pairs(spark):
    units = spark.createDataFrame([(k, [f"w{i}" for i in range(20)]) for k in range(30)] + [(100 + k, [f"v{k}_{i}" for i in range(20)]) for k in range(100)], "id int, tokens array<string>")
    cap = similarity.postings_cap(130)
    for found in (similarity.jaccard_pairs, similarity.multiset_pairs, similarity.tfidf_pairs, similarity.tfidf_multiset_pairs, similarity.alignment_pairs):
        assert found(units, 0.9, cap=cap).count() == 435, found
    light = spark.createDataFrame([("a", 0.5)], "key string, w double")
    two = spark.createDataFrame([(1, ["a", "a", "b"]), (2, ["a", "b", "b"])], "id int, tokens array<string>")
    assert similarity.tfidf_multiset_pairs(two, 0.1, weights=light).first().sim == 1.5 / 3.0


def test_annotations():
    assert annotations.split_outside("a, b[c, d], 'x,y'", ",") == ["a", "b[c, d]", "'x,y'"]
    assert annotations.members("Optional[Union[int, str]] | int") == ["int", "str", "None"]
    assert annotations.union_text("None | typing.Union[A, NoneType]") == "A | None" and annotations.union_text("int | Any") == "Any"
    assert annotations.merged("int", "str") == "Any" and annotations.merged("int", "str", "union") == "int | str" and annotations.merged(None, "int") == "int"
    assert annotations.merged("int | None", "Optional[int]") == "int | None" and annotations.compatible("int", "Any") and not annotations.compatible("int", "str")
    assert annotations.outputs_type([]) == "None" and annotations.outputs_type(["int", None]) == "tuple[int, Any]"
    assert annotations.typing_names(["List[int]", "typing.Any", "'Dict'", None]) == ["List"] and annotations.parameters_text(["a", "b"], {"a": "int"}) == "a: int, b"


def test_filters_and_warnings(spark, tmp_path):
    pairs = spark.createDataFrame([("T.test_a", "test_b:if"), ("test_a", "b")], "name1 string, name2 string")
    assert checks.only_tests(pairs).count() == 1
    units = spark.createDataFrame([(3, 4, 1, 2), (3, 2, 0, 0), (3, 3, 5, 2), (3, 3, None, None)], "start int, end int, col int, end_col int")
    ok = lambda strict: [r[0] for r in units.select(checks.valid_coordinates(strict=strict)).collect()]
    assert ok(False) == [True, False, False, True] and ok(True) == [True, False, False, False]
    text = "import x\n# pragma: no-refactor\n@d\ndef f():\n    pass\ndef g():\n    pass\n"
    files = spark.createDataFrame([("a.py", text)], "file string, content string")
    two = spark.createDataFrame([("a.py", 4, 5), ("a.py", 6, 7)], "file string, start int, end int")
    assert [r.source for r in checks.unit_source(two, files).orderBy("start").collect()] == ["def f():\n    pass\n", "def g():\n    pass\n"]
    lined = two.join(files, "file").withColumn("lines", F.split("content", "\n")).orderBy("start")
    assert [r[0] for r in lined.select(checks.keeps_as_is("lines")).collect()] == [True, False]
    (tmp_path / "a.py").write_text("x")
    (tmp_path / "l.py").symlink_to(tmp_path / "a.py")
    assert checks.safe_file("a.py", str(tmp_path)) and not checks.safe_file("l.py", str(tmp_path)) and not checks.safe_file("../a.py", str(tmp_path))
    edits = spark.createDataFrame([(1, 86400), (2, 101 * 86400)], "id int, ts bigint")
    found = checks.risk_warnings(spark.createDataFrame([(1, 2)], "i int, j int"), edits).collect()
    assert [(r.kind, r.line) for r in found] == [("divergence", "last edits lie 100 days apart")]
    assert checks.coloured("x", "red") == "\x1b[31mx\x1b[0m" and not checks.wants_colour(environ={"NO_COLOR": ""}) and "25.00 %" in checks.scorecard({"sloc": 8, "duplicated": 2})


def test_quoted_paths_of_git(spark):
    assert changes.plain_text(r"caf\303\251\t\"q\\.py") == 'café\t"q\\.py'
    lines = ['--- "a/caf\\303\\251.py"', '+++ "b/caf\\303\\251.py"', "@@ -1 +2,3 @@", "--- a/x y.py", "+++ b/x y.py", "@@ -1 +5 @@"]
    diff = spark.createDataFrame([(1, k, x) for k, x in enumerate(lines)], "diff int, ln int, line string")
    assert [(r.file, r.lo, r.hi) for r in changes.parse_diff(diff).collect()] == [("café.py", 2, 4), ("x y.py", 5, 5)]


def test_operands_in_one_order():
    import ast

    plain = lambda text: ast.dump(code._ordered_operands(ast.parse(text)))
    for a, b in (("b + a", "a + b"), ("x == f(b and a)", "f(a and b) == x"), ("(c * b) | a", "a | (b * c)")):
        assert plain(a) == plain(b)
    for a, b in (("a - b", "b - a"), ("a < b", "b < a"), ("a == b == c", "c == b == a")):
        assert plain(a) != plain(b)


def test_many_small_sets_share_a_call(spark):
    """Sets of one clone and one record each: Python gets them many at a time, not one by one."""
    rows = spark.range(3000).select(F.col("id").alias("ord"), *(F.concat(F.lit(x), F.col("id").cast("string")).alias(c) for c, x in zip(baseline.ENDS, ("old/a", "f", "x", "old/b", "g", "y"), strict=True)))
    moved = rows.where("ord % 3 <> 0").withColumns({c: F.replace(c, F.lit("old"), F.lit("new")) for c in ("file1", "file2")})
    found = baseline.matches(moved, rows)
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in found.collect()) == [(k, k) for k in range(3000) if k % 3]
