import itertools

from pyspark.sql import functions as F

from twinsift.functions import columns as C
from twinsift.operators import families, pairs, scan, similarity
from twinsift.sources import changes, code

BRANCHES = "def f(a, b):\n    if a and b:\n        for x in a:\n            while x:\n                x -= 1\n    elif b or a:\n        return 1\n    return 0\n"


def test_lcs_matches_table():
    a, b = list("ABCBDAB"), list("BDCABA")
    assert similarity.lcs_length(a, b) == 4
    assert similarity.lcs_length([], b) == 0


def test_jaccard_pairs_match_brute_force(spark):
    texts = {0: "a b c d e f g", 1: "a b c d e f h", 2: "x y", 3: "x y", 4: "q r s t", 5: ""}
    units = spark.createDataFrame([(k, v.split()) for k, v in texts.items()], "id bigint, tokens array<string>")

    def sh(t):
        t = t.split()
        return {tuple(t[i : i + 3]) for i in range(max(1, len(t) - 2))} if t else set()

    want = {(i, j) for i, j in itertools.combinations(texts, 2) if (u := sh(texts[i]) | sh(texts[j])) and len(sh(texts[i]) & sh(texts[j])) / len(u) >= 0.5}
    assert {(r.i, r.j) for r in similarity.jaccard_pairs(units, 0.5).collect()} == want == {(0, 1), (2, 3)}


def test_families_and_linkage(spark):
    edges = spark.createDataFrame([("A", "B", 0.95), ("B", "C", 0.9), ("A", "C", 0.9), ("C", "D", 0.7), ("E", "F", 0.85)], "k1 string, k2 string, sim double")
    single = {r.node: r.component for r in families.linked_families(edges).collect()}
    assert single == {"A": "A", "B": "A", "C": "A", "D": "A", "E": "E", "F": "E"}
    full = {r.node: r.component for r in families.linked_families(edges, "complete", 0.8).collect()}
    assert full["C"] == "A" and full["D"] == "D"


def test_suppression_and_overlap(spark):
    rows = [(0, "f", 1, 30, "g", 1, 30, 0.9), (1, "f", 5, 20, "g", 5, 20, 0.92), (2, "f", 5, 20, "g", 5, 20, 0.99)]
    df = spark.createDataFrame(rows, "ord int, file1 string, start1 int, end1 int, file2 string, start2 int, end2 int, sim double")
    assert sorted(r.ord for r in pairs.suppress_contained(df).collect()) == [0, 2]
    units = spark.createDataFrame([("f", 1, 10), ("f", 5, 30), ("f", 31, 40)], "file string, start int, end int")
    assert sorted((r.start, r.end) for r in pairs.largest_disjoint(units).collect()) == [(5, 30), (31, 40)]


def test_diff_ranges(spark):
    lines = ["--- a/x.py", "+++ b/x.py", "@@ -10,0 +12,8 @@", "@@ -50,3 +50,1 @@", "--- a/y.py", "+++ /dev/null", "@@ -1,2 +0,0 @@"]
    df = spark.createDataFrame([("d", k, x) for k, x in enumerate(lines)], "diff string, ln int, line string")
    assert [(r.file, r.lo, r.hi) for r in changes.parse_diff(df).orderBy("lo").collect()] == [("x.py", 12, 19), ("x.py", 50, 50)]


def test_code_units(spark):
    two = "def f(a, b):\n    t = a + b\n    for i in range(9):\n        t += i\n        t -= a\n        t *= b\n        t += 1\n    return t\n"
    files = spark.createDataFrame([("a.py", two), ("b.py", two.replace("t", "q")), ("c.py", "def ("), ("d.py", None)], "file string, content string")
    units = code.harvest(files, blind=True).where("kind = 'function'").collect()
    assert {u.file for u in units} == {"a.py"}
    import ast

    assert code.complexity_of(ast.parse(BRANCHES)) == 7
    assert code.complexity_of(ast.parse("try:\n    assert a\nexcept E:\n    pass")) == 3
    assert code.notebook_cells("n.ipynb", '{"cells": [{"cell_type": "markdown"}, {"cell_type": "code", "source": ["x"]}]}') == [("n.ipynb#cell_2", "x")]


def test_columns(spark):
    row = spark.range(1).select(
        C.notebook_cell(F.lit("a/b.ipynb#cell_3")).alias("cell"), C.without_dots(F.lit("a/./b/../c")).alias("p"), C.without_dots(F.lit("../c")).alias("out"),
        F.size(C.source_lines(F.lit("a\r\nb\rc\nd"))).alias("n"), C.lenient_int(F.lit("12:0")).alias("i"), C.priority(F.lit(0.95), F.lit(20), F.lit(20), F.lit(6), F.lit(2)).alias("pr"),
    ).first()
    assert (row.cell, row.p, row.out, row.n, row.i, row.pr) == (2, "a/c", None, 4, 12, 114.0)


def test_scan_broadcasts_no_units(spark):
    """A scan holds no table of units in the driver, and hands no pair of files to Python alone."""
    body = "def run(v):\n    a = open_{h}(v)\n    b = read_{h}(a)\n    if b:\n        c = sort_{h}(b)\n    else:\n        c = list_{h}(a)\n    return done_{h}(c)\n"
    files = spark.createDataFrame([(f"p{k}.py", body.replace("{h}", str(k // 2))) for k in range(80)], "file string, content string")
    found = scan.scan(files, 0.9, metric="calls", functions_only=True)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "FlatMapGroupsInPandas" not in plan
    assert {frozenset((r.file1, r.file2)) for r in found.collect()} == {frozenset((f"p{k}.py", f"p{k + 1}.py")) for k in range(0, 80, 2)}
