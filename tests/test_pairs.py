from twinsift.operators import pairs

PAIR = "file1 string, name1 string, start1 int, end1 int, shingles1 array<string>, file2 string, name2 string, start2 int, end2 int, shingles2 array<string>, sim double"


def test_merging_unites_shingles_and_renames(spark):
    rows = [
        ("a", "f:stmts_1-5", 1, 10, ["x", "y"], "b", "g:stmts_1-5", 1, 10, ["x", "y"], 1.0),
        ("b", "g:stmts_2-6", 12, 20, ["z"], "a", "f:stmts_2-6", 12, 20, ["z", "w"], 0.5),  # the other way round
        ("a", "f:stmts_9-13", 40, 50, ["q"], "b", "g:stmts_9-13", 40, 50, ["q"], 1.0),
    ]
    df = spark.createDataFrame(rows, PAIR)
    got = {(r.name1, r.name2, r.start1, r.end2, r.sim) for r in pairs.merge_adjacent(df).collect()}
    assert got == {("f:merged_1-20", "g:merged_1-20", 1, 20, 0.75), ("f:stmts_9-13", "g:stmts_9-13", 40, 50, 1.0)}
    assert pairs.merge_adjacent(df, threshold=0.8).count() == 1
    assert pairs.merge_adjacent(df.drop("shingles1", "shingles2"), threshold=0.9).count() == 2
    assert pairs.merge_adjacent(df.limit(0)).count() == 0


def test_exemptions_by_path_prefix_and_base_name(spark):
    rows = [(1, 2, "src/p/a.py", "f", "src/p/b.py", "g"), (3, 4, "x/a.py", "f", "y/b.py", "g"), (5, 6, "x/a.py", "k", "y/c.py", "g"), (7, 8, "d.py", "f", "e.py", "g")]
    df = spark.createDataFrame(rows, "i int, j int, file1 string, name1 string, file2 string, name2 string")
    left = lambda *e: {r.i for r in pairs.drop_exemptions(df, spark.createDataFrame(list(e), "a string, b string")).collect()}
    assert left(("p/b.py:g", "p/a.py:f")) == {3, 5, 7}
    assert left(("a.py:f", "b.py:g")) == {5, 7}
    assert left(("./x\\a.py", "y/c.py")) == {1, 3, 7}
    assert left(("d.py:f", "e.py:h")) == {1, 3, 5, 7}


def test_lookup_by_path(spark):
    units = spark.createDataFrame([("p/a.py",), ("q/n.ipynb#cell_2",), ("none.py",), ("b.py",)], "file string")
    values = spark.createDataFrame([("root/p/a.py", 0), ("a.py", 1), ("p/a.py", 2), ("q/n.ipynb", 3), ("x/b.py", 5), ("y/b.py", 4)], "path string, ord int")
    assert {(r.file, r.path) for r in pairs.lookup_by_path(units, values).collect()} == {("p/a.py", "p/a.py"), ("q/n.ipynb#cell_2", "q/n.ipynb"), ("b.py", "y/b.py")}
