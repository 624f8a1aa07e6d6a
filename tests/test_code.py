import ast

import pytest

from twinsift.sources import code

SOURCE = "def f(a, b):\n    out = []\n    for x in a:\n        if x == 1:\n            out.append(x)\n    logger.info(x)\n    total = a + b\n    return out\n"


def _units(text, **options):
    return {(u[1], u[2]) for u in code.units_of("a.py", text, 1, 1, **options)}


def test_identifier_tokens():
    root = ast.parse(SOURCE).body[0]
    plain = code.tokens_of(root)
    assert {"VAR", "ARG", "ATTR"} <= set(plain) and "Name" not in plain
    assert {"ARG_0", "ARG_1", "LVAR_0"} <= set(code.tokens_of(root, renaming=True))
    assert code.tokens_of(ast.parse("len(q)").body[0], renaming=True).count("BUILTIN_len") == 1


def test_tokens_of_statements_do_not_interleave():
    a, b = ast.parse("x = 1\ny = f(2)").body
    assert code.tokens_of([a, b]) == code.tokens_of(a) + code.tokens_of(b)


def test_boilerplate_and_markers():
    root = ast.parse(SOURCE).body[0]
    assert len(code.tokens_of(root, boilerplate=True)) < len(code.tokens_of(root))
    tokens = code.tokens_of(root, abstract=True)
    assert tokens.count("COND") == 1 and tokens.count("EXPR") == 1


@pytest.mark.parametrize(
    ("loop", "short"),
    [
        ("for x in a:\n    r.append(x + 1)", "r = [x + 1 for x in a]"),
        ("for x in a:\n    if x:\n        self.r.add(x)", "self.r = {x for x in a if x}"),
        ("for x in a:\n    r[x] = 1", "r = {x: 1 for x in a}"),
        ("for x in a:\n    if x > 1:\n        return True", "return any((x > 1 for x in a))"),
        ("for x in a:\n    if not x:\n        return False", "return all((x for x in a))"),
        ("for x in a:\n    if x:\n        return False", "for x in a:\n    if x:\n        return False"),
    ],
)
def test_idioms(loop, short):
    assert ast.unparse(code._Idioms().visit(ast.parse(loop))) == short


def test_commutative_order():
    dump = lambda t: ast.dump(code._ordered_operands(ast.parse(t)))
    assert dump("b == a") == dump("a == b") and dump("a + b") == dump("b + a") and dump("a < b") != dump("b < a")


def test_exempt_functions_hide_their_blocks():
    assert _units("# noqa: clone\n" + SOURCE) == set()
    assert ("f", "function") in _units(SOURCE) and ("f:For", "compound_block") in _units(SOURCE)
    assert _units(SOURCE, functions_only=True) == {("f", "function")}


def test_closures_and_comprehensions():
    text = "z = [q for q in w if q if q + 1]\ndef f(a):\n    def g(b):\n        c = b + 1\n        d = c * b\n        return [c + e for e in b if e]\n    return g\n"
    assert ("f:g", "closure") in _units(text, kinds=("closure",)) and ("g", "function") in _units(text)
    assert {("module:listcomp_L1", "comprehension"), ("g:listcomp_L6", "comprehension")} <= _units(text, kinds=("comprehension",))


def test_imports():
    text = "import a.b\nfrom . import x\nfrom ..r import y\nfrom ....z import no0\ntry:\n    import z\nexcept ImportError:\n    import w\nif TYPE_CHECKING:\n    import no1\ndef f():\n    import no2\n"
    assert code.imports_of("src/p/q/m.py", text) == ["a.b", "p.q", "p.q.x", "p.r", "p.r.y", "w", "z"]
    assert code.imports_of("m.py", "def (") == []
    assert [code.module_name(p) for p in ("src/p/__init__.py", "a/b.py", "__init__.py")] == ["p", "a.b", ""]


def test_parsing_uses_all_cores(spark):
    files = spark.createDataFrame([(f"{k}.py", "x = 1\n") for k in range(40)], "file string, content string").coalesce(1)
    assert code.harvest(files).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
