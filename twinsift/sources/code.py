"""Units of Python source: functions, blocks, windows, classes, expressions, tables, comprehensions, notebook cells.

Parsing needs a syntax tree, so each file passes through one Python function (mapInPandas); what does not parse
gives no rows. All later steps are DataFrame operations on the units.
"""

from __future__ import annotations

import ast
import builtins
import hashlib
import json
import re
from collections import Counter, deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UNIT_SCHEMA = "file string, name string, kind string, start int, end int, start_col int, end_col int, tokens array<string>, calls array<string>, complexity int, structural_hash string, enclosing_class string, is_async boolean"
_DEFS = (ast.FunctionDef, ast.AsyncFunctionDef)
# What counts as a branch, as logging, as an annotation, and the comments that exempt a unit.
_BRANCH = (ast.If, ast.IfExp, ast.For, ast.AsyncFor, ast.While, ast.Try, ast.TryStar, ast.ExceptHandler, ast.match_case, ast.With, ast.AsyncWith)
_PRINTERS = {"print", "log"}
_LOGGERS = {"logger", "logging"}
_LOG_METHODS = {"debug", "info", "warning", "warn", "error", "critical", "exception", "fatal", "trace", "log", "_log"}
_ANNOTATION_FIELDS = {"annotation", "returns", "type_comment", "type_params"}
_PRAGMA = re.compile(r"#.*?(?:twinsift\s*:?\s*ignore|noqa:\s*(?:clone|duplicate))", re.IGNORECASE)
_BLOCK = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.Try, ast.TryStar, ast.With, ast.AsyncWith, ast.Match)
_COMPREHENSION = (ast.ListComp, ast.DictComp, ast.SetComp, ast.GeneratorExp)
_OPERATION = (ast.BinOp, ast.BoolOp, ast.UnaryOp, ast.Compare, ast.Call, ast.IfExp, ast.Subscript, ast.Attribute, ast.Lambda)


def read_sources(spark: SparkSession, folder: str, excludes: tuple[str, ...] = (), suffix: str = "*.py") -> DataFrame:
    """file, content of a tree, without paths that hold an excluded substring."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", suffix).load(folder)
    for e in excludes:
        files = files.where(~F.col("path").contains(e))
    return files.select(F.col("path").alias("file"), F.decode("content", "UTF-8").alias("content"))


class _Names:
    """Tokens of identifiers: their kind, numbers by first sight (blind), or builtin / argument / local (renaming)."""

    def __init__(self, blind: bool, renaming: bool):
        self.blind, self.renaming = blind, renaming
        self.seen: dict[str, dict[str, int]] = {"VAR": {}, "ATTR": {}, "ARG": {}, "LVAR": {}}

    def number(self, kind: str, name: str) -> str:
        known = self.seen[kind]
        return f"{kind}_{known.setdefault(name, len(known))}"

    def declare(self, args: ast.arguments) -> None:
        for a in (*args.posonlyargs, *args.args, *args.kwonlyargs, *filter(None, (args.vararg, args.kwarg))):
            if not hasattr(builtins, a.arg):
                self.number("ARG", a.arg)

    def token(self, kind: str, name: str) -> str:
        if not (self.blind or self.renaming):
            return kind
        if kind == "ATTR" or not self.renaming:
            return self.number(kind, name)
        if hasattr(builtins, name):
            return f"BUILTIN_{name}"
        return self.number("ARG" if kind == "ARG" or name in self.seen["ARG"] else "LVAR", name)


def _is_noise(n: ast.AST) -> bool:
    """Assertions, and statements that only print or log."""
    if not (isinstance(n, ast.Expr) and isinstance(n.value, ast.Call)):
        return isinstance(n, ast.Assert)
    f = n.value.func
    if isinstance(f, ast.Name):
        return f.id in _PRINTERS
    return isinstance(f, ast.Attribute) and (f.attr in _LOG_METHODS or (isinstance(f.value, ast.Name) and f.value.id in _LOGGERS))


def _marker(n: ast.AST, field: str, value) -> str | None:
    """COND for a computed test or guard, EXPR for a computed value that is assigned."""
    if (field == "test" and isinstance(n, (ast.If, ast.While, ast.IfExp))) or (field == "guard" and isinstance(n, ast.match_case)):
        return "COND" if isinstance(value, (ast.Compare, ast.BoolOp, ast.UnaryOp)) else None
    if field == "value" and isinstance(n, (ast.Assign, ast.AnnAssign, ast.AugAssign)):
        return "EXPR" if isinstance(value, (ast.BinOp, ast.UnaryOp, ast.Compare, ast.BoolOp, ast.IfExp)) else None
    return None


def _has_docstring(n: ast.AST) -> bool:
    if not isinstance(n, (*_DEFS, ast.ClassDef, ast.Module)) or not n.body or not isinstance(n.body[0], ast.Expr):
        return False
    return isinstance(n.body[0].value, ast.Constant) and isinstance(n.body[0].value.value, str)


#: Fields of each node type, with and without annotations.
_FIELDS: dict[bool, dict[type, tuple[str, ...]]] = {False: {}, True: {}}
_KINDS = {ast.FunctionDef: "FUNC", ast.AsyncFunctionDef: "FUNC", ast.ClassDef: "CLASS"}
_NAMED = {ast.Name: ("VAR", "id"), ast.Attribute: ("ATTR", "attr"), ast.arg: ("ARG", "arg")}
_BRANCHES = frozenset(_BRANCH)


def _fields(kind: type, annotations: bool) -> tuple[str, ...]:
    known = _FIELDS[annotations]
    if kind not in known:
        known[kind] = tuple(f for f in kind._fields if annotations or f not in _ANNOTATION_FIELDS)
    return known[kind]


class _Children(dict):
    """Child nodes of each node of a tree that no longer changes, listed once."""

    def __init__(self, tree: ast.AST):
        super().__init__()
        self.nodes = [tree]  # breadth first
        for n in self.nodes:
            found = self[n] = list(ast.iter_child_nodes(n))
            self.nodes += found

    def __missing__(self, n):
        return list(ast.iter_child_nodes(n))


def tokens_of(nodes, blind: bool = False, literals: bool = False, renaming: bool = False, boilerplate: bool = False, abstract: bool = False, annotations: bool = False, docstrings: bool = False) -> list[str]:
    """Node names, breadth first within each node of a list; constants by type.

    blind / renaming number identifiers, literals blinds constants (and drops docstrings), boilerplate drops logging,
    abstract replaces computed tests and values by markers, annotations / docstrings keep what is left out otherwise.
    """
    names, numbered = _Names(blind, renaming), blind or renaming
    out: list[str] = []
    for root in nodes if isinstance(nodes, list) else [nodes]:
        if renaming and isinstance(root, _DEFS):
            names.declare(root.args)
        queue = deque([root])
        while queue:
            n = queue.popleft()
            if boilerplate and _is_noise(n):
                continue
            kind = type(n)
            if kind is ast.Constant:
                out.append("LITERAL" if literals else f"CONST_{type(n.value).__name__}")
            elif kind in _NAMED:
                label, name = _NAMED[kind]
                out.append(names.token(label, getattr(n, name)) if numbered else label)
            elif kind in _KINDS:
                out.append(_KINDS[kind])
            else:
                out.append("Assign" if kind is ast.AnnAssign and not annotations else kind.__name__)
            for field in _fields(kind, annotations):
                value = getattr(n, field, None)
                if abstract and (mark := _marker(n, field, value)):
                    out.append(mark)
                elif isinstance(value, ast.AST):
                    queue.append(value)
                elif value.__class__ is list:
                    if field == "body" and (literals or not docstrings) and _has_docstring(n):
                        value = value[1:]
                    queue.extend([x for x in value if isinstance(x, ast.AST)])
    return out


def calls_of(nodes, children: dict | None = None) -> list[str]:
    """Names of called functions, outer before inner. children: those of each node, where they are listed already."""
    out = []
    stack = list(reversed(nodes)) if isinstance(nodes, list) else [nodes]
    while stack:
        n = stack.pop()
        if type(n) is ast.Call:
            if isinstance(n.func, ast.Name):
                out.append(n.func.id)
            elif isinstance(n.func, ast.Attribute):
                out.append(n.func.attr)
        below = list(ast.iter_child_nodes(n)) if children is None else children[n]
        if below:
            stack += below[::-1]
    return out


def complexity_of(nodes, children: dict | None = None) -> int:
    """Cyclomatic: 1, branches, extra operands of and / or, conditions of comprehensions."""
    total = 1
    queue = list(nodes) if isinstance(nodes, list) else [nodes]
    for n in queue:
        kind = type(n)
        if kind in _BRANCHES:
            total += 1
        elif kind is ast.BoolOp:
            total += len(n.values) - 1
        elif kind is ast.comprehension:
            total += len(n.ifs)
        queue += ast.iter_child_nodes(n) if children is None else children[n]
    return total


#: Where the order of operands has no meaning: node type, the field with the operator (any of these types), the fields that hold the operands.
_UNORDERED = (
    (ast.BoolOp, "op", (ast.And, ast.Or), ("values",)),
    (ast.BinOp, "op", (ast.Add, ast.Mult, ast.BitAnd, ast.BitOr, ast.BitXor), ("left", "right")),
    (ast.Compare, "ops", (ast.Eq, ast.NotEq, ast.Is, ast.IsNot), ("left", "comparators")),
    (ast.MatchOr, None, (), ("patterns",)),
)


def _ordered_operands(tree: ast.AST) -> ast.AST:
    """The tree with the operands of unordered nodes sorted by their dumps, inner nodes first."""
    for n in reversed(list(ast.walk(tree))):
        for kind, operator, types, fields in _UNORDERED:
            if not isinstance(n, kind):
                continue
            used = getattr(n, operator) if operator else []
            used = used if isinstance(used, list) else [used]
            held = [getattr(n, f) for f in fields]
            operands = sorted((x for h in held for x in (h if isinstance(h, list) else [h])), key=ast.dump)
            if len(used) > 1 or not all(isinstance(o, types) for o in used):
                continue  # a chain of tests, or an operator whose sides differ
            for f, h in zip(fields, held, strict=True):
                setattr(n, f, [operands.pop(0) for _ in h] if isinstance(h, list) else operands.pop(0))
    return tree


class _Idioms(ast.NodeTransformer):
    """Loops that only fill a container become comprehensions; loops that only search become any() or all()."""

    def visit_For(self, node):
        self.generic_visit(node)
        if len(node.body) != 1 or node.orelse:
            return node
        step, tests = node.body[0], []
        if isinstance(step, ast.If) and len(step.body) == 1 and not step.orelse:
            step, tests = step.body[0], [step.test]
        loop = ast.comprehension(node.target, node.iter, tests, int(isinstance(node, ast.AsyncFor)))
        new = self._filled(step, loop)
        if new is None and tests and isinstance(node, ast.For):
            new = self._searched(step, tests[0], ast.comprehension(node.target, node.iter, [], 0))
        return node if new is None else ast.fix_missing_locations(ast.copy_location(new, node))

    visit_AsyncFor = visit_For

    @staticmethod
    def _filled(step, loop):
        match step:
            case ast.Expr(ast.Call(ast.Attribute(box, "append"), [item])):
                value = ast.ListComp(item, [loop])
            case ast.Expr(ast.Call(ast.Attribute(box, "add"), [item])):
                value = ast.SetComp(item, [loop])
            case ast.Assign([ast.Subscript(box, key)], item):
                value = ast.DictComp(key, item, [loop])
            case _:
                return None
        if isinstance(box, ast.Name):
            return ast.Assign([ast.Name(box.id, ast.Store())], value)
        return ast.Assign([ast.Attribute(box.value, box.attr, ast.Store())], value) if isinstance(box, ast.Attribute) else None

    @staticmethod
    def _searched(step, test, loop):
        match step, test:
            case ast.Return(ast.Constant(value=True)), _:
                name = "any"
            case ast.Return(ast.Constant(value=False)), ast.UnaryOp(ast.Not(), operand):
                name, test = "all", operand
            case _:
                return None
        return ast.Return(ast.Call(ast.Name(name, ast.Load()), [ast.GeneratorExp(test, [loop])], []))


def _local(root, children: dict):
    """Nodes below root, not inside nested functions or classes."""
    queue = deque(children[root])
    while queue:
        n = queue.popleft()
        yield n
        if not isinstance(n, (*_DEFS, ast.ClassDef)):
            queue.extend(children[n])


def units_of(file: str, text: str, min_lines: int = 8, min_tokens: int = 15, window: int = 0, blind: bool = False, canonical: bool = False, idioms: bool = False, functions_only: bool = False, kinds: tuple[str, ...] = (), **switches) -> Iterator[tuple]:
    """Rows of UNIT_SCHEMA. kinds: further kinds than functions and blocks (clause_branch, class, complex_expr, data_table, comprehension, closure).

    A comment from the line above a unit to its end can exempt it (and what lies in an exempt function); switches: of tokens_of.
    """
    lines = re.split(r"\r\n|\r|\n", text)

    def exempt(first: int, last: int) -> bool:
        return any(_PRAGMA.search(x) for x in lines[max(0, first - 2) : last])

    try:
        tree = ast.parse(text)
        if idioms:
            tree = _Idioms().visit(tree)
        if canonical:
            tree = _ordered_operands(tree)
    except (SyntaxError, ValueError, RecursionError):
        return
    half = min_tokens // 2
    bounds = {
        "complex_expr": (1, max(8, max(8, half) // 2)), "data_table": (1, max(10, max(10, half) // 2)), "comprehension": (1, max(8, max(8, half) // 2)),
        "clause_branch": (max(3, min_lines // 2), max(10, half)), "class": (max(3, min_lines // 2), min_tokens), "closure": (max(4, min_lines // 2), max(10, half)),
    }

    def unit(name, kind, nodes, owner=None, is_async=False):
        ends = (nodes[0], nodes[-1]) if isinstance(nodes, list) else (nodes, nodes)
        # a module has no position: a cell spans no lines, so that only min_lines <= 1 lets it pass
        first, start_col = getattr(ends[0], "lineno", 0), getattr(ends[0], "col_offset", 0)
        last, end_col = getattr(ends[1], "end_lineno", 0), getattr(ends[1], "end_col_offset", 0)
        height, least = bounds.get(kind, (min_lines, min_tokens))
        if last - first + 1 < height or exempt(first, last):
            return
        tokens = tokens_of(nodes, blind, **switches)
        if len(tokens) >= least:
            yield file, name, kind, first, last, start_col, end_col, tokens, calls_of(nodes, children), complexity_of(nodes, children), hashlib.sha256(" ".join(tokens).encode()).hexdigest()[:16], owner, is_async

    children = _Children(tree)
    defs = [n for n in children.nodes if isinstance(n, _DEFS)]
    owners = {id(f): c.name for c in children.nodes if isinstance(c, ast.ClassDef) for f in c.body}
    nested: dict[int, str] = {}  # nested function -> the innermost function around it
    around: dict[int, str] = {}  # node -> the innermost function around it
    for n in children.nodes:
        name = n.name if isinstance(n, _DEFS) else around.get(id(n))
        if name is not None:
            for below in children[n]:
                around[id(below)] = name
                if isinstance(below, _DEFS):
                    nested[id(below)] = name
    if "notebook_cell" in kinds:
        yield from unit(file.rpartition("#")[2], "notebook_cell", tree)
    for f in defs:
        owner, flag = owners.get(id(f)), isinstance(f, ast.AsyncFunctionDef)
        closure = id(f) in nested and "closure" in kinds
        name = f"{nested[id(f)]}:{f.name}" if closure else f.name
        if exempt(f.lineno, f.end_lineno):
            continue
        if closure or "notebook_cell" in kinds or len(f.body) - _has_docstring(f) > 1:
            yield from unit(name, "closure" if closure else "function", f, owner, flag)
        for n in _local(f, children):
            if not functions_only and isinstance(n, _BLOCK) and n.end_lineno - n.lineno < f.end_lineno - f.lineno:
                yield from unit(f"{name}:{type(n).__name__}", "compound_block", n, owner, flag)
            if "clause_branch" in kinds:
                for label in ("body", "orelse", "finalbody"):
                    branch = getattr(n, label, None)
                    if isinstance(n, (ast.If, ast.Try, ast.ExceptHandler, ast.match_case)) and isinstance(branch, list) and len(branch) >= 3:
                        yield from unit(f"{name}:{type(n).__name__.lower()}_{label}", "clause_branch", branch, owner, flag)
        for k in range(len(f.body) - window + 1 if window else 0):
            yield from unit(f"{name}:stmts_{k + 1}-{k + window}", "sliding_window", f.body[k : k + window], owner, flag)
    if "comprehension" in kinds:
        for n in (n for n in children.nodes if isinstance(n, _COMPREHENSION)):
            yield from unit(f"{around.get(id(n), 'module')}:{type(n).__name__.lower()}_L{n.lineno}", "comprehension", n)
    if "class" in kinds:
        for c in (n for n in children.nodes if isinstance(n, ast.ClassDef)):
            yield from unit(f"class:{c.name}", "class", c)
    if "data_table" in kinds:
        for a in (n for n in children.nodes if isinstance(n, ast.Assign)):
            if isinstance(a.targets[0], ast.Name) and isinstance(a.value, (ast.Dict, ast.List, ast.Set, ast.Tuple)):
                yield from unit(f"data_table:{a.targets[0].id}", "data_table", a.value)
    if "complex_expr" in kinds:
        queue = deque([tree])
        while queue:
            n = queue.popleft()
            if isinstance(n, ast.expr) and sum(isinstance(x, _OPERATION) for x in ast.walk(n)) >= 4:
                yield from unit(f"expr:{n.lineno}", "complex_expr", n)
            else:
                queue.extend(ast.iter_child_nodes(n))


def harvest(files: DataFrame, **options) -> DataFrame:
    """Units of files (file, content); notebooks (.ipynb) by code cell."""

    def run(frames):
        for frame in frames:
            rows: list[tuple] = []
            for file, text in zip(frame.file, frame.content, strict=True):
                if file.endswith(".ipynb"):
                    for label, source in notebook_cells(file, text or ""):
                        rows += cell_units(label, source, **options)
                else:
                    rows += units_of(file, text or "", **options)
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in UNIT_SCHEMA.split(", ")])

    return spread(files.select("file", "content")).mapInPandas(run, UNIT_SCHEMA)


def spread(files: DataFrame) -> DataFrame:
    """Files dealt over all cores: parsing takes long, and a small table can come in a few partitions."""
    cores = files.sparkSession.sparkContext.defaultParallelism
    return files if files.rdd.getNumPartitions() >= 4 * cores else files.repartition(4 * cores)


def cell_units(label: str, source: str, **options) -> Iterator[tuple]:
    """A code cell as one unit, and its functions; no blocks, windows or other kinds."""
    plain = {k: v for k, v in options.items() if k not in ("window", "kinds", "functions_only")}
    yield from units_of(label, source, functions_only=True, kinds=("notebook_cell",), **plain)


def notebook_cells(file: str, text: str) -> list[tuple[str, str]]:
    """(label, source) of code cells; the number in a label counts all cells."""
    try:
        cells = json.loads(text).get("cells", [])
        return [(f"{file}#cell_{k}", s if isinstance(s := c.get("source", ""), str) else "".join(s)) for k, c in enumerate(cells, 1) if c.get("cell_type") == "code"]
    except (ValueError, AttributeError, TypeError):
        return []


def module_name(path: str) -> str:
    """Dotted name of a file's module; a leading src/ is not part of it, a package is named by its folder."""
    parts = [p for p in path.removesuffix(".py").split("/") if p not in ("", ".")]
    parts = parts[1:] if parts[:1] == ["src"] else parts
    return ".".join(parts[:-1] if parts[-1:] == ["__init__"] else parts)


def _runs_on_import(body: list) -> Iterator[ast.stmt]:
    """Statements that importing a module runs; not those under TYPE_CHECKING or inside functions."""
    for s in body:
        yield s
        if isinstance(s, _DEFS) or (isinstance(s, ast.If) and "TYPE_CHECKING" in ast.unparse(s.test)):
            yield from _runs_on_import(s.orelse if isinstance(s, ast.If) else [])
            continue
        for field in ("body", "orelse", "handlers", "finalbody", "cases"):
            yield from _runs_on_import(getattr(s, field, []))


def imports_of(file: str, text: str) -> list[str]:
    """Dotted names that a file imports when it is imported, relative ones resolved; none if it does not parse."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return []
    here = module_name(file).split(".")
    here = here if file.endswith("__init__.py") else here[:-1]
    out: set[str] = set()
    for s in _runs_on_import(tree.body):
        if isinstance(s, ast.Import):
            out |= {a.name for a in s.names}
        elif isinstance(s, ast.ImportFrom) and s.level <= len(here):
            base = ".".join([*(here[: len(here) - s.level + 1] if s.level else []), *filter(None, [s.module])])
            out |= {x for x in (base, *(f"{base}.{a.name}" for a in s.names if a.name != "*")) if base}
    return sorted(out)


def import_rows(files: DataFrame) -> DataFrame:
    """module, imported: one row per dotted name that a file (file, content) imports."""

    def run(frames):
        for frame in frames:
            rows = [(module_name(f), i) for f, t in zip(frame.file, frame.content, strict=True) for i in imports_of(f, t or "")]
            yield pd.DataFrame(rows, columns=["module", "imported"])

    return files.select("file", "content").mapInPandas(run, "module string, imported string")


def token_vector(tokens: list[str]) -> dict[str, int]:
    return dict(Counter(tokens))
