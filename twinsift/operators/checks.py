"""Filters of units and warnings about pairs, as a listing shows them."""

from __future__ import annotations

import os
import sys
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import source_lines
from .pairs import asymmetric, diverged

COLOURS = {"red": 31, "green": 32, "yellow": 33, "cyan": 36, "bold": 1}


def only_tests(pairs: DataFrame) -> DataFrame:
    """Pairs of two tests, by the names of their functions."""
    own = lambda c: F.element_at(F.split(F.split_part(c, F.lit(":"), F.lit(1)), r"\."), -1)
    return pairs.where(F.startswith(own("name1"), F.lit("test_")) & F.startswith(own("name2"), F.lit("test_")))


def valid_coordinates(start="start", end="end", first_column="col", last_column="end_col", strict: bool = False) -> Column:
    """Lines from 1 up that do not run backwards, columns from 0 up that do not on one line; missing columns are no fault unless strict."""
    s, e, a, b = (F.col(c) if isinstance(c, str) else c for c in (start, end, first_column, last_column))
    lines = (s >= 1) & (e >= s)
    columns = (a >= 0) & (b >= 0) & ((e > s) | (b >= a))
    return F.coalesce(lines, F.lit(False)) & F.coalesce(columns, F.lit(not strict))


def is_subroutine(kind="kind") -> Column:
    """Whether a unit is a part of a function and not a whole one."""
    return ~F.coalesce(F.col(kind) if isinstance(kind, str) else kind, F.lit("function")).isin("function", "closure", "class", "method")


def is_excerpt(lines, start="start", end="end") -> Column:
    """Whether lines are those of the unit alone and not of its whole file."""
    size = F.size(lines if isinstance(lines, Column) else F.col(lines))
    span = F.col(end) - F.col(start) + 1
    return (size == span) & (F.col(start) > 1) | (size < F.col(end))


def keeps_as_is(lines, start="start", end="end") -> Column:
    """Whether a unit, or a comment block or decorator right above it, says that it must not be refactored."""
    text = lines if isinstance(lines, Column) else F.col(lines)
    asks = lambda x: F.lower(x).rlike(r"#\s*pragma:\s*no-refactor\b")
    own = F.exists(F.slice(text, F.col(start), F.greatest(F.lit(0), F.col(end) - F.col(start) + 1)), asks)
    above = F.reverse(F.slice(text, F.lit(1), F.greatest(F.lit(0), F.col(start) - 1)))
    # lines above count as long as each is a comment or a decorator
    seen = F.aggregate(
        above,
        F.struct(F.lit(True).alias("open"), F.lit(False).alias("found")),
        lambda acc, x: F.struct((acc["open"] & x.rlike(r"^\s*[#@]")).alias("open"), (acc["found"] | (acc["open"] & x.rlike(r"^\s*[#@]") & asks(x))).alias("found")),
    )
    return own | seen["found"]


def unit_source(units: DataFrame, files: DataFrame) -> DataFrame:
    """units with source: their lines out of files (file, content); a missing end means one line."""
    lines = files.select("file", source_lines("content").alias("lines of file"))
    size = F.coalesce("end", "start") - F.col("start") + 1
    text = F.array_join(F.slice("lines of file", F.greatest(F.lit(1), F.col("start")), F.greatest(F.lit(0), size)), "")
    return units.join(lines, "file", "left").withColumn("source", text).drop("lines of file")


def safe_file(file: str, root: str, suffixes: tuple[str, ...] = (".py", ".ipynb")) -> str | None:
    """The real path of a source file below root; None for another kind, a link, or a place outside."""
    at = Path(root, file.partition("#")[0])
    inside = at.resolve().is_relative_to(Path(root).resolve())
    linked = any(p.is_symlink() for p in (at, *at.parents) if p.is_relative_to(root) and p != Path(root))
    return str(at.resolve()) if at.suffix in suffixes and inside and not linked and at.is_file() else None


def risk_warnings(pairs: DataFrame, edits: DataFrame | None = None, coverage: DataFrame | None = None, days: float = 90.0) -> DataFrame:
    """i, j, kind, line: pairs whose sides were last edited far apart (edits: id, ts), or are covered unevenly (coverage: id, coverage)."""
    out = pairs.select("i", "j", F.lit("").alias("kind"), F.lit("").alias("line")).where("false")
    if edits is not None:
        apart = diverged(pairs.select("i", "j"), edits, days)
        out = out.unionByName(apart.select("i", "j", F.lit("divergence").alias("kind"), F.format_string("last edits lie %d days apart", F.col("days").cast("int")).alias("line")))
    if coverage is not None:
        uneven = asymmetric(pairs.select("i", "j"), coverage)
        out = out.unionByName(uneven.select("i", "j", F.lit("coverage").alias("kind"), F.lit("only one side is covered well by tests").alias("line")))
    return out


def wants_colour(override: bool | None = None, stream=None, environ=None) -> bool:
    env, out = os.environ if environ is None else environ, stream or sys.stdout
    if override is not None:
        return override
    return "NO_COLOR" not in env and env.get("TERM") != "dumb" and out.isatty()


def coloured(text, colour: str, enabled: bool = True):
    """Text (or a column of it) between the codes of a colour."""
    if not enabled:
        return text
    on, off = f"\x1b[{COLOURS[colour]}m", "\x1b[0m"
    return F.concat(F.lit(on), text, F.lit(off)) if isinstance(text, Column) else f"{on}{text}{off}"


def scorecard(stats: dict, colour: bool = False) -> str:
    """Lines of code, duplicated lines and their share."""
    total, copied = int(stats.get("sloc", 0)), int(stats.get("duplicated", 0))
    share = 100.0 * copied / total if total else 0.0
    tint = "green" if share < 5 else "yellow" if share < 15 else "red"
    return "\n".join([f"Lines of code:    {total}", f"Duplicated lines: {copied}", "Share:            " + coloured(f"{share:.2f} %", tint, colour)])


def scan_banner(options: dict[str, bool], metric: str) -> str:
    """What a scan does, in one line."""
    on = [name.replace("_", " ") for name, value in options.items() if value]
    return f"comparing by {metric}" + (f" with {', '.join(on)}" if on else "")
