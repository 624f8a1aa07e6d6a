"""Line ranges of unified diffs, blame, and covered lines."""

from __future__ import annotations

import re
import sqlite3
import subprocess

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


#: One-letter escapes of git's quoted paths, and the bytes they stand for.
_ESCAPES = {"a": 7, "b": 8, "t": 9, "n": 10, "v": 11, "f": 12, "r": 13, '"': 34, "\\": 92}


def plain_text(quoted: str) -> str:
    """A path that git wrote with octal and one-letter escapes of its bytes."""
    one = lambda m: bytes([int(m[1], 8) & 255 if m[1][:1].isdigit() else _ESCAPES.get(m[1], ord(m[1]))])
    parts = re.split(r"(\\(?:[0-7]{1,3}|.))", quoted)
    return b"".join(one((p, p[1:])) if k % 2 else p.encode() for k, p in enumerate(parts)).decode("utf-8", "replace")


@F.pandas_udf(T.StringType())
def plain_path(quoted: pd.Series) -> pd.Series:
    return quoted.map(lambda x: None if x is None else plain_text(x))


def parse_diff(lines: DataFrame) -> DataFrame:
    """lines: diff (any key), ln, line. Changed ranges of new files: diff, file, lo, hi. A deleted file (/dev/null) has none."""
    w = Window.partitionBy("diff").orderBy("ln").rowsBetween(Window.unboundedPreceding, 0)
    head = F.regexp_extract("line", r"^\+\+\+ (?:[abiwc]/)?([^\t]*)", 1)
    quoted_head = F.regexp_extract("line", r'^\+\+\+ "(?:[abiwc]/)?((?:[^"\\]|\\.)*)"', 1)
    head = F.when(F.startswith("line", F.lit('+++ "')), plain_path(quoted_head)).otherwise(head)
    named = lines.withColumn("file", F.last(F.when(F.startswith("line", F.lit("--- ")), F.lit("/dev/null")).when(F.startswith("line", F.lit("+++ ")), head), True).over(w))
    hunk = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"
    lo, n = F.regexp_extract("line", hunk, 1).try_cast("int"), F.coalesce(F.regexp_extract("line", hunk, 2).try_cast("int"), F.lit(1))
    return named.select("diff", "file", lo.alias("lo"), n.alias("n")).where("lo is not null and n > 0 and file <> '/dev/null'").select("diff", "file", "lo", (F.col("lo") + F.col("n") - 1).alias("hi"))


def git_diff(spark: SparkSession, folder: str, since: str | None = None) -> DataFrame:
    """Lines of git diff as diff, ln, line; no rows if git fails. A ref that begins with - is refused."""
    text = ""
    if since is None or not since.startswith("-"):
        done = subprocess.run(["git", "-C", folder, "diff", "--unified=0", *([since] if since else []), "--"], capture_output=True, text=True)
        text = done.stdout if done.returncode == 0 else ""
    return spark.createDataFrame([("git", k, x) for k, x in enumerate(text.splitlines())], "diff string, ln int, line string")


def read_coverage_xml(spark: SparkSession, path: str) -> DataFrame:
    """file, line of lines with hits, from Cobertura XML."""
    schema = "_filename string, lines struct<line: array<struct<_number:int,_hits:int>>>"
    found = spark.read.format("xml").option("rowTag", "class").schema(schema).load(path)
    return found.select(F.col("_filename").alias("file"), F.explode("lines.line").alias("l")).where("l._hits > 0 and l._number > 0").select("file", F.col("l._number").alias("line"))


def read_coverage_sqlite(spark: SparkSession, path: str) -> DataFrame:
    """file, line of a coverage database: bit b of byte n is line 8 n + b + 1."""
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        tables = {name for (name,) in db.execute("select name from sqlite_master where type = 'table'")}
        rows = db.execute("select f.path, b.num_bits, b.bits from line_bits b join file f on f.id = b.file_id").fetchall() if "line_bits" in tables else []
        if not any(any(x) for _, _, x in rows) and "arc" in tables:  # branch measurements record jumps, not lines
            arcs = db.execute("select distinct f.path, a.fromno from arc a join file f on f.id = a.file_id where a.fromno > 0").fetchall()
            return spark.createDataFrame(arcs, "file string, line int")
    bits = spark.createDataFrame([(p, int(n), bytearray(x)) for p, n, x in rows], "file string, n int, bits binary")
    each = bits.where("n > 0").select("file", "bits", F.explode(F.sequence(F.lit(0), F.least(F.col("n"), F.length("bits") * 8) - 1)).alias("b"))
    byte = "cast(conv(hex(substring(bits, b div 8 + 1, 1)), 16, 10) as int)"
    return each.where(f"shiftright({byte}, b % 8) & 1 = 1").select("file", (F.col("b") + 1).alias("line"))


def read_coverage(spark: SparkSession, path: str) -> DataFrame:
    """file, line of covered lines, from XML by its suffix, else from a database."""
    return read_coverage_xml(spark, path) if path.lower().endswith(".xml") else read_coverage_sqlite(spark, path)


def latest_commit(lines: DataFrame) -> DataFrame:
    """lines: blame (any key), ln, line of git blame --porcelain. blame, commit (8 digits), author, ts, summary of the newest commit; ties: the first. A blame without commits has no row."""
    w = Window.partitionBy("blame").orderBy("ln").rowsBetween(Window.unboundedPreceding, 0)
    head = F.substring(F.regexp_extract("line", r"^([0-9a-fA-F]{40}(?:[0-9a-fA-F]{24})?)(?: |$)", 1), 1, 8)
    carried = lines.withColumn("commit", F.last(F.nullif(head, F.lit("")), True).over(w)).where("commit is not null and not startswith(line, '\t')")
    value = lambda key: F.when(F.startswith("line", F.lit(key + " ")), F.trim(F.substr("line", F.lit(len(key) + 2))))
    commits = carried.groupBy("blame", "commit").agg(
        F.max(F.struct(F.coalesce(value("author-time").try_cast("bigint"), F.lit(0)).alias("ts"), -F.col("ln"))).alias("newest"),
        F.max_by(value("author"), F.when(value("author").isNotNull(), F.col("ln"))).alias("author"), F.max_by(value("summary"), F.when(value("summary").isNotNull(), F.col("ln"))).alias("summary"),
    )
    best = commits.groupBy("blame").agg(F.max_by(F.struct("commit", F.coalesce("author", F.lit("Unknown")).alias("author"), F.col("newest.ts").alias("ts"), F.coalesce("summary", F.lit("")).alias("summary")), "newest").alias("b"))
    return best.select("blame", "b.*")


def git_blame(spark: SparkSession, folder: str, file: str, start: int, end: int) -> DataFrame:
    """Lines of git blame of a line range as blame, ln, line; no rows if git fails."""
    first = max(1, start)
    done = subprocess.run(["git", "-C", folder, "blame", "-L", f"{first},{max(first, end)}", "--porcelain", "--", file], capture_output=True, text=True, errors="replace")
    rows = done.stdout.split("\n") if done.returncode == 0 else []
    return spark.createDataFrame([(f"{file}:{start}-{end}", k, x) for k, x in enumerate(rows) if x], "blame string, ln int, line string")


def git_files(folder: str, since: str | None = None) -> list[str]:
    """Changed files, each once, in git's order; names come NUL-separated, so none is quoted."""
    if since is not None and since.startswith("-"):
        return []
    done = subprocess.run(["git", "-C", folder, "diff", "--name-only", "-z", *([since] if since else []), "--"], capture_output=True, text=True, errors="replace")
    return list(dict.fromkeys(filter(None, done.stdout.split("\0")))) if done.returncode == 0 else []


def git_value(folder: str, what: str) -> str | None:
    """The worktree's root (what = root) or the commit it is at (what = head); None outside a repository."""
    done = subprocess.run(["git", "-C", folder, "rev-parse", {"root": "--show-toplevel", "head": "HEAD"}[what]], capture_output=True, text=True)
    return done.stdout.strip() or None if done.returncode == 0 else None
