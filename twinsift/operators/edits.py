"""Replacing parts of source texts: line offsets, spans, collisions, edits, and unified diffs of the result."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.columns import source_lines
from .pairs import collisions


def line_offsets(files: DataFrame) -> DataFrame:
    """file, line (from 1), start, length: 0-based character offset and length (with its end) of each physical line."""
    lines = files.select("file", F.posexplode(source_lines("content")).alias("k", "text")).select("file", (F.col("k") + 1).alias("line"), F.length("text").cast("bigint").alias("length"))
    before = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    return lines.withColumn("start", F.coalesce(F.sum("length").over(before), F.lit(0)))


def char_column(line, column) -> Column:
    """Characters before a UTF-8 byte column of a line; a column inside a character counts as its start."""
    head = F.substring(F.encode(line, "UTF-8"), F.lit(1), column)
    # continuation bytes are 10xxxxxx; a cut character has fewer bytes than its lead byte says
    return F.length(F.regexp_replace(F.decode(head, "ISO-8859-1"), r"[\x80-\xbf]|[\xc0-\xdf]\z|[\xe0-\xef][\x80-\xbf]?\z|[\xf0-\xff][\x80-\xbf]{0,2}\z", ""))


def colliding_edits(edits: DataFrame) -> DataFrame:
    """edits: file, start, end (half-open). Those that begin before an earlier one of their file has ended."""
    return collisions(edits, "file")


def apply_edits(files: DataFrame, edits: DataFrame) -> DataFrame:
    """files: file, content; edits: file, start, end, new. file, content with every edit applied; files without edits as they are.

    Edits of a file are sorted by place and the text is built once from left to right. A file with colliding edits stays
    as it is and has refused = true.
    """
    plan = edits.groupBy("file").agg(F.array_sort(F.collect_list(F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "new"))).alias("plan"))
    state = lambda text, at, bad: F.struct(text.alias("text"), at.alias("at"), bad.alias("bad"))
    built = F.aggregate(
        F.coalesce("plan", F.array().cast("array<struct<start:int,end:int,new:string>>")),
        state(F.lit(""), F.lit(0), F.lit(False)),
        lambda a, e: state(F.concat(a["text"], F.substring("content", a["at"] + 1, F.greatest(e["start"] - a["at"], F.lit(0))), e["new"]), e["end"], a["bad"] | (e["start"] < a["at"]) | (e["end"] < e["start"])),
        lambda a: F.struct(F.concat(a["text"], F.substring("content", a["at"] + 1, F.greatest(F.length("content") - a["at"], F.lit(0)))).alias("text"), a["bad"].alias("bad")),
    )
    out = files.select("file", "content").join(plan, "file", "left").withColumn("built", built)
    return out.select("file", F.when(F.col("built.bad"), F.col("content")).otherwise(F.col("built.text")).alias("content"), F.coalesce(F.col("built.bad"), F.lit(False)).alias("refused"))


@F.pandas_udf(T.StringType())
def unified_diff(file: pd.Series, before: pd.Series, after: pd.Series) -> pd.Series:
    """A patch that git apply takes; empty where nothing changes."""
    out = []
    for f, a, b in zip(file, before, after, strict=True):
        lines = difflib.unified_diff((a or "").splitlines(keepends=True), (b or "").splitlines(keepends=True), f"a/{f}" if a is not None else "/dev/null", f"b/{f}")
        out.append("".join(x if x.endswith("\n") else x + "\n\\ No newline at end of file\n" for x in lines))
    return pd.Series(out, dtype=object)


def patches(files: DataFrame, edits: DataFrame) -> DataFrame:
    """file, patch of the files that edits change."""
    new = apply_edits(files, edits).where("not refused").select("file", F.col("content").alias("after"))
    changed = files.select("file", "content").join(new, "file").where("not (content <=> after)")
    return changed.select("file", unified_diff("file", "content", "after").alias("patch"))
