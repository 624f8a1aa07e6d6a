"""Import graph of modules: edges between known modules, reachability, the cycle that a new import would close, and where two files can share a module."""

from __future__ import annotations

import keyword

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .families import checkpointer


def resolved_edges(imports: DataFrame, known: DataFrame) -> DataFrame:
    """imports: module, imported; known: module. src, dst: each import leads to its longest dotted prefix that is a known module.

    An equi-join on prefixes: an import has as many of them as it has parts.
    """
    parts = F.split("imported", r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))
    each = imports.where("imported <> ''").select(F.col("module").alias("src"), "imported", F.explode(prefixes).alias("dst"))
    found = each.join(known.select(F.col("module").alias("dst")).distinct(), "dst")
    return found.groupBy("src", "imported").agg(F.max_by("dst", F.length("dst")).alias("dst")).where("src <> dst").select("src", "dst").distinct()


def reachable(edges: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """src, dst, hops: all modules that each start module (column src; default: every one) reaches, with the least number of hops.

    Semi-naive: only the pairs found last are extended, and known pairs are removed by an anti-join. The result has a
    row per reachable pair, so give start modules on large graphs.
    """
    cut = checkpointer(edges.sparkSession)
    edges = cut(edges.distinct())
    first = edges if start is None else edges.join(start.select("src").distinct(), "src", "left_semi")
    new = cut(first.withColumn("hops", F.lit(1)))
    seen = new
    while not new.isEmpty():
        step = new.toDF("src", "via", "hops").join(edges.toDF("via", "dst"), "via").select("src", "dst", (F.col("hops") + 1).alias("hops")).distinct()
        new = cut(step.join(seen.select("src", "dst"), ["src", "dst"], "left_anti"))
        seen = cut(seen.unionByName(new))
    return seen


def closes_cycle(edges: DataFrame, added: DataFrame) -> DataFrame:
    """Of the new edges (src, dst) those whose dst already reaches src, or that lead to themselves."""
    back = reachable(edges, added.select(F.col("dst").alias("src"))).select(F.col("src").alias("dst"), F.col("dst").alias("src"))
    return added.where("src <> dst").join(back, ["src", "dst"], "left_semi").unionByName(added.where("src = dst")).select("src", "dst")


def common_folder(file1: str, file2: str) -> Column:
    """The lowest folder that holds both files (paths below the repository's root, without . or ..); empty: the root, also for a path outside of it."""
    folders = [F.slice(parts, F.lit(1), F.size(parts) - 1) for parts in (F.split(f, "/") for f in (file1, file2))]
    same = F.zip_with(*folders, lambda a, b: F.coalesce(a == b, F.lit(False)))
    differs = F.array_position(same, False)
    shared = F.array_join(F.slice(folders[0], F.lit(1), F.when(differs > 0, differs - 1).otherwise(F.size(same)).cast("int")), "/")
    outside = F.lit(False)
    for f in (file1, file2):
        outside = outside | F.startswith(f, F.lit("/")) | F.startswith(f, F.lit("../"))
    return F.when(~outside, shared).when(outside, F.lit(""))


def shared_module(file1: str, file2: str, name: str = "_common.py") -> Column:
    """Path of a module for helpers of both files, in their lowest common folder. A name that is no module's is replaced."""
    stem = name.rsplit("/", 1)[-1].strip().removesuffix(".py")
    stem = stem if stem.isidentifier() and not keyword.iskeyword(stem) else "_common"
    folder = common_folder(file1, file2)
    return F.when(folder == "", F.lit(f"{stem}.py")).otherwise(F.concat(folder, F.lit(f"/{stem}.py")))
