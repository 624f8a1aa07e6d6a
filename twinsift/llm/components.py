"""Connected components by randomised contraction: each node joins the neighbour that a hash of the round puts first.

The graph shrinks by a constant factor a round in expectation, whatever its shape; each round is two
aggregations and two joins over written tables, and nothing is gathered on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written


def components(edges: DataFrame) -> DataFrame:
    """edges: u, v (bigint). One row per node that an edge names: node, label (some node of its component)."""
    edges = written(edges.where("u <> v").select("u", "v").distinct(), "cc-edges")
    steps, rounds = [], 0
    while not edges.isEmpty():
        rounds += 1
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))

        def rank(c, k=rounds):
            return F.struct(F.xxhash64(F.lit(k), F.col(c)).alias("h"), F.col(c).alias("n"))

        best = both.groupBy("u").agg(F.min(rank("v")).alias("m"))
        step = written(best.select(F.col("u").alias("node"), F.least(F.col("m"), rank("u"))["n"].alias("label")), f"cc-step{rounds}")
        steps.append(step)
        a = step.select(F.col("node").alias("u"), F.col("label").alias("lu"))
        b = step.select(F.col("node").alias("v"), F.col("label").alias("lv"))
        shrunk = edges.join(a, "u").join(b, "v").where("lu <> lv").select(F.least("lu", "lv").alias("u"), F.greatest("lu", "lv").alias("v")).distinct()
        shrunk = written(shrunk, f"cc-edges{rounds}")
        drop_written(edges)
        edges = shrunk
    if not steps:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    total = steps[-1]
    for step in reversed(steps[:-1]):
        up = total.select(F.col("node").alias("label"), F.col("label").alias("top"))
        total = step.join(up, "label", "left").select("node", F.coalesce("top", "label").alias("label"))
    out = written(total, "cc-labels")
    for s in steps:
        drop_written(s)
    return out
