"""Candidate pairs as a whole scan makes them: stop shingles, calibrated frequencies, changed units, and a budget for novel shingles."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .similarity import document_frequency

#: New pairs that shingles unknown to the calibration may add.
NOVEL_PAIRS = 10_000
#: Shingles of the main guard, of logging, of error handling and of raising.
STOP_SHINGLES = (
    ("Module", "If", "Compare"), ("If", "Compare", "Pass"), ("If", "Compare", "Expr"), ("Compare", "Pass", "VAR"),
    ("Compare", "Expr", "VAR"), ("Pass", "VAR", "Eq"), ("VAR", "Eq", "CONST_str"), ("Eq", "CONST_str", "Load"),
    ("Eq", "CONST_str", "Call"),
    ("Module", "Expr", "Call"), ("Expr", "Call", "ATTR"), ("Call", "ATTR", "CONST_str"), ("Call", "ATTR", "VAR"),
    ("ATTR", "CONST_str", "VAR"), ("ATTR", "VAR", "VAR"), ("ATTR", "VAR", "Load"), ("Call", "Load", "ATTR"),
    ("Load", "Call", "ATTR"), ("Load", "ATTR", "VAR"),
    ("Module", "Try", "Pass"), ("Module", "Try", "Expr"), ("Try", "Pass", "ExceptHandler"), ("Try", "Expr", "ExceptHandler"),
    ("Pass", "ExceptHandler", "VAR"), ("ExceptHandler", "VAR", "Pass"), ("ExceptHandler", "VAR", "Expr"),
    ("ExceptHandler", "Call", "VAR"), ("Expr", "ExceptHandler", "Call"),
    ("Module", "Raise", "Call"), ("Raise", "Call", "VAR"),
)


def stop_shingles(spark: SparkSession, extra=(), calibration: DataFrame | None = None, separator: str = "\u001f") -> DataFrame:
    """shingle: the fixed ones, those of the user, and those that a calibration marks (is_stop)."""
    rows = [(separator.join(s) if not isinstance(s, str) else s,) for s in (*STOP_SHINGLES, *extra)]
    out = spark.createDataFrame(rows, "shingle string")
    if calibration is not None:
        out = out.union(calibration.where("is_stop").select("shingle"))
    return out.distinct()


def shingle_plan(index: DataFrame, total: int, cap: int | None, calibration: DataFrame | None = None, calibrated_units: int = 0, changed: DataFrame | None = None) -> DataFrame:
    """shingle, df (units), df_changed, is_novel, pairs (that it can make), usable (but for the budget).

    index: shingle, id. calibration: shingle, df. A shingle's frequency for pruning is the larger of what is seen
    and what the calibration guarantees. With changed ids, units that are not changed stood in the calibrated corpus,
    so at most calibrated_units less those, less the shingle's changed units, occurrences can have gone since.
    """
    if changed is not None:
        marks = changed.select("id").distinct().withColumn("is_changed", F.lit(1))
        counted = index.join(marks, "id", "left").groupBy("shingle").agg(F.count(F.lit(1)).alias("df"), F.coalesce(F.sum("is_changed"), F.lit(0)).alias("df_changed"))
        counted = counted.where("df_changed > 0")
        n_changed = marks.count()
    else:
        counted = document_frequency(index).withColumn("df_changed", F.col("df"))
        n_changed = total
    counted = counted.where("df >= 2")
    if calibration is None:
        known = counted.withColumn("saved", F.lit(None).cast("bigint"))
    else:
        saved = calibration.select("shingle", F.least(F.col("df").cast("bigint"), F.lit(calibrated_units).cast("bigint")).alias("saved")).where("saved > 0")
        known = counted.join(saved, "shingle", "left")
    lowest = F.coalesce("saved", F.lit(0))
    if changed is None:
        frequency = F.greatest("df", lowest)
    elif calibrated_units > 0 and calibrated_units >= total - n_changed:
        gone = F.greatest(F.lit(calibrated_units - (total - n_changed)) - F.col("df_changed"), F.lit(0))
        frequency = F.greatest(F.col("df"), lowest - gone)
    else:
        frequency = F.col("df")
    novel = F.col("saved").isNull() if calibration is not None else F.lit(False)
    still = F.col("df") - F.col("df_changed")
    pairs = F.expr("df_changed * (df_changed - 1) div 2 + df_changed * (df - df_changed)")
    checked = F.when(novel, still).otherwise(frequency) if changed is not None else frequency
    usable = F.lit(True) if cap is None else checked <= cap
    return known.select("shingle", "df", "df_changed", novel.alias("is_novel"), pairs.alias("pairs"), usable.alias("usable"))


def _within_budget(budget: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows shingle, ids, changed (lists) in the order of shingles: greedily, those whose pairs still fit; only new pairs are charged."""
        left, made = budget, set()
        for frame in frames:
            out = []
            for shingle, ids, marks in zip(frame["shingle"], frame["ids"], frame["marks"], strict=True):
                units = sorted(zip(map(int, ids), map(bool, marks), strict=True))
                n, c = len(units), sum(m for _, m in units)
                if c * (c - 1) // 2 + c * (n - c) > left:
                    continue
                fresh = {(a, b) for k, (a, m) in enumerate(units) for b, o in units[k + 1 :] if m or o} - made
                made |= fresh
                left -= len(fresh)
                out.append(shingle)
            yield pd.DataFrame({"shingle": out})

    return run


def usable_shingles(index: DataFrame, plan: DataFrame, changed: DataFrame | None = None, budget: int = NOVEL_PAIRS) -> DataFrame:
    """shingle: those that make pairs. Novel ones are taken in their order while their pairs fit the budget.

    The greedy choice is one ordered pass; a shingle of more pairs than the whole budget is left out before it, so
    that no list is longer than the budget allows.
    """
    known = plan.where("usable and not is_novel").select("shingle")
    small = plan.where(F.col("usable") & F.col("is_novel") & (F.col("pairs") <= budget)).select("shingle")
    rows = index.join(small, "shingle")
    if changed is None:
        rows = rows.withColumn("mark", F.lit(True))
    else:
        rows = rows.join(changed.select("id").distinct().withColumn("mark", F.lit(True)), "id", "left").withColumn("mark", F.coalesce("mark", F.lit(False)))
    lists = rows.groupBy("shingle").agg(F.sort_array(F.collect_list(F.struct("id", "mark"))).alias("units"))
    ordered = lists.select("shingle", F.col("units.id").alias("ids"), F.col("units.mark").alias("marks")).coalesce(1).sortWithinPartitions("shingle")
    return known.unionByName(ordered.mapInPandas(_within_budget(budget), "shingle string"))


def candidate_pairs(index: DataFrame, total: int, cap: int | None, stop: DataFrame | None = None, calibration: DataFrame | None = None, calibrated_units: int = 0, changed: DataFrame | None = None, budget: int = NOVEL_PAIRS) -> DataFrame:
    """i < j of units that share a usable shingle; with changed ids, only pairs with one of them. index: shingle, id."""
    rows = index.select("shingle", "id").distinct()
    if stop is not None:
        rows = rows.join(stop.select("shingle"), "shingle", "left_anti")
    plan = shingle_plan(rows, total, cap, calibration, calibrated_units, changed)
    kept = rows.join(usable_shingles(rows, plan, changed, budget), "shingle")
    left = kept.toDF("shingle", "a")
    right = kept.toDF("shingle", "b")
    if changed is not None:
        left = left.join(changed.select(F.col("id").alias("a")).distinct(), "a", "left_semi").select("shingle", "a")
    return left.join(right, "shingle").where("a <> b").select(F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j")).distinct()
