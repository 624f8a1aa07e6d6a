"""Similarity joins over a table of units (id, tokens): inverted index, pruning, exact scores.

Every metric compares sets of weighted items: shingles (weight 1 or IDF), or the n-th occurrences of tokens. Items
are named by 64-bit hashes. Candidates come from an equi-join on the items of prefixes: in an order of rising
frequency, the items of a unit from which on its weights still add up to the threshold's share of its total. Two
sets that reach the threshold share an item of both prefixes, and from the first one on all that they share. The
shared weight is then exact over whole sets (setjoin.py; bagjoin.py for occurrences of tokens).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import shingles
from .bagjoin import similar_bags
from .setjoin import similar_sets
from .store import stored  # noqa: F401  a test counts what is written by way of this name


def postings_cap(total: int, frequency: float = 0.25, least_corpus: int = 30) -> int | None:
    """Most units a shingle may stand in to be indexed; None: no limit (small corpus)."""
    return max(2, math.ceil(total * frequency)) if total >= least_corpus else None


def unit_shingles(units: DataFrame, k: int = 3) -> DataFrame:
    """id, n (distinct shingles), token_count, shingle."""
    return units.withColumn("s", shingles("tokens", k)).select("id", F.size("s").alias("n"), F.size("tokens").alias("token_count"), F.explode("s").alias("shingle"))


def document_frequency(exploded: DataFrame, key: str = "shingle") -> DataFrame:
    return exploded.groupBy(key).agg(F.count(F.lit(1)).alias("df"))


def size_filters(threshold: float, ratio: float = 2.5) -> Column:
    """Length bound and size ratio, on token counts t1 and t2."""
    low, high = F.least("t1", "t2"), F.greatest("t1", "t2")
    return (high <= ratio * low) & (2.0 * low >= threshold * (F.col("t1") + F.col("t2")))


def jaccard_pairs(units: DataFrame, threshold: float = 0.7, k: int = 3, cap: int | None = None, stop: DataFrame | None = None, changed: DataFrame | None = None) -> DataFrame:
    """i < j, inter, n1, n2, sim. Pairs share a shingle that is neither above cap nor in stop; sim is over whole sets.

    changed: ids; only pairs with one of them are made.
    """
    found = similar_sets(units, threshold, k, lambda: size_filters(threshold), cap, stop=stop, changed=changed)
    inter, n1, n2 = (F.col(c).cast("bigint") for c in ("common", "w1", "w2"))
    return found.select("i", "j", inter.alias("inter"), n1.alias("n1"), n2.alias("n2"), (inter / (n1 + n2 - inter)).alias("sim"))


def token_counts(units: DataFrame) -> DataFrame:
    return units.select("id", F.size("tokens").alias("size"), F.explode("tokens").alias("key")).groupBy("id", "size", "key").agg(F.count(F.lit(1)).alias("c"))


def multiset_pairs(units: DataFrame, threshold: float = 0.7, cap: int | None = None) -> DataFrame:
    """Sum of least counts over sum of greatest. Pairs share a token within the cap; sim is over whole multisets."""
    found = similar_bags(units, threshold, cap)
    return found.select("i", "j", (F.col("common") / (F.col("w1") + F.col("w2") - F.col("common"))).alias("sim"))


def tfidf_multiset_pairs(units: DataFrame, threshold: float = 0.7, cap: int | None = None, weights: DataFrame | None = None) -> DataFrame:
    """Weighted least counts over weighted greatest. weights: key, w (by default the tokens' IDF); a token without one weighs 1."""
    weight = _idf if weights is None else lambda df, given, total: np.ones(len(df)) if given is None else given
    found = similar_bags(units, threshold, cap, weight, weights)
    return found.select("i", "j", (F.col("common") / (F.col("w1") + F.col("w2") - F.col("common"))).alias("sim"))


def idf_weights(df: DataFrame, total: int) -> DataFrame:
    """key, w = max(0, ln((1 + N) / (1 + df)) + 1)."""
    return df.select(df.columns[0], F.greatest(F.lit(0.0), F.log((1.0 + total) / (1.0 + F.col("df"))) + 1.0).alias("w"))


def _idf(df: np.ndarray, given, total: int) -> np.ndarray:
    return np.maximum(0.0, np.log((1.0 + total) / (1.0 + df)) + 1.0)


def tfidf_pairs(units: DataFrame, threshold: float = 0.7, k: int = 3, cap: int | None = None) -> DataFrame:
    """Weighted set Jaccard of shingles. Pairs share a shingle within the cap; sim is over whole sets."""
    found = similar_sets(units, threshold, k, lambda: size_filters(threshold), cap, _idf)
    return found.select("i", "j", (F.col("common") / (F.col("w1") + F.col("w2") - F.col("common"))).alias("sim"))


def lcs_length(a: list, b: list) -> int:
    """Longest common subsequence, with one machine word per token of the longer side's bit vector."""
    places: dict = {}
    for k, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        hit = row & places.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


@F.pandas_udf(T.DoubleType())
def lcs_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([2.0 * lcs_length(list(x), list(y)) / (len(x) + len(y)) if len(x) and len(y) else 0.0 for x, y in zip(a, b, strict=True)])


def alignment_pairs(units: DataFrame, threshold: float = 0.7, cap: int | None = None) -> DataFrame:
    """2 LCS / (a + b) of pairs whose multiset overlap can reach the threshold."""
    found = similar_bags(units, threshold / (2 - threshold), cap, align=threshold)
    return found.select("i", "j", (2.0 * F.col("common") / (F.col("w1") + F.col("w2"))).alias("sim"))


def call_pairs(units: DataFrame, threshold: float = 0.7, least_calls: int = 3, cap: int | None = None) -> DataFrame:
    """Alignment of call traces (column calls) of at least least_calls calls. No side fits a broadcast: all grow with the units."""
    long = units.where(F.size("calls") >= least_calls)
    keys = long.select(F.explode(F.array_distinct("calls")).alias("key"), "id")
    df = document_frequency(keys, "key").where("df >= 2" if cap is None else f"df between 2 and {cap}").select("key")
    kept = keys.join(df.hint("merge"), "key")
    pairs = kept.toDF("key", "i").join(kept.toDF("key", "j").hint("merge"), "key").where("i < j").select("i", "j").distinct()
    a, b = long.select(F.col("id").alias("i"), F.col("calls").alias("ta")), long.select(F.col("id").alias("j"), F.col("calls").alias("tb"))
    return pairs.join(a.hint("merge"), "i").join(b.hint("merge"), "j").select("i", "j", lcs_similarity("ta", "tb").alias("sim")).where(F.col("sim") >= threshold)


def drop_exempt(pairs: DataFrame, exemptions: DataFrame) -> DataFrame:
    """pairs (a, b) without those that exemptions (a, b) name, in either order."""
    keys = exemptions.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).distinct()
    return pairs.join(keys, (F.least("a", "b") == F.col("x")) & (F.greatest("a", "b") == F.col("y")), "left_anti")


def compatible_places(pairs: DataFrame) -> DataFrame:
    """Without pairs of one file (file1 = file2) that overlap: names with the same base if lines meet, others if one contains the other."""
    base1, base2 = F.split_part("name1", F.lit(":"), F.lit(1)), F.split_part("name2", F.lit(":"), F.lit(1))
    meet = (F.col("start1") <= F.col("end2")) & (F.col("start2") <= F.col("end1"))
    holds = ((F.col("start1") <= F.col("start2")) & (F.col("end2") <= F.col("end1"))) | ((F.col("start2") <= F.col("start1")) & (F.col("end1") <= F.col("end2")))
    return pairs.where(~((F.col("file1") == F.col("file2")) & F.when(base1 == base2, meet).otherwise(holds)))
