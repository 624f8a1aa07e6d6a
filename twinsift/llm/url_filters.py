"""URL filters by host-suffix and path-prefix expressions.

Each URL becomes the expressions ``suffix + prefix`` of its host suffixes (by label) and path prefixes (of
the lengths that rules have). Expressions meet rules in an equi-join on the first 32 bits of their digest;
the full digest then confirms, and of the rules that fit the longest wins. Only DataFrame functions are used.

Rules: ``host`` (lower case, no port), ``path`` (compared as it stands) and ``verdict``. Null and malformed
URLs have an empty host and path and fit no rule; very long ones are cut and compared whole; repeated rows are
judged alike; no rule means ``allow``. Ties: of rules of equal length block comes before allow. Empty tables of
rules or pages give every page the default, or no rows. Other columns of pages are not read, so their names do
not matter.

A URL that many rows share is judged once and its verdict broadcast, if there are few such URLs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_hot, written

#: Rules up to this many are broadcast (at most some 100 MB); more meet the expressions in a salted shuffle.
BROADCAST_RULES = 200_000
SALTS = 16

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def rules_frame(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def split_url(pages: DataFrame, url: str = "url") -> DataFrame:
    """pages with _host and _path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(F.col(url), at + 3, F.length(F.col(url)))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return pages.withColumns({"_host": lower, "_path": path})


def filter_urls(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """One row per row of pages: key, host, path, rule, verdict.

    Of rules that fit, the longest ``host + path`` wins; of equal rules, block comes before allow.
    """
    keyed = F.concat("host", F.lit("\u0000"), "path")
    wanted = (
        rules.where("host is not null and path is not null")
        .groupBy("host", "path")
        .agg(F.max("verdict").alias("verdict"))
        .select(
            F.sha2(keyed, 256).alias("digest"),
            F.concat("host", "path").alias("rule"),
            F.length(F.concat("host", "path")).alias("size"),
            "verdict",
        )
        .withColumn("short", F.substring("digest", 1, 8))
    )
    seen = rules.agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set(F.length("path"))).alias("lengths")).first()
    # path lengths of rules: distinct small integers, bounded by the longest path
    lengths = [int(x) for x in seen["lengths"]]
    split = split_url(pages.select(F.col(key).alias("key"), F.col(url).alias("url")), "url")
    urls = split.where("_host <> ''").groupBy("_host", "_path").agg(F.count(F.lit(1)).alias("n"))
    labels = F.split("_host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.filter(F.array(*[F.when(F.length("_path") >= n, F.expr(f"substring(_path, 1, {n})")) for n in lengths] or [F.lit(None).cast("string")]), lambda p: p.isNotNull())
    expressions = (
        urls.withColumn("_s", F.explode(suffixes))
        .withColumn("_p", F.explode(prefixes))
        .withColumn("digest", F.sha2(F.concat("_s", F.lit("\u0000"), "_p"), 256))
        .select("_host", "_path", "digest", F.substring("digest", 1, 8).alias("short"))
    )
    if seen["n"] <= BROADCAST_RULES:
        met = expressions.alias("e").join(F.broadcast(wanted).alias("r"), "short")
    else:
        salted = wanted.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = expressions.withColumn("salt", F.pmod(F.xxhash64("_host", "_path"), F.lit(SALTS)).cast("int")).alias("e").join(salted.alias("r"), ["short", "salt"])
    best = (
        met.where(F.col("e.digest") == F.col("r.digest"))
        .groupBy("_host", "_path")
        .agg(F.max(F.struct("size", "verdict", "rule")).alias("best"))
    )
    judged = written(urls.join(best, ["_host", "_path"], "left"), "url-verdicts")
    total = split.count()
    named = join_hot(split.where("_host <> ''").select("key", "_host", "_path"), judged, ["_host", "_path"], total).select("key", "_host", "_path", "best")
    bare = split.where("_host = ''").select("key", "_host", "_path", F.lit(None).cast(judged.schema["best"].dataType).alias("best"))
    return named.unionByName(bare).select(
        F.col("key").alias(key),
        F.col("_host").alias("host"),
        F.col("_path").alias("path"),
        F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )
