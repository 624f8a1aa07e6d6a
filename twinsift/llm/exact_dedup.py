"""Exact duplicates by deterministic block naming.

A text (white space folded) is cut into blocks of a fixed size. The distinct blocks are sorted and numbered;
then adjacent pairs of numbers are sorted and numbered again, until each document has one number. Equal
numbers mean equal texts, with no chance of a collision: a number stands for one block or one pair only. Blocks,
pairs and groups that very many rows share are few, and their numbers are broadcast.

Blocks meet their numbers over a 64-bit key. Keys that two different blocks share are found when the blocks
are numbered, and those blocks meet over their text instead. Only DataFrame functions are used.

Null texts count as empty. Very long texts have more blocks and rounds. Ties: of rows with the smallest key of a
group one stays. Rows repeated with the same key are rows of one group. A null key is kept only if the whole group
has null keys; keys may be of any type that can be sorted. An empty table gives no rows. Columns other than key
and text are kept (or, in groups, not read), whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, fresh_names, join_hot, written

BLOCK = 4096


def normalised(text: str = "text"):
    """Each run of the six white-space characters is one space; null is empty."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _blocks(norm, size: int):
    """Blocks of size characters; an empty text is one empty block."""
    count = F.greatest(F.lit(1), F.ceil(F.length(norm) / F.lit(size)).cast("int"))
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(norm, i * size + 1, F.lit(size)))


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", block: int = BLOCK, block_key=F.xxhash64) -> DataFrame:
    """One row per row of docs: key, keep (the smallest key of equal texts), group_size, kept, sha256, row.

    block_key can be replaced by a weaker key in tests.
    """
    spark = docs.sparkSession
    parts = docs.select(F.col(key).alias("id"), normalised(text).alias("norm"))
    per_doc = written(
        parts.select(
            F.monotonically_increasing_id().alias("row"),
            "id",
            F.sha2("norm", 256).alias("sha256"),
            F.transform(_blocks(F.col("norm"), block), lambda b: block_key(b)).alias("names"),
        ),
        "exact-docs",
    )

    # round 0: sort the distinct blocks, number them
    cut = parts.select(F.explode(_blocks(F.col("norm"), block)).alias("block")).select(block_key("block").alias("k"), "block")
    distinct = cut.groupBy("k", "block").agg(F.count(F.lit(1)).alias("n")).sortWithinPartitions("k", "block")
    blocks = written(distinct.select("k", "n", (F.monotonically_increasing_id() + 1).alias("name")), "exact-blocks")
    names = written(blocks.groupBy("k").agg(F.count(F.lit(1)).alias("blocks"), F.min("name").alias("name"), F.sum("n").alias("n")), "exact-keys")
    total = blocks.agg(F.sum("n")).first()[0] or 0
    flat = per_doc.select("row", F.posexplode("names").alias("pos", "k"), F.size("names").alias("n_blocks"))
    named = join_hot(flat, names.select("k", "n", F.when(F.col("blocks") == 1, F.col("name")).alias("name")), "k", total).select("row", "pos", "n_blocks", "name")
    if not names.where("blocks > 1").isEmpty():
        bad = names.where("blocks > 1").select("k")
        by_text = written(
            cut.distinct().join(bad, "k", "left_semi").sortWithinPartitions("k", "block").select("k", "block", (-F.monotonically_increasing_id() - 1).alias("name2")),
            "exact-clashes",
        )
        texts = parts.select(F.sha2("norm", 256).alias("sha"), F.posexplode(_blocks(F.col("norm"), block)).alias("pos", "block"))
        texts = texts.withColumn("k", block_key("block")).join(bad, "k", "left_semi").join(by_text, ["k", "block"]).select("sha", "pos", "name2").distinct()
        texts = per_doc.select("row", F.col("sha256").alias("sha")).join(texts, "sha").select("row", "pos", "name2")
        named = named.join(texts, ["row", "pos"], "left").withColumn("name", F.coalesce("name", "name2"))
    level = 0
    current = written(named.select("row", "pos", "n_blocks", "name"), "exact-level0")
    done = current.where("n_blocks = 1").select("row", F.lit(level).alias("level"), "name")
    rest = current.where("n_blocks > 1")
    levels = [current]

    # rounds: number the adjacent pairs; a last one without neighbour is paired with 0
    while not rest.isEmpty():
        level += 1
        pairs = rest.groupBy("row", F.expr("pos div 2").cast("int").alias("pos")).agg(
            F.max(F.when(F.expr("pos % 2 = 0"), F.col("name"))).alias("a"),
            F.coalesce(F.max(F.when(F.expr("pos % 2 = 1"), F.col("name"))), F.lit(0)).alias("b"),
            F.expr("cast((max(n_blocks) + 1) div 2 as int)").alias("n_blocks"),
        )
        pairs = written(pairs, f"exact-pairs{level}")
        numbered = written(
            pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).sortWithinPartitions("a", "b").select("a", "b", "n", (F.monotonically_increasing_id() + 1).alias("name")),
            f"exact-names{level}",
        )
        current = written(join_hot(pairs, numbered, ["a", "b"], pairs.count()).select("row", "pos", "n_blocks", "name"), f"exact-level{level}")
        for x in (pairs, numbered):
            drop_written(x)
        levels.append(current)
        done = done.unionByName(current.where("n_blocks = 1").select("row", F.lit(level).alias("level"), "name"))
        rest = current.where("n_blocks > 1")
    drop_written(names)
    drop_written(blocks)

    ids = written(per_doc.select("row", "id", "sha256").join(done, "row"), "exact-ids")
    for x in (*levels, per_doc):
        drop_written(x)
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row"))
    groups = written(ids.groupBy("level", "name").agg(first.alias("first"), F.count(F.lit(1)).alias("group_size")), "exact-groups")
    return join_hot(ids, groups, ["level", "name"], ids.count(), "group_size").select(
        F.col("id").alias(key),
        F.col("first.id").alias("keep"),
        "group_size",
        (F.col("row") == F.col("first.row")).alias("kept"),
        "sha256",
        "row",
    )


def drop_exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with all their columns. docs is read again, so it should be a stored table."""
    keep, sha = fresh_names(docs, "keep", "sha")
    kept = written(exact_groups(docs, key, text).where("kept").select(F.col(key).alias(keep), F.col("sha256").alias(sha)), "exact-kept")
    stays = F.col(key).eqNullSafe(F.col(keep))
    found = docs.join(kept.select(keep).distinct(), stays, "left_semi")
    repeated = docs.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col(key).alias(keep))
    if repeated.isEmpty():
        return found
    # keys that stand in several rows: one row of each text that stays
    other = sha + " of row"
    again = found.join(repeated, stays, "left_semi").withColumn(other, F.sha2(normalised(text), 256)).dropDuplicates([key, other])
    again = again.join(kept, stays & (F.col(other) == F.col(sha)), "left_semi").drop(other)
    return found.join(repeated, stays, "left_anti").unionByName(again)
