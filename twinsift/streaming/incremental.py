"""Incremental scan: batches of new units are joined with the units so far (foreachBatch)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.similarity import jaccard_pairs


def watch(stream: DataFrame, corpus_path: str, pairs_path: str, checkpoint: str, threshold: float = 0.7):
    """stream: id, tokens. Appends to pairs_path the pairs that have a new unit, and the units to corpus_path. A batch that is run again writes the same folder again."""

    def batch(new: DataFrame, number: int) -> None:
        spark = new.sparkSession
        new.select("id", "tokens").write.mode("overwrite").parquet(f"{corpus_path}/batch={number}")
        every = spark.read.parquet(corpus_path)
        fresh = every.where(f"batch = {number}").select("id")
        jaccard_pairs(every.where(f"batch <= {number}").select("id", "tokens"), threshold, changed=fresh).write.mode("overwrite").parquet(f"{pairs_path}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()
