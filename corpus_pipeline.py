"""From raw documents to packed training sequences: five stages, each written as Parquet and read again.

Stages 1 to 4 return the columns of documents; the last returns the placed pieces.

Null, empty and blank texts have no language and go in the first stage, so later stages see only texts with a
letter. Very long texts are read whole by all stages. Rows that repeat a key are judged each by their own text; of
equal rows one stays. Ties go to the smallest doc_id. An empty table passes all stages empty. Extra columns are
kept up to the last stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from twinsift.llm import decontaminate, exact_dedup, language_id, near_dup, packing
from twinsift.llm.common import drop_written, remainder_of_id, table, written
from twinsift.llm.tokens import default_tokenizer


#: Pieces that a worker of the packing stage keeps (some 250 bytes each).
PACKING_PIECES = 200_000


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from the documents' own labels; texts in no language (null, or without letters) go."""
    model = language_id.train_language_codes(docs.where(remainder_of_id("doc_id", 4) != 2))
    return language_id.keep_identified(docs, model)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the smallest doc_id stays."""
    return exact_dedup.drop_exact_duplicates(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links of Jaccard 0.8 connect, the document with the smallest doc_id stays."""
    return near_dup.drop_near_duplicates(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 ids. Workers keep the memory of earlier stages, so the piece cache is small."""
    return packing.pack_documents(docs, default_tokenizer("byte_bpe_50k.json"), end_id=0, cache=PACKING_PIECES)


STAGES = [
    ("language", language_stage),
    ("exact_dedup", exact_stage),
    ("near_duplicates", near_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: Language identification and tokenization have no SQL form; tests/llm hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, written(stage(spark, docs, sf_dir), f"stage-{name}")
        drop_written(before)
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
