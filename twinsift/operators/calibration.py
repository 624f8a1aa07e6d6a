"""Corpus calibration: frequencies, stop shingles, reduction measures."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .similarity import document_frequency, postings_cap


def calibrate(exploded: DataFrame, total: int, frequency: float = 0.25, least_corpus: int = 30, min_frequency: int = 1) -> DataFrame:
    """shingle, df, is_stop (df above the cap); rarer than min_frequency is left out."""
    cap = postings_cap(total, frequency, least_corpus)
    df = document_frequency(exploded).where(F.col("df") >= min_frequency)
    return df.withColumn("is_stop", F.lit(False) if cap is None else F.col("df") > cap)


def reduction(df: DataFrame, min_frequency: int) -> DataFrame:
    """One row: raw, retained, removed share (4 digits)."""
    kept = F.sum((F.col("df") >= min_frequency).cast("bigint"))
    out = df.agg(F.count(F.lit(1)).alias("raw"), F.coalesce(kept, F.lit(0)).alias("retained"))
    return out.withColumn("removed_share", F.when(F.col("raw") > 0, F.round(1.0 - F.col("retained") / F.col("raw"), 4)).otherwise(0.0))


def settings_hash(settings: dict) -> str:
    return hashlib.sha256(json.dumps(settings, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def first_mismatch(saved: dict, now: dict) -> str | None:
    """The first setting, by name, in which two calibrations differ."""
    return next((k for k in sorted(saved.keys() | now.keys()) if saved.get(k) != now.get(k)), None)
