"""A whole scan: sources, units, pairs, filters, merging and order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..sources import code
from . import pairs as P
from . import similarity
from .store import stored

METRICS = ("shingles", "bag", "gapped", "tfidf", "calls")
_PLACE = ("file", "name", "start", "end", "complexity")


def unit_ids(units: DataFrame) -> DataFrame:
    """id: file, lines and name. Units that agree in all of them are one."""
    return units.withColumn("id", F.format_string("%s:%d-%d:%s", "file", "start", "end", "name")).dropDuplicates(["id"])


def scan_pairs(units: DataFrame, threshold: float = 0.9, metric: str = "shingles", cap: int | None = None, stop: DataFrame | None = None, changed: DataFrame | None = None) -> DataFrame:
    """units: UNIT_SCHEMA and id. i, j, sim and the places of both ends, without pairs that overlap in one file."""
    if metric == "calls":
        found = similarity.call_pairs(units, threshold, cap=cap)
    elif metric == "tfidf":
        found = similarity.tfidf_pairs(units, threshold, cap=cap)
    elif metric == "gapped":
        found = similarity.alignment_pairs(units, threshold, cap)
    elif metric == "bag":
        found = similarity.multiset_pairs(units, threshold, cap)
    else:
        found = similarity.jaccard_pairs(units, threshold, cap=cap, stop=stop, changed=changed)
    if changed is not None and metric != "shingles":
        found = P.changed_pairs(found, changed)
    side = lambda k, key: units.select(F.col("id").alias(key), *(F.col(c).alias(f"{c}{k}") for c in _PLACE))
    return similarity.compatible_places(found.select("i", "j", "sim").join(side(1, "i").hint("merge"), "i").join(side(2, "j").hint("merge"), "j"))


def ranked(pairs: DataFrame, by: str = "similarity", top: int | None = None) -> DataFrame:
    """Largest first; ties in the order of ids."""
    lines = lambda k: F.col(f"end{k}") - F.col(f"start{k}") + 1
    key = {"similarity": F.col("sim"), "priority": C.priority("sim", lines(1), lines(2), F.col("complexity1"), F.col("complexity2")), "sloc": lines(1) + lines(2)}[by]
    out = pairs.orderBy(F.desc(key), "i", "j")
    return out if top is None else out.limit(top)


def scan(files: DataFrame, threshold: float = 0.9, metric: str = "shingles", frequency: float = 0.25, suppress: bool = True, **options) -> DataFrame:
    """files: file, content. Pairs of units; options are those of code.units_of(). Files are parsed once, and the units kept."""
    units = stored(unit_ids(code.harvest(files, **options)), "scan-units")
    found = scan_pairs(units, threshold, metric, similarity.postings_cap(units.count(), frequency))
    if not suppress:
        return found
    return P.suppress_contained(found.withColumn("ord", F.concat_ws("|", "i", "j"))).drop("ord")


def code_lines(files: DataFrame) -> DataFrame:
    """file, is_code: one row per physical line; blank lines and comments are no code."""
    lines = files.select("file", F.explode(C.source_lines("content")).alias("line"))
    return lines.select("file", (~F.col("line").rlike(r"^\s*(#|$)")).alias("is_code"))


def stats(files: DataFrame, pairs: DataFrame) -> DataFrame:
    ranges = lambda k: pairs.select(F.col(f"file{k}").alias("file"), F.col(f"start{k}").alias("start"), F.col(f"end{k}").alias("end"))
    return P.dry_stats(code_lines(files), ranges(1).union(ranges(2)))
