"""Known clones on file: fingerprints of pairs, writing and reading them, and matching a scan with them."""

from __future__ import annotations

from collections import namedtuple
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import namespace, sorted_pair
from .families import connected_components

ENDS = ("file1", "name1", "hash1", "file2", "name2", "hash2")
RECORD = "ord bigint, " + ", ".join(f"{c} string" for c in ENDS) + ", fingerprint string, path_hash string, namespace_hash string, pure string"


def fingerprints(pairs: DataFrame) -> DataFrame:
    """pairs: file1, name1, hash1, file2, name2, hash2. Adds four fingerprints, none of which depends on the order of the ends."""

    def of(sep, left, right):
        return sorted_pair(F.concat(left(1), F.lit(sep), right(1)), F.concat(left(2), F.lit(sep), right(2)))

    col = lambda c: (lambda k: F.col(f"{c}{k}"))
    place = lambda k: namespace(f"file{k}")
    return pairs.withColumns({
        "fingerprint": of(":", col("file"), col("name")), "path_hash": of("#", col("file"), col("hash")),
        "namespace_hash": of("#", place, col("hash")), "pure": sorted_pair("hash1", "hash2"),
    })


def record(pairs: DataFrame, path: str) -> None:
    """pairs: ord and the ends. Writes JSON lines, one record per pair."""
    fingerprints(pairs).select(*(c.split()[0] for c in RECORD.split(", "))).write.mode("overwrite").json(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    """Records of a file; missing fingerprints come from the ends. A line that is no record gives none."""
    rows = spark.read.schema(RECORD).json(path).where("file1 is not null and file2 is not null")
    full = fingerprints(rows.select("ord", *ENDS))
    return full


def _meet(a: str, b: str) -> bool:
    return a == b or a.endswith("/" + b) or b.endswith("/" + a)


def _same_place(r, c) -> bool:
    """Paths equal at a slash from their ends, with the hashes of their sides; either way round."""
    straight = _meet(r.file1, c.file1) and _meet(r.file2, c.file2) and (r.hash1, r.hash2) == (c.hash1, c.hash2)
    return straight or (_meet(r.file1, c.file2) and _meet(r.file2, c.file1) and (r.hash1, r.hash2) == (c.hash2, c.hash1))


def _names(x) -> list:
    return sorted((x.name1, x.name2))


def _spaces(x) -> list:
    return sorted(f.rpartition("/")[0] or "." for f in (x.file1, x.file2))


#: (what must hold, what is preferred), in the order in which they are tried.
PASSES = (
    (lambda r, c: r.fingerprint == c.fingerprint, lambda r, c: r.path_hash == c.path_hash),
    (lambda r, c: r.path_hash == c.path_hash, None),
    (lambda r, c: r.namespace_hash == c.namespace_hash, lambda r, c: _names(r) == _names(c)),
    (lambda r, c: r.pure == c.pure and _spaces(r) == _spaces(c), lambda r, c: _names(r) == _names(c)),
    (lambda r, c: r.pure == c.pure and r.hash1 != r.hash2 and _names(r) == _names(c), None),
    (lambda r, c: r.pure == c.pure and _names(r) == _names(c) and _same_place(r, c), None),
)


def _pick(records: list, clone):
    for needed, liked in PASSES:
        fits = [r for r in records if needed(r, clone)]
        if fits:
            return next((r for r in fits if liked(r, clone)), fits[0]) if liked else fits[0]
    return None


def matches(clones: DataFrame, known: DataFrame) -> DataFrame:
    """clone, record: the record that accounts for each clone (both by ord). A record accounts for one clone; clones choose in their order.

    Every pass needs an equal fingerprint or an equal pair of hashes, so rows that no chain of these connects cannot
    compete, and each connected set is matched alone; Python sees many sets at once. (Equal 64-bit hashes of different
    keys only put two sets together.) Ends must not be null.
    """
    side = lambda rows, is_clone: fingerprints(rows.select(F.col("ord").cast("bigint").alias("ord"), *ENDS)).withColumn("is_clone", F.lit(is_clone))
    rows = side(clones, True).unionByName(side(known, False))
    rows = rows.withColumns({"a": F.xxhash64(F.lit("f"), "fingerprint"), "b": F.xxhash64(F.lit("p"), "pure")})
    parts = connected_components(rows.select(F.col("a").alias("k1"), F.col("b").alias("k2")))
    row = namedtuple("row", ("ord", "is_clone", *ENDS, "fingerprint", "path_hash", "namespace_hash", "pure"))

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            sets = batch.column(0)
            all_rows = map(row._make, zip(*(x.to_pylist() for x in sets.flatten().flatten()), strict=True))
            out = []
            for n in pc.list_value_length(sets).to_pylist():
                found = sorted(islice(all_rows, n), key=lambda r: r.ord)
                left = [r for r in found if not r.is_clone]
                for c in found:
                    if c.is_clone and (r := _pick(left, c)) is not None:
                        left.remove(r)
                        out.append((c.ord, r.ord))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["clone", "record"])

    grouped = rows.join(parts.toDF("a", "component").hint("merge"), "a").groupBy("component")
    both = grouped.agg(F.collect_list(F.struct(*row._fields)).alias("rows"), F.max("is_clone").alias("clones"), F.min("is_clone").alias("no records")).where("clones and not `no records`")
    return both.select("rows").mapInArrow(run, "clone bigint, record bigint")


def unknown_clones(clones: DataFrame, known: DataFrame) -> DataFrame:
    """Clones that no record accounts for."""
    return clones.join(matches(clones, known).select(F.col("clone").alias("ord")), "ord", "left_anti")


def pruned(known: DataFrame, clones: DataFrame, dirty: DataFrame | None = None) -> DataFrame:
    """Records that still account for a clone, or that touch a file (column file) with changes that are not committed."""
    keep = matches(clones, known).select(F.col("record").alias("ord"))
    if dirty is not None:
        files = dirty.select("file").distinct()
        keep = keep.union(known.join(files, F.col("file1") == F.col("file"), "left_semi").select("ord")).union(known.join(files, F.col("file2") == F.col("file"), "left_semi").select("ord"))
    return known.join(keep.distinct(), "ord", "left_semi")
