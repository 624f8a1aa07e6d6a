"""The life of a baseline file: reading what any version wrote, path bases, pruning with rewritten ends, calibration metadata.

Records are a DataFrame (ord, the ends file1, name1, hash1, file2, name2, hash2); metadata is a small dictionary.
Settings from files are never trusted: each has a column expression (over many) and a function (of one) that
gives a sane value or null.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from dataclasses import dataclass, field
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.paths import repo_path, target_offsets
from . import baseline
from .pairs import suppress_known
from .store import stored

VERSION, VERSIONS = "1.5", ("1.0", "1.1", "1.2", "1.3", "1.4", "1.5")
MOST_UNITS, DEEPEST = 1_000_000_000, 20
LEAST_CORPUS, LEAST_CORPUS_WITH_STOPS = 30, 4
#: Tags of keys on file.
TAGS = ("t:", "s:", "i:", "f:", "b:")


def safe_int(value, least: int = 1) -> int | None:
    """A whole number of at least that much, or None; a boolean is no number."""
    if isinstance(value, bool) or not isinstance(value, (int, float, str)):
        return None
    try:
        number = int(value)
    except (ValueError, OverflowError):
        return None
    return number if number >= least else None


def safe_bool(value) -> bool:
    return value.strip().lower() in ("true", "1", "yes") if isinstance(value, str) else bool(value)


def safe_hash(value, lengths: tuple[int, ...] = (64,)) -> str | None:
    text = value.strip().lower() if isinstance(value, str) else ""
    return text if len(text) in lengths and re.fullmatch("[0-9a-f]+", text) else None


def safe_frequency(value) -> float | None:
    """A share above 0 and up to 1."""
    if isinstance(value, bool):
        return None
    try:
        share = float(value)
    except (TypeError, ValueError, OverflowError):
        return None
    return share if math.isfinite(share) and 0 < share <= 1 else None


def safe_units(value) -> int:
    return min(MOST_UNITS, safe_int(value, 0) or 0)


def safe_least_corpus(value, with_stops: bool = False) -> int:
    return safe_int(value) or (LEAST_CORPUS_WITH_STOPS if with_stops else LEAST_CORPUS)


def safe_int_column(value, least: int = 1) -> Column:
    number = _col(value).cast("string").try_cast("bigint")
    return F.when(number >= least, number)


def safe_bool_column(value) -> Column:
    return F.coalesce(F.lower(F.trim(_col(value).cast("string"))).isin("true", "1", "yes"), F.lit(False))


def safe_hash_column(value, lengths: tuple[int, ...] = (64,)) -> Column:
    text = F.lower(F.trim(_col(value)))
    return F.when(text.rlike("^[0-9a-f]+$") & F.length(text).isin(*lengths), text)


def safe_frequency_column(value) -> Column:
    share = _col(value).cast("string").try_cast("double")
    return F.when((share > 0) & (share <= 1), share)


def safe_units_column(value) -> Column:
    return F.least(F.lit(MOST_UNITS).cast("bigint"), F.coalesce(safe_int_column(value, 0), F.lit(0).cast("bigint")))


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def key_text(key) -> str:
    """A shingle key as a file holds it: sequences, numbers and booleans by their tag, text as it is unless it looks tagged."""
    match key:
        case list() | tuple():
            return "t:" + json.dumps(list(key))
        case bool():
            return f"b:{int(key)}"
        case int():
            return f"i:{key}"
        case float():
            return f"f:{key}"
        case str():
            return "s:" + key if key.startswith((*TAGS, "[")) else key
    return str(key)


def key_value(text: str):
    """What key_text() wrote; untagged arrays of old files too. Text that does not parse stays text."""
    tag, rest = text[:2], text[2:]
    try:
        if tag == "t:" or text.startswith("["):
            found = json.loads(rest if tag == "t:" else text)
            return frozen(found) if isinstance(found, list) else text
        if tag == "i:":
            return int(rest)
        if tag == "f:":
            return float(rest)
    except (ValueError, RecursionError):
        return text
    return rest == "1" if tag == "b:" else rest if tag == "s:" else text


def frozen(value, depth: int = 0):
    """Nested lists as tuples, to a bounded depth."""
    if depth > DEEPEST:
        raise RecursionError("a key is nested too deeply")
    return tuple(frozen(x, depth + 1) for x in value) if isinstance(value, (list, tuple)) else value


def key_text_column(tokens) -> Column:
    """The stored form of an array of tokens."""
    return F.concat(F.lit("t:"), F.regexp_replace(F.to_json(_col(tokens)), '","', '", "'))


def frequencies(raw: DataFrame, most: int | None = None) -> DataFrame:
    """key, df: rows whose number is a positive whole one, at most the number of units; of a repeated key the largest."""
    number = safe_int_column("df")
    number = number if most is None else F.when(number > most, F.lit(most).cast("bigint")).otherwise(number)
    return raw.select("key", number.alias("df")).where("key is not null and df is not null").groupBy("key").agg(F.max("df").alias("df"))


class PruneResult(NamedTuple):
    pruned: int
    retained: int
    dirty: int = 0


@dataclass
class BaselineFile:
    """Records of known clones, and what is known of the scan that wrote them."""

    records: DataFrame
    version: str = VERSION
    basis: str = "target_relative"
    target: str = "."
    calibration: dict = field(default_factory=dict)
    frequencies: DataFrame | None = None


_END = T.StructType([T.StructField(c, T.StringType()) for c in ("file", "name", "structural_hash")])
_OLD = T.StructType([T.StructField(c, T.StringType()) for c in ("file1", "name1", "hash1", "file2", "name2", "hash2", "fingerprint")] + [T.StructField("unit1", _END), T.StructField("unit2", _END)])


def record_ends(rows: DataFrame) -> DataFrame:
    """Ends of records of any version: own columns, else nested units, else the two halves of the symbol fingerprint."""
    half = lambda k: F.element_at(F.split("fingerprint", " <===> "), k)
    file_of = lambda k: F.regexp_replace(half(k), ":[^:/]*$", "")
    name_of = lambda k: F.regexp_extract(half(k), ":([^:/]*)$", 1)
    ends = [F.coalesce(f"file{k}", f"unit{k}.file", F.try_element_at(F.array(file_of(k)), F.lit(1))).alias(f"file{k}") for k in (1, 2)]
    names = [F.coalesce(f"name{k}", f"unit{k}.name", name_of(k), F.lit("")).alias(f"name{k}") for k in (1, 2)]
    hashes = [F.coalesce(f"hash{k}", f"unit{k}.structural_hash", F.lit("")).alias(f"hash{k}") for k in (1, 2)]
    order = [ends[0], names[0], hashes[0], ends[1], names[1], hashes[1]]
    return rows.select("ord", *order).where("file1 is not null and file2 is not null")


def read_file(spark: SparkSession, path: str) -> BaselineFile:
    """A baseline of any version: a list of fingerprints, an object with records, or JSON lines."""
    text = "\n".join(r[0] for r in spark.read.text(path).toLocalIterator())
    try:
        data = json.loads(text)
    except ValueError:
        return BaselineFile(baseline.load(spark, path).select("ord", *baseline.ENDS))
    head = data if isinstance(data, dict) else {}
    rows = data if isinstance(data, list) else head.get("clones", head.get("records", head.get("fingerprints", [])))
    rows = [{"fingerprint": r} if isinstance(r, str) else r for r in rows if isinstance(r, (str, dict))]
    lines = spark.createDataFrame([(k, json.dumps(r)) for k, r in enumerate(rows)], "ord bigint, line string")
    parsed = lines.select("ord", F.from_json("line", _OLD).alias("r")).select("ord", "r.*")
    wide = parsed.withColumn("fingerprint", F.when(F.col("fingerprint").contains(" <===> "), F.col("fingerprint")))
    saved = head.get("corpus_calibration") if isinstance(head.get("corpus_calibration"), dict) else {}
    known = saved.get("shingle_frequencies") if isinstance(saved.get("shingle_frequencies"), dict) else {}
    counts = spark.createDataFrame([(str(k), str(v)) for k, v in known.items()], "key string, df string")
    version = str(head.get("version", VERSIONS[0]))
    basis = "repo_relative" if str(head.get("path_basis", "")).startswith("repo") else "target_relative"
    return BaselineFile(record_ends(wide), version if version in VERSIONS else VERSIONS[0], basis, str(head.get("target", ".")), settings_of(saved), frequencies(counts, safe_units(saved.get("total_units")) or None))


def settings_of(saved: dict) -> dict:
    """The settings of a calibration in canonical form."""
    stops = safe_bool(saved.get("filter_stop_shingles", False))
    flags = ("bag_of_tokens", "call_sequences", "audit_tests", "include_notebooks")
    return {
        **{name: safe_bool(saved.get(name, False)) for name in flags},
        "filter_stop_shingles": stops,
        "max_index_frequency": safe_frequency(saved.get("max_index_frequency")) or 0.25,
        "min_corpus_size": safe_least_corpus(saved.get("min_corpus_size"), stops),
        "min_frequency": safe_int(saved.get("min_frequency")) or 1,
        "total_units": safe_units(saved.get("total_units")),
        "excludes": sorted({str(x) for x in saved.get("excludes") or ()}),
        "harvest": {str(k): safe_bool(v) for k, v in sorted((saved.get("harvest") or {}).items())},
        "scope": str(saved.get("scope") or "."),
    }


def config_hash(settings: dict) -> str:
    """Names the settings that make two calibrations comparable; sizes of the corpus do not."""
    kept = {k: v for k, v in settings_of(settings).items() if k not in ("total_units", "min_frequency")}
    return hashlib.sha256(json.dumps(kept, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def setting_mismatch(saved: dict, now: dict) -> str | None:
    """The first setting that keeps a saved calibration from serving a scan; None if it serves."""
    a, b = settings_of(saved), settings_of(now)
    for name in ("bag_of_tokens", "call_sequences", "filter_stop_shingles", "audit_tests", "include_notebooks", "excludes", "min_corpus_size", "max_index_frequency", "harvest", "scope"):
        if a[name] != b[name]:
            return name
    digest = safe_hash(saved.get("config_hash"))
    return "config_hash" if digest and digest != config_hash(saved) else None


def is_compatible(saved: dict, now: dict) -> bool:
    return setting_mismatch(saved, now) is None


def refreshed(saved: dict, target: str, basis: str) -> dict:
    """Metadata after pruning: this version, the basis, the scope and the hash of what is left."""
    calibration = {**saved, "scope": target}
    return {**calibration, "version": VERSION, "path_basis": basis, "config_hash": config_hash(calibration)}


def detected_basis(clones: DataFrame, offset: str, explicit: str | None = None, sample: int = 50) -> str:
    """Whether ends are relative to the repository: most of the first clones' files lie below the target's offset."""
    if explicit:
        return "repo_relative" if explicit.startswith("repo") else "target_relative"
    if not offset:
        return "target_relative"
    below = lambda c: F.startswith(F.col(c), F.lit(offset + "/")).cast("int")
    share = clones.orderBy("ord").limit(sample).agg(F.avg((below("file1") + below("file2")) / 2)).first()[0]
    return "repo_relative" if (share or 0) > 0.5 else "target_relative"


def in_repository(rows: DataFrame, offset: str, basis: str) -> DataFrame:
    """Records or clones with both files named from the repository's root."""
    return rows.withColumns({f"file{k}": repo_path(f"file{k}", offset, basis) for k in (1, 2)})


def prune(known: BaselineFile, clones: DataFrame, dirty: DataFrame | None = None, repo: str = ".", target: str | None = None, clone_basis: str | None = None) -> tuple[DataFrame, PruneResult]:
    """Records that still account for a clone, with their ends as the clone names them now, and those that touch a dirty file, as they are.

    dirty: column file, from the repository's root. Ends keep the basis of the baseline.
    """
    base_offset, scan_offset = target_offsets(known.target, repo, target)
    basis = detected_basis(clones, scan_offset, clone_basis)
    records, active = in_repository(known.records, base_offset, known.basis), in_repository(clones, scan_offset, basis)
    found = baseline.matches(active, records)
    new = active.select(F.col("ord").alias("clone"), *(F.col(c).alias(f"new {c}") for c in baseline.ENDS))
    kept = records.join(found.withColumnRenamed("record", "ord"), "ord", "left").join(new, "clone", "left")
    if dirty is not None:
        files = dirty.select(F.col("file").alias("dirty file")).distinct()
        touched = records.select("ord", F.explode(F.array("file1", "file2")).alias("dirty file")).join(files, "dirty file", "left_semi").select("ord").distinct().withColumn("touched", F.lit(True))
        kept = kept.join(touched, "ord", "left")
    else:
        kept = kept.withColumn("touched", F.lit(None).cast("boolean"))
    swapped = (F.col("hash1") == F.col("new hash2")) & (F.col("hash2") == F.col("new hash1")) & (F.col("hash1") != F.col("hash2"))
    side = {c: c[:-1] + ("2" if c[-1] == "1" else "1") for c in baseline.ENDS}
    rewritten = [F.when(F.col("clone").isNull(), F.col(c)).when(swapped, F.col(f"new {side[c]}")).otherwise(F.col(f"new {c}")).alias(c) for c in baseline.ENDS]
    state = F.when(F.col("clone").isNotNull(), F.lit("retained")).when(F.col("touched"), F.lit("dirty")).otherwise(F.lit("pruned"))
    decided = kept.select("ord", *rewritten, state.alias("state"))
    if known.basis.startswith("target") and base_offset:
        cut = lambda c: F.when(F.startswith(F.col(c), F.lit(base_offset + "/")), F.substring(F.col(c), len(base_offset) + 2, 1 << 20)).otherwise(F.col(c))
        decided = decided.withColumns({"file1": cut("file1"), "file2": cut("file2")})
    decided = stored(decided, "baseline-decided")
    counts = {r["state"]: r["n"] for r in decided.groupBy("state").agg(F.count(F.lit(1)).alias("n")).collect()}
    return decided.where("state <> 'pruned'"), PruneResult(counts.get("pruned", 0), counts.get("retained", 0), counts.get("dirty", 0))


def without_known_prints(clones: DataFrame, prints: DataFrame) -> DataFrame:
    """clones less those a bag of fingerprints (column fingerprint) accounts for, tried as symbol, path, namespace and pure prints; each is used once."""
    kinds = ["fingerprint", "path_hash", "namespace_hash", "pure"]
    rows = prints.select(*(F.col("fingerprint").alias(k) for k in kinds), F.monotonically_increasing_id().alias("ord"))
    return suppress_known(baseline.fingerprints(clones), rows, kinds).select(*clones.columns)
