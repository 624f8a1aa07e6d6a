"""What follows a join: merging neighbours, dropping pairs inside others, overlaps, baselines, changes, coverage, statistics."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import normalized_path, notebook_base, sorted_pair


_SIDES = ("file", "name", "start", "end", "shingles")
_MERGED = "file1 string, name1 string, start1 bigint, end1 bigint, file2 string, name2 string, start2 bigint, end2 bigint, sim double"


def _joined(a: dict, b: dict) -> dict:
    start, end = min(a["start"], b["start"]), max(a["end"], b["end"])
    name = f"{a['name'].split(':')[0]}:merged_{start}-{end}"
    return a | {"start": start, "end": end, "name": name, "shingles": a["shingles"] | b["shingles"]}


def _near(a: dict, b: dict, tolerance: int) -> bool:
    return a["start"] <= b["end"] + tolerance and b["start"] <= a["end"] + tolerance


def merge_adjacent(pairs: DataFrame, tolerance: int = 2, threshold: float | None = None) -> DataFrame:
    """Pairs of the same files and base names whose ranges are within tolerance lines on both sides merge, until none do.

    pairs: file1, name1, start1, end1, file2, name2, start2, end2, sim and, optionally, shingles1, shingles2 (arrays).
    Sides are put in the order of their files, lines and names first. A merged pair has the shingles of its parts and their Jaccard similarity (without
    shingles: the largest similarity), and goes if that is below the threshold.
    """
    known = "shingles1" in pairs.columns
    full = pairs if known else pairs.withColumns({f"shingles{k}": F.array().cast("array<string>") for k in (1, 2)})
    side = lambda k: F.struct(*(F.col(f"{c}{k}").cast("bigint" if c in ("start", "end") else "array<string>" if c == "shingles" else "string").alias(c) for c in _SIDES))
    rank = lambda k: F.struct(F.col(f"file{k}"), F.col(f"start{k}").cast("bigint"), F.col(f"end{k}").cast("bigint"), F.col(f"name{k}"))
    swap = rank(2) < rank(1)
    both = full.select(F.when(swap, side(2)).otherwise(side(1)).alias("a"), F.when(swap, side(1)).otherwise(side(2)).alias("b"), F.col("sim").cast("double").alias("sim"))
    flat = both.select(*(F.col(f"{x}.{c}").alias(f"{c}{k}") for k, x in ((1, "a"), (2, "b")) for c in _SIDES), "sim")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for r in frame.sort_values(["start1", "start2", "end1", "end2"]).to_dict("records"):
            one, two = ({c: set(r[f"{c}{k}"]) if c == "shingles" else r[f"{c}{k}"] for c in _SIDES} for k in (1, 2))
            rows.append((one, two, r["sim"]))
        count = -1
        while count != len(rows):
            count, out = len(rows), []
            for one, two, sim in rows:
                at = next((k for k, o in enumerate(out) if _near(o[0], one, tolerance) and _near(o[1], two, tolerance)), None)
                if at is None:
                    out.append((one, two, sim))
                else:
                    x, y = _joined(out[at][0], one), _joined(out[at][1], two)
                    union = x["shingles"] | y["shingles"]
                    out[at] = x, y, len(x["shingles"] & y["shingles"]) / len(union) if union else 0.0 if known else max(out[at][2], sim)
            rows = out
        return pd.DataFrame([(*(x[c] for c in _SIDES[:4]), *(y[c] for c in _SIDES[:4]), s) for x, y, s in rows], columns=[c.split()[0] for c in _MERGED.split(", ")])

    based = flat.withColumns({f"base{k}": F.split_part(f"name{k}", F.lit(":"), F.lit(1)) for k in (1, 2)})
    out = based.groupBy("file1", "file2", "base1", "base2").applyInPandas(run, _MERGED)
    return out if threshold is None else out.where(F.col("sim") >= threshold)


def drop_exemptions(pairs: DataFrame, exemptions: DataFrame, prefixes: tuple[str, ...] = ("src/",)) -> DataFrame:
    """pairs: i, j, file1, name1, file2, name2; exemptions: a, b, each `file` or `file:name`, in either order.

    An entry names files by path, by path without one of the prefixes, or (if neither end has a folder) by base name.
    """
    path = lambda c: normalized_path(F.regexp_replace(c, r":[^:/\\]*$", ""))
    symbol = lambda c: F.regexp_extract(c, r"(:[^:/\\]+)$", 1)
    base = lambda c: F.regexp_replace(c, "^.*/", "")
    keyed = lambda tag, a, b: F.concat(F.lit(tag), sorted_pair(a, b))
    a, b = F.col("a"), F.col("b")
    plain = ~F.concat(path(a), path(b)).contains("/")
    whole, short = keyed("p", F.concat(path(a), symbol(a)), F.concat(path(b), symbol(b))), keyed("b", F.concat(base(path(a)), symbol(a)), F.concat(base(path(b)), symbol(b)))
    entries = exemptions.select(F.explode(F.when(plain, F.array(whole, short)).otherwise(F.array(whole))).alias("key")).distinct()
    stripped = lambda c: F.coalesce(*(F.when(F.startswith(c, F.lit(p)), F.substr(c, F.lit(len(p) + 1))) for p in prefixes), c)
    file = lambda k: normalized_path(f"file{k}")
    name = lambda k: F.concat(F.lit(":"), f"name{k}")
    ways = [("p", file), ("p", lambda k: stripped(file(k))), ("b", lambda k: base(file(k)))]
    keys = [keyed(tag, f(1), f(2)) for tag, f in ways] + [keyed(tag, F.concat(f(1), name(1)), F.concat(f(2), name(2))) for tag, f in ways]
    hit = pairs.select("i", "j", F.explode(F.array_distinct(F.array(*keys))).alias("key")).join(entries, "key", "left_semi").select("i", "j").distinct()
    return pairs.join(hit, ["i", "j"], "left_anti")


def _suffixes(path):
    """The path and what follows each of its slashes."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/"))


def lookup_by_path(units: DataFrame, values: DataFrame) -> DataFrame:
    """units: file; values: path, ord. file, path of the best match: the same path, else one that ends with the other at a slash; then both without a notebook anchor; ties: least ord. Equi-joins on suffixes only."""
    files = units.select("file").distinct().withColumn("full", normalized_path("file"))
    paths = values.select("path", "ord").withColumn("full", normalized_path("path"))
    found = None
    for tier, of in ((0, lambda c: F.col(c)), (2, notebook_base)):
        u, v = files.select("file", of("full").alias("key")), paths.select("path", "ord", of("full").alias("key"))
        longer = u.select("file", F.col("key").alias("whole"), F.explode(_suffixes("key")).alias("key")).join(v, "key").select("file", "path", "ord", F.when(F.col("whole") == F.col("key"), tier).otherwise(tier + 1).alias("tier"))
        shorter = v.select("path", "ord", F.explode(_suffixes("key")).alias("key")).join(u, "key").select("file", "path", "ord", F.lit(tier + 1).alias("tier"))
        both = longer.unionByName(shorter)
        found = both if found is None else found.unionByName(both)
    return found.groupBy("file").agg(F.min_by("path", F.struct("tier", "ord")).alias("path"))


_INSIDE = ("ord", "file1", "start1", "end1", "file2", "start2", "end2", "sim")


def suppress_contained(pairs: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Drops a pair strictly inside a kept pair of the same two files (either way round) whose sim is at least its own less tolerance. pairs: ord, file1, start1, end1, file2, start2, end2, sim.

    Python sees many groups at once, and only those of more than one pair.
    """

    def judged(frame: pd.DataFrame) -> list[bool]:
        rows = list(frame.sort_values("ord").itertuples())
        gone: set[int] = set()
        for k, p in enumerate(rows):
            if k in gone:
                continue
            for m, c in enumerate(rows):
                if m == k or m in gone or p.sim < c.sim - tolerance:
                    continue
                sides = [(c.file1, c.start1, c.end1, c.file2, c.start2, c.end2), (c.file2, c.start2, c.end2, c.file1, c.start1, c.end1)]
                for f1, s1, e1, f2, s2, e2 in sides:
                    if (f1, f2) == (p.file1, p.file2) and p.start1 <= s1 and e1 <= p.end1 and p.start2 <= s2 and e2 <= p.end2 and (s1, e1, s2, e2) != (p.start1, p.end1, p.start2, p.end2):
                        gone.add(m)
        return frame["ord"].isin([r.ord for k, r in enumerate(rows) if k not in gone]).tolist()

    @F.pandas_udf("array<boolean>")
    def keeps(*columns: pd.Series) -> pd.Series:
        return pd.Series([None if x[0] is None else judged(pd.DataFrame(dict(zip(_INSIDE, x, strict=True)))) for x in zip(*columns, strict=True)], dtype=object)

    grouped = pairs.groupBy(F.least("file1", "file2"), F.greatest("file1", "file2")).agg(F.collect_list(F.struct(*pairs.columns)).alias("_rows"))
    flags = keeps(*(F.when(F.size("_rows") > 1, F.col("_rows").getField(c)) for c in _INSIDE))
    kept = F.filter("_rows", lambda _, k: F.coalesce(F.get("_keep", k), F.lit(True)))
    return grouped.withColumn("_keep", flags).select(F.inline(kept))


def collisions(intervals: DataFrame, group: str, start: str = "start", end: str = "end") -> DataFrame:
    """Rows that begin before an earlier row of their group has ended (half-open)."""
    w = Window.partitionBy(group).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    return intervals.withColumn("reach", F.max(end).over(w)).where(F.col("reach") > F.col(start))


def largest_disjoint(units: DataFrame) -> DataFrame:
    """Per file, a maximal set of units (file, start, end) without overlap: longest first, then earliest."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        keep = []
        for r in frame.assign(_n=frame.start - frame.end).sort_values(["_n", "start", "end"], kind="stable").itertuples():
            if all(r.end < frame.start[k] or frame.end[k] < r.start for k in keep):
                keep.append(r.Index)
        return frame.loc[sorted(keep)]

    return units.groupBy("file").applyInPandas(run, units.schema)


def suppress_known(clones: DataFrame, baseline: DataFrame, tiers: list[str]) -> DataFrame:
    """Clones that no baseline record accounts for. Each record accounts for one clone; keys are tried in the order of tiers, equal keys in the order of ord."""
    left, records = clones, baseline
    for key in tiers:
        w = Window.partitionBy(key).orderBy("ord")
        a, b = left.withColumn("_n", F.row_number().over(w)), records.withColumn("_n", F.row_number().over(w))
        used = a.where(F.col(key).isNotNull()).select(key, "_n").join(b.select(key, "_n"), [key, "_n"])
        left = a.join(used, [key, "_n"], "left_anti").drop("_n")
        records = b.join(used, [key, "_n"], "left_anti").drop("_n")
    return left


def prune_baseline(baseline: DataFrame, active: DataFrame, key: str) -> DataFrame:
    """Records that a current clone still has."""
    return baseline.join(active.select(key).distinct(), key, "left_semi")


def changed_lines(units: DataFrame, ranges: DataFrame) -> DataFrame:
    """units: id, file, start, end; ranges: file, lo, hi. Changed lines of each unit, and their share (4 digits)."""
    hit = units.join(ranges, "file").where("lo <= end and start <= hi")
    lines = hit.select("id", F.explode(F.sequence(F.greatest("start", "lo"), F.least("end", "hi"))).alias("line")).distinct()
    n = lines.groupBy("id").agg(F.count(F.lit(1)).alias("changed"))
    out = units.join(n, "id", "left").withColumn("changed", F.coalesce("changed", F.lit(0).cast("bigint")))
    return out.withColumn("share", F.round(F.col("changed") / (F.col("end") - F.col("start") + 1), 4))


def touched(units: DataFrame, policy: str = "any", least: float = 0.0) -> DataFrame:
    bound = least if least > 0 else {"any": 0.0, "major": 0.5, "new": 0.8}[policy]
    return units.where((F.col("changed") > 0) & (F.col("share") >= bound))


def changed_pairs(pairs: DataFrame, ids: DataFrame, both: bool = False) -> DataFrame:
    marks = ids.select("id").distinct()
    one = pairs.join(marks.toDF("i"), "i", "left_semi")
    if both:
        return one.join(marks.toDF("j"), "j", "left_semi")
    return one.unionByName(pairs.join(marks.toDF("i"), "i", "left_anti").join(marks.toDF("j"), "j", "left_semi"))


def coverage_ratio(units: DataFrame, covered: DataFrame) -> DataFrame:
    """units: id, file, start, end; covered: file, line. Share of covered lines."""
    n = units.join(covered.distinct(), "file").where("line between start and end").groupBy("id").agg(F.count(F.lit(1)).alias("hit"))
    return units.join(n, "id", "left").select("id", (F.coalesce("hit", F.lit(0)) / (F.col("end") - F.col("start") + 1)).alias("coverage"))


def asymmetric(pairs: DataFrame, coverage: DataFrame, least: float = 0.4) -> DataFrame:
    both = pairs.join(coverage.toDF("i", "c1"), "i").join(coverage.toDF("j", "c2"), "j")
    return both.where(F.abs(F.col("c1") - F.col("c2")) >= least)


def diverged(pairs: DataFrame, edits: DataFrame, days: float = 90.0) -> DataFrame:
    """edits: id, ts (seconds). Pairs last edited at least so many days apart; unknown times (<= 0) never count."""
    both = pairs.join(edits.toDF("i", "t1"), "i").join(edits.toDF("j", "t2"), "j").where("t1 > 0 and t2 > 0")
    return both.withColumn("days", F.abs(F.col("t1") - F.col("t2")) / 86400.0).where(F.col("days") >= days)


def dry_stats(lines: DataFrame, clone_ranges: DataFrame, family_count: int = 0) -> DataFrame:
    """lines: file, is_code; clone_ranges: file, start, end. One row: sloc, duplicated lines, percentage, score, grade."""
    zero = F.lit(0).cast("bigint")
    sloc = lines.where("is_code").agg(F.count(F.lit(1)).alias("sloc"), zero.alias("dloc"))
    dup = clone_ranges.select("file", F.explode(F.sequence("start", "end")).alias("line")).distinct().agg(zero.alias("sloc"), F.count(F.lit(1)).alias("dloc"))
    pct = F.when(F.col("sloc") > 0, F.least(F.lit(100.0), F.col("dloc") * 100.0 / F.col("sloc"))).otherwise(0.0)
    score = 100.0 - F.col("pct")
    grade = F.when(score >= 98, "A+").when(score >= 95, "A").when(score >= 90, "B").when(score >= 80, "C").otherwise("F")
    return sloc.unionByName(dup).agg(F.sum("sloc").alias("sloc"), F.sum("dloc").alias("dloc")).withColumn("pct", pct).withColumn("score", score).withColumn("grade", grade).withColumn("families", F.lit(family_count))
