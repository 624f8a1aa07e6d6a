"""Paths in two coordinate systems: below the repository and below the scanned target.

A root is a lexical path (forward slashes, no trailing slash). The offset is where the target lies in the
repository, "" if they are the same folder. Everything is a column expression over any number of paths.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import notebook_base, normalized_path, paths_match, relative_to, without_dots

BASES = ("auto", "target", "repo")


def root_text(root: str | None) -> str:
    """A root with forward slashes, without . segments, a doubled or trailing slash; an upper-case drive."""
    text = re.sub(r"(?<=.)/{2,}", "/", re.sub(r"(^|/)(\./)+", r"\1", (root or "").replace("\\", "/")))
    text = re.sub(r"(/\.)?/*$", "", text) or ("/" if text.startswith("/") else "")
    return text[0].upper() + text[1:] if re.match("[a-z]:", text) else "" if text == "." else text


def path_offset(below: str | None, root: str | None) -> str | None:
    """Where one root lies in the other: "" if they are equal, None if it lies elsewhere."""
    a, b = root_text(below), root_text(root)
    if a == b:
        return ""
    if not b:
        return None if is_absolute_text(a) else a
    return a[len(b.rstrip("/")) + 1 :] if a.startswith(b.rstrip("/") + "/") else None


def target_offsets(saved_target: str | None, repo: str | None, target: str | None = None) -> tuple[str, str]:
    """Offsets in the repository of the target that a baseline was recorded for, and of the one that is scanned now."""
    return path_offset(saved_target, repo) or "", path_offset(target if target is not None else saved_target, repo) or ""


def is_absolute_text(path: str) -> bool:
    return path.startswith("/") or bool(re.match(r"[A-Za-z]:", path))


def is_absolute(path) -> Column:
    return path_column(path).rlike(r"^(/|[A-Za-z]:)")


def path_column(path) -> Column:
    return path if isinstance(path, Column) else F.col(path)


def joined(base, rel) -> Column:
    """base / rel, with . and .. resolved; an absolute rel stands for itself; null if it climbs out."""
    b, r = path_column(base), path_column(rel)
    lead = F.when(F.startswith(b, F.lit("/")), F.lit("/")).otherwise(F.lit(""))
    return F.when(is_absolute(r), r).otherwise(F.concat(lead, without_dots(F.concat_ws("/", b, r))))


def repo_path(path, offset: str, basis: str = "target_relative") -> Column:
    """An endpoint's path below the repository."""
    p = normalized_path(path)
    return F.concat(F.lit(offset + "/"), p) if offset and not basis.startswith("repo") else p


def coordinates(path, target: str, repo: str, basis: str = "auto", strip_anchor: bool = False) -> Column:
    """Struct raw, target, repo, display of a path. A coordinate is null where the path lies outside of its root.

    basis says what a relative path is relative to; auto takes one that starts with the target's offset to be
    relative to the repository, any other to the target. display is the target's, else the repository's path,
    else the path as it is.
    """
    if basis not in BASES:
        raise ValueError(f"basis {basis!r} is none of {', '.join(BASES)}")
    target, repo = root_text(target), root_text(repo)
    offset = path_offset(target, repo)
    raw = notebook_base(path) if strip_anchor else path_column(path)
    here, none = F.lit(offset or ""), F.lit(None).cast("string")

    def relative(clean: Column, up: Column) -> tuple[Column, Column]:
        """Target's and repository's path of a relative one; up: resolved from the repository."""
        inside = (clean == here) | F.startswith(clean, F.concat(here, F.lit("/")))
        of_repo = F.lit(True) if basis == "repo" else F.lit(False) if basis == "target" or not offset else inside
        if offset is None:
            return F.when(~of_repo, clean), F.when(of_repo, clean)
        found = F.when(of_repo, clean).otherwise(up)
        return (relative_to(found, here) if offset else found), found

    def below(whole: Column, root: str) -> Column:
        return relative_to(whole, F.lit(root)) if root else none

    def resolved(cut: Column) -> Column:
        plain, lead = cut["plain"], F.regexp_extract(cut["plain"], r"^([A-Za-z]:/?|/)", 1)
        up = F.concat(here, F.lit("/"), plain) if offset else plain
        return F.struct(
            without_dots(plain).alias("clean"), without_dots(up).alias("up"), cut["anchor"].alias("anchor"), cut["p"].alias("p"),
            F.when(lead != "", F.concat(lead, without_dots(F.substr(plain, F.length(lead) + 1)))).alias("whole"),
        )

    def placed(x: Column) -> Column:
        t, r = relative(x["clean"], x["up"])
        ends = [F.concat(F.when(x["whole"].isNotNull(), below(x["whole"], root)).otherwise(rel), x["anchor"]) for root, rel in ((target, t), (repo, r))]
        return F.struct(ends[0].alias("target"), ends[1].alias("repo"), x["p"].alias("p"))

    p = normalized_path(raw)
    anchor = F.regexp_extract(p, r"(?i)\.ipynb(#cell_?[1-9]\d*)$", 1)
    cut = F.struct(F.substr(p, F.lit(1), F.length(p) - F.length(anchor)).alias("plain"), anchor.alias("anchor"), p.alias("p"))
    found = _let(_let(_let(cut, resolved), placed), lambda x: F.struct(x["target"].alias("target"), x["repo"].alias("repo"), F.coalesce(x["target"], x["repo"], x["p"]).alias("display")))
    return _let(found, lambda x: F.struct(path_column(path).alias("raw"), x["target"].alias("target"), x["repo"].alias("repo"), x["display"].alias("display")))


def _let(value: Column, then) -> Column:
    """then(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def key_of(path, target: str, repo: str, which: str = "canonical", basis: str = "auto", strip_anchor: bool = False) -> Column:
    """One key of a path: target, repo, or canonical (the repository's, else what is displayed)."""
    found = coordinates(path, target, repo, basis, strip_anchor)
    return F.coalesce(found["repo"], found["display"]) if which == "canonical" else found[which]


def equivalent(a, b, target: str, repo: str, allow_suffix: bool = True) -> Column:
    """Whether two paths name one file: by key, or (allowed) one ends with the other at a slash."""
    same = key_of(a, target, repo, strip_anchor=True).eqNullSafe(key_of(b, target, repo, strip_anchor=True))
    return same | paths_match(normalized_path(a), normalized_path(b)) if allow_suffix else same


def diff_keys(files: DataFrame, target: str, repo: str, file: str = "file", basis: str = "repo") -> DataFrame:
    """Keys of changed files in both systems: basis, key."""
    found = files.select(coordinates(file, target, repo, basis, strip_anchor=True).alias("c"))
    both = F.array(*(F.struct(F.lit(b).alias("basis"), F.col(f"c.{b}").alias("key")) for b in ("target", "repo")))
    return found.select(F.explode(both).alias("k")).select("k.basis", "k.key").where("key is not null").distinct()


def combined_keys(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    """Sets of (basis, key): union, intersection, difference or symmetric_difference."""
    if how == "union":
        return a.unionByName(b).distinct()
    if how == "intersection":
        return a.intersect(b)
    if how == "difference":
        return a.subtract(b)
    if how == "symmetric_difference":
        return a.subtract(b).unionByName(b.subtract(a))
    raise ValueError(f"no set operation {how!r}")


def in_diff(units: DataFrame, keys: DataFrame, target: str, repo: str, file: str = "file", basis: str = "target") -> DataFrame:
    """Units whose file is among the keys, in either system; a notebook cell counts with its notebook."""
    found = units.select(*units.columns, coordinates(file, target, repo, basis, strip_anchor=True).alias("coordinates of unit"))
    t = keys.where("basis = 'target'").select(F.col("key").alias("target key")).distinct()
    r = keys.where("basis = 'repo'").select(F.col("key").alias("repo key")).distinct()
    met = found.join(t, F.col("coordinates of unit.target") == F.col("target key"), "left").join(r, F.col("coordinates of unit.repo") == F.col("repo key"), "left")
    return met.where("`target key` is not null or `repo key` is not null").select(*units.columns)


def worktree_paths(paths: DataFrame, git_root: str, target: str, file: str = "file") -> DataFrame:
    """Paths that git gives (relative to its root) of files inside the target, as the target names them; other columns stay."""
    offset = path_offset(target, git_root)
    if offset is None:
        return paths.where("false")
    p = normalized_path(file)
    here = relative_to(p, F.lit(offset)) if offset else p
    return paths.withColumn(file, here).where(F.col(file).isNotNull())


def ranges_by_basis(ranges: DataFrame, git_root: str, target: str, file: str = "file") -> DataFrame:
    """Changed line ranges under both names of their file: basis, file, and the other columns."""
    rest = [c for c in ranges.columns if c != file]
    of_repo = ranges.select(F.lit("repo").alias("basis"), normalized_path(file).alias(file), *rest)
    of_target = worktree_paths(ranges, git_root, target, file).select(F.lit("target").alias("basis"), file, *rest)
    return of_repo.unionByName(of_target)


def unit_ranges(units: DataFrame, ranges: DataFrame, basis: str = "repo", file: str = "file") -> DataFrame:
    """Units with the ranges of their file in one basis only."""
    mine = ranges.where(F.col("basis") == basis).drop("basis")
    return units.join(mine, file)
