"""Column expressions: tokens, shingles, hashes, fingerprints, paths, lines and scores. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEP = "\u001f"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def word_tokens(text) -> Column:
    """Lower-case runs of letters and digits; null has none."""
    return F.filter(F.split(F.lower(F.coalesce(_c(text), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def shingles(tokens, k: int = 3) -> Column:
    """Distinct runs of k tokens; a shorter sequence is one shingle, an empty one none."""
    def of(t: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.size(t) - k + 1), lambda i: F.array_join(F.slice(t, i, F.lit(k)), SEP))
        return F.when(F.size(t) >= k, F.array_distinct(runs)).when(F.size(t) > 0, F.array(F.array_join(t, SEP))).otherwise(F.array().cast("array<string>"))

    # bound as a variable, so that the tokens are computed once and not again for every shingle
    return F.element_at(F.transform(F.array(_c(tokens)), of), 1)


def structural_hash(tokens) -> Column:
    return F.substring(F.sha2(F.array_join(_c(tokens), " "), 256), 1, 16)


def sorted_pair(a, b, sep: str = " <===> ") -> Column:
    """Order-free fingerprint of two endpoints."""
    return F.concat_ws(sep, F.least(_c(a), _c(b)), F.greatest(_c(a), _c(b)))


def namespace(path) -> Column:
    p = _c(path)
    return F.when(F.instr(p, "/") > 0, F.regexp_replace(p, "/[^/]*$", "")).otherwise(F.lit("."))


def normalized_path(path) -> Column:
    """Forward slashes, no leading ./, upper-case drive letter."""
    p = F.regexp_replace(F.translate(_c(path), "\\\u0000", "/"), r"^(\./+)+", "")
    drive = F.regexp_extract(p, r"^([A-Za-z]):", 1)
    return F.when(drive != "", F.concat(F.upper(drive), F.regexp_replace(p, "^[A-Za-z]", ""))).otherwise(p)


def notebook_base(path) -> Column:
    """Path of the notebook that an anchor names, else the path."""
    base = F.regexp_extract(_c(path), r"(?i)^(.*\.ipynb)#cell_?([1-9]\d*)$", 1)
    return F.when(base != "", base).otherwise(_c(path))


def notebook_cell(path) -> Column:
    """0-based cell of an anchor, or null."""
    n = F.regexp_extract(_c(path), r"(?i)^(.*\.ipynb)#cell_?([1-9]\d*)$", 2)
    return F.when(n != "", n.cast("int") - 1)


def without_dots(path) -> Column:
    """Path with . and .. segments resolved; null if it climbs above its start."""
    parts = F.filter(F.split(_c(path), "/"), lambda s: (s != "") & (s != "."))
    done = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(acc.isNull(), acc)
        .when(s != "..", F.concat(acc, F.array(s)))
        .when(F.size(acc) == 0, F.lit(None).cast("array<string>"))
        .otherwise(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))),
    )
    return F.array_join(done, "/")


def relative_to(path, base) -> Column:
    """Path below base, "." for base itself, else null."""
    p, b = _c(path), _c(base)
    return F.when(p == b, F.lit(".")).when(F.startswith(p, F.concat(b, F.lit("/"))), F.substring(p, F.length(b) + 2, F.length(p)))


def paths_match(a, b) -> Column:
    """Equal, or one ends with the other at a slash."""
    a, b = _c(a), _c(b)
    return (a == b) | F.endswith(a, F.concat(F.lit("/"), b)) | F.endswith(b, F.concat(F.lit("/"), a))


def source_lines(text) -> Column:
    """Physical lines with their ends: CRLF, CR and LF only."""
    return F.regexp_extract_all(_c(text), F.lit(r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+$"), F.lit(0))


def newline_count(text) -> Column:
    return F.regexp_count(_c(text), F.lit(r"\r\n|\r|\n"))


def line_ending(text) -> Column:
    """The commonest line end; ties in the order LF, CRLF, CR; LF where there is none."""
    crlf = F.regexp_count(_c(text), F.lit(r"\r\n"))
    cr, lf = F.regexp_count(_c(text), F.lit(r"\r")) - crlf, F.regexp_count(_c(text), F.lit(r"\n")) - crlf
    return F.when((lf >= crlf) & (lf >= cr), F.lit("\n")).when(crlf >= cr, F.lit("\r\n")).otherwise(F.lit("\r"))


def lenient_int(x, default: int = 1) -> Column:
    """Whole part of a number or of text before a colon; default if it is none."""
    return F.coalesce(F.split_part(_c(x).cast("string"), F.lit(":"), F.lit(1)).try_cast("double").cast("int"), F.lit(default))


def line_bounds(start, end) -> tuple[Column, Column]:
    s = F.greatest(F.lit(1), F.coalesce(_c(start), F.lit(1)))
    return s, F.greatest(s, F.coalesce(_c(end), s))


def priority(sim, lines_a, lines_b, complexity_a, complexity_b) -> Column:
    return F.round(_c(sim) * (_c(lines_a) + _c(lines_b)) / 2.0 * F.greatest(_c(complexity_a), _c(complexity_b)), 1)


def is_suppressed(lines, start, end) -> Column:
    """A comment from the line above a unit to its end asks to ignore it."""
    seen = F.slice(_c(lines), F.greatest(F.lit(1), _c(start) - 1), F.greatest(F.lit(0), _c(end) - F.greatest(F.lit(1), _c(start) - 1) + 1))
    return F.exists(seen, lambda s: F.regexp_extract(F.lower(s), r"#(.*)", 1).rlike(r"(twinsift|clone)\s*:?\s*ignore|noqa:\s*(clone|duplicate)"))
