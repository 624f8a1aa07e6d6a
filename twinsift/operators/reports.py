"""Report rows: JSON, SARIF, annotations and Markdown, one value per pair, built in the JVM."""

from __future__ import annotations

import difflib
import json
import os

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _unit(k: int) -> Column:
    return F.struct(*(F.col(f"{c}{k}").alias(c) for c in ("file", "name", "start", "end")))


def json_rows(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.to_json(F.struct(F.round("sim", 4).alias("similarity"), _unit(1).alias("unit_a"), _unit(2).alias("unit_b"))).alias("json"))


def sarif_rows(pairs: DataFrame) -> DataFrame:
    """One SARIF 2.1.0 result per pair; error from 0.95."""

    def place(k):
        region = F.struct(F.col(f"start{k}").alias("startLine"), F.col(f"end{k}").alias("endLine"))
        return F.struct(F.struct(F.struct(F.col(f"file{k}").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))

    level = F.when(F.col("sim") >= 0.95, "error").otherwise("warning")
    text = F.format_string("%s duplicates %s (%.1f%%)", "name1", "name2", F.col("sim") * 100)
    return pairs.select(level.alias("level"), F.to_json(F.struct(F.lit("code-clone").alias("ruleId"), level.alias("level"), F.struct(text.alias("text")).alias("message"), F.array(place(1)).alias("locations"), F.array(place(2)).alias("relatedLocations"))).alias("result"))


def annotations(pairs: DataFrame) -> DataFrame:
    """Two warning lines per pair, one at each end."""

    def line(a, b):
        return F.format_string("::warning file=%s,line=%d,endLine=%d::Duplicate of %s in %s", f"file{a}", f"start{a}", f"end{a}", f"name{b}", f"file{b}")

    return pairs.select(F.explode(F.array(line(1, 2), line(2, 1))).alias("line"))


def markdown(stats: DataFrame) -> DataFrame:
    """stats of dry_stats() as a table."""
    return stats.select(F.format_string("| metric | value |\n|---|---|\n| SLOC | %d |\n| duplicated lines | %d |\n| duplication | %.2f%% |\n| grade | %s |\n", "sloc", "dloc", "pct", "grade").alias("markdown"))


@F.pandas_udf(T.StringType())
def clone_diff(name1: pd.Series, text1: pd.Series, name2: pd.Series, text2: pd.Series) -> pd.Series:
    """Unified diff of the texts of two units."""
    rows = zip(name1, text1, name2, text2, strict=True)
    return pd.Series(["\n".join(difflib.unified_diff((a or "").splitlines(), (b or "").splitlines(), n, m, lineterm="")) for n, a, m, b in rows], dtype=object)


@F.pandas_udf(T.StringType())
def suggestion(name1: pd.Series, text1: pd.Series, name2: pd.Series, text2: pd.Series) -> pd.Series:
    """What to do about a pair: parametrize two tests, else share a helper named after the common start of the names."""
    out = []
    for n, a, m, b in zip(name1, text1, name2, text2, strict=True):
        n, m = n.split(":")[0], m.split(":")[0]
        varying = sum(x[0] in "-+" for x in difflib.ndiff((a or "").splitlines(), (b or "").splitlines()) if x)
        if n.startswith("test_") and m.startswith("test_"):
            out.append(f"Parametrize {n} and {m} (pytest.mark.parametrize); {varying} varying lines.")
        else:
            stem = os.path.commonprefix([n.lstrip("_"), m.lstrip("_")]).strip("_") or "logic"
            out.append(f"Move the common part of {n} and {m} to _shared_{stem}; {varying} varying lines.")
    return pd.Series(out, dtype=object)


def package_sloc(lines: DataFrame) -> DataFrame:
    """lines: file, is_code. Code lines of each top folder (a file at the top is its own), largest first."""
    return lines.where("is_code").groupBy(F.split_part("file", F.lit("/"), F.lit(1)).alias("package")).agg(F.count(F.lit(1)).alias("sloc")).orderBy(F.desc("sloc"), "package")


def text_rows(pairs: DataFrame) -> DataFrame:
    """One console line per pair."""
    end = lambda k: F.format_string("%s:%d-%d %s", f"file{k}", f"start{k}", f"end{k}", f"name{k}")
    return pairs.select(F.format_string("%5.1f%%  %s  ~  %s", F.col("sim") * 100, end(1), end(2)).alias("line"))


def _escaped(column) -> Column:
    out = F.col(column).cast("string")
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(plain), F.lit(entity))
    return out


def html_cards(pairs: DataFrame) -> DataFrame:
    """One HTML card per pair; every text is escaped."""
    end = lambda k: F.format_string("<code>%s:%d-%d</code> %s", _escaped(f"file{k}"), f"start{k}", f"end{k}", _escaped(f"name{k}"))
    return pairs.select(F.format_string('<div class="pair"><b>%.1f%%</b> %s ~ %s</div>', F.col("sim") * 100, end(1), end(2)).alias("card"))


_PAGE = """<!doctype html><meta charset="utf-8"><title>Duplicates</title>
<style>body{font-family:sans-serif;margin:2em}.pair{border:1px solid #ccc;padding:.5em;margin:.3em 0}</style>
<h1>Duplicates</h1><p>SLOC %d, duplicated lines %d, duplication %.2f%%, grade %s</p>
<input placeholder="filter" oninput="for(const p of document.querySelectorAll('.pair'))p.hidden=!p.textContent.includes(this.value)">
"""


def write_html(pairs: DataFrame, stats: DataFrame, path: str) -> None:
    """A page with the figures of dry_stats() and a card per pair. Cards arrive partition by partition."""
    s = stats.first()
    with open(path, "w", encoding="utf-8") as out:
        out.write(_PAGE % (s.sloc, s.dloc, s.pct, s.grade))
        for row in html_cards(pairs).toLocalIterator():
            out.write(row.card + "\n")


def sarif_document(pairs: DataFrame) -> str:
    """The whole SARIF 2.1.0 text. Results are built in the JVM and arrive partition by partition."""
    results = ",".join(r.result for r in sarif_rows(pairs).toLocalIterator())
    return '{"version":"2.1.0","$schema":"https://json.schemastore.org/sarif-2.1.0.json","runs":[{"tool":{"driver":{"name":"twinsift","rules":[{"id":"code-clone"}]}},"results":[' + results + "]}]}"


def json_document(pairs: DataFrame, target: str, threshold: float, stats: DataFrame | None = None) -> str:
    head = {"target": target, "threshold": threshold} | ({"stats": stats.first().asDict()} if stats is not None else {})
    return json.dumps(head)[:-1] + ', "clones": [' + ",".join(r.json for r in json_rows(pairs).toLocalIterator()) + "]}"
