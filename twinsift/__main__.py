"""python -m twinsift scan FOLDER | init FOLDER"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import reports, scan
from .sources import code, settings

FORMATS = ("text", "json", "sarif", "github", "markdown", "html")


def render(pairs: DataFrame, files: DataFrame, form: str, target: str, threshold: float) -> str:
    if form == "json":
        return reports.json_document(pairs, target, threshold, scan.stats(files, pairs))
    if form == "sarif":
        return reports.sarif_document(pairs)
    if form == "markdown":
        return reports.markdown(scan.stats(files, pairs)).first().markdown
    rows = reports.annotations(pairs) if form == "github" else reports.text_rows(pairs)
    return "\n".join(r.line for r in rows.toLocalIterator())


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="twinsift")
    p.add_argument("command", choices=("scan", "init"))
    p.add_argument("folder")
    p.add_argument("--config")
    p.add_argument("--threshold", type=float)
    p.add_argument("--min-lines", type=int)
    p.add_argument("--min-tokens", type=int)
    p.add_argument("--metric", choices=scan.METRICS, default="shingles")
    p.add_argument("--sort", choices=("similarity", "priority", "sloc"), default="similarity")
    p.add_argument("--top", type=int)
    p.add_argument("--blind", action="store_true")
    p.add_argument("--idioms", action="store_true")
    p.add_argument("--format", choices=FORMATS, default="text")
    p.add_argument("--output")
    p.add_argument("--fail", action="store_true", help="exit code 1 if there are pairs")
    a = p.parse_args(argv)
    if a.command == "init":
        print(settings.init_settings(a.folder))
        return 0
    known = settings.load_settings(a.folder, a.config)
    pick = lambda name: getattr(a, name) if getattr(a, name) is not None else known[name]
    spark = SparkSession.builder.appName("twinsift").getOrCreate()
    files = code.read_sources(spark, a.folder, tuple(known["exclude"]), "*.{py,ipynb}" if known["notebooks"] else "*.py")
    files = files.withColumn("file", F.regexp_replace("file", "^file:/+", "/")).persist()
    found = scan.scan(files, pick("threshold"), a.metric, min_lines=pick("min_lines"), min_tokens=pick("min_tokens"), blind=a.blind, idioms=a.idioms)
    pairs = scan.ranked(found, a.sort, a.top).persist()
    if a.format == "html":
        reports.write_html(pairs, scan.stats(files, pairs), a.output or "report.html")
    else:
        text = render(pairs, files, a.format, a.folder, pick("threshold"))
        if a.output:
            Path(a.output).parent.mkdir(parents=True, exist_ok=True)
            Path(a.output).write_text(text + "\n", encoding="utf-8")
        else:
            print(text)
    return int(a.fail and not pairs.isEmpty())


if __name__ == "__main__":
    sys.exit(main())
