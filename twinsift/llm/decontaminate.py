"""Benchmark decontamination with one Aho-Corasick automaton over the windows of all test items.

Texts are folded (A-Z to a-z, all ASCII but letters and digits to blanks) and their words joined by one
blank. The automaton scans that string once; a hit's end gives word numbers, and these give offsets in the
text as it was. Windows are `` w1 w2 ... wn ``, with blanks at both ends, so hits are whole words.

Null and empty texts have no words and no hits; items without words have no window; an empty benchmark hits
nothing; an empty table gives no rows. Very long texts are scanned whole. Each row of a repeated key is judged
alike; keys of any type, null too, are kept as they are. Ties: overlapping hits cover their words once. Columns
other than key and text are kept (or, in a report, not read), so their names do not matter.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FOLD, bytes_of, drop_written, frugal, slices, written

WINDOW = 10
#: Bytes of windows in one automaton (about 60 bytes of memory each); more are dealt over several automata.
AUTOMATON_BYTES = 4_000_000
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def benchmark_windows(benchmark: DataFrame, key: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Distinct (pattern, item) rows; the item is its id as a string."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            patterns, items = [], []
            for item, raw in zip(batch.column(0).to_pylist(), bytes_of(batch.column(1)), strict=True):
                words = raw.translate(FOLD).split()
                for k in range(max(1, len(words) - window + 1) if words else 0):
                    patterns.append(b" " + b" ".join(words[k : k + window]) + b" ")
                    items.append(item)
            yield pa.RecordBatch.from_arrays([pa.array(patterns, pa.binary()), pa.array(items, pa.string())], names=["pattern", "item"])

    return benchmark.select(F.col(key).cast("string"), text).mapInArrow(frugal(run), "pattern binary, item string").distinct()


class WindowAutomaton:
    def __init__(self, rows: list[tuple[bytes, list[str]]]):
        import ahocorasick

        self.items = [items for _, items in rows]
        self.sizes = [p.count(b" ") - 1 for p, _ in rows]
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for k, (p, _) in enumerate(rows):
            self.automaton.add_word(bytes(p).decode("latin-1"), k)
        if rows:
            self.automaton.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """((first, after last) word of each hit, items hit)."""
        if not self.items or not words:
            return [], set()
        line = b" " + b" ".join(words) + b" "
        found = list(self.automaton.iter(line.decode("latin-1")))
        if not found:
            return [], set()
        blanks = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
        ends = np.searchsorted(blanks, [e for e, _ in found]).tolist()
        return [(e - self.sizes[k], e) for e, (_, k) in zip(ends, found, strict=True)], {i for _, k in found for i in self.items[k]}


def merge_ranges(ranges) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def spans_of(raw: bytes, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Character offsets in the original text of ranges of words."""
    places = [(m.start(), m.end()) for m in _WORD.finditer(raw)]
    chars = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
    return [(int(chars[places[a][0]]) - 1, int(chars[places[b - 1][1] - 1])) for a, b in ranges]


def _stored_windows(benchmark: DataFrame, key: str, text: str, window: int, automaton_bytes: int) -> tuple[DataFrame, int]:
    """The windows, as a stored table, and the number of automata that hold them."""
    windows = written(benchmark_windows(benchmark, key, text, window), "windows")
    size = windows.agg(F.sum(F.length("pattern"))).first()[0] or 0
    return windows, max(1, -(-size // automaton_bytes))


def _shard(windows: DataFrame, shard: int, shards: int):
    """Broadcast of one automaton's (pattern, items): automaton_bytes of patterns, dealt evenly by hash."""
    mine = windows.where(F.pmod(F.xxhash64("pattern"), F.lit(shards)) == shard)
    rows = mine.groupBy("pattern").agg(F.sort_array(F.collect_set("item")).alias("items")).collect()
    return windows.sparkSession.sparkContext.broadcast([(bytes(r["pattern"]), list(r["items"])) for r in rows])


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", window: int = WINDOW, automaton_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """One row per row of docs: key, n_words, n_hit (words in any hit), items (sorted strings), spans (character offsets of runs of hit words)."""
    windows, shards = _stored_windows(benchmark, item_key, item_text, window, automaton_bytes)
    id_type = docs.schema[key].dataType.simpleString()
    schema = f"key {id_type}, row bigint, n_words bigint, n_hit bigint, items array<string>, spans array<struct<start:bigint,stop:bigint>>"
    source = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    if shards > 1:  # the numbers of rows must be the same for each automaton
        source = written(source, "contamination-source")

    def scanned(shard: int) -> DataFrame:
        shared = _shard(windows, shard, shards)

        def run(batches):
            import pyarrow as pa

            automaton = WindowAutomaton(shared.value)
            span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            for batch in batches:
                n_words, n_hit, items, spans = [], [], [], []
                for raw in bytes_of(batch.column(1)):
                    words = raw.translate(FOLD).split()
                    hits, names = automaton.scan(words)
                    ranges = merge_ranges(hits)
                    n_words.append(len(words))
                    n_hit.append(sum(b - a for a, b in ranges))
                    items.append(sorted(names))
                    spans.append([{"start": a, "stop": b} for a, b in spans_of(raw, ranges)] if ranges else [])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(2), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(spans, span)],
                    names=["key", "row", "n_words", "n_hit", "items", "spans"],
                )

        return written(source.mapInArrow(run, schema), f"contamination{shard}")

    parts = [scanned(k) for k in range(shards)]
    drop_written(windows)
    if shards == 1:
        return parts[0].drop("row").withColumnRenamed("key", key)
    # several automata: the first one's rows carry the hits of the others
    hit = parts[0]
    for p in parts[1:]:
        other = p.where("n_hit > 0").select("row", F.col("items").alias("i2"), F.col("spans").alias("s2"))
        hit = hit.join(other, "row", "left").select(
            "key", "row", "n_words", "n_hit",
            F.array_sort(F.array_union("items", F.coalesce("i2", F.array().cast("array<string>")))).alias("items"),
            F.concat("spans", F.coalesce("s2", F.expr("cast(array() as array<struct<start:bigint,stop:bigint>>)"))).alias("spans"),
        )

    def unite(batches):
        import pyarrow as pa

        for batch in batches:
            rows = batch.to_pylist()
            for r, raw in zip(rows, bytes_of(batch.column(batch.num_columns - 1)), strict=True):
                r["spans"] = [{"start": a, "stop": b} for a, b in merge_ranges((s["start"], s["stop"]) for s in r["spans"])]
                text_ = raw.decode("utf-8")
                r["n_hit"] = sum(len(text_[s["start"] : s["stop"]].encode().translate(FOLD).split()) for s in r["spans"])
                del r["text"]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([f for f in batch.schema if f.name != "text"]))

    again = source.select("row", "text").join(hit, "row").select("key", "row", "n_words", "n_hit", "items", "spans", "text")
    out = written(again.mapInArrow(unite, schema), "contamination")
    for x in (source, *parts):
        drop_written(x)
    return out.drop("row").withColumnRenamed("key", key)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", window: int = WINDOW, automaton_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """Rows whose text no window hits, with all their columns.

    Decided row by row while the texts are scanned, so nothing is shuffled. With several automata, each scans
    what those before it kept, from a stored table.
    """
    windows, shards = _stored_windows(benchmark, item_key, item_text, window, automaton_bytes)
    at = docs.columns.index(text)

    def clean(shard: int, rows: DataFrame) -> DataFrame:
        shared = _shard(windows, shard, shards)

        def run(batches):
            import pyarrow as pa

            automaton = WindowAutomaton(shared.value)
            for batch in itertools.chain.from_iterable(slices(b, at) for b in batches):
                stays = [not automaton.scan(raw.translate(FOLD).split())[0] for raw in bytes_of(batch.column(at))]
                yield batch.filter(pa.array(stays, pa.bool_()))

        return rows.mapInArrow(frugal(run), docs.schema)

    out = docs
    for shard in range(shards):
        kept = clean(shard, out)
        out = written(kept, f"clean{shard}") if shard < shards - 1 else kept
    drop_written(windows)
    return out
