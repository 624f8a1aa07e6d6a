"""Substring deduplication with repeated-phrase automata.

1. Every window has a minimizer, the smallest hash of the short word runs in it; equal windows have equal
   minimizers. Neighbouring windows with one minimizer are a segment. Only segments whose minimizer stands in two
   documents are kept: no other window can recur.
2. Confirming: equal segments are aggregated (smallest and largest document), dealt to shards by minimizer, and
   their windows compared. Neighbouring windows that recur are a passage; its first document is known. A window's
   segments all lie in one shard, so a shard knows all there is to know about its windows.
3. Locating: a shard's passages are compiled into one Aho-Corasick automaton, and the segments of all
   documents that were dealt to the shard are streamed through it. An occurrence in a document after the
   passage's first one is removed. Shards with many segments are split, each split with the same automaton.
4. The occurrences of a document are joined to its text, and the words that they cover are cut out.

A minimizer with very many different segments (the edges of a common passage) is dealt out by window instead.
The automaton compares bytes, not hashes, so nothing is removed on a collision.

Null and empty texts have no words; texts shorter than a window lose nothing; long texts are read whole; rows
that repeat a key count as one document, each with its own row; a null key counts as the largest; ties cannot
arise, as documents without a smaller key keep their words; an empty table gives no rows. Columns other than key
and text are not read, so their names do not matter. Keys of any type that can be sorted are kept as they are.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Keys, Words, bounded_batches, bytes_of, drop_written, grams, join_hot, mixed, written

WINDOW = 13
RUN = 4
#: Segments of one shard on average, and of one split of a shard at most (about).
SHARD_ROWS, SPLIT_ROWS = 50_000, 100_000
#: Different segments of one minimizer before they are cut to windows.
HOT_TEXTS = 2000
_NO_ID = (1 << 63) - 1


def window_minimizers(words: np.ndarray, window: int = WINDOW, run: int = RUN) -> np.ndarray:
    """For each window of words, the smallest hash of its runs."""
    h = grams(words, run)
    size = len(words) - window + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    out = h[:size].copy()
    for k in range(1, window - run + 1):
        np.minimum(out, h[k : k + size], out=out)
    return out


def _inside(sizes: np.ndarray, window: int) -> np.ndarray:
    """The text that each whole window lies in, of texts of these sizes in a row; -1 if it spans two."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    n = max(0, len(owner) - window + 1)
    return np.where(owner[:n] == owner[len(owner) - n :], owner[:n], -1)


def _heads(inside: np.ndarray, *values: np.ndarray) -> np.ndarray:
    """Where a run of neighbours with equal values begins."""
    if not len(inside):
        return np.zeros(0, np.int64)
    new = inside[1:] != inside[:-1]
    for v in values:
        new = new | (v[1:] != v[:-1])
    return np.flatnonzero(np.r_[True, new])


def _minimizers(docs: DataFrame, window: int, run_words: int) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            words = Words(bytes_of(batch.column(1)))
            inside = _inside(words.sizes, window)
            h = window_minimizers(words.hashes, window, run_words)
            new = _heads(inside, h)
            new = new[inside[new] >= 0]
            at = pa.array(inside[new])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(2).take(at), pa.array(h[new].view(np.int64))], names=["id", "version", "h"])

    return docs.mapInArrow(run, "id bigint, version bigint, h bigint")


def _of_text(h: np.ndarray, text: np.ndarray) -> np.ndarray:
    return mixed(h + text.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def _segments(met: DataFrame, window: int, run_words: int) -> DataFrame:
    """met: id, text, version, marks (the minimizers that recur)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            words = Words(bytes_of(batch.column(1)))
            inside = _inside(words.sizes, window)
            h = window_minimizers(words.hashes, window, run_words)
            marks = batch.column(3)
            bounds = marks.offsets.to_numpy()
            bounds = bounds - bounds[0]
            flat = marks.flatten().to_numpy().view(np.uint64)
            new = _heads(inside, h)
            ends = np.append(new[1:], len(inside))  # after the last window of the run
            ok = inside[new] >= 0
            new, ends = new[ok], ends[ok]
            # a mark is one of its own document: both are named by one number
            whose = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
            keep = np.isin(_of_text(h[new], inside[new]), _of_text(flat[bounds[0] : bounds[-1]], whose))
            new, ends = new[keep], ends[keep]
            owner = inside[new]
            first = new - (np.cumsum(words.sizes) - words.sizes)[owner]
            places = zip(words.starts[new].tolist(), words.ends[ends + window - 2].tolist(), strict=True)
            cut = [words.line[x:y] for x, y in places]
            whose = pa.array(owner)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(whose), batch.column(2).take(whose), pa.array(first.astype(np.int32)), pa.array(h[new].view(np.int64)), pa.array(cut, pa.binary())],
                names=["id", "version", "start", "h", "words"],
            )

    return met.mapInArrow(run, "id bigint, version bigint, start int, h bigint, words binary")


def _cut_to_windows(segments: DataFrame, window: int) -> DataFrame:
    """Each window of each segment as a segment of its own, under its own hash."""

    def run(batches):
        import pyarrow as pa
        import xxhash

        for batch in batches:
            whose, starts, names, out = [], [], [], []
            for k, (start, raw) in enumerate(zip(batch.column(2).to_pylist(), batch.column(4).to_pylist(), strict=True)):
                words = raw.split(b" ")
                for at in range(len(words) - window + 1):
                    piece = b" ".join(words[at : at + window])
                    whose.append(k)
                    starts.append(start + at)
                    names.append(xxhash.xxh64_intdigest(piece, 1) - (1 << 63))
                    out.append(piece)
            at = pa.array(whose, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(starts, pa.int32()), pa.array(names, pa.int64()), pa.array(out, pa.binary())], names=["id", "version", "start", "h", "words"])

    return segments.mapInArrow(run, "id bigint, version bigint, start int, h bigint, words binary")


def confirmed_passages(segments: list[bytes], lo: np.ndarray, hi: np.ndarray, window: int = WINDOW) -> dict[bytes, int]:
    """Passages of different segments (lo, hi: smallest and largest document of each): words to first document.

    Windows recur if they stand in two documents. Neighbouring ones of a segment are one passage if the same
    documents lose them: those after the segment's own first, or all that have the segment.
    """
    words = Words(segments)
    inside = _inside(words.sizes, window)
    at = np.flatnonzero(inside >= 0)
    if not len(at):
        return {}
    owner = inside[at]
    a, b = grams(words.hashes, window, 1)[at], grams(words.hashes, window, 2)[at]
    order = np.lexsort((b, a))
    new = _heads(a[order], b[order])
    size = np.diff(np.append(new, len(order)))
    first, last = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
    first[order] = np.repeat(np.minimum.reduceat(lo[owner][order], new), size)
    last[order] = np.repeat(np.maximum.reduceat(hi[owner][order], new), size)
    recurs = first < last
    kind = np.where(recurs, 1 + (first < lo[owner]), 0)
    heads = _heads(owner, kind)
    ends = np.append(heads[1:], len(at))
    latest = np.maximum.reduceat(first, heads)
    keep = kind[heads] > 0
    places = zip(words.starts[at[heads[keep]]].tolist(), words.ends[at[ends[keep] - 1] + window - 1].tolist(), strict=True)
    return dict(zip([words.line[x:y] for x, y in places], latest[keep].tolist(), strict=True))


class PassageAutomaton:
    """Aho-Corasick automaton of passages, each with a blank before and after it."""

    def __init__(self, passages: list[bytes]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        self.sizes = np.fromiter((p.count(b" ") + 1 for p in passages), np.int64, len(passages))
        for k, p in enumerate(passages):
            self.automaton.add_word(f" {p.decode('latin-1')} ", k)
        if passages:
            self.automaton.make_automaton()

    def occurrences(self, segments: list[bytes]):
        """(segment, first word, after last word, passage) of all occurrences, by segment and first word."""
        none = np.zeros(0, np.int64)
        if not len(self.sizes) or not segments:
            return none, none, none, none
        # two blanks, which no passage has, stand between segments
        line = b" " + b"  ".join(segments) + b" "
        found = np.fromiter(itertools.chain.from_iterable(self.automaton.iter(line.decode("latin-1"))), np.int64)
        end, k = found[::2], found[1::2]
        blanks = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
        bounds = np.cumsum([0, *(s.count(b" ") + 2 for s in segments)])  # of blanks
        after = np.searchsorted(blanks, end)
        first = after - self.sizes[k]
        order = np.argsort(first, kind="stable")
        after, k, first = after[order], k[order], first[order]
        seg = np.searchsorted(bounds, first, "right") - 1
        return seg, first - bounds[seg], after - bounds[seg], k


def removed_ranges(passages: list[bytes], firsts: np.ndarray, segments: list[bytes], place: np.ndarray, ids: np.ndarray):
    """passages and their first documents; different segments; the segment and the document of each row.

    (row, first word, after last word) of the merged occurrences in rows whose document is after the passage's first.
    """
    seg, a, b, k = PassageAutomaton(passages).occurrences(segments)
    edge = np.searchsorted(seg, np.arange(len(segments) + 1))
    count = np.diff(edge)[place]
    row = np.repeat(np.arange(len(place)), count)
    hit = np.arange(len(row)) + np.repeat(edge[place] - (np.cumsum(count) - count), count)
    late = firsts[k[hit]] < ids[row]
    row, a, b = row[late], a[hit[late]], b[hit[late]]
    if not len(row):
        return row, a, b
    shift = row * (int(b.max()) + 1)  # so that rows follow each other
    reach = np.maximum.accumulate(b + shift)
    new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | ((a + shift)[1:] > reach[:-1])])
    return row[new], a[new], (reach - shift)[np.append(new[1:], len(row)) - 1]


def _confirm(window: int):
    def run(keys, frame):
        import pandas as pd

        found = confirmed_passages(frame["words"].tolist(), frame["lo"].to_numpy(), frame["hi"].to_numpy(), window)
        return pd.DataFrame({"shard": np.full(len(found), keys[0], np.int64), "id": np.fromiter(found.values(), np.int64, len(found)), "words": list(found)})

    return run


def _locate(batches):
    """Rows shard, split, kind, id, version, start, words, sorted: the passages (kind 0) of a split, then its segments."""
    import pyarrow as pa

    def located(held):
        kinds = np.concatenate([x.column(2).to_numpy() for x in held])
        ids, versions, starts = (np.concatenate([x.column(k).to_numpy() for x in held]) for k in (3, 4, 5))
        words = pa.chunked_array([x.column(6) for x in held]).combine_chunks()
        n = int((kinds == 0).sum())
        equal = words.slice(n).dictionary_encode()
        row, a, b = removed_ranges(words.slice(0, n).to_pylist(), ids[:n], equal.dictionary.to_pylist(), equal.indices.to_numpy(), ids[n:])
        at = starts[n:][row].astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[n:][row], versions[n:][row], at + a, at + b)], names=["id", "version", "first", "stop"])

    held, group = [], None
    for batch in batches:
        shards, splits = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        heads = _heads(shards, splits).tolist()
        for a, b in zip(heads, [*heads[1:], len(shards)], strict=True):
            here = (shards[a], splits[a])
            if held and here != group:
                yield located(held)
                held = []
            group = here
            held.append(batch.slice(a, b - a))
    if held:
        yield located(held)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per row of docs: key, n_words, n_removed, kept_sha256 (of the kept words joined by one blank), removed (ranges of words). docs is read three times, so it should be a stored table."""
    spark = docs.sparkSession
    run_words = min(RUN, window)
    keys = Keys(docs, key)
    # rows of one key with other texts are told apart by a hash of the text; without such keys it is 0 everywhere
    alone = docs.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    version = F.lit(0).cast("bigint") if alone else F.xxhash64(text)
    chosen = keys.select(docs, F.col(text).cast("string").alias("text"), version.alias("version"))
    chosen = chosen.withColumn("id", F.coalesce("id", F.lit(_NO_ID)))
    marks = written(_minimizers(chosen, window, run_words), "phrase-minimizers")
    recurring = marks.groupBy("h").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi").select("h", "n")
    recurring = written(recurring, "phrase-recurring")
    shared = join_hot(marks, recurring, "h", marks.count()).groupBy("id", "version").agg(F.collect_set("h").alias("marks"))
    shared = written(shared, "phrase-shared")
    drop_written(marks)
    drop_written(recurring)
    met = chosen.join(shared.hint("merge"), ["id", "version"]).select("id", "text", "version", "marks")
    segments = written(_segments(met, window, run_words), "phrase-segments")
    drop_written(shared)

    equal = segments.groupBy("h", "words").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    equal = written(equal, "phrase-equal")
    hot = written(equal.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT_TEXTS).select("h"), "phrase-hot")
    if not hot.isEmpty():
        single = written(_cut_to_windows(segments.join(hot, "h", "left_semi").select(*segments.columns), window), "phrase-single")
        parts = (segments.join(hot, "h", "left_anti").select(*segments.columns).unionByName(single))
        equal_parts = written(equal.join(hot, "h", "left_anti").unionByName(single.groupBy("h", "words").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))), "phrase-equal")
        drop_written(equal)
        equal = equal_parts
    else:
        single, parts = None, segments
    shards = max(8, -(-segments.count() // SHARD_ROWS))
    shard = F.pmod(F.xxhash64("h"), F.lit(shards)).alias("shard")
    passages = written(equal.select(shard, "words", "lo", "hi").groupBy("shard").applyInPandas(_confirm(window), "shard bigint, id bigint, words binary"), "phrase-passages")
    drop_written(equal)
    # one row per shard, of which there are few: a count of rows cut by SHARD_ROWS
    splits = F.broadcast(parts.select(shard).groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / F.lit(SPLIT_ROWS)).alias("splits")))
    whole = parts.withColumn("shard", shard).join(splits, "shard")
    rows = whole.select("shard", F.pmod(F.xxhash64("id", "start"), "splits").alias("split"), F.lit(1).alias("kind"), "id", "version", "start", "words")
    split = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("splits") - 1)).alias("split")
    heads = passages.join(splits, "shard").select("shard", split, F.lit(0).alias("kind"), "id", F.lit(0).cast("bigint").alias("version"), F.lit(0).alias("start"), "words")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(shards, 100_000))
    dealt = heads.unionByName(rows).repartition(tasks, "shard", "split").sortWithinPartitions("shard", "split", "kind")
    located = dealt.mapInArrow(_locate, "id bigint, version bigint, first bigint, stop bigint")
    found = written(located.groupBy("id", "version").agg(F.collect_list(F.struct("first", "stop")).alias("found")), "phrase-found")
    for x in (segments, passages, hot, *([single] if single is not None else [])):
        drop_written(x)

    def cut(batches):
        import pyarrow as pa

        span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        for batch in batches:
            n_words, n_removed, shas, removed = [], [], [], []
            for raw, found in zip(bytes_of(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                words, ranges = raw.split(), []  # runs without the six ASCII white-space characters
                for a, b in sorted((x["first"], x["stop"]) for x in found or ()):
                    if ranges and a <= ranges[-1][1]:
                        ranges[-1][1] = max(b, ranges[-1][1])
                    else:
                        ranges.append([a, b])
                kept, at = [], 0
                for a, b in ranges:
                    kept += words[at:a]
                    at = b
                kept += words[at:]
                n_words.append(len(words))
                n_removed.append(len(words) - len(kept))
                shas.append(hashlib.sha256(b" ".join(kept)).hexdigest())
                removed.append([{"start": a, "stop": b} for a, b in ranges])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(shas, pa.string()), pa.array(removed, span)],
                names=["id", "n_words", "n_removed", "kept_sha256", "removed"],
            )

    with_found = chosen.join(found.hint("merge"), ["id", "version"], "left").select("id", "text", "found")
    out = with_found.mapInArrow(cut, "id bigint, n_words bigint, n_removed bigint, kept_sha256 string, removed array<struct<start:bigint,stop:bigint>>")
    out = out.withColumn("id", F.when(F.col("id") != _NO_ID, F.col("id")))
    with bounded_batches(spark):
        out = written(keys.restore(out, {"id": key}), "phrase-out")
    drop_written(found)
    keys.drop()
    return out
