"""Interpolated modified Kneser-Ney trigram model: counted in Spark, kept as sorted hash arrays that workers map.

1. Each task counts its trigrams u v w and sends them on as arrays, to shards by the middle word. The trigrams of
   very frequent middle words are dealt over all shards, by first word.
2. A shard sums its trigrams into sorted files of 64-bit hashes and counts: of trigrams, and of their contexts
   u v. It also knows the different u before each pair v w: numbers of left contexts, which are the counts of the
   pairs. Those of very frequent v are summed in a second step, dealt by w; all others are written at once.
3. Word shards sum what the pairs say of words: counts, left contexts, and what follows them.
4. Workers map the files and look up whole batches by binary search. Keys of trigrams, contexts and pairs are kept
   whole in six bytes and a bucket, their counts in four bits and a list of the rare ones.

p(w | u v) = max(c(uvw) - D, 0) / c(uv) + g(uv) p(w | v); p(w | v) likewise from numbers of left contexts (after
the start of a text, where there is only one, from counts); p(w) likewise, and then the uniform 1 / (V + 1).
All counts are kept, and all discounts come from counts of counts. train(prune=True) makes a smaller model: trigrams
seen once are cut off, their discount is 1, so their mass goes to p(w | v) and probabilities still sum to one. They
still count as such in c(uv) and in the numbers of left contexts. Pairs and words are never cut off.

Every text is its words (runs without white space, A-Z lowered) and one end. Null, empty and blank texts are the
end alone. Very long texts are counted whole. Repeated rows and keys count and are scored each. With no training
rows every probability is the uniform one; an empty table gives no scores. Clashing names: only the columns of
keep and the text are read. Ties do not arise, but among the commonest words, where the hash decides.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, Words, bytes_of, drop_written, fresh_names, fresh_path, local_path, mixed, open_store, put_file, written

END, BEGIN = np.uint64(0x9D5F3A1E00000001), np.uint64(0x9D5F3A1E00000002)
#: Tokens whose trigrams a task counts before it sends them on.
HELD = 4_000_000
#: Tokens that a scoring task looks up at once, but for a longer text.
SLICE = 1_200_000
#: Words that are dealt over all shards: the commonest of a sample, the first rows of each partition, so many in all
#: but one a partition at least (for balance only; counts are exact).
SAMPLE_ROWS, COMMON_WORDS = 2000, 256
#: Words of that sample, the commonest, that tasks name by two bytes when they send trigrams on.
KNOWN_WORDS = 1 << 16
#: Tokens whose hashes are computed at once.
PIECE = 1 << 19
#: Different columns of counts that four bits name in a file; the others are listed.
NAMED = 15


def _pair(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mixed(v * np.uint64(0x9E3779B97F4A7C15) + w)


def _spot(h: np.ndarray, n: int) -> np.ndarray:
    """Shard by the high bits."""
    return ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _shard(v: np.ndarray, other: np.ndarray, common: np.ndarray, n: int) -> np.ndarray:
    """Of the word v; of v and the other word where v is common."""
    salt = np.where(np.isin(v, common), other % np.uint64(n) + np.uint64(1), np.uint64(0))
    return _spot(mixed(v + salt * np.uint64(0xC2B2AE3D27D4EB4F)), n)


def _summed(keys: np.ndarray, *values: np.ndarray):
    """Distinct keys, sorted, the place of a row of each, and the sums of their values."""
    order = np.argsort(keys)
    k = keys[order]
    at = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
    return k[at], order[at], [np.add.reduceat(v[order], at) if len(at) else v[:0] for v in values]


def _tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each text and its end, all texts in a row; tokens of each text."""
    words = Words([t.translate(LOWER) for t in texts])
    return np.insert(words.hashes, np.cumsum(words.sizes), END), words.sizes + 1


def _before(w: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two tokens before those at the places at; a text begins after an end."""
    v = np.where(at > 0, w[at - 1], END)
    v[v == END] = BEGIN
    u = np.where((at > 1) & (v != BEGIN), w[at - 2], END)
    u[u == END] = BEGIN
    return u, v


def _distinct(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct trigram among the tokens w, and its count. Holds four numbers a token at most."""
    key = np.empty(len(w), np.uint64)
    for a in range(0, len(w), PIECE):
        at = np.arange(a, min(a + PIECE, len(w)))
        u, v = _before(w, at)
        key[at] = _pair(_pair(u, v), w[at])
    order = np.argsort(key)
    key = key[order]
    at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    del key
    return order[at], np.diff(at, append=len(w)).astype(np.int32)


def _release() -> None:
    """Give freed memory back to the system: Python workers outlive their tasks."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only in the GNU library
    if trim:
        trim(0)


def _arrays(*arrays: np.ndarray, steps: tuple[int, ...] = (0,)) -> bytes:
    """Arrays one after the other, led by their lengths, types and sizes; those at steps are kept as differences. Bytes of one rank stand together, compressed."""
    import pyarrow as pa

    head, out = [], []
    for k, a in enumerate(arrays):
        if k in steps:
            a = np.diff(a, prepend=a.dtype.type(0))
        planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes()
        out.append(pa.compress(planes, codec="zstd", asbytes=True))
        head.append(f"{a.dtype.str},{len(a)},{len(out[-1])},{int(k in steps)}")
    top = ";".join(head).encode()
    return b"".join([len(top).to_bytes(4, "little"), top, *out])


def _unarrays(data: bytes) -> list[np.ndarray]:
    import pyarrow as pa

    n = int.from_bytes(data[:4], "little")
    at, out = 4 + n, []
    for kind, size, packed, steps in (x.split(",") for x in data[4 : 4 + n].decode().split(";")):
        kind, size, packed = np.dtype(kind), int(size), int(packed)
        raw = pa.decompress(data[at : at + packed], decompressed_size=size * kind.itemsize, codec="zstd", asbytes=True) if size else b""
        a = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(kind.itemsize, size).T).view(kind).reshape(size)
        out.append(np.cumsum(a, dtype=kind) if steps == "1" else a)
        at += packed
    return out


def _small(a: np.ndarray) -> np.ndarray:
    """As the smallest unsigned type that holds all values."""
    return a.astype(np.min_scalar_type(int(a.max(initial=0))))


def _put_counts(uri: str, name: str, keys: np.ndarray, counts: np.ndarray, kind) -> None:
    """Sorted keys, their counts (rows) of a small type, and the whole counts of the keys that do not fit it."""
    top = np.iinfo(kind).max
    odd = np.flatnonzero((counts >= top).any(0))
    put_file(uri, name, keys.tobytes())
    put_file(uri, name + "-c", np.minimum(counts, top).astype(kind).tobytes())
    put_file(uri, name + "-o", _arrays(odd, counts[:, odd].ravel()))


def _put_packed(uri: str, name: str, keys: np.ndarray, counts: np.ndarray) -> None:
    """Sorted keys and the counts (rows) of each, whole, in six and a half bytes a key and what is rare.

    A key's first two bytes are its bucket, whose size is kept; the other six are four and two. Four bits name one of the
    commonest columns of counts, or say that the key's own is listed.
    """
    sizes = _small(np.bincount((keys >> np.uint64(48)).astype(np.int64), minlength=1 << 16))
    columns, where, often = np.unique(_columns(counts), return_inverse=True, return_counts=True)
    top = np.argsort(-often, kind="stable")[:NAMED]
    number = np.full(len(columns), NAMED, np.uint8)
    number[top] = np.arange(len(top))
    code = number[where]
    example = np.full(len(columns), -1)
    example[where] = np.arange(len(keys))
    odd = np.flatnonzero(code == NAMED)
    halves = np.append(code, np.zeros(len(code) % 2, np.uint8)).reshape(-1, 2)
    head = np.array([len(keys), sizes.dtype.itemsize], np.int64)
    low = keys & np.uint64((1 << 48) - 1)
    put_file(uri, name, b"".join(x.tobytes() for x in (head, (low >> np.uint64(16)).astype(np.uint32), low.astype(np.uint16), sizes, halves[:, 0] | halves[:, 1] << 4)))
    put_file(uri, name + "-o", _arrays(odd, *map(_small, counts[:, example[top]]), *map(_small, counts[:, odd])))


def _columns(counts: np.ndarray) -> np.ndarray:
    """A number for each column, the same for equal columns of small numbers. One with a large number, which is rare, has a number of its own."""
    bits = 60 // len(counts)
    small = (counts < 1 << bits).all(0)
    out = np.arange(counts.shape[1], dtype=np.uint64) | np.uint64(1 << 63)
    line = np.zeros(int(small.sum()), np.uint64)
    for x in counts[:, small]:
        line = line << np.uint64(bits) | x.astype(np.uint64)
    out[small] = line
    return out


class Packed:
    """What _put_packed() wrote, as bytes (data) and a function for those of the list."""

    def __init__(self, data: np.ndarray, listed):
        self.n, width = data[:16].view(np.int64).tolist() if len(data) else (0, 1)
        n, at = self.n, 16
        self.high, at = data[at : at + 4 * n].view(np.uint32), at + 4 * n
        self.low, at = data[at : at + 2 * n].view(np.uint16), at + 2 * n
        self.sizes, at = data[at : at + (width << 16)].view(f"u{width}"), at + (width << 16)
        self.codes, self.listed = data[at:], listed

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key; -1 if it is not there."""
        if not self.n:
            return np.full(len(keys), -1)
        bucket = (keys >> np.uint64(48)).astype(np.int64)
        b = np.cumsum(self.sizes, dtype=np.int64)[bucket]
        a = b - self.sizes[bucket]
        end, high, low = b, (keys >> np.uint64(16)).astype(np.uint32), keys.astype(np.uint16)
        last = self.n - 1
        for _ in range(int((b - a).max(initial=0)).bit_length()):  # until a == b: the first whose four bytes are not smaller
            mid = (a + b) >> 1
            less = (self.high[np.minimum(mid, last)] < high) & (a < b)
            a, b = np.where(less, mid + 1, a), np.where(less, b, mid)
        out = np.full(len(keys), -1)
        ask = np.flatnonzero(a < end)
        while len(ask):  # one round, but for keys that share the four bytes
            at = a[ask]
            same = self.high[at] == high[ask]
            hit = same & (self.low[at] == low[ask])
            out[ask[hit]] = at[hit]
            ask = ask[same & ~hit]
            a[ask] += 1
            ask = ask[a[ask] < end[ask]]
        return out

    def counts(self, at: np.ndarray, rows: int) -> np.ndarray:
        """The column of each place."""
        odd, *values = self.listed()
        table = np.zeros((rows, NAMED + 1), np.int64)
        for k, x in enumerate(values[:rows]):
            table[k, : len(x)] = x
        code = self.codes[at >> 1] >> ((at & 1) * 4).astype(np.uint8) & 15
        out = table[:, code]
        big = np.flatnonzero(code == NAMED)
        if len(big):
            place = np.searchsorted(odd, at[big])
            for k, x in enumerate(values[rows:]):
                out[k, big] = x[place]
        return out


def _discounts(n: np.ndarray) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from how many keys have the counts 1, 2, 3 and 4."""
    n1, n2, n3, n4 = (float(x) for x in n)
    if min(n1, n2) <= 0:
        return (0.5, 0.5, 0.5)
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5)
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in enumerate(found, 1))


def _levels(c: np.ndarray) -> list[np.ndarray]:
    """Which counts are 1, 2, and more."""
    return [(c == 1).astype(np.int64), (c == 2).astype(np.int64), (c > 2).astype(np.int64)]


#: Whom a row of the counting steps is for: a word shard (0 and up), the totals of trigrams or pairs, or (below) a shard of pairs of common words.
_TRIGRAMS, _PAIRS, _COMMON = -1, -2, -3


def _for_words(kind: int, h: np.ndarray, sums: list[np.ndarray], n: int) -> list[tuple]:
    at = np.searchsorted(_spot(h, n), np.arange(n + 1))
    return [(k, _arrays(np.array([kind]), h[a:b], *(_small(x[a:b]) for x in sums), steps=(1,))) for k, (a, b) in enumerate(zip(at, at[1:], strict=False)) if b > a]


def _finish_pairs(uri: str, name: str, v: np.ndarray, w: np.ndarray, key: np.ndarray, left: np.ndarray, n: int, words=None) -> list[tuple]:
    """Write pairs (sorted by key) and their numbers of left contexts; rows for their words, with the counts of words (all w, sorted, and more) if they are given."""
    _put_packed(uri, name, key, left[None])
    rows = [(_PAIRS, _arrays(np.array([(left == k).sum() for k in (1, 2, 3, 4)])))]
    h, _, sums = _summed(w, np.ones(len(w), np.int64))
    if words is None:
        rows += _for_words(1, h, sums, n)
    else:
        names, count = words
        before = np.zeros(len(names), np.int64)
        before[np.searchsorted(names, h)] = sums[0]
        rows += _for_words(0, names, [count, before], n)
    h, _, sums = _summed(v, left, *_levels(left))
    return rows + _for_words(2, h, sums, n)


def train(docs: DataFrame, text: str = "text", shards: int | None = None, prune: bool = True) -> dict:
    """Count docs; returns what a scorer needs: the folder of the files, their numbers, and the totals. prune: without trigrams seen once."""
    spark = docs.sparkSession
    uri = fresh_path(spark, "ngram-lm")
    partitions = docs.rdd.getNumPartitions()
    n = shards or max(8, 2 * partitions)
    chosen = docs.select(F.col(text).cast("string").alias("text"))

    def words(batches):
        import pyarrow as pa

        for batch in batches:
            u, c = np.unique(_tokens(bytes_of(batch.column(0)))[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(c)], names=["h", "c"])

    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    sample = chosen.select("text", place.alias("place")).where(F.col("place") < max(1, SAMPLE_ROWS // max(1, partitions))).select("text")
    top = sample.mapInArrow(words, "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "h").limit(max(COMMON_WORDS, KNOWN_WORDS)).collect()
    top = np.array([r["h"] for r in top], np.int64).view(np.uint64)
    common = top[:COMMON_WORDS]
    ranked = np.sort(common)
    shared = spark.sparkContext.broadcast(np.sort(top[:KNOWN_WORDS]))

    def count(batches):
        import pyarrow as pa

        held, size = [], 0

        def out():
            w = np.concatenate(held)
            held.clear()
            names = np.append(np.unique(w), BEGIN)
            names.sort()
            familiar = np.isin(names, shared.value)
            moved = np.where(familiar, np.cumsum(familiar), familiar.sum() + np.cumsum(~familiar)).astype(np.uint32) - np.uint32(1)  # the known words come first
            first, c = _distinct(w)
            s = np.empty(len(first), np.uint32 if n > 65535 else np.uint16)
            places = [np.empty(len(first), np.uint32) for _ in range(3)]
            for a in range(0, len(first), PIECE):
                at = first[a : a + PIECE]
                u, v = _before(w, at)
                s[a : a + PIECE] = _shard(v, u, common, n)
                for place, x in zip(places, (u, v, w[at]), strict=True):
                    place[a : a + PIECE] = moved[np.searchsorted(names, x)]
            names = np.concatenate([names[familiar], names[~familiar]])
            n_known = int(familiar.sum())
            del w, first, moved, familiar
            order = np.argsort(s, kind="stable")
            ends = np.searchsorted(s[order], np.arange(n + 1))
            u, v, w = (x[order] for x in places)
            c = c[order]
            del s, order, places
            shards_, blobs = [], []
            for k in np.flatnonzero(np.diff(ends)).tolist():
                a, b = ends[k : k + 2]
                by = np.lexsort((u[a:b], v[a:b]))
                used = np.zeros(len(names), bool)
                for x in (u, v, w):
                    used[x[a:b]] = True
                place = np.cumsum(used) - 1
                lead, sizes = np.unique(v[a:b], return_counts=True)
                shards_.append(k)
                ranks = np.searchsorted(shared.value, names[:n_known][used[:n_known]])
                blobs.append(_arrays(names[n_known:][used[n_known:]], *(_small(x) for x in (ranks, place[lead], sizes, place[u[a:b][by]], place[w[a:b][by]], c[a:b][by])), steps=(0, 1, 2, 4)))
            return pa.RecordBatch.from_arrays([pa.array(shards_, pa.int64()), pa.array(blobs, pa.binary())], names=["shard", "blob"])

        for batch in batches:
            held.append(_tokens(bytes_of(batch.column(0)))[0])
            size += len(held[-1])
            if size >= HELD:
                yield out()
                held, size = [], 0
        if size:
            yield out()
        _release()

    def trigrams(keys, frame):
        import pandas as pd

        parts: list[list[np.ndarray]] = [[], [], [], []]
        for blob in frame["blob"]:
            names, ranks, lead, sizes, u, w, c = _unarrays(blob)
            names = np.concatenate([shared.value[ranks], names])
            for held, x in zip(parts, (names[u], np.repeat(names[lead], sizes), names[w], c.astype(np.int64)), strict=True):
                held.append(x)
        u, v, w, c = (np.concatenate(x) for x in parts)
        del parts
        key, first, (c,) = _summed(_pair(_pair(u, v), w), c)
        u, v, w = u[first], v[first], w[first]
        stored = c > int(prune)
        _put_packed(uri, f"three-{keys[0]:06d}", key[stored], c[None, stored])
        rows = [(_TRIGRAMS, _arrays(np.array([(c == k).sum() for k in (1, 2, 3, 4)])))]
        context, _, sums = _summed(_pair(u, v), c, *_levels(c))
        stored = sums[0] > int(prune) * sums[1]
        _put_packed(uri, f"context-{keys[0]:06d}", context[stored], np.array(sums)[:, stored])
        h, _, sums = _summed(w, c)
        pair, first, (left,) = _summed(_pair(v, w), np.where(v == BEGIN, c, 1))
        v, w = v[first], w[first]
        often = np.isin(v, common)
        rows += _finish_pairs(uri, f"two-{keys[0]:06d}", v[~often], w[~often], pair[~often], left[~often], n, (h, sums[0]))
        v, w, left = v[often], w[often], left[often]
        s = _shard(v, w, common, n)
        order = np.lexsort((w, s))
        ends = np.searchsorted(s[order], np.arange(n + 1))
        for k in np.flatnonzero(np.diff(ends)).tolist():
            at = order[ends[k] : ends[k + 1]]
            rows.append((_COMMON - k, _arrays(w[at], _small(np.searchsorted(ranked, v[at])), _small(left[at]))))
        del u, v, w, c, key, first, context, pair, left, sums, order, s
        _release()
        return pd.DataFrame(rows, columns=["shard", "blob"])

    def common_pairs(keys, frame):
        import pandas as pd

        w, v, left = (np.concatenate(x) for x in zip(*map(_unarrays, frame["blob"]), strict=True))
        v = ranked[v]
        pair, first, (left,) = _summed(_pair(v, w), left.astype(np.int64))
        return pd.DataFrame(_finish_pairs(uri, f"often-{_COMMON - keys[0]:06d}", v[first], w[first], pair, left, n), columns=["shard", "blob"])

    kind = "shard bigint, blob binary"
    parts = written(chosen.mapInArrow(count, kind).groupBy("shard").applyInPandas(trigrams, kind), "ngram-parts")
    more = written(parts.where(F.col("shard") <= _COMMON).groupBy("shard").applyInPandas(common_pairs, kind), "ngram-common")
    both = parts.unionByName(more)

    def vocabulary(keys, frame):
        import pandas as pd

        kinds: tuple[list, list, list] = ([], [], [])
        for blob in frame["blob"]:
            which, *arrays = _unarrays(blob)
            kinds[int(which[0])].append(arrays)
        columns = []
        for held, width in zip(kinds, (2, 1, 4), strict=True):
            h = np.concatenate([x[0] for x in held]) if held else np.zeros(0, np.uint64)
            sums = [np.concatenate([x[k].astype(np.int64) for x in held]) if held else np.zeros(0, np.int64) for k in range(1, width + 1)]
            h, _, sums = _summed(h, *sums)
            columns.append((h, sums))
        h = np.unique(np.concatenate([x[0] for x in columns]))
        full = np.zeros((6, len(h)), np.int64)  # count; left contexts; as a context: sum, and followers with 1, 2, 3+ left contexts
        for places, (have, sums) in zip(((0, 1), (1,), (2, 3, 4, 5)), columns, strict=True):
            for place, x in zip(places, sums, strict=True):
                full[place, np.searchsorted(h, have)] += x
        name = f"words-{keys[0]:06d}"
        _put_counts(uri, name, h, full, np.uint16)
        left = full[1]
        return pd.DataFrame([(int(full[0].sum()), int((full[0] > 0).sum()), int(left.sum()), *(int((left == k).sum()) for k in (1, 2, 3, 4)), int((left > 2).sum()))], columns=["n", "v", "left", "n1", "n2", "n3", "n4", "more"])

    kinds = "n bigint, v bigint, left bigint, n1 bigint, n2 bigint, n3 bigint, n4 bigint, more bigint"
    sums = both.where("shard >= 0").groupBy("shard").applyInPandas(vocabulary, kinds)
    totals = written(sums, "ngram-totals")
    total = totals.agg(*(F.sum(c).alias(c) for c in ("n", "v", "left", "n1", "n2", "n3", "n4", "more"))).first().asDict()
    seen = {_TRIGRAMS: np.zeros(4, np.int64), _PAIRS: np.zeros(4, np.int64)}  # one row of four numbers a shard
    for r in both.where(F.col("shard").isin(_TRIGRAMS, _PAIRS)).toLocalIterator():
        seen[r["shard"]] += _unarrays(bytes(r["blob"]))[0]
    for x in (parts, more, totals):
        drop_written(x)
    total = {k: v or 0 for k, v in total.items()}
    d3 = _discounts(seen[_TRIGRAMS])
    d3 = (1.0, *d3[1:]) if prune else d3
    return {"uri": uri, "shards": n, "common": common, **total, "d3": d3, "d2": _discounts(seen[_PAIRS]), "d1": _discounts(np.array([total[f"n{k}"] for k in (1, 2, 3, 4)]))}


class MappedModel:
    """The files of train(), mapped into memory as they are needed."""

    def __init__(self, model: dict):
        self.m = model
        self.files: dict[str, np.ndarray] = {}

    def _file(self, name: str, kind) -> np.ndarray:
        if name not in self.files:
            top = local_path(self.m["uri"])
            if top is not None:
                try:
                    self.files[name] = np.memmap(f"{top}/{name}", kind, "r")
                except (FileNotFoundError, ValueError):  # a shard without rows has no file or an empty one
                    self.files[name] = np.zeros(0, kind)
            else:
                store, at = open_store(f"{self.m['uri']}/{name}")
                self.files[name] = np.frombuffer(store.open_input_file(at).read(), kind) if store.get_file_info(at).is_file else np.zeros(0, kind)
        return self.files[name]

    def _find(self, kind: str, shard: np.ndarray, key: np.ndarray):
        """For each shard asked: (name, places in key, places in the file, size of the file)."""
        order = np.lexsort((key, shard))
        cut = np.searchsorted(shard[order], np.arange(self.m["shards"] + 1))
        for k in np.flatnonzero(np.diff(cut)):
            ask = order[cut[k] : cut[k + 1]]
            name = f"{kind}-{k:06d}"
            have = self._file(name, np.uint64)
            at = np.searchsorted(have, key[ask])
            ok = at < len(have)
            ok[ok] = have[at[ok]] == key[ask][ok]
            yield name, ask[ok], at[ok], len(have)

    def counts(self, kind: str, shard: np.ndarray, key: np.ndarray, rows: int, small) -> np.ndarray:
        out = np.zeros((rows, len(key)), np.int64)
        for name, ask, at, n in self._find(kind, shard, key):
            c = self._file(name + "-c", small).reshape(rows, n)[:, at].astype(np.int64)
            big = np.flatnonzero((c == np.iinfo(small).max).any(0))
            if len(big):
                odd, value = _unarrays(self._file(name + "-o", np.uint8).tobytes())
                c[:, big] = value.reshape(rows, -1)[:, np.searchsorted(odd, at[big])]
            out[:, ask] = c
        return out

    def packed(self, kind: str, shard: np.ndarray, key: np.ndarray, rows: int) -> np.ndarray:
        """The counts of each key, 0 if it is not there."""
        out = np.zeros((rows, len(key)), np.int64)
        shard = _small(shard)
        order = np.argsort((key >> np.uint64(48)).astype(np.uint16), kind="stable")  # neighbours in a file are asked together
        order = order[np.argsort(shard[order], kind="stable")]
        cut = np.cumsum(np.r_[0, np.bincount(shard, minlength=self.m["shards"])])
        for k in np.flatnonzero(np.diff(cut)):
            ask = order[cut[k] : cut[k + 1]]
            name = f"{kind}-{k:06d}"
            file = Packed(np.asarray(self._file(name, np.uint8)), lambda name=name: _unarrays(self._file(name + "-o", np.uint8).tobytes()))
            at = file.find(key[ask])
            ok = at >= 0
            if ok.any():
                out[:, ask[ok]] = file.counts(at[ok], rows)
        return out

    def log10(self, w: np.ndarray):
        """Of each token of texts that stand one after the other (each ends with END): (known, base, model) with log10 probabilities."""
        m, common, n = self.m, self.m["common"], self.m["shards"]
        u, v = _before(w, np.arange(len(w)))
        names, where = np.unique(np.concatenate([w, [BEGIN]]), return_inverse=True)
        stats = self.counts("words", _spot(names, n), names, 6, np.uint16)
        count, left = stats[0][where[:-1]], stats[1][where[:-1]]
        after = stats[2:][:, np.where(v == BEGIN, where[-1], np.r_[where[-1], where[:-2]])]
        base = np.log10((count + 0.5) / (m["n"] + 0.5 * (m["v"] + 1)))

        def level(c, context, discounts, low):
            """c: of the token; context: sum of counts, and how many are 1, 2, and more."""
            d = np.array([0.0, *discounts])
            size = np.maximum(context[0], 1)
            rest = np.where(context[0] > 0, (d[1] * context[1] + d[2] * context[2] + d[3] * context[3]) / size, 1.0)
            return np.maximum(c - d[np.minimum(c, 3)], 0) / size + rest * low

        one = level(left, np.array([m["left"], m["n1"], m["n2"], m["more"]])[:, None], m["d1"], 1 / (m["v"] + 1))
        pair, often = _pair(v, w), np.isin(v, common)
        shard = _shard(v, w, common, n)
        lefts = np.zeros(len(w), np.int64)
        for kind, here in (("two", ~often), ("often", often)):
            lefts[here] = self.packed(kind, shard[here], pair[here], 1)[0]
        two = level(lefts, after, m["d2"], one)
        context, shard = _pair(u, v), _shard(v, u, common, n)
        sums = self.packed("context", shard, context, 4)
        c, seen = np.zeros(len(w), np.int64), sums[0] > 0
        c[seen] = self.packed("three", shard[seen], _pair(context[seen], w[seen]), 1)[0]
        three = level(c, sums, m["d3"], two)
        return count > 0, base, np.log10(three)


_open: dict[str, MappedModel] = {}


def _mapped(model: dict) -> MappedModel:
    """One per Python worker: the maps of the model used last."""
    if model["uri"] not in _open:
        _open.clear()
        _open[model["uri"]] = MappedModel(model)
    return _open[model["uri"]]


def score(docs: DataFrame, model: dict, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns keep, and n_tokens, n_known, base_score, score, perplexity, of each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join([*(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep), "n_tokens bigint, n_known bigint, base_score double, score double, perplexity double"])

    def run(batches):
        import pyarrow as pa

        mapped = _mapped(shared.value)
        for batch in batches:
            if not batch.num_rows:
                continue
            tokens, sizes = _tokens(bytes_of(batch.column(len(keep))))
            starts, ends = np.cumsum(sizes) - sizes, np.cumsum(sizes)
            # whole texts of about SLICE tokens at a time
            cuts = np.unique(np.searchsorted(ends, np.arange(0, len(tokens), SLICE), "right"))
            cuts = [*cuts.tolist(), len(sizes)]
            some = [mapped.log10(tokens[starts[a] : ends[b - 1]]) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]
            known, base, high = (np.concatenate(x) for x in zip(*some, strict=True))
            total = np.add.reduceat(high, starts)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in range(len(keep))), pa.array(sizes), pa.array(np.add.reduceat(known.astype(np.int64), starts)), pa.array(np.add.reduceat(base, starts)), pa.array(total), pa.array(10 ** np.minimum(-total / sizes, 300))],
                names=[*keep, "n_tokens", "n_known", "base_score", "score", "perplexity"],
            )

        _open.clear()  # the maps go with the task
        _release()

    chosen = docs.select(*(F.col(k) for k in keep), F.col(text).cast("string").alias(fresh_names(docs, "text")[0]))
    return written(chosen.mapInArrow(run, schema), "ngram-scores")
