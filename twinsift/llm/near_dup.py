"""N-gram Jaccard join: MinHash LSH forest with exact verification.

1. A document's signature has TREES paths of DEPTH MinHash values. A tree is the trie of all paths of one place.
2. Each document starts with its whole paths and shortens them, value by value, until pairs as dissimilar as its
   size allows would share a path in some tree with the target probability. The least similarity at or above the
   threshold depends on the size: a set of 7 has no partner between 0.8 and 0.857, so it stops at 7 values; sets
   of 100 stop at 5; sets of up to 3 have no partner but equal sets, so they enter no trie. Two documents are
   candidates if they share a prefix of the longer of the two lengths in some tree.
3. Subtrees below the shortest prefix are sorted groups. Groups are dealt in blocks of at most BLOCK_DOCS
   documents; a task compares two blocks. A pair belongs to the first tree in which it is a candidate, so it is
   verified once however many tries it meets in. First the paths and set sizes alone tell which documents of a
   block have such a pair; only these get their shingle sets. No pairs are emitted, only numbers of links and
   one linked document each.
4. Connected links are classes.

Documents with the same shingle set are one class and enter once. Shingles are compared by 64-bit hashes.

Words are folded (A-Z to a-z, runs of letters, digits and non-ASCII); shingles have five words; a text of
fewer words is one shingle; a text without words (null, empty) has none and no links. Very long texts are hashed
piece by piece and read whole. Ties: of equal keys any row may lead a class; a class is named by its smallest key,
null keys last. An empty table gives no rows. Columns other than key and text are not read, so their names do not
matter. Keys of any type that can be sorted are kept as they are.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FOLD, Keys, Words, bytes_of, drop_written, fresh_names, frugal, grams, join_hot, mixed, slices, written
from .components import components

SHINGLE, THRESHOLD = 5, 0.8
TREES, DEPTH, TARGET_RECALL = 20, 8, 0.9995
BLOCK_DOCS = 1024
#: Pairs of two blocks up to which each is intersected by itself.
FEW_PAIRS = 64
#: Shingles that a matrix of a block's documents has as columns at a time.
_COLUMNS = 1024


def prefix_depth(similarity: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, target: float = TARGET_RECALL) -> int:
    """The longest prefix that a pair of this similarity shares in some tree with the target probability."""
    while depth > 1 and 1 - (1 - similarity**depth) ** trees < target:
        depth -= 1
    return depth


@functools.cache
def least_similarity(size: int, threshold: float = THRESHOLD) -> float | None:
    """The least Jaccard similarity at or above the threshold of a set of this size with a different set; None if there is none."""
    best = None
    for other in range(int(size * threshold - 1e-9), int(size / threshold + 1e-9) + 1):
        for common in range(min(size, other), -1, -1):
            similarity = common / (size + other - common)
            if similarity < threshold - 1e-9:
                break
            if (common < size or common < other) and (best is None or similarity < best):
                best = similarity
    return best


def query_depth(size: int, threshold: float = THRESHOLD) -> int:
    """How far a set of this size shortens its paths; 0 if it cannot have a partner."""
    if size > 64:  # steps of similarity are fine enough for the threshold itself
        return prefix_depth(threshold)
    least = least_similarity(size, threshold)
    return 0 if least is None else prefix_depth(least)


def shingle_set(words: np.ndarray, n: int = SHINGLE) -> np.ndarray:
    return np.unique(grams(words, min(n, len(words)))) if len(words) else np.zeros(0, np.uint64)


def signature(shingles: np.ndarray, size: int) -> np.ndarray:
    """MinHash values, of 16 bits each: what they add to the chance of a candidate is below 1 in 60,000 a value."""
    rng = np.random.default_rng(20240607)
    mult, flip = rng.integers(0, 2**32, size, np.uint32) | np.uint32(1), rng.integers(0, 2**32, size, np.uint32)
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(size, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(low), 2048):
        np.minimum(out, ((low[k : k + 2048, None] ^ flip) * mult).min(0), out=out)
    return (out >> np.uint32(16)).astype(np.uint16)


def prefix_keys(paths: np.ndarray, depth: int) -> np.ndarray:
    """paths: documents x trees x values. One 64-bit key per document and tree for the first depth values."""
    h = np.arange(1, paths.shape[1] + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h = np.broadcast_to(h, paths.shape[:2])
    for k in range(depth):
        h = mixed(h ^ (paths[:, :, k].astype(np.uint64) + np.uint64(k + 1)) * np.uint64(0xC2B2AE3D27D4EB4F))
    return h


def _set_key(s: np.ndarray) -> tuple[int, int]:
    """128 bits that name a shingle set."""
    import xxhash

    h = xxhash.xxh3_128_intdigest(s.tobytes())
    return tuple(x - (1 << 64) if x >= 1 << 63 else x for x in (h >> 64, h & 0xFFFFFFFFFFFFFFFF))


def linked(sets_a: list[np.ndarray], sets_b: list[np.ndarray] | None, threshold: float) -> np.ndarray:
    """Boolean matrix of the pairs whose Jaccard similarity reaches the threshold; b None: within a."""
    both = sets_a if sets_b is None else sets_a + sets_b
    sizes = np.array([len(s) for s in both])
    names, where = np.unique(np.concatenate(both), return_inverse=True)
    owner = np.repeat(np.arange(len(both)), sizes)
    shared = np.bincount(where, minlength=len(names)) > 1
    column = np.cumsum(shared) - 1
    keep = shared[where]
    where, owner = column[where[keep]], owner[keep]
    order = np.argsort(where, kind="stable")
    where, owner = where[order], owner[order]
    rows = len(sets_a)
    common = np.zeros((rows, len(both)), np.float32)
    for c in range(0, int(shared.sum()), _COLUMNS):
        a, b = np.searchsorted(where, [c, c + _COLUMNS])
        m = np.zeros((len(both), _COLUMNS), np.float32)
        m[owner[a:b], where[a:b] - c] = 1
        common += m[:rows] @ m.T
    union = sizes[:rows, None] + sizes[None, :] - common
    hit = common >= threshold * union - 1e-6
    return hit[:, rows:] if sets_b is not None else hit & ~np.eye(rows, dtype=bool)


def first_met(tree: int, paths: np.ndarray, depths: np.ndarray, sizes: np.ndarray, rows: int, threshold: float) -> np.ndarray:
    """Of the first rows documents with the others (all with each other, once, if there are no others): whether a pair is a candidate in this tree and in none before."""
    within = rows == len(paths)
    a, b = slice(0, rows), slice(0, rows) if within else slice(rows, len(paths))
    need = np.maximum(depths[a, None], depths[None, b])
    out = np.zeros(need.shape, bool)
    fits = np.minimum(sizes[a, None], sizes[None, b]) >= threshold * np.maximum(sizes[a, None], sizes[None, b]) - 1e-9
    if within:
        fits &= np.triu(np.ones((rows, rows), bool), 1)
    for depth in np.unique(need).tolist():
        keys = prefix_keys(paths[:, : tree + 1], depth)
        met = fits & (need == depth) & (keys[a, None, tree] == keys[None, b, tree])
        for k in range(tree):
            if not met.any():
                break
            met &= keys[a, None, k] != keys[None, b, k]
        out |= met
    return out


def _signed(chosen: DataFrame, threshold: float) -> DataFrame:
    """chosen: id, text, row, text_hash."""

    def run(batches):
        import pyarrow as pa

        for batch in itertools.chain.from_iterable(slices(b, 1) for b in batches):
            his, los, sizes, depths, paths = [], [], [], [], []
            for words in Words([raw.translate(FOLD) for raw in bytes_of(batch.column(1))]).by_text():
                s = shingle_set(words)
                hi, lo = _set_key(s)
                his.append(hi)
                los.append(lo)
                sizes.append(len(s))
                depths.append(query_depth(len(s), threshold) if len(s) else 0)
                paths.append(signature(s, TREES * DEPTH).tobytes() if depths[-1] else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), batch.column(3), *(pa.array(x, pa.int64()) for x in (his, los, sizes)), pa.array(depths, pa.int32()), pa.array(paths, pa.binary())],
                names=["id", "row", "text_hash", "hi", "lo", "size", "depth", "paths"],
            )

    return chosen.mapInArrow(frugal(run), "id bigint, row bigint, text_hash bigint, hi bigint, lo bigint, size bigint, depth int, paths binary")


def _paths(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, TREES, DEPTH)


def _rooted(least: int):
    """The subtree of each document in each tree, named by the shortest prefix in use."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = prefix_keys(_paths(batch.column(1)), least)
            trees = np.tile(np.arange(TREES, dtype=np.int32), len(keys))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(trees), batch.column(0).take(pa.array(np.repeat(np.arange(len(keys)), TREES)))], names=["root", "tree", "node"])

    return run


def _block_pairs(batches, columns: int):
    """Arrow batches sorted by root, i, j: (root, i, j, the other columns) of each group, as it ends."""
    import pyarrow as pa

    held, name = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        roots, i, j = (batch.column(k).to_numpy() for k in range(3))
        new = np.flatnonzero(np.r_[True, (roots[1:] != roots[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
        for a, b in zip(new.tolist(), [*new[1:].tolist(), len(roots)], strict=True):
            here = (roots[a], i[a], j[a])
            if held and here != name:
                yield name, [pa.chunked_array([x.column(k) for x in held]).combine_chunks() for k in range(3, columns)]
                held = []
            name = here
            held.append(batch.slice(a, b - a))
    if held:
        yield name, [pa.chunked_array([x.column(k) for x in held]).combine_chunks() for k in range(3, columns)]


def _halves(i: int, j: int, nodes: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, int]:
    """An order of the rows that has block i first, without repeated nodes, and how many are in it."""
    once = np.unique(nodes, return_index=True)[1]
    if i == j:
        return once, len(once)
    first = blocks[once] == i
    return np.concatenate([once[first], once[~first]]), int(first.sum())


def _with_new_pairs(threshold: float):
    """Rows root, i, j, node, block, tree, depth, size, paths: those with a pair that belongs here."""

    def run(batches):
        import pyarrow as pa

        kept: list[tuple] = []
        total = 0

        def out():
            arrays = [pa.array(np.concatenate([np.full(len(x[1]), x[0][k]) for x in kept]).astype(np.int64)) for k in range(3)]
            rest = [pa.array(np.concatenate([x[k] for x in kept])) for k in (1, 2, 3)]
            return pa.RecordBatch.from_arrays([*arrays, *rest], names=["root", "i", "j", "node", "block", "tree"])

        for name, (node, block, tree, depth, size, paths) in _block_pairs(batches, 9):
            nodes, blocks, depths, sizes = node.to_numpy(), block.to_numpy(), depth.to_numpy(), size.to_numpy()
            order, rows = _halves(name[1], name[2], nodes, blocks)
            if len(order) < 2 or (name[1] != name[2] and not 0 < rows < len(order)):
                continue
            met = first_met(tree[0].as_py(), _paths(paths)[order], depths[order], sizes[order], rows, threshold)
            left, right = met.any(1), met.any(0)
            found = order[left | right] if rows == len(order) else np.concatenate([order[:rows][left], order[rows:][right]])
            if len(found):
                kept.append((name, nodes[found], blocks[found], tree.to_numpy()[found]))
                total += len(found)
            if total >= 10_000:
                yield out()
                kept, total = [], 0
        if kept:
            yield out()

    return run


def _verified(threshold: float):
    """Rows root, i, j, node, block, tree, depth, paths, shingles: of each node, its number of links here and a node that it is joined to."""

    def run(batches):
        import pyarrow as pa

        kept: list[tuple] = []
        total = 0
        for name, (node, block, tree, depth, paths, shingles) in _block_pairs(batches, 9):
            nodes, blocks = node.to_numpy(), block.to_numpy()
            order, rows = _halves(name[1], name[2], nodes, blocks)
            if len(order) < 2 or (name[1] != name[2] and not 0 < rows < len(order)):
                continue
            raw = shingles.to_pylist()
            sets = [np.frombuffer(raw[k], np.uint64) for k in order.tolist()]
            sizes = np.array([len(s) for s in sets])
            met = first_met(tree[0].as_py(), _paths(paths)[order], depth.to_numpy()[order], sizes, rows, threshold)
            within = rows == len(order)
            a, b = np.nonzero(met)
            if len(a) > FEW_PAIRS:
                hit = met & linked(sets if within else sets[:rows], None if within else sets[rows:], threshold)
                a, b = np.nonzero(hit)
            else:
                shift = 0 if within else rows
                common = np.array([len(np.intersect1d(sets[x], sets[y + shift], assume_unique=True)) for x, y in zip(a.tolist(), b.tolist(), strict=True)])
                good = common >= threshold * (sizes[a] + sizes[b + shift] - common) - 1e-6 if len(a) else np.zeros(0, bool)
                a, b = a[good], b[good]
            if not len(a):
                continue
            b = b if within else b + rows
            links = np.bincount(np.concatenate([a, b]), minlength=len(order))
            label = np.arange(len(order))
            while True:  # the smallest place that links lead to
                new = label.copy()
                np.minimum.at(new, a, label[b])
                np.minimum.at(new, b, label[a])
                new = np.minimum(new, new[new])
                if (new == label).all():
                    break
                label = new
            some = links > 0
            kept.append((nodes[order[some]], links[some].astype(np.int64), nodes[order[label[some]]]))
            total += int(some.sum())
            if total >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*kept, strict=True)], names=["node", "links", "joined"])
                kept, total = [], 0
        if kept:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*kept, strict=True)], names=["node", "links", "joined"])

    return run


def _shingle_sets(met: DataFrame) -> DataFrame:
    """met: text, node, hi, lo. Rows whose text has not the shingle set of the name are left out (a key may stand for several texts)."""

    def run(batches):
        import pyarrow as pa

        for batch in itertools.chain.from_iterable(slices(b, 0) for b in batches):
            keep, out = [], []
            expected = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            texts = Words([raw.translate(FOLD) for raw in bytes_of(batch.column(0))]).by_text()
            for words, name in zip(texts, expected, strict=True):
                s = shingle_set(words)
                keep.append(_set_key(s) == name)
                out.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(out, pa.binary())], names=["node", "shingles"]).filter(pa.array(keep, pa.bool_()))

    return met.mapInArrow(frugal(run), "node bigint, shingles binary")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, text_hash: str | None = None) -> DataFrame:
    """One row per row of docs: key, class_id, n_links, n_copies.

    class_id: smallest key among documents that links or equal shingle sets connect (null keys last). n_links:
    different shingle sets within the threshold. n_copies: rows with the same shingle set. Rows without words
    are classes of their own. docs is read twice, so it should be a stored table. text_hash: name of one more
    column, that tells rows of one key apart.
    """
    spark = docs.sparkSession
    keys = Keys(docs, key)
    texts = keys.select(docs, F.col(text).cast("string").alias("text"))
    signed = written(_signed(texts.select("id", "text", F.monotonically_increasing_id().alias("row"), F.xxhash64("text").alias("text_hash")), threshold), "near-signed")
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row", "text_hash"))
    classes = written(signed.where("size > 0").groupBy("hi", "lo").agg(first.alias("first"), F.count(F.lit(1)).alias("n_copies")).select("hi", "lo", F.col("first.row").alias("node"), F.col("first.id").alias("rep"), F.col("first.text_hash").alias("text_hash"), "n_copies"), "near-classes")
    # one signature of each shingle set
    nodes = signed.where("depth > 0").join(classes.select(F.col("node").alias("row")), "row", "left_semi")
    nodes = written(nodes.select(F.col("row").alias("node"), "paths", "depth", "size"), "near-nodes")
    least = prefix_depth(threshold)
    tries = written(nodes.select("node", "paths").mapInArrow(frugal(_rooted(least)), "root bigint, tree int, node bigint"), "near-tries")
    groups = written(tries.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "near-groups")
    met = join_hot(tries, groups, "root", tries.count()).withColumn("blocks", F.ceil(F.col("n") / F.lit(BLOCK_DOCS)))
    met = met.withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("other")
    dealt = met.select("root", "tree", "node", "block", other).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)

    def by_blocks(df: DataFrame, *columns: str) -> DataFrame:
        chosen = df.select("root", "i", "j", "node", "block", "tree", *columns)
        return chosen.repartition(tasks, "root", "i", "j").sortWithinPartitions("root", "i", "j")

    # documents with a node in common tries grow with the input, so they are never broadcast, however few they are
    compared = by_blocks(dealt.join(nodes.hint("merge"), "node"), "depth", "size", "paths")
    needed = written(compared.mapInArrow(frugal(_with_new_pairs(threshold)), "root bigint, i bigint, j bigint, node bigint, block bigint, tree int"), "near-needed")
    for x in (tries, groups):
        drop_written(x)
    chosen = written(needed.select("node").distinct().join(classes, "node").select("node", "rep", "text_hash", "hi", "lo"), "near-chosen")
    same = F.col("id").eqNullSafe(F.col("rep")) & (F.xxhash64("text") == F.col("text_hash"))
    sets = _shingle_sets(texts.join(chosen.hint("merge"), same).select("text", "node", "hi", "lo"))
    sets = written(sets if signed.groupBy("id").count().where("count > 1").isEmpty() else sets.dropDuplicates(["node"]), "near-sets")
    held = needed.join(nodes.select("node", "depth", "paths").hint("merge"), "node").join(sets.hint("merge"), "node")
    verified = written(by_blocks(held, "depth", "paths", "shingles").mapInArrow(frugal(_verified(threshold)), "node bigint, links bigint, joined bigint"), "near-verified")
    for x in (needed, chosen, sets, nodes):
        drop_written(x)
    links = verified.groupBy("node").agg(F.sum("links").alias("n_links"))
    joined = components(verified.select(F.col("node").alias("u"), F.col("joined").alias("v")))
    member = classes.join(joined, "node", "left").join(links, "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = member.groupBy("label").agg(F.min(F.struct(F.col("rep").isNull().alias("no_id"), "rep"))["rep"].alias("class_id"), F.count(F.lit(1)).alias("n"))
    member = join_hot(written(member, "near-member"), written(named, "near-named"), "label", classes.count(), "n")
    member = member.select("hi", "lo", "class_id", F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"), "n_copies")
    member = written(member, "near-classed")
    worded = join_hot(signed.where("size > 0").select("id", "text_hash", "hi", "lo"), member, ["hi", "lo"], signed.count(), "n_copies").select("id", "class_id", "n_links", "n_copies", "text_hash")
    bare = signed.where("size = 0").select("id", F.col("id").alias("class_id"), F.lit(0).cast("bigint").alias("n_links"), F.lit(1).cast("bigint").alias("n_copies"), "text_hash")
    out = worded.unionByName(bare)
    out = out.drop("text_hash") if text_hash is None else out.withColumnRenamed("text_hash", text_hash)
    out = written(keys.restore(out, {"id": key, "class_id": "class_id"}), "near-out")
    for x in (signed, classes, verified):
        drop_written(x)
    keys.drop()
    return out


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One document of each group stays (the one with the smallest key), with all its columns; texts without words stay.

    Of rows that repeat a key, those that stay are told apart by their text: one row of each text.
    """
    stays, name = fresh_names(docs, "stays", "hash")
    classes = near_duplicates(docs, key, text, threshold, name)
    stay = classes.where(F.col(key).eqNullSafe(F.col("class_id"))).select(F.col(key).alias(stays), name).distinct()
    kept = docs.join(stay, F.col(key).eqNullSafe(F.col(stays)) & (F.xxhash64(F.col(text).cast("string")) == F.col(name)), "left_semi")
    repeated = docs.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col(key).alias(stays))
    if repeated.isEmpty():
        return kept
    again = kept.join(repeated, F.col(key).eqNullSafe(F.col(stays)), "left_semi").dropDuplicates([key, text])
    return kept.join(repeated, F.col(key).eqNullSafe(F.col(stays)), "left_anti").unionByName(again)
