"""Best-fit packing of token pieces into sequences, by hierarchical residual packing.

Each partition packs its own pieces best-fit and keeps its nearly full bins. Bins with room left become items
that groups of partitions pack best-fit again, group after group up a tree. Only (bin, fill) pairs travel. A
group with more bins than one task packs is split by hash; at the root the rounds go on, dealt anew, until the
rest fits one task or a round no longer merges a hundredth of the bins (then hardly any two fit together).

Null and empty texts are a piece of the end id alone (of no id, with length 0, if end_id is None). Very long texts
are cut into full pieces, of which the first may be shorter. Ties: of equal pieces the first read goes first, of
equal bins the one opened last. Repeated rows and keys are packed each; keys of any type are kept, null keys stay
null. An empty table gives no rows. Columns other than key and text are not read, so their names do not matter.
"""

from __future__ import annotations

import itertools
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, frugal, slices, written
from .tokens import CACHE_PIECES, encoder

CAPACITY = 2048
#: A bin with this little room left is closed.
NEARLY_FULL = 16
FAN_IN = 8
#: Pieces a task holds before it packs them, and bins that one task of a merge round packs.
HELD = 400_000


def best_fit(lengths, capacity: int):
    """Longest first, each into the fullest bin that has room. Returns bin of each item, offset of each item, fill of each bin."""
    lengths = np.asarray(lengths, np.int64)
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, fill = 0, []
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = open_bins[room].pop()
            if not open_bins[room]:
                rooms ^= 1 << room
        else:
            b, room = len(fill), capacity
            fill.append(0)
        where[i], offset[i] = b, fill[b]
        fill[b] += size
        if room > size:
            open_bins[room - size].append(b)
            rooms |= 1 << (room - size)
    return where, offset, np.array(fill, np.int64)


def _cut(n: int, capacity: int):
    """(start, length) of the pieces of a document of n ids: all but the first are full."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def token_pieces(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int | None = 0, capacity: int = CAPACITY, cache: int = CACHE_PIECES) -> DataFrame:
    """One row per piece, packed within its partition: key (under this name), piece, start, length, ids_crc32, part, bin, offset, fill."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, used, tail = TaskContext.get().partitionId(), 0, b"" if end_id is None else np.array([end_id], "<u4").tobytes()
        held: list[tuple] = []

        def pack():
            nonlocal used, held
            lengths = np.array([x[3] for x in held], np.int64)
            where, offset, fill = best_fit(lengths, capacity)
            names = ((part << 40) + used + where).tolist()
            used += len(fill)
            cols = [list(c) for c in zip(*held, strict=True)]
            held = []
            return pa.RecordBatch.from_arrays(
                [pa.array(cols[0], key_type), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:]), pa.array([part] * len(names), pa.int64()), pa.array(names, pa.int64()), pa.array(offset, pa.int64()), pa.array(fill[where], pa.int64())],
                names=["key", "piece", "start", "length", "ids_crc32", "part", "bin", "offset", "fill"],
            )

        enc = encoder(tokenizer, cache)
        key_type = None
        for batch in itertools.chain.from_iterable(slices(b, 1) for b in batches):
            key_type = batch.column(0).type
            keys, texts = batch.column(0).to_pylist(), [x or "" for x in batch.column(1).to_pylist()]
            for doc, ids in zip(keys, enc.encode(texts), strict=True):
                ids = memoryview(ids + tail)
                for k, (start, n) in enumerate(_cut(len(ids) // 4, capacity)):
                    held.append((doc, k, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)])))
            if len(held) >= HELD:
                yield pack()
        if held:
            yield pack()

    schema = f"key {docs.schema[key].dataType.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint, part bigint, bin bigint, offset bigint, fill bigint"
    return written(docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(frugal(run), schema), "packing-pieces")


def pack_documents(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int | None = 0, capacity: int = CAPACITY, cache: int = CACHE_PIECES) -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = token_pieces(docs, tokenizer, key, text, end_id, capacity, cache)
    room = capacity - NEARLY_FULL
    left = written(pieces.where(F.col("fill") < room).groupBy("bin").agg(F.first("fill").alias("fill"), F.first("part").alias("grp")), "packing-left")
    top = left.agg(F.max("grp")).first()[0]
    maps = []
    rounds = 0
    bins = left.count()
    while top is not None and bins:
        rounds += 1
        at_root = top < FAN_IN
        grouped = left.withColumn("grp", F.expr(f"grp div {FAN_IN}"))
        sizes = grouped.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / F.lit(HELD)).alias("split"))
        grouped = grouped.join(sizes, "grp").withColumn("split", F.pmod(F.xxhash64(F.lit(rounds), "bin"), "split"))

        def merge(keys, frame):
            import pandas as pd

            frame = frame.sort_values("bin")
            where, offset, fill = best_fit(frame["fill"].to_numpy(), capacity)
            name = frame["bin"].to_numpy()[np.unique(where, return_index=True)[1]] if len(where) else where
            return pd.DataFrame({"bin": frame["bin"].to_numpy(), "into": name[where], "shift": offset, "grp": keys[0], "fill": fill[where]})

        merged = written(grouped.groupBy("grp", "split").applyInPandas(merge, "bin bigint, into bigint, shift bigint, grp bigint, fill bigint"), f"packing-round{rounds}")
        maps.append(merged.select("bin", "into", "shift"))
        left = merged.where(F.col("fill") < room).groupBy("into").agg(F.first("fill").alias("fill"), F.first("grp").alias("grp")).withColumnRenamed("into", "bin")
        top //= FAN_IN
        before, bins = bins, left.count()
        if at_root and (before <= HELD or bins > 0.99 * before):
            break
    total = None
    for later in reversed(maps):
        if total is None:
            total = later
        else:
            up = total.select(F.col("bin").alias("into"), F.col("into").alias("into2"), F.col("shift").alias("shift2"))
            total = later.join(up, "into", "left").select("bin", F.coalesce("into2", "into").alias("into"), (F.col("shift") + F.coalesce("shift2", F.lit(0))).alias("shift"))
    if total is None:
        placed = pieces.withColumns({"into": F.lit(None).cast("bigint"), "shift": F.lit(0).cast("bigint")})
    else:
        placed = pieces.join(total, "bin", "left")
    out = written(
        placed.select(F.col("key").alias(key), "piece", "start", "length", "ids_crc32", F.coalesce("into", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset")),
        "packing-out",
    )
    drop_written(pieces)
    return out
