"""Token ids in patched frame-of-reference files.

A stream of integers is cut into blocks. A block stores its minimum and the differences from it, packed at
the bit width that a percentile of them needs; wider ones go to an exception list (position and whole
difference). An index holds where each block starts, so that a reader can decode any block alone.

Null and empty texts are the end id alone. Very long texts are one document, in a file of its own size. Ties:
rows that repeat a key stand beside each other, by text. Null keys come first. No rows, no files. Columns other
than key and text are not read, so their names do not matter. Keys are stored as integers; keys of another type
are stored as numbers in their order, counted over the distinct keys but not gapless.

File: magic, then streams (document keys, null flags of keys, document lengths, ids), then the footer (JSON
with the streams' places) and its length. Files of a partition are in ascending key order, as are partitions.
"""

from __future__ import annotations

import json
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Keys, fresh_path, open_store, put_file, written
from .tokens import encoder

MAGIC = b"TSPF1\n"
BLOCK = 4096
PERCENTILE = 95
#: Ids in one file at most (but for a longer single document).
FILE_IDS = 16_000_000


def _fits(v: np.ndarray, bits: int) -> bool:
    return int(v.max()) >> bits == 0


def _holder(width: int) -> int:
    """Bits of the machine integer that values of this width pass through."""
    return 16 if width <= 16 else 32 if width <= 32 else 64


def _widths(v: np.ndarray) -> np.ndarray:
    """Bits that each unsigned 64-bit value needs."""
    if _fits(v, 32):
        return np.frexp(v.astype(np.float64))[1]
    hi, lo = (v >> np.uint64(32)).astype(np.float64), (v & np.uint64(0xFFFFFFFF)).astype(np.float64)
    return np.where(hi > 0, np.frexp(hi)[1] + 32, np.frexp(lo)[1])


def pack_block(values: np.ndarray, percentile: int = PERCENTILE) -> bytes:
    low = values.min()
    diff = values - low
    need = _widths(diff)
    at = (len(need) - 1) * percentile // 100
    width = int(np.partition(need, at)[at])
    odd = np.flatnonzero(need > width)
    short = diff.copy()
    short[odd] = 0
    bits = np.unpackbits(short.astype(f"<u{_holder(width) // 8}").view(np.uint8).reshape(len(short), -1), axis=1, bitorder="little")[:, :width]
    head = struct.pack("<QBII", int(low), width, len(values), len(odd))
    return head + np.packbits(bits, axis=None, bitorder="little").tobytes() + odd.astype("<u4").tobytes() + diff[odd].astype("<u8").tobytes()


def unpack_block(data) -> np.ndarray:
    low, width, n, n_odd = struct.unpack_from("<QBII", data)
    at, size = struct.calcsize("<QBII"), (n * width + 7) // 8
    bits = np.unpackbits(np.frombuffer(data, np.uint8, size, at), bitorder="little", count=n * width).reshape(n, width)
    held = _holder(width)
    padded = np.zeros((n, held), np.uint8)
    padded[:, :width] = bits
    out = np.packbits(padded, axis=None, bitorder="little").view(f"<u{held // 8}").reshape(n).astype(np.uint64)
    odd = np.frombuffer(data, "<u4", n_odd, at + size)
    out[odd] = np.frombuffer(data, "<u8", n_odd, at + size + 4 * n_odd)
    return out + np.uint64(low)


def pack_stream(values: np.ndarray, block: int = BLOCK) -> tuple[bytes, np.ndarray]:
    """(bytes of all blocks, starts of the blocks and the end)."""
    values = np.asarray(values).astype(np.uint64)
    blocks = [pack_block(values[k : k + block]) for k in range(0, len(values), block)]
    return b"".join(blocks), np.cumsum([0, *map(len, blocks)]).astype("<u8")


def file_bytes(keys: list, lengths: list[int], ids: np.ndarray, block: int = BLOCK) -> bytes:
    out, places = [MAGIC], {"block": block, "n_docs": len(keys), "n_ids": len(ids)}
    at = len(MAGIC)
    numbers = np.array([0 if k is None else k for k in keys], np.int64).view(np.uint64)
    for name, values in (("keys", numbers), ("nulls", np.array([k is None for k in keys])), ("lengths", np.array(lengths)), ("ids", ids)):
        body, starts = pack_stream(values, block)
        places[name] = [at, at + len(body), len(starts)]
        out += [body, starts.tobytes()]
        at += len(body) + starts.nbytes
    footer = json.dumps(places).encode()
    return b"".join([*out, footer, struct.pack("<I", len(footer)), MAGIC])


class TokenFile:
    """Random access to a file of file_bytes(): blocks are read and decoded one at a time."""

    def __init__(self, uri: str):
        store, path = open_store(uri)
        self.f = store.open_input_file(path)
        size = self.f.size()
        n, magic = struct.unpack(f"<I{len(MAGIC)}s", self.f.read_at(4 + len(MAGIC), size - 4 - len(MAGIC)))
        if magic != MAGIC:
            raise ValueError(f"not a token file, or cut short: {uri}")
        self.places = json.loads(self.f.read_at(n, size - 4 - len(MAGIC) - n))
        self.index = {s: np.frombuffer(self.f.read_at(8 * self.places[s][2], self.places[s][1]), "<u8") for s in ("keys", "nulls", "lengths", "ids")}

    def block(self, stream: str, k: int) -> np.ndarray:
        a, b = self.index[stream][k : k + 2]
        return unpack_block(self.f.read_at(int(b - a), self.places[stream][0] + int(a)))

    def stream(self, name: str) -> np.ndarray:
        blocks = [self.block(name, k) for k in range(len(self.index[name]) - 1)]
        return np.concatenate(blocks) if blocks else np.zeros(0, np.uint64)

    def ids(self, start: int, n: int) -> np.ndarray:
        size = self.places["block"]
        if n <= 0:
            return np.zeros(0, np.uint32)
        parts = [self.block("ids", k) for k in range(start // size, (start + n - 1) // size + 1)]
        return np.concatenate(parts)[start % size : start % size + n].astype("<u4")

    def documents(self):
        """(key, ids) in file order; each block of ids is decoded once."""
        keys = self.stream("keys").view(np.int64).tolist()
        nulls, lengths = self.stream("nulls").tolist(), self.stream("lengths").tolist()
        k, rest = 0, np.zeros(0, "<u4")
        for key, null, n in zip(keys, nulls, lengths, strict=True):
            parts, have = [rest], len(rest)
            while have < n:
                parts.append(self.block("ids", k).astype("<u4"))
                have, k = have + len(parts[-1]), k + 1
            whole = np.concatenate(parts) if len(parts) > 1 else rest
            yield (None if null else key), whole[:n]
            rest = whole[n:]


def write_token_files(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int | None = 2, partitions: int | None = None) -> DataFrame:
    """Encode and write; one row per file: part, seq, uri, n_docs, n_ids, in ascending (null first) key order."""
    spark = docs.sparkSession
    uri = fresh_path(spark, "token-files")
    chosen = Keys(docs, key).select(docs, F.col(text).cast("string").alias("text")).select(F.col("id").alias("key"), "text")
    n = partitions or max(8, docs.rdd.getNumPartitions())
    ordered = chosen.repartitionByRange(n, "key").sortWithinPartitions("key", "text")

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, seq, tail = TaskContext.get().partitionId(), 0, b"" if end_id is None else np.array([end_id], "<u4").tobytes()
        keys, lengths, chunks, rows = [], [], [], []

        def flush():
            nonlocal seq, keys, lengths, chunks
            ids = np.frombuffer(b"".join(chunks), "<u4")
            name = f"part-{part:06d}-{seq:04d}.tspf"
            rows.append((part, seq, put_file(uri, name, file_bytes(keys, lengths, ids)), len(keys), len(ids)))
            seq, keys, lengths, chunks = seq + 1, [], [], []

        enc, held = encoder(tokenizer), 0
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            for k, ids in zip(batch.column(0).to_pylist(), enc.encode(texts), strict=True):
                keys.append(k)
                chunks.append(ids + tail)
                lengths.append(len(chunks[-1]) // 4)
                held += lengths[-1]
                if held >= FILE_IDS:
                    flush()
                    held = 0
        if keys:
            flush()
        cols = list(zip(*rows, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["part", "seq", "uri", "n_docs", "n_ids"])

    return written(ordered.mapInArrow(run, "part bigint, seq bigint, uri string, n_docs bigint, n_ids bigint"), "token-files-list")


def read_token_files(files: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per document, from the files: key, start (ids before it in all files), n_tokens, ids_crc32."""
    spark = files.sparkSession
    # one row per file, so the ordered sum over all of them is small
    before = F.sum("n_ids").over(Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1))
    placed = files.withColumn("before", F.coalesce(before, F.lit(0))).select("uri", "before")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for uri, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys, starts, sizes, sums = [], [], [], []
                for k, ids in TokenFile(uri).documents():
                    keys.append(k)
                    starts.append(start)
                    sizes.append(len(ids))
                    sums.append(zlib.crc32(np.ascontiguousarray(ids).tobytes()))
                    start += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (keys, starts, sizes, sums)], names=[key, "start", "n_tokens", "ids_crc32"])

    return placed.repartition(tasks, "uri").mapInArrow(run, f"`{key}` bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
