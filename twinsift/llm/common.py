"""What the operators of this subpackage share: the shared folder, written tables and word splitting.

Tables between stages are written as Parquet below ``spark.checkpoint.dir``, which cuts the lineage: an
executor that is lost later costs a re-read, not a re-run. Their shuffle files are dropped as soon as the
table is written.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import tempfile
import uuid
from urllib.parse import urlsplit

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Byte table: A-Z become a-z, every other ASCII byte but digits and a-z a space, bytes of longer characters stay.
FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
#: Only A-Z become a-z.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "16m"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Unset (tests on one machine), a temporary one is chosen once."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="twinsift-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/") if "://" in found else "file://" + found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def bounded_batches(spark: SparkSession):
    """Arrow batches stay small while texts of any length pass; shuffle files go when a written table is complete."""
    old = {k: spark.conf.get(k, None) for k in (*_BATCH, _CLEANUP)}
    for k, v in _BATCH.items():
        spark.conf.set(k, v)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, from a table in the shared folder."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    with bounded_batches(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def drop_written(df: DataFrame) -> None:
    """Delete a table of written() that no later step reads."""
    spark, path = df.sparkSession, getattr(df, "written_at", None)
    if path:
        jvm = spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def fresh_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names like the wanted ones that no column of df has, in any case of letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


class Keys:
    """Integers that stand for the keys of a table, in the same order, and the way back.

    Integer keys stand for themselves. Keys of any other type (strings, dates) are sorted and numbered in a
    written table, which is joined where rows go in and come out. Null keys are null integers.
    """

    def __init__(self, docs: DataFrame, key: str):
        self.key, self.type, self.ranks = key, docs.schema[key].dataType, None
        if not isinstance(self.type, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            distinct = docs.select(F.col(key).alias("value")).where("value is not null").distinct().orderBy("value")
            self.ranks = written(distinct.select("value", F.monotonically_increasing_id().alias("rank")), "key-ranks")

    def select(self, docs: DataFrame, *columns) -> DataFrame:
        """id (bigint) and the columns."""
        if self.ranks is None:
            return docs.select(F.col(self.key).cast("bigint").alias("id"), *columns)
        found = docs.select(F.col(self.key).alias("value"), *columns)
        rest = [c for c in found.columns if c != "value"]
        return found.join(self.ranks, "value", "left").select(F.col("rank").alias("id"), *rest)

    def restore(self, df: DataFrame, names: dict[str, str]) -> DataFrame:
        """df with the integers of each column in names as keys again, under the new name, in the same place."""
        order = [names.get(c, c) for c in df.columns]
        for old, new in names.items():
            if self.ranks is None:
                back = F.col(old).cast(self.type)
                df = df.select(*(back.alias(new) if c == old else F.col(c) for c in df.columns))
            else:
                kept = [F.col(c) for c in df.columns if c != old]
                df = df.join(self.ranks.select(F.col("rank").alias(old), F.col("value").alias(f"key of {new}")), old, "left")
                df = df.select(*kept, F.col(f"key of {new}").alias(new))
        return df.select(*order)

    def drop(self) -> None:
        if self.ranks is not None:
            drop_written(self.ranks)


#: A key with more than this share of all rows is hot; there are at most HOT_KEYS of them.
HOT_KEYS = 1000


def join_hot(left: DataFrame, right: DataFrame, key: str | list[str], total: int, n: str = "n") -> DataFrame:
    """Inner equi-join of left with right, where right has one row per key (not null) and in n how many rows of left have it.

    Keys with more than 1 / HOT_KEYS of the total rows of left are at most HOT_KEYS rows of right. They are
    broadcast to where the rows of left lie; only the rest is shuffled, so no task gets the rows of a hot key.
    """
    least = max(1, total // HOT_KEYS)
    hot = F.broadcast(right.where(F.col(n) > least))
    rest = left.join(F.broadcast(right.where(F.col(n) > least).select(*([key] if isinstance(key, str) else key))), key, "left_anti")
    return left.join(hot, key).unionByName(rest.join(right.where(F.col(n) <= least).hint("merge"), key))


def open_store(uri: str):
    """(pyarrow file system, path) of a shared folder, as executors see it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def local_path(uri: str) -> str | None:
    """Path of a mounted folder, for memory maps; None for an object store."""
    parts = urlsplit(uri)
    return parts.path if parts.scheme in ("", "file") else None


def put_file(uri: str, name: str, data: bytes) -> str:
    """Write under a name of this attempt, then rename: a repeated or doubled task leaves one whole file."""
    store, top = open_store(uri)
    store.create_dir(top, recursive=True)
    part = f"{top}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as out:
        out.write(data)
    store.move(part, f"{top}/{name}")
    return f"{uri}/{name}"


def bytes_of(column) -> list[bytes]:
    """UTF-8 bytes of a string column of an Arrow batch; null is empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def remainder_of_id(column: str, modulus: int):
    """crc32 of the id as text, modulo; a null id counts as the text 'null'."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("null")).cast("binary")) % modulus


#: Bytes of text that a Python worker cuts into words at a time (arrays of words and bytes take some 50 times as much).
SOME_BYTES = 1 << 20


def slices(batch, column: int, some: int = SOME_BYTES):
    """Parts of an Arrow batch, in order, with at most so many bytes in this column (or one row)."""
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + some, "right")))
        yield batch.slice(at, stop - at)
        at = stop


@functools.cache
def _trim():
    """malloc_trim of glibc, or nothing."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):
        return lambda _: 0


def frugal(run):
    """A function for mapInArrow that gives memory which it no longer uses back to the system when a task ends.

    Python workers live on between tasks, next to the JVM of their executor, and the allocators of Python, numpy and
    Arrow would keep what the largest batch took.
    """

    def task(batches):
        import pyarrow as pa

        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            _trim()(0)

    return task


_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_PIECE = 1 << 18
#: A 64-bit value for each byte; the ASCII white space ends words.
_VALUES = np.random.default_rng(20240611).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_VALUES[_SPACE] = 0


@functools.cache
def _powers(base: int, size: int) -> np.ndarray:
    out = np.full(size, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def hash_between(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each word (starts rise): values of its bytes times powers of a base, summed modulo 2^64."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        low = int(starts[at])
        stop = max(at + 1, int(np.searchsorted(ends, low + _PIECE, "right")))
        high = int(ends[stop - 1])
        size = max(_PIECE, 1 << (high - low).bit_length())
        total = np.zeros(high - low + 1, np.uint64)
        np.cumsum(_VALUES[buffer[low:high]] * _powers(_BASE, size)[: high - low], out=total[1:])
        a, b = starts[at:stop] - low, ends[at:stop] - low
        out[at:stop] = (total[b] - total[a]) * _powers(_BACK, size)[a] + (b - a).astype(np.uint64)
        at = stop
    return mixed(out)


class Words:
    """The words of texts in a row, one blank after each: line (bytes), where words start and end in it, their hashes, and sizes (words of each text)."""

    def __init__(self, texts: list[bytes]):
        raw = np.frombuffer(b" ".join(texts), np.uint8)
        blank = _SPACE[raw]
        before = np.concatenate([[True], blank[:-1]]) if len(raw) else blank
        firsts = np.flatnonzero(~blank & before)
        bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.sizes = np.diff(np.searchsorted(firsts, bounds))
        line = raw[~(blank & before)]
        if len(line) and not _SPACE[line[-1]]:
            line = np.append(line, np.uint8(32))
        self.ends = np.flatnonzero(_SPACE[line])
        self.starts = np.concatenate([[0], self.ends[:-1] + 1]) if len(self.ends) else self.ends
        if len(line) and not line.flags.writeable:
            line = line.copy()
        line[self.ends] = 32
        self.line = line.tobytes()
        self.hashes = hash_between(line, self.starts, self.ends)

    def text(self, first: int, stop: int) -> bytes:
        """Some words (one at least), joined by one blank."""
        return self.line[self.starts[first] : self.ends[stop - 1]]

    def by_text(self) -> list[np.ndarray]:
        return np.split(self.hashes, np.cumsum(self.sizes)[:-1]) if len(self.sizes) else []


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit sums."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def grams(words: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hash of each n consecutive words; empty if there are fewer."""
    size = len(words) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    step = np.uint64((0x9E3779B97F4A7C15 + 2 * seed * 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    h = np.full(size, np.uint64(seed + 1))
    for k in range(n):
        h = h * step + words[k : k + size]
    return mixed(h)
