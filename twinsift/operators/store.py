"""Tables between steps: written as Parquet in the shared folder, which cuts the lineage and spares a second evaluation."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Arrow batches stay small while long arrays pass; shuffle files go when a table is complete.
_WRITING = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "4m", "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder where it is unset and the session is local; else an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="twinsift-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/") if "://" in folder else "file://" + folder.rstrip("/")


@contextlib.contextmanager
def with_batches(spark: SparkSession):
    old = {k: spark.conf.get(k, None) for k in _WRITING}
    for k, v in _WRITING.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stored(df: DataFrame, name: str, by: str | None = None, plain: bool = False) -> DataFrame:
    """The rows of df, from a table in the shared folder; by: column with a folder for each value; plain: neither compressed nor in dictionaries, for large packed values."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with with_batches(df.sparkSession):
        out = df.write.partitionBy(by) if by else df.write
        if plain:  # else Spark holds each page several times outside of the heap
            out = out.option("compression", "uncompressed").option("parquet.enable.dictionary", "false").option("parquet.page.size.row.check.min", "1").option("parquet.page.size.row.check.max", "1")
        out.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def drop_stored(table: DataFrame | str, spark: SparkSession | None = None) -> None:
    """Delete a table of stored(), or its folder, that no later step reads."""
    spark, path = (spark, table) if isinstance(table, str) else (table.sparkSession, getattr(table, "written_at", None))
    if path:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def open_store(uri: str):
    """(pyarrow file system, path) of a shared folder, as executors see it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)
