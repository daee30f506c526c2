"""What the operators share: the folder all executors see, cuts of lineage, batches."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handled together in a Python worker.
CHUNK_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, or else the one given to setCheckpointDir. Where there is neither, a
    session of one process (tests) gets a folder of its own; on a cluster that is an error, as executors would not see it."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='tickloom-')}")
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Write df to the shared folder (in folders by some columns) and read it back: what follows does not depend on
    executors that may be lost."""
    path = scratch(df.sparkSession, name)
    df.write.partitionBy(*by).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def forget(*cuts: DataFrame) -> None:
    """Remove the files of cut() tables that nothing will read again."""
    for df in cuts:
        drop_path(df.sparkSession, df.scratch_path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a scratch path, through Hadoop's file system."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and text (null: empty); other columns, whatever their names, are left out."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def rows_of(batches: Iterator[pa.RecordBatch], most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches of about `most` bytes (one row at least), so that Python holds little at once."""
    for b in batches:
        if not b.num_rows:
            continue
        step = max(1, int(b.num_rows * most / max(b.nbytes, 1)))
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)


_caches: list[dict] = []


def worker_cache() -> dict:
    """A dictionary that a module keeps in its Python workers."""
    _caches.append({})
    return _caches[-1]


def only(cache: dict) -> dict:
    """Empties all other modules' caches and gives their memory back to the system: workers live on from one operator to
    the next, and hold one operator's data."""
    if any(c for c in _caches if c is not cache):
        for c in _caches:
            if c is not cache:
                c.clear()
        gc.collect()
        give_back()
    return cache


def give_back() -> None:
    """Gives memory that nothing uses back to the system."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches. What is free after each goes back to the system: Arrow and malloc would keep it, in idle workers too."""
    for b in batches:
        yield b
        give_back()


def small_batches(spark: SparkSession) -> None:
    """Unless the session says otherwise, rows reach Python by the thousand: texts may be long."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, "1000")
