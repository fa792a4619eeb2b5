"""What the operators of this subpackage share: the shared folder, materialised tables, word rules."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import os
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that parts words: blank and the five ASCII controls from tab to carriage return.
GAP = r"[\x20\x09-\x0D]+"
GAP_CHARS = " \t\n\x0b\x0c\r"
_OWN: dict[str, str] = {}
_CACHES: dict[str, Callable[[], None]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where the setting is absent in a local session, as in tests, one temporary folder per process stands in; a
    cluster has no such folder, and so it is an error there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if "tmp" not in _OWN:
            _OWN["tmp"] = tempfile.mkdtemp(prefix="seriesmill-")
            import shutil

            atexit.register(shutil.rmtree, _OWN["tmp"], True)
        base = f"file://{_OWN['tmp']}"
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._seriesmill_path = path
    return out


def drop(df: DataFrame | None) -> None:
    """Delete the files of a table made by materialise(), once nothing reads it any more."""
    path = getattr(df, "_seriesmill_path", None)
    if path:
        remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing reads any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def free(spark: SparkSession) -> None:
    """Let go of the shuffle files of jobs that are over: Spark deletes them once the driver has collected their handles."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch may hold, so that very long texts fit a Python worker.

    The bound is the same for every operator: a plan that runs late meets the limits that it was built with.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 6 << 20)


def turn_to(operator: str, forget: Callable[[], None] | None = None) -> None:
    """In a Python worker, which outlives its tasks: lets go of what other operators have cached there.

    forget: what lets go of this operator's own cache once another one is turned to.
    """
    for name in [x for x in _CACHES if x != operator]:
        _CACHES.pop(name)()
    if forget:
        _CACHES[operator] = forget


def give_back() -> None:
    """In a Python worker at the end of a task: memory that is free, but still held by allocators, goes to the system."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of maximal runs of non-gap characters, without Python; null counts 0."""
    t = F.coalesce(text, F.lit(""))
    gaps = list(GAP_CHARS)
    ends = F.when(F.length(t) == 0, 1).otherwise(
        F.substring(t, 1, 1).isin(gaps).cast("int") + F.substring(t, -1, 1).isin(gaps).cast("int")
    )
    return (F.size(F.split(t, GAP)) - ends).cast("long")


def text_keys(text: Column) -> list[Column]:
    """t1, t2: two independent 64-bit hashes that stand for a text; null counts as empty."""
    t = F.coalesce(text, F.lit(""))
    return [F.xxhash64(t).alias("t1"), F.xxhash64(F.lit(7), t).alias("t2")]


def in_bucket(doc_id: Column, parts: int, rest: int) -> Column:
    """Whether crc32 of doc_id as text leaves this remainder; a null id counts as the text 'null'."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")) % parts == rest


# --- files that Python on the executors writes and reads ---------------------------------------------------


def open_fs(uri: str):
    """(pyarrow file system, path) of a URI or a plain path."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


class ShardFile:
    """A file that appears under its final name only when it is complete: retries never leave half of one."""

    def __init__(self, folder: str, suffix: str):
        self.fs, base = open_fs(folder)
        self.fs.create_dir(base, recursive=True)
        name = uuid.uuid4().hex
        self.tmp, self.path = f"{base}/.{name}.tmp", f"{base}/{name}{suffix}"
        self.uri = f"{folder}/{name}{suffix}"
        self.out, self.size = self.fs.open_output_stream(self.tmp), 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def commit(self) -> str:
        self.out.close()
        self.fs.move(self.tmp, self.path)
        return self.uri


def basename(uri: str) -> str:
    return os.path.basename(uri)
