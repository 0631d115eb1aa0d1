"""Shared folders, written intermediate tables and remote files for the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import posixpath
import re
import tempfile
import uuid
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession

#: One word of a text: a run without space, tab, newline, vertical tab, form feed or carriage return.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where the session names none and runs on one machine, as in tests, a temporary folder is chosen, and it is
    kept for the life of the session so that the tables in it can be read again.  On a cluster it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not hasattr(context, "_notewell_shared"):
        context._notewell_shared = "file://" + tempfile.mkdtemp(prefix="notewell-")
    return context._notewell_shared


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, lineage cut, safe against lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Removes a table that ``written`` made and that nothing reads any more."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(posixpath.dirname(file))
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The pyarrow file system of ``uri`` (file, hdfs, s3, gs) and the path within it."""
    if urlsplit(uri).scheme in ("", "file"):
        return pafs.LocalFileSystem(), urlsplit(uri).path
    return pafs.FileSystem.from_uri(uri)


def public_name(uri: str, name: str) -> str:
    return f"{uri.rstrip('/')}/{name}"


class Publisher:
    """A file written under a task's own name and moved to its final one at the end.

    The final name must be one that no other attempt of the task uses.
    """

    def __init__(self, uri: str, name: str):
        self.fs, base = filesystem(uri)
        self.fs.create_dir(base, recursive=True)
        self.final = posixpath.join(base, name)
        self.temporary = f"{self.final}.{uuid.uuid4().hex}.part"
        self.sink = self.fs.open_output_stream(self.temporary)
        self.size = 0

    def write(self, data: bytes) -> int:
        """Appends ``data`` and returns the offset at which it begins."""
        at = self.size
        self.sink.write(data)
        self.size += len(data)
        return at

    def close(self) -> None:
        self.sink.close()
        self.fs.move(self.temporary, self.final)

    def abandon(self) -> None:
        self.sink.close()
        self.fs.delete_file(self.temporary)


def give_back_memory() -> None:
    """Returns what a finished task has freed to the system: a worker is used again, and the heap keeps its peak else."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        # Only the GNU C library has it; elsewhere there is nothing to do.
        ctypes.CDLL("libc.so.6").malloc_trim(0)
