"""Places that every executor shares, and files written there by tasks.

The base folder is ``spark.checkpoint.dir`` of the session. Where that is unset, a local session gets a
folder of this machine; any other session gets an error, as its executors could not see such a folder. Files are written through ``pyarrow.fs``, so the
base may be any URI that it opens. A task writes under a name of its own and reports it; files that no
manifest names belong to attempts that failed and are never read.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

_fallback: list[str] = []
#: Work folders in the order in which they were named.
made: list[str] = []


def shared_base(spark: SparkSession) -> str:
    """The folder shared by driver and executors."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _fallback:
        _fallback.append(tempfile.mkdtemp(prefix="crestline-"))
        spark.sparkContext.setCheckpointDir(_fallback[0])
    return _fallback[0]


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared base."""
    made.append(f"{shared_base(spark)}/{name}-{uuid.uuid4().hex}")
    return made[-1]


def written(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` as Parquet and read it back: the lineage ends at the files."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_dir(spark: SparkSession, path: str) -> None:
    """Remove a work folder that no returned result reads."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def drop_since(spark: SparkSession, mark: int) -> None:
    """Remove the work folders named after the first ``mark``, once nothing reads them any more."""
    for path in made[mark:]:
        drop_dir(spark, path)
    del made[mark:]


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of results that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def give_back() -> None:
    """At the end of a task: free memory that this Python worker would hold on to while it waits goes to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI or an absolute local path."""
    return pafs.FileSystem.from_uri(uri)


def put(folder: str, stem: str, data: bytes) -> str:
    """Write a file of this attempt's own and return its name for ``get``."""
    fs, root = open_fs(folder)
    fs.create_dir(root, recursive=True)
    name = unique_name(stem)
    with fs.open_output_stream(f"{root}/{name}", compression=None) as out:
        out.write(data)
    return f"{folder}/{name}"


def get(uri: str) -> bytes:
    fs, path = open_fs(uri)
    with fs.open_input_stream(path, compression=None) as f:
        return f.read()


def unique_name(stem: str) -> str:
    """A file name that no other attempt of the same task uses."""
    return f"{stem}-{uuid.uuid4().hex}"
