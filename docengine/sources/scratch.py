"""Tables that a job writes for itself, in the folder that driver and executors share.

A written table cuts the lineage, so a lost executor costs the tasks of one step. Tables go when the scope that they were
written in ends, at the latest with the driver's JVM.
"""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_scopes: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where that is unset, a temporary one, and only if everything runs on one machine."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors can reach")
        found = f"file://{tempfile.mkdtemp(prefix='docengine-')}"
        context.setCheckpointDir(found)
    return found.rstrip("/")


def _filesystem(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def folder(spark: SparkSession) -> str:
    """A new folder's path; what is put there goes with the scope."""
    path = f"{shared_dir(spark)}/docengine-{os.getpid()}-{uuid.uuid4().hex}"
    where, files = _filesystem(spark, path)
    files.deleteOnExit(where)
    if _scopes:
        _scopes[-1].append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    where, files = _filesystem(spark, path)
    files.delete(where, True)


def _plain(path: str) -> dict[str, str]:
    """Options by which a local folder gets files without checksums beside them.

    Where Hadoop has no native library, it sets modes by starting chmod, three times for a file with checksums and its folder;
    while the executor's JVM starts a process, its memory counts twice.
    """
    local = path.startswith("file:") or path.startswith("/")
    return {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"} if local else {}


def materialize(df: DataFrame, files: int | None = None) -> DataFrame:
    """Writes df as Parquet in the shared folder, into that many files at most, and reads it again."""
    spark, path = df.sparkSession, folder(df.sparkSession)
    (df if files is None else df.coalesce(files)).write.options(**_plain(path)).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes tables that materialize() wrote; nothing that is still to be computed may read them."""
    for df in tables:
        remove(df.sparkSession, df._scratch_path)


@contextlib.contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Removes at its end what was written in it. Results must be written or collected before."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            remove(spark, path)
