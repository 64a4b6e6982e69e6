"""Files that tasks open themselves, by path or by the address of a shared file system."""

from __future__ import annotations

import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

#: What the local file system is called in an address.
LOCAL = "file:"


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path within it. A path without a scheme is one of the shared local tree."""
    if path.startswith(LOCAL):
        # Spark's addresses don't escape characters; one, two and three slashes are the same.
        return fs.LocalFileSystem(), "/" + path[len(LOCAL) :].lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def listed(path: str) -> list[tuple[str, int, int]]:
    """(path, bytes, change in nanoseconds) of a file, or of a folder's files at any depth but hidden ones, by path."""
    system, inside = file_system(path)
    info = system.get_file_info(inside)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(inside, recursive=True))
    top = len(inside.rstrip("/"))
    hidden = lambda f: any(part[:1] in ("_", ".") for part in f.path[top:].split("/"))
    files = [f for f in found if f.type == fs.FileType.File and (f is info or not hidden(f))]
    prefix = path[: len(path) - len(inside)] if path.endswith(inside) else ""
    return sorted((prefix + f.path, f.size, int(f.mtime_ns or 0)) for f in files)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of this session's own only where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        kept = spark.sparkContext._jsc.sc().getCheckpointDir()
        if kept.isDefined():
            return kept.get()
        named = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has been written to."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: its lineage ends there, and its rows and their order in files stay the same."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
