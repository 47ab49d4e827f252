"""The folder that all executors share, and files in it by Hadoop's file system interface."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir.

    Where it is unset, a folder of our own in local mode, whose driver and executors are one process; an error elsewhere.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="pricewell-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """What runs within, and streams that start within, deletes its shuffle files as soon as a table is written.

    Else they stay until the driver drops what refers to them, at worst all to the end. A DataFrame that is run again works
    its shuffles out again.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def filed(spark: SparkSession, path: str):
    """(file system, path) as Hadoop's objects."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has yet; what is put there goes when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    files, where = filed(spark, path)
    files.deleteOnExit(where)
    return path


def listed(spark: SparkSession, path: str) -> list[tuple[str, int, bool]]:
    """(name, bytes, whether a folder) of what is in a folder; nothing if it isn't there."""
    files, where = filed(spark, path)
    if not files.exists(where):
        return []
    return [(s.getPath().getName(), s.getLen(), s.isDirectory()) for s in files.listStatus(where)]


def removed(spark: SparkSession, path: str) -> None:
    files, where = filed(spark, path)
    files.delete(where, True)


def moved(spark: SparkSession, path: str, to: str) -> bool:
    """Moves a folder to a place that nothing has yet; False if there is none."""
    files, where = filed(spark, path)
    _, there = filed(spark, to)
    if not files.exists(where):
        return False
    files.mkdirs(there.getParent())
    if not files.rename(where, there):
        raise OSError(f"{path} can't be moved to {to}")
    return True


def read_text(spark: SparkSession, path: str) -> str:
    files, where = filed(spark, path)
    stream = files.open(where)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def put_once(spark: SparkSession, path: str, text: str) -> bool:
    """Puts a whole file there at once by renaming; False, and nothing changed, if there is one."""
    files, where = filed(spark, path)
    _, part = filed(spark, f"{path}.{uuid.uuid4().hex}.part")
    if files.exists(where):
        return False
    stream = files.create(part, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    if files.rename(part, where) and not files.exists(part):
        return True
    files.delete(part, False)
    return False
