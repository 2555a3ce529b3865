"""Folders that all executors share, for tables in between and for what is kept."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_local: list[str] = []
_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, in local mode alone, one temporary folder of the process."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="silvae-"))
        there = f"file://{_local[0]}"
    return there.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/silvae-{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path as it takes it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder; none if it is not there."""
    fs, at = system(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory()) if fs.exists(at) else []


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = system(spark, path)
    return fs.exists(at)


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, written aside and then moved to its name, so that it is there whole or not at all."""
    fs, at = system(spark, path)
    aside = at.suffix(f".{uuid.uuid4().hex}")
    out = fs.create(aside, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(at, False)
    if not fs.rename(aside, at):
        raise OSError(f"could not write {path}")


def get_text(spark: SparkSession, path: str) -> str | None:
    """What a small file says; None if it is not there."""
    fs, at = system(spark, path)
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def remove(spark: SparkSession, path: str) -> None:
    fs, at = system(spark, path)
    fs.delete(at, True)


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        with contextlib.suppress(Exception):
            if spark.sparkContext._jsc is not None:
                remove(spark, path)
    for path in _local:
        shutil.rmtree(path, ignore_errors=True)
