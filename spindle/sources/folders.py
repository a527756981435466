"""Folders on any file system that Spark knows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession


def _system(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def children(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder; none if it is not there."""
    folder, system = _system(spark, path)
    if not system.exists(folder):
        return []
    return sorted(entry.getPath().getName() for entry in system.listStatus(folder))


def remove(spark: SparkSession, path: str) -> None:
    folder, system = _system(spark, path)
    system.delete(folder, True)


def put(spark: SparkSession, path: str) -> None:
    """An empty file, with the folders above it. It is there or not: readers never
    see a part of it."""
    folder, system = _system(spark, path)
    system.create(folder, True).close()


def replaced(spark: SparkSession, path: str, write: Callable[[str], object]) -> str:
    """Write a folder anew beside the one that is there, and put it in its place
    when it is whole. If writing fails, the old one stays as it was. Names that
    begin with `_` are not read as data."""
    parent, _, name = path.rstrip("/").rpartition("/")
    mark = uuid.uuid4().hex
    fresh, old = f"{parent}/_new-{mark}/{name}", f"{parent}/_old-{mark}/{name}"
    try:
        write(fresh)
        target, system = _system(spark, path)
        as_path = lambda p: _system(spark, p)[0]
        if system.exists(target):
            system.mkdirs(as_path(old).getParent())
            if not system.rename(target, as_path(old)):
                raise OSError(f"{path} could not be moved")
        if not system.rename(as_path(fresh), target):
            if system.exists(as_path(old)):
                system.rename(as_path(old), target)
            raise OSError(f"{path} could not be put in place")
    finally:
        remove(spark, f"{parent}/_new-{mark}")
    remove(spark, f"{parent}/_old-{mark}")
    return path
