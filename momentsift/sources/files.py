"""Folders and files in whatever store Spark reads: names, whole tables, staged writing."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _at(spark, path)
    return fs.exists(at)


def is_whole(spark: SparkSession, path: str) -> bool:
    """Was the table at ``path`` committed?"""
    return exists(spark, f"{path}/_SUCCESS")


def folder_names(spark: SparkSession, path: str) -> list[str]:
    fs, at = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory()) if fs.exists(at) else []


def file_paths(spark: SparkSession, path: str) -> list[str]:
    """The data files of a folder by name (hidden ones left out), or the one file at ``path``."""
    fs, at = _at(spark, path)
    if not fs.exists(at):
        return []
    found = [s.getPath() for s in fs.listStatus(at) if not s.isDirectory()]
    return [p.toString() for p in sorted(found, key=lambda p: p.getName()) if p.getName()[0] not in "._"]


def remove(spark: SparkSession, path: str) -> None:
    fs, at = _at(spark, path)
    fs.delete(at, True)


def rename(spark: SparkSession, path: str, target: str) -> None:
    fs, at = _at(spark, path)
    if not fs.rename(at, _at(spark, target)[1]):
        raise OSError(f"can't rename {path} to {target}")


def make_folder(spark: SparkSession, path: str) -> None:
    fs, at = _at(spark, path)
    fs.mkdirs(at)


def replace_table(spark: SparkSession, path: str, write: Callable[[str], None], check: Callable[[str], None] | None = None) -> None:
    """``write`` gets a folder beside ``path``; only what it has written whole, and ``check`` accepts, takes the place of the old table.

    The old table stands until then, and comes back if the last renaming fails.
    """
    staged, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    try:
        write(staged)
        if check:
            check(staged)
    except BaseException:
        remove(spark, staged)
        raise
    had = exists(spark, path)
    if had:
        rename(spark, path, old)
    try:
        rename(spark, staged, path)
    except BaseException:
        if had:
            rename(spark, old, path)
        raise
    if had:
        remove(spark, old)


def fingerprint(df: DataFrame) -> str:
    """Changes when a file that ``df`` reads does: names, sizes and times of all its files."""
    files = df.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    return files.selectExpr("cast(sum(cast(xxhash64(*) as decimal(38,0))) as string) as f").first()["f"] or ""
