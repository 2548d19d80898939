"""File-system steps of a job, through the Hadoop API that also serves the data."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _path(spark, path)
    return fs.exists(target)


def rename(spark: SparkSession, source: str, target: str) -> None:
    fs, src = _path(spark, source)
    if not fs.rename(src, _path(spark, target)[1]):
        raise OSError(f"could not move {source} to {target}")


def move(spark: SparkSession, source: str, target: str, replace: bool = False) -> None:
    """Move a folder; one it replaces is kept aside until the new one is in place, and put back on failure."""
    fs, dst = _path(spark, target)
    aside = None
    if fs.exists(dst):
        if not replace:
            raise FileExistsError(f"output already exists: {target}")
        aside = f"{target.rstrip('/')}.replaced-{uuid.uuid4().hex[:12]}"
        rename(spark, target, aside)
    elif dst.getParent() is not None:
        fs.mkdirs(dst.getParent())
    try:
        rename(spark, source, target)
    except Exception:
        if aside:
            rename(spark, aside, target)
        raise
    if aside:
        delete(spark, aside)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file under a new name, then put it in place in one step."""
    fs, target = _path(spark, path)
    fresh = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.new")
    out = fs.create(fresh, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    context = hadoop.FileContext.getFileContext(fs.makeQualified(target).toUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    options[0] = hadoop.Options.Rename.OVERWRITE
    context.rename(fs.makeQualified(fresh), fs.makeQualified(target), options)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder of a job's own; nothing happens when it is not there."""
    fs, target = _path(spark, path)
    fs.delete(target, True)


def qualified(spark: SparkSession, path: str) -> str:
    """Full URI of a path, so that tasks resolve it as the driver does."""
    fs, target = _path(spark, path)
    return fs.makeQualified(target).toString()
