"""Many small files of one folder: a task lists it, and tasks open what a table of names tells them to.

Spark's own file sources cost a split's worth of planning for each file, and a listing job for a list of
paths; with one small file a track that is most of a compile. Folders that Arrow's file systems cannot open
(``reachable``) are left to those sources.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.paths import qualified
from .files import dealt, open_uri

LISTED_ROWS = 10_000
TEXT_BYTES = 16 << 20  # of texts handed on at a time, or one larger text


def reachable(spark: SparkSession, folder: str) -> str | None:
    """The folder's URI if tasks can list and open it, else None."""
    uri = qualified(spark, folder)
    try:
        fs, path = open_uri(uri)
        return uri if fs.get_file_info(path).type == pafs.FileType.Directory else None
    except (OSError, ValueError, NotImplementedError):
        return None


def listed(spark: SparkSession, uri: str) -> DataFrame:
    """(file_name, byte_size) of a folder's files but hidden ones, by one task; contents are not read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for folder in batch["uri"]:
                fs, path = open_uri(folder)
                found = fs.get_file_info(pafs.FileSelector(path))
                files = [(f.base_name, f.size) for f in found if f.type == pafs.FileType.File and f.base_name[0] not in "._"]
                for i in range(0, len(files), LISTED_ROWS):
                    yield pd.DataFrame(files[i : i + LISTED_ROWS], columns=["file_name", "byte_size"])

    one = spark.range(0, 1, 1, 1).select(F.lit(uri).alias("uri"))
    return one.mapInPandas(run, "file_name string, byte_size long")


def _dealt(names: DataFrame) -> DataFrame:
    """Names over a fixed number of tasks: they are few bytes, but each is a file to open."""
    return dealt(names.select("file_name").distinct(), "file_name")


def checksums(names: DataFrame, uri: str) -> DataFrame:
    """(file_name, source_checksum) of the named files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, folder = open_uri(uri)
        for batch in batches:
            sums = []
            for name in batch["file_name"]:
                sha = hashlib.sha256()
                with fs.open_input_stream(f"{folder}/{name}", compression=None) as stream:
                    while chunk := stream.read(8 << 20):
                        sha.update(chunk)
                sums.append(sha.hexdigest())
            yield pd.DataFrame({"file_name": batch["file_name"], "source_checksum": sums})

    return _dealt(names).mapInPandas(run, "file_name string, source_checksum string")


def texts(names: DataFrame, uri: str) -> DataFrame:
    """(file, text) of the named files, gzipped ones unpacked."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, folder = open_uri(uri)
        for batch in batches:
            held, size = [], 0
            for name in batch["file_name"]:
                with fs.open_input_stream(f"{folder}/{name}", compression=None) as stream:
                    content = stream.read()
                content = gzip.decompress(content) if name.lower().endswith(".gz") else content
                held.append((name, content))
                size += len(content)
                if size >= TEXT_BYTES:
                    yield pd.DataFrame(held, columns=["file", "content"])
                    held, size = [], 0
            yield pd.DataFrame(held, columns=["file", "content"])

    read = _dealt(names).mapInPandas(run, "file string, content binary")
    return read.select("file", F.col("content").cast("string").alias("text"))
