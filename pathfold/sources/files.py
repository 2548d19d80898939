"""Facts about written Parquet files, gathered by tasks (one file each)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import plain_path
from ..plans.paths import qualified

VERTEX = ("vertex_count", "clean_vertex_count")
FACTS = (
    "kind string, path string, byte_size long, sha256 string, geo boolean, row_group int, row_count long, "
    "uncompressed_bytes long, xmin double, ymin double, xmax double, ymax double, "
    + ", ".join(f"{v}_{s} long" for v in VERTEX for s in ("sum", "min", "max"))
)


def open_uri(uri: str):
    """File system and path of a URI (``file:/x`` as Spark writes it, or ``scheme://host/x``)."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[len("file:") :].lstrip("/")
    for alias in ("s3a://", "s3n://"):
        if uri.startswith(alias):
            uri = "s3://" + uri[len(alias) :]
    return pafs.FileSystem.from_uri(uri)


def _digest(fs, path: str) -> tuple[str, int]:
    sha, size = hashlib.sha256(), 0
    with fs.open_input_stream(path) as stream:
        while chunk := stream.read(8 << 20):
            sha.update(chunk)
            size += len(chunk)
    return sha.hexdigest(), size


def _facts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Checksum and per-row-group facts; only bounds and count columns are decoded."""
    for batch in batches:
        for kind, name, uri in zip(batch["kind"], batch["path"], batch["uri"]):
            fs, path = open_uri(uri)
            sha, size = _digest(fs, path)
            rows = []
            with fs.open_input_file(path) as handle:
                parquet = pq.ParquetFile(handle)
                names = set(parquet.schema_arrow.names)
                described = b"geo" in (parquet.metadata.metadata or {})
                wanted = [c for c in ("xmin", "ymin", "xmax", "ymax", *VERTEX) if c in names]
                for number in range(parquet.num_row_groups):
                    meta = parquet.metadata.row_group(number)
                    t = parquet.read_row_group(number, columns=wanted).to_pandas()
                    row = {
                        "kind": kind,
                        "path": name,
                        "byte_size": size,
                        "sha256": sha,
                        "geo": described,
                        "row_group": number,
                        "row_count": meta.num_rows,
                        "uncompressed_bytes": meta.total_byte_size,
                        "xmin": t["xmin"].min(),
                        "ymin": t["ymin"].min(),
                        "xmax": t["xmax"].max(),
                        "ymax": t["ymax"].max(),
                    }
                    for v in VERTEX:
                        has = v in t
                        row[f"{v}_sum"] = int(t[v].sum()) if has else None
                        row[f"{v}_min"] = int(t[v].min()) if has else None
                        row[f"{v}_max"] = int(t[v].max()) if has else None
                    rows.append(row)
            out = pd.DataFrame(rows)
            for v in VERTEX:
                for s in ("sum", "min", "max"):
                    out[f"{v}_{s}"] = out[f"{v}_{s}"].astype("Int64")
            yield out


def dealt(names: DataFrame, key: str) -> DataFrame:
    """Rows over a fixed number of tasks, whatever their bytes: a listing is tiny, but each file is work.

    Dealt by a hash of the key, as distinct keys are already partitioned by the key itself: Spark would
    drop the same partitioning again, and then join the small partitions to one task.
    """
    spark = names.sparkSession
    tasks = max(
        spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))
    )
    return names.repartition(tasks, F.xxhash64(key))


def _uris(spark: SparkSession, root: str, kinds: tuple[str, ...]) -> DataFrame:
    """(kind, path, uri) of every Parquet file that counts under ``root`` of these kinds, dealt to tasks together.

    ``path`` begins with the kind.
    """
    from .dataset import listed_files  # reads what this module describes

    out = None
    for kind in kinds:
        listed = listed_files(spark, root, kind)
        if listed is not None:
            listed = listed.select(F.concat(F.lit(f"{qualified(spark, root)}/"), "path").alias("uri")).distinct()
        else:
            listed = (
                spark.read.format("binaryFile")
                .option("recursiveFileLookup", "true")
                .option("pathGlobFilter", "*.parquet")
                .load(f"{root}/{kind}")
                .select(plain_path("path").alias("uri"))
            )
        marker = f"/{kind}/"
        inside = F.expr(f"substring(uri, length(uri) - length(substring_index(uri, '{marker}', -1)) + 1)")
        listed = listed.select(F.lit(kind).alias("kind"), F.concat(F.lit(f"{kind}/"), inside).alias("path"), "uri")
        out = listed if out is None else out.unionByName(listed)
    return dealt(out, "uri")


def _sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        sums = [_digest(*open_uri(uri))[0] for uri in batch["uri"]]
        yield pd.DataFrame({"path": batch["path"], "sha256": sums})


def file_sums(spark: SparkSession, root: str, *kinds: str) -> DataFrame:
    """(path, sha256) of every Parquet file that counts under ``root`` of these kinds."""
    return _uris(spark, root, kinds).mapInPandas(_sums, "path string, sha256 string")


def row_group_facts(spark: SparkSession, root: str, *kinds: str) -> DataFrame:
    """One row per row group of every Parquet file that counts under ``root`` of these kinds."""
    return _uris(spark, root, kinds).mapInPandas(_facts, FACTS)


def copy_files(paths: DataFrame, source: str, target: str) -> None:
    """Copy files (path, relative to both folders) byte for byte, one task's share each."""
    spark = paths.sparkSession
    old, new = qualified(spark, source), qualified(spark, target)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                fs, there = open_uri(f"{old}/{path}")
                out_fs, here = open_uri(f"{new}/{path}")
                out_fs.create_dir(here.rsplit("/", 1)[0])
                with fs.open_input_stream(there) as stream, out_fs.open_output_stream(here) as out:
                    while chunk := stream.read(8 << 20):
                        out.write(chunk)
            yield batch[["path"]]

    spread = paths.select("path").repartition(spark.sparkContext.defaultParallelism)
    spread.mapInPandas(run, "path string").write.format("noop").mode("overwrite").save()


def remove_files(uris: DataFrame) -> int:
    """Delete files (uri); returns their number."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for uri in batch["uri"]:
                fs, path = open_uri(uri)
                try:
                    fs.delete_file(path)
                except FileNotFoundError:
                    pass  # by an earlier attempt
            yield pd.DataFrame({"n": [len(batch)]})

    return uris.select("uri").mapInPandas(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
