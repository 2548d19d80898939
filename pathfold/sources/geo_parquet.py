"""GeoParquet sink: Spark tasks write files with exact row groups and a ``geo`` footer.

``df.write.format("pathfold_geo")`` expects rows sorted by the partition and group columns.
Options: ``path``; ``partition`` (one column, becomes folders); ``group`` (comma-separated
columns whose change closes a row group); ``group_rows``, ``file_rows``, ``file_bytes``.

A task writes its files where they stay, under names of its own attempt, and the commit writes the
list of those that count to ``_files``. No file is moved, and what a lost attempt has left behind
is on no list.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    WriterCommitMessage,
)

from ..schema import BOUNDS
from .files import open_uri

FORMAT = "pathfold_geo"
LISTS = "_files"
LINE = pa.list_(pa.list_(pa.float64(), 2))
LINE_METADATA = {
    "ARROW:extension:name": "geoarrow.linestring",
    "ARROW:extension:metadata": json.dumps({"crs": "OGC:CRS84"}),
}


def geo_footer(bounds: list[float], columns: list[str]) -> dict:
    """GeoParquet 1.1 description of line columns and the bounds columns that cover them."""
    described = {}
    for name in columns:
        prefix = "clean_" if name.startswith("geometry_clean") else ""
        described[name] = {
            "encoding": "linestring",
            "geometry_types": ["LineString"],
            "bbox": bounds,
            "covering": {"bbox": {b: [f"{prefix}{b}"] for b in BOUNDS}},
        }
    return {"version": "1.1.0", "primary_column": "geometry", "columns": described}


def _typed(table: pa.Table) -> pa.Table:
    """Line columns as fixed pairs, marked as GeoArrow lines."""
    fields = [
        pa.field(f.name, LINE, metadata=LINE_METADATA) if f.name.startswith("geometry") else f
        for f in table.schema
    ]
    return table.cast(pa.schema(fields))


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class _Output:
    """The open file of a task; a new one starts at a partition change or when full."""

    def __init__(self, fs, base: str, stem: str, file_rows: int, file_bytes: int):
        self.fs, self.base, self.stem = fs, base, stem
        self.file_rows, self.file_bytes = file_rows, file_bytes
        self.files: list[str] = []
        self.writer = None

    def room(self) -> int:
        return self.file_rows - (self.rows if self.writer else 0)

    def add(self, folder: str, group: pa.Table) -> None:
        size = group.nbytes
        if self.writer and (folder != self.folder or self.bytes + size > self.file_bytes):
            self.close()
        group = _typed(group)
        if self.writer is None:
            name = f"{self.stem}-{len(self.files):05d}.parquet"
            self.folder, self.rows, self.bytes = folder, 0, 0
            self.box = [np.inf, np.inf, -np.inf, -np.inf]
            self.fs.create_dir(f"{self.base}/{folder}")
            self.files.append(f"{folder}/{name}".removeprefix("./"))
            self.sink = self.fs.open_output_stream(f"{self.base}/{self.files[-1]}")
            self.writer = pq.ParquetWriter(self.sink, group.schema, compression="zstd")
            self.lines = [n for n in group.schema.names if n.startswith("geometry")]
        self.writer.write_table(group, row_group_size=group.num_rows)
        self.rows, self.bytes = self.rows + group.num_rows, self.bytes + size
        low = [pc.min(group[b]).as_py() for b in BOUNDS[:2]]
        high = [pc.max(group[b]).as_py() for b in BOUNDS[2:]]
        self.box = [*np.minimum(self.box[:2], low).tolist(), *np.maximum(self.box[2:], high).tolist()]
        if self.rows >= self.file_rows:
            self.close()

    def close(self) -> None:
        if self.writer is not None:
            footer = json.dumps(geo_footer(self.box, self.lines), separators=(",", ":"))
            self.writer.add_key_value_metadata({"geo": footer})
            self.writer.close()
            self.sink.close()
            self.writer = None


class GeoParquetWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.partition = options.get("partition")
        self.group = [g for g in options.get("group", "").split(",") if g]
        self.group_rows = int(options.get("group_rows", 1 << 40))
        self.file_rows = int(options.get("file_rows", 1 << 40))
        self.file_bytes = int(options.get("file_bytes", 1 << 30))
        self.job = uuid.uuid4().hex

    def _runs(self, table: pa.Table) -> list[tuple[int, int]]:
        """Row ranges with equal partition and group values."""
        change = np.zeros(table.num_rows, dtype=bool)
        change[0] = True
        for name in [self.partition, *self.group]:
            if name and table.num_rows > 1:
                column = table[name].combine_chunks()
                differs = pc.not_equal(column.slice(1), column.slice(0, len(column) - 1))
                change[1:] |= differs.to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(change)
        return list(zip(starts, [*starts[1:], table.num_rows], strict=True))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, base = open_uri(self.path)
        context = TaskContext.get()
        stem = f"part-{context.partitionId():05d}-{self.job[:8]}-{context.taskAttemptId()}"
        out = _Output(fs, base, stem, self.file_rows, self.file_bytes)
        drop = [c for c in (self.partition, *self.group) if c]
        pending: list[pa.Table] = []
        key = folder = None
        held = 0

        def flush(everything: bool) -> None:
            nonlocal pending, held
            while held:
                size = min(self.group_rows, out.room())
                if held < size and not everything:
                    return
                whole = pa.concat_tables(pending).combine_chunks()
                out.add(folder, whole.slice(0, size))
                rest = whole.slice(size)
                pending, held = ([rest], rest.num_rows) if rest.num_rows else ([], 0)

        for batch in iterator:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            for start, stop in self._runs(table):
                now = tuple(table[c][int(start)].as_py() for c in drop)
                if key is not None and now != key:
                    flush(True)
                    if self.partition and now[0] != key[0]:
                        out.close()
                key = now
                folder = f"{self.partition}={now[0]}" if self.partition else "."
                pending.append(table.slice(start, stop - start).drop_columns(drop))
                held += stop - start
                flush(False)
        flush(True)
        out.close()
        return Written(out.files)

    def commit(self, messages: list[Written]) -> None:
        fs, base = open_uri(self.path)
        names = "".join(f"{name}\n" for message in messages if message for name in message.files)
        fs.create_dir(f"{base}/{LISTS}")
        fresh = f"{base}/{LISTS}/.{self.job}"
        with fs.open_output_stream(fresh) as out:
            out.write(names.encode())
        fs.move(fresh, f"{base}/{LISTS}/{self.job}.txt")  # the list appears whole

    def abort(self, messages: list[Written]) -> None:
        fs, base = open_uri(self.path)
        for message in messages:
            for name in message.files if message else []:
                fs.delete_file(f"{base}/{name}")


class GeoParquetSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema, overwrite: bool) -> GeoParquetWriter:
        return GeoParquetWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GeoParquetSource)
