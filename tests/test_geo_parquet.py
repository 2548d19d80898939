import glob
import json

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from pathfold.plans.writers import write_geo
from pathfold.sources.files import row_group_facts


def test_row_groups_files_and_footer(spark, tmp_path):
    i = F.col("id")
    rows = spark.range(300).select(
        F.concat(F.lit("a"), i).alias("activity_id"),
        (i / 10).alias("xmin"),
        (i / 20).alias("ymin"),
        (i / 10 + 1).alias("xmax"),
        (i / 20 + 1).alias("ymax"),
        F.array(F.array(i / 10, i / 20), F.array(i / 10 + 1, i / 20 + 1)).alias("geometry"),
        F.lit(2).cast("long").alias("vertex_count"),
        F.when(i < 130, "run").otherwise("ride").alias("family"),
    )
    ordered = rows.repartitionByRange(2, "family", "xmin").sortWithinPartitions("family", "xmin")
    path = f"{tmp_path}/data/activities"
    write_geo(ordered, path, partition="family", group_rows=16, file_rows=40)
    files = glob.glob(f"{path}/family=*/*.parquet")
    sizes = {f: pq.ParquetFile(f).metadata for f in files}
    assert sum(m.num_rows for m in sizes.values()) == 300
    assert all(m.num_rows <= 40 for m in sizes.values())
    groups = [[m.row_group(g).num_rows for g in range(m.num_row_groups)] for m in sizes.values()]
    assert all(set(g[:-1]) <= {16} for g in groups) and [16, 16, 8] in groups
    footer = json.loads(pq.ParquetFile(files[0]).metadata.metadata[b"geo"])
    box = footer["columns"]["geometry"]["bbox"]
    table = pq.read_table(files[0])
    assert box[0] == min(table["xmin"].to_pylist()) and box[2] == max(table["xmax"].to_pylist())
    back = spark.read.parquet(path)
    assert dict(back.dtypes)["geometry"] == "array<array<double>>"
    assert back.where("family = 'run'").count() == 130
    assert back.select("activity_id").exceptAll(rows.select("activity_id")).count() == 0
    facts = row_group_facts(spark, f"{tmp_path}/data", "activities")
    total = facts.agg(F.sum("row_count"), F.sum("vertex_count_sum"), F.min("geo")).first()
    assert tuple(total) == (300, 600, True)
    assert not glob.glob(f"{path}/_staging*")
    with pytest.raises(FileExistsError):
        write_geo(ordered, path)


def test_groups_close_on_key_change(spark, tmp_path):
    i = F.col("id")
    rows = spark.range(0, 50, 1, 1).select(
        F.lit(0.0).alias("xmin"), F.lit(0.0).alias("ymin"), F.lit(1.0).alias("xmax"), F.lit(1.0).alias("ymax"),
        F.array(F.array(F.lit(0.0), F.lit(0.0))).alias("geometry"),
        (i >= 30).cast("int").alias("lod"), F.floor(i / 7).alias("group_no"),
    )
    path = f"{tmp_path}/r"
    write_geo(rows.sortWithinPartitions("lod", "group_no"), path, partition="lod", group="group_no")
    counts = {}
    for f in glob.glob(f"{path}/lod=*/*.parquet"):
        meta = pq.ParquetFile(f).metadata
        counts[f.split("lod=")[1][0]] = [meta.row_group(g).num_rows for g in range(meta.num_row_groups)]
    assert counts == {"0": [7, 7, 7, 7, 2], "1": [5, 7, 7, 1]}
