import glob
import os
import random

import duckdb
import pytest

import __spark_entry__ as entry
import check
import corpus_pipeline
from pathfold.llm import queries as llm

from .helpers import fresh, linked

D = "/root/testdata/sf0.001"


def test_each_operator_has_a_query():
    names = entry.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names
    assert set(llm.ORACLES) <= set(llm.QUERIES) and corpus_pipeline.ORACLE_SQL is None


@pytest.mark.parametrize("name", sorted(llm.ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{D}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    got, want = llm.QUERIES[name](spark, D).toPandas(), con.execute(llm.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and check.canon(got) == check.canon(want) and len(got)


@pytest.mark.parametrize("name", sorted(set(llm.QUERIES) - set(llm.ORACLES)))
def test_query_covers_all_documents(spark, name):
    out = llm.QUERIES[name](spark, D)
    ids = [r.doc_id for r in out.select("doc_id").collect()]
    assert sorted(ids) == [r.doc_id for r in spark.read.parquet(f"{D}/documents.parquet").select("doc_id").orderBy("doc_id").collect()]


def test_stages_on_odd_documents(spark, tmp_path):
    rng = random.Random(3)
    base = [fresh(rng, 90) for _ in range(12)]
    line = "Every one of these documents ends with this line"
    rows = [(i, f"n{i} {base[i % 12]}\n{line}" if i % 2 else f"n{i} {base[i % 12]} more", ["en", None, "de"][i % 3], ["a", "a", None][i % 3], 0) for i in range(60)]
    rows += [(100, None, "en", "a", None), (101, "", None, None, 0), (102, "too short", "en", "a", 9), (103, "spam spam " * 500, "en", "b", 1), (7, *rows[7][1:])]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, after = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        after[name] = docs.collect()
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == corpus_pipeline.COLUMNS
    assert {100, 101, 102, 103}.isdisjoint(r.doc_id for r in after["quality_rules"]) and len(after["quality_rules"]) == 61
    texts = [r.text for r in after["line_dedup"]]
    assert len(texts) == 61 and sum(line in t for t in texts) == 1 and all(r.n_chars == len(r.text) for r in after["line_dedup"])
    want = linked([(r.doc_id, r.text) for r in after["line_dedup"]], 5, 80)
    assert sorted(r.doc_id for r in after["ngram_join"]) == sorted({c for _, c in want.values()}) == list(range(12))
    assert {r.doc_id for r in after["source_mix"]} <= {r.doc_id for r in after["ngram_join"]}
    assert all(r.round_trip and r.n_pieces == len(r.ids) for r in after["piece_codec"]) and len(after["piece_codec"]) == len(after["source_mix"])
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted((r.doc_id, r.n_pieces) for r in whole.collect()) == sorted((r.doc_id, r.n_pieces) for r in after["piece_codec"])


def test_stages_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_a_run_leaves_one_stage_table(spark, tmp_path, monkeypatch):
    """What only earlier stages read is deleted."""
    made = []
    monkeypatch.setattr(corpus_pipeline, "scratch_path", lambda spark, label: made.append(f"{tmp_path}/{label}-{len(made)}") or made[-1])
    assert corpus_pipeline.run(spark, D).count() > 0
    assert len(made) == 4 and [os.path.exists(p) for p in made] == [False, False, False, True]
