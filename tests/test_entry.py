import glob
import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
import check

D = "/root/testdata/sf0.001"


def test_contract(spark):
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 90
    out = entry.entry(spark)
    assert out.count() == 1 and "activity_count" in out.columns


@pytest.mark.parametrize(
    "name",
    ["track_summary", "selection_summary", "heat_scores", "simplify_m", "polygon_within", "nearest_route", "registry_rollup", "record_merge"],
)
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{D}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    got = entry.queries()[name](spark, D).toPandas()
    want = con.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert check.canon(got) == check.canon(want) and len(got) > 0


ROOT = os.path.dirname(os.path.abspath(entry.__file__))
COUNT = "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') for n in e.queries()))"


@pytest.mark.parametrize("missing", ["folder", "modules", "package"])
def test_entry_without_the_optional_part(tmp_path, missing):
    """Its folder gone, only compiled leftovers of it there, or the tokenizer package not installed."""
    here = tmp_path / "repo"
    shutil.copytree(ROOT, here, ignore=shutil.ignore_patterns(".git", "tests", ".scratch", "spark-warehouse"))
    code = COUNT
    if missing == "package":
        code = "import sys; sys.modules['public_tokenizers'] = None; " + code
    else:
        (here / "corpus_pipeline.py").unlink(missing_ok=True)
        shutil.rmtree(here / "pathfold" / "llm", ignore_errors=True)
        if missing == "modules":
            (here / "pathfold" / "llm" / "__pycache__").mkdir(parents=True)
    done = subprocess.run([sys.executable, "-c", code], cwd=here, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]
    count, optional = done.stdout.split()
    assert int(count) > 100 and optional == "False"
