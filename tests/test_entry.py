"""Registered queries against their SQL in DuckDB, plans, streams, and that the subpackage can be taken away."""

import json
import os
import shutil
import subprocess
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sparkloom.functions import messages
from sparkloom.plans import queries as own
from sparkloom.sources.tables import read_csv
from sparkloom.streaming import apply as streaming

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DIR}/{f}'")
    return con


def norm(v):
    return repr(round(v, 9) + 0.0) if isinstance(v, float) else repr(v)


def same(df, con, sql):
    r = con.execute(sql)
    names = [d[0] for d in r.description]
    cols = sorted(df.columns)
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert sorted(tuple(norm(x[c]) for c in cols) for x in df.collect()) == sorted(tuple(norm(x[i]) for i in at) for x in r.fetchall())


@pytest.mark.parametrize("name", sorted(own.QUERIES))
def test_query(spark, duck, name):
    df = own.QUERIES[name](spark, DIR)
    if name in own.ORACLE_SQL:
        same(df, duck, own.ORACLE_SQL[name])
    else:
        assert df.count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["vec_id", "neighbor_id", "rank", "distance"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_the_subpackage(tmp_path):
    """With the llm folders and the pipeline deleted the rest imports and lists its own queries."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    at = str(tmp_path / "repo")
    shutil.copytree(root, at, ignore=lambda d, names: [n for n in names if n in (".git", "llm", "corpus_pipeline.py", "__pycache__", ".pytest_cache")])
    code = "import __spark_entry__ as e, json; print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))"
    out = subprocess.run([sys.executable, "-c", code], cwd=at, env=os.environ | {"PYTHONPATH": at}, capture_output=True, text=True, check=True)
    assert json.loads(out.stdout) == [sorted(own.QUERIES), sorted(own.ORACLE_SQL)]
    # Nothing but the entry names the subpackage.
    for folder, _, names in os.walk(os.path.join(at, "sparkloom")):
        for n in names:
            if n.endswith(".py"):
                with open(os.path.join(folder, n)) as f:
                    assert "llm" not in f.read().replace("ollm", "")


def test_scan_reads_two_columns(spark):
    plan = own.QUERIES["filtered_knn"](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(label,3)" in plan


def test_streams(spark, tmp_path):
    schema = spark.read.parquet(f"{DIR}/conversations.parquet").schema
    os.makedirs(tmp_path / "in")
    os.symlink(f"{DIR}/conversations.parquet", tmp_path / "in/a.parquet")
    stream = streaming.with_columns(streaming.read_stream(spark, str(tmp_path / "in"), schema), m=messages.string_to_message("text"))
    q = stream.writeStream.format("memory").queryName("said").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("said").count() == spark.read.parquet(f"{DIR}/conversations.parquet").count()


def test_search_by_stream(spark, tmp_path):
    e = spark.read.parquet(f"{DIR}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    e.limit(20).write.parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    q = streaming.knn_stream(streaming.read_stream(spark, str(tmp_path / "in"), e.schema), e, 3, lambda df, n: df.write.mode("append").parquet(out), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert spark.read.parquet(out).count() == 60


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,t\n1,x\n")
    assert [tuple(r) for r in read_csv(spark, str(tmp_path / "a.csv"), "id int, t string").collect()] == [(1, "x")]
