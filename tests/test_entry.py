import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from tablediff import queries

ROOT = os.path.dirname(os.path.abspath(entry.__file__))
SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def test_works_without_the_subpackage(tmp_path):
    skip = shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__", "spark-warehouse")
    shutil.copytree(ROOT, tmp_path / "repo", ignore=skip)
    code = "import __spark_entry__ as e; print(len(e.queries()), set(e.oracle_sql()) <= set(e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", env=os.environ | {"PYTHONPATH": ""}, capture_output=True, text=True)
    assert out.stdout.split() == [str(len(queries.QUERIES)), "True"], out.stderr


@needs_tables
def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns[:3] == ["O_ORDERKEY", "O_ORDERSTATUS", "metric"] and df.count() > 0


def text(v):
    if v is None or v != v:
        return "null"
    if isinstance(v, float):
        return repr(round(v, 9) + 0.0)
    return str(v)


@needs_tables
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_against_duckdb(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(text(r[c]) for c in columns) for r in df.collect())
    picked = ", ".join(f'"{c}"' for c in columns)
    expected = con.execute(f"SELECT {picked} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert got == sorted(tuple(text(v) for v in r) for r in expected)
