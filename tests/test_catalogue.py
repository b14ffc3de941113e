"""Every query against its SQL on the smallest tables, and the entry file without the optional parts."""

import glob
import math
import os
import subprocess
import sys

import duckdb
import pytest

from pipelens import catalogue

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 4) + 0.0)
    return str(v)


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p + '/**/*.parquet' if os.path.isdir(p) and not glob.glob(p + '/*.parquet') else p + '/*.parquet' if os.path.isdir(p) else p}')")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_query_equals_its_sql(spark, sf, db, name):
    df = catalogue.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(v) for v in r) for r in df.select(*(f"`{c}`" for c in cols)).collect())
    res = db.execute(catalogue.ORACLE[name])
    names = [d[0] for d in res.description]
    want = sorted(tuple(norm(r[names.index(c)]) for c in cols) for r in res.fetchall())
    assert sorted(names) == cols and got == want


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE)))
def test_query_without_sql_runs(spark, sf, name):
    assert catalogue.QUERIES[name](spark, sf).count() > 0


def test_entry_without_the_optional_parts(tmp_path):
    for f in ("__spark_entry__.py", "pipelens"):
        os.symlink(f"{REPO}/{f}", tmp_path / f) if f.endswith(".py") else subprocess.run(["cp", "-r", f"{REPO}/{f}", str(tmp_path / f)], check=True)
    os.remove(tmp_path / "__spark_entry__.py")
    subprocess.run(["cp", f"{REPO}/__spark_entry__.py", str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "pipelens" / "llm")], check=True)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), sorted(k for k in e.queries() if k.startswith('op') and k[2:3].isdigit()))"], cwd=tmp_path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True)
    assert out.stdout.split()[1] == "[]"
