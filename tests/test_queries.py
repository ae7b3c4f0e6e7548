"""Every registered query against its SQL in DuckDB, on the smallest tables; and the driver's contract."""

import math
import os
import subprocess
import sys

import duckdb
import pytest

from lectern import queries

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, (list, tuple)):
        return [plain(y) for y in x]
    return x


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        if f.endswith(".parquet"):
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf, db, name):
    df = queries.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    rows = df.select(*columns).collect()
    if name not in queries.SQL:
        assert rows
        return
    found = db.execute(queries.SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    expected = sorted((plain([r[i] for i in at]) for r in found.fetchall()), key=repr)
    assert sorted((plain(list(r)) for r in rows), key=repr) == expected


def test_entry_without_the_llm_folder(tmp_path):
    """The driver takes out the subpackage and the pipeline; the rest still imports."""
    for p in os.listdir(REPO):
        if p not in ("corpus_pipeline.py", "lectern", ".git", "tests"):
            os.symlink(f"{REPO}/{p}", tmp_path / p)
    os.mkdir(tmp_path / "lectern")
    for p in os.listdir(f"{REPO}/lectern"):
        if p != "llm":
            os.symlink(f"{REPO}/lectern/{p}", tmp_path / "lectern" / p)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(n.startswith('op') for n in e.queries()))"
    out = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120, env=os.environ | {"PYTHONPATH": str(tmp_path)})
    n, m, llm = out.stdout.split()
    assert int(n) >= 40 and int(m) >= 35 and llm == "False"
