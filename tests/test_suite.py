"""Every query with SQL gives DuckDB's rows on the driver's tables."""

import math
import os

import duckdb
import pytest

from gaugeflow import suite

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v.isoformat() if hasattr(v, "isoformat") else v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(suite.QUERIES))
def test_query(spark, con, name):
    df = suite.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    if name in suite.ORACLE_SQL:
        rel = con.execute(suite.ORACLE_SQL[name])
        names = [d[0] for d in rel.description]
        assert sorted(names) == cols
        assert rows == sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in rel.fetchall()), key=repr)


def test_library_does_not_need_llm():
    import pathlib

    for p in pathlib.Path(suite.__file__).parent.rglob("*.py"):
        if "llm" not in p.parts:
            assert "llm" not in p.read_text(), p


def test_import_needs_no_session():
    import pathlib
    import subprocess
    import sys

    root = str(pathlib.Path(suite.__file__).parent.parent)
    said = subprocess.run([sys.executable, "-c", f"import sys; sys.path.insert(0, {root!r}); import __spark_entry__ as e; print(len(e.queries()) > 50)"], capture_output=True, text=True, timeout=120)
    assert said.stdout.strip() == "True", said.stderr[-500:]
