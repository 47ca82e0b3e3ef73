"""Every catalogue query with SQL gives the oracle's rows on the smallest data; the rest import without the llm parts."""

import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from loglattice import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
ROOT = Path(__file__).resolve().parents[1]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def _rows(rows, columns):
    order = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple(r[i] for i in order) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_oracle(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    got = _rows([tuple(r) for r in df.collect()], df.columns)
    relation = duck.sql(catalog.oracle_sql()[name])
    assert sorted(df.columns) == sorted(relation.columns)
    assert got == _rows(relation.fetchall(), relation.columns)


def test_imports_without_llm(tmp_path):
    for item in ("loglattice", "__spark_entry__.py"):
        subprocess.run(["cp", "-r", str(ROOT / item), str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "loglattice/llm")], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'consumer_lag' in q and 'pipeline' not in q and not any(k.startswith('op') and k[2].isdigit() for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
