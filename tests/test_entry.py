import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def test_imports_without_a_session():
    root = os.path.dirname(os.path.abspath(entry.__file__))
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()) > 20, set(e.oracle_sql()) <= set(e.queries()))"], cwd=root, capture_output=True, text=True)
    assert out.stdout.split() == ["True", "True"], out.stderr[-500:]


def test_entry(spark):
    assert entry.entry(spark).count() >= 0


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in os.listdir(DATA):
        con.execute(f"create view {f[:-8]} as select * from read_parquet('{DATA}/{f}')")
    return con


def plain(rows):
    text = lambda x: "" if x is None else f"{x:.9g}" if isinstance(x, float) else str(x).replace("+00:00", "")
    return sorted(tuple(text(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    result = duck.execute(entry.oracle_sql()[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    want = [[r[names.index(c)] for c in columns] for r in result.fetchall()]
    assert plain([[r[c] for c in columns] for r in df.collect()]) == plain(want)
