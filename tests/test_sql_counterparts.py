"""Every query with a SQL counterpart against DuckDB on the smallest data folder, where it exists."""

import decimal
import glob
import os
from collections import Counter

import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
NAMES = sorted(set(entry.oracle_sql()) & set(entry.queries()))
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no data folder")


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    return v


@pytest.fixture(scope="module")
def db():
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, db, name):
    df = entry.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    ours = Counter(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    result = db.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert ours == Counter(repr(tuple(plain(r[names.index(c)]) for c in columns)) for r in result.fetchall())


def test_names_are_unique_and_known():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    problems = {f"p{n}" for n in range(1, 11)}
    assert {q.split("_")[0] for q in entry.queries()} >= problems or not any(q.startswith("p3_") for q in entry.queries())
