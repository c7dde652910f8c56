"""All queries of the rule engine against their SQL on the smallest tables."""

import glob
import math
import os

import pytest

from tamarack.queries import ORACLE_SQL, QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no tables")


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return connection


def plain(rows):
    clean = lambda x: None if isinstance(x, float) and math.isnan(x) else round(x, 9) if isinstance(x, float) else x
    return sorted((tuple(map(clean, r)) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sql, name):
    found = QUERIES[name](spark, SF_DIR)
    rows = found.collect()
    if name in ORACLE_SQL:
        want = sql.execute(ORACLE_SQL[name]).fetchall()
        names = [d[0] for d in sql.description]
        assert sorted(names) == sorted(found.columns)
        assert plain([tuple(r[c] for c in names) for r in rows]) == plain(want)
    else:
        assert rows


def test_names():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
