"""Every query that SQL can say, against the SQL, on the smallest tables."""

import math
import os

import pytest

from spindrift.catalog import load

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CATALOG = load()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from read_parquet('{FOLDER}/{name}.parquet')")
    return connection


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, (float, int)) and not isinstance(value, bool):
        return round(float(value), 6) + 0.0
    return str(value)[:19] if hasattr(value, "isoformat") else value


@pytest.mark.parametrize("name", sorted(CATALOG.oracle))
def test_same_rows(spark, duck, name):
    result = CATALOG.queries[name](spark, FOLDER)
    columns = sorted(result.columns)
    mine = sorted((tuple(plain(r[c]) for c in columns) for r in result.collect()), key=repr)
    relation = duck.sql(CATALOG.oracle[name])
    assert sorted(relation.columns) == columns
    at = [relation.columns.index(c) for c in columns]
    theirs = sorted((tuple(plain(r[k]) for k in at) for r in relation.fetchall()), key=repr)
    assert mine == theirs


def test_entry_points():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and entry.FLAGSHIP in entry.queries()
