"""Every query against its SQL on the small test tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    yield con
    con.close()


def canonical(names, rows):
    """Rows with columns sorted by name, as sorted text."""
    order = sorted(range(len(names)), key=lambda i: names[i])

    def text(v):
        if isinstance(v, float):
            return "null" if math.isnan(v) else repr(v + 0.0)
        return "null" if v is None else str(v)

    return sorted(tuple(text(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, db, name):
    df = entry.queries()[name](spark, DATA)
    result = db.execute(entry.oracle_sql()[name])
    names = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(names)
    assert canonical(df.columns, [tuple(r) for r in df.collect()]) == canonical(names, result.fetchall())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() == 150 and len(df.columns) == 47


def test_every_query_has_sql():
    assert not [name for name, (_, sql) in entry.CHECKS.items() if not sql]
