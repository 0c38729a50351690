"""Every query of the core on the smallest tables, held against its SQL."""

import datetime

import duckdb
import pytest

from conftest import DATA
from tracewright.plans import core_queries, log_queries, lookup_queries

QUERIES = {**core_queries.QUERIES, **log_queries.QUERIES, **lookup_queries.QUERIES}
SQL = {**core_queries.SQL, **log_queries.SQL, **lookup_queries.SQL}


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def cell(v):
        if isinstance(v, float):
            return f"{v:.6f}"
        if isinstance(v, datetime.datetime):
            return v.isoformat()
        return str(v)

    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, str(DATA))
    rows = [tuple(r) for r in df.collect()]
    assert rows or name in SQL
    if name in SQL:
        cur = db.execute(SQL[name])
        names = [d[0] for d in cur.description]
        assert sorted(names) == sorted(df.columns)
        assert _rows(df.columns, rows) == _rows(names, cur.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(SQL) <= set(__spark_entry__.oracle_sql())
    assert __spark_entry__.entry(spark).count() > 0
