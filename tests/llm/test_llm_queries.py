import duckdb
import pytest

from conftest import DATA
from tracewright.llm import queries


@pytest.mark.parametrize("name", ["p1_found", "p3_found", "p4_found", "p6_decoded", "p7_fill", "p8_found"])
def test_query(spark, name):
    df = queries.QUERIES[name](spark, str(DATA))
    rows = {tuple(r) for r in df.collect()}
    assert rows
    if name in queries.SQL:
        c = duckdb.connect()
        for f in DATA.glob("*.parquet"):
            c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
        assert rows == set(c.execute(queries.SQL[name]).fetchall())
    if name == "p7_fill":
        assert all(r.fullest <= r.capacity and r.containers <= r.fewest * 1.1 + 1 for r in df.collect())
