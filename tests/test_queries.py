"""Every registered query of the engine against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from netquarry.plans import oracles, queries
from netquarry.streaming import trace

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, tmp_path, name):
    queries.QUERIES[name](spark, SF).write.parquet(str(tmp_path / "out"))
    got = duck.sql(f"SELECT * FROM '{tmp_path}/out/*.parquet'")
    if name not in oracles.SQL:
        assert duck.sql(f"SELECT count(*) FROM '{tmp_path}/out/*.parquet'").fetchall()[0][0] > 0
        return
    want = duck.sql(oracles.SQL[name])
    assert dict(zip(got.columns, map(str, got.types))) == dict(zip(want.columns, map(str, want.types)))
    columns = sorted(got.columns)
    rows = lambda r: sorted((tuple(row[r.columns.index(c)] for c in columns) for row in r.fetchall()), key=repr)
    assert rows(got) == rows(want)


def test_advance():
    s = trace.advance((0, "x", 0, 0, 0, 0), [(10, 1, "1"), (5, 0, "0"), (10, 2, "0")])
    assert s == (10, "0", 5, 0, 5, 0)
    assert trace.advance(s, [(7, 3, "1")]) == s  # late
