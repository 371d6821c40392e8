"""Every query with SQL gives DuckDB's rows."""

import duckdb
import pytest

from weftgraph import queries

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(names, values):
    order = sorted(range(len(names)), key=names.__getitem__)

    def cell(v):
        return f"{v:.6g}" if isinstance(v, float) else str(v)

    return sorted(tuple(cell(v[i]) for i in order) for v in values)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows(spark, con, name):
    got = queries.QUERIES[name](spark, SF)
    want = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_others_run(spark, name):
    assert queries.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
