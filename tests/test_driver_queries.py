"""Every registered query of the core against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from spandrel.plans import driver_queries as q

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(x):
    return repr(float(x)) if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_query(spark, db, name):
    df = q.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    if name not in q.ORACLE_SQL:
        assert got
        return
    cur = db.execute(q.ORACLE_SQL[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == names
    assert got == sorted(tuple(plain(r[cols.index(c)]) for c in names) for r in cur.fetchall())
