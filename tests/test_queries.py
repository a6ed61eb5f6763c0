"""Every registered query with SQL gives the rows that DuckDB gives for it."""

import math

import duckdb
import pytest
from curata.plans import advice, articles, banking, guardrails, records, reports, stores  # noqa: F401  (they register queries)
from curata.plans.queries import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def plain(rows, order):
    out = []
    for r in rows:
        out.append(tuple(f"{r[k]:.5f}" if isinstance(r[k], float) and math.isfinite(r[k]) else str(r[k]) for k in order))
    return sorted(out)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, DIR)
    rows = df.collect()
    if name not in ORACLES:
        assert rows
        return
    cur = con.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = cur.fetchall()
    order = sorted(names)
    mine = plain([r.asDict() for r in rows], order)
    theirs = plain([dict(zip(names, r)) for r in want], order)
    assert len(mine) == len(theirs)
    assert mine == theirs
