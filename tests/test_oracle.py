"""Every query of the document operators that has SQL gives the same rows as DuckDB."""

import os
from collections import Counter
from decimal import Decimal

import duckdb
import pytest

from dockett import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return con


def shown(x):
    """Floats and decimals by value, whatever their type."""
    return f"{float(x):.9g}" if isinstance(x, (float, Decimal)) else str(x)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_matches_sql(spark, db, name):
    got = queries.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    mine = Counter(tuple(shown(r[c]) for c in columns) for r in got.collect())
    found = db.execute(queries.ORACLE[name])
    order = [d[0] for d in found.description]
    assert sorted(order) == columns
    at = [order.index(c) for c in columns]
    theirs = Counter(tuple(shown(r[i]) for i in at) for r in found.fetchall())
    assert sum(mine.values()) == sum(theirs.values()) > 0
    assert mine == theirs, (list((mine - theirs).items())[:3], list((theirs - mine).items())[:3])
