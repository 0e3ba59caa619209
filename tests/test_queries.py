"""Every query with an oracle against it, over the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from grovemark.plans import catalog

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in Path(D).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return c


def rows(names, got):
    order = sorted(range(len(names)), key=lambda i: names[i])
    as_ = lambda x: repr(round(x, 6) + 0.0) if isinstance(x, float) and not math.isnan(x) else repr(x)
    return sorted(names), sorted(tuple(as_(r[i]) for i in order) for r in got)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query(spark, con, name):
    df = catalog.QUERIES[name](spark, D)
    cur = con.execute(catalog.ORACLES[name])
    want = rows([c[0] for c in cur.description], cur.fetchall())
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == want
