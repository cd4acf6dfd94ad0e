"""Every query of the library against its SQL twin on the smallest tables."""

import os

import duckdb
import pytest

from pagegraph import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def shown(v):
    return f"{v:.6f}" if isinstance(v, float) else str(v)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    rows = sorted([tuple(map(shown, r)) for r in df.collect()])
    if name not in catalog.ORACLES:
        assert df.columns
        return
    cursor = duck.execute(catalog.ORACLES[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns)
    order = [names.index(c) for c in df.columns]
    assert rows == sorted([tuple(shown(r[k]) for k in order) for r in cursor.fetchall()])
