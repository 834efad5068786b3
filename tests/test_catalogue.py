"""Each query of the catalogue against its SQL in DuckDB, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from chronoloom.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def plain(x):
    x = x.item() if hasattr(x, "item") else x
    return round(x, 5) + 0.0 if isinstance(x, float) and x == x else str(x)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = df.toPandas()
    if name not in ORACLES:
        assert len(got)
        return
    want = duck.execute(ORACLES[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    key = lambda f: sorted(map(str, (tuple(plain(v) for v in r) for r in f[sorted(f.columns)].itertuples(index=False, name=None))))
    a, b = key(got), key(want)
    assert len(a) == len(b)
    assert a == b
