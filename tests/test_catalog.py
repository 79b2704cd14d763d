"""Every query with reference SQL against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from geoloom import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        con.sql(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(norm, v)) + "]"
    return str(v)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, duck, name):
    df = catalog.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    rows = sorted(tuple(map(norm, r)) for r in df.select([f"`{c}`" for c in cols]).collect())
    if name not in catalog.ORACLES:
        return
    rel = duck.sql(catalog.ORACLES[name])
    assert sorted(rel.columns) == cols
    assert rows == sorted(tuple(map(norm, r)) for r in rel.project(",".join(f'"{c}"' for c in cols)).fetchall())
