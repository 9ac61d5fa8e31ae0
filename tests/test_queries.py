"""Every registered listing query against its oracle on the smallest tables."""

import math
import os

import duckdb
import pytest
from packlens.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


def norm(rows, cols):
    at = sorted(range(len(cols)), key=lambda i: cols[i])
    one = lambda v: None if v is None else round(float(v), 6) if isinstance(v, float) and not math.isnan(v) else v
    return sorted((tuple(str(one(r[i])) for i in at) for r in rows))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    rows = df.collect()
    if name in registry.ORACLES:
        rel = duck.sql(registry.ORACLES[name])
        assert sorted(df.columns) == sorted(rel.columns)
        assert norm(rows, df.columns) == norm(rel.fetchall(), rel.columns)
    else:
        assert rows
