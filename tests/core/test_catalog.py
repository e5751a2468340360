"""Every query of the catalogue against its SQL."""

import math
import os

import duckdb
import pytest

from docengine.plans import catalog
from docengine.sources.tables import TABLES


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, bool):
        return str(int(value))
    return repr(value) if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, sf_dir, name):
    got = catalog.QUERIES[name](spark, sf_dir)
    want = duck.execute(catalog.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    rows = sorted([plain(r[c]) for c in columns] for r in got.collect())
    assert rows == sorted([plain(v) for v in r] for r in want.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert set(catalog.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert len(__spark_entry__.entry(spark).collect()) > 0


def test_prefix_over_all_keys(spark, sf_dir):
    raw = {r.raw for r in catalog.QUERIES["collection_prefix"](spark, sf_dir).collect()}
    ids = [r.o_orderkey for r in catalog.orders(spark, sf_dir).select("o_orderkey").collect()]
    assert max(ids) >= 200 and raw == {f"orders:{i}".encode().hex() for i in ids}
