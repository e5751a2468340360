"""The queries that have SQL against it, and the plans of those that must stay within the JVM."""

import math
import os

import duckdb
import pytest

from docengine.llm import queries as llm
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
    return str(int(value)) if isinstance(value, bool) else repr(value) if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query(spark, duck, sf_dir, name):
    got = llm.queries()[name](spark, sf_dir)
    want = duck.execute(llm.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert sorted([plain(r[c]) for c in columns] for r in got.collect()) == sorted([plain(v) for v in r] for r in want.fetchall())


@pytest.mark.parametrize("name", ["op2_mix", "op3_secrets", "op4_pii", "op10_line_dedup"])
def test_native_plans(spark, sf_dir, name):
    plan = llm.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


def test_names(spark):
    names = list(llm.queries())
    assert [n for n in range(1, 11) if sum(x.startswith(f"op{n}_") for x in names) != 1] == [] and "pipeline" in names
