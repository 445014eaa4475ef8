"""Every query of the engine against its oracle on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tessella.plans import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = [f[:-8] for f in os.listdir(SF) if f.endswith(".parquet")]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    mine = [{k: plain(v) for k, v in r.asDict().items()} for r in df.collect()]
    found = duck.execute(catalogue.ORACLE[name])
    names = [c[0] for c in found.description]
    theirs = [dict(zip(names, map(plain, r))) for r in found.fetchall()]
    assert sorted(df.columns) == sorted(names)
    key = lambda r: [repr(r[c]) for c in sorted(names)]
    assert sorted(mine, key=key) == sorted(theirs, key=key)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_no_python_and_no_cross_join_in_plans(spark):
    """All but the model boundary and the flattening of files stays in the JVM."""
    for name in ("page_text", "dump_frontmatter", "needs_classification", "routed_copies", "join_back", "key_ideas"):
        plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan, name


def test_bookmark_tree_has_every_leaf(spark, tmp_path):
    spark.range(2500).selectExpr("id AS page_id", "concat('u', id) AS url", "'' AS html").write.parquet(f"{tmp_path}/pages.parquet")
    df = catalogue.QUERIES["bookmark_tree"](spark, str(tmp_path))
    found = duckdb.sql(catalogue.ORACLE["bookmark_tree"].replace("FROM pages", f"FROM '{tmp_path}/pages.parquet/*.parquet'"))
    reached = {k for k in range(60, 2500) if k // 5 < 60}
    assert sorted(map(tuple, df.select(*found.columns).collect())) == sorted(found.fetchall()) and {r["id"] for r in df.collect()} == reached
