"""Every query against its SQL on the smallest tables, and the plans that matter."""

import os
from collections import Counter

import pytest

from parley.operators.storage import setting
from parley.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(frame):
    cols = sorted(frame.columns)
    out = Counter()
    for r in frame[cols].astype(object).where(frame[cols].notna(), None).itertuples(index=False):
        out[tuple(v if v is None else round(float(v), 5) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r)] += 1
    return cols, out


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, duck, name):
    assert rows(registry.QUERIES[name](spark, SF).toPandas()) == rows(duck.sql(registry.ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_other_queries_run(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_prune_push_and_top(spark):
    text = plan(registry.QUERIES["top_04_audit_list"](spark, SF))
    assert "TakeOrderedAndProject" in text and "o_orderdate" not in text
    text = plan(registry.QUERIES["flt_08_half_open_range"](spark, SF))
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual" in text
    text = plan(registry.QUERIES["agg_03_by_harness"](spark, SF))
    assert "CartesianProduct" not in text and "l_shipdate" not in text


def test_lines_are_moved_once(spark):
    with setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"):
        shared, report = plan(registry.QUERIES["agg_30_shared_turns"](spark, SF)), plan(registry.QUERIES["flagship_usage_report"](spark, SF))
    # Customers, orders by customer and by turn, and lines by turn, where they are grouped too.
    assert shared.count("Exchange hashpartitioning") == 4 and "count(distinct" not in shared and shared.count("Aggregate(") == 2
    assert "l_orderkey" not in report  # its four passes read the joined lines


def test_entry_and_registry():
    import __spark_entry__ as e

    found = e.queries()
    assert set(e.oracle_sql()) <= set(found) and set(registry.QUERIES) <= set(found)
