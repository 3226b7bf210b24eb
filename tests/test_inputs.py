"""The form that a view has on Spark against its SQL in DuckDB."""

from datetime import datetime

import duckdb
import pytest

from __spark_entry__ import oracle_sql, queries
from checks.inputs import VIEWS, Inputs, with_views
from tests.conftest import rows


@pytest.fixture
def orders_of_flows(spark, tmp_path):
    day = datetime(2001, 1, 1)
    customers = [(k, f"Customer#00_1{k}", k % 3, s) for k, s in enumerate(
        ["MACHINERY", "BUILDING", "AUTOMOBILE", "FURNITURE", "HOUSEHOLD", None])]
    customers += [(2, "Customer#2", 1, "FURNITURE"), (None, "none", 0, "BUILDING"), (9, "far", None, "BUILDING")]
    orders = [(1, 1, "O", day), (10, 1, "F", day), (9, 1, "P", day),        # 10 is newer than 9, not than a text
              (2, 2, "O", None), (3, 2, "O", day), (3, 2, "O", day), (4, 3, "F", None), (50, 3, "F", None),
              (None, 4, "O", day), (5, 4, "O", day.replace(year=2000)), (6, None, "O", day)]
    spark.createDataFrame(customers, "c_custkey long, c_name string, c_nationkey int, c_mktsegment string").write.parquet(
        f"{tmp_path}/customer.parquet")
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp_ntz").write.parquet(
        f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(0, "NATION_3"), (1, "NATION_1"), (2, "NATION_7")], "n_nationkey int, n_name string").write.parquet(
        f"{tmp_path}/nation.parquet")
    duck = duckdb.connect()
    for name in ("customer", "orders", "nation"):
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    return str(tmp_path), duck


def in_duckdb(duck, sql):
    found = duck.execute(sql)
    names = [c[0] for c in found.description]
    places = [names.index(n) for n in sorted(names)]
    return sorted((tuple(row[p] for p in places) for row in found.fetchall()), key=repr)


def test_the_newest_run_of_a_flow(spark, orders_of_flows):
    folder, duck = orders_of_flows
    assert rows(Inputs(spark, folder)("b_flows")) == in_duckdb(duck, with_views("SELECT * FROM b_flows"))
    assert "row_number()" in VIEWS["b_flows"]


def test_a_search_of_flows_reads_no_runs(spark, orders_of_flows):
    """it ordered all runs four times over, and used none of their columns."""
    folder, duck = orders_of_flows
    found = queries()["f4_search"](spark, folder)
    assert rows(found) == in_duckdb(duck, oracle_sql()["f4_search"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "o_custkey" not in plan and "Window" not in plan and "n_name" in plan
