"""What the physical plans must and must not hold."""

import re
import uuid
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from checks.inputs import Inputs
from checks.rules import decided
from ledgerline.operators import joins, latest, lookup, rules, spread

from ledgerline.session import new_dir
from ledgerline.sources.tables import keep_by_key

SOURCES = Path(__file__).parent.parent / "ledgerline"


@pytest.fixture(scope="module")
def i(spark, folder):
    return Inputs(spark, folder)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def below(text, at):
    """The lines of a plan that hang under the operator on line ``at``."""
    lines = text.splitlines()
    depth = re.search(r"[A-Za-z]", lines[at]).start()
    for line in lines[at + 1:]:
        start = re.search(r"[A-Za-z(*]", line)
        if start is None or start.start() <= depth:
            return
        yield line


@pytest.fixture(autouse=True)
def no_small_table_shortcut(spark):
    """Plan as for big tables: nothing is broadcast because it happens to be small."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_latest_cuts_before_its_only_shuffle(i):
    text = plan(latest.latest_events(i("b_iterations")))
    assert text.count("Exchange hashpartitioning") == 1
    below = text[text.index("Exchange hashpartitioning"):]
    assert "WindowGroupLimit" in below and "Partial" in below


def test_history_cuts_before_its_only_shuffle(i):
    text = plan(latest.run_history(i("b_runs")))
    assert text.count("Exchange") == 1 and text.count("WindowGroupLimit") == 2


def test_history_of_one_flow_is_a_top_n(i):
    assert "TakeOrderedAndProject" in plan(latest.run_history(i("b_runs"), 5, "7"))


def test_snapshot_shuffles_each_table_once(spark, i):
    path = spark.sparkContext._gateway.jvm.java.io.File.createTempFile("flows", "").getPath()
    i("b_flows").write.mode("overwrite").parquet(path)
    text = plan(joins.status_snapshot(spark.read.parquet(path), i("b_runs"), i("b_iterations")))
    # flows, events, and for each of their two uses the current runs and the pointers to them
    assert text.count("Exchange hashpartitioning") == 6
    ranked, scan = text.index("row_number"), text.rindex("iteration_num")
    assert ranked < text.index("LeftSemi", ranked) < scan      # events are left out before they are ranked


def test_point_lookup_reaches_the_scan(spark, folder):
    orders = spark.read.parquet(f"{folder}/orders.parquet")
    text = plan(lookup.by_id(orders, "o_orderpriority", "5-LOW").select("o_orderkey"))
    assert "EqualTo(o_orderpriority,5-LOW)" in text
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderpriority:string>" in text


def test_tables_bucketed_by_run_meet_without_a_shuffle(spark, i):
    names = []
    for view in ("b_iterations", "b_runs", "b_patches"):
        names.append(keep_by_key(i(view), f"{view}_{uuid.uuid4().hex}", new_dir(spark, view), buckets=8))
    events, runs, artifacts = names
    joined = plan(latest.details_with_run(events, runs))
    assert "Exchange" not in joined and "SortMergeJoin" in joined
    assert "Exchange" not in plan(latest.latest_events(events))
    assert "Exchange" not in plan(events.groupBy("run_id").count().join(runs, "run_id"))
    flows = spark.range(100).selectExpr("string(id) AS flow_id", "string(id) AS current_run_id")
    current = plan(joins.current_artifacts(flows, artifacts))
    assert current.count("Exchange hashpartitioning") == 1      # the pointers of the flows
    assert len(events.inputFiles()) <= 8 and events.count() == i("b_iterations").count()


def test_orphans_are_counted_before_the_join(i):
    text = plan(joins.count_orphans(i("b_iterations"), i("b_runs"), "run_id", "run_id"))
    join = text.index("LeftAnti")
    assert "partial_count" in text[join:]


def test_only_bounded_tables_are_broadcast(i):
    """With the threshold off, what is still broadcast is cut by the list of hot keys."""
    for df in (rules.open_requests(i("b_human"), i("b_runs"), i("b_flows")),
               lookup.resolve(i("b_requests"), i("b_flows")), decided(i),
               joins.current_artifacts(i("b_flows"), i("b_patches"))):
        text = plan(df)
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
        for at, line in enumerate(text.splitlines()):
            if "BroadcastExchange" in line:
                assert any(f"TakeOrderedAndProject(limit={spread.MAX_HOT_KEYS}" in part
                           for part in below(text, at)), line


def test_detail_reads_sort_by_range(i):
    assert "rangepartitioning(run_id" in plan(latest.run_details(i("b_iterations"), "events"))


def test_library_keeps_to_distributed_calls():
    """No local checkpoints, no cross joins, no row-at-a-time functions."""
    for source in (s for s in SOURCES.rglob("*.py") if "llm" not in s.parts):   # those bound what they collect
        text = source.read_text()
        for word in ("localCheckpoint", "crossJoin", "toPandas", ".rdd", "collect_list",
                     "collect_set", "current_timestamp", "F.udf("):
            assert word not in text, f"{word} in {source.name}"


def test_driver_reads_are_bounded():
    """``collect`` is used for table names, bucket numbers, sizes of zones and folders only."""
    found = {(source.name, line.strip()) for source in SOURCES.rglob("*.py") if "llm" not in source.parts
             for line in source.read_text().splitlines() if ".collect()" in line}
    assert {name for name, _ in found} <= {"store.py", "buckets.py", "known_ids.py"}
    assert len(found) == 4


def test_row_counts_need_no_columns(i):
    text = plan(i("orders").agg(F.count("*")))
    assert "ReadSchema: struct<>" in text
