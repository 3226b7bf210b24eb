"""Joins of large tables with few keys: the same rows, and no large table shuffled whole."""

from pyspark.sql import functions as F

from ledgerline.functions import definition
from ledgerline.operators import changes, sieve
from ledgerline.plans import poll
from ledgerline.sources import files, listing
from tests.conftest import rows


def _explained(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_matching_is_a_semi_join(spark):
    large = spark.range(20_000).select(
        F.when(F.col("id") % 50 != 0, (F.col("id") % 7_000).cast("string")).alias("k"), "id")
    few = large.filter("id % 97 = 0").select("k").union(spark.createDataFrame([("none",), (None,)], "k string"))
    assert rows(sieve.matching(large, few, "k")) == rows(large.join(few, "k", "left_semi").select("k", "id"))
    passed = sieve.sieved(large, few, "k")
    assert passed.count() < 2_000
    assert passed.join(few, "k", "left_semi").count() == large.join(few, "k", "left_semi").count()
    touched, rest = sieve.apart(large, few, "k")
    assert rows(touched.unionByName(rest)) == rows(large)
    assert rest.join(few, "k", "left_semi").isEmpty()


def test_keys_of_other_types_and_no_keys(spark):
    large = spark.range(100).withColumnRenamed("id", "k")
    text = spark.createDataFrame([("7",), ("200",)], "k string")
    assert [r["k"] for r in sieve.matching(large, text, "k").collect()] == [7]
    assert sieve.matching(large, large.limit(0), "k").isEmpty()


def test_few_updates_give_the_same_rows(spark):
    target = spark.range(5_000).select(F.when(F.col("id") != 3, F.col("id").cast("string")).alias("k"), F.lit("old").alias("v"))
    updates = spark.createDataFrame([("17", "a"), ("4000", None), ("new", "b"), (None, "c")], "k string, v string")
    assert rows(changes.keyed_update(target, updates, "k", few=True)) == rows(changes.keyed_update(target, updates, "k"))
    source = updates.filter("k IS NOT NULL")
    assert rows(changes.upsert(target, source, ["k"], ["v"], ["v"], few=True)) == rows(
        changes.upsert(target, source, ["k"], ["v"], ["v"]))


def test_a_poll_sieves_what_it_joins(spark):
    """Events, artifacts and executions of other runs are left out before they are shuffled."""
    ts = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    runs = spark.range(300).select(
        F.col("id").cast("string").alias("run_id"), (F.col("id") % 30).cast("string").alias("flow_id"),
        F.concat(F.lit("j"), F.col("id")).alias("job_run_id"), ts.alias("start_ts"), ts.alias("end_ts"), F.lit("RUNNING").alias("status"))
    flows = spark.range(30).select(F.col("id").cast("string").alias("flow_id"), F.col("id").cast("string").alias("current_run_id"))
    each = runs.select("run_id", F.lit(1).alias("iteration_num"), ts.alias("ts"))
    none = F.lit(None).cast("string")
    tables = {
        "flows": flows, "runs": runs, "artifacts": each,
        "events": each.withColumns({"event_seq": F.lit(1), "step": F.lit("agent_generate"), "step_status": F.lit("RUNNING")}),
        "executions": each.withColumns({"job_type": F.lit("x"), "runtime_s": F.lit(1), "error": none, "logs_ref": none, "status": F.lit("SUCCESS")})}
    told = runs.select("job_run_id", F.lit("TERMINATED").alias("life_cycle_state"), F.lit("SUCCESS").alias("result_state"), none.alias("state_message"))
    decisions = poll.decide(tables, told)
    assert _explained(decisions).count("BroadcastHashJoin") >= 4
    assert {(r["run_id"], r["action"], r["follow_up"]) for r in decisions.collect()} == {
        (str(n), "EXECUTE_GENERATED", "FINISH") for n in range(30)}


def test_artifacts_lie_in_a_fixed_number_of_folders(spark, tmp_path):
    made = spark.range(600).select(
        F.concat(F.lit("flow "), F.col("id") % 300).alias("flow"), F.when(F.col("id") % 2 == 0, "read").otherwise("write").alias("intent"),
        F.concat(F.lit("n"), F.col("id")).alias("name"), F.lit("text").alias("content"))
    base = str(tmp_path / "artifacts")
    files.write_artifacts(made, base)
    assert len([d for d in (tmp_path / "artifacts").iterdir() if d.is_dir()]) <= files.PARTS
    assert rows(files.read_artifacts(spark, base)) == rows(made)
    one = files.read_artifacts(spark, base, "flow 7", "write")
    assert rows(one) == rows(made.filter("flow = 'flow 7' AND intent = 'write'")) and one.count() == 2
    assert len(one.inputFiles()) == len(spark.read.parquet(base).inputFiles())   # pruned when it runs
    assert "PartitionFilters: [isnotnull(part" in _explained(one)


def test_log_files_are_listed_by_tasks(spark, tmp_path, monkeypatch):
    for run in range(70):
        folder = tmp_path / "logs" / f"run-{run}"
        (folder / "deeper").mkdir(parents=True)
        for name, body in (("a.log", "x"), ("b.log", "x"), ("empty.log", ""), ("_b.log", "x"), ("c.txt", "x"), ("deeper/d.log", "x")):
            (folder / name).write_text(body)
    (tmp_path / "logs" / "top.log").write_text("x")
    by_source = files.scan_files(spark, f"{tmp_path}/logs/*", "*.log", recursive=False).select("path")
    want = rows(by_source.groupBy(F.regexp_replace("path", "/[^/]*$", "").alias("folder")).agg(F.count("*").alias("log_files")))
    monkeypatch.setattr(files, "scan_files", None)               # the driver's listing is not used
    assert rows(files.log_counts(spark, f"{tmp_path}/logs/*")) == want and len(want) == 71
    assert files.log_counts(spark, f"{tmp_path}/logs/run-*").count() == 70
    assert {r["log_files"] for r in files.log_counts(spark, f"{tmp_path}/logs/run-1").collect()} == {2}
    assert files.log_counts(spark, f"{tmp_path}/logs/run-?").count() == 10
    monkeypatch.setattr(listing, "TASKS", 8)
    reader = listing.FolderReader({"path": f"file://{tmp_path}/logs", "ending": ".log"})
    assert len(reader.partitions()) == 8
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 70 * 5 + 1


def test_documents_are_parsed_a_few_at_a_time(spark, monkeypatch):
    """No more documents are held as Python objects than are parsed together."""
    import pyarrow as pa

    held = []
    real = pa.array
    monkeypatch.setattr(pa, "array", lambda values, *a, **k: held.append(len(values)) or real(values, *a, **k))
    texts = real([f"<template><groupId>{n}</groupId></template>" for n in range(100)])
    parsed = definition.parse_definition.func(texts)
    assert [r["flow_id"] for r in parsed.to_pylist()] == [str(n) for n in range(100)]
    assert max(held) <= definition.AT_ONCE
    assert len(definition.parse_definition.func(real([], pa.string()))) == 0
