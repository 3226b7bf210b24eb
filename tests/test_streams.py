"""Streams in several micro-batches against the same question in batch."""

import random
import re
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from ledgerline.operators.latest import latest_events
from ledgerline.operators.totals import status_distribution
from ledgerline.session import new_dir
from ledgerline.sources.buckets import Part, touched_by, whole
from ledgerline.sources.store import BUCKET, Store
from ledgerline.streaming import events as streams
from tests.conftest import rows
from tests.ledgers import T0, T2, event, flow, ledger, run, table


@pytest.fixture(scope="module")
def event_files(spark):
    """Five files of events; a run's last event may be in any of them."""
    base, pick = new_dir(spark, "events"), random.Random(3)
    for part in range(5):
        data = [event(f"r{pick.randrange(12)}", pick.randrange(1, 4), f"s{pick.randrange(9)}",
                      pick.choice(["RUNNING", "COMPLETED", "FAILED"]),
                      T0 + timedelta(hours=pick.randrange(90)), part * 100 + n) for n in range(40)]
        table(spark, "events", data).coalesce(1).write.mode("append").parquet(base)
    return base


def follow(spark, event_files, one_at_a_time=True):
    schema = spark.read.parquet(event_files).schema
    return streams.event_stream(spark, event_files, schema,
                                files_per_batch=1 if one_at_a_time else None)


def test_latest_over_batches(spark, event_files):
    base = new_dir(spark, "st1")
    store = Store(spark, base)
    handle = streams.keep_latest(store, counts="counts")
    query = streams.run_available(
        streams.latest_stream(follow(spark, event_files)), handle, f"{base}/c", "update")
    assert query.lastProgress["batchId"] >= 4
    want = latest_events(spark.read.parquet(event_files))
    assert rows(store.read("latest").select(*want.columns)) == rows(want)
    assert rows(streams.live_counts(store)) == rows(status_distribution(want, "step_status"))
    # a batch that is run again changes nothing
    version = store.version()
    handle(want.withColumn("step", F.lit("again")), 0)
    assert store.version() == version


def test_each_event_once(spark, event_files):
    base = new_dir(spark, "st2")
    keep = streams.ingest_once(f"{base}/t", "event_seq")
    stream = follow(spark, event_files)
    streams.run_available(stream.unionByName(follow(spark, event_files)), keep, f"{base}/a")
    first = spark.read.parquet(f"{base}/t")
    assert first.count() == 200 == first.select("event_seq").distinct().count()
    later = streams.ingest_once(f"{base}/t", "event_seq", first_batch=100)
    streams.run_available(follow(spark, event_files), later, f"{base}/b")
    again = spark.read.parquet(f"{base}/t")
    assert again.count() == 200
    # the same batch once more writes the same rows to the same place
    batch = spark.read.parquet(event_files).filter("event_seq < 100")
    keep(batch, 0)
    assert spark.read.parquet(f"{base}/t").select("event_seq").distinct().count() == 200


def test_only_touched_buckets_are_written(spark, event_files):
    base = new_dir(spark, "buckets")
    store = Store(spark, base)
    handle = streams.keep_latest(store, counts="counts", buckets=32)
    every = latest_events(spark.read.parquet(event_files))
    handle(every, 0)
    before = {name: set(store.read(name).inputFiles()) for name in ("latest", "counts")}
    one = every.filter("run_id = 'r3'").withColumns(
        {"step": F.lit("moved"), "step_status": F.lit("FAILED"), "iteration_num": F.lit(99)})
    new = one.withColumn("run_id", F.lit("fresh"))
    handle(one.unionByName(new), 1)
    after = {name: set(store.read(name).inputFiles()) for name in ("latest", "counts")}
    touched = set(touched_by(one.unionByName(new), ["run_id"], 32))
    assert 1 <= len(touched) <= 2
    for name in before:
        def number(path):
            return int(re.search(f"{BUCKET}=([0-9]+)", path)[1])

        assert {number(f) for f in after[name] - before[name]} == touched
        assert {f for f in before[name] if number(f) not in touched} == after[name] & before[name]
    want = every.filter("run_id <> 'r3'").unionByName(one).unionByName(new)
    assert rows(store.read("latest").select(*want.columns)) == rows(want)
    assert rows(streams.live_counts(store)) == rows(status_distribution(want, "step_status"))
    with pytest.raises(ValueError):
        store.commit(replace={"latest": want})
    # a touched bucket that has no row any more
    store.commit(parts={"latest": Part(want.filter("false").withColumn(BUCKET, F.lit(0)), range(32), 32)})
    assert store.read("latest").columns == want.columns and store.read("latest").isEmpty()


@pytest.mark.parametrize("keeps_latest, buckets", [(False, None), (True, None), (False, 8), (True, 8)])
def test_transitions_per_batch(spark, keeps_latest, buckets):
    base = new_dir(spark, "st3")
    store = Store(spark, f"{base}/ledger")
    tables = ledger(
        spark, flows=[flow("a", run="ra"), flow("b", run="rb"), flow("c", run="rc")],
        runs=[run("ra", "a", "QUEUED"), run("rb", "b"), run("rc", "c")],
        events=[event("ra", 1, "agent_generate"), event("rb", 1, "agent_generate")])
    last = {"latest": latest_events(tables["events"])} if keeps_latest else {}
    keyed = {**{n: tables[n] for n in ("flows", "runs")}, **last}
    if buckets:
        store.commit(parts={n: whole(df, ["flow_id" if n == "flows" else "run_id"], buckets) for n, df in keyed.items()})
    else:
        store.commit(replace=keyed)
    store.commit(replace={"events": tables["events"]})
    columns = "job_run_id string, life_cycle_state string, result_state string, " \
              "state_message string, poll_error string, ts int"
    told = [[("job-ra", "PENDING", None, None, None, 1), ("job-ra", "RUNNING", None, None, None, 2)],
            [("job-ra", "TERMINATED", "FAILED", "boom", None, 3),
             ("job-rb", "TERMINATED", "CANCELED", None, None, 3)]]
    handle = streams.apply_transitions(store, lambda batch: F.lit(T2))
    for part in told:
        spark.createDataFrame(part, columns).coalesce(1).write.mode("append").parquet(
            f"{base}/states")
        states = streams.event_stream(spark, f"{base}/states",
                                      spark.read.parquet(f"{base}/states").schema)
        streams.run_available(states, handle, f"{base}/c")
        if part is told[0]:
            got = {r["run_id"]: r["status"] for r in store.read("runs").collect()}
            assert got == {"ra": "RUNNING", "rb": "RUNNING", "rc": "RUNNING"}
    got = {r["flow_id"]: r["status"] for r in store.read("flows").collect()}
    assert got == {"a": "NEEDS_HUMAN", "b": "STOPPED", "c": "RUNNING"}
    assert store.read("requests").first()["instructions"] == "Agent job failed: boom"
    steps = [r["step"] for r in store.read("events").filter("run_id = 'ra'").orderBy(
        "iteration_num", "ts", "event_seq").collect()]
    assert steps == ["agent_generate", "agent_generate", "needs_human"]
    if keeps_latest:
        last = latest_events(store.read("events"))
        assert rows(store.read("latest")) == rows(last)


def test_jobs_of_other_runs_touch_no_bucket(spark):
    """States of jobs whose run is closed, or no flow's current one, are not decided on: nothing of theirs is written."""
    base = new_dir(spark, "others")
    store = Store(spark, f"{base}/ledger")
    tables = ledger(
        spark, flows=[flow("a", run="ra"), flow("b", run="rb"), flow("c", run="rc")],
        runs=[run("ra", "a"), run("rb", "b", "SUCCESS"), run("rc", "c"), run("old", "c")],
        events=[event("ra", 1, "agent_generate")])
    keyed = {**{n: tables[n] for n in ("flows", "runs")}, "latest": latest_events(tables["events"])}
    store.commit(parts={n: whole(df, ["flow_id" if n == "flows" else "run_id"], 32) for n, df in keyed.items()})
    store.commit(replace={"events": tables["events"]})
    handle = streams.apply_transitions(store, lambda batch: F.lit(T2))

    def told(batch, *jobs):
        before = {n: store.bucket_folders(n) for n in keyed}
        handle(spark.createDataFrame(
            [(job, "TERMINATED", "FAILED", "boom", None, n) for n, job in enumerate(jobs)],
            "job_run_id string, life_cycle_state string, result_state string, "
            "state_message string, poll_error string, ts int"), batch)
        assert store.last_batch("transitions") == batch
        return {n: {b for b, folders in store.bucket_folders(n).items() if folders != before[n][b]} for n in keyed}

    assert told(0, "job-rb", "job-old", "job-unknown") == {"flows": set(), "runs": set(), "latest": set()}
    assert store.read_or_empty("requests").isEmpty() and store.read("events").count() == 1
    moved = told(1, "job-rb", "job-old", "job-ra")
    of = tables["runs"].filter("run_id = 'ra'")
    assert moved == {"flows": set(touched_by(of, ["flow_id"], 32)), "runs": set(touched_by(of, ["run_id"], 32)),
                     "latest": set(touched_by(of, ["run_id"], 32))}
    assert {r["flow_id"]: r["status"] for r in store.read("flows").collect()} == {
        "a": "NEEDS_HUMAN", "b": "RUNNING", "c": "RUNNING"}
    assert {r["run_id"]: r["status"] for r in store.read("runs").collect()} == {
        "ra": "FAILED", "rb": "SUCCESS", "rc": "RUNNING", "old": "RUNNING"}
    assert rows(store.read("latest")) == rows(latest_events(store.read("events")))


def test_silent_runs(spark):
    latest = table(spark, "events", [
        event("quiet", 1, "s"), event("done", 1, "s", "COMPLETED"), event("busy", 1, "s", ts=T2)])
    got = streams.silent_runs(latest, F.lit(T2), 7000).collect()
    assert [(r["run_id"], r["silent_over_s"]) for r in got] == [("quiet", 200)]


def test_state_of_latest_is_on_disk(spark, event_files):
    """Also in a session that was not built here: one row a run does not fit a heap."""
    other = spark.newSession()
    other.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    other.conf.set("spark.sql.shuffle.partitions", "3")
    base = new_dir(spark, "on-disk")
    store = Store(other, base)
    query = streams.run_available(streams.latest_stream(follow(other, event_files, False)),
                                  streams.keep_latest(store, buckets=8), f"{base}/c", "update")
    assert any(name.startswith("rocksdb") for name in query.lastProgress["stateOperators"][0]["customMetrics"])
    # three tasks of state, and yet a file a bucket
    files = [re.search(f"{BUCKET}=([0-9]+)", f)[1] for f in store.read("latest").inputFiles()]
    assert len(files) == len(set(files))
    want = latest_events(spark.read.parquet(event_files))
    assert rows(store.read("latest").select(*want.columns)) == rows(want)


def test_events_with_one_place_in_the_order(spark):
    base = new_dir(spark, "ties")
    table(spark, "events", [event("r", 1, "a"), event("r", 1, "b"), event("q", 1, "a", ts=None), event("q", 1, None)]
          ).repartition(4).write.parquet(f"{base}/t")
    store = Store(spark, f"{base}/store")
    streams.run_available(streams.latest_stream(follow(spark, f"{base}/t", False)), streams.keep_latest(store), f"{base}/c", "update")
    assert {(r["run_id"], r["step"]) for r in store.read("latest").collect()} == {("r", "b"), ("q", None)}
