"""Silent runs told by timers, against the batch filter at every time of the clock."""

import random
from datetime import timedelta

from pyspark.sql import functions as F

from ledgerline.operators.latest import latest_events
from ledgerline.session import new_dir
from ledgerline.sources.store import Store
from ledgerline.streaming import events as streams
from ledgerline.streaming import silence
from tests.conftest import rows
from tests.ledgers import T0, event, table

LIMIT = 600


def told_files(spark, base, batches):
    """Each batch as a file: events with the time at which they arrive, and a tick without a run."""
    for at, data in batches:
        part = table(spark, "events", data).withColumn("told_at", F.lit(at))
        tick = part.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in part.schema if f.name != "told_at"]).limit(0)
        tick = spark.range(1).select(*[F.lit(None).cast(part.schema[c].dataType).alias(c) for c in tick.columns], F.lit(at).alias("told_at"))
        part.unionByName(tick).coalesce(1).write.mode("append").parquet(base)
        yield at, part.schema


def test_told_when_it_happens(spark):
    base, pick = new_dir(spark, "silence"), random.Random(5)
    store = Store(spark, f"{base}/store")
    batches, seq = [], 0
    for k in range(5):
        at = T0 + timedelta(seconds=300 * k, milliseconds=250 * k)
        data = []
        for _ in range(12):
            seq += 1
            # some arrive long after their time, and some runs speak again
            ts = at - timedelta(seconds=pick.choice([0, 0, 5, 299, 601, 4000]))
            data.append(event(f"r{pick.randrange(9)}", pick.choice([1, 1, 2]), f"s{seq}",
                              pick.choice(["RUNNING", "RUNNING", "COMPLETED"]), ts, seq))
        batches.append((at, data))
    batches.append((T0 + timedelta(seconds=1200 + LIMIT + 1, milliseconds=1), []))
    told, changes = [], []
    for (at, data), (_, schema) in zip(batches, told_files(spark, f"{base}/told", batches)):
        told += data
        stream = streams.event_stream(spark, f"{base}/told", schema)
        handle = silence.keep_silent(store, buckets=4)

        def note(df, batch):
            changes.extend(df.collect())
            handle(df, batch)

        # a new query from the same checkpoint each time: timers outlive it
        streams.run_available(silence.silence_stream(stream, "told_at", LIMIT), note, f"{base}/checkpoint", "update")
        latest = latest_events(table(spark, "events", told))
        want = streams.silent_runs(latest, F.lit(at), LIMIT)
        assert rows(silence.silent_now(store, F.lit(at), LIMIT)) == rows(want), at
    assert {r["silent"] for r in changes} == {True, False}
    turns = {}
    for r in changes:                        # each run by turns silent and heard, nothing twice
        assert r["turn"] == turns.get(r["run_id"], 0) + 1 and r["silent"] == bool(r["turn"] % 2)
        turns[r["run_id"]] = r["turn"]


def test_limit_is_a_whole_second(spark):
    base = new_dir(spark, "limit")
    store = Store(spark, f"{base}/store")
    for k, seconds in enumerate((LIMIT, LIMIT + 0.999, LIMIT + 1)):
        at = T0 + timedelta(seconds=seconds)
        list(told_files(spark, f"{base}/told", [(at, [event("r", 1, "s")] if not k else [])]))
        stream = streams.event_stream(spark, f"{base}/told", spark.read.parquet(f"{base}/told").schema)
        streams.run_available(silence.silence_stream(stream, "told_at", LIMIT), silence.keep_silent(store, buckets=2),
                              f"{base}/checkpoint", "update")
        want = streams.silent_runs(table(spark, "events", [event("r", 1, "s")]), F.lit(at), LIMIT)
        assert rows(silence.silent_now(store, F.lit(at), LIMIT)) == rows(want)
        assert want.count() == (k == 2)


def test_many_events_of_a_run_are_one_row_a_batch(spark):
    many = table(spark, "events", [event("r", 1, f"s{k}", seq=k) for k in range(50)] + [event("q", 1, "s")])
    some = many.coalesce(1).selectExpr("run_id", "iteration_num", "unix_micros(ts) AS at_us", "event_seq", "step", "step_status", "ts AS clock")
    found = some.mapInArrow(silence._last_of_batch, silence._EVENT).collect()
    assert sorted((r["run_id"], r["step"]) for r in found) == [("q", "s"), ("r", "s49")]
