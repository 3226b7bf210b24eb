"""Streams over the append-only event table.

Sinks are versioned tables (``sources.store``), written per micro-batch. A batch
number that is already committed is skipped, so a batch that is run again after
a failure changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ledgerline.functions.timing import epoch_seconds
from ledgerline.operators.changes import upsert
from ledgerline.operators.latest import latest_events
from ledgerline.operators.sieve import apart, sieved
from ledgerline.plans import poll
from ledgerline.schemas import AGENT_LIMIT_S, EVENT_ORDER, TABLES
from ledgerline.session import remove_dir, state_on_disk
from ledgerline.sources.buckets import BUCKETS, Part, bucket_of, changed, touched_by, whole
from ledgerline.sources.store import BUCKET, Store
from ledgerline.streaming.known_ids import folders_that_may_hold, id_number, known_ids, write_filters


def event_stream(spark: SparkSession, folder: str, schema: T.StructType,
                 pattern: str = "*.parquet", files_per_batch: int | None = None) -> DataFrame:
    """Event files of a folder as a stream."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def run_available(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str,
                  mode: str = "append") -> StreamingQuery:
    """Handle everything that is there in micro-batches, then stop."""
    query = (
        stream.writeStream.outputMode(mode).foreachBatch(handle)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query


def latest_stream(events: DataFrame) -> DataFrame:
    """The last event of every run as a running aggregate.

    Each split combines its rows first, so a run with many events sends one row
    per split to its state. The state holds one row per run, on disk; of events with one place in
    the order the largest by its other columns stands.
    """
    state_on_disk(events.sparkSession)
    columns = [*EVENT_ORDER, *[c for c in events.columns if c not in ("run_id", *EVENT_ORDER)]]
    return (
        events.groupBy("run_id").agg(F.max(F.struct(*columns)).alias("_last"))
        .select("run_id", *[F.col(f"_last.{c}").alias(c) for c in events.columns if c != "run_id"])
    )


def keep_latest(store: Store, table: str = "latest", counts: str | None = None,
                stream: str = "latest", buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """Handler for ``latest_stream`` in update mode: upsert the changed runs.

    The table is kept in hash buckets of the run id. A batch reads and writes the buckets of its
    runs; files of all others stay. With ``counts``, the runs per step status are written along
    with it, bucket by bucket (see ``live_counts``). ``stream`` names the stream whose batch
    numbers these are.
    """
    def handle(changed_rows: DataFrame, batch: int) -> None:
        if batch <= store.last_batch(stream):
            return
        if store.exists(table):
            # the batch is evaluated once, and read for its buckets and for its rows
            changes = store.materialize(changed_rows)
            columns = [c for c in changes.columns if c != "run_id"]
            part = changed(store, table, changes, ["run_id"],
                           lambda old: upsert(old, changes, ["run_id"], columns, columns))
        else:
            part = whole(changed_rows, ["run_id"], buckets)
        store.commit(parts={table: part}, batch=None if counts else batch, stream=stream)
        if counts:
            # counted from the buckets as written
            written = store.read(table, part.touched).withColumn(BUCKET, bucket_of(["run_id"], part.of))
            fresh = written.groupBy(BUCKET, F.col("step_status").alias("status")).agg(F.count("*").alias("count"))
            store.commit(parts={counts: Part(fresh, part.touched, part.of)}, batch=batch, stream=stream)
        store.drop_scratch()

    return handle


def live_counts(store: Store, table: str = "counts") -> DataFrame:
    """Runs per status, summed over the buckets that ``keep_latest`` counts."""
    return store.read(table).groupBy("status").agg(F.sum("count").alias("count"))


def ingest_once(folder: str, key: str = "event_id", time: str = "ts", first_batch: int = 0
                ) -> Callable[[DataFrame, int], None]:
    """Handler that keeps every event id once, in a Parquet table by batch and event date.

    Ids alone are compared: a repeat may carry another time, or none, and the first
    delivery stands. Filters beside the table (``known_ids``) tell which of its folders may hold
    an id of the batch; only the ids of those are read and joined. Each batch owns a folder per
    date and its filters, and overwrites them when it runs again. No event is dropped for
    being late. A new stream into the same folder starts at ``first_batch``.
    """
    def handle(batch_rows: DataFrame, batch: int) -> None:
        spark, number = batch_rows.sparkSession, batch + first_batch
        rest = [c for c in batch_rows.columns if c != key]
        kind = batch_rows.schema[key].dataType
        once = (
            batch_rows.groupBy(key).agg(F.min(F.struct(*rest)).alias("_row"))
            .select(key, *[F.col(f"_row.{c}").alias(c) for c in rest])
            .withColumn("event_date", F.to_date(time))
        )
        ids = batch_rows.select(id_number(key, kind).alias("id")).distinct()
        hit = folders_that_may_hold(ids, folder, number)
        if hit:
            once = once.join(known_ids(spark, folder, key, kind, hit), key, "left_anti")
        remove_dir(spark, f"{folder}/batch={number}")      # of an earlier run; it may have had other dates
        _write_batch(once, folder, number, ["event_date"])
        write_filters(spark, folder, key, kind, number)

    return handle


def drop_near_repeats(events: DataFrame, clock: str, key: str = "event_id", within: str = "2 days") -> DataFrame:
    """The stream without ids that came before within ``within`` of the arrival time ``clock``.

    The state holds the ids of that span alone. As the clock is the arrival, not the event's
    time, no row is late for it; what repeats later is left to ``ingest_once``.
    """
    timed = events.withColumn("_clock", F.col(clock).cast("timestamp")).withWatermark("_clock", within)
    return timed.dropDuplicatesWithinWatermark([key]).drop("_clock")


def append_batches(folder: str) -> Callable[[DataFrame, int], None]:
    """Handler that adds the rows of a batch to a Parquet table."""
    def handle(batch_rows: DataFrame, batch: int) -> None:
        _write_batch(batch_rows, folder, batch, [])

    return handle


def _write_batch(rows: DataFrame, folder: str, batch: int, by: list[str]) -> None:
    """A folder per batch (and more columns), overwritten when the batch runs again."""
    (rows.withColumn("batch", F.lit(batch).cast("bigint"))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("batch", *by).parquet(folder))


def drop_repeats(events: DataFrame, key: str = "event_id") -> DataFrame:
    """The stream with every event id once, whenever a repeat comes.

    The state holds every id (on disk, see the state store of ``build_session``); no
    event is lost to a watermark.
    """
    return events.dropDuplicates([key])


def silent_runs(latest: DataFrame, as_of: Column, limit_s: int = AGENT_LIMIT_S) -> DataFrame:
    """Runs whose last event is older than the limit and that have not finished."""
    age = epoch_seconds(as_of) - epoch_seconds(F.col("ts"))
    return latest.filter((F.col("step_status") == "RUNNING") & (age > limit_s)).select(
        "run_id", "step", (age - limit_s).alias("silent_over_s"))


def apply_transitions(store: Store, as_of: Callable[[int], Column], logs_base: str = "",
                      launches: DataFrame | None = None, latest: str = "latest",
                      stream: str = "transitions") -> Callable[[DataFrame, int], None]:
    """Handler for a stream of job states: decide and write for the touched runs.

    ``store`` holds the ledger; events and requests are added to; all switch together. Flows, runs
    and the last event per run (table ``latest``, see ``keep_latest``) that the store keeps in
    buckets are read and written by touched bucket, else they get a whole new version. Jobs
    are looked up among the open current runs: no other run is decided on, so states of other jobs go
    before they are grouped. Where ``latest`` is kept the events are not read at all.
    """
    def handle(states: DataFrame, batch: int) -> None:
        if batch <= store.last_batch(stream) or states.isEmpty():
            return
        tables = {name: store.read_or_empty(name) for name in TABLES}
        current = store.materialize(poll.open_runs(
            poll.current_runs(tables["flows"], tables["runs"].select(*poll.OF_RUN))))
        # the newest state per job; a job may report many times in a batch
        rest = [c for c in states.columns if c not in ("job_run_id", "ts")]
        newest = store.materialize(
            sieved(states, current, "job_run_id").groupBy("job_run_id")
            .agg(F.max_by(F.struct(*rest), F.struct("ts", *rest)).alias("_s"))
            .select("job_run_id", "_s.*")
        )
        told = current.join(newest, "job_run_id", "left_semi").select("run_id")
        runs = store.materialize(current.join(told, "run_id", "left_semi"))
        keys = {"runs": "run_id", "flows": "flow_id", latest: "run_id"}
        counts = {name: store.buckets(name) for name in keys}
        parts = {name: touched_by(runs, [key], counts[name]) for name, key in keys.items() if counts[name]}
        near = {name: store.read(name, numbers) for name, numbers in parts.items()}
        tables = {**tables, **{name: near[name] for name in ("runs", "flows") if name in near}}
        kept = near.get(latest, store.read(latest) if store.exists(latest) else None)
        decisions = store.materialize(poll.decide_on(runs, tables, newest, kept))
        result = poll.apply(tables, decisions, as_of(batch), launches, logs_base, stored=True)
        after = {"flows": result["flows"], "runs": result["runs"]}
        if kept is not None:
            # runs without a new event keep their last one
            added = result["events"].select(*kept.columns)
            moved, others = apart(kept, added, "run_id")
            after[latest] = latest_events(moved.unionByName(added)).unionByName(others)
        in_buckets = {
            name: Part(after.pop(name).withColumn(BUCKET, bucket_of([keys[name]], counts[name])), numbers, counts[name])
            for name, numbers in parts.items()}
        store.commit(replace=after, parts=in_buckets, batch=batch, stream=stream, append={
            "events": result["events"], "requests": result["requests"]})
        store.drop_scratch()

    return handle
