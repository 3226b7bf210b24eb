"""Streams over the event table, each against the same question asked in batch."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks.registry import check
from checks.rules import CURRENT, FLOW_STATUS
from checks.texts import as_of
from ledgerline.session import new_dir
from ledgerline.sources import polls
from ledgerline.sources.buckets import whole
from ledgerline.sources.store import Store
from ledgerline.streaming import events as streams
from ledgerline.streaming import silence

EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
])

LAST_EVENT = """
newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id
  ORDER BY iteration_num DESC, ts DESC, event_seq DESC) AS rn FROM b_events) q WHERE rn = 1)"""


def raw_events(i):
    return streams.event_stream(i.spark, i.folder, EVENT_SCHEMA, "events*.parquet")


def as_ledger_events(raw):
    """The stream in the shape of the ledger's events."""
    return raw.selectExpr(
        "CAST(user_id AS STRING) AS run_id", "1 AS iteration_num", "event_type AS step",
        "CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'click' THEN 'RUNNING' "
        "ELSE 'COMPLETED' END AS step_status", "ts", "event_id AS event_seq")


def streamed_latest(i, counts=None):
    base = new_dir(i.spark, "latest")
    store = Store(i.spark, base)
    stream = streams.latest_stream(as_ledger_events(raw_events(i)))
    streams.run_available(stream, streams.keep_latest(store, counts=counts),
                          f"{base}/checkpoint", "update")
    return store


@check("st1_latest_event", f"""WITH {LAST_EVENT}
SELECT run_id, iteration_num, step, step_status, ts, event_seq FROM newest""")
def latest_event(i):
    return streamed_latest(i).read("latest")


@check("st2_ingest_once", "SELECT event_id, user_id, event_type, ts, props FROM events")
def ingest_once(i):
    """Every event delivered twice, kept once."""
    base = new_dir(i.spark, "ingest")
    twice = raw_events(i).unionByName(raw_events(i))
    streams.run_available(twice, streams.ingest_once(f"{base}/events"), f"{base}/checkpoint")
    return i.spark.read.parquet(f"{base}/events").select(
        "event_id", "user_id", "event_type", "ts", "props")


@check("st2_redelivered", "SELECT event_id, user_id, event_type, ts FROM events")
def redelivered(i):
    """The same events again by a second stream run, after the first has finished."""
    base = new_dir(i.spark, "redelivered")
    keep = streams.ingest_once(f"{base}/events")
    streams.run_available(raw_events(i), keep, f"{base}/first")
    again = streams.ingest_once(f"{base}/events", first_batch=1)
    streams.run_available(raw_events(i), again, f"{base}/second")
    return i.spark.read.parquet(f"{base}/events").select(
        "event_id", "user_id", "event_type", "ts")


@check("st2_repeats_dropped", "SELECT event_id, user_id, event_type FROM events")
def repeats_dropped(i):
    """The stateful form: every id once, whatever time a repeat has."""
    base = new_dir(i.spark, "repeats")
    stream = streams.drop_repeats(raw_events(i).unionByName(raw_events(i)))
    streams.run_available(stream, streams.append_batches(f"{base}/events"), f"{base}/checkpoint")
    return i.spark.read.parquet(f"{base}/events").select("event_id", "user_id", "event_type")


@check("st2_repeats_with_other_times", "SELECT event_id, user_id, event_type, ts FROM events")
def repeats_with_other_times(i):
    """Redelivered with a date of their own, or with none."""
    base = new_dir(i.spark, "other-times")
    keep = streams.ingest_once(f"{base}/events")
    streams.run_available(raw_events(i), keep, f"{base}/first")
    moved = F.when(F.col("event_id") % 2 == 0, F.col("ts") + F.expr("INTERVAL 3 DAYS"))
    again = streams.ingest_once(f"{base}/events", first_batch=1)
    streams.run_available(raw_events(i).withColumn("ts", moved), again, f"{base}/second")
    return i.spark.read.parquet(f"{base}/events").select("event_id", "user_id", "event_type", "ts")


@check("st2_late_repeats", "SELECT event_id, user_id, event_type, ts FROM events")
def late_repeats(i):
    """Near repeats meet in the state of an arrival window; others come 400 days late, or untimed, and meet the filters."""
    base = new_dir(i.spark, "late")
    raw, arrived = raw_events(i), F.lit(END).cast("timestamp")
    twice = raw.unionByName(raw).withColumn("told_at", arrived)
    keep = streams.ingest_once(f"{base}/events")
    streams.run_available(streams.drop_near_repeats(twice, "told_at").drop("told_at"), keep, f"{base}/first")
    moved = F.when(F.col("event_id") % 3 > 0, F.col("ts") + F.expr("INTERVAL 400 DAYS"))
    again = streams.ingest_once(f"{base}/events", first_batch=1)
    streams.run_available(raw_events(i).withColumn("ts", moved), again, f"{base}/second")
    return i.spark.read.parquet(f"{base}/events").select("event_id", "user_id", "event_type", "ts")


@check("st3_streamed_transitions", f"""WITH {CURRENT},
upd AS (SELECT flow_id, {FLOW_STATUS} AS new_status FROM cur)
SELECT f.flow_id, coalesce(u.new_status, f.status) AS status, f.current_run_id
FROM b_flows f LEFT JOIN upd u ON u.flow_id = f.flow_id""")
def streamed_transitions(i):
    """Job states arrive as files of a stream; each batch decides and writes."""
    return transitions(i, keeps_latest=False)


@check("st3_two_streams", f"""WITH {CURRENT},
upd AS (SELECT flow_id, {FLOW_STATUS} AS new_status FROM cur)
SELECT f.flow_id, coalesce(u.new_status, f.status) AS status, f.current_run_id
FROM b_flows f LEFT JOIN upd u ON u.flow_id = f.flow_id""")
def two_streams(i):
    """The same beside a stream that keeps the last events, whose batches have the same numbers."""
    return transitions(i, keeps_latest=True)


@check("st3_touched_buckets", f"""WITH {CURRENT},
upd AS (SELECT flow_id, {FLOW_STATUS} AS new_status FROM cur)
SELECT f.flow_id, coalesce(u.new_status, f.status) AS status, f.current_run_id
FROM b_flows f LEFT JOIN upd u ON u.flow_id = f.flow_id""")
def touched_buckets(i):
    """The same with flows and runs in buckets, of which a batch writes those of its jobs."""
    return transitions(i, keeps_latest=True, buckets=16)


@check("st3_polled_transitions", f"""WITH {CURRENT},
upd AS (SELECT flow_id, {FLOW_STATUS} AS new_status FROM cur)
SELECT f.flow_id, coalesce(u.new_status, f.status) AS status, f.current_run_id
FROM b_flows f LEFT JOIN upd u ON u.flow_id = f.flow_id""")
def polled_transitions(i):
    """The same from the polls of a poller: an older state of every job first, then its state now."""
    return transitions(i, keeps_latest=False, polled=True)


def transitions(i, keeps_latest, buckets=None, polled=False):
    base = new_dir(i.spark, "transitions")
    store = Store(i.spark, f"{base}/ledger")
    tables = i.ledger()
    keyed = {"flows": "flow_id", "runs": "run_id"} if buckets else {}
    store.commit(
        replace={name: tables[name] for name in ("flows", "runs", "events", "artifacts", "executions") if name not in keyed},
        parts={name: whole(tables[name], [key], buckets) for name, key in keyed.items()})
    if keeps_latest:
        # the stream follows the events of the store itself
        told, = store.bucket_folders("events")[None]
        events = streams.event_stream(i.spark, told, tables["events"].schema)
        streams.run_available(streams.latest_stream(events), streams.keep_latest(store), f"{base}/latest", "update")
    told = i("b_job_state").select(
        "job_run_id", "life_cycle_state", "result_state", "state_message", "poll_error",
        F.lit(1).alias("ts"))
    if polled:
        for number, part in enumerate((told.withColumn("life_cycle_state", F.lit("PENDING")), told)):
            polls.write_poll(part.drop("poll_error", "ts"), f"{base}/polls", number)
        states = polls.job_states(polls.poll_stream(i.spark, f"{base}/polls"))
    else:
        told.write.parquet(f"{base}/states")
        states = streams.event_stream(i.spark, f"{base}/states", told.schema)
    streams.run_available(states, streams.apply_transitions(store, lambda batch: as_of()),
                          f"{base}/checkpoint")
    return store.read("flows").select("flow_id", "status", "current_run_id")


@check("st4_live_counts", f"""WITH {LAST_EVENT}
SELECT step_status AS status, count(*) AS count FROM newest GROUP BY step_status""")
def live_counts(i):
    return streams.live_counts(streamed_latest(i, counts="counts"))


@check("st5_silent_runs", f"""WITH {LAST_EVENT}
SELECT run_id, step, CAST(epoch(TIMESTAMP '2024-02-01 00:00:00') AS BIGINT) - CAST(floor(epoch(ts)) AS BIGINT) - 7200 AS silent_over_s
FROM newest WHERE step_status = 'RUNNING'
  AND CAST(epoch(TIMESTAMP '2024-02-01 00:00:00') AS BIGINT) - CAST(floor(epoch(ts)) AS BIGINT) > 7200""")
def silent(i):
    latest = streamed_latest(i).read("latest")
    return streams.silent_runs(latest, F.expr("TIMESTAMP_NTZ '2024-02-01 00:00:00'"))


HALF, END = "2024-01-15 12:00:00", "2024-02-01 00:00:00"


def silent_at(as_of):
    return f"""
SELECT TIMESTAMP '{as_of}' AS as_of, run_id, step, CAST(epoch(TIMESTAMP '{as_of}') AS BIGINT) - CAST(floor(epoch(ts)) AS BIGINT) - 7200 AS silent_over_s
FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY iteration_num DESC, ts DESC, event_seq DESC) AS rn
      FROM b_events WHERE ts <= TIMESTAMP '{as_of}') q
WHERE rn = 1 AND step_status = 'RUNNING'
  AND CAST(epoch(TIMESTAMP '{as_of}') AS BIGINT) - CAST(floor(epoch(ts)) AS BIGINT) > 7200"""


@check("st5_told_by_timers", f"{silent_at(HALF)} UNION ALL {silent_at(END)}")
def told_by_timers(i):
    """Who is silent at two times of the clock, told by timers that outlive a restart between them."""
    base = new_dir(i.spark, "silence")
    store = Store(i.spark, f"{base}/store")
    events, found = i("b_events").withColumn("told_at", F.col("ts").cast("timestamp")), []
    for after, upto in (("1970-01-01 00:00:00", HALF), (HALF, END)):
        clock = F.lit(upto).cast("timestamp")
        tick = i.spark.range(1).select(*[
            (clock if c == "told_at" else F.lit(None)).cast(events.schema[c].dataType).alias(c) for c in events.columns])
        arrived = events.filter((F.col("told_at") > F.lit(after).cast("timestamp")) & (F.col("told_at") <= clock))
        arrived.unionByName(tick).write.mode("append").parquet(f"{base}/told")
        told = streams.event_stream(i.spark, f"{base}/told", events.schema)
        streams.run_available(silence.silence_stream(told, "told_at"), silence.keep_silent(store),
                              f"{base}/checkpoint", "update")
        found.append(silence.silent_now(store, clock).withColumn("as_of", clock.cast("timestamp_ntz")))
    return found[0].unionByName(found[1])
