"""Runs that fall silent, told when it happens: keyed state with a timer per run.

The clock is an arrival time that comes with the rows, not the events' own time: no event
is late for it, whatever its own time, and a row without a run moves the clock alone. A run
whose last event is RUNNING has a timer at the end of its limit; when the clock passes it
the run is told of, and withdrawn when it speaks again.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ledgerline.functions.timing import epoch_seconds
from ledgerline.operators.changes import one_row_per_key, upsert
from ledgerline.schemas import AGENT_LIMIT_S
from ledgerline.session import ROCKSDB
from ledgerline.sources.buckets import BUCKETS, changed, whole
from ledgerline.sources.store import Store

# executors get these functions themselves, so they need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_EVENT = ("run_id string, iteration_num int, at_us long, event_seq long, step string, step_status string, "
          "clock timestamp")
_ORDER = ("iteration_num", "at_us", "event_seq")
_STATE = "iteration_num int, at_us long, event_seq long, step string, due_ms long, told boolean, turn long"
_TOLD = "run_id string, turn long, silent boolean, step string, at_us long, clock_ms long"


def _last_of_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last event of every run in each Arrow batch, with the latest clock: a hot run sends a row a batch."""
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table.take(pc.sort_indices(
            table, [(n, "ascending") for n in _ORDER], null_placement="at_start"))
        table = table.append_column("place", pa.array(range(len(table)), pa.int64()))
        last = table.group_by("run_id").aggregate([("place", "max"), ("clock", "max")])
        rows = table.take(last["place_max"]).drop_columns(["place", "clock"]).append_column("clock", last["clock_max"])
        yield from rows.cast(batch.schema).combine_chunks().to_batches()


def _order(row) -> tuple:
    """A place in the order of events; what is not given comes first."""
    return tuple((v is not None, v or 0) for v in row)


class _Silence(StatefulProcessor):
    """One run: its last event, the timer of its limit, and whether it was told of."""

    def __init__(self, limit_s: int):
        self.limit_s = limit_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", _STATE)

    def handleInputRows(self, key, rows, timerValues):
        newest = max(rows, key=lambda r: _order((r.iteration_num, r.at_us, r.event_seq)))
        if key[0] is None:
            return                           # a tick of the clock
        old, turn = self.last.get() if self.last.exists() else None, 0
        if old is not None:
            if _order((newest.iteration_num, newest.at_us, newest.event_seq)) <= _order(old[:3]):
                return                       # nothing newer
            _, at_us, _, step, due, told, turn = old
            if told:
                turn += 1
                yield Row(run_id=key[0], turn=turn, silent=False, step=step, at_us=at_us,
                          clock_ms=timerValues.getCurrentWatermarkInMs())
            elif due is not None:
                self.handle.deleteTimer(due - 1)
        due = None
        if newest.step_status == "RUNNING" and newest.at_us is not None:
            # the first whole second after the limit
            due = (newest.at_us // 1_000_000 + self.limit_s + 1) * 1000
            self.handle.registerTimer(due - 1)
        self.last.update((newest.iteration_num, newest.at_us, newest.event_seq, newest.step, due, False, turn))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        iteration_num, at_us, event_seq, step, due, told, turn = self.last.get()
        if timerValues.getCurrentWatermarkInMs() < due:
            self.handle.registerTimer(due)   # fired at the last moment of the limit itself
            return
        if not told:
            self.last.update((iteration_num, at_us, event_seq, step, due, True, turn + 1))
            yield Row(run_id=key[0], turn=turn + 1, silent=True, step=step, at_us=at_us,
                      clock_ms=timerValues.getCurrentWatermarkInMs())


def silence_stream(events: DataFrame, clock: str, limit_s: int = AGENT_LIMIT_S) -> DataFrame:
    """``run_id``, ``turn``, ``silent``, ``step``, ``at_us``, ``clock_ms``: a row when a run falls silent or speaks again.

    ``events`` is a stream with the column ``clock``, the time at which a row arrived; rows without
    a run only tell the time. Rows of a run are numbered by ``turn``; the last one holds.
    State and timers are one entry per run and outlive a restart from the same checkpoint.
    """
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)    # timers need it
    seconds = F.col("ts").cast("timestamp")
    rows = events.select(
        "run_id", F.col("iteration_num").cast("int"), F.unix_micros(seconds).alias("at_us"),
        F.col("event_seq").cast("long"), "step", "step_status", F.col(clock).cast("timestamp").alias("clock"))
    return (
        rows.mapInArrow(_last_of_batch, _EVENT).withWatermark("clock", "0 seconds").groupBy("run_id")
        .transformWithState(_Silence(limit_s), _TOLD, "Update", "EventTime")
    )


def keep_silent(store: Store, table: str = "silent", stream: str = "silence",
                buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """Handler for ``silence_stream``: the runs that are silent now, in buckets of the run id."""
    def handle(told: DataFrame, batch: int) -> None:
        if batch <= store.last_batch(stream):
            return
        now = store.materialize(one_row_per_key(told, ["run_id"], ["turn"]))
        columns = [c for c in now.columns if c != "run_id"]
        if store.exists(table):
            part = changed(store, table, now, ["run_id"],
                           lambda old: upsert(old, now, ["run_id"], columns, columns).filter("silent"))
        else:
            part = whole(now.filter("silent"), ["run_id"], buckets)
        store.commit(parts={table: part}, batch=batch, stream=stream)
        store.drop_scratch()

    return handle


def silent_now(store: Store, as_of: Column, limit_s: int = AGENT_LIMIT_S, table: str = "silent") -> DataFrame:
    """The rows of ``silent_runs`` for the clock that the stream has reached."""
    at = F.floor(F.col("at_us") / 1_000_000)
    return store.read(table).select(
        "run_id", "step", (epoch_seconds(as_of) - at - limit_s).alias("silent_over_s"))
