"""Job snapshots as a stream: what a poller leaves behind, poll by poll, from any offset on.

A poll is a folder ``poll=<n>`` of text files, a JSON snapshot in each line, complete with its
``_SUCCESS`` mark; a poller numbers its polls without gaps. The stream's offset is the number of
the last poll that was read, so a restart goes on with the next one.
"""

from __future__ import annotations

import io
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ledgerline.schemas import JOB_STATES
from ledgerline.session import resolved
from ledgerline.sources.listing import children, opened

# executors get these functions themselves, so they need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SOURCE = "job_polls"
LINES = 1_000                # of one Arrow batch
MARK = "_SUCCESS"


def write_poll(snapshots: DataFrame, folder: str, number: int) -> None:
    """One poll: the rows of ``snapshots`` as JSON lines."""
    lines = snapshots.select(F.to_json(F.struct(*snapshots.columns)).alias("value"))
    lines.write.text(f"{folder}/poll={number}")


@dataclass
class PollFile(InputPartition):
    poll: int
    path: str


class PollReader(DataSourceStreamReader):
    def __init__(self, options):
        self.uri, self.first = options["path"], int(options.get("first", 0))

    def initialOffset(self) -> dict:
        return {"poll": self.first - 1}

    def latestOffset(self) -> dict:
        """The last of the polls that are complete without a gap."""
        system, root = opened(self.uri)
        found, _ = children(system, root)
        there = {f.base_name for f in found if f.type == pafs.FileType.Directory}
        last = self.first - 1
        # polls that this reader has seen stay complete
        last = max(last, getattr(self, "seen", last))
        while f"poll={last + 1}" in there and system.get_file_info(
                f"{root.rstrip('/')}/poll={last + 1}/{MARK}").type == pafs.FileType.File:
            last += 1
        self.seen = last
        return {"poll": last}

    def partitions(self, start: dict, end: dict) -> list[PollFile]:
        """The files of the polls after ``start``, up to ``end``."""
        system, root = opened(self.uri)
        return [
            PollFile(poll, f.path) for poll in range(start["poll"] + 1, end["poll"] + 1)
            for f in system.get_file_info(pafs.FileSelector(f"{root.rstrip('/')}/poll={poll}"))
            if f.type == pafs.FileType.File and f.size and not f.base_name.startswith(("_", "."))]

    def read(self, partition: PollFile) -> Iterator[pa.RecordBatch]:
        system, _ = opened(self.uri)
        held: list[str] = []
        with system.open_input_stream(partition.path) as source:
            for line in io.TextIOWrapper(io.BufferedReader(source), encoding="utf-8", newline="\n"):
                if line.strip():
                    held.append(line.rstrip("\n"))
                if len(held) >= LINES:
                    yield _batch(partition.poll, held)
                    held = []
        yield _batch(partition.poll, held)


def _batch(poll: int, lines: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([poll] * len(lines), pa.int64()), pa.array(lines, pa.string())], names=["poll", "snapshot"])


class JobPolls(DataSource):
    """``spark.readStream.format("job_polls")`` with options ``path`` (resolved) and ``first``."""

    @classmethod
    def name(cls) -> str:
        return SOURCE

    def schema(self) -> str:
        return "poll bigint, snapshot string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return PollReader(self.options)


def poll_stream(spark: SparkSession, folder: str, first: int = 0) -> DataFrame:
    """``poll`` and the snapshot columns (see ``jobs.read_snapshots``) of every poll from ``first`` on."""
    spark.dataSource.register(JobPolls)
    lines = spark.readStream.format(SOURCE).option("first", first).load(resolved(spark, folder, make=True))
    parsed = F.from_json(F.col("snapshot"), JOB_STATES).alias("_s")
    return lines.select("poll", parsed).select("poll", "_s.*")


def job_states(polls: DataFrame) -> DataFrame:
    """The polls as the job states that ``streaming.events.apply_transitions`` takes; a later poll is newer."""
    return polls.select(
        "job_run_id", "life_cycle_state", "result_state", "state_message",
        F.lit(None).cast("string").alias("poll_error"), F.col("poll").alias("ts"))
