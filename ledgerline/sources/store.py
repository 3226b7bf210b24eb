"""Versioned tables: data folders that never change and a list naming the current ones.

A commit writes new folders, then adds one small file to the list. Readers take
the newest entry per table, so all tables of a commit switch together and a job
lost half way leaves nothing visible.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Mapping
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from ledgerline.operators.quality import duplicate_keys
from ledgerline.schemas import KEYS, LAYOUT, TABLES
from ledgerline.session import child_names, remove_dir

if TYPE_CHECKING:
    from ledgerline.sources.buckets import Part

_ENTRY = ("version bigint, table string, paths array<string>, batch bigint, stream string, "
          "bucket int, of int, schema string")
BUCKET = "_bucket"


class Store:
    """Tables below one shared folder. One writer at a time."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    def _entries(self) -> DataFrame:
        try:
            return self.spark.read.schema(_ENTRY).json(f"{self.base}/versions")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], _ENTRY)   # nothing committed yet

    def _current(self, upto: int | None = None
                 ) -> dict[str, tuple[int, dict[int | None, list[str]], int | None, str | None]]:
        """Newest version, folders by bucket (None: not in buckets), number of buckets, schema.

        With ``upto``, as they were at that version.
        """
        entries = self._entries()
        newest = (entries if upto is None else entries.filter(F.col("version") <= upto)).groupBy("table", "bucket").agg(
            F.max("version").alias("version"), F.max_by("paths", "version").alias("paths"),
            F.max("of").alias("of"), F.max_by("schema", "version").alias("schema"))
        found: dict = {}
        for r in newest.collect():
            version, paths, of, schema = found.get(r["table"], (0, {}, None, None))
            paths[r["bucket"]] = list(r["paths"])
            found[r["table"]] = (max(version, r["version"]), paths, r["of"] or of, r["schema"] or schema)
        return found

    def version(self) -> int:
        return self._entries().agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]

    def last_batch(self, stream: str) -> int:
        """Highest micro-batch number that the stream has committed, -1 when none."""
        own = self._entries().filter(F.col("stream") == stream)
        return own.agg(F.coalesce(F.max("batch"), F.lit(-1))).first()[0]

    def exists(self, table: str) -> bool:
        return table in self._current()

    def buckets(self, table: str) -> int | None:
        """In how many buckets the table is kept, None if in none (see ``sources.buckets``)."""
        current = self._current()
        return current[table][2] if table in current else None

    def bucket_folders(self, table: str, version: int | None = None) -> dict[int | None, list[str]]:
        """Folders of each bucket at a version, by default the newest."""
        return self._current(version)[table][1]

    def read(self, table: str, buckets: Iterable[int] | None = None, version: int | None = None) -> DataFrame:
        """The table as it is, or as it was at a version, or only some of its buckets."""
        _, paths, of, schema = self._current(version)[table]
        wanted = list(paths) if buckets is None else [b for b in buckets if b in paths]
        folders = [path for b in wanted for path in paths[b]]
        if of is None:
            return self.spark.read.parquet(*folders)
        kind = T.StructType.fromJson(json.loads(schema))
        if not folders:
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).parquet(*folders)

    def read_or_empty(self, table: str) -> DataFrame:
        if self.exists(table):
            return self.read(table)
        return self.spark.createDataFrame([], TABLES[table])

    def commit(self, replace: Mapping[str, DataFrame] | None = None,
               append: Mapping[str, DataFrame] | None = None,
               batch: int | None = None, check_keys: bool = False, stream: str | None = None,
               parts: Mapping[str, Part] | None = None) -> int:
        """Write new states, added rows and buckets, then switch to all of them at once.

        A stream numbers its batches for itself: several may write to one store. A table is kept
        in buckets from its first commit on, or never.
        """
        current, entries = self._current(), []
        version = 1 + max((entry[0] for entry in current.values()), default=0)
        for mode, tables in (("replace", replace or {}), ("append", append or {})):
            for name, df in tables.items():
                if name in current and current[name][2]:
                    raise ValueError(f"{name} is kept in buckets")
                path = f"{self.base}/data/{name}/{version}-{uuid.uuid4().hex}"
                df.write.parquet(path)
                if check_keys and mode == "replace" and name in KEYS:
                    self._refuse_broken(name, path)
                before = current[name][1][None] if mode == "append" and name in current else []
                entries.append((version, name, before + [path], batch, stream, None, None, None))
        for name, part in (parts or {}).items():
            if name in current and current[name][2] != part.of:
                raise ValueError(f"{name} is kept in {current[name][2]} buckets, not {part.of}")
            path = f"{self.base}/data/{name}/{version}-{uuid.uuid4().hex}"
            # rows of a bucket together, in files of a measured size where the session plans as it runs
            # (batches of a stream with state do not, and pass over the hint)
            adaptive = part.rows.sparkSession.conf.get("spark.sql.adaptive.enabled") == "true"
            dealt = part.rows.hint("rebalance", BUCKET) if adaptive else part.rows.repartitionById(part.of, BUCKET)
            dealt.write.partitionBy(BUCKET).parquet(path)
            there = child_names(self.spark, path)
            schema = part.rows.drop(BUCKET).schema.json() if part.touched else None
            entries += [
                (version, name, [f"{path}/{BUCKET}={b}"] if f"{BUCKET}={b}" in there else [], batch,
                 stream, b, part.of, schema) for b in part.touched]
        if entries:
            self.spark.createDataFrame(entries, _ENTRY).coalesce(1).write.mode("append").json(
                f"{self.base}/versions")
        return version

    def compact(self, table: str) -> int:
        """One folder in place of the many that appends leave, its rows in reading order."""
        order = LAYOUT[table]
        rows = self.read(table).repartitionByRange(*order).sortWithinPartitions(*order)
        return self.commit(replace={table: rows})

    def materialize(self, df: DataFrame) -> DataFrame:
        """The rows as written to the shared folder, to read several times."""
        path = f"{self.base}/scratch/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.parquet(path)

    def drop_scratch(self) -> None:
        """Remove what ``materialize`` wrote; its frames cannot be read any more."""
        remove_dir(self.spark, f"{self.base}/scratch")

    def _refuse_broken(self, name: str, path: str) -> None:
        written = self.spark.read.parquet(path)
        required = [f.name for f in TABLES[name].fields if not f.nullable]
        missing = " OR ".join(f"{c} IS NULL" for c in required)
        if not written.filter(missing).isEmpty():
            raise ValueError(f"{name}: a required column is NULL")
        if not duplicate_keys(written, KEYS[name]).isEmpty():
            raise ValueError(f"{name}: key {KEYS[name]} is not unique")
