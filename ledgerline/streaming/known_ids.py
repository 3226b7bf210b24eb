"""Which written folders may hold an id: Bloom filters over id ranges, kept beside the folders.

Ids of a folder are cut, in order, into chunks; a chunk knows its lowest and highest id and a
filter of 16 bits for each id. The ids of a batch meet only chunks whose range they fall into,
in groups of bounded size, and only folders with a hit are read at all.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.session import child_names

# executors get these functions themselves, so they need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHUNK_IDS = 8_192
BITS_PER_ID, PROBES = 16, 6          # an unknown id passes a filter with a chance of 1e-3
ZONE_IDS = 65_536                    # ids of a batch that meet filters in one group
GROUP_CHUNKS = 256                   # filters in one group, 4 MB of them

_CHUNK = "event_date date, low long, high long, n int, bits binary"


def id_number(key: str, kind: T.DataType) -> Column:
    """An id as a number: itself if it is one, so that ranges mean something, else its hash."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return F.coalesce(F.col(key).cast("long"), F.lit(0))
    return F.xxhash64(key)


def _spots(ids: np.ndarray, bits: int) -> np.ndarray:
    """Places of each id in a filter of ``bits`` (a power of two): one row for each probe."""
    h = ids.astype(np.int64).view(np.uint64).copy()
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h ^= h >> np.uint64(shift)
        h *= np.uint64(factor)
    h ^= h >> np.uint64(31)
    step = (h >> np.uint64(32)) | np.uint64(1)
    probes = np.arange(PROBES, dtype=np.uint64)[:, None]
    return (h[None, :] + probes * step[None, :]) & np.uint64(bits - 1)


def filter_of(ids: np.ndarray) -> bytes:
    bits = 1 << max(9, int(BITS_PER_ID * len(ids) - 1).bit_length())
    flags = np.zeros(bits, dtype=bool)
    flags[_spots(ids, bits).ravel().astype(np.int64)] = True
    return np.packbits(flags, bitorder="little").tobytes()


def may_hold(bits: bytes, ids: np.ndarray) -> np.ndarray:
    """Which ids pass the filter: all that are in it, and few others."""
    data = np.frombuffer(bits, np.uint8)
    spots = _spots(ids, 8 * len(data))
    return ((data[(spots >> np.uint64(3)).astype(np.int64)] >> (spots & np.uint64(7)).astype(np.uint8)) & 1).all(axis=0)


def write_filters(spark: SparkSession, folder: str, key: str, kind: T.DataType, batch: int) -> None:
    """Filters of the batch's date folders, in place of any that an earlier run of it left.

    Ids are dealt by ranges of date and id and come sorted, so a task holds one chunk at a time.
    """
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, day, started = [], None, False

        def chunk() -> pa.RecordBatch:
            ids = np.concatenate(held)
            return pa.RecordBatch.from_arrays(
                [pa.array([day], pa.date32()), pa.array([ids[0]]), pa.array([ids[-1]]), pa.array([len(ids)], pa.int32()),
                 pa.array([filter_of(ids)], pa.binary())], names=["event_date", "low", "high", "n", "bits"])

        for part in batches:
            days, ids = part.column(0).to_pylist(), part.column(1).to_numpy()
            at = 0
            while at < len(ids):
                if started and (days[at] != day or sum(map(len, held)) >= CHUNK_IDS):
                    yield chunk()
                    held, started = [], False
                day, started = days[at], True
                upto = at
                room = CHUNK_IDS - sum(map(len, held))
                while upto < len(ids) and upto - at < room and days[upto] == day:
                    upto += 1
                held.append(ids[at:upto])
                at = upto
        if started:
            yield chunk()

    written = f"{folder}/batch={batch}"
    target = f"{folder}.ids/batch={batch}"
    schema = T.StructType([T.StructField(key, kind), T.StructField("event_date", T.DateType())])
    if not any(name.startswith("event_date=") for name in child_names(spark, written)):
        spark.createDataFrame([], _CHUNK).write.mode("overwrite").parquet(target)
        return
    ids = spark.read.schema(schema).parquet(written).select("event_date", id_number(key, kind).alias("id"))
    order = ["event_date", "id"]
    (ids.repartitionByRange(*order).sortWithinPartitions(*order)
     .mapInArrow(build, _CHUNK).write.mode("overwrite").parquet(target))


def folders_that_may_hold(ids: DataFrame, folder: str, before: int) -> list[tuple[int, object]]:
    """(batch, event_date) of folders of batches ``before`` that may hold one of ``ids`` (column id, distinct).

    The driver gets the bounds of zones (one for 65,536 ids) and the folders that are hit.
    """
    spark = ids.sparkSession
    if not child_names(spark, f"{folder}.ids"):
        return []
    n, low, high = ids.agg(F.count("*"), F.min("id"), F.max("id")).first()
    if not n:
        return []
    schema = T.StructType.fromDDL(_CHUNK).add("batch", "long")
    # what lies beside all ids of the batch is skipped by the scan itself
    chunks = spark.read.schema(schema).parquet(f"{folder}.ids").filter(
        (F.col("batch") < before) & (F.col("high") >= low) & (F.col("low") <= high))
    zones = -(-n // ZONE_IDS)
    bounds = np.zeros(0, np.int64)
    if zones > 1:
        shares = [k / zones for k in range(1, zones)]
        bounds = np.unique(np.array(ids.agg(F.percentile_approx("id", shares, 100 * zones)).first()[0], np.int64))

    def overlapping(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each zone that a chunk's range reaches into."""
        for part in batches:
            first = np.searchsorted(bounds, part.column("low").to_numpy(), "right")
            last = np.searchsorted(bounds, part.column("high").to_numpy(), "right")
            rows = np.repeat(np.arange(part.num_rows), last - first + 1)
            zone = np.arange(len(rows)) - np.repeat(np.cumsum(last - first + 1) - (last - first + 1), last - first + 1) + first[rows]
            yield pa.RecordBatch.from_arrays([pa.array(zone.astype(np.int32)), *part.take(pa.array(rows)).columns],
                                             names=["zone", *part.schema.names])

    sizes = dict(chunks.select("low", "high").mapInArrow(overlapping, "zone int, low long, high long")
                 .groupBy("zone").count().collect())
    if not sizes:
        return []
    groups = np.array([-(-sizes.get(z, 0) // GROUP_CHUNKS) for z in range(len(bounds) + 1)])

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """An id once for each group of its zone's filters; ids that no range holds are gone."""
        for part in batches:
            found = part.column(0).to_numpy()
            zone = np.searchsorted(bounds, found, "right")
            times = groups[zone]
            rows = np.repeat(np.arange(len(found)), times)
            group = np.arange(len(rows)) - np.repeat(np.cumsum(times) - times, times)
            yield pa.RecordBatch.from_arrays(
                [pa.array(zone[rows].astype(np.int32)), pa.array(group.astype(np.int32)), pa.array(found[rows])],
                names=["zone", "group", "id"])

    def probe(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        sought = np.sort(mine["id"].to_numpy())
        hits = []
        for batch, day, low_, high_, bits in zip(*(theirs[c].to_pylist() for c in ("batch", "event_date", "low", "high", "bits"))):
            near = sought[np.searchsorted(sought, low_):np.searchsorted(sought, high_, "right")]
            if len(near) and may_hold(bits, near).any():
                hits.append((batch, day))
        return pa.table({"batch": pa.array([b for b, _ in hits], pa.int64()), "event_date": pa.array([d for _, d in hits], pa.date32())})

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Filters by zone, each in one of its zone's groups."""
        for part in overlapping(batches):
            zone = part.column("zone").to_numpy()
            own = part.column("low").to_numpy().view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)
            group = (own + part.column("batch").to_numpy().astype(np.uint64)) % groups[zone].astype(np.uint64)
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(group.astype(np.int32))], names=[*part.schema.names, "group"])

    wide = T.StructType([T.StructField("zone", T.IntegerType()), *chunks.schema.fields, T.StructField("group", T.IntegerType())])
    filters = chunks.mapInArrow(grouped, wide)
    keys = ids.select("id").mapInArrow(dealt, "zone int, group int, id long")
    found = keys.groupBy("zone", "group").cogroup(filters.groupBy("zone", "group")).applyInArrow(
        probe, "batch long, event_date date")
    return sorted(map(tuple, found.distinct().collect()), key=lambda r: (r[0], str(r[1])))


def known_ids(spark: SparkSession, folder: str, key: str, kind: T.DataType, hit: list[tuple[int, object]]) -> DataFrame:
    """Ids in the folders that were hit; no other folder is opened."""
    names = [f"{folder}/batch={batch}/event_date={day or '__HIVE_DEFAULT_PARTITION__'}" for batch, day in hit]
    return spark.read.schema(T.StructType([T.StructField(key, kind)])).parquet(*names)
