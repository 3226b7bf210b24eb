"""Each event once, reading only folders that may hold an id of the batch."""

import glob
import random
from datetime import timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.session import new_dir
from ledgerline.streaming import events as streams
from ledgerline.streaming import known_ids as K
from tests.ledgers import T0

KIND = "event_id long, ts timestamp, value int"


def test_filters_have_no_false_negative_and_few_false_positives():
    pick = np.random.default_rng(3)
    for n in (1, 7, 500, 8_192):
        ids = np.unique(pick.integers(-2**62, 2**62, n))
        bits = K.filter_of(ids)
        assert K.may_hold(bits, ids).all()
        others = np.setdiff1d(pick.integers(-2**62, 2**62, 20_000), ids)
        assert K.may_hold(bits, others).mean() < 0.005
    near = K.filter_of(np.arange(8_000))
    assert K.may_hold(near, np.arange(8_000)).all() and K.may_hold(near, np.arange(8_000, 28_000)).mean() < 0.005


def rows(ids, day, value):
    return [(i, None if day is None else T0 + timedelta(days=day), value) for i in ids]


def spoil(folder, batch):
    """Files of a batch that nobody can read any more."""
    for name in glob.glob(f"{folder}/batch={batch}/*/*.parquet"):
        with open(name, "wb") as out:
            out.write(b"spoiled")


def test_only_folders_that_may_hold_an_id_are_read(spark):
    folder = f"{new_dir(spark, 'once')}/t"
    keep = streams.ingest_once(folder)
    for batch in range(5):
        ids = range(1000 * batch, 1000 * batch + 300)
        keep(spark.createDataFrame(rows(ids, batch % 2, batch), KIND), batch)
    ids = spark.createDataFrame([(k,) for k in (1005, 1299, 3000, 99_999)], "id long")
    assert [b for b, _ in K.folders_that_may_hold(ids, folder, 5)] == [1, 3]
    assert [b for b, _ in K.folders_that_may_hold(ids, folder, 3)] == [1]
    kept = spark.read.parquet(folder).filter("batch in (1, 3)").count()
    for batch in (0, 2, 4):
        spoil(folder, batch)
    # repeats 400 days late, or without a time, beside new ids
    late = rows([1005, 1006, 3000], 401, 77) + rows([1299], None, 77) + rows([7000, 7001], 400, 5) + rows([7002], None, 5)
    keep(spark.createDataFrame(late + late, KIND), 5)
    def got():
        return spark.read.schema(KIND + ", batch long, event_date date").parquet(folder)

    assert sorted(r["event_id"] for r in got().filter("batch = 5").collect()) == [7000, 7001, 7002]
    assert got().filter("batch in (1, 3)").count() == kept == 600
    # the same batch again, with fewer dates: nothing of its first run stays
    keep(spark.createDataFrame(rows([7002, 3001], 400, 5), KIND), 5)
    assert [r["event_id"] for r in got().filter("batch = 5").collect()] == [7002]
    again = spark.createDataFrame([(7000,), (7002,)], "id long")
    assert len(K.folders_that_may_hold(again, folder, 6)) == 1


@pytest.mark.parametrize("kind", ["long", "string"])
def test_ids_of_any_order_in_many_chunks_and_zones(spark, monkeypatch, kind):
    monkeypatch.setattr(K, "CHUNK_IDS", 50)
    monkeypatch.setattr(K, "ZONE_IDS", 40)
    monkeypatch.setattr(K, "GROUP_CHUNKS", 3)
    folder, pick = f"{new_dir(spark, 'zones')}/t", random.Random(8)
    keep, seen = streams.ingest_once(folder), {}
    for batch in range(4):
        ids = [pick.randrange(-400, 400) for _ in range(250)]
        keep(spark.createDataFrame([(i, T0 + timedelta(days=pick.randrange(3)), batch) for i in ids], KIND)
             .withColumn("event_id", F.col("event_id").cast(kind)), batch)
        for i in ids:
            seen.setdefault(str(i), batch)
    got = spark.read.parquet(folder).select(F.col("event_id").cast("string"), "value").collect()
    assert len(got) == len(seen) and {r["event_id"]: r["value"] for r in got} == seen


def test_null_ids_and_empty_batches(spark):
    folder = f"{new_dir(spark, 'nulls')}/t"
    keep = streams.ingest_once(folder)
    keep(spark.createDataFrame([], KIND), 0)
    keep(spark.createDataFrame([(None, T0, 1), (None, T0, 2), (1, T0, 1)], KIND), 1)
    keep(spark.createDataFrame([(1, T0, 3)], KIND), 2)
    keep(spark.createDataFrame([(2, T0, 3)], KIND), 3)
    assert sorted((r["event_id"] or 0) for r in spark.read.parquet(folder).collect()) == [0, 1, 2]


def test_near_repeats_by_arrival(spark):
    base = new_dir(spark, "near")
    data = [(1, T0 - timedelta(days=900), 0), (1, T0, 1), (2, T0, 0), (2, None, 0)]
    spark.createDataFrame(data, KIND).withColumn("told_at", F.lit(T0)).coalesce(1).write.parquet(f"{base}/in")
    late = spark.createDataFrame([(1, T0, 5), (3, T0 - timedelta(days=999), 0)], KIND).withColumn("told_at", F.lit(T0 + timedelta(days=9)))
    folder, schema = f"{base}/t", late.schema
    for part in (None, late):
        if part is not None:
            part.coalesce(1).write.mode("append").parquet(f"{base}/in")
        stream = streams.drop_near_repeats(streams.event_stream(spark, f"{base}/in", schema), "told_at")
        streams.run_available(stream, streams.ingest_once(folder), f"{base}/c")
    assert sorted(r["event_id"] for r in spark.read.parquet(folder).collect()) == [1, 2, 3]
