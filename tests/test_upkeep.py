"""Totals kept from change rows, and change rows by digest, against counting and joining everything."""

import glob
import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import changes, totals, upkeep
from ledgerline.session import new_dir
from ledgerline.sources import buckets
from ledgerline.sources.store import BUCKET, Store
from tests.conftest import rows
from tests.ledgers import T0

RUNS = "run_id string, flow_id string, status string, start_ts timestamp"


def versions(spark, seed, n=4):
    pick, now, out = random.Random(seed), {}, []
    for _ in range(n):
        for k in range(60):
            if pick.random() < 0.5:
                now[f"r{k}"] = (pick.choice(["a", "b", "c", None]), pick.choice(["SUCCESS", "FAILED", None]),
                                pick.choice([None, T0 + timedelta(hours=pick.randrange(9))]))
            elif pick.random() < 0.3:
                now.pop(f"r{k}", None)
        out.append(spark.createDataFrame([(k, *v) for k, v in now.items()], RUNS))
    return out + [out[0].filter("false")]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_totals_after_versions_equal_a_full_count(spark, seed):
    states = versions(spark, seed)
    counts, attempts = totals.status_distribution(states[0]), totals.attempt_totals(states[0])
    for old, new in zip(states, states[1:]):
        moved = changes.changes_between(old, new, ["run_id"])
        counts = spark.createDataFrame(upkeep.status_counts_after(counts, moved).collect(), "status string, count long")
        attempts = spark.createDataFrame(
            upkeep.attempt_totals_after(attempts, moved, new).collect(), totals.attempt_totals(new).schema)
        assert rows(counts) == rows(totals.status_distribution(new))
        assert rows(attempts) == rows(totals.attempt_totals(new))
        flows = new.select("status")
        assert rows(upkeep.dashboard_of_counts(counts)) == rows(totals.dashboard_totals(flows))


@pytest.mark.parametrize("coarse, fine", [(1, 1), (4, 3), (256, 64)])
def test_changes_by_digest(spark, coarse, fine):
    states = versions(spark, 8)
    for old, new in [*zip(states, states[1:]), (states[0], states[0].repartition(3)), (states[-1], states[1])]:
        want = changes.changes_between(old, new, ["run_id"])
        got = changes.changes_by_digest(old, new, ["run_id"], coarse, fine)
        assert got.columns == want.columns and rows(got) == rows(want)


def test_digests_see_repeated_and_swapped_rows(spark):
    one = spark.createDataFrame([("k", 1, 2), ("k", 1, 2)], "k string, a int, b int")
    other = spark.createDataFrame([("k", 2, 1), ("k", 2, 1)], one.schema)
    assert rows(changes.digests(one, ["k"])) != rows(changes.digests(other, ["k"]))
    assert rows(changes.digests(one, ["k"])) != rows(changes.digests(one.distinct(), ["k"]))
    assert rows(changes.digests(one, ["k"])) == rows(changes.digests(one.select("b", "a", "k"), ["k"]))


def test_versions_read_only_what_was_written_anew(spark):
    store = Store(spark, new_dir(spark, "versions"))
    old = versions(spark, 5)[0]
    first = store.commit(parts={"runs": buckets.whole(old, ["run_id"], 16)})
    some = old.limit(2).withColumn("status", F.lit("MOVED"))
    news = store.materialize(some)
    second = store.commit(parts={"runs": buckets.changed(
        store, "runs", news, ["run_id"],
        lambda now: now.join(news, "run_id", "left_anti").unionByName(news))})
    new = store.materialize(store.read("runs"))
    touched = set(buckets.touched_by(some, ["run_id"], 16))
    for b, folders in store.bucket_folders("runs").items():
        for name in (n for f in folders if b not in touched for n in glob.glob(f"{f.removeprefix('file:')}/*.parquet")):
            with open(name, "wb") as out:
                out.write(b"spoiled")
    got = buckets.changes_of(store, "runs", ["run_id"], first, second)
    assert rows(got) == rows(changes.changes_between(old, new, ["run_id"])) and got.count() == 4
    assert buckets.changes_of(store, "runs", ["run_id"], second).isEmpty()
    assert BUCKET not in got.columns
