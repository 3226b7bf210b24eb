"""Numbering by ranges gives what a window gives, whatever share a key has."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import spread
from ledgerline.operators.spread import number_rows
from tests.conftest import rows


@pytest.fixture(scope="module")
def skewed(spark):
    pick = random.Random(7)
    data = []
    for n in range(3000):
        key = "hot" if n % 3 == 0 else None if n % 7 == 0 else f"k{pick.randrange(200)}"
        data.append((key, pick.randrange(10**6), n if n % 50 else 0))
    return spark.createDataFrame(data, "k string, v int, n int").repartition(5)


def test_copies_of_one_row_are_numbered(spark):
    data = spark.range(3000).select(
        F.lit("k").alias("k"), F.when(F.col("id") < 2500, 7).otherwise(F.col("id")).alias("v"))
    spread.WRITTEN_TOGETHER, kept = 100, spread.WRITTEN_TOGETHER
    try:
        got = number_rows(data, ["k"], [F.asc("v")], "place").collect()
    finally:
        spread.WRITTEN_TOGETHER = kept
    assert sorted(r["place"] for r in got) == list(range(1, 3001))
    assert {r["place"] for r in got if r["v"] == 7} == set(range(1, 2501))


def test_numbers_follow_the_order(skewed):
    kept = skewed.filter("k IS NOT NULL")
    got = number_rows(kept, ["k"], [F.asc("v"), F.asc("n")], "place", 0).collect()
    by_key = {}
    for r in got:
        by_key.setdefault(r["k"], []).append((r["place"], r["v"], r["n"]))
    assert sum(map(len, by_key.values())) == kept.count()
    for found in by_key.values():
        found.sort()
        assert [p for p, _, _ in found] == list(range(len(found)))
        assert [(v, n) for _, v, n in found] == sorted((v, n) for _, v, n in found)


def test_numbers_without_counting_first(skewed):
    """Repeated rows among them: each has a number of its own."""
    twice = skewed.unionByName(skewed.filter("n % 5 = 0"))
    for order in ([F.asc("v"), F.asc("n")], [F.desc("v")]):
        whole = number_rows(twice, ["k"], order, "place", 3)
        plain = number_rows(twice, ["k"], order, "place", 3, unique=True)
        assert plain.schema["place"].dataType == whole.schema["place"].dataType
        key = ["k", "v", "place"]
        assert rows(plain.select(key)) == rows(whole.select(key))


def test_descending_numbers_over_ranges(skewed):
    kept = skewed.filter("k = 'hot'")
    got = number_rows(kept, ["k"], [F.desc("v"), F.desc("n")], "place").collect()
    ordered = sorted(((r["v"], r["n"]) for r in got), reverse=True)
    assert [(r["v"], r["n"]) for r in sorted(got, key=lambda r: r["place"])] == ordered


def test_null_keys_are_numbered(spark):
    data = spark.createDataFrame([(None, None, 3), (None, None, 1), ("a", None, 2), ("a", 1, 9)], "k string, m int, v int")
    got = number_rows(data, ["k", "m"], [F.asc("v")], "place")
    assert rows(got) == rows(spark.createDataFrame(
        [(None, None, 1, 1), (None, None, 3, 2), ("a", None, 2, 1), ("a", 1, 9, 1)], "k string, m int, v int, place long"))


def test_no_job_runs_while_the_plan_is_built(skewed, spark):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("numbering", "")
    try:
        number_rows(skewed, ["k"], [F.asc("v"), F.asc("n")], "place")
        assert not tracker.getJobIdsForGroup("numbering")
    finally:
        spark.sparkContext._jsc.clearJobGroup()


def test_a_hot_key_is_split_and_the_ranges_are_made_once(skewed, spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = number_rows(skewed, ["k"], [F.asc("v"), F.asc("n")], "place")
        got.collect()
        plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert plan.count("Exchange rangepartitioning") == 1 + plan.count("ReusedExchange")
    assert "ReusedExchange" in plan
