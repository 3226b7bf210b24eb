"""Properties of the write operators."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import changes, rules
from ledgerline.plans import migrate
from ledgerline.schemas import FLOWS
from ledgerline.sources.tables import (
    LEGACY_DEFAULTS, conform, read_table, with_own_names,
)
from ledgerline.schemas import LEGACY_FLOWS
from ledgerline.session import new_dir
from tests.conftest import rows
from tests.ledgers import T0, T1, flow, table

SCHEMA = "k string, a int, b string, ts timestamp"


def random_table(spark, seed, keys=60):
    pick = random.Random(seed)
    chosen = pick.sample(range(100), keys)
    return spark.createDataFrame(
        [(f"k{n}", pick.choice([None, 1, 2]), pick.choice([None, "", "x"]), T0) for n in chosen],
        SCHEMA)


def upsert(target, source, **more):
    return changes.upsert(target, source, ["k"], ["a"], ["a", "b"], {"ts": F.lit(T1)}, **more)


@pytest.mark.parametrize("seed", range(3))
def test_upsert_twice_is_once(spark, seed):
    target, source = random_table(spark, seed), random_table(spark, seed + 10, 40)
    once = upsert(target, source)
    assert rows(upsert(once, source)) == rows(once)


def test_upsert_of_nothing(spark):
    target = random_table(spark, 1)
    assert rows(upsert(target, target.filter("false"))) == rows(target)


def test_upsert_column_lists(spark):
    target = spark.createDataFrame([("m", 1, "old", T0), ("t", 2, "keep", T0)], SCHEMA)
    source = spark.createDataFrame([("m", None, "new", T0), ("s", 3, "ins", T0)], SCHEMA)
    assert rows(upsert(target, source)) == rows(spark.createDataFrame(
        [("m", None, "old", T1), ("t", 2, "keep", T0), ("s", 3, "ins", T1)], SCHEMA))


def test_repeated_source_key(spark):
    target = random_table(spark, 1)
    twice = spark.createDataFrame([("z", 1, "x", T0), ("z", 2, "y", T1)], SCHEMA)
    with pytest.raises(Exception, match="several source rows for key z"):
        upsert(target, twice).collect()
    got = upsert(target, twice, order=["ts"]).filter("k = 'z'").collect()
    assert [(r["a"], r["b"]) for r in got] == [(2, "y")]


@pytest.mark.parametrize("seed", range(3))
def test_changes_lead_to_the_new_version(spark, seed):
    old, new = random_table(spark, seed), random_table(spark, seed + 20, 50)
    found = changes.changes_between(old, new, ["k"])
    assert rows(changes.apply_changes(old, found, ["k"])) == rows(new)
    assert changes.changes_between(old, old, ["k"]).isEmpty()


def test_change_kinds(spark):
    old = spark.createDataFrame([("d", 1, "x", T0), ("u", 1, None, T0), ("s", None, None, None)],
                                SCHEMA)
    new = spark.createDataFrame([("i", 1, "x", T0), ("u", 1, "", T0), ("s", None, None, None)],
                                SCHEMA)
    got = {(r["change_type"], r["k"], r["b"])
           for r in changes.changes_between(old, new, ["k"]).collect()}
    assert got == {("delete", "d", "x"), ("insert", "i", "x"), ("update_preimage", "u", None),
                   ("update_postimage", "u", "")}


def test_keyed_update_null_and_not_given(spark):
    target = spark.createDataFrame([("x", 1, "b", T0), ("y", 1, "b", T0)], SCHEMA)
    updates = spark.createDataFrame([("x", None, None), ("gone", 5, "z")], "k string, a int, b string")
    got = changes.keyed_update(target, updates, "k", {"ts": F.lit(T1)}, when_given=["b"])
    assert rows(got) == rows(spark.createDataFrame(
        [("x", None, "b", T1), ("y", 1, "b", T0)], SCHEMA))


def test_repeated_right_hand_keys_are_refused_or_decided(spark):
    target = spark.createDataFrame([("x", 1, "b", T0), ("y", 1, "b", T0), (None, 1, "b", T0)], SCHEMA)
    updates = spark.createDataFrame(
        [("x", 5, "old"), ("x", 7, "new"), (None, 3, "z"), (None, 4, "z")], "k string, a int, b string")
    got = changes.keyed_update(target, updates, "k", order=["a"])
    assert rows(got) == rows(spark.createDataFrame(
        [("x", 7, "new", T0), ("y", 1, "b", T0), (None, 1, "b", T0)], SCHEMA))
    with pytest.raises(Exception, match="several source rows for key x"):
        changes.keyed_update(target, updates, "k").collect()

    requests = spark.createDataFrame(
        [("r", 1, "PENDING"), ("r", 2, "PENDING"), ("q", 1, "PENDING")], "run_id string, iteration_num int, status string")
    answers = spark.createDataFrame(
        [("r", 1, "IGNORED", 1), ("r", 1, "RESOLVED", 2), ("r", 2, "RESOLVED", 1), ("r", 2, "RESOLVED", 1), ("r", 2, None, 3)],
        "run_id string, iteration_num int, status string, at int")
    want = [("r", 1, "RESOLVED"), ("r", 2, "RESOLVED"), ("q", 1, "PENDING")]
    decided = rules.resolve_requests(requests, answers.filter("status is not null"), order=["at"])
    assert rows(decided) == rows(spark.createDataFrame(want, requests.schema))
    alike = rules.resolve_requests(requests, answers.filter("iteration_num = 2"))
    assert rows(alike) == rows(spark.createDataFrame([("r", 1, "PENDING"), *want[1:]], requests.schema))
    with pytest.raises(Exception, match="several answers for r/1"):
        rules.resolve_requests(requests, answers).collect()


def test_a_path_with_two_ids_gives_one_flow(spark):
    old = spark.createDataFrame([("a", "/p", "DONE")], "flow_name string, source_path string, status string")
    old = conform(old, LEGACY_FLOWS, LEGACY_DEFAULTS)
    ids = spark.createDataFrame([("/p", "1"), ("/p", "2"), ("/p", None), (None, "9")], "path string, flow_id string")
    assert [r["flow_id"] for r in migrate.migrated_flows(old, ids).collect()] == ["2"]


def test_bulk_set(spark):
    target = random_table(spark, 5)
    chosen = target.limit(7).select("k").unionByName(target.limit(7).select("k"))
    got = changes.bulk_set(target, chosen, "k", {"a": F.lit(9)})
    assert got.count() == 60 and got.filter("a = 9").count() == 7


def test_append_stamps_and_aligns(spark):
    old = table(spark, "flows", [flow("1")])
    new = spark.createDataFrame([("2", "n", "DONE")], "flow_id string, flow_name string, status string")
    got = changes.append(old, new, FLOWS, {"updated_ts": F.lit(T1)}).filter("flow_id = '2'").first()
    assert (got["updated_ts"], got["owner"]) == (T1, None)


def test_old_column_names(spark):
    old = spark.createDataFrame(
        [("1", "n", "RUNNING", T0, "/x")],
        "flow_id string, flow_name string, migration_status string, last_update_ts timestamp, "
        "vendor_xml_path string")
    names = {"migration_status": "status", "last_update_ts": "updated_ts", "vendor_xml_path": "source_path",
             "absent": "owner"}
    got = conform(with_own_names(old, names), FLOWS).first()
    assert (got["status"], got["updated_ts"], got["source_path"]) == ("RUNNING", T0, "/x")
    history = spark.createDataFrame(
        [("a", "5", "6")], "attempt_id string, vendor_job_id string, vendor_run_id string")
    names = {"vendor_job_id": "job_id", "vendor_run_id": "job_run_id"}
    assert with_own_names(history, names).columns == ["attempt_id", "job_id", "job_run_id"]
    for clash in ({"vendor_job_id": "attempt_id"}, {"vendor_job_id": "x", "vendor_run_id": "x"}):
        with pytest.raises(ValueError):
            with_own_names(history, clash)


def test_defaults_fill_absent_columns_only(spark):
    part = spark.createDataFrame([("n", None)], "flow_name string, total_attempts int")
    got = conform(part, LEGACY_FLOWS, LEGACY_DEFAULTS).first()
    assert (got["total_attempts"], got["iterations"], got["status"]) == (None, 0, "NOT_STARTED")
    assert got["generated_artifacts"] == []


def test_read_table_limit(spark):
    path = new_dir(spark, "limit")
    spark.range(20).write.parquet(path)
    assert read_table(spark, path).count() == 20 == read_table(spark, path, 0).count()
    assert read_table(spark, path, 3).count() == 3
