"""Versioned tables and files."""

import os

import pytest
from pyspark.sql import functions as F

from ledgerline.session import new_dir
from ledgerline.sources import files
from ledgerline.sources.store import Store
from tests.conftest import rows
from tests.ledgers import event, flow, table


@pytest.fixture
def store(spark):
    return Store(spark, new_dir(spark, "store"))


def test_versions(spark, store):
    assert store.version() == 0 and not store.exists("flows")
    store.commit(replace={"flows": table(spark, "flows", [flow("1")])},
                 append={"events": table(spark, "events", [event("r", 1, "a")])})
    store.commit(append={"events": table(spark, "events", [event("r", 2, "b")])})
    flows = store.read("flows")
    store.commit(replace={"flows": flows.withColumn("status", F.lit("DONE"))})
    assert store.version() == 3
    assert store.read("flows").first()["status"] == "DONE"
    assert flows.first()["status"] == "RUNNING"      # an old version stays readable
    assert store.read("events").count() == 2
    assert store.read_or_empty("scans").isEmpty()


def test_compaction_keeps_the_rows(spark, store):
    for n in range(4):
        store.commit(append={"events": table(spark, "events", [
            event(f"r{k}", n, "s", seq=k) for k in range(5)])})
    before = rows(store.read("events"))
    assert len(store._current()["events"][1][None]) == 4
    store.compact("events")
    assert len(store._current()["events"][1][None]) == 1
    assert rows(store.read("events")) == before


def test_unlisted_data_is_not_seen(spark, store):
    store.commit(replace={"flows": table(spark, "flows", [flow("1")])})
    table(spark, "flows", [flow("2")]).write.parquet(f"{store.base}/data/flows/2-lost")
    assert [r["flow_id"] for r in store.read("flows").collect()] == ["1"]


@pytest.mark.parametrize("bad", [[flow("1"), flow("1")], [flow("1"), {**flow("2"), "status": None}]])
def test_broken_tables_are_refused(spark, store, bad):
    store.commit(replace={"flows": table(spark, "flows", [flow("0")])}, check_keys=True)
    rows_ = spark.createDataFrame(
        [tuple(r.get(c) for c in store.read("flows").columns) for r in bad],
        store.read("flows").schema)
    with pytest.raises(ValueError):
        store.commit(replace={"flows": rows_}, check_keys=True)
    assert [r["flow_id"] for r in store.read("flows").collect()] == ["0"]


def test_files_round_trip(spark):
    base = new_dir(spark, "files")
    named = spark.createDataFrame(
        [("a/x.xml", "é1"), ("a/b/y.xml", "y"), ("a/empty.xml", ""), ("a/b/Y.XML", "no"), ("a/_z.xml", "hidden"),
         ("a/n.log", "l"), ("b/m.log", "l"), ("b/deep/o.log", "l"), ("a/x.xml.txt", "no")],
        "name string, content string")
    assert files.write_files(named, base) == 9
    found = {os.path.basename(r["path"]): r["content"]
             for r in files.read_texts(spark, base).collect()}
    assert found == {"x.xml": "é1", "y.xml": "y"}     # hidden and empty files are not listed
    counts = {os.path.basename(r["folder"]): r["log_files"]
              for r in files.log_counts(spark, f"{base}/*").collect()}
    assert counts == {"a": 1, "b": 1}


def test_bytes_that_are_no_text(spark):
    df = spark.createDataFrame([(bytearray(b"ok"),), (bytearray(b"\xff\xfe"),)], "content binary")
    assert rows(df.select(files.as_text(F.col("content")).alias("t"))) == [("ok",), (None,)]
