"""Files as rows: every state, unreadable folders, other file systems, balanced subtrees."""

import os

import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F

from ledgerline.session import new_dir, qualified
from ledgerline.sources import files, listing


def local(path):
    return path.removeprefix("file://").removeprefix("file:")


@pytest.fixture
def folder(spark):
    base = local(new_dir(spark, "tree"))
    for name, body in {
        "a.xml": b"<a/>", "b.txt": b"no", "deep/er/c.xml": "é".encode(), "deep/bytes.xml": b"\xff\xfe",
        "deep/none.xml": b"", "_h/d.xml": b"hidden", ".e.xml": b"hidden", "deep/_x=1/f.xml": b"<f/>",
        "spaces and %41/g h.xml": b"<g/>",
    }.items():
        os.makedirs(os.path.dirname(f"{base}/{name}"), exist_ok=True)
        with open(f"{base}/{name}", "wb") as out:
            out.write(body)
    os.symlink(f"{base}/nowhere", f"{base}/deep/gone.xml")      # leads nowhere: no file
    os.mkfifo(f"{base}/deep/pipe.xml")
    return base


WANT = {"a.xml": "text", "deep/er/c.xml": "text", "deep/bytes.xml": "not text", "deep/none.xml": "empty",
        "_h/d.xml": "hidden", ".e.xml": "hidden", "deep/_x=1/f.xml": "text", "spaces and %41/g h.xml": "text",
        "deep/pipe.xml": "unreadable"}


def states(df, base):
    return {r["path"].removeprefix(base + "/"): r["state"] for r in df.collect()}


def test_every_file_has_a_state(spark, folder):
    found = files.scan_all(spark, folder)
    assert states(found, qualified(spark, folder)) == WANT
    texts = {r["path"].rsplit("/", 1)[1]: r["content"] for r in found.filter("content is not null").collect()}
    assert texts == {"a.xml": "<a/>", "c.xml": "é", "f.xml": "<f/>", "g h.xml": "<g/>"}
    assert files.scan_report(spark, folder).columns == ["path", "length", "state", "error"]
    empty = local(new_dir(spark, "empty"))
    os.makedirs(empty)
    assert files.scan_all(spark, empty).count() == 0


def test_a_path_that_only_spark_resolves(spark, folder):
    link = "fs.viewfs.mounttable.listing.link./defs"
    spark.conf.set(link, f"file://{folder}")
    spark.sparkContext._jsc.hadoopConfiguration().set(link, f"file://{folder}")
    assert states(files.scan_all(spark, "viewfs://listing/defs"), "viewfs://listing/defs") == WANT
    named = spark.createDataFrame([("new/z.xml", "<z/>")], "name string, content string")
    assert files.write_files(named, "viewfs://listing/defs/made") == 1
    with open(f"{folder}/made/new/z.xml") as made:
        assert made.read() == "<z/>"


class Refusing(pafs.FileSystemHandler):
    """The local file system, but for a folder that may not be opened."""

    def __getattribute__(self, name):
        if name == "get_file_info_selector":
            def listed(selector):
                if "closed" in selector.base_dir:
                    raise PermissionError("not for you")
                return pafs.LocalFileSystem().get_file_info(selector)
            return listed
        if name.startswith("__"):
            return object.__getattribute__(self, name)
        return lambda *a, **b: getattr(pafs.LocalFileSystem(), name)(*a, **b)


Refusing.__abstractmethods__ = frozenset()


def test_an_unreadable_folder_is_a_row(tmp_path):
    for name in ("x/1.xml", "closed/2.xml", "x/y/3.xml"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("t")
    system = pafs.PyFileSystem(Refusing())
    trees = listing.subtrees(system, str(tmp_path), 2)
    rows = sorted(row for tree in trees for row in listing.walk(system, tree, ".xml"))
    assert [(p.removeprefix(f"{tmp_path}/"), s) for p, _, s, _ in rows] == [
        ("closed", "unreadable folder"), ("x/1.xml", "file"), ("x/y/3.xml", "file")]
    assert "not for you" in rows[0][3]


def test_subtrees_cover_everything_once(spark, folder):
    system = pafs.LocalFileSystem()
    want = None
    for least in (1, 2, 3, 5, 1000):
        trees = listing.subtrees(system, folder, least)
        found = sorted(row[0] for tree in trees for row in listing.walk(system, tree, ".xml"))
        assert len(found) == len(set(found))
        want = want or found
        assert found == want and len(found) == len(WANT)
    assert len(listing.subtrees(system, folder, 3)) > 3


def test_a_file_that_goes_away_is_a_row(spark, folder):
    listed = spark.createDataFrame(
        [(f"{qualified(spark, folder)}/a.xml", 4, "file", None), (f"{qualified(spark, folder)}/left.xml", 4, "file", None),
         (f"{qualified(spark, folder)}/huge.xml", 1 << 40, "file", None)],
        "path string, length bigint, state string, error string")
    got = {r["path"].rsplit("/", 1)[1]: (r["state"], r["content"]) for r in listing.with_contents(listed, folder).collect()}
    assert got == {"a.xml": ("file", b"<a/>"), "left.xml": ("unreadable", None), "huge.xml": ("unreadable", None)}
    assert listing.with_contents(listed.filter(F.lit(False)), folder).count() == 0
