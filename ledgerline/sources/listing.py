"""Files below a folder as rows: listed folder by folder in tasks, read in others.

A folder or file that cannot be opened is a row with what went wrong, not the end of the
job. The driver resolves the folder through Spark's file system (so a mount table or an
alias is followed) and names the subtrees that tasks walk; it never holds names of files.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ledgerline.session import qualified, resolved

# executors get these functions themselves, so they need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SOURCE = "folder_files"
SUBTREES = 64                # to walk by themselves, where the folders are so many
TASKS = 256                  # that walk them at most
ROWS, BYTES = 1_000, 4 << 20     # of one Arrow batch
MOST_BYTES = (1 << 31) - 1   # of one value

_LISTED = pa.schema([("path", pa.string()), ("length", pa.int64()), ("state", pa.string()), ("error", pa.string())])


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a resolved path, in whatever process asks."""
    return pafs.FileSystem.from_uri(uri.replace("s3a://", "s3://").replace("s3n://", "s3://"))


def reachable(spark: SparkSession, folder: str) -> bool:
    """Whether tasks can open the folder's file system by themselves."""
    try:
        opened(resolved(spark, folder))
    except pa.ArrowException:
        return False
    return True


def children(system: pafs.FileSystem, folder: str) -> tuple[list[pafs.FileInfo], str | None]:
    """What lies directly in a folder, or why that cannot be told."""
    try:
        return system.get_file_info(pafs.FileSelector(folder, recursive=False)), None
    except OSError as problem:
        return [], str(problem)


@dataclass
class Subtree(InputPartition):
    folder: str
    deep: bool                # with all folders below it


def subtrees(system: pafs.FileSystem, root: str, least: int = SUBTREES) -> list[Subtree]:
    """Parts of the tree for tasks: whole folders, and those that were opened to find enough of them."""
    opened_, leaves = [], [root]
    while leaves and len(leaves) < least:
        below = [[f.path for f in children(system, leaf)[0] if f.type == pafs.FileType.Directory] for leaf in leaves]
        if not any(below):
            break
        opened_ += [leaf for leaf, found in zip(leaves, below) if found]
        leaves = [path for leaf, found in zip(leaves, below) for path in (found or [leaf])]
    return [Subtree(path, False) for path in opened_] + [Subtree(path, True) for path in leaves]


def walk(system: pafs.FileSystem, tree: Subtree, ending: str) -> Iterator[tuple[str, int | None, str, str | None]]:
    """(path, length, state, error) of files whose name ends so, and of what cannot be opened."""
    folders = [tree.folder]
    while folders:
        folder = folders.pop()
        found, problem = children(system, folder)
        if problem is not None:
            yield folder, None, "unreadable folder", problem
        for info in found:
            if info.type == pafs.FileType.Directory:
                if tree.deep:
                    folders.append(info.path)
            elif info.path.endswith(ending):
                if info.type == pafs.FileType.File:
                    yield info.path, info.size, "file", None
                else:
                    yield info.path, None, "unreadable", "neither file nor folder"


@dataclass
class Subtrees(InputPartition):
    trees: list[Subtree]


class FolderReader(DataSourceReader):
    def __init__(self, options):
        self.uri, self.ending = options["path"], options.get("ending", "")
        self.least = int(options.get("subtrees", SUBTREES))

    def partitions(self) -> list[Subtrees]:
        """Subtrees dealt out to tasks: one each, or where they are very many, several."""
        system, root = opened(self.uri)
        found = subtrees(system, root.rstrip("/"), self.least)
        tasks = min(len(found), TASKS)
        return [Subtrees(found[at::tasks]) for at in range(tasks)]

    def read(self, partition: Subtrees) -> Iterator[pa.RecordBatch]:
        system, root = opened(self.uri)
        root, rows = root.rstrip("/"), []
        for tree in partition.trees:
            for path, length, state, error in walk(system, tree, self.ending):
                rows.append((path[len(root):].lstrip("/"), length, state, error))
                if len(rows) >= ROWS:
                    yield _batch(rows)
                    rows = []
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(_LISTED)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _LISTED)], schema=_LISTED)


class FolderFiles(DataSource):
    """``spark.read.format("folder_files")`` with options ``path`` (resolved), ``ending``, ``subtrees``.

    ``path`` in its rows is relative to the folder.
    """

    @classmethod
    def name(cls) -> str:
        return SOURCE

    def schema(self) -> str:
        return "path string, length bigint, state string, error string"

    def reader(self, schema) -> DataSourceReader:
        return FolderReader(self.options)


def listed_files(spark: SparkSession, folder: str, ending: str = ".xml") -> DataFrame:
    """``path``, ``length``, ``state``, ``error`` of every file below a folder whose name ends so, hidden ones too.

    ``state`` is ``file``, ``unreadable`` or ``unreadable folder``; an unreadable folder is told of
    whatever its name.
    """
    spark.dataSource.register(FolderFiles)
    base = qualified(spark, folder).rstrip("/")
    found = spark.read.format(SOURCE).option("ending", ending).load(resolved(spark, folder))
    return found.withColumn("path", F.concat_ws("/", F.lit(base), F.nullif(F.col("path"), F.lit(""))))


def hidden(path: Column, base: str) -> Column:
    """Whether Spark's file sources pass over a path: a name below ``base`` begins with ``.`` or ``_``."""
    names = F.split(F.substr(path, F.lit(len(base) + 2)), "/")
    return F.exists(names, lambda n: n.startswith(".") | (n.startswith("_") & ~n.contains("=")))


def with_contents(files: DataFrame, folder: str) -> DataFrame:
    """Listed files with ``content``; one that cannot be read turns ``unreadable``.

    Files are dealt out by size before they are read, so one folder with many is many tasks.
    """
    spark = files.sparkSession
    base, root = qualified(spark, folder).rstrip("/"), resolved(spark, folder).rstrip("/")
    schema = pa.schema([*_LISTED, ("content", pa.large_binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = opened(root)
        rows, size = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                body = None
                if row["state"] == "file":
                    try:
                        if row["length"] > MOST_BYTES:
                            raise OSError("larger than one value can be")
                        with system.open_input_stream(top.rstrip("/") + row["path"][len(base):]) as source:
                            body = source.read()
                    except OSError as problem:
                        row = {**row, "state": "unreadable", "error": str(problem)}
                rows.append({**row, "content": body})
                size += len(body or b"")
                if len(rows) >= ROWS or size >= BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    spread = files.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("path", "length"))
    return spread.select(*_LISTED.names).mapInArrow(
        read, "path string, length bigint, state string, error string, content binary")
