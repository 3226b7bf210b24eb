"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_local_dirs: dict[str, str] = {}


def build_session(app: str = "ledgerline", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the operators are designed for."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # split a skewed join even where a later step must then shuffle once more
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # definition files can be large; keep Arrow batches of them small
        "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
        "spark.ui.enabled": "false",
    }
    settings.update({k: str(v) for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def state_on_disk(spark: SparkSession) -> None:
    """Streams that start from now on keep their state on the executors' disks, not in the heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    # a count for the progress report alone, which looks up every key before it is written
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows", "false")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as the session names it.

    Only a local session without the setting gets a temporary folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    app = context.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="ledgerline-")
    return _local_dirs[app]


def new_dir(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder (not created yet)."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows as written below the shared folder, to read several times."""
    path = new_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder with its file system, as Spark's own configuration resolves it."""
    system, path = _file_system(spark, folder)
    return system.makeQualified(path).toString()


def resolved(spark: SparkSession, folder: str, make: bool = False) -> str:
    """The folder where it really lies: mount tables and links of Spark's file system are followed."""
    system, path = _file_system(spark, folder)
    if make:
        system.mkdirs(path)
    return system.resolvePath(path).toString()


def remove_dir(spark: SparkSession, folder: str) -> None:
    """Remove a folder of our own in the shared file system, if it is there."""
    system, path = _file_system(spark, folder)
    system.delete(path, True)


def child_names(spark: SparkSession, folder: str) -> set[str]:
    """Names directly in a folder of our own; none if it is not there."""
    system, path = _file_system(spark, folder)
    return {s.getPath().getName() for s in system.listStatus(path)} if system.exists(path) else set()


def _file_system(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path

