"""Session helpers: a local session for tests and benchmarks, and shared scratch folders."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
_made: dict[str, str] = {}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-machine session, for tests and benchmarks. On a cluster use the session it gives you."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("docsieve")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by the session.

    Only where a local session names none (a test run) a temporary folder is made.
    """
    named = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getConf().get(CHECKPOINT_DIR)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder that every executor can reach")
    # The setting cannot be changed in a running session, so the folder is remembered here.
    key = spark.sparkContext.applicationId
    if key not in _made:
        _made[key] = tempfile.mkdtemp(prefix="run-", dir=os.environ.get("TMPDIR", "/tmp"))
    return _made[key]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; nothing exists there yet."""
    return f"{shared_dir(spark)}/docsieve/{name}-{uuid.uuid4().hex}"


def _folder(spark: SparkSession, path: str):
    """A path and its file system, as Hadoop knows them: folders may lie in any store that Spark writes to."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def list_folders(spark: SparkSession, path: str, finished: bool = False) -> list[str]:
    """Names of the folders in a folder, none if it does not exist; only those that a job has ``finished`` writing."""
    place, store = _folder(spark, path)
    if not store.exists(place):
        return []
    found = [entry.getPath() for entry in store.listStatus(place) if entry.isDirectory()]
    done = spark._jvm.org.apache.hadoop.fs.Path
    return sorted(p.getName() for p in found if not finished or store.exists(done(p, "_SUCCESS")))


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a file or folder that this library has written; nothing happens if it is not there."""
    place, store = _folder(spark, path)
    store.delete(place, True)


def keep(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write a result that several later steps need to the shared folder, and read it from there.

    It is then made once, outlives lost executors, and Spark knows its size when it plans the joins. ``zstd`` makes
    texts smaller.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.parquet(path)
