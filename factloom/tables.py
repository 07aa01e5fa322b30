"""Tables in the folder that driver and executors share: how iterative operators cut lineage."""

from __future__ import annotations

import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a temporary folder in local mode, and a fault on a cluster, whose machines share no such folder."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or getattr(shared_dir, "own", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        base = shared_dir.own = "file://" + tempfile.mkdtemp(prefix="factloom-")
    return base.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new folder name in the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/factloom/{name}-{uuid.uuid4().hex}"
    fs, p = _file_system(spark, path)
    fs.deleteOnExit(p)
    return path


#: Runtime setting: a query's shuffle files go when it ends, instead of when the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_lock, _writers = threading.Lock(), {}


class Cleaning:
    """The setting is on while any thread of the session writes; the last to end puts back what was there before the first."""

    def __init__(self, spark: SparkSession):
        self.spark, self.key = spark, str(spark._jsparkSession.sessionUUID())

    def __enter__(self) -> None:
        with _lock:
            n, before = _writers.get(self.key, (0, None))
            if not n:
                before = self.spark.conf.get(CLEANUP, "false")
                self.spark.conf.set(CLEANUP, "true")
            _writers[self.key] = (n + 1, before)

    def __exit__(self, *_) -> None:
        with _lock:
            n, before = _writers.pop(self.key)
            if n > 1:
                _writers[self.key] = (n - 1, before)
            else:
                self.spark.conf.set(CLEANUP, before)


def durable(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read back: later plans start there, and lost executors cost nothing of it."""
    spark, schema = df.sparkSession, df.schema
    path = fresh_dir(spark, name)
    with Cleaning(spark):
        df.write.parquet(path)
    back = spark.read.schema(schema).parquet(path)
    back._factloom_path = path
    return back


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, whole or not at all: written beside its place and renamed."""
    fs, p = _file_system(spark, path)
    part = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.part")
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(p, False)
    fs.rename(part, p)


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _file_system(spark, path)
    fs.delete(p, True)


def drop(*tables: DataFrame) -> None:
    """Delete tables made by :func:`durable` that no later plan reads."""
    for df in tables:
        if path := getattr(df, "_factloom_path", None):
            remove(df.sparkSession, path)
