"""Re-analysis of changed files as a stream: a file source, and per micro-batch only files whose text is not the last known of their path are parsed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.project import parse_files
from ..tables import drop, durable


def watch(spark: SparkSession, folder: str, extension: str = ".ts") -> DataFrame:
    """(path, code, hash, modified) of files as they appear under ``folder``.

    Spark's file source gives each path once: files rewritten in place need a stream of their versions, or ``changed_files``.
    """
    found = spark.readStream.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", f"*{extension}").text(folder)
    return found.select(F.input_file_name().alias("path"), F.col("value").alias("code"), F.sha2("value", 256).alias("hash"), F.col("_metadata.file_modification_time").alias("modified"))


def analyse_changes(stream: DataFrame, project: str, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append the facts of changed files to ``out``/facts and their (path, hash) to ``out``/files; a batch that runs again replaces itself.

    A file is parsed where its hash is not the last one of its path, whatever other files hold; the facts of a path's greatest batch
    are its current ones. Of a path's versions in one batch the last by ``modified`` counts, all of them in a stream without that
    column. ``out``/seen lists each content hash once.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession

        def earlier(name: str, schema: str) -> DataFrame:
            path = f"{out}/{name}"
            return (spark.read.schema(schema).parquet(path) if _exists(spark, path) else spark.createDataFrame([], schema)).where(F.col("batch") < number)

        if "modified" in batch.columns:
            last = F.rank().over(Window.partitionBy("path").orderBy(F.col("modified").desc()))
            batch = batch.withColumn("nth", last).where("nth = 1")
        known = earlier("files", "path string, hash string, batch long")
        known = known.withColumn("last", F.max("batch").over(Window.partitionBy("path"))).where("batch = last")
        new = batch.dropDuplicates(["path", "hash"]).join(known.select("path", "hash"), ["path", "hash"], "left_anti")
        # written once: a lost executor would read files again that may have changed since
        new = durable(new, "changed")
        parse_files(new, project).write.mode("overwrite").parquet(f"{out}/facts/batch={number}")
        seen = earlier("seen", "hash string, batch long")
        new.select("hash").distinct().join(seen.select("hash"), "hash", "left_anti").write.mode("overwrite").parquet(f"{out}/seen/batch={number}")
        new.select("path", "hash").write.mode("overwrite").parquet(f"{out}/files/batch={number}")
        drop(new)

    writer = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
