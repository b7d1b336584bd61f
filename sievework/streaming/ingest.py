"""Incremental intake of function files: a file stream whose batches are admitted once each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


def admit(batch: DataFrame, table: str) -> None:
    """Append the batch's functions that ``table`` does not hold yet. Replays add nothing."""
    spark = batch.sparkSession
    one = batch.groupBy("binary_id", "name").agg(F.max_by("code", "path").alias("code"))
    try:
        known = spark.read.parquet(table).select("binary_id", "name")
        one = one.join(known, ["binary_id", "name"], "left_anti")
    except Exception as e:  # the first batch has no table yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
    one.write.mode("append").parquet(table)


def watch(spark: SparkSession, folder: str, table: str, checkpoint: str, on_batch: Callable[[DataFrame, int], None] | None = None) -> DataStreamWriter:
    """A writer that takes ``<folder>/<binary_id>/**/*.c`` into ``table``, each function once, whatever is replayed."""
    files = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.c").schema("value string").load(folder)
    rows = files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("code"))
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    # by the path alone: the reader's addresses and the folder's may differ in their slashes
    base = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(root).toUri().getRawPath().rstrip("/")
    below = F.substring_index(F.regexp_replace("path", "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?(?=/)", ""), "?", 1)
    parts = F.split(F.substring(below, len(base) + 2, 1 << 30), "/")
    rows = rows.select(F.element_at(parts, 1).alias("binary_id"), F.regexp_replace(F.element_at(parts, -1), r"\.c$", "").alias("name"), "path", "code")

    def each(batch: DataFrame, number: int) -> None:
        admit(batch, table)
        if on_batch:
            on_batch(batch, number)

    return rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
