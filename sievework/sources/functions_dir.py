"""Decompiled functions and what surrounds them on storage, through Spark's readers alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _stem(path: str) -> F.Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def read_functions(spark: SparkSession, root: str, binary_id: str) -> DataFrame:
    """``(binary_id, name, path, code)`` of every ``*.c`` below ``root``; of files with one stem the last path counts.

    Line ends become line feeds. A missing folder is an error of the reader; an empty one has no rows.
    """
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.c").text(root, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "\r\n?", "\n").alias("code"))
    named = files.withColumn("name", F.url_decode(F.replace(_stem("path"), F.lit("+"), F.lit("%2B"))))
    last = named.groupBy("name").agg(F.max_by(F.struct("path", "code"), "path").alias("f"))
    return last.select(F.lit(binary_id).alias("binary_id"), "name", "f.path", "f.code")


def lost_files(spark: SparkSession, root: str) -> DataFrame:
    """``(path, length)`` of files of a ``decomps`` folder that hold a function which can't be read: empty, or cut at ``[abi``.

    Spark's readers pass over empty files, so the folder is listed by the file system that its address names.
    """
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(root)
    found, rows = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(where, True), []
    while found.hasNext():
        f = found.next()
        path = f.getPath()
        name, parts = path.getName(), path.toString().split("/")
        if not name.endswith(".c") and parts[-2:-1] == ["decomps"] and "ghidra_projects" not in parts and ("[abi" in name or f.getLen() == 0):
            rows.append((path.toString(), f.getLen()))
    return spark.createDataFrame(rows, "path string, length bigint")


def digests(files: DataFrame) -> DataFrame:
    """``files`` with the MD5 and SHA-256 of ``content``."""
    return files.withColumn("md5", F.md5("content")).withColumn("sha256", F.sha2("content", 256))
