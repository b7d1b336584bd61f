"""Shared scratch tables, so that a loop's lineage starts afresh each round."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_REPO = str(Path(__file__).resolve().parents[1])
_ROOTS: dict[str, str] = {}


def workers_can_import(spark: SparkSession) -> None:
    """Let Python workers import this package when it is not installed on them.

    A cluster has the package installed or on its PYTHONPATH; runs from a checkout get the checkout added once.
    """
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "")
    if _REPO not in known.split(os.pathsep) + os.environ.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (known, _REPO) if x)


def scratch_root(spark: SparkSession) -> str:
    """A folder for intermediate tables below the cluster's spark.checkpoint.dir.

    Only where that is unset, and Spark runs in one local process, a temporary folder takes its place.
    """
    sc = spark.sparkContext
    if sc.applicationId not in _ROOTS:
        root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
        if not root:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            root = "file://" + tempfile.mkdtemp(prefix="sievework-")
        own = f"{root.rstrip('/')}/sievework-{sc.applicationId}"
        _ROOTS[sc.applicationId] = own
        atexit.register(lambda: sc._jsc is not None and delete_path(spark, own))
    return _ROOTS[sc.applicationId]


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever file system its address names."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Staged:
    """A table written to the shared folder; reading it starts a fresh lineage."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = f"{scratch_root(self.spark)}/{name}-{uuid.uuid4().hex[:12]}"
        df.write.parquet(self.path)
        self.schema = df.schema

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        delete_path(self.spark, self.path)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back."""
    return Staged(df, name).read()
