"""Exact duplicates against a persistent digest index."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import delete_path, lower_ascii, scratch_root, staged, text_or_empty

_SCHEMA = "digest BINARY, keep_id BIGINT"


class DigestIndex:
    """A table of the digests seen so far, bucketed and sorted by digest.

    ``folder`` lies on storage that all executors share. Its ``_index.json`` names the number of buckets and the
    subfolder that holds the rows now, so the same folder, opened in a later session whatever its settings, is the same index.
    A new one has 64 buckets, or as many as the session has shuffle partitions, unless told otherwise; asking
    for another number of an existing one is an error, as its files are dealt already.

    ``admit`` takes a batch of digests: those already present are found by a sort-merge anti-join on the bucketed
    table, the others are appended. An append that was cut short is mended by admitting the batch again. Appends add
    files, so after many batches ``compact`` writes one sorted file a bucket to a new subfolder; ``_index.json`` is swapped
    by a rename once that is whole, and only then does the old one go.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int | None = None):
        self.spark, self.folder = spark, folder.rstrip("/")
        known = self._state()
        if known and buckets and buckets != known["buckets"]:
            raise ValueError(f"the index in {folder} has {known['buckets']} buckets, not {buckets}")
        if not known:
            if any(True for _ in self._files()):
                raise ValueError(f"{folder} is not empty and holds no index")
            known = {"buckets": buckets or max(64, int(spark.conf.get("spark.sql.shuffle.partitions"))), "rows": "rows-0"}
            self._swap(known)
        self.buckets, self.rows = known["buckets"], known["rows"]
        self._open()

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        return jvm, jvm.org.apache.hadoop.fs.Path(self.folder).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _files(self):
        jvm, fs = self._fs()
        where = jvm.org.apache.hadoop.fs.Path(self.folder)
        return iter([f.getPath().getName() for f in fs.listStatus(where)] if fs.exists(where) else [])

    def _state(self) -> dict | None:
        jvm, fs = self._fs()
        # a swap that was cut short leaves the new state beside no old one
        for name in ("_index.json", "_index.next"):
            at = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
            if fs.exists(at):
                stream = fs.open(at)
                try:
                    return json.loads(bytes(stream.readAllBytes()).decode())
                finally:
                    stream.close()
        return None

    def _swap(self, state: dict) -> None:
        jvm, fs = self._fs()
        now, following = (jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}") for name in ("_index.json", "_index.next"))
        stream = fs.create(following, True)
        stream.write(bytearray(json.dumps(state).encode()))
        stream.close()
        fs.delete(now, False)
        if not fs.rename(following, now):
            raise OSError(f"could not move {following} to {now}")

    def _open(self) -> None:
        self.path = f"{self.folder}/{self.rows}"
        self.table = "digest_index_" + uuid.uuid5(uuid.NAMESPACE_URL, self.path).hex
        # the catalog's entry is this session's view of the folder and may be dropped at any time
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self.table} ({_SCHEMA}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}'")

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def read_plain(self) -> DataFrame:
        """The rows without the bucketing, for joins in which a hot digest has to be split."""
        return self.spark.read.schema(_SCHEMA).parquet(self.path)

    def admit(self, groups: DataFrame) -> None:
        """Append the rows of ``groups(digest, keep_id)``, one a digest, that are new."""
        fresh = groups.select("digest", "keep_id").hint("merge").join(self.read(), "digest", "left_anti")
        self._write(fresh, self.table, self.path, "append")

    def _write(self, rows: DataFrame, table: str, path: str, mode: str) -> None:
        # one task a bucket, so that each write is one sorted file a bucket
        out = rows.repartition(self.buckets, "digest").sortWithinPartitions("digest")
        out.write.mode(mode).format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").option("path", path).saveAsTable(table)

    def compact(self) -> None:
        """One sorted file a bucket. Rows that an append wrote twice become one."""
        old, rows = self.rows, self.read().groupBy("digest").agg(F.max("keep_id").alias("keep_id"))
        state = {"buckets": self.buckets, "rows": f"rows-{uuid.uuid4().hex[:12]}"}
        temporary = "digest_index_" + uuid.uuid4().hex
        self._write(rows, temporary, f"{self.folder}/{state['rows']}", "overwrite")
        self.spark.sql(f"DROP TABLE {temporary}")
        self._swap(state)
        self.close()
        delete_path(self.spark, f"{self.folder}/{old}")
        self.rows = state["rows"]
        self._open()

    def close(self) -> None:
        """Drop the catalog's entry; the folder stays, and is the index."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def digests(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``(doc_id, digest)``: SHA-256 of each text with A-Z lower-cased; null counts as empty."""
    sha = F.unhex(F.sha2(F.encode(lower_ascii(text_or_empty(text)), "UTF-8"), 256))
    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), sha.alias("digest"))


def fresh_folder(spark: SparkSession) -> str:
    return f"{scratch_root(spark)}/digest-index-{uuid.uuid4().hex[:12]}"


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None, batches: int = 1) -> DataFrame:
    """One row a document: ``doc_id, digest, keep_id, group_size, kept``.

    Texts are equal when identical after lower-casing A-Z only; null counts as empty. Of
    equal texts in ``docs`` the largest doc_id stays; a text that ``index`` has already
    keeps its earlier document. ``group_size`` counts the rows of ``docs`` alone. Null doc_ids are the smallest; a group of null ids only has a
    null keep_id and keeps its rows. Rows repeated with the same id and text are all
    marked alike. An empty table gives no rows. Other columns are not looked at.

    ``docs`` may be admitted in several ``batches``, ranges of doc_id from the largest down, so that the
    row that stays comes first and later batches meet it in the index. Texts are read once. Digests are grouped with a
    partial aggregate before the shuffle, and the joins that carry the answer back are between plain tables, so that adaptive
    execution can split a digest that holds a third of all rows.
    """
    spark = docs.sparkSession
    own = index is None
    index = index or DigestIndex(spark, fresh_folder(spark))
    rows = staged(digests(docs), "doc-digests")
    low, high = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
    edges = [low + (high - low + 1) * i // batches for i in range(1, batches)] if low is not None else []
    upper = [None, *reversed(edges)]
    for to, at in zip(upper, [*upper[1:], None], strict=True):
        mine = rows if to is None else rows.where(F.col("doc_id").isNull() | (F.col("doc_id") < to))
        mine = mine if at is None else mine.where(F.col("doc_id") >= at)
        # stored, as else the optimizer moves the anti-join below the aggregate, to all rows of a hot digest
        index.admit(staged(mine.groupBy("digest").agg(F.max("doc_id").alias("keep_id")), "groups"))
    sizes = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"))
    known = staged(sizes.join(index.read_plain(), "digest"), "known")
    if own:
        index.close()
    return rows.join(known, "digest").select("doc_id", "digest", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"))


def drop_exact(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """``docs`` with one row for each text, all columns kept; rules as in ``exact_dedup``.

    Of rows repeated with the same id and text one stays. Dropped rows leave by an anti-join
    on (id, digest), keys that no hot group shares.
    """
    # one struct as the key is never null: the join and the window after it deal rows alike, so text moves once
    gone = exact_dedup(docs, index).where("NOT kept").select(F.struct("doc_id", "digest").alias("__gone"))
    gone = staged(gone, "dropped")
    sha = F.unhex(F.sha2(F.encode(lower_ascii(text_or_empty("text")), "UTF-8"), 256))
    whole = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), F.struct(docs["doc_id"].cast("bigint").alias("doc_id"), sha.alias("digest")).alias("__key"))
    stay = whole.join(gone, F.col("__key") == F.col("__gone"), "left_anti")
    first = F.row_number().over(Window.partitionBy("__key").orderBy(F.xxhash64("row")))
    return stay.withColumn("__n", first).where("__n = 1").select("row.*")


def op7_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract of op7 over the whole ``documents`` table, whose later half of ids is in the index when the earlier comes."""
    found = exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), batches=2)
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP7_SQL = """
WITH t AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""
