"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import ranked, staged

WORDS = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, size)`` rows.

    Sources in code-point order, null last, take ``weights`` in turn and share all of the sizes.
    A target stops at ``most`` times its source's size and the excess is shared again by
    weight. That fixed point is found in one pass: sources fill up in order of
    (cap / weight), so with the first k of them at their caps every other gets weight times
    (total - caps) / (weights left). Works on one row a source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("bigint").alias("source_size"))
    n = len(weights)
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(turn, F.lit(n)) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("cap", most * F.col("source_size"))
    every = Window.partitionBy()
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    per = per.withColumn("level", level)
    # a source is full when even the level it would see as the next to fill reaches its cap
    per = per.withColumn("full", F.col("level") * F.col("weight") >= F.col("cap"))
    per = per.withColumn("shared", F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("weight"), F.col("source"), F.col("level")))).over(every)["level"])
    return per.select("source", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(F.col("shared") * F.col("weight")).alias("target"))


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), most: float = 3.0, seed: int = 20_240_601, cell_rows: int = 20_000) -> DataFrame:
    """How often the mix takes each document: ``row`` (its columns), ``size, source_size, target, copies``.

    A document's expected copies are target / source size of its source. Within a source, documents
    stand in order of the size's bin, eight to an octave, and then of the MD5 of id and text; expected copies are summed up along that order, one random
    offset (from ``seed`` and the source) is added, and a document is emitted once for each integer
    that the running sum crosses; so copies are the expectation rounded up or down, never
    above ``most`` where that is whole. Standing in order of size makes the words taken follow the target closely. The
    running sum is distributed: see ``shared.ranked``.

    Null text has size 0; a null source is a source; null or repeated doc_ids are
    documents of their own, and rows alike in id and text are interchangeable; a source without words is taken 0 times; an empty table gives no rows.
    The result depends on the rows alone, not on their order or partitions, nor on the session's settings.
    """
    whole = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), docs["source"].alias("source"), *_measured(docs))
    slim = staged(docs.select(docs["source"].alias("source"), *_measured(docs)), "sizes")
    return _mix_sizes(whole, slim, weights, most, seed, cell_rows).select("row", "size", "source_size", "target", "copies")


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("bigint")


def _measured(docs: DataFrame) -> list:
    """``size, bin, h``: the words, eight bins to an octave of them, and the MD5 of id and text."""
    size = word_count(docs["text"])
    digits = F.bin(size + 1)
    octave = F.struct(F.length(digits).alias("bits"), F.rpad(F.substring(digits, 2, 3), 3, "0").alias("next"))
    h = F.md5(F.encode(F.concat_ws(":", F.coalesce(docs["doc_id"].cast("string"), F.lit("")), F.coalesce(docs["text"], F.lit(""))), "UTF-8"))
    return [size.alias("size"), octave.alias("bin"), h.alias("h")]


def _mix_sizes(rows: DataFrame, slim: DataFrame, weights: Sequence[float], most: float, seed: int, cell_rows: int) -> DataFrame:
    """``rows(source, size, bin, h, ...)`` with their copies; ``slim`` holds those four columns of the same rows, stored."""
    placed = ranked(rows, ["source"], ["bin"], "h", [], slim.count(), cell_rows, slim)
    targets = staged(source_targets(slim, weights, most), "targets")
    offset = F.conv(F.substring(F.md5(F.encode(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("source"), F.lit("\0"))), "UTF-8")), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))
    per = targets.select(F.col("source").alias("__source"), "source_size", "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("__rate"), offset.alias("__u"))
    out = placed.join(per, F.col("source").eqNullSafe(F.col("__source")))
    crossed = F.floor(F.col("pos") * F.col("__rate") + F.col("__u")) - F.floor((F.col("pos") - 1) * F.col("__rate") + F.col("__u"))
    return out.withColumn("copies", crossed.cast("bigint"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with the columns of ``docs``; rules as in ``mix``."""
    taken = mix(docs, **options).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def op10_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract of op10 over the whole ``documents`` table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    slim = staged(docs.select("doc_id", "source", *_measured(docs)), "sizes")
    out = _mix_sizes(slim, slim, (5, 2, 1), 3.0, 20_240_601, 20_000)
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), ':', coalesce(text, ''))) AS h FROM documents),
b AS (SELECT *, bin(size + 1) AS digits FROM d),
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY length(digits), rpad(substr(digits, 2, 3), 3, '0'), h) AS pos FROM b),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 3.0::DOUBLE * CAST(sum(size) AS DOUBLE) AS cap,
         [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight FROM d GROUP BY source),
l AS (
  SELECT *, (sum(CAST(source_size AS DOUBLE)) OVER () - coalesce(sum(cap) OVER w, 0.0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0.0)) AS level
  FROM s WINDOW w AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, level * weight >= cap AS filled FROM l),
t AS (
  SELECT source, source_size, CASE WHEN filled THEN cap ELSE weight * first_value(level) OVER (ORDER BY filled, cap / weight, source NULLS LAST) END AS target FROM f),
r AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
         CAST(concat('0x', substr(md5(concat('20240601:', coalesce(source, chr(0)))), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE AS u FROM t)
SELECT doc_id, size, source_size, target, CAST(floor(pos * rate + u) - floor((pos - 1) * rate + u) AS BIGINT) * size AS taken
FROM p JOIN r ON p.source IS NOT DISTINCT FROM r.source
"""
