"""Programs of several sources, cases, and candidates in their several layouts."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "id string, tier int, path string, description string, stdin_cases array<string>"
SOURCE_SUFFIXES = (".cpp", ".cc", ".c")


def manifest(spark: SparkSession, entries: Iterable[dict], tier: int | None = None, ids: list[str] | None = None) -> DataFrame:
    """Program rows from manifest entries, filtered by tier and by ids, both if both are given."""
    rows = [(e["id"], int(e["tier"]), e["path"], e.get("description", ""), list(e.get("stdin_cases", []))) for e in entries]
    out = spark.createDataFrame(rows, MANIFEST)
    if tier is not None:
        out = out.where(F.col("tier") == tier)
    return out.where(F.col("id").isin(ids)) if ids is not None else out


def assembled(files: DataFrame) -> DataFrame:
    """``(id, n_files, source, plain, source_hash)`` of ``files(id, name, is_header, path, text)``.

    Headers come first, each kind in order of path. Each has a banner in
    ``source`` and none in ``plain``. The hash is over names and bytes in that order.
    """
    one = F.struct((~F.col("is_header")).alias("unit"), "path", "name", "text")
    per = files.groupBy("id").agg(F.sort_array(F.collect_list(one)).alias("f"))
    banner = F.transform("f", lambda x: F.concat(F.lit("// ===== "), x["name"], F.lit(" =====\n"), x["text"]))
    texts = F.transform("f", lambda x: x["text"])
    joined = F.array_join(F.transform("f", lambda x: F.concat(x["name"], x["text"])), "")
    source = F.array_join(banner, "\n")
    return per.select("id", F.size("f").alias("n_files"), source.alias("source"), F.array_join(texts, "\n\n").alias("plain"), F.substring(F.sha2(F.encode(joined, "UTF-8"), 256), 1, 16).alias("source_hash"))


def source_of(assembled: DataFrame) -> DataFrame:
    """``(id, source)`` with a single file as it is."""
    return assembled.select("id", F.when(F.col("n_files") == 1, F.col("plain")).otherwise(F.col("source")).alias("source"))


def blobs(files: DataFrame) -> DataFrame:
    """``(case, text)`` of ``files(case, path, text)``: ``.cpp`` first, then ``.cc``, then ``.c``, each in order of path."""
    kind = F.coalesce(*[F.when(F.endswith("path", F.lit(s)), i) for i, s in enumerate(SOURCE_SUFFIXES)])
    per = files.withColumn("kind", kind).where("kind IS NOT NULL").groupBy("case").agg(F.sort_array(F.collect_list(F.struct("kind", "path", "text"))).alias("f"))
    return per.select("case", F.array_join(F.transform("f", lambda x: x["text"]), "\n\n").alias("text"))


def resolved(layouts: list[DataFrame]) -> DataFrame:
    """Of several layouts' ``(case, text)``, listed from the most to the least preferred, the first that has a case."""
    from sievework.operators.dedup import first_wins

    return first_wins(*layouts, key=["case"])


def inferred(names: DataFrame, cases: DataFrame) -> DataFrame:
    """``(name, case)``: the case whose lower-cased name is the binary's without build suffixes; null if none is."""
    from sievework.functions.text import infer_case

    known = cases.groupBy(F.lower("case").alias("stem")).agg(F.max_by("case", F.struct(F.length("case"), "case")).alias("case"))
    return names.withColumn("stem", infer_case(F.col("name"))).join(known, "stem", "left").select("name", "case")


def _kind(path: str):
    return F.coalesce(*[F.when(F.endswith(path, F.lit(s)), i) for i, s in enumerate(SOURCE_SUFFIXES)])


def _picked(files: DataFrame, whole: bool) -> DataFrame:
    """``(case, text)`` of ``files(case, path, text)``: the case's own file, else its own folder, else, if ``whole``, all files."""
    alone = F.regexp_replace("path", r"\.[^./]*$", "") == F.col("case")
    rank = F.when(alone, F.col("kind")).when(F.startswith("path", F.concat("case", F.lit("/"))), len(SOURCE_SUFFIXES)).when(F.lit(whole), len(SOURCE_SUFFIXES) + 1)
    ranked = files.withColumn("kind", _kind("path")).where("kind IS NOT NULL").withColumn("rank", rank).where("rank IS NOT NULL").drop("kind")
    best = ranked.groupBy("case").agg(F.min("rank").alias("rank"))
    return blobs(ranked.join(best, ["case", "rank"])).where("text <> ''")


def _of_stage(files: DataFrame, stage: str) -> DataFrame:
    """``files(owner, path, text)`` of each owner's folder ``stage`` if it has one, else all of the owner's."""
    inside = F.startswith("path", F.lit(stage + "/"))
    have = files.groupBy("owner").agg(F.max(inside).alias("staged"))
    kept = files.join(have, "owner").where(~F.col("staged") | inside)
    return kept.select("owner", F.when(F.col("staged"), F.substring("path", F.lit(len(stage) + 2), F.length("path"))).otherwise(F.col("path")).alias("path"), "text")


def candidates(files: DataFrame, cases: DataFrame, root: str, stage: str = "improved", case: str | None = None) -> DataFrame:
    """``(case, text)`` of the candidates in ``files(path, text)``, paths relative to the folder ``root``.

    The first that holds anything: the one ``case`` if it is named; files or folders by a case's name; a folder whose own or parent's name
    gives a case (``inferred``); folders in it whose names do, the first by name of a case. Folders of a binary
    are read from their ``stage`` if they have it.
    """
    spark = files.sparkSession
    whole = _of_stage(files.select(F.lit(root).alias("owner"), "path", "text"), stage)
    named = lambda c: _picked(whole.select(F.lit(c).alias("case"), "path", "text"), True)
    if case is not None:
        return named(case)
    nested = F.contains("path", F.lit("/"))
    top = F.when(nested, F.substring_index("path", "/", 1)).otherwise(F.regexp_replace("path", r"\.[^.]*$", ""))
    classic = _picked(files.select(top.alias("case"), "path", "text").join(cases, "case", "left_semi"), False)
    if not classic.isEmpty():
        return classic
    for part in root.rstrip("/").split("/")[:-3:-1]:
        found = inferred(spark.createDataFrame([(part,)], "name string"), cases).first()
        if found["case"] is not None:
            return named(found["case"])
    below = files.where(nested).select(F.substring_index("path", "/", 1).alias("owner"), F.regexp_replace("path", "^[^/]*/", "").alias("path"), "text")
    owners = inferred(below.select(F.col("owner").alias("name")).distinct(), cases).where("case IS NOT NULL").groupBy("case").agg(F.min("name").alias("owner"))
    return _picked(_of_stage(below, stage).join(owners, "owner").select("case", "path", "text"), True)
