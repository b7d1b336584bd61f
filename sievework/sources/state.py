"""State as tables that only grow, with views of what holds now."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUNS = "timestamp string, stage string, provider string, model string, binary string, improved int, skipped int, refined int, header_written boolean, endpoint string"
NAMES = "functions map<string,string>, files map<string,string>"


def append(df: DataFrame, path: str, form: str = "parquet") -> None:
    df.write.mode("append").format(form).save(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON state file; what can't be read counts as absent, so corrupt state is empty state."""
    raw = spark.read.text(path, wholetext=True)
    parsed = raw.select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("s"))
    return parsed.where("s IS NOT NULL").select("s.*")


def runs(spark: SparkSession, path: str) -> DataFrame:
    """The runs recorded in a JSON list; a corrupt file has none."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", f"array<struct<{RUNS.replace(' ', ':').replace(',:', ',')}>>").alias("r"))
    return raw.where("r IS NOT NULL").select(F.explode("r").alias("x")).where("x.timestamp IS NOT NULL").select("x.*")


def names(spark: SparkSession, path: str) -> DataFrame:
    """``(kind, old, new)`` of a names file, with the earlier flat shape read as functions."""
    raw = spark.read.text(path, wholetext=True)
    both = raw.select(F.from_json("value", NAMES).alias("n"), F.from_json("value", "map<string,string>").alias("flat"))
    nested = F.col("n.functions").isNotNull() | F.col("n.files").isNotNull()
    empty = F.create_map().cast("map<string,string>")
    both = both.select(F.when(nested, F.coalesce("n.functions", empty)).otherwise(F.coalesce("flat", empty)).alias("functions"), F.when(nested, F.coalesce("n.files", empty)).otherwise(empty).alias("files"))
    per = [both.select(F.lit(k).alias("kind"), F.explode(k).alias("old", "new")) for k in ("functions", "files")]
    return per[0].union(per[1])


def models_used(runs: DataFrame) -> DataFrame:
    """The distinct models in order of first use, joined, from ``runs(model, at)``."""
    first = runs.where("model IS NOT NULL").groupBy("model").agg(F.min("at").alias("at"))
    return first.agg(F.sort_array(F.collect_list(F.struct("at", "model"))).alias("m")).select(F.array_join(F.transform("m", lambda x: x["model"]), " + ").alias("models"))


def lookup(store: DataFrame, wanted: DataFrame) -> DataFrame:
    """The stored documents of the wanted names."""
    return store.join(wanted, "name", "left_semi")


def log_results(df: DataFrame, path: str) -> None:
    """Append result rows as JSON lines, scores rounded to 4 places."""
    rounded = [F.round(c, 4).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    df.select(*rounded).write.mode("append").json(path)


def log_leaderboard(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("header", True).csv(path)
