"""How near a candidate comes to its original: recalls, cosine, weighted means, best matches. Null is an undefined metric."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.functions.constants import SIMILARITY_WEIGHTS


def recall(original: Column, candidate: Column) -> Column:
    """The share of a set that the other holds; null for an empty original."""
    wanted = F.array_distinct(original)
    return F.try_divide(F.size(F.array_intersect(wanted, candidate)), F.size(wanted))


def lost_recovery(original: Column, raw: Column, improved: Column) -> Column:
    """Of what decompiling lost, the share that came back, as a struct with the counts; 1 if nothing was lost."""
    lost = F.array_except(original, raw)
    back = F.array_intersect(lost, improved)
    score = F.when(F.size(lost) == 0, 1.0).otherwise(F.try_divide(F.size(back), F.size(lost)))
    return F.struct(score.alias("score"), F.size(lost).alias("recoverable"), F.size(back).alias("recovered"), F.slice(F.array_sort(F.array_except(lost, improved)), 1, 12).alias("missed"))


def cosine(a: Column, b: Column) -> Column:
    """Of two columns of count maps; 0 if either is empty. For token arrays see ``token_cosine``."""
    square = lambda m: F.sqrt(F.aggregate(F.map_values(m), F.lit(0.0), lambda s, v: s + v.cast("double") * v))
    dot = F.aggregate(F.map_keys(a), F.lit(0.0), lambda s, key: s + F.coalesce(F.element_at(a, key) * F.element_at(b, key).cast("double"), F.lit(0.0)))
    return F.coalesce(F.try_divide(dot, square(a) * square(b)), F.lit(0.0))


def token_cosine(rows: DataFrame, key: list[str], a: Column, b: Column) -> DataFrame:
    """``(*key, cosine)`` of the counts of two token arrays a row; 0 where they share none or one is empty.

    Both sides' counts of a token meet in one aggregate, so no text is compared with another and the
    work is that of the tokens.
    """
    tokens = lambda c, i: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda t: F.struct(t.alias("t"), F.lit(i).alias("a"), F.lit(1 - i).alias("b")))
    flat = rows.select(*key, F.explode_outer(F.concat(tokens(a, 1), tokens(b, 0))).alias("x")).select(*key, "x.*")
    counts = flat.groupBy(*key, "t").agg(F.sum("a").cast("double").alias("a"), F.sum("b").cast("double").alias("b"))
    sums = counts.groupBy(*key).agg(F.sum(F.col("a") * F.col("b")).alias("dot"), F.sqrt(F.sum(F.col("a") * F.col("a"))).alias("na"), F.sqrt(F.sum(F.col("b") * F.col("b"))).alias("nb"))
    return sums.select(*key, F.coalesce(F.try_divide("dot", F.col("na") * F.col("nb")), F.lit(0.0)).alias("cosine"))


def weighted(values: dict[str, Column], weights: dict[str, float]) -> Column:
    """The weighted mean of the values that are not null; 0 if none is."""
    total, weight = F.lit(0.0), F.lit(0.0)
    for name, v in values.items():
        total = total + F.coalesce(v * weights[name], F.lit(0.0))
        weight = weight + F.when(v.isNotNull(), weights[name]).otherwise(0.0)
    return F.coalesce(F.try_divide(total, weight), F.lit(0.0))


@F.pandas_udf(T.DoubleType())
def sequence_ratio(original: pd.Series, candidate: pd.Series) -> pd.Series:
    """difflib's ratio of two token arrays; the order of the arguments matters."""
    return pd.Series([difflib.SequenceMatcher(None, list(a), list(b), autojunk=False).ratio() for a, b in zip(original, candidate, strict=True)])


def compare(pairs: DataFrame, weights: dict[str, float] = SIMILARITY_WEIGHTS) -> DataFrame:
    """Scores of ``pairs`` whose ``original`` and ``candidate`` are parsed code (``codeparse.parse``).

    Structs of ``tokens, histogram, identifiers, literals, blank``. A blank side scores 0 with
    the recalls undefined.
    """
    o, c = F.col("original"), F.col("candidate")
    blank = o["blank"] | c["blank"]
    scored = pairs.withColumn("structure", F.when(blank, 0.0).otherwise(sequence_ratio(o["tokens"], c["tokens"])))
    scored = scored.withColumn("ast_shape", F.when(blank, 0.0).otherwise(cosine(o["histogram"], c["histogram"])))
    for name, part in (("identifier", "identifiers"), ("literal", "literals")):
        scored = scored.withColumn(f"{name}_recovery", F.when(~blank, recall(o[part], c[part])))
        scored = scored.withColumn(f"{part}_total", F.when(blank, 0).otherwise(F.size(o[part]))).withColumn(f"{part}_recovered", F.when(blank, 0).otherwise(F.size(F.array_intersect(o[part], c[part]))))
    overall = F.when(blank, 0.0).otherwise(weighted({n: F.col(n) for n in weights}, weights))
    return scored.withColumn("overall", overall)


def best_match(left: DataFrame, right: DataFrame, group: str = "program_id") -> DataFrame:
    """For each left set the right set of its group that shares the largest part of it.

    ``left(group, name, ord, fields)``, ``right`` alike. Fields meet by an equi-join, so sets without a
    common field never pair. The first right set, by ``ord``, of the largest overlap wins; without
    overlap there is no match and the recall is 0.
    """
    fields = lambda d, p: d.select(group, F.col("name").alias(f"{p}_name"), F.col("ord").alias(f"{p}_ord"), F.explode(F.array_distinct("fields")).alias("field"))
    shared = fields(left, "l").join(fields(right, "r"), [group, "field"]).groupBy(group, "l_name", "r_name", "r_ord").agg(F.count(F.lit(1)).alias("overlap"))
    first = F.row_number().over(Window.partitionBy(group, "l_name").orderBy(F.col("overlap").desc(), "r_ord"))
    best = shared.withColumn("n", first).where("n = 1").select(group, F.col("l_name").alias("name"), F.col("r_name").alias("match"), "overlap")
    out = left.select(group, "name", F.size(F.array_distinct("fields")).alias("total")).join(best, [group, "name"], "left")
    return out.select(group, "name", "match", F.coalesce("overlap", F.lit(0)).alias("overlap"), F.coalesce(F.try_divide("overlap", "total"), F.lit(0.0)).alias("recall"))


def pair_score(parses: Column, identifier: Column, judge: Column, weights: dict[str, float]) -> Column:
    """0 unless it parses; else the weighted mean of the parts that are there."""
    parts = {"identifier": identifier, "judge": judge} if "identifier" in weights else {"struct": identifier, "judge": judge}
    return F.when(~parses, 0.0).otherwise(weighted(parts, weights))
