"""Bodies that need to be handled once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def groups(rows: DataFrame, key: str, order: str, name: str) -> DataFrame:
    """Each row's representative, the first by ``order`` of those with its ``key``: adds ``rep`` and ``members``. Null is a key like any other."""
    reps = rows.groupBy(F.col(key).alias("__key")).agg(F.min_by(name, order).alias("rep"), F.count(F.lit(1)).alias("members"))
    return rows.join(reps, F.col(key).eqNullSafe(F.col("__key"))).drop("__key")


def unique_keys(rows: DataFrame, key: str, name: str) -> DataFrame:
    """``(key, name)`` of the keys that one row alone claims."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.first(name).alias(name)).where("n = 1").select(key, name)


def fan_out(rows: DataFrame, key: str, order: str, name: str, apply) -> DataFrame:
    """Apply an expensive ``apply(representatives)`` once a group and give each member its representative's result.

    ``apply`` takes the representatives' rows, one a group, and returns their ``key``, ``name`` and ``result``: a name alone need not tell groups apart.
    """
    grouped = groups(rows, key, order, name)
    reps = grouped.where(F.col(name).eqNullSafe(F.col("rep"))).drop("rep", "members").dropDuplicates([key, name])
    done = apply(reps).select(F.col(key).alias("__key"), F.col(name).alias("__name"), "result")
    joined = grouped.join(done, F.col(key).eqNullSafe(F.col("__key")) & F.col("rep").eqNullSafe(F.col("__name")))
    return joined.select(*rows.columns, "rep", "result")


def first_wins(*sources: DataFrame, key: list[str]) -> DataFrame:
    """The union of ``sources`` with one row a key, from the earliest source that has it."""
    ranked = [s.withColumn("__rank", F.lit(i)) for i, s in enumerate(sources)]
    every = ranked[0]
    for s in ranked[1:]:
        every = every.unionByName(s)
    value = F.struct(*[c for c in every.columns if c not in (*key, "__rank")])
    return every.groupBy(*key).agg(F.min_by(value, "__rank").alias("v")).select(*key, "v.*")


def last_wins(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The latest row of each key by ``order``."""
    value = F.struct(*[c for c in rows.columns if c not in key])
    return rows.groupBy(*key).agg(F.max_by(value, F.struct(*order)).alias("v")).select(*key, "v.*")
