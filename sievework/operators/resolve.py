"""Which function a call site names: equi-joins in order of precision, and nothing where it is ambiguous."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievework.session import staged


def index(functions: DataFrame) -> DataFrame:
    """One row a way to name a function: ``binary_id, kind, value, name, arity``.

    ``functions(binary_id, name, qualified, base, arity)``: its stem, its qualified and its base name.
    """
    ways = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("value")) for k, c in (("exact", "name"), ("qualified", "qualified"), ("base", "base"))])
    return functions.select("binary_id", "name", "arity", F.explode(ways).alias("way")).select("binary_id", "way.kind", "way.value", "name", "arity")


def candidates(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """``(call_id, name)`` for each function that a call could mean.

    ``calls(call_id, binary_id, text, qualifier, qualified, base, arity)``. A stem equal to the
    text wins. Else a qualified call matches on its whole qualified name only, and a bare one on
    the base name. A known arity narrows several hits, unless that leaves none: for
    qualified calls to the arity or unknown, for bare ones, if more than one, to the arity.

    What a call means is decided on counts of functions by name and arity; only then are functions listed. A way that
    very many calls and functions share is listed in parts, so that no task has all of it.
    """
    named = index(functions)
    kept = staged(_hits(calls, _counted(named)).select("call_id", *_WAY, "n"), "kept")
    a_part = F.greatest(F.lit(_CALLS_A_PART), F.lit(_ROWS_A_PART) / F.max("n"))
    parts = staged(kept.groupBy(*_WAY).agg(F.ceil(F.count(F.lit(1)) / a_part).cast("int").alias("parts")), "parts")
    mine = _same_way(kept.drop("n"), parts, "parts").withColumn("part", F.pmod(F.xxhash64("call_id"), "parts").cast("int"))
    theirs = _same_way(named, parts, "parts").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return _same_way(mine, theirs, "name", "part").select("call_id", "binary_id", "name")


_WAY = ["binary_id", "kind", "value", "arity"]
#: A part of a way has about so many pairs, but so many calls at least: its functions are copied once a part.
_ROWS_A_PART, _CALLS_A_PART = 4_000_000, 64


def _counted(named: DataFrame) -> DataFrame:
    """Functions of one name and arity as one row: a common name costs a call a row an arity, not one a function."""
    return named.groupBy(*_WAY).agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("name"))


def _same_way(left: DataFrame, right: DataFrame, extra: str, *also: str) -> DataFrame:
    """``left`` with ``extra`` of each row of ``right`` of the same way, and of the same ``also``; null arities are the same."""
    keys = ["binary_id", "kind", "value", *also]
    other = right.select(*[F.col(k).alias(f"__{k}") for k in (*keys, "arity")], extra)
    on = F.col("arity").eqNullSafe(F.col("__arity"))
    for k in keys:
        on = on & (F.col(k) == F.col(f"__{k}"))
    return left.join(other, on).select(*[left[c] for c in left.columns if c != extra], other[extra])


def _hits(calls: DataFrame, ways: DataFrame) -> DataFrame:
    """The rows of ``ways`` that each call could mean; a row stands for the ``n`` functions of its name and arity."""
    qualified = F.coalesce(F.col("qualifier"), F.lit("")) != ""
    probes = calls.select(
        "call_id", "binary_id", F.col("arity").alias("wanted"), qualified.alias("is_qualified"),
        F.explode(F.array(F.struct(F.lit("exact").alias("kind"), F.col("text").alias("value")), F.struct(F.when(qualified, "qualified").otherwise("base").alias("kind"), F.when(qualified, F.col("qualified")).otherwise(F.col("base")).alias("value")))).alias("p"),
    ).select("call_id", "binary_id", "wanted", "is_qualified", "p.*")
    hits = probes.join(ways, ["binary_id", "kind", "value"])
    per = Window.partitionBy("call_id", "binary_id")
    hits = hits.withColumn("exact", F.max((F.col("kind") == "exact").cast("int")).over(per)).where("exact = 0 OR kind = 'exact'")
    fits = (F.col("arity") == F.col("wanted")) | (F.col("is_qualified") & (F.col("arity") == -1))
    narrows = (F.col("kind") != "exact") & (F.col("wanted") >= 0) & (F.col("is_qualified") | (F.sum("n").over(per) > 1))
    hits = hits.withColumn("keeps", narrows & fits).withColumn("any", F.max(F.col("keeps").cast("int")).over(per))
    return hits.where("any = 0 OR keeps")


def resolve(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """``(call_id, binary_id, name)`` of the calls that name exactly one function; a guess would be a wrong edge."""
    found = _hits(calls, _counted(index(functions))).groupBy("call_id", "binary_id").agg(F.sum("n").alias("n"), F.min("name").alias("name"))
    return found.where("n = 1").select("call_id", "binary_id", "name")


def ambiguous(functions: DataFrame) -> DataFrame:
    """Base names that several functions share, with the sharers in order."""
    return functions.groupBy("binary_id", "base").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("name")).alias("names")).where("n > 1")


def matched(left: DataFrame, right: DataFrame, tiers: list[str]) -> DataFrame:
    """Of each program's ``left`` rows, those that match ``right`` on the first of ``tiers`` that matches any.

    Tiers are key columns present on both sides, from strict to loose; a program that none matches keeps
    its rows with ``tier`` null, for the caller's fallback. One pass ranks the tiers.
    """
    flagged = left
    for i, key in enumerate(tiers):
        keys = right.select("program_id", key).distinct().withColumn(f"__hit{i}", F.lit(True))
        flagged = flagged.join(keys, ["program_id", key], "left")
    tier = F.coalesce(*[F.when(F.col(f"__hit{i}"), F.lit(i)) for i in range(len(tiers))])
    flagged = flagged.withColumn("tier", tier)
    per = Window.partitionBy("program_id")
    # a row counts for the program's tier if it matches on that tier's key, whatever stricter keys say
    best = F.min("tier").over(per)
    hit = F.coalesce(*[F.when(F.col("__best") == i, F.coalesce(F.col(f"__hit{i}"), F.lit(False))) for i in range(len(tiers))], F.lit(True))
    out = flagged.withColumn("__best", best).where(hit)
    return out.withColumn("tier", F.col("__best")).drop("__best", *[f"__hit{i}" for i in range(len(tiers))])
