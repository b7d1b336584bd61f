"""Which functions are worth sending: the gate, the scope around the entry, ranking and scoring of the choice."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions import text
from sievework.session import staged

from . import graph


def gate(functions: DataFrame, name: str | None = "name") -> DataFrame:
    """``functions`` with one column a clause, the first clause that rejects as ``reason``, and ``worth``.

    Needs ``code``, and from the parser ``parsed_name``, ``calls`` (distinct) and ``cyclomatic``; with
    ``name=None`` the parsed name stands in for the caller's. Clauses on text alone stay in the
    JVM; the order of clauses decides the reason only, not the verdict.
    """
    code, parsed = F.col("code"), F.col("parsed_name")
    given = F.col(name) if name else parsed
    thunk = F.coalesce((F.size("calls") == 1) & (F.col("calls")[0] == parsed) & (F.col("cyclomatic") == 1), F.lit(False))
    clauses = {
        "blank": text.is_blank(code),
        "library": text.is_library(parsed, given),
        "short": text.is_short(code),
        "named_thunk": text.is_named_thunk(given),
        "stub": text.is_stub(code),
        "forwarding_thunk": thunk,
        "named_and_clean": text.is_named_and_clean(code, given),
    }
    out = functions.select("*", *[F.coalesce(c, F.lit(False)).alias(f"is_{n}") for n, c in clauses.items()])
    reason = F.coalesce(*[F.when(F.col(f"is_{n}"), F.lit(n)) for n in clauses])
    return out.withColumn("reason", reason).withColumn("worth", F.col("reason").isNull())


def looks_stripped(functions: DataFrame) -> DataFrame:
    """``(binary_id, stripped)``: half of the names or more are ``FUN_``."""
    return functions.groupBy("binary_id").agg((F.avg(F.startswith("name", F.lit("FUN_")).cast("int")) >= 0.5).alias("stripped"))


def in_scope(vertices: DataFrame, edges: DataFrame, max_depth: int | None = None, default_depth: int = 2, least_share: float = 0.5) -> DataFrame:
    """The vertices near enough to an entry: ``(binary_id, name)``.

    ``max_depth`` None means ``default_depth`` for binaries that look stripped and no filter for others; 0
    means no filter. A binary without an entry, or whose entries reach less than ``least_share`` of it, isn't
    filtered, as depth says nothing about it then.
    """
    every = vertices.select(graph.KEY)
    if max_depth == 0:
        return every
    depth = default_depth if max_depth is None else max_depth
    filtered = looks_stripped(vertices).where("stripped").select("binary_id") if max_depth is None else vertices.select("binary_id").distinct()
    reached = staged(graph.depths(edges, graph.entry_points(vertices, edges)), "depths")
    counts = reached.groupBy("binary_id").agg(F.count(F.lit(1)).alias("reached"))
    total = vertices.groupBy("binary_id").agg(F.count(F.lit(1)).alias("n"))
    usable = staged(total.join(counts, "binary_id").where(F.col("reached") >= least_share * F.col("n")).select("binary_id").join(filtered, "binary_id", "left_semi"), "usable")
    near = reached.where(F.col("depth") <= depth).join(usable, "binary_id", "left_semi").select(graph.KEY)
    return near.union(every.join(usable, "binary_id", "left_anti"))


def selected(gated: DataFrame, scope: DataFrame) -> DataFrame:
    """Functions that pass the gate and lie in scope."""
    return gated.where("worth").join(scope.select(graph.KEY), graph.KEY, "left_semi")


def selection_score(chosen: DataFrame, truth: DataFrame) -> DataFrame:
    """Precision, recall and F1 of ``chosen(address)`` against ``truth(address, is_user)``, one row.

    A choice without a counterpart is a false positive; ratios without a denominator are 0.
    """
    hits = chosen.join(truth, "address", "left").agg(F.count(F.lit(1)).alias("selected"), F.coalesce(F.sum(F.coalesce(F.col("is_user"), F.lit(False)).cast("bigint")), F.lit(0)).alias("true_positives"))
    users = truth.agg(F.count_if("is_user").alias("total_user"))
    both = hits.join(users).withColumn("false_positives", F.col("selected") - F.col("true_positives"))
    return with_f1(both)


def with_f1(counts: DataFrame) -> DataFrame:
    p = F.coalesce(F.try_divide("true_positives", "selected"), F.lit(0.0))
    r = F.coalesce(F.try_divide("true_positives", "total_user"), F.lit(0.0))
    out = counts.withColumn("precision", p).withColumn("recall", r)
    return out.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def ranked(functions: DataFrame) -> DataFrame:
    """Order of work within each binary: score downwards, then name."""
    return functions.withColumn("pos", F.row_number().over(Window.partitionBy("binary_id").orderBy(F.col("score").desc(), "name")))


def resume(todo: DataFrame, renamed: DataFrame, done: DataFrame) -> DataFrame:
    """``todo`` without what is done already under its own stem or the one it was renamed to."""
    current = todo.join(renamed.select("binary_id", F.col("old").alias("name"), "new"), graph.KEY, "left")
    outputs = done.select("binary_id", F.col("stem").alias("stem"))
    own = current.join(outputs, (current["binary_id"] == outputs["binary_id"]) & (current["name"] == outputs["stem"]), "left_anti")
    return own.join(outputs, (own["binary_id"] == outputs["binary_id"]) & (own["new"] == outputs["stem"]), "left_anti").drop("new")
