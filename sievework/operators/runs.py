"""Whole runs: the plan before any call, the chain of stages, and reports in the planned order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions import text
from sievework.session import staged

from . import callgraph, dedup, graph, stages


def dry_run(functions: DataFrame, leveled: DataFrame, done: DataFrame, workers: int, preview: int = 8) -> DataFrame:
    """What a run would do, one row a binary: ``functions, done, filtered, todo, levels, sizes, rounds, first``.

    ``functions(binary_id, name, score, worth)``, ``leveled(binary_id, name, level)`` of the whole graph. Levels without work are
    left out of ``levels``, ``sizes`` and ``rounds``; ``first`` are the ``preview`` names of the highest score, ties by name.
    """
    marked = functions.join(done.select(graph.KEY).distinct().withColumn("done", F.lit(True)), graph.KEY, "left").fillna(False, "done")
    todo = F.col("worth") & ~F.col("done")
    counts = marked.groupBy("binary_id").agg(F.count(F.lit(1)).alias("functions"), F.count_if("done").alias("done"), F.count_if(~F.col("worth") & ~F.col("done")).alias("filtered"), F.count_if(todo).alias("todo"))
    work = marked.where(todo)
    sizes = work.join(leveled, graph.KEY).groupBy("binary_id", "level").agg(F.count(F.lit(1)).alias("size"))
    plan = sizes.groupBy("binary_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("level", "size"))), lambda x: x["size"]).alias("sizes"), F.sum(F.ceil(F.col("size") / workers)).cast("bigint").alias("rounds"))
    place = F.row_number().over(Window.partitionBy("binary_id").orderBy(F.col("score").desc(), "name"))
    top = work.select("binary_id", "name", place.alias("place")).where(F.col("place") <= preview)
    top = top.groupBy("binary_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "name"))), lambda x: x["name"]).alias("first"))
    none = F.array().cast("array<bigint>")
    out = counts.join(plan, "binary_id", "left").join(top, "binary_id", "left")
    return out.select("binary_id", "functions", "done", "filtered", "todo", F.size(F.coalesce("sizes", none)).alias("levels"), F.coalesce("sizes", none).alias("sizes"), F.coalesce("rounds", F.lit(0)).alias("rounds"), F.coalesce("first", F.array().cast("array<string>")).alias("first"))


def in_planned_order(outcomes: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds ``turn``, an outcome's place within its binary and status by ``plan(binary_id, name, pos)``; what was not planned comes last, by name."""
    order = Window.partitionBy("binary_id", "status").orderBy(F.col("pos").asc_nulls_last(), "name")
    return outcomes.join(plan.select(*graph.KEY, "pos"), graph.KEY, "left").withColumn("turn", F.row_number().over(order)).drop("pos")


def chain(functions: DataFrame, make: Callable[[], stages.Provider], prompts: stages.Prompts = stages.Prompts()) -> tuple[DataFrame, DataFrame]:
    """Improve, merge types, refine ``functions(binary_id, name, code)``; returns ``(rows, headers)``.

    ``rows``: ``binary_id, name, rep, code, improved, refined, status``. Equal bodies of a binary are handled once. An improvement
    that fails keeps the text it had, as does a refinement (``status`` of the latter is refined or kept).
    """
    keyed = functions.withColumn("body", F.struct("binary_id", text.body_fingerprint(F.col("name"), F.col("code"))))
    grouped = staged(dedup.groups(keyed, "body", "name", "name").select(*graph.KEY, "code", "rep"), "grouped")
    reps = grouped.where("name = rep")
    asked = reps.select(*graph.KEY, F.concat_ws("\n\n", F.lit(prompts.improve), "code").alias("prompt"))
    answers = staged(stages.ask(asked, make, correct=prompts.correct), "answers")
    improved = staged(reps.join(answers, graph.KEY).select(*graph.KEY, F.coalesce("answer", "code").alias("answer")), "improved")
    headers = staged(stages.synthesize(improved, make, prompts=prompts), "headers")
    files = improved.withColumnRenamed("answer", "code")
    context = stages.callee_context(callgraph.build(reps), stages.signatures(improved))
    refined = stages.refine(files, headers, context, make, prompts).withColumnRenamed("code", "refined")
    done = refined.join(improved, graph.KEY).select("binary_id", F.col("name").alias("rep"), F.col("answer").alias("improved"), "refined", "status")
    return grouped.join(done, ["binary_id", "rep"]).select(*graph.KEY, "rep", "code", "improved", "refined", "status"), headers
