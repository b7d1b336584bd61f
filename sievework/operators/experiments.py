"""Comparing runs, prompts and models from score tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLACK = 1e-9


def mean(score: Column, scale: int, digits: int) -> Column:
    """The mean of scores of at most ``scale`` decimals to ``digits`` decimals, of which there are no fewer; halves away from 0.

    It is summed in whole units: a sum of doubles depends on the order of rows, which decides where a mean lies halfway.
    Scores that are no such numbers, not finite or of 1e9 or more, are averaged as doubles.
    """
    small = F.abs(score) < 1e9  # not so for NaN, which is the largest double
    units = F.sum(F.when(small, F.round(score * 10**scale).cast("decimal(18,0)")))
    n = F.count(score).cast("decimal(18,0)")
    # halves are counted, so that one whole division rounds; there is no score for n = 0 to divide
    halves = F.call_function("div", F.abs(units) * (2 * 10 ** (digits - scale)) + n, F.greatest(2 * n, F.lit(1)))
    return F.when(F.count_if(~small) > 0, F.round(F.avg(score), digits)).otherwise(F.signum(units) * halves / 10**digits)


def paired(scores: DataFrame, seed: str, missing: float | None = None) -> DataFrame:
    """Each candidate against ``seed`` on the same examples: ``mean, delta, wins, losses``.

    ``scores(candidate, example, score)``. Examples that the seed lacks are left out, or count as
    ``missing`` for it. Differences within 1e-9 are neither a win nor a loss.
    """
    base = scores.where(F.col("candidate") == seed).select("example", F.col("score").alias("base"))
    both = scores.join(base, "example", "inner" if missing is None else "left")
    both = both.withColumn("base", F.coalesce("base", F.lit(missing)) if missing is not None else F.col("base"))
    return both.groupBy("candidate").agg(
        F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean"), F.avg(F.col("score") - F.col("base")).alias("delta"),
        F.count_if(F.col("score") > F.col("base") + SLACK).alias("wins"), F.count_if(F.col("score") < F.col("base") - SLACK).alias("losses"),
    )


def winner(table: DataFrame) -> DataFrame:
    """The candidate of the largest mean, ties to the first by name."""
    return table.orderBy(F.col("mean").desc(), "candidate").limit(1)


def repeated(scores: DataFrame) -> DataFrame:
    """Mean and sample deviation over repeats of each repeat's mean; one repeat deviates by 0."""
    per = scores.groupBy("candidate", "repeat").agg(F.avg("score").alias("m"))
    return per.groupBy("candidate").agg(F.count(F.lit(1)).alias("repeats"), F.avg("m").alias("mean"), F.coalesce(F.stddev_samp("m"), F.lit(0.0)).alias("stdev"))


def pareto_wins(scores: DataFrame) -> DataFrame:
    """How many examples each candidate is best at, ties counting for all and scores of 0 for none; and its weight, one more."""
    top = F.max("score").over(Window.partitionBy("example"))
    marked = scores.withColumn("top", top)
    return marked.groupBy("candidate").agg(F.count_if((F.col("score") >= F.col("top")) & (F.col("top") > 0)).alias("wins")).withColumn("weight", F.col("wins") + 1)


def best_so_far(rows: DataFrame, order: str, score: str, group: str) -> DataFrame:
    """Marks rows whose score is above all before; the first one is the start, not a best."""
    before = F.max(score).over(Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("best", F.coalesce(F.col(score) > before, F.lit(False)))


def against_baseline(now: DataFrame, base: DataFrame) -> DataFrame:
    """``(case, overall, baseline, delta)``: every case of the run, with its baseline if it has one."""
    return now.join(base.select("case", F.col("overall").alias("baseline")), "case", "left").withColumn("delta", F.col("overall") - F.col("baseline"))


def degrades(means: DataFrame, order: str, mean: str, group: str, slack: float = 0.02) -> DataFrame:
    """Does a group's last mean lie more than ``slack`` below its first?"""
    per = means.groupBy(group).agg(F.min_by(mean, order).alias("first"), F.max_by(mean, order).alias("last"))
    return per.withColumn("degrades", F.col("last") < F.col("first") - slack)


def leaderboard(table: DataFrame, score: str, name: str) -> DataFrame:
    """Ranked by score, undefined ones last, ties by name; a rank for every row."""
    return table.withColumn("rank", F.row_number().over(Window.orderBy(F.col(score).desc_nulls_last(), name)))


def worst(scores: DataFrame, k: int) -> DataFrame:
    """The ``k`` + 1 lowest cases, ties by example."""
    return scores.orderBy("score", "example").limit(k + 1)


def costs(calls: DataFrame) -> DataFrame:
    """What each model's calls that were not answered from the cache took."""
    fresh = ~F.col("cached")
    return calls.groupBy("model").agg(F.count_if(fresh).alias("calls"), F.coalesce(F.sum(F.when(fresh, F.col("seconds"))), F.lit(0.0)).alias("seconds"))


def split(examples: DataFrame, share: float, seed: int = 0) -> DataFrame:
    """Marks about ``share`` of the examples as validation, one at least, by a stable hash of (seed, program, name).

    Not the draw of a seeded shuffle, but the same on every run and cluster: the first max(1, int(n x share)) by hash.
    """
    marked = examples.withColumn("__hash", F.xxhash64(F.lit(seed), "program_id", "name")).withColumn("__part", F.shiftright("__hash", 48))
    # places within parts of the hash's range; only the parts, at most 65,536 rows, are summed in one task
    sizes = marked.groupBy("__part").agg(F.count(F.lit(1)).alias("__size"))
    before = F.sum("__size").over(Window.orderBy("__part")) - F.col("__size")
    parts = sizes.select("__part", before.alias("__before"), F.sum("__size").over(Window.partitionBy(F.lit(0))).alias("__n"))
    place = F.col("__before") + F.row_number().over(Window.partitionBy("__part").orderBy("__hash", "program_id", "name"))
    fold = F.when(place <= F.greatest(F.lit(1), F.floor(F.col("__n") * share)), "val").otherwise("train")
    return marked.join(parts, "__part").withColumn("fold", fold).select(*examples.columns, "fold")


def uncached(todo: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """What the cache has no answer for; keys should name model and judge as well as prompt and example."""
    return todo.join(cache.select(*keys).distinct(), keys, "left_anti")


def eta(done: Column, total: Column, elapsed: Column) -> Column:
    """Seconds left at the pace so far; null before the first is done, 0 at the end."""
    return F.when(done <= 0, None).when(done >= total, 0.0).otherwise(elapsed / done * (total - done))


def control(scores: DataFrame, group: str, case: str, score: str) -> DataFrame:
    """A run's baseline, one row a group: ``n`` cases, those ``defined``, ``best_score`` (the mean of these, 0 without any) and ``per_case``."""
    one = F.struct(F.col(case).alias("case"), F.round(score, 4).alias("score"))
    return scores.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.count(score).alias("defined"), F.round(F.coalesce(F.avg(score), F.lit(0.0)), 4).alias("best_score"),
        F.sort_array(F.collect_list(one)).alias("per_case"),
    )


def before_after(scores: DataFrame, group: str) -> DataFrame:
    """``n, base_mean, refined_mean, delta`` of ``scores(group, failed, base, refined)``, failed cases left out; means without a case are 0."""
    mean = lambda c: F.coalesce(F.avg(F.when(~F.col("failed"), F.col(c))), F.lit(0.0))
    per = scores.groupBy(group).agg(F.count_if(~F.col("failed")).alias("n"), mean("base").alias("base_mean"), mean("refined").alias("refined_mean"))
    return per.withColumn("delta", F.col("refined_mean") - F.col("base_mean"))
