"""What a judge thinks of a candidate, and how well a header brings back the original's types. A failure scores 0 with a reason."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.constants import HEADER_WEIGHTS

from . import similarity
from .stages import Provider

AXES = ("correctness", "readability", "naming", "types")
RUBRIC = (
    "Compare rewritten C++ with the original it was compiled from. Rate each of correctness, readability, naming, types and overall "
    "from 0 to 1. Answer with one JSON object of these five keys and a string critique that names what is still missing."
)


def json_of_reply(reply: Column) -> Column:
    """What stands from the first opening to the last closing brace of a reply without fences; empty if nothing does."""
    plain = F.replace(F.replace(reply, F.lit("```json"), F.lit("")), F.lit("```"), F.lit(""))
    return F.regexp_extract(plain, r"(?s)\{.*\}", 0)


def verdict(reply: Column, problem: Column | None = None) -> Column:
    """A struct of ``score``, the four axes, ``critique`` and ``detail``.

    An axis that is missing or no number is 0, a missing overall is the mean of the axes. No reply, a ``problem``,
    no JSON object or an empty one score 0, the axes are null and ``detail`` says why.
    """
    found = F.try_parse_json(json_of_reply(reply))
    number = lambda key: F.try_variant_get(found, f"$.{key}", "double")
    axes = {a: F.coalesce(number(a), F.lit(0.0)) for a in AXES}
    mean = sum(axes.values(), F.lit(0.0)) / len(AXES)
    wrong = F.when(reply.isNull(), "no reply").when(found.isNull() | (F.to_json(found) == "{}"), "reply is no JSON object")
    wrong = wrong if problem is None else F.coalesce(F.when(problem != "", problem), wrong)
    return F.struct(
        F.when(wrong.isNotNull(), 0.0).otherwise(F.coalesce(number("overall"), mean)).alias("score"),
        *[F.when(wrong.isNull(), v).alias(a) for a, v in axes.items()],
        F.when(wrong.isNull(), F.trim(F.coalesce(F.try_variant_get(found, "$.critique", "string"), F.lit("")))).alias("critique"),
        F.coalesce(wrong, F.lit("")).alias("detail"),
    )


def _replies(make: Callable[[], Provider]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = make()
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                try:
                    rows.append((r.binary_id, r.name, provider(r.prompt), ""))
                except Exception as e:  # noqa: BLE001  one bad answer must not end the batch
                    rows.append((r.binary_id, r.name, None, f"{type(e).__name__}: {e}"[:120]))
            yield pd.DataFrame(rows, columns=["binary_id", "name", "reply", "problem"])

    return run


def judge(pairs: DataFrame, make: Callable[[], Provider], rubric: str = RUBRIC, workers: int = 8) -> DataFrame:
    """``(binary_id, name, score, *axes, critique, detail)`` for ``pairs(binary_id, name, original, candidate)``."""
    prompt = F.concat_ws("\n\n", F.lit(rubric), F.lit("Original:"), F.coalesce("original", F.lit("")), F.lit("Rewritten:"), F.coalesce("candidate", F.lit("")))
    asked = pairs.select("binary_id", "name", prompt.alias("prompt")).repartition(workers, "binary_id", "name")
    replies = asked.mapInPandas(_replies(make), "binary_id string, name string, reply string, problem string")
    return replies.select("binary_id", "name", verdict(F.col("reply"), F.col("problem")).alias("v")).select("binary_id", "name", "v.*")


def header_scores(headers: DataFrame, originals: DataFrame, found: DataFrame, weights: dict[str, float] = HEADER_WEIGHTS) -> DataFrame:
    """``(program_id, structs, struct, score, detail)`` of ``headers(program_id, failed, parses, judge)``.

    ``originals`` and ``found`` are structs as in ``similarity.best_match``. ``struct`` is the mean recall of the original structs'
    fields, 1 without any. A run that failed or a header that does not parse scores 0; a null judge takes no part.
    """
    per = similarity.best_match(originals, found).groupBy("program_id").agg(F.count(F.lit(1)).alias("structs"), F.avg("recall").alias("struct"))
    rows = headers.join(per, "program_id", "left").withColumns({"structs": F.coalesce("structs", F.lit(0)), "struct": F.coalesce("struct", F.lit(1.0))})
    usable = ~F.col("failed") & F.col("parses")
    detail = F.when(F.col("failed"), "run failed").when(~F.col("parses"), "header does not parse").when(F.col("structs") == 0, "no structs to recover").otherwise("")
    return rows.select("program_id", "failed", "structs", "struct", similarity.pair_score(usable, F.col("struct"), F.col("judge"), weights).alias("score"), detail.alias("detail"))


def header_control(scored: DataFrame) -> DataFrame:
    """``header_scores`` without the programs that have no structs, unless their run failed."""
    return scored.where("failed OR structs > 0")
