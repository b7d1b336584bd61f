"""Stages that call a model: improve, merge types, refine, name. The model is a ``Provider`` of the caller's.

Spark may run a task twice, so a provider may be asked twice. Answers are therefore stored
as they come, and what has an answer is not asked again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.functions import codeparse, text
from sievework.session import staged

from . import dedup, graph, naming


class Provider(Protocol):
    """Answers a prompt. Made once a partition by a picklable factory."""

    def __call__(self, prompt: str) -> str: ...


@dataclass(frozen=True)
class Prompts:
    improve: str = "Improve the readability of this decompiled C++ without changing what it does. Return code only."
    correct: str = "That did not parse as C++. Return corrected, complete code only."
    refine: str = "Refine this function with the project's types and its callees' signatures. Return code only."
    name: str = "Name this function with one lower_snake_case identifier, or UNKNOWN if it gives no clue."
    merge: str = "Merge these type fragments into one header without duplicates. Return code only."


def _ask(make: Callable[[], Provider], attempts: int, correct: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = make()
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                answer, status, detail, prompt = None, "failed", "", r.prompt
                try:
                    for _ in range(attempts):
                        reply = provider(prompt)
                        answer = _code(reply)
                        if codeparse.is_valid(answer):
                            status = "ok"
                            break
                        detail, prompt = "output does not parse", f"{r.prompt}\n\n{reply}\n\n{correct}"
                except Exception as e:  # noqa: BLE001  one bad answer must not end the batch
                    detail = f"{type(e).__name__}: {e}"[:120]
                rows.append((r.binary_id, r.name, answer if status == "ok" else None, status, detail if status != "ok" else ""))
            yield pd.DataFrame(rows, columns=["binary_id", "name", "answer", "status", "detail"])

    return run


def _code(reply: str) -> str:
    import re

    block = re.search(r"```(?:cpp|c\+\+|c)?\s*\n(.*?)```", reply, re.DOTALL)
    return (block.group(1) if block else reply.replace("```cpp", "").replace("```", "")).strip()


ANSWER = "binary_id string, name string, answer string, status string, detail string"


def ask(prompts: DataFrame, make: Callable[[], Provider], attempts: int = 2, correct: str = Prompts.correct, workers: int = 8) -> DataFrame:
    """``(binary_id, name, answer, status, detail)`` for ``prompts(binary_id, name, prompt)``.

    An answer has to parse; else the provider is asked again with its reply and a correction. Failures are
    rows, never exceptions. ``workers`` bounds how many are asked at a time.
    """
    return prompts.select("binary_id", "name", "prompt").repartition(workers, "binary_id", "name").mapInPandas(_ask(make, attempts, correct), ANSWER)


def callee_context(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """``(binary_id, name, context)``: the recorded signatures of a function's callees, in order of their original names."""
    known = symbols.select("binary_id", F.col("original").alias("dst"), "new_name", "signature")
    line = F.concat(F.col("signature"), F.lit(";"), F.when(F.col("new_name") != F.col("dst"), F.concat(F.lit("  // was "), F.col("dst"))).otherwise(""))
    lines = edges.join(known, ["binary_id", "dst"]).groupBy("binary_id", F.col("src").alias("name")).agg(F.sort_array(F.collect_list(F.struct("dst", line.alias("line")))).alias("l"))
    return lines.select("binary_id", "name", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("context"))


def sibling_context(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """``(binary_id, name, context)`` for refining: callees matched by new name; without a match, all siblings.

    ``calls(binary_id, name, current, callee)``, one row a call or one with a null callee.
    """
    sig = symbols.select("binary_id", F.col("original").alias("o"), F.col("new_name").alias("n"), "signature")
    own = calls.select("binary_id", "name", "current").distinct()
    direct = calls.where("callee IS NOT NULL AND callee <> current").join(sig, (calls["binary_id"] == sig["binary_id"]) & (calls["callee"] == sig["n"])).select(calls["binary_id"], "name", F.col("n").alias("key"), "signature").distinct()
    found = staged(direct, "context")
    rest = own.join(found.select("binary_id", "name").distinct(), ["binary_id", "name"], "left_anti")
    others = rest.join(sig, "binary_id").where("n <> current AND o <> current").select("binary_id", "name", F.col("o").alias("key"), "signature")
    lines = found.union(others).groupBy("binary_id", "name").agg(F.sort_array(F.collect_list(F.struct("key", F.concat("signature", F.lit(";")).alias("line")))).alias("l"))
    return own.select("binary_id", "name").join(lines, ["binary_id", "name"], "left").select("binary_id", "name", F.coalesce(F.array_join(F.transform("l", lambda x: x["line"]), "\n"), F.lit("// (no related functions)")).alias("context"))


def signatures(improved: DataFrame) -> DataFrame:
    """``(binary_id, original, new_name, signature)`` of improved code's first function."""
    shaped = improved.withColumn("s", codeparse.shape(F.col("answer")))
    return shaped.where("s.parsed_name IS NOT NULL").select("binary_id", F.col("name").alias("original"), F.col("s.parsed_name").alias("new_name"), F.col("s.signature").alias("signature"))


def improve(functions: DataFrame, edges: DataFrame, todo: DataFrame, done: DataFrame, make: Callable[[], Provider], limit: int | None = None, workers: int = 8, prompts: Prompts = Prompts()) -> tuple[DataFrame, DataFrame]:
    """Improve ``todo(binary_id, name, score)`` leaves first; returns ``(outcomes, symbols)``.

    Work is cut to ``limit`` in order of (level, score, name) after filtering, then levelled again over
    what is left, so that functions without a bond run side by side. A level sees the signatures of the
    levels below only. Outcomes: ``binary_id, name, status, detail, answer`` with status improved or failed; a
    failure is not recorded as done, so that the next run tries again.
    """
    vertices = functions.select("binary_id", "name")
    order = graph.ordered(vertices.join(todo.select("binary_id", "name", F.col("score").alias("priority")), graph.KEY, "left").fillna(0.0, "priority"), edges)
    plan = order.join(todo.select(graph.KEY), graph.KEY, "left_semi")
    if limit is not None:
        plan = graph.limited(plan, limit)
    chosen = staged(plan.select(graph.KEY), "chosen")
    leveled = staged(graph.levels_subset(vertices, edges, chosen), "leveled")
    symbols = staged(signatures(done), "symbols")
    outcomes = functions.sparkSession.createDataFrame([], ANSWER)
    levels = leveled.agg(F.max("level")).first()[0]
    for level in range(0 if levels is None else levels + 1):
        now = leveled.where(F.col("level") == level).join(functions, graph.KEY).join(callee_context(edges, symbols), graph.KEY, "left")
        prompt = F.concat_ws("\n\n", F.lit(prompts.improve), F.when(F.col("context").isNotNull(), F.concat(F.lit("Callees:\n"), "context")), "code")
        answers = staged(ask(now.select(*graph.KEY, prompt.alias("prompt")), make, correct=prompts.correct, workers=workers), "answers")
        outcomes = outcomes.union(answers)
        symbols = staged(dedup.first_wins(symbols, signatures(answers.where("status = 'ok'")), key=["binary_id", "original"]), "symbols")
    status = F.when(F.col("status") == "ok", "improved").otherwise("failed")
    return outcomes.withColumn("status", status), symbols


def fragments(improved: DataFrame) -> DataFrame:
    """``(binary_id, text, n)``: each binary's types and declarations, in order of file and place."""
    found = codeparse.items(improved.select("binary_id", "name", F.col("answer").alias("code"))).where("kind IN ('struct', 'class', 'declaration')")
    piece = F.struct("name", "ordinal", F.concat(F.lit("// From "), "name", F.lit(".cpp\n"), "body").alias("text"))
    return found.groupBy("binary_id").agg(F.sort_array(F.collect_list(piece)).alias("p")).select("binary_id", F.array_join(F.transform("p", lambda x: x["text"]), "\n\n").alias("text"), F.size("p").alias("n"))


def synthesize(improved: DataFrame, make: Callable[[], Provider], attempts: int = 3, prompts: Prompts = Prompts()) -> DataFrame:
    """One header a binary from its fragments; a binary without any, or whose calls all fail, has none."""
    asked = fragments(improved).select("binary_id", F.lit("project.h").alias("name"), F.concat_ws("\n\n", F.lit(prompts.merge), "text").alias("prompt"))
    return ask(asked, make, attempts=attempts, correct=prompts.correct)


def refine(files: DataFrame, headers: DataFrame, context: DataFrame, make: Callable[[], Provider], prompts: Prompts = Prompts()) -> DataFrame:
    """``(binary_id, name, code, status)``: each file refined once; what fails or does not parse keeps its text."""
    head = headers.where("status = 'ok'").select("binary_id", F.col("answer").alias("header"))
    rows = files.join(head, "binary_id", "left").join(context, graph.KEY, "left")
    asked = rows.select(*graph.KEY, F.concat_ws("\n\n", F.lit(prompts.refine), "header", "context", "code").alias("prompt"))
    got = ask(asked, make, attempts=1).select(*graph.KEY, "answer", "status")
    return files.join(got, graph.KEY).select(*graph.KEY, F.coalesce("answer", "code").alias("code"), F.when(F.col("status") == "ok", "refined").otherwise("kept").alias("status"))


def name_all(files: DataFrame, edges: DataFrame, symbols: DataFrame, make: Callable[[], Provider], prompts: Prompts = Prompts()) -> tuple[DataFrame, DataFrame]:
    """Name every placeholder, callees before callers, and rewrite all files; returns ``(files, renames)``.

    ``files(binary_id, name, code)`` by stem. Proposals of a level are asked with the names found below it; they
    are made unique in order of (level, stem), so that reruns agree, with as many numbers as it takes.
    """
    current = staged(files.join(symbols.select("binary_id", F.col("original").alias("name"), "new_name"), graph.KEY, "left").select("binary_id", F.col("name").alias("stem"), F.coalesce(F.when(F.col("new_name") != "", F.col("new_name")), text.strip_address(F.col("name"))).alias("current"), "code"), "current")
    todo = current.where(text.is_synthetic(F.col("current"))).select("binary_id", F.col("stem").alias("name"))
    vertices = current.select("binary_id", F.col("stem").alias("name"))
    leveled = staged(graph.levels_subset(vertices, edges, todo), "leveled")
    renames = files.sparkSession.createDataFrame([], "binary_id string, old string, new string")
    top = leveled.agg(F.max("level")).first()[0]
    for level in range(0 if top is None else top + 1):
        called = edges.join(current.select("binary_id", F.col("stem").alias("dst"), F.col("current").alias("callee")), ["binary_id", "dst"]).join(renames.select("binary_id", F.col("old").alias("callee"), "new"), ["binary_id", "callee"], "left")
        names = F.coalesce("new", "callee")
        lists = called.where(~text.is_synthetic(names)).groupBy("binary_id", F.col("src").alias("name")).agg(F.slice(F.sort_array(F.collect_set(names)), 1, 20).alias("calls"))
        now = leveled.where(F.col("level") == level).join(current.withColumnRenamed("stem", "name"), graph.KEY).join(lists, graph.KEY, "left")
        prompt = F.concat_ws("\n\n", F.lit(prompts.name), F.when(F.col("calls").isNotNull(), F.concat(F.lit("It calls: "), F.array_join("calls", ", "))), "code")
        replies = now.select(*graph.KEY, "current", prompt.alias("prompt")).repartition("binary_id", "name")

        def propose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            provider = make()
            for pdf in batches:
                out = []
                for r in pdf.itertuples():
                    try:
                        out.append((r.binary_id, r.current, provider(r.prompt), r.name))
                    except Exception:  # noqa: BLE001  declined
                        out.append((r.binary_id, r.current, None, r.name))
                yield pd.DataFrame(out, columns=["binary_id", "old", "reply", "stem"])

        from pyspark.sql import Window

        got = replies.mapInPandas(propose, "binary_id string, old string, reply string, stem string").withColumn("proposal", text.proposal_of_reply(F.col("reply")))
        got = got.withColumn("pos", F.row_number().over(Window.partitionBy("binary_id").orderBy("stem"))).where("proposal IS NOT NULL")
        used = naming.taken_names(symbols, current.select("binary_id", F.col("current").alias("name"))).union(renames.select("binary_id", "new"))
        renames = staged(renames.union(naming.assign(got, used, last=None)), "renames")
    out = naming.apply(current.select("binary_id", F.col("stem").alias("name"), "code"), renames)
    return out, renames
