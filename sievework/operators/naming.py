"""Names for what has none, and applying them everywhere."""

from __future__ import annotations

import re
from itertools import count

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.functions import text
from sievework.functions.constants import IDENTIFIER, RESERVED, SYNTHETIC


def taken_names(symbols: DataFrame, current: DataFrame) -> DataFrame:
    """``(binary_id, name)`` of what a new name must not equal: names in use that are no placeholders, and current ones."""
    used = symbols.where(F.col("new_name").isNotNull() & (F.col("new_name") != "") & ~text.is_synthetic(F.col("new_name"))).select("binary_id", F.col("new_name").alias("name"))
    return used.union(current.where("name IS NOT NULL AND name <> ''").select("binary_id", "name")).distinct()


def unique_name(proposal: str | None, taken: set[str], last: int | None = 99) -> str | None:
    """The proposal, or it with the first free number from 2 to ``last``, None being no end; None if it can't be a name."""
    return _next_name(proposal, taken, 1, last)[0]


def _next_name(proposal: str | None, taken: set[str], start: int, last: int | None) -> tuple[str | None, int]:
    """The first free name from number ``start`` to ``last``, 1 being the proposal itself, and that number; a later one if there is none."""
    if not proposal or not re.match(IDENTIFIER, proposal) or proposal in RESERVED or re.match(SYNTHETIC, proposal):
        return None, start
    for i in count(start) if last is None else range(start, last + 1):
        name = proposal if i == 1 else f"{proposal}_{i}"
        if name not in taken:
            return name, i
    return None, last + 1


def assign(proposals: DataFrame, taken: DataFrame, last: int | None = 99) -> DataFrame:
    """``(binary_id, old, new)`` for ``proposals(binary_id, old, proposal, pos)``; rejected ones have no row.

    Each choice depends on those before it, so a binary's proposals are folded in order of ``pos`` in one
    task; they are at most as many as its functions. Numbers end at ``last``, or nowhere if it is None: then
    only what can't be a name is rejected.
    """
    both = proposals.select("binary_id", "old", "proposal", "pos").unionByName(taken.select("binary_id", F.lit(None).cast("string").alias("old"), F.col("name").alias("proposal"), F.lit(-1).alias("pos")))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        used = set(pdf.loc[pdf["pos"] < 0, "proposal"]) | set(RESERVED)
        rows, tried = [], {}
        for r in pdf[pdf["pos"] >= 0].sort_values(["pos", "old"]).itertuples():
            # names are never freed, so what was taken for a proposal before is taken now
            new, tried[r.proposal] = _next_name(r.proposal, used, tried.get(r.proposal, 1), last)
            if new:
                used.add(new)
                rows.append((r.binary_id, r.old, new))
        return pd.DataFrame(rows, columns=["binary_id", "old", "new"])

    return both.groupBy("binary_id").applyInPandas(fold, "binary_id string, old string, new string")


def apply(files: DataFrame, renames: DataFrame, code: str = "code") -> DataFrame:
    """``files(binary_id, ..., code)`` with every whole word that ``renames(binary_id, old, new)`` lists replaced.

    New names are no placeholders, so no rename feeds another. The distinct words of a text meet the renames in an
    equi-join, so that a text carries its own renames only and its work does not grow with their number.
    """
    wanted = renames.where("old <> new").select("binary_id", F.col("old").alias("__old"), F.col("new").alias("__new"))
    mark = lambda df: F.sha2(F.encode(df[code], "UTF-8"), 256)
    texts = files.select("binary_id", mark(files).alias("__text"), F.explode(F.array_distinct(F.regexp_extract_all(code, F.lit("[A-Za-z0-9_]+"), F.lit(0)))).alias("__old"))
    # the same text may be there more than once; its renames are the same
    hits = texts.join(wanted, ["binary_id", "__old"]).groupBy("binary_id", "__text").agg(F.map_from_entries(F.collect_set(F.struct("__old", "__new"))).alias("__map"))
    words = F.regexp_extract_all(code, F.lit(r"[A-Za-z0-9_]+|[^A-Za-z0-9_]+"), F.lit(0))
    joined = files.withColumn("__text", mark(files)).join(hits, ["binary_id", "__text"], "left")
    new = F.when(F.col("__map").isNull(), F.col(code)).otherwise(F.array_join(F.transform(words, lambda w: F.coalesce(F.element_at("__map", w), w)), ""))
    return joined.withColumn(code, new).select(*files.columns)


def file_names(files: DataFrame, renames: DataFrame) -> DataFrame:
    """``(binary_id, stem, new_stem)``: a file takes its function's name unless another file has that one."""
    wanted = files.join(renames.select("binary_id", F.col("old").alias("current"), "new"), ["binary_id", "current"])
    per = wanted.groupBy("binary_id", "new").agg(F.min("stem").alias("stem"))
    free = per.join(files.select("binary_id", F.col("stem").alias("new")), ["binary_id", "new"], "left_anti")
    return free.select("binary_id", "stem", F.col("new").alias("new_stem"))


