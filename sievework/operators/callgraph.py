"""A call graph from function texts: parse once, resolve by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.functions import codeparse, identity, text
from sievework.session import staged

from . import resolve


def identified(functions: DataFrame) -> DataFrame:
    """``functions(binary_id, name, code)`` with ``qualifier, base, arity, params, qualified``."""
    key = identity.key_of(F.col("name"), text.demangled_signature(F.col("code")), text.definition_lines(F.col("code")))
    out = functions.withColumn("__key", key)
    return out.select(*functions.columns, "__key.*").withColumn("qualified", text.qualified(F.col("qualifier"), F.col("base")))


def call_sites(functions: DataFrame) -> DataFrame:
    """``(call_id, binary_id, caller, text, qualifier, qualified, base, arity)``: the distinct calls of every function item."""
    found = codeparse.items(functions.select("binary_id", "name", "code")).where("kind = 'function'")
    found = found.select("binary_id", F.col("name").alias("caller"), F.explode("calls").alias("text")).distinct()
    found = found.withColumn("key", identity.signature_key(F.col("text")))
    base = F.coalesce("key.base", text.normalize_name(F.col("text")))
    return found.select(
        F.sha1(F.encode(F.concat_ws("\0", "binary_id", "caller", "text"), "UTF-8")).alias("call_id"), "binary_id", "caller", "text",
        F.col("key.qualifier").alias("qualifier"), text.qualified(F.col("key.qualifier"), base).alias("qualified"), base.alias("base"), F.coalesce("key.arity", F.lit(-1)).alias("arity"),
    )


def build(functions: DataFrame) -> DataFrame:
    """Distinct edges ``(binary_id, src, dst)``; calls that are unknown, ambiguous or to itself have none."""
    functions = functions.repartition("binary_id", "name")  # texts are parsed in all tasks, however few files they come from
    calls = staged(call_sites(functions), "sites")  # read twice, parsed once
    hits = resolve.resolve(calls, identified(functions))
    return hits.join(calls.select("call_id", "binary_id", "caller"), ["call_id", "binary_id"]).where("caller <> name").select("binary_id", F.col("caller").alias("src"), F.col("name").alias("dst")).distinct()
