"""What a prompt is told about a program: types and signatures, all of them or those a function uses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions import codeparse, identity, text


def program_types(sources: DataFrame) -> DataFrame:
    """``(program_id, type, body, ord)`` of each struct and class of ``sources(program_id, code)``; a later one of a name replaces it."""
    found = codeparse.items(sources).where("kind IN ('struct', 'class')")
    return found.groupBy("program_id", F.col("item").alias("type")).agg(F.max_by("body", "ordinal").alias("body"), F.min("ordinal").alias("ord"))


def program_signatures(sources: DataFrame) -> DataFrame:
    """``(program_id, name, signature, ord)``: the distinct signatures under each bare function name."""
    found = codeparse.items(sources).where("kind = 'function'")
    sig = F.trim(F.regexp_replace(F.substring_index("body", "{", 1), r"\s+", " "))
    return found.select("program_id", text.normalize_name(F.col("item")).alias("name"), sig.alias("signature"), "ordinal").groupBy("program_id", "name", "signature").agg(F.min("ordinal").alias("ord"))


def _listed(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("ord", value))).alias("l")).select(*keys, F.transform("l", lambda x: x[value]).alias(name))


def block(types: Column, signatures: Column) -> Column:
    """The text of a context: a section for types and one for signatures, each only if it has something."""
    ended = F.transform(signatures, lambda s: F.when(F.endswith(F.rtrim(s), F.lit(";")), s).otherwise(F.concat(s, F.lit(";"))))
    part = lambda head, items, sep: F.when(F.size(items) > 0, F.concat(F.lit(f"### {head}\n```cpp\n"), F.array_join(items, sep), F.lit("\n```\n\n"))).otherwise("")
    return F.concat(part("Project Types (project.h)", types, "\n\n"), part("Improved Callee Signatures (use these names/types)", ended, "\n"))


def static_context(examples: DataFrame, sources: DataFrame) -> DataFrame:
    """``(program_id, name, context)`` with the types an example's original names and the signatures of what it calls.

    ``examples(program_id, name, original)``. Names and calls meet the program's by equi-joins on words.
    """
    none = F.array().cast("array<string>")
    words = examples.select("program_id", "name", F.explode(F.array_distinct(F.regexp_extract_all("original", F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0)))).alias("type"))
    types = _listed(words.join(program_types(sources), ["program_id", "type"]), ["program_id", "name"], "body", "types")
    calls = examples.select("program_id", "name", F.explode(codeparse.shape(F.col("original"))["calls"]).alias("call"))
    calls = calls.select("program_id", "name", text.normalize_name(F.col("call")).alias("callee")).distinct().where(F.col("callee") != text.normalize_name(F.col("name")))
    sigs = program_signatures(sources).withColumnRenamed("name", "callee")
    used = _listed(calls.join(sigs, ["program_id", "callee"]), ["program_id", "name"], "signature", "signatures")
    both = examples.select("program_id", "name").join(types, ["program_id", "name"], "left").join(used, ["program_id", "name"], "left")
    return both.select("program_id", "name", block(F.coalesce("types", none), F.coalesce("signatures", none)).alias("context"))


def full_context(examples: DataFrame, sources: DataFrame, more_types: list[str] = (), more_signatures: list[str] = ()) -> DataFrame:
    """``(program_id, name, context)`` with all types and all other functions' signatures, padded with distractors."""
    none = F.array().cast("array<string>")
    given = lambda xs: F.array(*map(F.lit, xs)) if xs else none
    types = _listed(program_types(sources), ["program_id"], "body", "types")
    sigs = program_signatures(sources).withColumnRenamed("name", "callee")
    others = examples.select("program_id", "name").join(sigs, "program_id").where(F.col("callee") != text.normalize_name(F.col("name")))
    used = _listed(others, ["program_id", "name"], "signature", "signatures")
    both = examples.select("program_id", "name").join(types, "program_id", "left").join(used, ["program_id", "name"], "left")
    return both.select("program_id", "name", block(F.concat(F.coalesce("types", none), given(more_types)), F.concat(F.coalesce("signatures", none), given(more_signatures))).alias("context"))


def distractors(n: int, seed: int = 0) -> tuple[list[str], list[str]]:
    """``n`` structs and ``n`` signatures that belong to no program, the same for the same seed."""
    import random

    rng = random.Random(f"distractors {seed}")
    kinds, parts = ("int", "long", "double", "bool", "char"), ("count", "limit", "offset", "state", "owner", "label", "rate")
    types = [f"struct Spare{i} {{ {' '.join(f'{rng.choice(kinds)} {p};' for p in rng.sample(parts, rng.randint(3, 6)))} }};" for i in range(n)]
    signatures = [f"{rng.choice(kinds)} spare_call_{i}({', '.join(f'{rng.choice(kinds)} a{j}' for j in range(rng.randint(1, 3)))});" for i in range(n)]
    return types, signatures


def levels(spec: str) -> list[int]:
    """``0,20,80`` as numbers; nothing is ``[0]``."""
    return [int(x) for x in spec.split(",") if x.strip()] or [0]


def originals(sources: DataFrame) -> DataFrame:
    """``(program_id, name, body, key)`` of every function of a source; a repeated name is told apart by its match key."""
    from pyspark.sql import Window

    found = codeparse.items(sources).where("kind = 'function'")
    key = identity.key_of(F.col("item"), text.demangled_signature(F.col("body")), text.definition_lines(F.col("body")))
    found = found.withColumn("k", key).withColumn("key", identity.match_key_of(F.col("k.qualifier"), F.col("k.base"), F.col("k.arity"), F.col("k.params")))
    turn = F.row_number().over(Window.partitionBy("program_id", "item").orderBy("ordinal"))
    return found.select("program_id", F.when(turn == 1, F.col("item")).otherwise(F.concat_ws("#", "item", "key")).alias("name"), "body", "key")


def examples(decompiled: DataFrame, sources: DataFrame) -> DataFrame:
    """``(program_id, name, code, original)``: decompiled functions with the one original of their key, without ``main``.

    ``decompiled(program_id, name, code)``. A key that several originals claim pairs with none.
    """
    unique = originals(sources).groupBy("program_id", "key").agg(F.count(F.lit(1)).alias("n"), F.first("body").alias("original")).where("n = 1")
    key = identity.key_of(F.col("name"), text.demangled_signature(F.col("code")), text.definition_lines(F.col("code")))
    mine = decompiled.withColumn("k", key).withColumn("key", identity.match_key_of(F.col("k.qualifier"), F.col("k.base"), F.col("k.arity"), F.col("k.params")))
    return mine.where("k.base <> 'main'").join(unique, ["program_id", "key"]).select("program_id", "name", "code", "original")
