"""Preference formatting of conversations. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import let, prefix_scan

#: The rendering of a turn; what lies between the marks of an assistant's turn is trained on.
HEAD, TAIL = "<|{}|>\n", "\n"


def escaped(text):
    """Text in which no mark can be read: a backslash doubled, one put into each ``<|`` and ``|>``. Null is empty."""
    for mark, safe in (("\\", "\\\\"), ("<|", "<\\|"), ("|>", "|\\>")):
        text = F.replace(text, F.lit(mark), F.lit(safe))
    return F.coalesce(text, F.lit(""))


def preference_pairs(turns: DataFrame, pairs: DataFrame) -> DataFrame:
    """``format_pairs`` of ``turns(conv_id, turn, role, text)`` by ``pairs(pair_id, chosen_id, rejected_id)``.

    Turns with a null conv_id belong to none. A conversation that is missing has no turns, so its completion is empty.
    """
    sides = []
    for name in ("chosen", "rejected"):
        ids = pairs.select("pair_id", F.col(f"{name}_id").alias("conv_id"))
        sides.append(ids.join(turns.select("conv_id", "turn", "role", "text"), "conv_id"))
    return format_pairs(pairs.select("pair_id"), *sides)


def format_pairs(pairs: DataFrame, chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """One row a pair: ``pair_id, n_prefix, prompt, chosen, rejected, chosen_mask, rejected_mask``.

    ``pairs(pair_id)`` are distinct; ``chosen`` and ``rejected`` are ``(pair_id, turn, role, text)``. The prompt is the longest common prefix of turns, equal
    in role and text, and is rendered once; each completion is the rest of its conversation. A mask
    lists the code-point ranges ``start:end`` of assistant content in its completion; all else,
    role marks included, is masked out. Marks within roles and texts are escaped, see ``escaped``.

    Turns stand in order of (turn, role, text), nulls first. A null role renders as an empty one, a
    null text as empty; both compare as themselves. A side without turns has an empty completion. Repeated rows are turns
    of their own. A conversation is one row here, so its own text has to fit a task. Other columns are not read; an empty table gives no rows.
    """
    one = F.struct(F.col("turn").alias("turn"), F.col("role").alias("role"), F.col("text").alias("text"))
    side = lambda rows, name: rows.groupBy("pair_id").agg(F.sort_array(F.collect_list(one)).alias(name))
    left, right = side(chosen, "c"), side(rejected, "r")
    empty = F.array().cast(left.schema["c"].dataType)
    both = pairs.join(left, "pair_id", "left").join(right, "pair_id", "left")
    both = both.select("pair_id", F.coalesce("c", empty).alias("c"), F.coalesce("r", empty).alias("r"))
    same = F.zip_with("c", "r", lambda a, b: F.coalesce(a["role"].eqNullSafe(b["role"]) & a["text"].eqNullSafe(b["text"]) & F.lit(True), F.lit(False)))
    shorter = F.least(F.size("c"), F.size("r"))
    miss = F.array_position(F.slice(same, 1, shorter), False)
    both = both.withColumn("n_prefix", F.when(miss > 0, miss - 1).otherwise(shorter).cast("int"))
    rest = lambda c: F.slice(c, F.col("n_prefix") + 1, F.greatest(F.size(c) - F.col("n_prefix"), F.lit(0)))
    shown = both.select("pair_id", "n_prefix", _rendered(F.slice("c", F.lit(1), F.col("n_prefix"))).alias("p"), _rendered(rest(F.col("c"))).alias("c"), _rendered(rest(F.col("r"))).alias("r"))
    whole = lambda c: F.array_join(F.transform(c, lambda t: F.concat(t["head"], t["body"], F.lit(TAIL))), "")
    return shown.select("pair_id", "n_prefix", whole("p").alias("prompt"), whole("c").alias("chosen"), whole("r").alias("rejected"), _mask("c").alias("chosen_mask"), _mask("r").alias("rejected_mask"))


def _rendered(turns):
    before, after = HEAD.split("{}")
    return F.transform(turns, lambda t: F.struct(F.concat(F.lit(before), escaped(t["role"]), F.lit(after)).alias("head"), escaped(t["text"]).alias("body"), F.coalesce(t["role"] == "assistant", F.lit(False)).alias("ours")))


def _mask(turns: str):
    starts = prefix_scan(f"transform({turns}, _t -> length(_t.head) + length(_t.body) + {len(TAIL)})")
    span = "CASE WHEN _t.ours THEN concat_ws(':', _at + length(_t.head), _at + length(_t.head) + length(_t.body)) END"
    return F.expr(let(starts, "_starts", f"array_join(zip_with({turns}, _starts, (_t, _at) -> {span}), ',')"))


def swapped_replies(turns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(pairs, chosen, rejected)`` for a table without preferences, to give ``format_pairs``.

    A conversation is preferred to itself with its last assistant reply exchanged for that of the conversation
    whose id differs in the lowest bit, and nothing after it. Where that one has no reply, the reply is left out; a conversation
    without a reply of its own is compared with itself. ``pair_id`` is the conv_id; turns with a null one belong to none.
    """
    order = [F.col("turn"), F.col("role"), F.col("text")]
    rows = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").alias("pair_id"), "turn", "role", "text")
    ours = F.coalesce(F.col("role") == "assistant", F.lit(False))
    per = Window.partitionBy("pair_id").orderBy(*order)
    placed = rows.withColumn("at", F.row_number().over(per)).withColumn("last", F.max(F.when(ours, F.struct("at", "text"))).over(Window.partitionBy("pair_id")))
    replies = rows.where(ours).groupBy("pair_id").agg(F.max_by("text", F.struct(*order)).alias("other"), F.lit(True).alias("has"))
    replies = replies.select(F.col("pair_id").bitwiseXOR(F.lit(1)).alias("__partner"), "other", "has")
    cut = placed.where("last IS NULL OR at <= last.at").join(replies, F.col("pair_id") == F.col("__partner"), "left")
    is_last = F.coalesce(F.col("at") == F.col("last.at"), F.lit(False))
    rejected = cut.where(~is_last | F.col("has")).select("pair_id", "turn", "role", F.when(is_last, F.col("other")).otherwise(F.col("text")).alias("text"))
    return rows.select("pair_id").distinct(), rows, rejected


def op6_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preference pairs of the whole ``conversations`` table."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return format_pairs(*swapped_replies(turns))


OP6_SQL = r"""
WITH base AS (
  SELECT conv_id AS pair_id, turn, role, text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
last AS (SELECT pair_id, max(pos) AS pos FROM base WHERE role = 'assistant' GROUP BY pair_id),
reply AS (SELECT b.pair_id, b.text FROM base b JOIN last USING (pair_id, pos)),
t AS (
  SELECT pair_id, 0 AS side, role, text, pos AS i FROM base
  UNION ALL
  SELECT b.pair_id, 1, b.role, CASE WHEN b.pos = l.pos THEN o.text ELSE b.text END,
         row_number() OVER (PARTITION BY b.pair_id ORDER BY b.turn NULLS FIRST, b.role NULLS FIRST, CASE WHEN b.pos = l.pos THEN o.text ELSE b.text END NULLS FIRST)
  FROM base b LEFT JOIN last l ON l.pair_id = b.pair_id LEFT JOIN reply o ON o.pair_id = xor(b.pair_id, 1)
  WHERE l.pos IS NULL OR b.pos < l.pos OR (b.pos = l.pos AND o.pair_id IS NOT NULL)),
sizes AS (
  SELECT pair_id, count(*) FILTER (side = 0) AS nc, count(*) FILTER (side = 1) AS nr FROM t GROUP BY pair_id),
differs AS (
  SELECT c.pair_id, min(c.i) AS i FROM t c JOIN t r ON c.pair_id = r.pair_id AND c.i = r.i AND c.side = 0 AND r.side = 1
  WHERE c.role IS DISTINCT FROM r.role OR c.text IS DISTINCT FROM r.text GROUP BY c.pair_id),
prefix AS (
  SELECT s.pair_id, CAST(coalesce(d.i - 1, least(nc, nr)) AS INTEGER) AS n_prefix FROM sizes s LEFT JOIN differs d USING (pair_id)),
shown AS (
  SELECT t.pair_id, n_prefix, side, i, role, '<|' || replace(replace(replace(coalesce(role, ''), '\', '\\'), '<|', '<\|'), '|>', '|\>') || '|>' || chr(10) AS head,
         replace(replace(replace(coalesce(text, ''), '\', '\\'), '<|', '<\|'), '|>', '|\>') AS body FROM t JOIN prefix USING (pair_id)),
placed AS (
  SELECT *, sum(length(head) + length(body) + 1) OVER (PARTITION BY pair_id, side, i > n_prefix ORDER BY i) - length(body) - 1 AS s FROM shown)
SELECT p.pair_id, p.n_prefix,
  coalesce(string_agg(head || body || chr(10), '' ORDER BY i) FILTER (side = 0 AND i <= p.n_prefix), '') AS prompt,
  coalesce(string_agg(head || body || chr(10), '' ORDER BY i) FILTER (side = 0 AND i > p.n_prefix), '') AS chosen,
  coalesce(string_agg(head || body || chr(10), '' ORDER BY i) FILTER (side = 1 AND i > p.n_prefix), '') AS rejected,
  coalesce(string_agg(CAST(CAST(s AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(s + length(body) AS BIGINT) AS VARCHAR), ',' ORDER BY i) FILTER (side = 0 AND i > p.n_prefix AND role = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg(CAST(CAST(s AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(s + length(body) AS BIGINT) AS VARCHAR), ',' ORDER BY i) FILTER (side = 1 AND i > p.n_prefix AND role = 'assistant'), '') AS rejected_mask
FROM placed p GROUP BY p.pair_id, p.n_prefix
"""
