"""Queries over the engine's operators and their SQL oracles.

Analog views prove an operator on the shared tables; that code is read rightly is what the unit tests prove.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions import codeparse, text
from sievework.operators import callgraph, dedup, experiments, gate, graph, judging, naming, resolve, runs, similarity, stages
from sievework.session import staged, workers_can_import
from sievework.sources import programs, state

from . import views
from .views import GRAPHS, for_oracle, on_spark, vertices_of

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(run):
        def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
            workers_can_import(spark)
            return run(spark, sf_dir)

        QUERIES[name] = prepared
        if sql is not None:
            ORACLE_SQL[name] = for_oracle(sql)
        return run

    return add


def simple(name: str, source: str, columns: Callable[[], list], sql: str) -> None:
    """A query that selects ``columns()`` from a view; the oracle selects ``sql`` from it."""
    query(name, f"SELECT {sql} FROM ({source}) v")(lambda spark, d: on_spark(spark, d, source).select(*columns()))


def load(spark: SparkSession, sf_dir: str, which: str) -> tuple[DataFrame, DataFrame]:
    return staged(on_spark(spark, sf_dir, vertices_of(GRAPHS[which])), "vertices"), staged(on_spark(spark, sf_dir, GRAPHS[which]), "edges")


def with_graph(which: str, body: str) -> str:
    """Oracle SQL with ``e`` the edges and ``v`` the vertices of a view."""
    return f"WITH RECURSIVE e AS ({GRAPHS[which]}), v AS (SELECT src AS name FROM e UNION SELECT dst FROM e), roots AS (SELECT name FROM v WHERE name NOT IN (SELECT dst FROM e)), {body}"


# -- graphs -----------------------------------------------------------------------------------------------------------

_REACH = "reach AS (SELECT name AS start, name FROM roots UNION SELECT r.start, e.dst FROM reach r JOIN e ON e.src = r.name), sizes AS (SELECT start AS name, count(*) AS reach FROM reach GROUP BY start)"


@query("g_callers", f"SELECT dst AS name, src AS caller FROM ({views.DAG}) e")
def g_callers(spark, d):
    return graph.callers(on_spark(spark, d, views.DAG)).select("name", "caller")


@query("g_edges", with_graph("cyclic", "x AS (SELECT 1) SELECT src, dst FROM e"))
def g_edges(spark, d):
    every = on_spark(spark, d, views.CYCLIC.replace("WHERE a.l_partkey <> b.l_partkey", ""))
    return graph.graph_edges(every, on_spark(spark, d, vertices_of(views.CYCLIC))).select("src", "dst")


@query("g_roots_forest", with_graph("forest", "x AS (SELECT 1) SELECT name FROM roots"))
def g_roots_forest(spark, d):
    return graph.roots(*load(spark, d, "forest")).select("name")


@query("g_roots_cyclic", with_graph("cyclic", "x AS (SELECT 1) SELECT name FROM roots"))
def g_roots_cyclic(spark, d):
    return graph.roots(*load(spark, d, "cyclic")).select("name")


@query("g_degrees", with_graph("dag", "o AS (SELECT src AS name, count(*) AS n FROM e GROUP BY src), i AS (SELECT dst AS name, count(*) AS n FROM e GROUP BY dst) SELECT v.name, coalesce(o.n, 0) AS callees, coalesce(i.n, 0) AS callers FROM v LEFT JOIN o ON o.name = v.name LEFT JOIN i ON i.name = v.name"))
def g_degrees(spark, d):
    return graph.degrees(*load(spark, d, "dag")).select("name", "callees", "callers")


@query("g_reachable", with_graph("cyclic", "s AS (SELECT 'p1' AS name UNION SELECT e.dst FROM s JOIN e ON e.src = s.name) SELECT name FROM s"))
def g_reachable(spark, d):
    _, edges = load(spark, d, "cyclic")
    return graph.reachable(edges, graph.starts_from(spark, "cyclic", ["p1"])).select("name")


@query("g_reach_sizes", with_graph("dag", f"{_REACH} SELECT name, reach FROM sizes"))
def g_reach_sizes(spark, d):
    return graph.reach_sizes(*load(spark, d, "dag")).select("name", "reach")


@query("g_primary_entry", with_graph("forest", f"{_REACH} SELECT name, reach FROM sizes ORDER BY reach DESC, name DESC LIMIT 1"))
def g_primary_entry(spark, d):
    return graph.primary_entry(*load(spark, d, "forest")).select("name", "reach")


_ENTRY = f"{_REACH}, best AS (SELECT name, reach FROM sizes ORDER BY reach DESC, name DESC LIMIT 1), entries AS (SELECT s.name FROM sizes s, best b WHERE CASE WHEN b.reach >= 0.5 * (SELECT count(*) FROM v) THEN s.name = b.name ELSE TRUE END)"


@query("g_entries_library", with_graph("forest", f"{_ENTRY} SELECT name FROM entries"))
def g_entries_library(spark, d):
    return graph.entry_points(*load(spark, d, "forest")).select("name")


@query("g_entries_program", with_graph("single", f"{_ENTRY} SELECT name FROM entries"))
def g_entries_program(spark, d):
    return graph.entry_points(*load(spark, d, "single")).select("name")


@query("g_entries_exported", with_graph("forest", "x AS (SELECT 1) SELECT name FROM v WHERE name LIKE 'n%'"))
def g_entries_exported(spark, d):
    vertices, edges = load(spark, d, "forest")
    return graph.entry_points(vertices, edges, exported=vertices.where("name LIKE 'n%'")).select("name")


_HOPS = "hops AS (SELECT name, 0 AS depth FROM starts UNION SELECT e.dst, h.depth + 1 FROM hops h JOIN e ON e.src = h.name WHERE h.depth < {most}) SELECT name, CAST(min(depth) AS INTEGER) AS depth FROM hops GROUP BY name"


@query("g_depths_single", with_graph("cyclic", "starts AS (SELECT 'p1' AS name), " + _HOPS.replace("{most}", "12")))
def g_depths_single(spark, d):
    _, edges = load(spark, d, "cyclic")
    return graph.depths(edges, graph.starts_from(spark, "cyclic", ["p1"])).select("name", "depth")


@query("g_depths_multi", with_graph("dag", "starts AS (SELECT name FROM roots), " + _HOPS.replace("{most}", "9")))
def g_depths_multi(spark, d):
    vertices, edges = load(spark, d, "dag")
    return graph.depths(edges, graph.roots(vertices, edges)).select("name", "depth")


_LEVELS = "lv AS (SELECT name, 0 AS level FROM v WHERE name NOT IN (SELECT src FROM e) UNION SELECT e.src, lv.level + 1 FROM lv JOIN e ON e.dst = lv.name), levels AS (SELECT name, CAST(max(level) AS INTEGER) AS level FROM lv GROUP BY name)"


@query("g_levels", with_graph("dag", f"{_LEVELS} SELECT name, level FROM levels"))
def g_levels(spark, d):
    return graph.levels(*load(spark, d, "dag")).select("name", "level")


@query("g_level_sizes", with_graph("dag", f"{_LEVELS} SELECT level, count(*) AS size FROM levels GROUP BY level"))
def g_level_sizes(spark, d):
    return graph.levels(*load(spark, d, "dag")).groupBy("level").agg(F.count(F.lit(1)).alias("size"))


@query("g_rounds", with_graph("dag", f"{_LEVELS}, z AS (SELECT level, count(*) AS n FROM levels GROUP BY level) SELECT count(*) AS levels, CAST(sum(ceil(n / 8.0)) AS BIGINT) AS rounds FROM z"))
def g_rounds(spark, d):
    return graph.rounds(graph.levels(*load(spark, d, "dag")), 8).select("levels", "rounds")


_SUBSET = "m AS (SELECT name FROM v WHERE name LIKE 'r%' OR name LIKE 'n%' OR name LIKE 'b%'), rs AS (SELECT name AS start, name FROM m UNION SELECT r.start, e.dst FROM rs r JOIN e ON e.src = r.name), pe AS (SELECT start AS src, rs.name AS dst FROM rs JOIN m ON m.name = rs.name WHERE start <> rs.name), lv AS (SELECT name, 0 AS level FROM m WHERE name NOT IN (SELECT src FROM pe) UNION SELECT pe.src, lv.level + 1 FROM lv JOIN pe ON pe.dst = lv.name) SELECT name, CAST(max(level) AS INTEGER) AS level FROM lv GROUP BY name"


@query("g_levels_subset", with_graph("dag", _SUBSET))
def g_levels_subset(spark, d):
    vertices, edges = load(spark, d, "dag")
    return graph.levels_subset(vertices, edges, vertices.where("name RLIKE '^[rnb]'")).select("name", "level")


@query("g_order")
def g_order(spark, d):
    return graph.ordered(*load(spark, d, "cyclic")).select("name", "pos", "level")


@query("g_limit", with_graph("dag", f"{_LEVELS} SELECT name, level, turn FROM (SELECT name, level, CAST(row_number() OVER (ORDER BY level, name) AS INTEGER) AS turn FROM levels) z WHERE turn <= 500"))
def g_limit(spark, d):
    leveled = graph.levels(*load(spark, d, "dag")).withColumn("pos", F.col("name"))
    return graph.limited(leveled, 500).select("name", "level", "turn")


# -- resolution -------------------------------------------------------------------------------------------------------

_TARGETS = "SELECT 'b' AS binary_id, concat(p_name, '-', p_partkey) AS name, concat(p_brand, '::', p_name) AS qualified, p_name AS base, CAST(p_size % 4 AS INTEGER) AS arity FROM {part}"
_CALLS = "SELECT p_partkey AS call_id, 'b' AS binary_id, CASE WHEN p_partkey % 7 = 0 THEN concat(p_name, '-', p_partkey) ELSE p_name END AS text, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_brand END AS qualifier, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE concat(p_brand, '::', p_name) END AS qualified, p_name AS base, CAST(CASE WHEN p_partkey % 2 = 0 THEN -1 ELSE p_size % 4 END AS INTEGER) AS arity FROM {part}"
_RESOLVED = f"""
WITH f AS ({_TARGETS}), c AS ({_CALLS}),
hit AS (SELECT c.call_id, c.qualifier, c.arity AS wanted, f.name, f.arity FROM c JOIN f ON c.text <> f.name AND
    CASE WHEN c.qualifier <> '' THEN f.qualified = c.qualified ELSE f.base = c.base END
  WHERE c.text NOT IN (SELECT name FROM f)),
n AS (SELECT *, count(*) OVER (PARTITION BY call_id) AS k,
    max(CASE WHEN arity = wanted OR (qualifier <> '' AND arity = -1) THEN 1 ELSE 0 END) OVER (PARTITION BY call_id) AS fits FROM hit),
kept AS (SELECT call_id, name FROM n WHERE CASE WHEN wanted >= 0 AND (qualifier <> '' OR k > 1) AND fits = 1 THEN arity = wanted OR (qualifier <> '' AND arity = -1) ELSE TRUE END
  UNION ALL SELECT c.call_id, f.name FROM c JOIN f ON c.text = f.name)"""


@query("g_resolve", f"{_RESOLVED} SELECT call_id, min(name) AS name FROM kept GROUP BY call_id HAVING count(*) = 1")
def g_resolve(spark, d):
    return resolve.resolve(on_spark(spark, d, _CALLS), on_spark(spark, d, _TARGETS)).select("call_id", "name")


@query("g_candidates", f"{_RESOLVED} SELECT call_id, name FROM kept")
def g_candidates(spark, d):
    return resolve.candidates(on_spark(spark, d, _CALLS), on_spark(spark, d, _TARGETS)).select("call_id", "name")


@query("g_ambiguous", f"SELECT base, count(*) AS n, array_to_string(list(name ORDER BY name), ',') AS names FROM ({_TARGETS}) f GROUP BY base HAVING count(*) > 1")
def g_ambiguous(spark, d):
    return resolve.ambiguous(on_spark(spark, d, _TARGETS)).select("base", "n", F.array_join("names", ",").alias("names"))


_TIERS_L = "SELECT CAST(s_nationkey AS VARCHAR(20)) AS program_id, s_name AS name, concat(s_suppkey % 40, ':', round(s_acctbal)) AS strict, concat('k', s_suppkey % 3) AS loose FROM {supplier}"
_TIERS_R = "SELECT CAST(c_nationkey AS VARCHAR(20)) AS program_id, concat(c_custkey % 40, ':', round(c_acctbal)) AS strict, concat('k', c_custkey % 3) AS loose FROM {customer}"


@query("j_match_tiers", f"WITH l AS ({_TIERS_L}), r AS ({_TIERS_R}), m AS (SELECT l.*, EXISTS (SELECT 1 FROM r WHERE r.program_id = l.program_id AND r.strict = l.strict) AS a, EXISTS (SELECT 1 FROM r WHERE r.program_id = l.program_id AND r.loose = l.loose) AS b FROM l), t AS (SELECT *, CASE WHEN bool_or(a) OVER w THEN 0 WHEN bool_or(b) OVER w THEN 1 END AS tier FROM m WINDOW w AS (PARTITION BY program_id)) SELECT program_id, name, CAST(tier AS INTEGER) AS tier FROM t WHERE CASE tier WHEN 0 THEN a WHEN 1 THEN b ELSE TRUE END")
def j_match_tiers(spark, d):
    return resolve.matched(on_spark(spark, d, _TIERS_L), on_spark(spark, d, _TIERS_R), ["strict", "loose"]).select("program_id", "name", "tier")


# -- the gate ---------------------------------------------------------------------------------------------------------

_ART = r"'\bFUN_[0-9a-fA-F]+\b|\b_?DAT_[0-9a-fA-F]+\b|\b[a-z]Var\d+\b|\b[a-z]Stack_[0-9a-fA-F]+\b|\blocal_[0-9a-fA-F]+\b|\bparam_\d+\b|\bundefined\d?\b|\bcode \*'"
_NO_COMMENT = r"regexp_replace(code, '/\*(.|\n)*?\*/|//[^\n]*', '', 'g')"
_LINES = "len(list_filter(string_split({0}, chr(10)), lambda x: trim(x) <> ''))"
_N_ART = f"CAST(len(regexp_extract_all(code, {_ART})) AS INTEGER)"
_PREFIX = "'^(__cxa_|__cxxabiv|_Unwind_|_ITM_|__gmon_start|__libc_|__do_global_|_GLOBAL__sub_|register_tm_clones|deregister_tm_clones|frame_dummy|__stack_chk_|__throw_)'"
_BASE = "regexp_replace(regexp_replace(name, '^.*::', ''), '-[0-9a-fA-F]+$', '')"
_EXACT = "('_init', '_fini', '_start', '_dl_relocate_static_pie')"
_LIBRARY = f"(regexp_matches(name, '^(std|__gnu_cxx|__cxxabiv1|__cxx11)::') OR regexp_matches(name, '::(std|__gnu_cxx|__cxxabiv1|__cxx11)::') OR regexp_matches(name, {_PREFIX}) OR regexp_matches({_BASE}, {_PREFIX}) OR regexp_matches(regexp_replace({_BASE}, '^.* ', ''), {_PREFIX}) OR name IN {_EXACT} OR {_BASE} IN {_EXACT} OR regexp_replace({_BASE}, '^.* ', '') IN {_EXACT})"
_CLAUSES = {
    "blank": (lambda: text.is_blank(F.col("code")), "trim(code) = ''"),
    "library": (lambda: text.is_library(F.col("name")), _LIBRARY),
    "short": (lambda: text.is_short(F.col("code")), _LINES.format(_NO_COMMENT) + " < 5"),
    "named_thunk": (lambda: text.is_named_thunk(F.col("name")), "starts_with(name, 'thunk_')"),
    "stub": (lambda: text.is_stub(F.col("code")), rf"regexp_matches({_NO_COMMENT}, '\{{\s*(halt_baddata|_Unwind_Resume|__assert_fail|abort)\s*\([^;\{{\}}]*\)\s*;?\s*\}}')"),
    "named_clean": (lambda: text.is_named_and_clean(F.col("code"), F.col("name")), f"NOT regexp_matches(name, '^FUN_[0-9a-fA-F]+$') AND {_N_ART} = 0"),
}
for _name, (_column, _sql) in _CLAUSES.items():
    simple(f"f_gate_{_name}", views.FUNCTIONS, lambda c=_column: ["fid", c().alias("rejected")], f"fid, {_sql} AS rejected")
simple("f_artifacts", views.FUNCTIONS, lambda: ["fid", text.artifact_count(F.col("code")).alias("artifacts"), text.line_count(F.col("code")).alias("n_lines")], f"fid, {_N_ART} AS artifacts, CAST({_LINES.format('code')} AS INTEGER) AS n_lines")

_WORTH = "NOT (" + " OR ".join(f"({s})" for _, s in _CLAUSES.values()) + ")"


def _gated(spark, d):
    rows = on_spark(spark, d, views.FUNCTIONS).withColumn("parsed_name", F.lit(None).cast("string")).withColumn("calls", F.array().cast("array<string>")).withColumn("cyclomatic", F.lit(1))
    return gate.gate(rows)


@query("f_gate", f"SELECT fid, {_WORTH} AS worth FROM ({views.FUNCTIONS}) f")
def f_gate(spark, d):
    return _gated(spark, d).select("fid", "worth")


@query("f_gate_parsed", f"SELECT fid, reason, reason IS NULL AS worth FROM (SELECT fid, CASE WHEN fid % 13 = 0 THEN 'blank' WHEN fid % 11 IN (0, 1, 5) THEN 'library' WHEN fid % 13 = 1 THEN 'short' WHEN fid % 11 = 2 THEN 'named_thunk' WHEN fid % 13 = 2 AND fid % 11 IN (3, 4) THEN 'named_and_clean' END AS reason FROM ({views.FUNCTIONS}) f) r")
def f_gate_parsed(spark, d):
    rows = on_spark(spark, d, views.FUNCTIONS).withColumn("s", codeparse.shape(F.col("code"))).select("*", "s.parsed_name", "s.calls", "s.cyclomatic")
    return gate.gate(rows).select("fid", "reason", "worth")


_SCORE = f"CASE WHEN trim(code) = '' THEN 0.0 ELSE round(3.0 * {_N_ART} / greatest({_LINES.format('code')}, 1) + size % 5 + 0.5 * (size % 3) + 0.5 * (size % 6), 4) END"


def _scored(spark, d):
    f = on_spark(spark, d, views.FUNCTIONS)
    return f.withColumn("score", F.round(text.score(F.col("code"), F.col("size") % 5 + 1, F.col("size") % 3, F.col("size") % 6), 4))


@query("f_score", f"SELECT fid, CAST({_SCORE} AS DOUBLE) AS score FROM ({views.FUNCTIONS}) f")
def f_score(spark, d):
    return _scored(spark, d).select("fid", "score")


@query("f_rank", f"SELECT fid, CAST(row_number() OVER (ORDER BY {_SCORE} DESC, stem) AS INTEGER) AS pos FROM ({views.FUNCTIONS}) f")
def f_rank(spark, d):
    return gate.ranked(_scored(spark, d).withColumn("name", F.col("stem"))).select("fid", "pos")


@query("f_preview", f"SELECT stem, CAST({_SCORE} AS DOUBLE) AS score FROM ({views.FUNCTIONS}) f ORDER BY {_SCORE} DESC, stem LIMIT 8")
def f_preview(spark, d):
    return _scored(spark, d).select("stem", "score").orderBy(F.col("score").desc(), "stem").limit(8)


@query("f_looks_stripped", f"SELECT binary_id, avg(CASE WHEN starts_with(name, 'FUN_') THEN 1 ELSE 0 END) >= 0.5 AS stripped FROM ({views.FUNCTIONS}) f GROUP BY binary_id")
def f_looks_stripped(spark, d):
    return gate.looks_stripped(on_spark(spark, d, views.FUNCTIONS))


@query("f_scope", with_graph("single", f"{_ENTRY}, starts AS (SELECT name FROM entries), hops AS (SELECT name, 0 AS depth FROM starts UNION SELECT e.dst, h.depth + 1 FROM hops h JOIN e ON e.src = h.name) SELECT name FROM hops GROUP BY name HAVING min(depth) <= 3"))
def f_scope(spark, d):
    return gate.in_scope(*load(spark, d, "single"), max_depth=3).select("name")


@query("f_scope_off", with_graph("single", "x AS (SELECT 1) SELECT name FROM v"))
def f_scope_off(spark, d):
    return gate.in_scope(*load(spark, d, "single"), max_depth=0).select("name")


@query("f_scope_auto", with_graph("single", "x AS (SELECT 1) SELECT name FROM v"))
def f_scope_auto(spark, d):
    return gate.in_scope(*load(spark, d, "single")).select("name")


_TRUTH_V = "SELECT name, CAST(length(name) % 3 = 0 AS INTEGER) AS user_code, CAST(length(name) % 2 = 0 AS INTEGER) AS worth FROM v"
_DEPTHS = (0, 1, 2, 3, 4)


@query(
    "sel_by_depth",
    with_graph("single", f"{_ENTRY}, hops AS (SELECT name, 0 AS depth FROM entries UNION SELECT e.dst, h.depth + 1 FROM hops h JOIN e ON e.src = h.name), near AS (SELECT name, min(depth) AS depth FROM hops GROUP BY name), t AS ({_TRUTH_V}), k AS (SELECT unnest([0, 1, 2, 3, 4]) AS max_depth), c AS (SELECT k.max_depth, count(*) FILTER (t.worth = 1 AND (k.max_depth = 0 OR near.depth <= k.max_depth)) AS selected, count(*) FILTER (t.worth = 1 AND t.user_code = 1 AND (k.max_depth = 0 OR near.depth <= k.max_depth)) AS true_positives, count(*) FILTER (t.user_code = 1) AS total_user FROM k CROSS JOIN t LEFT JOIN near ON near.name = t.name GROUP BY k.max_depth), p AS (SELECT *, coalesce(true_positives / nullif(selected, 0), 0.0) AS pr, coalesce(true_positives / nullif(total_user, 0), 0.0) AS re FROM c) SELECT CAST(max_depth AS INTEGER) AS max_depth, selected, true_positives, selected - true_positives AS false_positives, total_user, CAST(round(pr, 4) AS DOUBLE) AS precision, CAST(round(re, 4) AS DOUBLE) AS recall, CAST(round(coalesce(2 * pr * re / nullif(pr + re, 0), 0.0), 4) AS DOUBLE) AS f1 FROM p"),
)
def sel_by_depth(spark, d):
    """How well the choice at each depth picks the program's own code, without any symbols."""
    vertices, edges = load(spark, d, "single")
    marked = vertices.withColumn("user_code", F.length("name") % 3 == 0).withColumn("worth", F.length("name") % 2 == 0)
    near = graph.depths(edges, graph.entry_points(vertices, edges))
    rows = marked.join(near, graph.KEY, "left").withColumn("max_depth", F.explode(F.array(*map(F.lit, _DEPTHS))))
    chosen = F.col("worth") & ((F.col("max_depth") == 0) | F.coalesce(F.col("depth") <= F.col("max_depth"), F.lit(False)))
    counts = rows.groupBy("max_depth").agg(F.count_if(chosen).alias("selected"), F.count_if(chosen & F.col("user_code")).alias("true_positives"), F.count_if("user_code").alias("total_user"))
    out = gate.with_f1(counts.withColumn("false_positives", F.col("selected") - F.col("true_positives")))
    return out.select("max_depth", "selected", "true_positives", "false_positives", "total_user", *[F.round(c, 4).alias(c) for c in ("precision", "recall", "f1")])


@query("f_selected", f"SELECT fid FROM ({views.FUNCTIONS}) f WHERE {_WORTH} AND size <= 25")
def f_selected(spark, d):
    gated = _gated(spark, d).drop("name").withColumnRenamed("stem", "name")
    return gate.selected(gated, gated.where("size <= 25")).select("fid")


@query("e_prf1", f"WITH t AS ({views.TRUTH}), c AS (SELECT count(*) AS selected, count(*) FILTER (known AND quality = 1) AS tp FROM t WHERE n_chars >= 1000), u AS (SELECT count(*) FILTER (quality = 1) AS total FROM t WHERE known) SELECT selected, tp AS true_positives, selected - tp AS false_positives, total AS total_user, CAST(round(coalesce(tp / nullif(selected, 0), 0.0), 6) AS DOUBLE) AS precision, CAST(round(coalesce(tp / nullif(total, 0), 0.0), 6) AS DOUBLE) AS recall FROM c, u")
def e_prf1(spark, d):
    t = on_spark(spark, d, views.TRUTH)
    out = gate.selection_score(t.where("n_chars >= 1000").select("address"), t.where("known").select("address", (F.col("quality") == 1).alias("is_user")))
    return out.select("selected", "true_positives", "false_positives", "total_user", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


# -- names and text ---------------------------------------------------------------------------------------------------

_STRIP = r"regexp_replace({0}, '-[0-9a-fA-F]{{4,}}$', '')"
simple("n_normalize", views.FUNCTIONS, lambda: ["fid", text.normalize_name(F.col("stem")).alias("base"), text.strip_address(F.col("stem")).alias("bare")], rf"fid, regexp_replace(regexp_replace({_STRIP.format('stem')}, '^.*::', ''), '[^A-Za-z0-9_]', '', 'g') AS base, {_STRIP.format('stem')} AS bare")
simple("n_address", views.FUNCTIONS, lambda: ["fid", text.address_of(F.col("stem")).alias("address")], "fid, CAST(concat('0x', regexp_extract(stem, '-([0-9a-fA-F]{4,})$', 1)) AS BIGINT) AS address")
simple("n_base_names", views.FUNCTIONS, lambda: ["fid", F.array_join(text.base_names(F.col("name")), "|").alias("names")], f"fid, concat(name, '|', {_BASE}, '|', regexp_replace({_BASE}, '^.* ', '')) AS names")
simple("n_synthetic", views.FUNCTIONS, lambda: ["fid", text.is_synthetic(F.col("stem")).alias("synthetic"), text.crt_fallback(F.col("name")).alias("kept"), text.unnamed(F.col("name"), F.when(F.col("fid") % 2 == 0, F.col("name"))).alias("unnamed")], rf"fid, regexp_matches({_STRIP.format('stem')}, '^(FUN|LAB|SUB|UNK)_[0-9a-fA-F]+$') AS synthetic, NOT starts_with(name, '_') AS kept, regexp_matches(name, '^(FUN|LAB|SUB|UNK)_[0-9a-fA-F]+$') AS unnamed")
simple("n_valid_identifier", views.FUNCTIONS, lambda: ["fid", text.valid_identifier(F.col("name")).alias("valid")], "fid, regexp_matches(name, '^[A-Za-z_][A-Za-z0-9_]*$') AND NOT regexp_matches(name, '^(FUN|LAB|SUB|UNK)_[0-9a-fA-F]+$') AND length(name) <= 60 AS valid")
simple("n_demangled", views.FUNCTIONS, lambda: ["fid", text.demangled_signature(F.col("code")).alias("signature"), F.array_join(text.definition_lines(F.col("code")), "|").alias("lines")], r"fid, CASE WHEN fid % 13 IN (0, 1) THEN NULL WHEN fid % 13 = 2 THEN concat('ns::Store::', name, '(int, Item const&)') ELSE concat('ns::Graph::', name, '(int) const') END AS signature, CASE fid % 13 WHEN 0 THEN '' WHEN 1 THEN concat('void ', name, '(void)|void ', name, '(void)') WHEN 2 THEN concat('long ', name, '(int total)|long ', name, '(int total)') ELSE concat('undefined8 ', name, '(int param_1)|undefined8 ', name, '(int param_1)') END AS lines")
simple("n_match_key", _TARGETS, lambda: ["name", text.match_key(text.owner(F.substring_index("qualified", "::", 1)), F.col("base"), F.col("arity"), F.array(F.lit("int"), F.col("base"))).alias("key"), text.is_stdlib(F.substring_index("qualified", "::", 1)).alias("stdlib")], "name, concat(string_split(qualified, '::')[1], '::', base, '(', arity, ':int,', base, ')') AS key, FALSE AS stdlib")
simple("n_model_spec", "SELECT p_partkey AS id, concat(CASE p_partkey % 3 WHEN 0 THEN 'local:' WHEN 1 THEN 'gemini:' ELSE 'other:' END, replace(p_name, ' ', '/')) AS spec FROM {part}", lambda: ["id", text.model_spec(F.col("spec"), "local")["provider"].alias("provider"), text.model_spec(F.col("spec"), "local")["model"].alias("model"), text.workspace_name(F.col("spec")).alias("folder")], "id, CASE id % 3 WHEN 1 THEN 'gemini' ELSE 'local' END AS provider, CASE id % 3 WHEN 2 THEN spec ELSE regexp_replace(spec, '^[a-z]*:', '') END AS model, replace(replace(spec, '/', '__'), ':', '_') AS folder")
simple("n_infer_case", "SELECT p_partkey AS id, concat(replace(p_name, ' ', ''), CASE p_partkey % 5 WHEN 0 THEN '-O2' WHEN 1 THEN '.exe' WHEN 2 THEN '-clang-O0' WHEN 3 THEN concat('-O2-', printf('%06x', p_partkey)) ELSE '' END) AS name, lower(replace(p_name, ' ', '')) AS plain FROM {part}", lambda: ["id", text.infer_case(F.col("name")).alias("case_name")], "id, plain AS case_name")
simple("n_duration", "SELECT o_orderkey AS id, o_totalprice / 20 AS seconds FROM {orders}", lambda: ["id", text.duration(F.col("seconds")).alias("shown")], "id, CASE WHEN seconds < 10 THEN printf('%.1fs', seconds) WHEN seconds < 60 THEN printf('%ds', CAST(floor(seconds) AS BIGINT)) WHEN seconds < 3600 THEN printf('%dm%02ds', CAST(floor(seconds) AS BIGINT) // 60, CAST(floor(seconds) AS BIGINT) % 60) ELSE printf('%dh%02dm', CAST(floor(seconds) AS BIGINT) // 3600, CAST(floor(seconds) AS BIGINT) % 3600 // 60) END AS shown")
simple("n_tail", "SELECT conv_id, turn, text FROM {conversations}", lambda: ["conv_id", "turn", text.tail(F.col("text"), 100).alias("tail")], "conv_id, turn, CASE WHEN length(text) <= 100 THEN text ELSE concat('...', right(text, 100)) END AS tail")
_REPLY = "SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN concat('`', replace(p_name, ' ', '_'), '`') WHEN 1 THEN concat('void ', replace(p_name, ' ', '_'), '(int)') WHEN 2 THEN 'UNKNOWN' WHEN 3 THEN concat(replace(p_name, ' ', '_'), '()', chr(10), 'because') WHEN 4 THEN '  ' ELSE concat('**', replace(p_name, ' ', '_'), '**') END AS reply, replace(p_name, ' ', '_') AS plain FROM {part}"
simple("n_proposal", _REPLY, lambda: ["id", text.proposal_of_reply(F.col("reply")).alias("proposal")], "id, CASE WHEN id % 6 IN (2, 4) THEN NULL ELSE plain END AS proposal")
simple("n_reply_code", "SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN concat('Here:', chr(10), '```cpp', chr(10), text, chr(10), '```', chr(10), 'done') WHEN 1 THEN concat('```', text) ELSE text END AS reply, text FROM {conversations}", lambda: ["conv_id", "turn", text.code_of_reply(F.col("reply")).alias("code")], r"conv_id, turn, regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '') AS code")

_RENAMES = "SELECT 'd' AS binary_id, old, concat('renamed_', old) AS new FROM (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS old FROM {part}) r"
_RENAMES_SPARK = "SELECT 'd' AS binary_id, old, concat('renamed_', old) AS new FROM (SELECT DISTINCT explode(split(p_name, ' ')) AS old FROM {part}) r"
_FILES = "SELECT 'd' AS binary_id, p_partkey AS fid, concat('int ', replace(p_name, ' ', ' + '), ' = f(', p_name, ', x', p_name, ');') AS code FROM {part}"


@query("n_rename_apply", f"WITH f AS ({_FILES}), r AS ({_RENAMES}), w AS (SELECT fid, unnest(regexp_extract_all(code, '[A-Za-z0-9_]+|[^A-Za-z0-9_]+')) AS w, generate_subscripts(regexp_extract_all(code, '[A-Za-z0-9_]+|[^A-Za-z0-9_]+'), 1) AS i FROM f) SELECT fid, string_agg(coalesce(r.new, w.w), '' ORDER BY i) AS code FROM w LEFT JOIN r ON r.old = w.w GROUP BY fid")
def n_rename_apply(spark, d):
    return naming.apply(on_spark(spark, d, _FILES), on_spark(spark, d, _RENAMES_SPARK)).select("fid", "code")


_RANKED = "SELECT p_partkey, replace(p_name, ' ', '_') AS proposal, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS n FROM part"


@query("n_unique_names", f"SELECT concat('FUN_', printf('%08x', p_partkey)) AS old, CASE WHEN n = 1 THEN proposal ELSE concat(proposal, '_', n + 1) END AS new FROM ({_RANKED}) r WHERE n < 99")
def n_unique_names(spark, d):
    rows = on_spark(spark, d, "SELECT 'b' AS binary_id, concat('FUN_', printf('%08x', p_partkey)) AS old, replace(p_name, ' ', '_') AS proposal, p_partkey AS pos FROM {part}")
    taken = on_spark(spark, d, "SELECT DISTINCT 'b' AS binary_id, concat(replace(p_name, ' ', '_'), '_2') AS name FROM {part}")
    return naming.assign(rows, taken).select("old", "new")


# -- duplicates -------------------------------------------------------------------------------------------------------

_FP = r"sha1(trim(regexp_replace(regexp_replace(regexp_replace(CASE WHEN own = '' THEN code ELSE replace(code, own, 'F') END, '0x[0-9a-fA-F]{5,}', '0', 'g'), '\b[0-9a-fA-F]{6,}\b', '0', 'g'), '\s+', ' ', 'g')))"
_OWN = r"regexp_replace(regexp_replace(regexp_replace(stem, '-[0-9a-fA-F]{4,}$', ''), '^.*::', ''), '[^A-Za-z0-9_]', '', 'g')"
_FPS = f"WITH o AS (SELECT *, {_OWN} AS own FROM ({views.FUNCTIONS}) f), p AS (SELECT fid, stem, {_FP} AS fp FROM o)"


def _printed(spark, d):
    return on_spark(spark, d, views.FUNCTIONS).select("fid", "stem", "code", text.body_fingerprint(F.col("stem"), F.col("code")).alias("fp"))


@query("d_fingerprint_groups", f"{_FPS} SELECT fid, fp, min_by(stem, fid) OVER w AS rep, count(*) OVER w AS members FROM p WINDOW w AS (PARTITION BY fp)")
def d_fingerprint_groups(spark, d):
    return dedup.groups(_printed(spark, d), "fp", "fid", "stem").select("fid", "fp", "rep", "members")


@query("d_unique_keys", f"{_FPS} SELECT fp, min(stem) AS stem FROM p GROUP BY fp HAVING count(*) = 1")
def d_unique_keys(spark, d):
    return dedup.unique_keys(_printed(spark, d), "fp", "stem")


@query("d_fan_out", f"{_FPS}, r AS (SELECT fp, min_by(stem, fid) AS rep FROM p GROUP BY fp) SELECT fid, p.fp, rep, length(o.code) AS result FROM p JOIN r ON r.fp = p.fp JOIN o ON o.stem = r.rep".replace("SELECT fid, p.fp", "SELECT p.fid, p.fp"))
def d_fan_out(spark, d):
    out = dedup.fan_out(_printed(spark, d), "fp", "fid", "stem", lambda reps: reps.select("fp", "stem", F.length("code").cast("bigint").alias("result")))
    return out.select("fid", "fp", "rep", "result")


@query("d_same_documents", r"SELECT doc_id, min(doc_id) OVER w AS rep, count(*) OVER w AS members FROM (SELECT doc_id, md5(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\r]+', ' ', 'g')) AS k FROM documents) t WINDOW w AS (PARTITION BY k)")
def d_same_documents(spark, d):
    folded = F.md5(F.encode(F.regexp_replace(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "[ \t\n\r]+", " "), "UTF-8"))
    rows = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", folded.alias("k"))
    return dedup.groups(rows, "k", "doc_id", "doc_id").select("doc_id", "rep", "members")


# -- similarity -------------------------------------------------------------------------------------------------------

_WORDS = r"list_sort(list_distinct(list_filter(regexp_extract_all({0}, '[A-Za-z_][A-Za-z0-9_]+'), lambda w: NOT list_contains(['the', 'and'], lower(w)))))"


def _words(c: str):
    return F.array_sort(F.array_distinct(F.filter(F.regexp_extract_all(c, F.lit("[A-Za-z_][A-Za-z0-9_]+"), F.lit(0)), lambda w: ~F.lower(w).isin("the", "and"))))


_SETS = f"SELECT conv_id, turn, {_WORDS.format('original')} AS o, {_WORDS.format('candidate')} AS c, {_WORDS.format('raw')} AS r FROM ({views.PAIRS}) p"


def _sets(spark, d):
    return on_spark(spark, d, views.PAIRS).select("conv_id", "turn", _words("original").alias("o"), _words("candidate").alias("c"), _words("raw").alias("r"))


@query("s_identifier_recall", f"SELECT conv_id, turn, CAST(round(len(list_intersect(o, c)) / nullif(len(o), 0), 6) AS DOUBLE) AS recall FROM ({_SETS}) s")
def s_identifier_recall(spark, d):
    return _sets(spark, d).select("conv_id", "turn", F.round(similarity.recall(F.col("o"), F.col("c")), 6).alias("recall"))


_LOST = "list_filter(o, lambda x: NOT list_contains(r, x))"


@query("s_lost_recovery", f"WITH s AS ({_SETS}), l AS (SELECT *, {_LOST} AS lost FROM s) SELECT conv_id, turn, CASE WHEN len(lost) = 0 THEN 1.0 ELSE CAST(round(len(list_intersect(lost, c)) / len(lost), 6) AS DOUBLE) END AS score, CAST(len(lost) AS INTEGER) AS recoverable, CAST(len(list_intersect(lost, c)) AS INTEGER) AS recovered, array_to_string(list_sort(list_filter(lost, lambda x: NOT list_contains(c, x)))[1:12], ',') AS missed FROM l")
def s_lost_recovery(spark, d):
    out = _sets(spark, d).select("conv_id", "turn", similarity.lost_recovery(F.col("o"), F.col("r"), F.col("c")).alias("s"))
    return out.select("conv_id", "turn", F.round("s.score", 6).alias("score"), "s.recoverable", "s.recovered", F.array_join("s.missed", ",").alias("missed"))


_TOKENS = "SELECT conv_id, turn, unnest(string_split({0}, ' ')) AS w FROM ({1}) p"
_COSINE = f"WITH a AS (SELECT conv_id, turn, w, count(*) AS n FROM ({_TOKENS.format('original', views.PAIRS)}) t GROUP BY ALL), b AS (SELECT conv_id, turn, w, count(*) AS n FROM ({_TOKENS.format('candidate', views.PAIRS)}) t GROUP BY ALL), na AS (SELECT conv_id, turn, sqrt(sum(n * n)) AS z FROM a GROUP BY ALL), nb AS (SELECT conv_id, turn, sqrt(sum(n * n)) AS z FROM b GROUP BY ALL), dot AS (SELECT conv_id, turn, sum(a.n * b.n) AS s FROM a JOIN b USING (conv_id, turn, w) GROUP BY ALL), cos AS (SELECT na.conv_id, na.turn, coalesce(s, 0) / (na.z * nb.z) AS cosine FROM na JOIN nb USING (conv_id, turn) LEFT JOIN dot USING (conv_id, turn))"


def _cosines(rows):
    return similarity.token_cosine(rows, ["conv_id", "turn"], F.split("original", " "), F.split("candidate", " "))


@query("s_token_cosine", f"{_COSINE} SELECT conv_id, turn, CAST(round(cosine, 6) AS DOUBLE) AS cosine FROM cos")
def s_token_cosine(spark, d):
    return _cosines(on_spark(spark, d, views.PAIRS)).select("conv_id", "turn", F.round("cosine", 6).alias("cosine"))


@query("s_weighted_overall", f"{_COSINE}, s AS ({_SETS}), x AS (SELECT s.conv_id, s.turn, cosine, len(list_intersect(o, c)) / nullif(len(o), 0) AS ident, CASE WHEN s.turn % 2 = 0 THEN CAST(s.turn AS DOUBLE) / 10 END AS lit FROM s JOIN cos USING (conv_id, turn)) SELECT conv_id, turn, CAST(round((0.15 * cosine + coalesce(0.30 * ident, 0) + coalesce(0.20 * lit, 0)) / (0.15 + CASE WHEN ident IS NULL THEN 0 ELSE 0.30 END + CASE WHEN lit IS NULL THEN 0 ELSE 0.20 END), 6) AS DOUBLE) AS overall FROM x")
def s_weighted_overall(spark, d):
    rows = on_spark(spark, d, views.PAIRS)
    rows = rows.join(_cosines(rows), ["conv_id", "turn"])
    values = {"ast_shape": F.col("cosine"), "identifier_recovery": similarity.recall(_words("original"), _words("candidate")), "literal_recovery": F.when(F.col("turn") % 2 == 0, F.col("turn").cast("double") / 10)}
    return rows.select("conv_id", "turn", F.round(similarity.weighted(values, {k: v for k, v in similarity.SIMILARITY_WEIGHTS.items() if k in values}), 6).alias("overall"))


_SIDE = "SELECT conv_id AS program_id, concat('t', turn) AS name, turn AS ord, {0} AS fields FROM conversations WHERE role {1} 'assistant'"


@query("s_best_match", f"WITH l AS ({_SIDE.format(_WORDS.format('text'), '<>')}), r AS ({_SIDE.format(_WORDS.format('text'), '=')}), p AS (SELECT l.program_id, l.name, r.name AS match, r.ord, len(list_intersect(l.fields, r.fields)) AS k FROM l JOIN r ON r.program_id = l.program_id), b AS (SELECT *, row_number() OVER (PARTITION BY program_id, name ORDER BY k DESC, ord) AS n FROM p WHERE k > 0) SELECT l.program_id, l.name, b.match, coalesce(b.k, 0) AS overlap, CAST(round(coalesce(b.k / nullif(len(l.fields), 0), 0.0), 6) AS DOUBLE) AS recall FROM l LEFT JOIN b ON b.program_id = l.program_id AND b.name = l.name AND b.n = 1")
def s_best_match(spark, d):
    turns = spark.read.parquet(f"{d}/conversations.parquet").select(F.col("conv_id").alias("program_id"), F.concat(F.lit("t"), "turn").alias("name"), F.col("turn").alias("ord"), "role", _words("text").alias("fields"))
    out = similarity.best_match(turns.where("role <> 'assistant'"), turns.where("role = 'assistant'"))
    return out.select("program_id", "name", "match", "overlap", F.round("recall", 6).alias("recall"))


@query("s_sequence_ratio")
def s_sequence_ratio(spark, d):
    return on_spark(spark, d, views.PAIRS).select("conv_id", "turn", similarity.sequence_ratio(F.split("original", " "), F.split("candidate", " ")).alias("ratio"))


@query("s_compare_code")
def s_compare_code(spark, d):
    rows = on_spark(spark, d, views.FUNCTIONS)
    renamed = F.regexp_replace("code", "iVar", "total_")
    pairs = rows.select("fid", codeparse.parsed(F.col("code")).alias("original"), codeparse.parsed(renamed).alias("candidate"))
    out = similarity.compare(pairs)
    return out.select("fid", *[F.round(c, 6).alias(c) for c in ("structure", "ast_shape", "identifier_recovery", "literal_recovery", "overall")])


@query("s_pair_score", f"WITH s AS ({_SETS}), x AS (SELECT conv_id, turn, len(list_intersect(o, c)) / nullif(len(o), 0) AS i, CASE WHEN turn % 3 = 0 THEN NULL ELSE 0.5 END AS j, turn % 5 <> 0 AS ok FROM s) SELECT conv_id, turn, CASE WHEN NOT ok THEN 0.0 ELSE CAST(round(coalesce((coalesce(0.4 * i, 0) + coalesce(0.6 * j, 0)) / nullif(CASE WHEN i IS NULL THEN 0 ELSE 0.4 END + CASE WHEN j IS NULL THEN 0 ELSE 0.6 END, 0), 0.0), 6) AS DOUBLE) END AS score FROM x")
def s_pair_score(spark, d):
    judge = F.when(F.col("turn") % 3 != 0, 0.5)
    return _sets(spark, d).select("conv_id", "turn", F.round(similarity.pair_score(F.col("turn") % 5 != 0, similarity.recall(F.col("o"), F.col("c")), judge, {"identifier": 0.4, "judge": 0.6}), 6).alias("score"))


# -- joins ------------------------------------------------------------------------------------------------------------


@query("j_address_pairs", "SELECT d.doc_id AS address, l.quality, l.toxic FROM documents d JOIN labels l ON l.doc_id = d.doc_id")
def j_address_pairs(spark, d):
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    return docs.select(F.col("doc_id").alias("address")).join(labels.withColumnRenamed("doc_id", "address"), "address")


_DONE = "SELECT 'b' AS binary_id, concat('Order#', o_orderkey) AS stem FROM {orders} WHERE o_orderstatus = 'F'"
_RENAMED = "SELECT 'b' AS binary_id, concat('Order#', o_orderkey) AS old, concat('Order#', o_orderkey + 1) AS new FROM {orders} WHERE o_orderstatus = 'P'"
_TODO = "SELECT 'b' AS binary_id, concat('Order#', o_orderkey) AS name FROM {orders}"


@query("j_resume", f"WITH t AS ({_TODO}), r AS ({_RENAMED}), d AS ({_DONE}) SELECT t.name FROM t LEFT JOIN r ON r.old = t.name WHERE t.name NOT IN (SELECT stem FROM d) AND (r.new IS NULL OR r.new NOT IN (SELECT stem FROM d))")
def j_resume(spark, d):
    return gate.resume(on_spark(spark, d, _TODO), on_spark(spark, d, _RENAMED), on_spark(spark, d, _DONE)).select("name")


_TYPE_NAMES = "SELECT DISTINCT regexp_extract(text, '^([A-Za-z]+)', 1) AS w FROM {benchmark}"


@query("j_whole_word", f"SELECT DISTINCT d.doc_id, n.w FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS w FROM documents) d JOIN ({_TYPE_NAMES}) n ON n.w = d.w AND n.w <> ''")
def j_whole_word(spark, d):
    """Names that occur as whole words: tokens meet by an equi-join, not every name with every text."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    words = docs.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z0-9_]+"), F.lit(0)))).alias("w"))
    return words.join(on_spark(spark, d, _TYPE_NAMES).where("w <> ''"), "w").select("doc_id", "w")


_SYMBOLS = "SELECT CAST(s_nationkey AS VARCHAR(20)) AS binary_id, s_name AS original, concat(s_name, '_v2') AS new_name, concat('int ', s_name, '(int)') AS signature FROM {supplier}"
_SITES = "SELECT CAST(a.s_nationkey AS VARCHAR(20)) AS binary_id, a.s_name AS name, concat(a.s_name, '_v2') AS current, concat(b.s_name, '_v2') AS callee FROM {supplier} a LEFT JOIN {supplier} b ON b.s_suppkey = a.s_suppkey + 25 AND a.s_suppkey % 3 = 0"


@query("j_context", f"WITH s AS ({_SYMBOLS}), c AS ({_SITES}), m AS (SELECT DISTINCT c.binary_id, c.name, s.new_name AS k, s.signature FROM c JOIN s ON s.binary_id = c.binary_id AND s.new_name = c.callee AND c.callee <> c.current), o AS (SELECT DISTINCT c.binary_id, c.name, s.original AS k, s.signature FROM c JOIN s ON s.binary_id = c.binary_id WHERE s.new_name <> c.current AND s.original <> c.current AND NOT EXISTS (SELECT 1 FROM m WHERE m.binary_id = c.binary_id AND m.name = c.name)), u AS (SELECT * FROM m UNION ALL SELECT * FROM o), l AS (SELECT binary_id, name, string_agg(signature || ';', chr(10) ORDER BY k, signature) AS context FROM u GROUP BY ALL) SELECT DISTINCT c.binary_id, c.name, coalesce(l.context, '// (no related functions)') AS context FROM c LEFT JOIN l ON l.binary_id = c.binary_id AND l.name = c.name")
def j_context(spark, d):
    return stages.sibling_context(on_spark(spark, d, _SITES), on_spark(spark, d, _SYMBOLS))


@query("j_callee_context", f"WITH e AS ({views.DAG}), s AS (SELECT concat('p', p_partkey) AS original, CASE WHEN p_partkey % 2 = 0 THEN concat('p', p_partkey) ELSE replace(p_name, ' ', '_') END AS new_name, concat('void ', replace(p_name, ' ', '_'), '()') AS signature FROM part) SELECT src AS name, string_agg(signature || ';' || CASE WHEN new_name <> original THEN '  // was ' || original ELSE '' END, chr(10) ORDER BY original) AS context FROM e JOIN s ON s.original = e.dst GROUP BY src")
def j_callee_context(spark, d):
    symbols = on_spark(spark, d, "SELECT 'dag' AS binary_id, concat('p', p_partkey) AS original, CASE WHEN p_partkey % 2 = 0 THEN concat('p', p_partkey) ELSE replace(p_name, ' ', '_') END AS new_name, concat('void ', replace(p_name, ' ', '_'), '()') AS signature FROM {part}")
    return stages.callee_context(on_spark(spark, d, views.DAG), symbols).select("name", "context")


# -- experiments ------------------------------------------------------------------------------------------------------

_S = f"WITH s AS ({views.SCORES})"


@query("e_paired", f"{_S}, b AS (SELECT example, score AS base FROM s WHERE candidate = 's1') SELECT candidate, count(*) AS n, CAST(round(avg(score), 6) AS DOUBLE) AS mean, CAST(round(avg(score - base), 6) AS DOUBLE) AS delta, count(*) FILTER (score > base + 1e-9) AS wins, count(*) FILTER (score < base - 1e-9) AS losses FROM s JOIN b USING (example) GROUP BY candidate")
def e_paired(spark, d):
    out = experiments.paired(on_spark(spark, d, views.SCORES), "s1")
    return out.select("candidate", "n", F.round("mean", 6).alias("mean"), F.round("delta", 6).alias("delta"), "wins", "losses")


@query("e_paired_default", f"{_S}, b AS (SELECT example, score AS base FROM s WHERE candidate = 's1') SELECT candidate, count(*) AS n, CAST(round(avg(score - coalesce(base, 0)), 6) AS DOUBLE) AS delta FROM s LEFT JOIN b USING (example) GROUP BY candidate")
def e_paired_default(spark, d):
    out = experiments.paired(on_spark(spark, d, views.SCORES), "s1", missing=0.0)
    return out.select("candidate", "n", F.round("delta", 6).alias("delta"))


_MEANS = f"{_S}, m AS (SELECT candidate, round(avg(score), 6) AS mean FROM s GROUP BY candidate)"


def _means(spark, d):
    return on_spark(spark, d, views.SCORES).groupBy("candidate").agg(experiments.mean(F.col("score"), 4, 6).alias("mean"))


@query("e_winner", f"{_MEANS} SELECT candidate, CAST(mean AS DOUBLE) AS mean FROM m ORDER BY m.mean DESC, candidate LIMIT 1")
def e_winner(spark, d):
    return experiments.winner(_means(spark, d))


@query("e_leaderboard", f"{_MEANS}, n AS (SELECT candidate, CASE WHEN candidate LIKE '%7' THEN NULL ELSE mean END AS mean FROM m) SELECT candidate, CAST(mean AS DOUBLE) AS mean, CAST(row_number() OVER (ORDER BY n.mean DESC NULLS LAST, candidate) AS INTEGER) AS rank FROM n")
def e_leaderboard(spark, d):
    table = _means(spark, d).withColumn("mean", F.when(~F.col("candidate").like("%7"), F.col("mean")))
    return experiments.leaderboard(table, "mean", "candidate")


@query("e_worst", f"{_MEANS} SELECT candidate AS example, CAST(mean AS DOUBLE) AS score FROM m ORDER BY m.mean, candidate LIMIT 5")
def e_worst(spark, d):
    return experiments.worst(_means(spark, d).select(F.col("candidate").alias("example"), F.col("mean").alias("score")), 4)


_REPEATS = "SELECT l_returnflag AS candidate, l_linenumber AS repeat, l_discount AS score FROM {lineitem}"


@query("e_repeated", f"WITH p AS (SELECT candidate, repeat, avg(score) AS m FROM ({_REPEATS}) r GROUP BY ALL) SELECT candidate, count(*) AS repeats, CAST(round(avg(m), 6) AS DOUBLE) AS mean, CAST(round(coalesce(stddev_samp(m), 0.0), 6) AS DOUBLE) AS stdev FROM p GROUP BY candidate")
def e_repeated(spark, d):
    out = experiments.repeated(on_spark(spark, d, _REPEATS))
    return out.select("candidate", "repeats", F.round("mean", 6).alias("mean"), F.round("stdev", 6).alias("stdev"))


@query("e_pareto", f"{_S}, t AS (SELECT *, max(score) OVER (PARTITION BY example) AS top FROM s) SELECT candidate, count(*) FILTER (score >= top AND top > 0) AS wins, count(*) FILTER (score >= top AND top > 0) + 1 AS weight FROM t GROUP BY candidate")
def e_pareto(spark, d):
    return experiments.pareto_wins(on_spark(spark, d, views.SCORES))


_NOW = "SELECT concat('s', s_suppkey) AS case_name, s_acctbal AS overall FROM {supplier}"
_THEN = "SELECT concat('s', s_suppkey) AS case_name, s_acctbal / 2 AS overall FROM {supplier} WHERE s_acctbal > 0"


@query("e_baseline", f"SELECT n.case_name, n.overall, b.overall AS baseline, CAST(round(n.overall - b.overall, 6) AS DOUBLE) AS delta FROM ({_NOW}) n LEFT JOIN ({_THEN}) b USING (case_name)")
def e_baseline(spark, d):
    now, then = (on_spark(spark, d, s).withColumnRenamed("case_name", "case") for s in (_NOW, _THEN))
    return experiments.against_baseline(now, then).select(F.col("case").alias("case_name"), "overall", "baseline", F.round("delta", 6).alias("delta"))


@query("e_degrades", "WITH m AS (SELECT l_suppkey AS g, l_linenumber AS k, round(avg(l_discount), 6) AS mean FROM lineitem GROUP BY ALL) SELECT g, CAST(min_by(mean, k) AS DOUBLE) AS first, CAST(max_by(mean, k) AS DOUBLE) AS last, max_by(mean, k) < min_by(mean, k) - 0.02 AS degrades FROM m GROUP BY g")
def e_degrades(spark, d):
    means = spark.read.parquet(f"{d}/lineitem.parquet").groupBy(F.col("l_suppkey").alias("g"), F.col("l_linenumber").alias("k")).agg(F.round(F.avg("l_discount"), 6).alias("mean"))
    return experiments.degrades(means, "k", "mean", "g")


_CALLS_LOG = "SELECT event_type AS model, value AS seconds, user_id % 2 = 0 AS cached FROM {events}"


@query("e_costs", f"SELECT model, count(*) FILTER (NOT cached) AS calls, CAST(round(coalesce(sum(seconds) FILTER (NOT cached), 0.0), 2) AS DOUBLE) AS seconds FROM ({_CALLS_LOG}) c GROUP BY model")
def e_costs(spark, d):
    return experiments.costs(on_spark(spark, d, _CALLS_LOG)).select("model", "calls", F.round("seconds", 2).alias("seconds"))


@query("e_uncached", "SELECT DISTINCT o_custkey, o_orderpriority FROM orders WHERE (o_custkey, o_orderpriority) NOT IN (SELECT (o_custkey, o_orderpriority) FROM orders WHERE o_orderstatus = 'F')")
def e_uncached(spark, d):
    orders = spark.read.parquet(f"{d}/orders.parquet")
    keys = ["o_custkey", "o_orderpriority"]
    return experiments.uncached(orders.select(*keys).distinct(), orders.where("o_orderstatus = 'F'"), keys)


@query("e_split")
def e_split(spark, d):
    rows = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_brand").alias("program_id"), F.concat("p_name", F.lit("-"), "p_partkey").alias("name"))
    return experiments.split(rows, 0.3)


# -- runs, state, sources ---------------------------------------------------------------------------------------------


@query("r_first_use", "SELECT string_agg(event_type, ' + ' ORDER BY t, i) AS models FROM (SELECT event_type, min(ts) AS t, min_by(event_id, (ts, event_id)) AS i FROM events GROUP BY event_type) m")
def r_first_use(spark, d):
    return state.models_used(spark.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("model"), F.struct("ts", "event_id").alias("at")))


@query("r_counters", "SELECT event_type AS stage, count(*) AS runs, count(*) FILTER (value > 50) AS improved, count(*) FILTER (value <= 50) AS skipped FROM events GROUP BY event_type")
def r_counters(spark, d):
    ev = spark.read.parquet(f"{d}/events.parquet")
    return ev.groupBy(F.col("event_type").alias("stage")).agg(F.count(F.lit(1)).alias("runs"), F.count_if(F.col("value") > 50).alias("improved"), F.count_if(F.col("value") <= 50).alias("skipped"))


@query("r_latest", "SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) e WHERE n = 1")
def r_latest(spark, d):
    ev = spark.read.parquet(f"{d}/events.parquet").select("user_id", "event_type", "value", "ts", "event_id")
    return dedup.last_wins(ev, ["user_id"], ["ts", "event_id"]).select("user_id", "event_type", "value")


@query("r_first_wins", "SELECT k, v FROM (SELECT k, v, row_number() OVER (PARTITION BY k ORDER BY p) AS n FROM (SELECT s_suppkey AS k, s_name AS v, 0 AS p FROM supplier UNION ALL SELECT c_custkey, c_name, 1 FROM customer) u) x WHERE n = 1")
def r_first_wins(spark, d):
    return dedup.first_wins(on_spark(spark, d, "SELECT s_suppkey AS k, s_name AS v FROM {supplier}"), on_spark(spark, d, "SELECT c_custkey AS k, c_name AS v FROM {customer}"), key=["k"])


@query("r_best_so_far", "SELECT event_id, coalesce(value > max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS best FROM events")
def r_best_so_far(spark, d):
    ev = spark.read.parquet(f"{d}/events.parquet")
    return experiments.best_so_far(ev, "event_id", "value", "user_id").select("event_id", "best")


@query("r_eta", "SELECT event_id, CASE WHEN k = n THEN 0.0 ELSE CAST(round(k * 2.5 / k * (n - k), 6) AS DOUBLE) END AS eta FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events) e")
def r_eta(spark, d):
    from pyspark.sql import Window

    per = Window.partitionBy("user_id")
    ev = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.row_number().over(per.orderBy("event_id")).alias("k"), F.count(F.lit(1)).over(per).alias("n"))
    return ev.select("event_id", F.round(experiments.eta(F.col("k"), F.col("n"), F.col("k") * 2.5), 6).alias("eta"))


@query("x_program_text", "SELECT conv_id, string_agg('// ===== t' || turn || ' =====' || chr(10) || text, chr(10) ORDER BY CASE WHEN role = 'system' THEN 0 ELSE 1 END, turn) AS source, substr(sha256(string_agg('t' || turn || text, '' ORDER BY CASE WHEN role = 'system' THEN 0 ELSE 1 END, turn)), 1, 16) AS source_hash FROM conversations GROUP BY conv_id")
def x_program_text(spark, d):
    from sievework.sources import programs

    turns = spark.read.parquet(f"{d}/conversations.parquet")
    files = turns.select(F.col("conv_id").alias("id"), F.concat(F.lit("t"), "turn").alias("name"), (F.col("role") == "system").alias("is_header"), F.lpad(F.col("turn").cast("string"), 6, "0").alias("path"), "text")
    return programs.assembled(files).select(F.col("id").alias("conv_id"), "source", "source_hash")


@query("x_digest", "SELECT doc_id, md5(text) AS md5, sha256(text) AS sha256 FROM documents")
def x_digest(spark, d):
    from sievework.sources import functions_dir

    return functions_dir.digests(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.encode("text", "UTF-8").alias("content"))).select("doc_id", "md5", "sha256")


@query("x_lookup", "SELECT p_name AS name, p_brand AS body FROM part WHERE p_name = (SELECT min(p_name) FROM part)")
def x_lookup(spark, d):
    parts = spark.read.parquet(f"{d}/part.parquet")
    store = parts.select(F.col("p_name").alias("name"), F.col("p_brand").alias("body"))
    return state.lookup(store, store.agg(F.min("name").alias("name")))


@query("x_context_sizes", f"WITH e AS ({views.DAG}), s AS (SELECT concat('p', p_partkey) AS name, length(p_name) AS k FROM part) SELECT e.src AS name, count(*) AS callees, CAST(sum(s.k) AS BIGINT) AS chars, (SELECT CAST(sum(k) AS BIGINT) FROM s) AS full_chars FROM e JOIN s ON s.name = e.dst GROUP BY e.src")
def x_context_sizes(spark, d):
    sizes = on_spark(spark, d, "SELECT concat('p', p_partkey) AS name, length(p_name) AS k FROM {part}")
    edges = on_spark(spark, d, views.DAG)
    full = sizes.agg(F.sum("k").alias("full_chars"))
    own = edges.join(sizes.withColumnRenamed("name", "dst"), "dst").groupBy(F.col("src").alias("name")).agg(F.count(F.lit(1)).alias("callees"), F.sum("k").alias("chars"))
    return own.join(F.broadcast(full))  # one row


# -- parsing and stages: what each text of views.FUNCTIONS must give, by how it is built -----------------------------------------------------------------------------------------


@query("p_scan_items")
def p_scan_items(spark, d):
    return codeparse.items(on_spark(spark, d, views.FUNCTIONS).select("fid", "code")).select("fid", "ordinal", "kind", "item", "body", F.array_join("calls", ",").alias("calls"))


@query("p_complexity", f"SELECT fid, CASE WHEN fid % 13 = 0 THEN NULL WHEN fid % 11 = 5 THEN '_start' ELSE name END AS parsed_name, 1 AS cyclomatic, CASE WHEN fid % 13 IN (0, 2) THEN 0 ELSE 1 END AS n_calls, CASE fid % 13 WHEN 0 THEN 0 WHEN 2 THEN 1 ELSE 2 END AS max_depth, CASE fid % 13 WHEN 0 THEN NULL WHEN 1 THEN concat('void ', name, '(void)') WHEN 2 THEN concat('long ', name, '(int total)') ELSE concat('undefined8 ', name, '(int param_1)') END AS signature FROM ({views.FUNCTIONS}) f")
def p_complexity(spark, d):
    s = on_spark(spark, d, views.FUNCTIONS).select("fid", codeparse.shape(F.col("code")).alias("s"))
    return s.select("fid", "s.parsed_name", "s.cyclomatic", "s.n_calls", "s.max_depth", "s.signature")


@query("p_valid", f"SELECT fid, fid % 13 <> 0 AS valid FROM ({views.FUNCTIONS}) f")
def p_valid(spark, d):
    return on_spark(spark, d, views.FUNCTIONS).select("fid", codeparse.valid(F.col("code")).alias("valid"))


@query("p_parse")
def p_parse(spark, d):
    p = on_spark(spark, d, views.FUNCTIONS).select("fid", codeparse.parsed(F.col("code")).alias("p"))
    return p.select("fid", F.size("p.tokens").alias("n_tokens"), F.array_join("p.identifiers", ",").alias("identifiers"), F.array_join("p.literals", ",").alias("literals"))


_OWNER = "CASE fid % 11 WHEN 0 THEN 'std::vector' WHEN 4 THEN 'Ledger' ELSE '' END"


@query("p_identity", f"SELECT stem AS name, CASE WHEN fid % 11 = 5 OR fid % 13 = 0 THEN '' WHEN fid % 13 = 1 THEN own WHEN own = '' THEN ns ELSE concat(ns, '::', own) END AS qualifier, CASE fid % 11 WHEN 0 THEN 'push_back' WHEN 4 THEN replace(name, 'Ledger::', '') WHEN 5 THEN CASE WHEN fid % 13 = 0 THEN 'processEntry_start' ELSE '_start' END ELSE name END AS base, CASE fid % 13 WHEN 0 THEN -1 WHEN 1 THEN 0 WHEN 2 THEN 2 ELSE 1 END AS arity, CASE fid % 13 WHEN 0 THEN '' WHEN 1 THEN '' WHEN 2 THEN 'int,Item' ELSE 'int' END AS params FROM (SELECT *, {_OWNER} AS own, CASE fid % 13 WHEN 2 THEN 'ns::Store' ELSE 'ns::Graph' END AS ns FROM ({views.FUNCTIONS}) f) x")
def p_identity(spark, d):
    out = callgraph.identified(on_spark(spark, d, views.FUNCTIONS).select("binary_id", F.col("stem").alias("name"), "code"))
    return out.select("name", "qualifier", "base", "arity", F.array_join("params", ",").alias("params"))


@query("p_callgraph", f"WITH f AS ({views.FUNCTIONS}) SELECT f.binary_id, f.stem AS src, g.stem AS dst FROM f JOIN f g ON g.fid = f.fid + 1 WHERE f.fid % 13 > 2 AND g.fid % 11 > 5")
def p_callgraph(spark, d):
    return callgraph.build(on_spark(spark, d, views.FUNCTIONS).select("binary_id", F.col("stem").alias("name"), "code"))


@query("t_improve")
def t_improve(spark, d):
    """Improve every function worth it, with a provider that renames one placeholder."""
    rows = _scored(spark, d).withColumn("name", F.col("stem")).select("binary_id", "name", "code", "score")
    functions = staged(rows, "functions")
    shaped = functions.withColumn("s", codeparse.shape(F.col("code"))).select("*", "s.parsed_name", "s.calls", "s.cyclomatic")
    todo = staged(gate.gate(shaped).where("worth").select("binary_id", "name", "score"), "todo")
    done = spark.createDataFrame([], "binary_id string, name string, answer string")
    outcomes, _ = stages.improve(functions, staged(callgraph.build(functions), "calls"), todo, done, demo_provider)
    return outcomes.select("name", "status", "detail", "answer")


@query("t_naming")
def t_naming(spark, d):
    """Name every placeholder, with a provider that answers from the text alone, and rewrite all files."""
    files = staged(on_spark(spark, d, views.FUNCTIONS).select("binary_id", F.col("stem").alias("name"), "code"), "files")
    symbols = spark.createDataFrame([], "binary_id string, original string, new_name string, signature string")
    out, _ = stages.name_all(files, staged(callgraph.build(files), "calls"), symbols, demo_provider)
    return out.select("name", "code")


# -- judges and whole runs --------------------------------------------------------------------------------------------

#: Replies of a judge: fenced with all keys, without an overall, prose, an empty object, a broken one, an axis that is no number.
_JUDGED = """SELECT event_id AS id, event_id % 10 AS a, event_id % 7 AS b, CASE event_id % 6
  WHEN 0 THEN concat('Here it is:', chr(10), '```json', chr(10), '{"correctness": 0.', event_id % 10, ', "readability": 0.', event_id % 7, ', "naming": 1, "types": 0.5, "overall": 0.', event_id % 7, ', "critique": " fine "}', chr(10), '```')
  WHEN 1 THEN concat('{"correctness": 0.', event_id % 10, ', "readability": 0.', event_id % 7, ', "naming": 1}')
  WHEN 2 THEN 'I cannot rate this' WHEN 3 THEN '{}' WHEN 4 THEN '{"correctness": ' ELSE concat('{"correctness": "bad", "types": 0.', event_id % 10, ', "critique": "x"} done') END AS reply FROM {events}"""
_JUDGE_OK = "id % 6 IN (0, 1, 5)"


@query("e_judge", f"SELECT id, CAST(round(CASE id % 6 WHEN 0 THEN b / 10.0 WHEN 1 THEN (a / 10.0 + b / 10.0 + 1) / 4 WHEN 5 THEN a / 40.0 ELSE 0 END, 6) AS DOUBLE) AS score, CASE WHEN {_JUDGE_OK} THEN CAST(CASE WHEN id % 6 = 5 THEN 0 ELSE a / 10.0 END AS DOUBLE) END AS correctness, CASE WHEN {_JUDGE_OK} THEN CAST(CASE id % 6 WHEN 0 THEN 0.5 WHEN 1 THEN 0 ELSE a / 10.0 END AS DOUBLE) END AS types, CASE id % 6 WHEN 0 THEN 'fine' WHEN 1 THEN '' WHEN 5 THEN 'x' END AS critique, {_JUDGE_OK} AS usable FROM ({_JUDGED}) j")
def e_judge(spark, d):
    v = on_spark(spark, d, _JUDGED).select("id", judging.verdict(F.col("reply")).alias("v"))
    return v.select("id", F.round("v.score", 6).alias("score"), "v.correctness", "v.types", "v.critique", (F.col("v.detail") == "").alias("usable"))


_HEADERS = "SELECT DISTINCT conv_id AS program_id, conv_id % 11 = 0 AS failed, conv_id % 7 <> 0 AS parses, CASE WHEN conv_id % 3 <> 0 THEN CAST(0.5 AS DOUBLE) END AS judge FROM {conversations}"


@query("e_header_score", f"WITH m AS ({ORACLE_SQL['s_best_match']}), s AS (SELECT program_id, count(*) AS structs, avg(recall) AS struct FROM m GROUP BY program_id), h AS ({_HEADERS}) SELECT h.program_id, CAST(coalesce(structs, 0) AS BIGINT) AS structs, CAST(round(coalesce(struct, 1.0), 4) AS DOUBLE) AS struct, CAST(round(CASE WHEN failed OR NOT parses THEN 0 WHEN judge IS NULL THEN coalesce(struct, 1.0) ELSE 0.6 * coalesce(struct, 1.0) + 0.4 * judge END, 4) AS DOUBLE) AS score FROM h LEFT JOIN s ON s.program_id = h.program_id WHERE failed OR coalesce(structs, 0) > 0")
def e_header_score(spark, d):
    turns = spark.read.parquet(f"{d}/conversations.parquet").select(F.col("conv_id").alias("program_id"), F.concat(F.lit("t"), "turn").alias("name"), F.col("turn").alias("ord"), "role", _words("text").alias("fields"))
    out = judging.header_control(judging.header_scores(on_spark(spark, d, _HEADERS), turns.where("role <> 'assistant'"), turns.where("role = 'assistant'")))
    return out.select("program_id", "structs", F.round("struct", 4).alias("struct"), F.round("score", 4).alias("score"))


@query("e_control", "SELECT l_suppkey AS g, count(*) AS n, count(CASE WHEN l_linenumber < 4 THEN 1 END) AS defined, CAST(round(coalesce(avg(CASE WHEN l_linenumber < 4 THEN CAST(l_discount AS DOUBLE) END), 0), 4) AS DOUBLE) AS best_score FROM lineitem GROUP BY l_suppkey")
def e_control(spark, d):
    scores = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_suppkey").alias("g"), F.concat_ws("/", "l_orderkey", "l_linenumber").alias("case"), F.when(F.col("l_linenumber") < 4, F.col("l_discount").cast("double")).alias("score"))
    return experiments.control(scores, "g", "case", "score").select("g", "n", "defined", "best_score")


@query("e_before_after", "SELECT l_returnflag AS g, count(*) FILTER (l_linenumber < 6) AS n, CAST(round(avg(CASE WHEN l_linenumber < 6 THEN l_discount END), 6) AS DOUBLE) AS base_mean, CAST(round(avg(CASE WHEN l_linenumber < 6 THEN l_tax END), 6) AS DOUBLE) AS refined_mean FROM lineitem GROUP BY l_returnflag")
def e_before_after(spark, d):
    scores = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_returnflag").alias("g"), (F.col("l_linenumber") >= 6).alias("failed"), F.col("l_discount").cast("double").alias("base"), F.col("l_tax").cast("double").alias("refined"))
    return experiments.before_after(scores, "g").select("g", "n", F.round("base_mean", 6).alias("base_mean"), F.round("refined_mean", 6).alias("refined_mean"))


@query("r_planned_order", "SELECT o_orderkey AS k, CAST(row_number() OVER (PARTITION BY o_orderstatus ORDER BY CASE WHEN o_orderkey % 5 <> 0 THEN -o_orderkey END NULLS LAST, concat('f', o_orderkey)) AS INTEGER) AS turn FROM orders")
def r_planned_order(spark, d):
    rows = on_spark(spark, d, "SELECT concat('b', o_orderstatus) AS binary_id, concat('f', o_orderkey) AS name, o_orderstatus AS status, o_orderkey AS k FROM {orders}")
    return runs.in_planned_order(rows, rows.where("k % 5 <> 0").select("binary_id", "name", (-F.col("k")).alias("pos"))).select("k", "turn")


@query("g_dry_run", with_graph("dag", f"{_LEVELS}, w AS (SELECT name, level, length(name) AS score FROM levels WHERE name NOT LIKE 'p%' AND name NOT LIKE 'n%'), z AS (SELECT level, count(*) AS n FROM w GROUP BY level) SELECT (SELECT count(*) FROM v) AS functions, (SELECT count(*) FROM v WHERE name LIKE 'n%') AS done, (SELECT count(*) FROM v WHERE name LIKE 'p%') AS filtered, (SELECT count(*) FROM w) AS todo, (SELECT CAST(count(*) AS INTEGER) FROM z) AS levels, (SELECT CAST(sum(ceil(n / 8.0)) AS BIGINT) FROM z) AS rounds, (SELECT string_agg(n, ',' ORDER BY level) FROM z) AS sizes, (SELECT string_agg(name, ',' ORDER BY score DESC, name) FROM (SELECT * FROM w ORDER BY score DESC, name LIMIT 8) t) AS first"))
def g_dry_run(spark, d):
    vertices, edges = load(spark, d, "dag")
    functions = vertices.select("binary_id", "name", F.length("name").alias("score"), (~F.col("name").like("p%")).alias("worth"))
    out = runs.dry_run(functions, graph.levels(vertices, edges), vertices.where("name LIKE 'n%'"), 8)
    return out.select("functions", "done", "filtered", "todo", "levels", "rounds", F.array_join(F.col("sizes").cast("array<string>"), ",").alias("sizes"), F.array_join("first", ",").alias("first"))


#: One file or a folder of two a case, folders that are no case, and cases not asked for.
_LAID_OUT = "SELECT p_partkey % 4 AS k, (p_partkey - p_partkey % 4) / 4 AS n, concat('c', CAST((p_partkey - p_partkey % 4) / 4 AS BIGINT), CASE p_partkey % 4 WHEN 0 THEN '.cpp' WHEN 1 THEN '/b.cpp' WHEN 2 THEN '/sub/a.c' ELSE '/notes.txt' END) AS path, p_name AS text FROM {part}"


@query("x_candidates", f"WITH f AS (SELECT *, CAST(n AS BIGINT) AS c FROM ({_LAID_OUT}) l WHERE NOT (k = 0 AND CAST(n AS BIGINT) % 3 <> 0) AND k <> 3), o AS (SELECT c, bool_or(k = 0) AS alone FROM f GROUP BY c) SELECT concat('c', f.c) AS case_name, string_agg(text, chr(10) || chr(10) ORDER BY k) AS text FROM f JOIN o ON o.c = f.c WHERE f.c % 5 <> 4 AND (k = 0 OR NOT alone) GROUP BY f.c")
def x_candidates(spark, d):
    files = on_spark(spark, d, _LAID_OUT).where("NOT (k = 0 AND CAST(n AS BIGINT) % 3 <> 0)")
    cases = files.where("CAST(n AS BIGINT) % 5 <> 4").select(F.concat(F.lit("c"), F.col("n").cast("bigint")).alias("case")).distinct()
    return programs.candidates(files.select("path", "text"), cases, "/out/run").withColumnRenamed("case", "case_name")


def demo_provider():
    """A deterministic stand-in for a model."""

    def answer(prompt: str) -> str:
        code = prompt.rsplit("\n\n", 1)[-1]
        if prompt.startswith("Name this"):
            return f"handles_{len(code)}"
        return "```cpp\n" + code.replace("param_1", "count") + "\n```"

    return answer
