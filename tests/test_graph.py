"""Graph operators on small graphs, and their invariants on random ones."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from sievework.operators import graph

EDGES = "binary_id string, src string, dst string"


def make(spark, edges, extra=()):
    names = sorted({x for e in edges for x in e} | set(extra))
    rows = [("b", a, b) for a, b in edges if a != b]
    return spark.createDataFrame([("b", n) for n in names], "binary_id string, name string"), spark.createDataFrame(rows, EDGES)


def as_map(df, value):
    return {r["name"]: r[value] for r in df.collect()}


def test_diamond_levels(spark):
    v, e = make(spark, [("main", "parse"), ("main", "emit"), ("parse", "lex"), ("emit", "lex")])
    assert as_map(graph.levels(v, e), "level") == {"lex": 0, "parse": 1, "emit": 1, "main": 2}
    assert [tuple(r) for r in graph.rounds(graph.levels(v, e), 1).select("levels", "rounds").collect()] == [(3, 4)]


def test_cycle_keeps_all_nodes_once(spark):
    v, e = make(spark, [("a", "b"), ("b", "a"), ("c", "a")], ["self"])
    rows = graph.ordered(v, e).collect()
    assert sorted(r["name"] for r in rows) == ["a", "b", "c", "self"]
    assert set(as_map(graph.levels_any(v, e), "level")) == {"a", "b", "c", "self"}


def test_entries(spark):
    v, e = make(spark, [("main", "a"), ("a", "b")], ["unused"])
    assert [r["name"] for r in graph.entry_points(v, e).collect()] == ["main"]
    v, e = make(spark, [("api_1", "h1"), ("api_2", "h2"), ("api_3", "h3")])
    assert sorted(r["name"] for r in graph.entry_points(v, e).collect()) == ["api_1", "api_2", "api_3"]
    exported = spark.createDataFrame([("b", "h2")], "binary_id string, name string")
    assert [r["name"] for r in graph.entry_points(v, e, exported).collect()] == ["h2"]
    v, e = make(spark, [("a", "b"), ("b", "a")])
    assert graph.entry_points(v, e, exported.union(spark.createDataFrame([("b", "a")], exported.schema))).count() == 0


def test_subset_levels_through_others(spark):
    v, e = make(spark, [("a", "lib1"), ("lib1", "b"), ("b", "lib2"), ("lib2", "c")])
    subset = v.where("name IN ('a', 'b', 'c')")
    assert as_map(graph.levels_subset(v, e, subset), "level") == {"c": 0, "b": 1, "a": 2}


def test_depths_are_least(spark):
    v, e = make(spark, [("a", "b"), ("b", "c"), ("a", "c"), ("c", "a")])
    assert as_map(graph.depths(e, graph.starts_from(spark, "b", ["a"])), "depth") == {"a": 0, "b": 1, "c": 1}


def test_empty(spark):
    v, e = spark.createDataFrame([], "binary_id string, name string"), spark.createDataFrame([], EDGES)
    assert graph.levels(v, e).count() == graph.ordered(v, e).count() == graph.entry_points(v, e).count() == graph.depths(e, v).count() == 0


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), min_size=1, max_size=20))
def test_edges_of_a_dag_go_down(spark, pairs):
    edges = sorted({(f"n{max(p)}", f"n{min(p)}") for p in pairs if p[0] != p[1]})
    if not edges:
        return
    v, e = make(spark, edges)
    level = as_map(graph.levels(v, e), "level")
    exact = as_map(graph.ordered(v, e), "level")
    assert level == exact
    assert all(level[a] > level[b] for a, b in edges)


def test_a_walk_and_rounds_agree(spark):
    """Random graphs, some with cycles: one task a binary and rounds over all give the same depths and levels."""
    import random

    rng = random.Random(5)
    rows, names = set(), []
    for b in range(12):
        n = rng.randint(2, 14)
        names += [(f"b{b}", f"v{i}") for i in range(n)]
        for _ in range(rng.randint(0, 30)):
            x, y = rng.sample(range(n), 2)
            rows.add((f"b{b}", f"v{x}", f"v{y}") if b % 3 == 0 or x < y else (f"b{b}", f"v{y}", f"v{x}"))
    e = spark.createDataFrame(sorted(rows), "binary_id string, src string, dst string")
    v = spark.createDataFrame(names, "binary_id string, name string")
    starts = v.where("name IN ('v0', 'v3')")
    for small in (0, 8, 20):
        for most in (None, 0, 2):
            assert sorted(map(tuple, graph.depths(e, starts, most, small).collect())) == sorted(map(tuple, graph.depths(e, starts, most).collect()))
        assert sorted(map(tuple, graph.levels(v, e, small).collect())) == sorted(map(tuple, graph.levels(v, e).collect()))
    assert graph.depths(e, starts, 2).count() < graph.depths(e, starts).count()
