"""Call graphs as two tables: ``vertices(binary_id, name)`` and distinct ``edges(binary_id, src, dst)`` without self-edges.

All operators work on all binaries at once and join on (binary_id, name). A binary of at most ``SMALL``
edges is walked as a whole within one task, all such binaries side by side. For larger ones a traversal
is a loop over frontiers on the driver; what each round finds is a table in the shared folder, so a
round reads stored rows and a lost executor costs one round at most.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievework.session import Staged, staged

KEY = ["binary_id", "name"]
#: Edges of a binary that one task walks: some 300 MB of names at this many.
SMALL = 500_000


def _by_size(edges: DataFrame, small: int) -> DataFrame:
    """The binaries of more than ``small`` edges."""
    return staged(edges.groupBy("binary_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > small).select("binary_id"), "large")


def _walked(edges: DataFrame, nodes: DataFrame, walk, column: str) -> DataFrame:
    """``(binary_id, name, column)`` of each binary by ``walk(marked, src, dst)``, which returns a number a name, below 0 for no row.

    ``nodes(binary_id, name)`` are marked; ``src`` and ``dst`` are places of names.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        codes, names = pd.factorize(pd.concat([pdf["src"], pdf["dst"]], ignore_index=True))  # -1 for a node's missing dst
        src, dst = codes[: len(pdf)], codes[len(pdf) :]
        marked = np.zeros(len(names), bool)
        marked[src[dst < 0]] = True
        got = walk(marked, src[dst >= 0], dst[dst >= 0])
        keep = np.flatnonzero(got >= 0)
        return pd.DataFrame({"binary_id": pdf["binary_id"].iloc[0], "name": names.to_numpy(dtype=object)[keep], column: got[keep].astype(np.int32)})

    every = edges.select("binary_id", "src", "dst").union(nodes.select("binary_id", F.col("name"), F.lit(None).cast("string")))
    return every.groupBy("binary_id").applyInPandas(run, f"binary_id string, name string, {column} int")


def _grouped(n: int, key: np.ndarray, value: np.ndarray):
    """A function from places to the values of the pairs with such a key."""
    order = np.argsort(key, kind="stable")
    value, starts = value[order], np.searchsorted(key[order], np.arange(n + 1))

    def of(at: np.ndarray) -> np.ndarray:
        low, size = starts[at], starts[at + 1] - starts[at]
        return value[np.repeat(low - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())] if len(at) else value[:0]

    return of


def _hops(most: int | None):
    def walk(marked: np.ndarray, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
        depth = np.where(marked, 0, -1)
        callees, now, at = _grouped(len(marked), src, dst), np.flatnonzero(marked), 0
        while len(now) and (most is None or at < most):
            at += 1
            found = np.unique(callees(now))
            now = found[depth[found] < 0]
            depth[now] = at
        return depth

    return walk


def _heights(marked: np.ndarray, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    inside = marked[src] & marked[dst]
    src, dst = src[inside], dst[inside]
    open_callees, level = np.bincount(src, minlength=len(marked)), np.full(len(marked), -1)
    callers_of, now, at = _grouped(len(marked), dst, src), np.flatnonzero(marked & (open_callees == 0)), 0
    while len(now):
        level[now] = at
        at += 1
        touched, times = np.unique(callers_of(now), return_counts=True)
        open_callees[touched] -= times
        now = touched[open_callees[touched] == 0]
    return level


def graph_edges(calls: DataFrame, vertices: DataFrame) -> DataFrame:
    """Distinct edges between known vertices, self-edges dropped, from ``calls(binary_id, src, dst)``."""
    src = vertices.select("binary_id", F.col("name").alias("src"))
    dst = vertices.select("binary_id", F.col("name").alias("dst"))
    kept = calls.where("src <> dst").select("binary_id", "src", "dst").distinct()
    return kept.join(src, ["binary_id", "src"], "left_semi").join(dst, ["binary_id", "dst"], "left_semi").select("binary_id", "src", "dst")


def callers(edges: DataFrame) -> DataFrame:
    """Reverse edges: ``(binary_id, name, caller)``."""
    return edges.select("binary_id", F.col("dst").alias("name"), F.col("src").alias("caller"))


def degrees(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """``callees`` and ``callers`` of every vertex, 0 where there are none; one shuffle of the edges."""
    ends = edges.select("binary_id", F.explode(F.array(F.struct(F.col("src").alias("name"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("name"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e")).select("binary_id", "e.*")
    every = ends.union(vertices.select("binary_id", "name", F.lit(0), F.lit(0)))
    return every.groupBy(KEY).agg(F.sum("o").cast("bigint").alias("callees"), F.sum("i").cast("bigint").alias("callers"))


def roots(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Vertices that nothing calls."""
    return vertices.select(KEY).join(edges.select("binary_id", F.col("dst").alias("name")), KEY, "left_anti")


def depths(edges: DataFrame, starts: DataFrame, most: int | None = None, small: int = SMALL) -> DataFrame:
    """Least hops from any of ``starts(binary_id, name)``: ``(binary_id, name, depth)``; what is not reached has no row.

    ``most`` bounds the depth that is explored, which also bounds the work.
    """
    large = _by_size(edges, small)
    near = staged(_walked(edges.join(large, "binary_id", "left_anti"), starts.select(KEY).distinct().join(large, "binary_id", "left_anti"), _hops(most), "depth"), "depth")
    if large.isEmpty():
        return near
    return near.union(_depths_by_rounds(edges.join(large, "binary_id", "left_semi"), starts.join(large, "binary_id", "left_semi"), most))


def _depths_by_rounds(edges: DataFrame, starts: DataFrame, most: int | None) -> DataFrame:
    seen = [Staged(starts.select(KEY).distinct().withColumn("depth", F.lit(0)), "depth")]
    while most is None or len(seen) <= most:
        found = seen[0].read()
        for t in seen[1:]:
            found = found.union(t.read())
        step = _step(seen[-1].read(), edges)
        fresh = step.distinct().join(found.select(KEY), KEY, "left_anti").withColumn("depth", F.lit(len(seen)))
        table = Staged(fresh, "depth")
        if table.read().isEmpty():
            table.drop()
            break
        seen.append(table)
    out = seen[0].read()
    for t in seen[1:]:
        out = out.union(t.read())
    return out


def _step(frontier: DataFrame, edges: DataFrame) -> DataFrame:
    at = frontier.select("binary_id", F.col("name").alias("src"))
    return edges.join(at, ["binary_id", "src"]).select("binary_id", F.col("dst").alias("name"))


def reachable(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """``(binary_id, name)`` reachable from ``starts``, which are included."""
    return depths(edges, starts).select(KEY)


def closure(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """``(binary_id, start, name)`` for each start on its own, the start included.

    Quadratic in the worst case: it is meant for roots or a filtered subset, never for all pairs.
    """
    seen = [Staged(starts.select("binary_id", F.col("name").alias("start"), "name").distinct(), "closure")]
    while True:
        found = seen[0].read()
        for t in seen[1:]:
            found = found.union(t.read())
        at = seen[-1].read().select("binary_id", "start", F.col("name").alias("src"))
        step = edges.join(at, ["binary_id", "src"]).select("binary_id", "start", F.col("dst").alias("name")).distinct()
        fresh = Staged(step.join(found, ["binary_id", "start", "name"], "left_anti"), "closure")
        if fresh.read().isEmpty():
            fresh.drop()
            return found
        seen.append(fresh)


def reach_sizes(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """``(binary_id, name, reach)`` of every root."""
    return closure(edges, roots(vertices, edges)).groupBy("binary_id", F.col("start").alias("name")).agg(F.count(F.lit(1)).alias("reach"))


def primary_entry(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Each binary's root with the largest reach, ties to the greatest name; no row without a root."""
    return reach_sizes(vertices, edges).groupBy("binary_id").agg(F.max(F.struct("reach", "name")).alias("best")).select("binary_id", "best.name", "best.reach")


def entry_points(vertices: DataFrame, edges: DataFrame, exported: DataFrame | None = None, dominance: float = 0.5) -> DataFrame:
    """Where each binary is entered: its exported functions if any is known, else the root that reaches at least
    ``dominance`` of it, else all roots. A binary without a root has no entry, exported or not."""
    sizes = staged(reach_sizes(vertices, edges), "reach")
    best = sizes.groupBy("binary_id").agg(F.max(F.struct("reach", "name")).alias("best"))
    total = vertices.groupBy("binary_id").agg(F.count(F.lit(1)).alias("n"))
    plan = best.join(total, "binary_id").select("binary_id", F.col("best.name").alias("main"), (F.col("best.reach") >= dominance * F.col("n")).alias("dominant"))
    chosen = sizes.join(plan, "binary_id").where("NOT dominant OR name = main").select(KEY)
    if exported is None:
        return chosen
    named = vertices.select(KEY).join(exported.select(KEY), KEY, "left_semi").join(best.select("binary_id"), "binary_id", "left_semi")
    return named.union(chosen.join(named.select("binary_id").distinct(), "binary_id", "left_anti"))


def levels(vertices: DataFrame, edges: DataFrame, small: int = SMALL) -> DataFrame:
    """Dependency level of each vertex of an acyclic graph: 0 without callees, else one above its highest callee.

    Each round takes the vertices all of whose callees are done. On a cycle no round ends it:
    those vertices have no row; ``levels_any`` takes such binaries to the exact walk.
    """
    large = _by_size(edges, small)
    low = staged(_walked(edges.join(large, "binary_id", "left_anti"), vertices.select(KEY).distinct().join(large, "binary_id", "left_anti"), _heights, "level"), "level")
    if large.isEmpty():
        return low
    return low.union(_levels_by_rounds(vertices.join(large, "binary_id", "left_semi"), edges.join(large, "binary_id", "left_semi")))


def _levels_by_rounds(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    left = Staged(vertices.select(KEY).distinct(), "left")
    tables: list[Staged] = []
    while True:
        todo = left.read()
        open_callee = edges.join(todo.select("binary_id", F.col("name").alias("dst")), ["binary_id", "dst"], "left_semi").select("binary_id", F.col("src").alias("name"))
        ready = Staged(todo.join(open_callee, KEY, "left_anti").withColumn("level", F.lit(len(tables))), "level")
        if ready.read().isEmpty():
            ready.drop()
            break
        rest = Staged(todo.join(ready.read(), KEY, "left_anti"), "left")
        left.drop()
        left = rest
        tables.append(ready)
    out = vertices.select(KEY).where("false").withColumn("level", F.lit(0))
    for t in tables:
        out = out.union(t.read())
    return out


def levels_subset(vertices: DataFrame, edges: DataFrame, subset: DataFrame) -> DataFrame:
    """Levels over ``subset`` alone: one member comes after another only if it reaches it, through any vertices."""
    members = staged(subset.select(KEY).join(vertices.select(KEY), KEY, "left_semi").distinct(), "members")
    pairs = closure(edges, members).where("start <> name")
    inside = pairs.join(members, KEY, "left_semi").select("binary_id", F.col("start").alias("src"), F.col("name").alias("dst"))
    return levels(members, staged(inside, "inside"))


def rounds(leveled: DataFrame, workers: int) -> DataFrame:
    """How many rounds a batch takes: per binary the sum over levels of ceil(size / workers)."""
    sizes = leveled.groupBy("binary_id", "level").agg(F.count(F.lit(1)).alias("size"))
    return sizes.groupBy("binary_id").agg(F.count(F.lit(1)).alias("levels"), F.sum(F.ceil(F.col("size") / workers)).cast("bigint").alias("rounds"))


def _post_order(nodes: list[str], callees: dict[str, list[str]]) -> Iterator[str]:
    state: dict[str, int] = {}
    for start in nodes:
        if start in state:
            continue
        path = [(start, iter(callees.get(start, ())))]
        state[start] = 1
        while path:
            node, rest = path[-1]
            following = next((c for c in rest if c not in state), None)
            if following is None:
                path.pop()
                yield node
            else:
                state[following] = 1
                path.append((following, iter(callees.get(following, ()))))


def ordered(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """``(binary_id, name, pos, level)``: leaves first, cycles cut where the walk closes them.

    ``vertices`` may have ``priority``: among functions without a constraint between them, higher ones come
    first, then names in order. Cutting cycles depends on the walk, so each binary's graph is
    walked in one task; a binary's functions number in the thousands. A level is one above the
    highest of the callees already placed.
    """
    nodes = vertices.select("binary_id", "name", F.col("priority").cast("double").alias("priority") if "priority" in vertices.columns else F.lit(0.0).alias("priority"))
    lists = edges.groupBy("binary_id", F.col("src").alias("name")).agg(F.collect_list("dst").alias("callees"))
    rows = nodes.join(lists, KEY, "left")

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["priority", "name"], ascending=[False, True])
        rank = {n: i for i, n in enumerate(pdf["name"])}
        callees = {n: sorted((c for c in (cs if cs is not None else ()) if c in rank), key=rank.get) for n, cs in zip(pdf["name"], pdf["callees"], strict=True)}
        level: dict[str, int] = {}
        for n in _post_order(list(rank), callees):
            level[n] = 1 + max((level[c] for c in callees[n] if c in level), default=-1)
        return pd.DataFrame({"binary_id": pdf["binary_id"].iloc[0], "name": list(level), "pos": range(len(level)), "level": list(level.values())})

    return rows.groupBy("binary_id").applyInPandas(walk, "binary_id string, name string, pos int, level int")


def levels_any(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Levels of any graph: by rounds where a binary has no cycle, by the exact walk where it has one."""
    easy = staged(levels(vertices, edges), "levels")
    missing = vertices.select(KEY).join(easy, KEY, "left_anti").select("binary_id").distinct()
    cyclic = staged(missing, "cyclic")
    hard = ordered(vertices.join(cyclic, "binary_id", "left_semi"), edges.join(cyclic, "binary_id", "left_semi"))
    return easy.join(cyclic, "binary_id", "left_anti").union(hard.select(*KEY, "level"))


def limited(leveled: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` rows of each binary in order of (level, pos): a budget that runs across levels."""
    order = Window.partitionBy("binary_id").orderBy("level", "pos")
    return leveled.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= limit)


def starts_from(spark, binary_id: str, names: Iterable[str]) -> DataFrame:
    return spark.createDataFrame([(binary_id, n) for n in names], "binary_id string, name string")
