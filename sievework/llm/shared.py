"""Helpers that several corpus operators use: shared scratch tables, ranks, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.session import Staged, delete_path, scratch_root, staged, workers_can_import

__all__ = ["Staged", "components", "delete_path", "hash_key", "let", "lower_ascii", "prefix_scan", "ranked", "scratch_root", "staged", "text_or_empty", "workers_can_import"]


def text_or_empty(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def let(value: str, name: str, body: str) -> str:
    """SQL text: ``body``, in which ``name`` is ``value``, worked out once a row however often it is used."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def prefix_scan(values: str, merge: str = "({0} + {1})", block: int = 256) -> str:
    """SQL text: for each element of an array of numbers, ``merge`` of all before it, 0 for the first; ``merge`` is associative and 0 neutral.

    A fold that appends copies what it has at each step; folding blocks of ``block`` elements, and their totals, keeps that from
    growing with the square of the array. It is text, as long expressions are built many times faster so than call by call.
    """

    def running(numbers: str, start: str) -> str:
        step = f"(_a, _x) -> struct({merge.format('_a.at', '_x')} AS at, concat(_a.out, array(_a.at)) AS out)"
        return f"aggregate({numbers}, struct(CAST({start} AS BIGINT) AS at, CAST(array() AS ARRAY<BIGINT>) AS out), {step}, _a -> _a.out)"

    totals = f"transform(_bs, _b -> aggregate(_b, 0L, (_a, _x) -> {merge.format('_a', '_x')}))"
    folded = f"flatten(zip_with(_bs, {running(totals, '0')}, (_b, _s) -> {running('_b', '_s')}))"
    blocks = f"transform(sequence(0, CAST(floor((size(_n) - 1) / {block}) AS INT)), _i -> slice(_n, _i * {block} + 1, {block}))"
    return let(f"transform({values}, _v -> CAST(_v AS BIGINT))", "_n", f"CASE WHEN size(_n) > 0 THEN {let(blocks, '_bs', folded)} ELSE CAST(array() AS ARRAY<BIGINT>) END")


def hash_key(*columns: str | Column) -> Column:
    """A fixed-width hexadecimal hash of the columns, whose text order is the order that ``ranked`` gives rows."""
    return F.lpad(F.hex(F.xxhash64(*columns)), 16, "0")


def ranked(df: DataFrame, groups: list[str], cells: list[str], key: str, order: list[str], rows: int, cell_rows: int = 50_000, slim: DataFrame | None = None) -> DataFrame:
    """Add ``pos``, each row's position from 1 within its group, without a task that holds a whole group.

    Rows of a group stand in order of ``cells``, then of ``key`` (a hexadecimal hash of fixed width), then of
    ``order``; that depends on the rows alone. The session's shuffle partitions and the number of rows decide only how finely the order is cut into
    ranges of the key, of about ``cell_rows`` rows or fewer: a row's position is its rank within its
    range plus the rows of the ranges before it. So a group with a third of all rows is many tasks' work. Ranges are
    summed within a cell first and cells within a group after, so neither window holds more than one of the two.
    ``slim`` has the columns of groups, cells and key of the same rows, stored, if reading ``df`` twice is dear.

    A range's name is one struct: unlike several nullable columns it is never null, so that the
    window and the join agree on how rows are dealt and ``df`` is shuffled once. Rows alike in key and
    all of ``order`` share a range; they are read as a stream, not held.
    """
    bits = min(32, (max(-(-rows // cell_rows), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))) - 1).bit_length())
    cut = F.shiftright(F.conv(F.substring(key, 1, 8), 16, 10).cast("bigint"), 32 - bits)
    mark = lambda t: t.withColumn("__cell", F.struct(F.struct(*groups, *cells).alias("bin"), cut.alias("cut")))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    counts = mark(df if slim is None else slim).groupBy("__cell").agg(F.count(F.lit(1)).alias("__n")).select("__cell", "__n", F.col("__cell.bin").alias("__bin"))
    inside = counts.withColumn("__in", F.coalesce(F.sum("__n").over(before(Window.partitionBy("__bin").orderBy(F.col("__cell.cut")))), F.lit(0)))
    if cells:
        bins = counts.groupBy("__bin").agg(F.sum("__n").alias("__n"))
        per = before(Window.partitionBy(F.struct(*[F.col("__bin")[g].alias(g) for g in groups])).orderBy(*[F.col("__bin")[c] for c in cells]))
        bins = bins.select(F.col("__bin").alias("__which"), F.coalesce(F.sum("__n").over(per), F.lit(0)).alias("__to"))
        inside = inside.join(bins, F.col("__bin") == F.col("__which")).withColumn("__in", F.col("__in") + F.col("__to"))
    offsets = inside.select(F.col("__cell").alias("__key"), F.col("__in").alias("__before"))
    placed = mark(df).withColumn("__r", F.row_number().over(Window.partitionBy("__cell").orderBy(key, *order)))
    joined = placed.join(offsets, F.col("__cell") == F.col("__key"))
    return joined.withColumn("pos", F.col("__before") + F.col("__r")).drop("__cell", "__key", "__r", "__before")


def components(edges: DataFrame) -> DataFrame:
    """The smallest node that each node of ``edges(a, b)`` can reach: ``(node, root)``.

    Alternates the large-star and small-star steps of Kiveris et al. (2014): each
    round links every node to the smallest of its neighbourhood, which shrinks depth
    geometrically while the number of edges never grows. Each round is a table in the
    shared folder, so a lost executor costs one round at most. It ends when a round changes nothing, as it
    does after O(log^2 n) rounds. Nodes without edges are absent.
    """
    ordered = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = Staged(ordered, "edges")
    last = None
    while True:
        e = now.read()
        both = e.union(e.select(F.col("b"), F.col("a")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        step = Staged(large, "large")
        e = step.read()
        least = e.groupBy("a").agg(F.min("b").alias("m"))
        linked = e.join(least, "a")
        small = linked.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).distinct()
        after = Staged(small, "small")
        sums = lambda t: t.read().agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        seen, was = tuple(sums(after)), last or tuple(sums(now))
        now.drop()
        step.drop()
        now, last = after, seen
        if seen == was:
            break
    e = now.read()
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select("b", "b").distinct())
