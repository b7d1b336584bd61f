"""Near duplicates by the Jaccard similarity of word shingles: MinHash bands and SimHash links propose, whole shingle sets decide."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import components, staged, text_or_empty, workers_can_import

WORDS = 5
SIMILARITY = 0.8
#: At a similarity of s a pair shares a band with probability 1 - (1 - s ** WIDTH) ** BANDS: 0.99997 at 0.8.
BANDS, WIDTH = 20, 4

_SEED = 42
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_RNG = np.random.default_rng(_SEED)
_TIMES = _RNG.integers(0, 1 << 63, (BANDS * WIDTH, 1), np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RNG.integers(0, 1 << 63, (BANDS * WIDTH, 1), np.uint64)
_FOLD = _RNG.integers(0, 1 << 63, WIDTH, np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """The distinct XXH64 values, in order, of the shingles of UTF-8 ``text``; fewer words make one shingle, none make none."""
    from xxhash import xxh64_intdigest

    tokens = text.translate(_LOWER).split()  # bytes.split() cuts at exactly 0x20 and 0x09-0x0D
    if not tokens:
        return np.empty(0, np.uint64)
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(words, len(tokens))
    spans = zip(starts[: len(starts) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    return np.unique(np.array([xxh64_intdigest(joined[a:b], _SEED) for a, b in spans], np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The 64-bit SimHash of hashes: a bit is 1 if it is in over half of them; 0 of none."""
    n = len(hashes)
    if not n:
        return 0
    lanes = hashes.view(np.uint8).reshape(n, 8)
    if n < 2000:
        ones = np.unpackbits(lanes, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    else:
        ones = np.concatenate([np.bincount(lanes[:, i], minlength=256) @ _BITS for i in range(8)])
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def bands(values: np.ndarray) -> np.ndarray:
    """A key for each band of the MinHash of a set; none for the empty set."""
    if not len(values):
        return np.empty(0, np.uint64)
    least = np.full(BANDS * WIDTH, np.iinfo(np.uint64).max)
    for at in range(0, len(values), 4096):
        np.minimum(least, (values[at : at + 4096] * _TIMES + _PLUS).min(axis=1), out=least)
    return (least.reshape(BANDS, WIDTH) * _FOLD).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)


def _sketches(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in batches:
            ids, keys, sims = [], [], []
            for text in batch.column(2).to_pylist():
                values = shingles(text, words)
                ids.append(xxh64_intdigest(values.tobytes(), _SEED))
                keys.append(bands(values).view(np.int64))
                sims.append(majority(values))
            fp = np.array(ids, np.uint64).view(np.int64)
            offsets = np.concatenate(([0], np.cumsum([len(k) for k in keys]))).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(keys) if keys else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp), listed, pa.array(np.array(sims, np.uint64).view(np.int64))], ["doc_id", "salt", "fp", "keys", "sim"])

    return run


def _runs(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[list, ...]]:
    """The columns of each run of an equal first column of sorted batches, of two rows or more."""
    held: list[list] = [[] for _ in range(width)]
    for batch in batches:
        if not batch.num_rows:
            continue
        cell = batch.column(0).to_numpy()
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(cell)) + 1, [len(cell)])).tolist()
        columns = [batch.column(i).to_pylist() for i in range(width)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if held[0] and held[0][0] != columns[0][a]:
                if len(held[0]) > 1:
                    yield tuple(held)
                held = [[] for _ in range(width)]
            if b < len(cell) and b - a == 1 and not held[0]:
                continue
            for have, new in zip(held, columns, strict=True):
                have += new[a:b]
    if len(held[0]) > 1:
        yield tuple(held)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bands that two or more sets share, named by their members, so that bands of the same members are one."""
    from xxhash import xxh64_intdigest

    cells, fps = [], []

    def out():
        return pa.RecordBatch.from_arrays([pa.array(np.array(cells, np.uint64).view(np.int64)), pa.array(fps, pa.int64())], ["cell", "fp"])

    for _, fp in _runs(batches, 2):
        name = xxh64_intdigest(np.sort(np.array(fp, np.int64)).tobytes(), _SEED)
        cells += [name] * len(fp)
        fps += fp
        if len(fps) > 20_000:
            yield out()
            cells, fps = [], []
    yield out()


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [shingles(t, words).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.binary())], ["fp", "shingles"])

    return run


def alike(sets: list[np.ndarray], similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """Links that connect exactly what is connected by pairs of ``similarity`` or more, breadth first.

    Each set is compared with those not reached yet, by its values marked in one array of all values.
    """
    size = np.array([len(s) for s in sets])
    values, at = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate(([0], np.cumsum(size)[:-1]))
    mark = np.zeros(len(values), bool)
    reached = np.zeros(len(sets), bool)
    links = []
    for root in range(len(sets)):
        if reached[root]:
            continue
        reached[root] = True
        queue = [root]
        while queue and not reached.all():
            x = queue.pop()
            mine = at[starts[x] : starts[x] + size[x]]
            mark[mine] = True
            both = np.add.reduceat(mark[at], starts, dtype=np.int64)
            mark[mine] = False
            hit = np.flatnonzero(~reached & (both >= similarity * (size + size[x] - both) - 1e-9)).tolist()
            reached[hit] = True
            queue += hit
            links += [(x, y) for y in hit]
    return links


def _links(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, fp, values in _runs(batches, 3):
            found = alike([np.frombuffer(v, np.uint64) for v in values], similarity)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([fp[x] for x, _ in found], pa.int64()), pa.array([fp[y] for _, y in found], pa.int64())], ["a", "b"])

    return run


def similar_groups(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, near: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """One row a document: ``doc_id, salt, fp, lead``, the (doc_id, salt) that stays of its group.

    Words are what ASCII white space separates, A-Z lower-cased; a document is the set of its
    shingles of ``words`` words, and fewer words make one shingle. Documents link at a Jaccard
    similarity of ``similarity`` or more; a group is what links connect, its lead the smallest doc_id, null
    ids last. Texts without words are alike. ``fp`` tells sets apart: equal sets are compared once.

    Bands of a MinHash propose pairs, and so does ``near``, links ``(a, b)`` among SimHash fingerprints ``(fp)`` of the sets;
    a pair that neither proposes is the only way to miss a link. Shingle sets
    travel only for documents that share a band, to each distinct set of members once, and for pairs of ``near`` that bands left apart.
    """
    workers_can_import(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text_or_empty("text")).alias("salt"), F.encode(text_or_empty("text"), "UTF-8").alias("text"))
    rows = staged(texts.mapInArrow(_sketches(words), "doc_id bigint, salt bigint, fp bigint, keys array<bigint>, sim bigint"), "sketches")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "salt"))
    distinct = staged(rows.groupBy("fp").agg(first.alias("first"), F.first("keys").alias("keys"), F.first("sim").alias("sim")), "distinct")

    def linked(cells: DataFrame) -> DataFrame:
        """Links of at least ``similarity`` within each cell of ``(cell, fp)``."""
        wanted = distinct.join(cells.select("fp").distinct(), "fp").select("fp", F.struct("first.doc_id", "first.salt").alias("key"))
        # one document of each set; rows repeated with that id and text give the set again
        found = texts.select(F.struct("doc_id", "salt").alias("__key"), "text").join(wanted, F.col("__key").eqNullSafe(F.col("key"))).select("fp", "text")
        sets = staged(found.mapInArrow(_sets(words), "fp bigint, shingles binary").dropDuplicates(["fp"]), "sets")
        full = cells.join(sets, "fp").select("cell", "fp", "shingles").repartition("cell").sortWithinPartitions("cell")
        return staged(full.mapInArrow(_links(similarity), "a bigint, b bigint"), "links")

    cells = distinct.select(F.explode("keys").alias("cell"), "fp").repartition("cell").sortWithinPartitions("cell")
    roots = components(linked(staged(cells.mapInArrow(_shared, "cell bigint, fp bigint").distinct(), "shared")))
    labelled = staged(distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "sim", "first", F.coalesce("root", "fp").alias("label")), "labelled")
    if near is not None:
        apart = staged(_apart(labelled, near(labelled.select(F.col("sim").alias("fp")).distinct())), "apart")
        if not apart.isEmpty():
            labels = labelled.select("fp", "label")
            ends = linked(apart).join(labels.toDF("a", "x"), "a").join(labels.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
            joined = components(staged(ends, "links"))
            labelled = staged(labelled.join(joined, labelled["label"] == joined["node"], "left").select("fp", "first", F.coalesce("root", "label").alias("label")), "labelled")
    leads = labelled.groupBy("label").agg(F.min("first").alias("lead"))
    named = staged(labelled.join(leads, "label").select("fp", F.struct("lead.doc_id", "lead.salt").alias("lead")), "named")
    return rows.join(named, "fp").select("doc_id", "salt", "fp", "lead")


def _apart(labelled: DataFrame, links: DataFrame) -> DataFrame:
    """``(cell, fp)``: two sets a cell, each pair whose fingerprints are equal or linked and whose groups differ."""
    spread = staged(labelled.groupBy("sim").agg(F.min("label").alias("low"), F.max("label").alias("high")), "spread")
    links = links.union(spread.where("low <> high").select(F.col("sim").alias("a"), F.col("sim").alias("b")))
    # fingerprints of one group only are dropped before their sets are listed
    both = links.join(spread.toDF("a", "la", "ha"), "a").join(spread.toDF("b", "lb", "hb"), "b").where("NOT (la = ha AND lb = hb AND la = lb)").select("a", "b").distinct()
    x, y = (labelled.select(F.col("sim").alias(s), F.col("fp").alias(f"fp_{s}"), F.col("label").alias(f"label_{s}")) for s in "ab")
    pairs = both.join(x, "a").join(y, "b").where("label_a <> label_b").select(F.array_sort(F.array("fp_a", "fp_b")).alias("pair")).distinct()
    return pairs.select(F.xxhash64("pair").alias("cell"), F.explode("pair").alias("fp"))
