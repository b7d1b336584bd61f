"""SimHash near duplicates joined on a grid of per-segment bit counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .minhash import SIMILARITY, WORDS, majority, similar_groups
from .shared import Staged, components, staged, text_or_empty, workers_can_import

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_SEED = 42
_RADIUS = 3
_DENSE = 64


def fingerprint(text: bytes, words: int = 3) -> int:
    """The 64-bit SimHash of UTF-8 ``text``: each bit is the majority of its shingles' XXH64 bits."""
    from xxhash import xxh64_intdigest

    tokens = text.translate(_LOWER).split()  # bytes.split() cuts at exactly 0x20 and 0x09-0x0D
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(words, len(tokens))
    spans = zip(starts[: len(starts) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    hashes = np.array([xxh64_intdigest(joined[a:b], _SEED) for a, b in spans], np.uint64)
    return majority(hashes)


def _fingerprints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, words) for t in batch.column(2).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps)], ["doc_id", "salt", "fp"])

    return run


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """``(doc_id, salt, fp)`` of every document; ``salt`` tells apart texts that share an id."""
    workers_can_import(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text_or_empty("text")).alias("salt"), F.encode(text_or_empty("text"), "UTF-8").alias("text"))
    return rows.mapInArrow(_fingerprints(words), "doc_id bigint, salt bigint, fp bigint")


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each fingerprint at its own grid cells and, as a probe, one step up along each axis.

    The embedding has 32 segments of two bits; a segment's coordinate is its bit count, 0
    to 2. Two fingerprints that differ in d bits are at most d apart in Manhattan distance. With
    d at most 3, one of the two halves of 16 axes is at most 1 apart, so the pair shares that
    half's cell or one of them reaches the other's cell by one step up.
    """
    for batch in batches:
        fps = batch.column(0).to_numpy().view(np.uint64)
        n = len(fps)
        for half in (0, 1):
            bits = (fps >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)
            cell = (bits - ((bits >> np.uint64(1)) & np.uint64(0x55555555))).astype(np.int64)
            keys, who, owns = [cell], [fps], [np.ones(n, bool)]
            for axis in range(16):
                up = ((cell >> (2 * axis)) & 3) < 2
                keys.append(cell[up] + (1 << (2 * axis)))
                who.append(fps[up])
                owns.append(np.zeros(int(up.sum()), bool))
            key = np.concatenate(keys) | (half << 32)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.concatenate(who).view(np.int64)), pa.array(np.concatenate(owns))], ["cell", "fp", "own"])


def _near(cell: np.ndarray, fp: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of at most 3 bits within each run of equal ``cell``, enough of them to connect all that are linked."""
    cut = np.flatnonzero(np.diff(cell)) + 1
    starts, ends = np.concatenate(([0], cut)), np.concatenate((cut, [len(cell)]))
    owners = np.add.reduceat(own.astype(np.int64), starts)
    size = ends - starts
    live = (owners > 0) & (size > 1)
    left, right = [], []
    small = np.repeat(live & (size <= _DENSE), size)
    c, f, o = cell[small], fp[small], own[small]
    for shift in range(1, _DENSE):
        if shift >= len(c):
            break
        same = c[shift:] == c[:-shift]
        if not same.any():
            break
        i = np.flatnonzero(same & (o[shift:] | o[:-shift]))
        i = i[np.bitwise_count(f[i] ^ f[i + shift]) <= _RADIUS]
        left.append(f[i])
        right.append(f[i + shift])
    for a, b in zip(starts[live & (size > _DENSE)], ends[live & (size > _DENSE)], strict=True):
        for x, y in _search(fp[a:b], own[a:b]):
            left.append(x)
            right.append(y)
    if not left:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    return np.concatenate(left), np.concatenate(right)


def _search(fp: np.ndarray, own: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Breadth-first over one crowded cell: each fingerprint is compared with those not yet reached only.

    A close group is reached within a few steps, so its cost is not the square of its size, and
    links are one for each fingerprint reached. Pairs of probes are left to their own cells.
    """
    reached = np.zeros(len(fp), bool)
    for root in np.flatnonzero(own):
        if reached[root]:
            continue
        reached[root] = True
        queue = [root]
        while queue:
            at = queue.pop()
            rest = np.flatnonzero(~reached & (own | own[at]))
            hit = rest[np.bitwise_count(fp[rest] ^ fp[at]) <= _RADIUS]
            if len(hit):
                reached[hit] = True
                queue.extend(hit.tolist())
                yield np.full(len(hit), fp[at]), fp[hit]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams cells in order; only the cell that a batch ends in is held over."""
    held: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def out(cell, fp, own):
        a, b = _near(cell, fp, own)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    for batch in batches:
        cell, fp, own = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy(zero_copy_only=False)
        if held is not None:
            cell, fp, own = (np.concatenate(x) for x in zip(held, (cell, fp, own), strict=True))
        whole = int(np.searchsorted(cell, cell[-1])) if len(cell) else 0
        if whole:
            yield out(cell[:whole], fp[:whole], own[:whole])
        held = (cell[whole:], fp[whole:], own[whole:])
    if held is not None and len(held[0]):
        yield out(*held)


def near_links(distinct: DataFrame) -> DataFrame:
    """Links ``(a, b)`` among distinct fingerprints ``(fp)`` that connect exactly what differs in at most 3 bits."""
    workers_can_import(distinct.sparkSession)
    cells = distinct.select("fp").mapInArrow(_cells, "cell bigint, fp bigint, own boolean")
    return cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(_links, "a bigint, b bigint")


def simhash_groups(docs: DataFrame, words: int = 3) -> DataFrame:
    """One row a document: ``doc_id, salt, fp, component_id, lead``.

    Words are what ASCII white space separates, A-Z lower-cased; a fingerprint bit is the
    strict majority over all shingles of ``words`` words, repeats included. Fewer words make one
    shingle; none, or a null text, gives fingerprint zero, which links like any other. Two
    fingerprints link at 3 or fewer differing bits and ``component_id`` is the smallest
    doc_id reachable; null ids never name a component, unless it has no other. ``lead`` is the
    (doc_id, salt) that stays. Repeated rows are alike. An empty table gives no rows.

    Only distinct fingerprints are compared, so copies cost nothing; the joins back to
    documents are between plain tables, where adaptive execution splits a hot fingerprint.
    """
    rows = staged(fingerprints(docs, words), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "salt"))
    distinct = staged(rows.groupBy("fp").agg(first.alias("first")), "distinct")
    edges = Staged(near_links(distinct), "links")
    roots = components(edges.read())
    labelled = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("label"))
    labelled = Staged(labelled, "labelled")
    leads = labelled.read().groupBy("label").agg(F.min("first").alias("lead"))
    named = staged(labelled.read().join(leads, "label").select("fp", F.col("lead.doc_id").alias("component_id"), F.struct("lead.doc_id", "lead.salt").alias("lead")), "named")
    return rows.join(named, "fp").select("doc_id", "salt", "fp", "component_id", "lead")


def drop_near(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one document of each group of near duplicates, all columns kept.

    Near is a Jaccard similarity of ``similarity`` or more of shingles of ``words`` words, see
    ``minhash.similar_groups``: the grid join proposes what differs in at most 3 bits, MinHash bands what lies
    farther apart, and whole sets decide. The 3 words of ``simhash_groups`` are the contract of op8 alone.
    The smallest doc_id of the group stays. Of rows repeated with that id and text one stays.
    """
    found = similar_groups(docs, words, similarity, near_links)
    mine = F.struct("doc_id", "salt")
    gone = staged(found.where(mine != F.col("lead")).select(mine.alias("__gone")), "gone")
    whole = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), F.struct(docs["doc_id"].cast("bigint").alias("doc_id"), F.xxhash64(text_or_empty(docs["text"])).alias("salt")).alias("__key"))
    stay = whole.join(gone, F.col("__key") == F.col("__gone"), "left_anti")
    first = F.row_number().over(Window.partitionBy("__key").orderBy(F.xxhash64("row")))
    return stay.withColumn("__n", first).where("__n = 1").select("row.*")


def op8_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract of op8 over the whole ``documents`` table."""
    found = simhash_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
