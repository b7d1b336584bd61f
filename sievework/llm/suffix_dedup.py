"""Repeated passages by a column-wise, multi-document suffix order.

Which strings may be equal is settled by anchors before anything is sorted. The anchor of a 50-byte window is the
leftmost of its 16-byte grams with the least hash, so equal windows have equal anchors at equal
distances. Windows that share an anchor form a segment, of 84 bytes at most. Segments with equal
anchor grams meet in one partition, aligned at their anchors, and there one symbol of each
is inserted a round, from the last column to the first: the order of all suffixes of
the collection is updated from that of the round before, with the column of their preceding
symbols (the Burrows-Wheeler transform of the round) and their common prefixes. As equal windows
start in the same column, suffixes of different columns need not be merged.

Documents lie in chunks of about 4 MB, in a table bucketed by chunk. What chunks and partitions tell each other is
a few bits a gram or window, joined to the chunks without moving their text.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import delete_path, scratch_root, staged, text_or_empty, workers_can_import

SPAN = 50
GRAM = 16
REACH = SPAN - GRAM  # the farthest an anchor lies behind the start of its window
COLUMNS = REACH + SPAN
CHUNK_BYTES = 4 << 20
_NULL_ID = np.iinfo(np.int64).min
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def _stir(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _MIX
    return h ^ (h >> np.uint64(32))


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    h, n, power = data.astype(np.uint64) + np.uint64(1), 1, int(_ODD)
    while n < GRAM:
        h = h[:-n] * np.uint64(power) + h[n:]
        n, power = 2 * n, power * power & 0xFFFFFFFFFFFFFFFF
    return _stir(h)


def segments(data: np.ndarray, offsets: np.ndarray, block: int = 1 << 18) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: ``(first window, anchor - first window, number of windows)``."""
    n = len(data)
    if n < SPAN:
        return np.empty(0, np.int64), np.empty(0, np.uint8), np.empty(0, np.uint8)
    anchor = np.empty(n - SPAN + 1, np.int64)
    for at in range(0, len(anchor), block):
        part = data[at : min(at + block, len(anchor)) + SPAN - 1]
        x = _gram_hashes(part)
        # hash above, place below: the least is the leftmost gram of the least hash
        x = ((x >> np.uint64(31)) << np.uint64(31)) | np.arange(len(x), dtype=np.uint64)
        width, k = REACH + 1, 1
        while 2 * k <= width:
            x = np.minimum(x[:-k], x[k:])
            k *= 2
        if k < width:
            x = np.minimum(x[: len(x) - (width - k)], x[width - k :])
        anchor[at : at + len(x)] = (x & np.uint64(0x7FFFFFFF)).astype(np.int64) + at
    begin, end = offsets[:-1], offsets[1:]
    long = end - begin >= SPAN
    change = np.zeros(n + 1, np.int32)
    np.add.at(change, begin[long], 1)
    np.add.at(change, end[long] - SPAN + 1, -1)
    valid = np.cumsum(change)[: len(anchor)] > 0
    first = valid.copy()
    first[1:] &= (anchor[1:] != anchor[:-1]) | ~valid[:-1]
    starts = np.flatnonzero(first)
    seen = np.cumsum(valid)
    count = np.diff(np.append(seen[starts] - 1, seen[-1] if len(seen) else 0))
    return starts, (anchor[starts] - starts).astype(np.uint8), count.astype(np.uint8)


def gram_keys(data: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    if not len(anchors):
        return np.empty(0, np.uint64)
    pair = np.lib.stride_tricks.sliding_window_view(data, GRAM)[anchors].view("<u8")
    return _stir(_stir(pair[:, 0] * _ODD) + pair[:, 1] * _MIX)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    base, seq = TaskContext.get().partitionId() << 32, 0
    ids: list[int] = []
    texts: list[bytes] = []
    size = 0

    def flush():
        data = np.frombuffer(b"".join(texts), np.uint8)
        offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
        starts, lead, count = segments(data, offsets)
        row = [base + seq, np.array(ids, np.int64).tobytes(), offsets.tobytes(), data.tobytes(), np.diff(starts, prepend=0).astype(np.int32).tobytes(), lead.tobytes(), count.tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int64()), *[pa.array([x], pa.binary()) for x in row[1:]]], ["chunk", "ids", "offsets", "data", "starts", "lead", "count"])

    for batch in batches:
        for doc, text in zip(batch.column(0), batch.column(1), strict=True):
            doc, text = doc.as_py(), text.as_py()
            ids.append(_NULL_ID if doc is None else doc)
            texts.append(text)
            size += len(text)
            if size >= CHUNK_BYTES:
                yield flush()
                ids, texts, size, seq = [], [], 0, seq + 1
    if ids:
        yield flush()


class Chunk:
    """A stored chunk's documents, its segments and their grams, in an order that every pass finds again."""

    def __init__(self, row: dict, parts: int):
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.offsets = np.frombuffer(row["offsets"], np.int64)
        self.data = np.frombuffer(row["data"], np.uint8)
        self.starts = np.cumsum(np.frombuffer(row["starts"], np.int32), dtype=np.int64)
        self.lead = np.frombuffer(row["lead"], np.uint8).astype(np.int64)
        self.count = np.frombuffer(row["count"], np.uint8).astype(np.int64)
        self.doc = np.searchsorted(self.offsets, self.starts, side="right") - 1
        self.key = gram_keys(self.data, self.starts + self.lead)
        self.order = np.argsort(self.key, kind="stable")
        ranked = self.key[self.order]
        new = np.ones(len(ranked), bool)
        new[1:] = ranked[1:] != ranked[:-1]
        self.first = np.flatnonzero(new)
        self.grams = ranked[self.first]
        self.which = np.cumsum(new) - 1
        self.cuts = _cuts(self.grams, parts)

    def shared_here(self) -> np.ndarray:
        if not len(self.first):
            return np.empty(0, bool)
        doc = self.doc[self.order]
        return np.minimum.reduceat(doc, self.first) != np.maximum.reduceat(doc, self.first)

    def rows(self, live: np.ndarray, parts: int):
        """The distinct segments with a live gram: rows of key, first column, windows and bytes; with each one's least id."""
        mine = self.order[live[self.which]] if len(self.which) else self.order
        anchors = self.starts[mine] + self.lead[mine]
        padded = np.concatenate([np.zeros(REACH, np.uint8), self.data, np.zeros(SPAN, np.uint8)])
        table = np.zeros((len(mine), 10 + COLUMNS), np.uint8)
        if len(mine):
            table[:, :8] = self.key[mine].astype(">u8").view(np.uint8).reshape(-1, 8)
            table[:, 8] = REACH - self.lead[mine]
            table[:, 9] = self.count[mine]
            body = np.lib.stride_tricks.sliding_window_view(padded, COLUMNS)[anchors]
            low = (REACH - self.lead[mine])[:, None]
            at = np.arange(COLUMNS)[None, :]
            table[:, 10:] = np.where((at >= low) & (at < low + self.count[mine][:, None] + SPAN - 1), body, 0)
        view = table.view(np.dtype((np.void, table.shape[1]))).ravel()
        _, first, inverse = np.unique(view, return_index=True, return_inverse=True)
        ids = self.ids[self.doc[mine]]
        least = np.full(len(first), np.iinfo(np.int64).max)
        np.minimum.at(least, inverse, ids)
        distinct = table[first]
        keys = distinct[:, :8].copy().view(">u8").ravel().astype(np.uint64)
        return mine, inverse, ids, distinct, least, _cuts(keys, parts)


def _cuts(sorted_keys: np.ndarray, parts: int) -> np.ndarray:
    """Where the keys of each part begin; a part is a range of the key's leading bits."""
    shift = 64 - (parts.bit_length() - 1)
    edges = np.arange(1, parts, dtype=np.uint64) << np.uint64(shift) if parts > 1 else np.empty(0, np.uint64)
    return np.concatenate(([0], np.searchsorted(sorted_keys, edges), [len(sorted_keys)])).astype(np.int64)


def _by_part(told) -> dict[int, bytes]:
    return {x["part"]: x["bits"] for x in told} if told else {}


def _bits(told: dict[int, bytes], sizes) -> np.ndarray:
    out = [np.unpackbits(np.frombuffer(told[p], np.uint8), count=int(k)) for p, k in enumerate(sizes) if k]
    return np.concatenate(out).astype(bool) if out else np.empty(0, bool)


def _ask_grams(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                c = Chunk(row, parts)
                here = c.shared_here()
                hit = [p for p in range(parts) if c.cuts[p] < c.cuts[p + 1]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hit, pa.int32()), pa.array([row["chunk"]] * len(hit), pa.int64()), pa.array([c.grams[c.cuts[p] : c.cuts[p + 1]].tobytes() for p in hit], pa.binary()), pa.array([np.packbits(here[c.cuts[p] : c.cuts[p + 1]]).tobytes() for p in hit], pa.binary())],
                    ["part", "chunk", "grams", "here"],
                )

    return run


def _tell_grams(key: tuple, table: pa.Table) -> pa.Table:
    """For each chunk's grams: is it in two documents of one chunk, or in two chunks?"""
    grams = [np.frombuffer(x, np.uint64) for x in table["grams"].to_pylist()]
    sizes = [len(x) for x in grams]
    here = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=k) for x, k in zip(table["here"].to_pylist(), sizes, strict=True)]).astype(bool)
    flat = np.concatenate(grams)
    order = np.argsort(flat)
    ranked = flat[order]
    same = np.zeros(len(flat) + 1, bool)
    same[1:-1] = ranked[1:] == ranked[:-1]
    shared = same[1:] | same[:-1]
    out = np.empty(len(flat), bool)
    out[order] = shared
    out |= here
    # a gram shared within one chunk is alone in its run: the flag covers it
    cuts = np.concatenate(([0], np.cumsum(sizes)))
    return pa.table({"chunk": table["chunk"], "part": pa.array([key[0].as_py()] * len(sizes), pa.int32()), "bits": pa.array([np.packbits(out[a:b]).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())})


def _ask_windows(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                c = Chunk(row, parts)
                live = _bits(_by_part(row["grams_told"]), np.diff(c.cuts))
                _, _, _, distinct, least, cuts = c.rows(live, parts)
                hit = [p for p in range(parts) if cuts[p] < cuts[p + 1]]
                # by columns and packed: text that the shuffle's fast codec hardly shrinks
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hit, pa.int32()), pa.array([row["chunk"]] * len(hit), pa.int64()), pa.array([zlib.compress(distinct[cuts[p] : cuts[p + 1], 8:].T.tobytes(), 1) for p in hit], pa.binary()), pa.array([least[cuts[p] : cuts[p + 1]].tobytes() for p in hit], pa.binary())],
                    ["part", "chunk", "segments", "least"],
                )

    return run


def columns(symbols: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Insert one symbol of each row a round, last column first: ``(column, order, common)``.

    ``symbols`` is (columns, rows). ``order`` lists the rows by their suffixes from the column on and
    ``common[i]`` is the length of the common prefix of suffixes i - 1 and i. The symbols in
    the former order are the round's transform; sorting them stably is its last-to-first
    mapping. Two suffixes that come to stand side by side under one symbol share that symbol and the
    least of the common prefixes between their tails.
    """
    width, m = symbols.shape
    order, common = np.arange(m), np.zeros(m + 1, np.uint8)
    for column in range(width - 1, -1, -1):
        transform = symbols[column][order]
        step = np.argsort(transform, kind="stable")
        ranked = transform[step]
        low, high = step[:-1] + 1, step[1:]
        alike = ranked[1:] == ranked[:-1]
        fresh = np.zeros(m + 1, np.uint8)
        near = alike & (low == high)
        fresh[1:m][near] = common[high[near]] + 1
        far = np.flatnonzero(alike & (low != high))
        if len(far):
            pairs = np.empty(2 * len(far), np.int64)
            pairs[0::2], pairs[1::2] = low[far], high[far] + 1
            fresh[1 + far] = np.minimum.reduceat(common, pairs)[0::2] + 1
        order, common = order[step], fresh
        yield column, order, common[:m]


def repeats(symbols: np.ndarray, low: np.ndarray, count: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each row and window column: does a row with a smaller id hold the same window there?"""
    m = symbols.shape[1]
    out = np.zeros((m, REACH + 1), bool)
    if not m:
        return out
    low, high = low.astype(np.int64), low.astype(np.int64) + count
    for column, order, common in columns(symbols):
        if column > REACH:
            continue
        head = common < SPAN
        head[0] = True
        group = np.cumsum(head) - 1
        who = ids[order]
        inside = (low[order] <= column) & (column < high[order])
        least = np.minimum.reduceat(np.where(inside, who, np.iinfo(np.int64).max), np.flatnonzero(head))
        out[order, column] = inside & (who > least[group])
    return out


def _tell_windows(key: tuple, table: pa.Table) -> pa.Table:
    ids = [np.frombuffer(x, np.int64) for x in table["least"].to_pylist()]
    sizes = [len(x) for x in ids]
    told = np.concatenate([np.frombuffer(zlib.decompress(x), np.uint8).reshape(2 + COLUMNS, k) for x, k in zip(table["segments"].to_pylist(), sizes, strict=True)], axis=1)
    low, count = told[0].astype(np.int64), told[1].astype(np.int64)
    hit = repeats(told[2:], low, count, np.concatenate(ids))
    at = np.arange(REACH + 1)[None, :]
    real = (at >= low[:, None]) & (at < (low + count)[:, None])
    cuts = np.concatenate(([0], np.cumsum(sizes)))
    bits = [np.packbits(hit[a:b][real[a:b]]).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return pa.table({"chunk": table["chunk"], "part": pa.array([key[0].as_py()] * len(sizes), pa.int32()), "bits": pa.array(bits, pa.binary())})


def _cut_out(parts: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                c = Chunk(row, parts)
                live = _bits(_by_part(row["grams_told"]), np.diff(c.cuts))
                mine, inverse, ids, distinct, least, cuts = c.rows(live, parts)
                windows = distinct[:, 9].astype(np.int64)
                total = np.concatenate(([0], np.cumsum(windows)))
                bits = _bits(_by_part(row["windows_told"]), total[cuts[1:]] - total[cuts[:-1]])
                # an id above the segment's least is a repeat throughout
                count = c.count[mine]
                inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                hit = np.repeat(ids > least[inverse], count)
                hit |= bits[np.repeat(total[inverse], count) + inner] if len(hit) else False
                place = np.repeat(c.starts[mine], count) + inner
                change = np.zeros(len(c.data) + 1, np.int32)
                change[place[hit]] += 1
                change[place[hit] + SPAN] -= 1
                gone = np.cumsum(change)[:-1] > 0 if len(c.data) else np.empty(0, bool)
                begins = gone.copy()
                begins[1:] &= ~gone[:-1]
                edge = c.offsets[:-1]
                edge = edge[edge < len(gone)]
                begins[edge] = gone[edge]
                removed, spans = np.concatenate(([0], np.cumsum(gone))), np.concatenate(([0], np.cumsum(begins)))
                n_removed, n_spans = np.diff(removed[c.offsets]), np.diff(spans[c.offsets])
                kept = []
                for i, (a, b) in enumerate(zip(c.offsets[:-1], c.offsets[1:], strict=True)):
                    kept.append((c.data[a:b][~gone[a:b]] if n_removed[i] else c.data[a:b]).tobytes())
                arrays = [pa.array(c.ids, mask=c.ids == _NULL_ID), pa.array(np.diff(c.offsets)), pa.array(n_removed.astype(np.int64)), pa.array(n_spans.astype(np.int64)), pa.array([hashlib.sha256(x).hexdigest() for x in kept])]
                names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
                if with_text:
                    arrays.append(pa.array(kept, pa.binary()))
                    names.append("kept")
                yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def remove_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` (and ``kept``) of every document.

    Removed is each byte covered by a 50-byte string that also starts in a document with a smaller
    doc_id, judged on the input. Null and empty texts have no bytes; a null doc_id is smaller
    than any other and equal to itself; rows that share a doc_id do not repeat each other; a text
    below 50 bytes loses nothing. Other columns are not read. An empty table gives no rows.

    Text is written once, in chunks, and read three times where it lies. Grams that occur in one document only are
    ruled out first. Segments are merged within a chunk before they travel, so a passage in a third of all
    documents sends one segment a chunk. A partition sorts what its grams' segments hold; their number
    grows with the buckets, which grow with the input's partitions.
    """
    spark = docs.sparkSession
    workers_can_import(spark)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.encode(text_or_empty("text"), "UTF-8").alias("text"))
    least = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * rows.rdd.getNumPartitions())
    # several parts for each task, so that tasks are even though parts are dealt by a hash
    parts = 4 << (least - 1).bit_length()
    name = "chunks_" + uuid.uuid4().hex[:12]
    folder = f"{scratch_root(spark)}/{name}"
    binaries = ("ids", "offsets", "data", "starts", "lead", "count")
    packed = rows.mapInArrow(_chunks, "chunk bigint, " + ", ".join(f"`{b}` binary" for b in binaries))
    packed.write.format("parquet").option("compression", "zstd").bucketBy(least, "chunk").option("path", folder).saveAsTable(name)
    chunks = spark.table(name)
    with_told = lambda df, told, what: df.join(told.groupBy("chunk").agg(F.collect_list(F.struct("part", "bits")).alias(what)).hint("shuffle_hash"), "chunk", "left")
    answer = "chunk bigint, part int, bits binary"
    asked = chunks.mapInArrow(_ask_grams(parts), "part int, chunk bigint, grams binary, here binary")
    grams = staged(asked.groupBy("part").applyInArrow(_tell_grams, answer), "grams")
    asked = with_told(chunks, grams, "grams_told").mapInArrow(_ask_windows(parts), "part int, chunk bigint, segments binary, least binary")
    windows = staged(asked.groupBy("part").applyInArrow(_tell_windows, answer), "windows")
    both = with_told(with_told(chunks, grams, "grams_told"), windows, "windows_told")
    result = both.mapInArrow(_cut_out(parts, with_text), "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * with_text)
    if with_text:
        return result
    done = staged(result, "repeats")
    spark.sql(f"DROP TABLE {name}")
    delete_path(spark, folder)
    return done


def op2_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract of op2 over the whole ``documents`` table."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP2_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, s, substr(h, 2 * s + 1, 100) AS g FROM (SELECT doc_id, h, unnest(range(length(h) // 2 - 49)) AS s FROM d WHERE length(h) >= 100) x),
m AS (SELECT g, min(doc_id) AS first FROM w GROUP BY g HAVING count(*) > 1),
hit AS (SELECT doc_id, s FROM w JOIN m USING (g) WHERE doc_id > first),
cut AS (SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 50 THEN 0 ELSE 1 END AS new FROM hit),
run AS (SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS k FROM cut),
span AS (SELECT doc_id, min(s) AS a, max(s) + 50 AS e FROM run GROUP BY doc_id, k),
gap AS (SELECT doc_id, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY a), 0) AS f, a AS t FROM span
  UNION ALL SELECT d.doc_id, coalesce(max(e), 0), any_value(length(h) // 2) FROM d LEFT JOIN span ON span.doc_id = d.doc_id GROUP BY d.doc_id),
kept AS (SELECT gap.doc_id, string_agg(substr(h, 2 * f + 1, 2 * (t - f)), '' ORDER BY f) AS k FROM gap JOIN d ON d.doc_id = gap.doc_id GROUP BY gap.doc_id),
gone AS (SELECT doc_id, sum(e - a) AS r, count(*) AS n FROM span GROUP BY doc_id)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(r, 0) AS BIGINT) AS n_removed, coalesce(n, 0) AS n_spans, sha256(unhex(k)) AS kept_sha256
FROM d JOIN kept ON kept.doc_id = d.doc_id LEFT JOIN gone ON gone.doc_id = d.doc_id
"""
