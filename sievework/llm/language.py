"""Language identification with error-correcting output codes."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import workers_can_import

DIM = 1 << 16
ORDERS = (1, 2, 3)
UNKNOWN = "und"
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[ord("A") : ord("Z") + 1] += 32
_FOLD[[c for c in range(128) if not chr(c).isalpha()]] = 32
_LETTER = re.compile(rb"[A-Za-z]")


def codewords(n: int) -> np.ndarray:
    """Codewords of +1 and -1, one row a language, one column a binary task.

    Up to 6 languages all 2^(n-1) - 1 splits are used. Beyond, 12 log2(n) columns are drawn
    from a fixed seed, several times over, and the draw with the largest least distance is kept.
    """
    if n <= 1:
        return np.ones((n, 1), np.int8)
    if n <= 6:
        masks = np.arange(1, 1 << (n - 1))
        rows = [np.ones(len(masks), np.int8)] + [np.where(masks >> i & 1, -1, 1).astype(np.int8) for i in range(n - 1)]
        return np.stack(rows)
    rng, width, best, far = np.random.default_rng(7), math.ceil(12 * math.log2(n)), None, -1
    for _ in range(60):
        code = rng.choice(np.array([-1, 1], np.int8), (n, width))
        code = code[:, np.abs(code.sum(axis=0)) < n]
        apart = (code[:, None, :] != code[None, :, :]).sum(axis=2)
        np.fill_diagonal(apart, width)
        if apart.min() > far:
            best, far = code, int(apart.min())
    return best


@dataclass
class LanguageModel:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray  # (DIM + 1, bits), the last row is zero
    trust: np.ndarray = field(default=None)  # (languages, bits), rows sum to 1
    #: A prediction whose share of the weight is below this is marked ambiguous.
    least_score: float = 0.4


def gram_slots(data: np.ndarray, ends: np.ndarray, order: int) -> np.ndarray:
    """The hash slot of the byte n-gram at each position; DIM where it would leave its document."""
    n = len(data)
    value = np.zeros(n, np.uint32)
    for k in range(order):
        value[: n - k] = value[: n - k] * np.uint32(257) + data[k:]
    slots = ((value * np.uint32(2654435761) + np.uint32(order * 40503)) >> np.uint32(16)).astype(np.int32)
    for k in range(1, order):
        slots[ends[ends >= k] - k] = DIM
    return slots


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column's bytes and offsets, without copying; nulls have no bytes."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)), offsets


def _margins(model: LanguageModel, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each document's summed log odds for every bit and its number of n-grams, a bounded stretch at a time."""
    n, bits = len(offsets) - 1, model.weights.shape[1]
    total, count = np.zeros((n, bits)), np.zeros(n)
    step = max(1 << 16, (1 << 22) // bits)
    width = max(ORDERS) - 1
    for at in range(int(offsets[0]), int(offsets[-1]), step):
        to = min(at + step, int(offsets[-1]))
        part = _FOLD[data[at : min(to + width, int(offsets[-1]))]]
        first = int(np.searchsorted(offsets, at, side="right")) - 1
        last = int(np.searchsorted(offsets, to, side="left"))
        ends = offsets[first + 1 : last + 2] - at
        ends = np.unique(ends[(ends > 0) & (ends <= len(part))])
        starts = np.maximum(offsets[first:last] - at, 0)
        keep = np.append(starts[1:], to - at) > starts  # empty documents have no stretch
        docs, starts = np.arange(first, last)[keep], starts[keep]
        for order in ORDERS:
            slots = gram_slots(part, ends, order)[: to - at]
            total[docs] += np.add.reduceat(model.weights[slots], starts, axis=0)
            count[docs] += np.add.reduceat((slots < DIM).astype(np.float64), starts)
    return total, count


def _bit_losses(model: LanguageModel, total: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Each document's logistic loss for every language's bits: (documents, languages, bits)."""
    margin = total / np.sqrt(np.maximum(count, 1))[:, None]
    return np.logaddexp(0, -margin[:, None, :] * model.code[None, :, :])


def _losses(model: LanguageModel, total: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Loss of each codeword: the losses of its bits, weighted by how far each task is trusted for it."""
    return (_bit_losses(model, total, count) * model.trust[None, :, :]).sum(axis=2)


def predict(model: LanguageModel, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    data, offsets = _buffers(column)
    n = len(column)
    lang, score, unsure = [UNKNOWN] * n, np.zeros(n), np.ones(n, bool)
    if not model.languages or not n:
        return lang, score, unsure
    loss = np.concatenate([_losses(model, *_margins(model, data, offsets[a : a + 513])) for a in range(0, n, 512)])
    share = np.exp(loss.min(axis=1, keepdims=True) - loss)
    share /= share.sum(axis=1, keepdims=True)
    best = loss.argmin(axis=1)
    view = memoryview(data)
    for i in range(n):
        raw = view[offsets[i] : offsets[i + 1]]
        if _LETTER.search(raw) or any(c.isalpha() for c in bytes(raw).decode("utf-8", "replace")):
            lang[i], score[i] = model.languages[best[i]], share[i, best[i]]
            unsure[i] = score[i] < model.least_score
    return lang, score, unsure


def _counts(languages: list[str]):
    at = {x: i for i, x in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(languages), DIM + 1), np.int64)
        for batch in batches:
            data, offsets = _buffers(batch.column(1))
            for i, name in enumerate(batch.column(0).to_pylist()):
                part = _FOLD[data[offsets[i] : offsets[i + 1]]]
                ends = np.array([len(part)])
                for a in range(0, len(part), 1 << 20):
                    stretch = part[a : a + (1 << 20) + max(ORDERS) - 1]
                    for order in ORDERS:
                        slots = gram_slots(stretch, ends - a if a + len(stretch) == len(part) else np.array([], int), order)
                        np.add.at(sums[at[name]], slots[: 1 << 20], 1) if len(slots) < 20_000 else sums[at[name]].__iadd__(np.bincount(slots[: 1 << 20], minlength=DIM + 1))
        which, slot = np.nonzero(sums[:, :DIM])
        yield pa.RecordBatch.from_arrays([pa.array(which.astype(np.int32)), pa.array(slot.astype(np.int32)), pa.array(sums[which, slot])], ["lang", "slot", "n"])

    return run


def _uniform() -> F.Column:
    """A number from 0 to 1 that the row's id and text decide."""
    return (F.xxhash64("doc_id", "text", F.lit("language")).bitwiseAND(F.lit((1 << 52) - 1))).cast("double") / float(1 << 52)


def train(docs: DataFrame, most_docs: int = 8_000, most_trials: int = 500) -> LanguageModel:
    """Fit on ``docs(doc_id, text, lang)``; rows without a language are not used.

    Of a language with more than ``most_docs`` documents, a sample of about that many is learned
    from, chosen by a hash of id and text. Each bit's classifier is a linear one over hashed
    byte 1- to 3-grams: the log odds of a gram between the languages on either side, each
    language weighing the same. A tenth of a language's documents, about ``most_trials`` at most, is kept out of that and tries the
    classifiers: a task is trusted for a language by exp(-its mean logistic loss) on them, 1/2 where none was tried.
    """
    spark = docs.sparkSession
    workers_can_import(spark)
    labelled = docs.where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().orderBy("lang").collect()}
    languages = list(sizes)
    code = codewords(len(languages))
    model = LanguageModel(languages, code, np.zeros((DIM + 1, code.shape[1]), np.float32))
    if not languages:
        return model

    def rate(most: int, share: float):
        return F.create_map(*[x for k, v in sizes.items() for x in (F.lit(k), F.lit(min(share, most / v)))])[F.col("lang")]

    learn = labelled.where(_uniform() < rate(most_docs, 0.9)).select("lang", "text")
    tries = labelled.where(_uniform() >= 1 - rate(most_trials, 0.1)).select("lang", "text")
    summed = learn.mapInArrow(_counts(languages), "lang int, slot int, n bigint").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((len(languages), DIM))
    counts[summed["lang"].to_numpy(), summed["slot"].to_numpy()] = summed["n"].to_numpy()
    odds = np.log((counts + 0.1) / (counts.sum(axis=1, keepdims=True) + 0.1 * DIM))
    share = np.exp(odds)
    for b in range(code.shape[1]):
        sides = [share[code[:, b] == s] for s in (1, -1)]
        if all(map(len, sides)):
            model.weights[:DIM, b] = np.log(sides[0].mean(axis=0)) - np.log(sides[1].mean(axis=0))
    model.trust = np.full(code.shape, 1 / code.shape[1])
    shared = spark.sparkContext.broadcast(model)

    def trials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        loss, tried = np.zeros(m.code.shape), np.zeros(len(m.languages), np.int64)
        for batch in batches:
            which = np.array([m.languages.index(x) for x in batch.column(0).to_pylist()], np.int64)
            if len(which):
                mine = _bit_losses(m, *_margins(m, *_buffers(batch.column(1))))[np.arange(len(which)), which]
                np.add.at(loss, which, mine)
                np.add.at(tried, which, 1)
        i, b = np.nonzero(np.ones(m.code.shape))
        # rounded, so that the sum does not depend on the order of the tasks
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(b), pa.array(np.rint(loss[i, b] * 2**20).astype(np.int64)), pa.array(tried[i])], ["lang", "bit", "loss", "tried"])

    tested = tries.mapInArrow(trials, "lang bigint, bit bigint, loss bigint, tried bigint").groupBy("lang", "bit").agg(F.sum("loss").alias("loss"), F.sum("tried").alias("tried")).collect()
    model.trust = np.full(code.shape, 0.5)
    for r in tested:
        if r["tried"]:
            model.trust[r["lang"], r["bit"]] = math.exp(-r["loss"] / 2**20 / r["tried"])
    model.trust /= model.trust.sum(axis=1, keepdims=True)
    return model


def learnable(docs: DataFrame) -> DataFrame:
    """The documents to learn from: crc32 of the doc_id as text is no multiple of 5."""
    return docs.where(~held_out())


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Is the crc32 of the id as text a multiple of 5? A null id counts as empty text."""
    return F.crc32(F.encode(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), "UTF-8")) % 5 == 0


def identify(docs: DataFrame, model: LanguageModel, keep: list[str] | None = None) -> DataFrame:
    """``row, lang_pred, score, ambiguous`` of every whole text.

    ``lang_pred`` is the language whose codeword has the least weighted loss, or ``und`` if the text
    is null or has no letter, or nothing was learned; then the score is 0 and it is ambiguous. The
    score is the codeword's share among exp(-loss); below ``least_score`` it is marked
    ambiguous. Only the text decides; empty and very long texts are read alike. ``row`` has the columns ``keep``, all by default; repeated rows are alike;
    an empty table gives no rows.
    """
    workers_can_import(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score, unsure = predict(shared.value, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(unsure)], ["row", "lang_pred", "score", "ambiguous"])

    whole = docs.select(F.struct(*[docs[f"`{c}`"] for c in keep or docs.columns]).alias("row"), docs["text"].alias("text"))
    return whole.mapInArrow(run, f"row {whole.schema['row'].dataType.simpleString()}, lang_pred string, score double, ambiguous boolean")


def known_language(docs: DataFrame) -> DataFrame:
    """``docs`` without those whose language can't be told: no letter, or no codeword near enough; rules as in ``identify``."""
    model = train(learnable(docs.select("doc_id", "text", "lang")))
    return identify(docs, model).where("lang_pred <> 'und' AND NOT ambiguous").select("row.*")


def op3_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract of op3 over the whole ``documents`` table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "lang")
    found = identify(docs, train(learnable(docs)), keep=["doc_id"])
    return found.select("row.doc_id", held_out("row.doc_id").alias("held_out"), "lang_pred", "score", "ambiguous")
