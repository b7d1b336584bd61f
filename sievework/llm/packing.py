"""Best-fit packing by bin completion over the lengths' histogram."""

from __future__ import annotations

import bisect
import itertools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import hash_key, ranked, staged, text_or_empty, workers_can_import

CAPACITY = 4096
END = 1
#: Steps that bin completion may take before it keeps the best packing so far.
EFFORT = 60_000
#: Words of a generation whose ids a Python worker remembers; bounds its memory.
REMEMBER = 600_000
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")

_loaded: dict[str, object] = {}
_known: dict[str, Memory] = {}
_ends: dict[str, np.ndarray] = {}
_wordwise: dict[str, bool] = {}
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _tokenizer(path: str):
    if path not in _loaded:
        from tokenizers import Tokenizer

        _loaded[path] = Tokenizer.from_file(path)
    return _loaded[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Memory:
    """Ids of words seen by this Python worker; outlives a task, as workers are reused.

    Two generations of ``REMEMBER`` words at most: when the younger is full it becomes the older, and a
    word found there is young again. So words that recur stay, and those seen once go.
    """

    def __init__(self):
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def learn(self, words: set[bytes], encode) -> dict[bytes, bytes]:
        """A table that has all of ``words``. The pre-tokenizer parts a letter from a stop or comma that follows."""
        if len(self.young) > REMEMBER:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        missing, stopped = set(), []
        for w in words:
            if w not in young:
                if (ids := old.get(w)) is not None:
                    young[w] = ids
                elif 1 < len(w) <= 64 and w[-1] in b".," and 97 <= w[-2] <= 122:
                    stopped.append(w)
                else:
                    missing.add(w)
        for w in stopped:
            for part in (w[:-1], w[-1:]):
                if part not in young:
                    if (ids := old.get(part)) is not None:
                        young[part] = ids
                    else:
                        missing.add(part)
        young.update(encode(list(missing)))
        for w in stopped:
            young[w] = young[w[:-1]] + young[w[-1:]]
        return young


def _memory(path: str) -> Memory:
    return _known.setdefault(path, Memory())


def _word_ends(path: str) -> np.ndarray:
    """For each id, whether its token ends a word."""
    if path not in _ends:
        vocabulary = _tokenizer(path).get_vocab()
        ends = np.zeros(max(vocabulary.values()) + 1, bool)
        ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        _ends[path] = ends
    return _ends[path]


def _encode(path: str, words: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
    """Each word with its ids.

    Words of letters alone are one pre-token each, whose last id alone ends a word. They are encoded many to a
    text and parted there; if that gives another number of words, each is encoded on its own.
    """
    model, ends, rest, texts, groups = _tokenizer(path), _word_ends(path), [], [], []
    letters = []
    for w in words:
        (letters if w.isalpha() or w.decode().isalpha() else rest).append(w)
    for at in range(0, len(letters), 256):
        groups.append(letters[at : at + 256])
        texts.append(b" ".join(groups[-1]).decode())
    for group, e in zip(groups, model.encode_batch_fast(texts, add_special_tokens=False), strict=True):
        ids = np.array(e.ids, "<u4")
        cuts = 4 * (np.flatnonzero(ends[ids]) + 1)
        if len(cuts) == len(group):
            whole, a = ids.tobytes(), 0
            for w, b in zip(group, cuts.tolist(), strict=True):
                yield w, whole[a:b]
                a = b
        else:
            rest += group
    for at in range(0, len(rest), 4096):
        part = rest[at : at + 4096]
        for w, e in zip(part, model.encode_batch_fast([w.decode() for w in part], add_special_tokens=False), strict=True):
            yield w, np.array(e.ids, "<u4").tobytes()


def _by_words(path: str) -> bool:
    """Does this tokenizer fold case, drop white space and part what it separates, as ``token_ids`` takes for granted of words?"""
    if path not in _wordwise:
        told = json.loads(_tokenizer(path).to_str())
        folds = told.get("normalizer") == {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
        parts = (told.get("pre_tokenizer") or {}).get("pretokenizers", [])
        split = bool(parts) and parts[0].get("type") == "Split" and parts[0].get("pattern") == {"Regex": _WORDS} and parts[0].get("behavior") == "Removed" and parts[0].get("invert") is True
        _wordwise[path] = folds and split and told["model"].get("end_of_word_suffix") == "</w>" and told.get("post_processor") is None
    return _wordwise[path]


def token_ids(texts: list[bytes], path: str) -> Iterator[bytes]:
    """Each UTF-8 text's ids, little-endian 32-bit, without the closing one.

    A tokenizer that lower-cases and never joins across white space (``_by_words``) gives a word ids that don't
    depend on its neighbours or on the case of A-Z; they are worked out once for each word that
    recurs. A text that could hold the name of a special token, which does depend on case, is left as it is. Any other tokenizer reads whole texts.
    """
    if not _by_words(path):
        for text in texts:
            yield np.array(_tokenizer(path).encode(text.decode(), add_special_tokens=False).ids, "<u4").tobytes()
        return
    split = [(t if b"<|" in t else t.translate(_LOWER)).replace(b"\n", b" ").split(b" ") for t in texts]
    words = set().union(*split)
    known = _memory(path).learn(words, lambda new: _encode(path, new))
    for words_of_text in split:
        yield b"".join(map(known.__getitem__, words_of_text))
    for w in words:
        if len(w) > 64:
            del known[w]


def _pieces(tokenizer: str, capacity: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        end, step = np.array([END], "<u4").tobytes(), 4 * capacity
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                docs, pieces, starts, lengths, sums, ids = [], [], [], [], [], []
                for doc, body in zip(part.column(0).to_pylist(), token_ids(part.column(1).to_pylist(), tokenizer), strict=True):
                    whole = body + end
                    for piece, at in enumerate(range(0, len(whole), step)):
                        chunk = whole[at : at + step]
                        docs.append(doc)
                        pieces.append(piece)
                        starts.append(at // 4)
                        lengths.append(len(chunk) // 4)
                        sums.append(zlib.crc32(chunk))
                        ids.append(chunk)
                columns = [pa.array(docs, pa.int64()), pa.array(pieces, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array(ids, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def token_pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` (and ``ids``, little-endian 32-bit) of every document.

    A document is its ids and then id 1; a null text is empty, which leaves that id alone. Documents
    longer than ``capacity`` are cut into full pieces and a last, shorter one.
    """
    workers_can_import(docs.sparkSession)
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.encode(text_or_empty("text"), "UTF-8").alias("text"))
    return rows.mapInArrow(_pieces(tokenizer or default_tokenizer(), capacity, with_ids), schema)


Filling = tuple[tuple[int, int], ...]
Bins = list[tuple[int, list[tuple[int, int]]]]


def fillings(room: int, lengths: list[int], counts: list[int], most_waste: int, most_steps: int) -> tuple[list[tuple[int, Filling]], int, bool]:
    """The undominated fillings of ``room`` that waste no more than ``most_waste``: ``(waste, ((length, how many), ...))``, least waste and then largest lengths first.

    A filling is dominated if a spare length fits into what it wastes, or could take the place of a smaller one in
    it: whatever a packing does with the dominated one, it can do with the other. Also says how many steps were taken and whether all fillings were
    seen; a branch is cut when all that may still fit leaves too much waste.
    """
    n = len(lengths)
    left = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        left[i] = left[i + 1] + lengths[i] * counts[i]
    found, steps = [], 0
    # the entry popped first is the one that takes most of the largest length
    stack: list[tuple[int, int, Filling]] = [(0, room, ())]
    while stack and steps < most_steps:
        i, free, filling = stack.pop()
        steps += 1
        while i < n and (lengths[i] > free or not counts[i]):
            i += 1
        if free - left[i] > most_waste:
            continue
        if i == n:
            if not _dominated(free, filling, lengths, counts):
                found.append((free, filling))
            continue
        take = min(counts[i], free // lengths[i])
        stack.extend((i + 1, free - k * lengths[i], (*filling, (lengths[i], k)) if k else filling) for k in range(take + 1))
    return sorted(found, key=_order), steps, not stack


def _order(filling: tuple[int, Filling]) -> tuple:
    return filling[0], [(-x, -k) for x, k in filling[1]]


def _dominated(free: int, filling: Filling, lengths: list[int], counts: list[int]) -> bool:
    if not free:
        return False
    used = dict(filling)
    spare = [x for x, c in zip(lengths, counts, strict=True) if c > used.get(x, 0)]
    return any(x <= free for x in spare) or any(y < x <= y + free for y in used for x in spare)


def best_fit(histogram: dict[int, int], capacity: int) -> Bins:
    """Best-fit decreasing: each length, longest first, goes to the fullest bin that has room for it.

    Bins alike are placed together. A bin that takes a length is the fullest with room for the next of that length
    while it has any, so it takes as many as fit; the work depends on the kinds of bins, not on the number of pieces.
    """
    rooms: list[int] = []  # in order
    kinds: dict[int, list[tuple[int, tuple]]] = {}  # room: (how many bins, contents as a chain)

    def put(room: int, times: int, contents: tuple) -> None:
        if room not in kinds:
            bisect.insort(rooms, room)
            kinds[room] = []
        kinds[room].append((times, contents))

    for x in sorted(histogram, reverse=True):
        c = histogram[x]
        while c:
            at = bisect.bisect_left(rooms, x)
            if at == len(rooms):
                put(capacity, -(-c // (capacity // x)), ())
                continue
            room = rooms[at]
            times, contents = kinds[room].pop()
            if not kinds[room]:
                del kinds[room]
                rooms.pop(at)
            each = room // x
            full = min(times, c // each)
            rest = c - full * each if full < times else 0
            if full:
                put(room - full // full * each * x, full, (contents, x, each))
            if rest:
                put(room - min(rest, each) * x, 1, (contents, x, min(rest, each)))
            if times - full - bool(rest):
                put(room, times - full - bool(rest), contents)
            c -= full * each + (min(rest, each) if rest else 0)
    out = []
    for same in kinds.values():
        for times, contents in same:
            filling = []
            while contents:
                contents, x, k = contents
                filling.append((x, k))
            if filling:
                out.append((times, filling[::-1]))
    return out


def least_bins(histogram: dict[int, int], capacity: int) -> int:
    """Martello and Toth's bound L2: pieces too long to share a bin each have one, the short ones fill what those leave and then bins of their own."""
    n = np.zeros(capacity + 2, np.int64)
    for x, c in histogram.items():
        n[x] = c
    size = n * np.arange(capacity + 2)
    number, total = np.concatenate(([0], np.cumsum(n))), np.concatenate(([0], np.cumsum(size)))
    half, best = capacity // 2 + 1, -(-int(total[-1]) // capacity)
    for a in range(capacity // 2 + 1):
        large = int(number[-1] - number[capacity - a + 1])
        middle = int(number[max(capacity - a + 1, half)] - number[half])
        middle_size = int(total[max(capacity - a + 1, half)] - total[half])
        small = int(total[half] - total[min(a, half)])
        best = max(best, large + middle + max(0, -(-(small - (middle * capacity - middle_size)) // capacity)))
    return best


def pack_lengths(histogram: dict[int, int], capacity: int = CAPACITY, effort: int = EFFORT) -> Bins:
    """Bins as ``(how many alike, [(length, how many in each)])`` for a histogram of lengths.

    Bin completion. Best-fit decreasing is the incumbent, ``least_bins`` the bound. While the two differ, a packing of a number of bins between them is
    sought, the bound first: the longest length left opens a bin, each undominated filling of the rest is tried, and a branch ends when the waste so far
    is more than that many bins can hold. Bins alike are placed together, as many as there can be and then fewer, so the work depends on
    the lengths, not on the number of documents. What is found becomes the incumbent.

    Ends with an optimal packing when the bound is met or all has been tried; else after ``effort`` steps, with the incumbent.
    """
    counts = {x: c for x, c in histogram.items() if c > 0}
    found, least, total = best_fit(counts, capacity), least_bins(counts, capacity), sum(x * c for x, c in counts.items())
    most, target = sum(m for m, _ in found), least
    while least < most and effort > 0:
        share = effort if target == most - 1 else effort // 2
        better, unused = _complete(counts, capacity, target * capacity - total, share)
        effort -= share - max(unused, 0)
        if better is None:
            least = target + 1
        else:
            found, most = better, sum(m for m, _ in better)
        target = (least + most - 1) // 2
    return found


def _times(open_bins: list[tuple], phase: int) -> Iterator[tuple]:
    for free, need, order, most in open_bins:
        halves = [most >> i for i in range(1, most.bit_length())]
        for t in [most][:most] if phase == 0 else halves if phase == 1 else (t for t in range(most - 1, 0, -1) if t not in halves):
            yield free, need, order, t


def _complete(counts: dict[int, int], capacity: int, waste: int, effort: int) -> tuple[Bins | None, int]:
    """A packing that wastes no more than ``waste``, or None; and the effort left.

    Depth first, in passes that may leave the choice that looks best once, three times, seven times and so on: so what is tried early
    in a packing is not stuck behind all that could follow it. A pass that no limit cut has tried everything.
    """
    deviations = 0
    while effort > 0:
        left, path, cut = dict(counts), [], False
        lengths = sorted(left, reverse=True)

        def options(waste: int, may: int, after: tuple | None):
            """``(times, filling, waste left, deviations left, order)`` of the bins that the longest length left may open."""
            nonlocal effort, cut
            live = [x for x in lengths if left[x]]
            top = live[0]
            left[top] -= 1
            usable = [x for x in live if x <= capacity - top and left[x]]
            every, steps, whole = fillings(capacity - top, usable, [left[x] for x in usable], waste, min(2_000, effort))
            left[top] += 1
            # what a node costs besides its steps: going through the lengths
            effort, cut = effort - steps - 1 - len(live) // 16, cut or not whole
            open_bins = []
            for free, filling in every:
                order = (top, _order((free, filling)))
                # bins that share their longest length stand in one order, so that no packing is met twice
                if after and after[0] == top and order[1] <= after[1]:
                    continue
                need = dict(filling)
                need[top] = need.get(top, 0) + 1
                times = min(left[x] // k for x, k in need.items())
                open_bins.append((free, need, order, min(times, waste // free) if free else times))
            tried = 0
            # each filling as often as can be, then half as often, a quarter and so on, then any other number of times
            for free, need, order, t in itertools.chain(*(_times(open_bins, phase) for phase in range(3))):
                if tried and not may:
                    cut = True
                    return
                yield t, need, waste - t * free, may - bool(tried), order
                tried += 1

        stack = [options(waste, deviations, None)]
        while stack and effort > 0:
            step = next(stack[-1], None)
            if step is None:
                stack.pop()
                if path:
                    t, need = path.pop()
                    for x, k in need.items():
                        left[x] += t * k
                continue
            t, need, rest, may, order = step
            for x, k in need.items():
                left[x] -= t * k
            path.append((t, need))
            if not any(left.values()):
                return [(t, sorted(need.items(), reverse=True)) for t, need in path], effort
            stack.append(options(rest, may, order))
        if not cut and effort > 0:
            return None, effort
        deviations = 2 * deviations + 1
    return None, effort


def _slots(bins) -> dict[str, np.ndarray]:
    """For each length, which positions among its pieces go to which bins."""
    rows, at, used = [], 0, {}
    for times, filling in bins:
        offset = 0
        for x, k in filling:
            rows.append((x, used.get(x, 0), k, at, offset))
            used[x] = used.get(x, 0) + k * times
            offset += k * x
        at += times
    table = np.array(rows or [(0, 0, 1, 0, 0)], np.int64)
    order = np.lexsort((table[:, 1], table[:, 0]))
    table = table[order]
    return {"key": (table[:, 0] << 48) + table[:, 1], "first": table[:, 1], "each": table[:, 2], "bin": table[:, 3], "offset": table[:, 4]}


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: its place in a sequence of at most ``capacity``.

    Only the histogram of lengths, at most ``capacity`` rows, reaches the driver; its packing
    goes back as a table of slots of bounded size. Pieces of a length are interchangeable:
    each takes the slot of its rank, and ranks are found without a task per length
    (``shared.ranked``), however many pieces share one. ``pieces`` is read more than once and
    should be a stored table.
    """
    rows = {int(r[0]): int(r[1]) for r in pieces.groupBy("length").count().collect()}
    slots = pieces.sparkSession.sparkContext.broadcast(_slots(pack_lengths(rows, capacity)))
    # the ids' checksum parts pieces whose documents have no id, or the same
    keyed = pieces.withColumn("__h", hash_key("doc_id", "piece", "ids_crc32"))
    placed = ranked(keyed, ["length"], [], "__h", ["doc_id", "piece", "ids_crc32"], sum(rows.values())).drop("__h")
    columns = [c for c in placed.columns if c != "pos"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = slots.value
        for batch in batches:
            length = batch.column(batch.schema.get_field_index("length")).to_numpy()
            rank = batch.column(batch.schema.get_field_index("pos")).to_numpy() - 1
            i = np.searchsorted(t["key"], (length << 48) + rank, side="right") - 1
            r = rank - t["first"][i]
            bins, offset = t["bin"][i] + r // t["each"][i], t["offset"][i] + length * (r % t["each"][i])
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in columns], pa.array(bins), pa.array(offset)], [*columns, "sequence_id", "offset"])

    kinds = ", ".join(f"`{c}` {t}" for c, t in placed.dtypes if c != "pos")
    return placed.mapInArrow(run, f"{kinds}, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row a piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    Null texts are empty documents of one token; null and repeated doc_ids are documents of their
    own; an empty table gives no rows; other columns are not looked at.
    """
    return pack(staged(token_pieces(docs, tokenizer, capacity), "pieces"), capacity)


def op4_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract of op4 over the whole ``documents`` table."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
