"""Near duplicates of the pipeline's stage: five words, a similarity of 0.8 or more."""

import random
import sys
from itertools import combinations

import brute
from pyspark import cloudpickle

from sievework.llm import minhash, simhash

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers have no tests folder


def sets_of(text):
    words = brute.WORD.findall((text or "").translate(brute.LOWER))
    k = min(5, len(words))
    return {" ".join(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def leads(rows):
    """{doc_id: the smallest doc_id that links of 0.8 or more reach}"""
    sets, parent = {i: sets_of(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {i: find(i) for i in sets}


def edited(rng, words, n):
    words = list(words)
    for i in rng.sample(range(len(words)), n):
        words[i] = f"new{rng.randrange(10**6)}"
    return words


def test_stage_drops_what_is_similar(spark):
    """Copies with a few words replaced, which differ in more than three bits, chains, and texts just below 0.8."""
    rng = random.Random(11)
    rows = []
    for g in range(40):
        base = [f"w{rng.randrange(5_000)}" for _ in range(rng.choice((7, 60, 200, 400)))]
        at = base
        for _ in range(5):
            at = edited(rng, at if g % 3 else base, rng.randint(0, len(base) // 40 + 1))
            rows.append((len(rows) * 7 % 211, " ".join(at)))
    want = leads(rows)
    kept = sorted(r["doc_id"] for r in simhash.drop_near(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert kept == sorted(set(want.values()))
    far = [(a, b) for (i, a), (j, b) in combinations(rows, 2) if want[i] == want[j] and bin(simhash.fingerprint(a.encode()) ^ simhash.fingerprint(b.encode())).count("1") > 3]
    assert len(far) > 20


def test_similarity_is_exact_at_its_edge(spark):
    """12 of 15 shingles shared is 0.8 and links; 11 of 15 does not."""
    words = [f"w{i}" for i in range(40)]
    rows = [(1, " ".join(words[:19])), (2, " ".join(words[:16])), (3, " ".join(words[20:39])), (4, " ".join(words[20:35]))]
    assert {i: len(sets_of(t)) for i, t in rows} == {1: 15, 2: 12, 3: 15, 4: 11}
    kept = sorted(r["doc_id"] for r in simhash.drop_near(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert kept == [1, 3, 4] and kept == sorted(set(leads(rows).values()))


def without_bands(run):
    def bare(batches):
        import pyarrow as pa

        for batch in run(batches):
            empty = pa.array([[]] * batch.num_rows, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([empty if n == "keys" else batch.column(n) for n in batch.schema.names], batch.schema.names)

    return bare


def test_stage_joins_fingerprints_on_the_grid(spark, monkeypatch):
    """Without a band in common, near fingerprints are proposed by the grid join, and sets decide."""
    rng = random.Random(4)
    rows = []
    for _ in range(30):
        base = [f"w{rng.randrange(9_000)}" for _ in range(600)]
        rows += [(len(rows) + i, " ".join(edited(rng, base, i))) for i in range(3)]
    want = leads(rows)
    prints = {i: minhash.majority(minhash.shingles(t.encode())) for i, t in rows}
    close = {i for i, _ in rows for j, _ in rows if i != j and want[i] == want[j] and (prints[i] ^ prints[j]).bit_count() <= 3}
    assert len(close) > 40
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    made = minhash._sketches
    monkeypatch.setattr(minhash, "_sketches", lambda words: without_bands(made(words)))
    got = {r["doc_id"]: r["lead"]["doc_id"] for r in minhash.similar_groups(df, near=simhash.near_links).collect()}
    parent = {i: i for i in prints}

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for a, b in combinations(sorted(prints), 2):
        if want[a] == want[b] and (prints[a] ^ prints[b]).bit_count() <= 3 and 5 * len(sets_of(rows[a][1]) & sets_of(rows[b][1])) >= 4 * len(sets_of(rows[a][1]) | sets_of(rows[b][1])):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    assert got == {i: find(i) for i in prints} and len(set(got.values())) < 75
    assert all(r["lead"]["doc_id"] == r["doc_id"] for r in minhash.similar_groups(df).collect())  # neither bands nor the grid


def test_links_connect_a_crowded_band():
    import numpy as np

    rng = random.Random(5)
    sets = [np.array(sorted(rng.sample(range(40), 30) if i % 2 else rng.sample(range(34), 30)), np.uint64) for i in range(80)]
    parent = list(range(80))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    want = [(a, b) for a, b in combinations(range(80), 2) if 5 * len(np.intersect1d(sets[a], sets[b])) >= 4 * len(np.union1d(sets[a], sets[b]))]
    for a, b in want:
        parent[find(b)] = find(a)
    groups = [find(i) for i in range(80)]
    parent[:] = range(80)
    for a, b in minhash.alike(sets):
        assert (min(a, b), max(a, b)) in want
        parent[find(b)] = find(a)
    same = lambda g: [g.index(x) for x in g]
    assert same([find(i) for i in range(80)]) == same(groups)
