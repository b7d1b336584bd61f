"""Operators on documents against brute force, on awkward rows, and on empty tables."""

import random

import brute
import pytest
from pyspark.sql import functions as F

from sievework.llm import exact_dedup, language, mixing, packing, pii, simhash, suffix_dedup
from sievework.llm.shared import staged

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
VOCABULARY = {"en": "the of and with this that which from have been over under".split(), "fr": "le la des est une dans pour avec sur qui été où".split(), "de": "der die das und nicht über für eine zwischen schön".split()}


def prose(rng, lang, n):
    return " ".join(rng.choice(VOCABULARY[lang]) for _ in range(n))


def corpus(spark):
    rng = random.Random(4)
    rows = []
    passage = "a passage of well over fifty bytes that several documents share, word for word"
    for i in range(120):
        lang = ("en", "fr", "de")[i % 3]
        text = prose(rng, lang, rng.choice((1, 2, 5, 40, 90)))
        if i % 7 == 0:
            text += f" {passage} " + prose(rng, lang, 4)
        if i % 11 == 0 and rows:
            text = rows[-3][1] or ""
        if i % 13 == 0 and rows:
            text = (rows[-2][1] or "") + " x"
        rows.append((i, text, lang, f"src{i % 5}" if i % 9 else None, len(text)))
    rows += [(200, None, None, None, None), (201, "", "en", "", 0), (202, "  \n\t ", None, "src1", 5), (203, "12 34 !!", "en", "src2", 8), (204, "É È ÉÈ", "fr", "src0", 6), (205, "word " * 30_000, "en", "src0", 150_000), (206, "A" * 9_000, "de", "src9", 9_000)]
    rows += [(207, "Mail a.b@c.de or a@b.c_d@e.f, call +1 (988) 555-2485 / +49 30 1234567 now", "en", "src3", 60), (208, "ip 10.0.0.1 999.1.1.1 1.2.3.4.5 card 4111 1111 1111 1111 4111111111111112 4012-8881-2345-6789", "en", "src3", 60), (209, "1.2.3.4é5.6.7.8 +1(2)3 a@b", "en", "src3", 9)]
    rows += [(210, "one two three", "en", "src0", 1), (211, "ONE two THREE", "en", "src0", 1), (212, "É one", "fr", "src0", 1), (213, "é one", "fr", "src0", 1)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return staged(corpus(spark), "docs")


@pytest.fixture(scope="module")
def plain(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


def clashing(df):
    """Extra columns that carry the operators' own names."""
    for c in ("size", "digest", "fp", "kept", "pos", "row", "target", "length", "base", "component_id", "salt"):
        df = df.withColumn(c, F.lit("x"))
    return df


def write(spark, tmp_path, df, name="documents"):
    df.write.mode("overwrite").parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


# -- op2 ----------------------------------------------------------------------------------------------------------------


def test_repeats(docs, plain):
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.remove_repeats(clashing(docs)).collect()}
    assert got == brute.repeats(plain)


def test_repeats_small_alphabet_and_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", 300)
    rng = random.Random(1)
    rows = [(i, "".join(rng.choice("ab") for _ in range(rng.choice((10, 49, 50, 51, 200))))) for i in range(40)]
    base = "".join(rng.choice("abc") for _ in range(160))
    rows += [(100 + i, base[rng.randrange(30) : 100 + rng.randrange(60)]) for i in range(30)] + [(200, "a" * 400), (201, "a" * 120), (202, "ab" * 100)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.remove_repeats(df).collect()}
    assert got == brute.repeats(rows)


def test_repeats_null_and_equal_ids(spark):
    t = "0123456789" * 6
    rows = [(None, t), (1, t), (1, t + "x"), (5, "tail " + t)]
    got = sorted(map(tuple, suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).select(F.coalesce("doc_id", F.lit(-1)), "n_removed").collect()))
    assert got == [(-1, 0), (1, 60), (1, 60), (5, 60)]


def test_columns_orders_suffixes():
    import numpy as np

    rng = np.random.default_rng(0)
    m = rng.integers(0, 3, (9, 50)).astype(np.uint8)
    for column, order, common in suffix_dedup.columns(m):
        tails = [bytes(m[column:, i]) for i in order]
        assert tails == sorted(tails)
        lcp = [next((k for k in range(len(a)) if a[k] != b[k]), len(a)) for a, b in zip(tails, tails[1:])]
        assert lcp == common[1:].tolist()


# -- op3 ----------------------------------------------------------------------------------------------------------------


def test_language_held_out(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, lang := ("en", "fr", "de")[i % 3], 30), lang) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language.train(language.learnable(df))
    out = language.identify(df, model).select("row.*", "lang_pred", "score", language.held_out("row.doc_id").alias("held_out")).collect()
    held = [r for r in out if r["held_out"]]
    assert len(held) > 30 and sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in out)


def test_language_equals_a_plain_predictor(spark, docs):
    """Counts, trust and decoding done word by word in plain Python; short, empty, null, mixed and repeated texts."""
    learnable = language.learnable(docs.where("doc_id < 205").unionByName(docs.where("doc_id < 205").withColumn("doc_id", F.lit(None).cast("bigint"))))
    model = language.train(learnable)
    rows = learnable.where("lang IS NOT NULL AND text IS NOT NULL").select("text", "lang", language._uniform().alias("u")).collect()
    n = {x: sum(r["lang"] == x for r in rows) for x in model.languages}
    learn = [(r["text"], r["lang"]) for r in rows if r["u"] < min(0.9, 8_000 / n[r["lang"]])]
    tries = [(r["text"], r["lang"]) for r in rows if r["u"] >= 1 - min(0.1, 500 / n[r["lang"]])]
    assert tries and not {t for t, _ in tries if len(t) > 200} & {t for t, _ in learn}
    predict = brute.language_model(learn, tries, model.languages, model.code.tolist(), language.DIM)
    texts = ["the und", "le", "über", "x", "", None, "12", "der the le la und of", "É", "the of and", "zwischen schön été"]
    got = language.identify(spark.createDataFrame([(None, t) for t in texts], "doc_id bigint, text string"), model).select("row.text", "lang_pred", "score").collect()
    for r in got:
        lang, score = predict(r["text"])
        assert r["lang_pred"] == lang and r["score"] == pytest.approx(score, abs=1e-4), r
    assert model.trust.max() - model.trust.min() > 1e-4


def test_language_query(spark, docs, tmp_path):
    import zlib

    out = {r["doc_id"]: r for r in language.op3_query(spark, write(spark, tmp_path, clashing(docs))).collect()}
    assert len(out) == docs.count()
    assert [out[i]["lang_pred"] for i in (200, 201, 202, 203)] == ["und"] * 4
    assert out[204]["lang_pred"] != "und" and {r["lang_pred"] for r in out.values()} <= {"und", "en", "fr", "de"}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in out.items())


def test_language_stretches_agree(spark, docs):
    """Long texts are read in stretches; the margins don't depend on where they are cut."""
    import numpy as np
    import pyarrow as pa

    model = language.train(language.learnable(docs))
    texts = ["é the word " * 30_000, "x", "", "über das"]
    data, offsets = language._buffers(pa.array(texts))
    whole, n = language._margins(model, data, offsets)
    wide = language.LanguageModel(model.languages, model.code, np.tile(model.weights, (1, 30)), model.trust)
    cut, m = language._margins(wide, data, offsets)
    assert np.allclose(whole, cut[:, : whole.shape[1]], rtol=1e-3, atol=1e-2) and (n == m).all()


def test_codewords_differ():
    for n in (2, 3, 4, 6, 9, 40):
        code = language.codewords(n)
        assert len({tuple(r) for r in code}) == n and ((code.max(axis=0) == 1) & (code.min(axis=0) == -1)).all()


def test_language_without_labels(spark):
    df = spark.createDataFrame([(1, "text", None), (2, None, "en")], "doc_id bigint, text string, lang string")
    assert [r["lang_pred"] for r in language.identify(df, language.train(df)).collect()] == ["und", "und"]


# -- op4 ----------------------------------------------------------------------------------------------------------------


def test_packing(docs, plain):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(packing.default_tokenizer())
    encode = lambda t: model.encode(t, add_special_tokens=False).ids
    rows = packing.pack_documents(clashing(docs)).collect()
    got = sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    assert got == sorted((i, *p) for i, t in plain for p in brute.pieces(t, encode))
    check_places(rows)
    assert len({r["sequence_id"] for r in rows}) == -(-sum(r["length"] for r in rows) // 4096)


def check_places(rows, capacity=4096):
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity


def test_packing_repeated_and_null_ids(spark):
    rows = [(1, "same words here")] * 9 + [(None, "x"), (None, None), (2, "word " * 9_000)]
    out = packing.pack_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert len(out) == 11 + 3
    check_places(out)


@pytest.mark.parametrize("seed", range(6))
def test_bin_completion_is_near_the_bound(seed):
    rng = random.Random(seed)
    histogram = {}
    for _ in range(400):
        x = rng.randint(1, 100 if seed % 2 else 60)
        histogram[x] = histogram.get(x, 0) + 1
    bins = packing.pack_lengths(histogram, 100)
    used = {}
    for times, filling in bins:
        assert sum(x * k for x, k in filling) <= 100
        for x, k in filling:
            used[x] = used.get(x, 0) + k * times
    assert used == histogram
    assert sum(m for m, _ in bins) <= least_bins(histogram, 100) + 2


def least_bins(histogram, capacity):
    """Martello and Toth's bound L2, item by item."""
    items = [x for x, c in histogram.items() for _ in range(c)]
    best = 0
    for a in range(capacity // 2 + 1):
        large, middle = [x for x in items if x > capacity - a], [x for x in items if capacity / 2 < x <= capacity - a]
        small = sum(x for x in items if a <= x <= capacity / 2)
        best = max(best, len(large) + len(middle) + max(0, -(-(small - (len(middle) * capacity - sum(middle))) // capacity)))
    return best


def histogram_of(items):
    return {x: items.count(x) for x in items}


def best_fit_decreasing(items, capacity):
    bins = []
    for x in sorted(items, reverse=True):
        room = [i for i, r in enumerate(bins) if r >= x]
        if room:
            bins[min(room, key=bins.__getitem__)] -= x
        else:
            bins.append(capacity - x)
    return len(bins)


def optimal(items, capacity):
    """The fewest bins, by the best (bins, room used in the last) of every subset."""
    best = {0: (1, 0)}
    for subset in range(1 << len(items)):
        bins, used = best[subset]
        for i, x in enumerate(items):
            if not subset >> i & 1:
                new = (bins, used + x) if used + x <= capacity else (bins + 1, x)
                key = subset | 1 << i
                best[key] = min(best.get(key, new), new)
    return best[(1 << len(items)) - 1][0]


def test_packings_are_optimal_and_parts_right():
    rng, better = random.Random(1), 0
    for _ in range(120):
        capacity = rng.choice((20, 50, 100))
        items = [rng.randint(capacity // 8, capacity * 2 // 3) for _ in range(rng.randint(1, 11))]
        h, least = histogram_of(items), optimal(items, capacity)
        greedy = sum(m for m, _ in packing.best_fit(h, capacity))
        assert greedy == best_fit_decreasing(items, capacity)
        assert packing.least_bins(h, capacity) == least_bins(h, capacity) <= least
        bins = packing.pack_lengths(h, capacity)
        assert sum(m for m, _ in bins) == least
        assert sorted(x for m, f in bins for x, k in f for _ in range(m * k)) == sorted(items) and all(sum(x * k for x, k in f) <= capacity for _, f in bins)
        better += greedy > least
    assert better > 0


@pytest.mark.parametrize("n", (1, 10, 10**9))
def test_hot_lengths_pack_as_few_do(n):
    """{60, 25, 15} and {40, 40, 20} leave nothing; taking 40 with 60 first does not cost more as the counts grow."""
    assert sum(m for m, _ in packing.pack_lengths({60: n, 40: 2 * n, 25: n, 20: n, 15: n}, 100)) == 2 * n


def test_effort_bounds_the_search():
    rng = random.Random(3)
    h = histogram_of([rng.randint(1_100, 1_700) for _ in range(3_000)])
    bins = packing.pack_lengths(h, 4096, effort=500)
    assert least_bins(h, 4096) <= sum(m for m, _ in bins) <= sum(m for m, _ in packing.best_fit(h, 4096))


def test_fillings_are_those_not_dominated():
    every, _, whole = packing.fillings(10, [7, 6, 4, 3], [1, 1, 1, 1], 10, 1_000)
    assert whole and [f for _, f in every] == [((7, 1), (3, 1)), ((6, 1), (4, 1))]
    assert packing.fillings(5, [3], [1], 5, 100)[0] == [(2, ((3, 1),))]


def test_other_tokenizers_read_whole_texts(spark):
    """A tokenizer that keeps white space and case: no word is taken for itself."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    model = Tokenizer.from_file(path)
    texts = ["Two  words", "two words", "", " é\n\tx", None]
    rows = packing.token_pieces(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), path).collect()
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted((i, *p) for i, t in enumerate(texts) for p in brute.pieces(t, lambda t: model.encode(t, add_special_tokens=False).ids))


# -- op5 ----------------------------------------------------------------------------------------------------------------


def test_personal_data(spark, docs, plain, tmp_path):
    import hashlib

    got = {r["doc_id"]: r for r in pii.op5_query(spark, write(spark, tmp_path, clashing(docs))).collect()}
    for i, t in plain:
        counts, spans = brute.personal(t)
        r = got[i]
        assert {k: r[f"n_{k}"] for k in counts} == counts, (i, r, spans)
        assert r["base_sha256"] == hashlib.sha256(spans.encode()).hexdigest()
        assert set(filter(None, spans.split(","))) <= set(r["spans"].split(","))


def test_trees_add_loose_formats(spark, redactor):
    texts = ["please mail anna.berg at example dot com today", "phone 030 123 4567 now", "our version 1.20.300.4000 is out", "invoice 123.456.789 was sent", "call (415) 555-0134 now", "please mail anna.berg(at)example.com today"]
    texts += ["x 4111 1111  1111 1111 y", "4111.1111.1111.1112", "up 10[.]1[.]2[.]3 now", "a 4012888888881881 4012888888881881 b +1 (415) 555-0134 10.0.0.1 zz"]
    rows = pii.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), redactor).select("row.doc_id", "added").collect()
    found = {r["doc_id"]: [(pii.KINDS[s["kind"]], texts[r["doc_id"]][s["start"] : s["end"]]) for s in r["added"]] for r in rows}
    assert [k for k, _ in found[0]] == ["email"] and found[4] == [("phone", "(415) 555-0134")] and found[2] == found[3] == found[7] == []
    assert found[5] == [("email", "anna.berg(at)example.com")] and found[6] == [("card", "4111 1111  1111 1111")] and found[8] == [("ip", "10[.]1[.]2[.]3")]
    # what a strict format loses as its match runs on is found
    assert ("phone", "+1 (415) 555-0134") in found[9]


def test_trees_do_well_on_documents_kept_out(redactor):
    assert set(redactor.report) == set(pii.KINDS)
    for precision, recall, n in redactor.report.values():
        assert n > 50 and precision >= 0.97 and recall >= 0.95


def test_trees_learn_from_all_documents(spark):
    """What 7,000 documents with an address each teach and report is not that of a part of them, and reruns agree."""
    docs = spark.range(7_000).selectExpr("id AS doc_id", "concat('note ', hex(id), ' from ann', id, '@mail', id % 50, '.example.org, order ', 100000000000000 + id * 7919, ' sent at noon') AS text")
    halves = [pii.examples(docs.where(f"doc_id % 2 = {i}")) for i in range(2)]
    count = lambda df: {tuple(r)[:-1]: r["n"] for r in df.groupBy("fold", "kind", "label").agg(F.sum("n").alias("n")).collect()}
    whole, parts = count(pii.examples(docs)), [count(h) for h in halves]
    assert whole == {k: sum(p.get(k, 0) for p in parts) for k in whole}
    # at least the address in its document, and put back as it stands and in a looser form
    assert sum(n for (_, kind, label), n in whole.items() if kind == 0 and label == 1) >= 3 * 7_000
    first, again = pii.fit(docs), pii.fit(docs.repartition(3))
    assert first.report["email"][2] == sum(n for (fold, kind, label), n in whole.items() if fold >= 8 and kind == 0 and label == 1) > 3_000
    assert (first.trees, first.least, first.report) == (again.trees, again.least, again.report)


def test_added_spans_are_what_their_kind_is(spark, redactor):
    """On the shared documents: something is added, nothing that overlaps, and each has its kind's digits."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("text RLIKE '[0-9@]'")
    rows = pii.personal_data(docs, redactor).where("size(added) > 0").select("row.text", "base", "added").collect()
    assert rows
    for r in rows:
        spans = sorted((s["start"], s["end"]) for s in r["added"])
        assert all(b <= c for (_, b), (c, _) in zip(spans, spans[1:]))
        for s in r["added"]:
            assert r["text"][s["start"] : s["end"]] == s["hit"] and not any(b["start"] < s["end"] and s["start"] < b["end"] for b in r["base"])
            digits = "".join(c for c in s["hit"] if c.isdigit())
            assert pii.KINDS[s["kind"]] != "card" or brute.luhn(digits)


def test_redaction(spark, redactor):
    df = spark.createDataFrame([(1, "to a@b.de, from 10.0.0.1."), (2, None), (3, ""), (None, "é" * 2_500 + " a@b.de " + "ü" * 2_500), (1, "+4111 1111 1111 1111 x"), (1, "+4111 1111 1111 1111 x")], "doc_id bigint, text string")
    got = [r["text"] for r in pii.redacted(df, redactor).collect()]
    assert got[:3] == ["to [email], from [ip].", None, ""] and got[3] == "é" * 2_500 + " [email] " + "ü" * 2_500
    assert got[4] == got[5] and "1111" not in got[4]


def test_long_runs_are_linear(spark, redactor):
    """Runs that a plain regex reads over and over, deep repeats that would exhaust a stack, and texts of many matches."""
    texts = ["a" * 200_000 + " @", "1" * 200_000, "a@" + "b." * 50_000 + "c", "1 " * 60_000, " info@x.de" * 20_000, " info at x dot de," * 5_000]
    out = pii.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), redactor)
    got = out.select(F.size("base"), F.size("added"), "base", "added").collect()
    assert [r[0] for r in got] == [0, 0, 1, 0, 20_000, 0] and got[5][1] == 5_000
    for text, r in zip(texts[4:], got[4:]):
        assert all(text[s["start"] : s["end"]] == s["hit"] for s in (*r["base"], *r["added"]))


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "no data"), (None, None)], "doc_id bigint, text string")
    assert [(r["base"], r["added"]) for r in pii.personal_data(df).collect()] == [([], []), ([], [])]


# -- op7 ----------------------------------------------------------------------------------------------------------------


def test_exact(docs, plain):
    groups = {}
    for i, t in plain:
        groups.setdefault((t or "").translate(brute.LOWER), []).append(i)
    want = {i: (max(g), len(g), i == max(g)) for g in groups.values() for i in g}
    assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(clashing(docs)).collect()} == want


def test_index_remembers(spark, tmp_path):
    index = exact_dedup.DigestIndex(spark, str(tmp_path / "index"), buckets=4)
    first = spark.createDataFrame([(1, "a"), (2, "A"), (3, "b")], "doc_id bigint, text string")
    later = spark.createDataFrame([(9, "a"), (10, "c"), (11, "c")], "doc_id bigint, text string")
    assert {r["doc_id"]: r["keep_id"] for r in exact_dedup.exact_dedup(first, index).collect()} == {1: 2, 2: 2, 3: 3}
    again = exact_dedup.DigestIndex(spark, str(tmp_path / "index"), buckets=4)
    assert {r["doc_id"]: r["keep_id"] for r in exact_dedup.exact_dedup(later, again).collect()} == {9: 2, 10: 11, 11: 11}
    again.compact()
    assert again.read().count() == 3


def test_index_outlives_settings(spark, tmp_path):
    """The bucket count is the folder's: another session's settings or a lost catalog change nothing."""
    folder, rows = str(tmp_path / "index"), [(i, f"text {i}") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    index = exact_dedup.DigestIndex(spark, folder, buckets=4)
    assert all(r["kept"] for r in exact_dedup.exact_dedup(df, index).collect())
    index.close()
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "80")
    try:
        again = exact_dedup.DigestIndex(spark, folder)
        assert again.buckets == 4
        later = df.withColumn("doc_id", F.col("doc_id") + 1_000)
        assert not any(r["kept"] for r in exact_dedup.exact_dedup(later, again).collect())
        assert again.read().count() == 200
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    again.compact()
    assert exact_dedup.DigestIndex(spark, folder, buckets=4).read().count() == 200
    with pytest.raises(ValueError):
        exact_dedup.DigestIndex(spark, folder, buckets=8)


@pytest.mark.parametrize("batches", (1, 2, 5))
def test_batches_agree(spark, docs, plain, batches):
    """Rows repeated, null ids, and texts that meet themselves in the index, in any number of batches."""
    rows = docs.select("doc_id", "text").union(docs.select("doc_id", "text").where("doc_id % 5 = 0"))
    rows = rows.union(spark.createDataFrame([(None, "one two three"), (None, "only null"), (None, "only null")], "doc_id bigint, text string"))
    got = sorted(str((r["doc_id"], r["keep_id"], r["group_size"], r["kept"])) for r in exact_dedup.exact_dedup(rows, batches=batches).collect())
    whole = [(r["doc_id"], r["text"]) for r in rows.collect()]
    groups = {}
    for i, t in whole:
        groups.setdefault((t or "").translate(brute.LOWER), []).append(i)
    keep = {t: max((i for i in g if i is not None), default=None) for t, g in groups.items()}
    keys = [(t or "").translate(brute.LOWER) for _, t in whole]
    assert got == sorted(str((i, keep[k], len(groups[k]), i == keep[k])) for (i, _), k in zip(whole, keys))


def test_drop_exact(spark):
    rows = [(1, "a", "x"), (2, "A", "y"), (2, "A", "y"), (3, None, None), (None, "q", "n"), (None, "Q", "m"), (5, "", "z")]
    out = exact_dedup.drop_exact(clashing(spark.createDataFrame(rows, "doc_id bigint, text string, source string")))
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, (r["text"] or "").lower()) for r in out.collect())
    assert got == [(False, 2, "a"), (False, 5, ""), (True, 0, "q"), (True, 0, "q")] or got == [(False, 2, "a"), (False, 5, ""), (True, 0, "q")]
    assert out.columns[:3] == ["doc_id", "text", "source"]


# -- op8 ----------------------------------------------------------------------------------------------------------------


def test_simhash(spark, docs, plain, tmp_path):
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.op8_query(spark, write(spark, tmp_path, clashing(docs))).collect()}
    assert got == brute.simhash_components(plain)


def test_links_connect_what_is_near(spark):
    """Chains, crowded cells and lone fingerprints: the components are those of all pairs."""
    rng = random.Random(3)
    fps = [rng.getrandbits(64) for _ in range(60)]
    for _ in range(400):
        x = rng.choice(fps[:12] + fps[-20:])
        for _ in range(rng.randint(1, 4)):
            x ^= 1 << rng.randrange(64)
        fps.append(x)
    fps = sorted(set(fps))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    from sievework.llm.shared import components

    df = spark.createDataFrame([(signed(x),) for x in fps], "fp bigint")
    roots = {r["node"]: r["root"] for r in components(simhash.near_links(df)).collect()}
    parent = {x: x for x in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, a in enumerate(fps):
        for b in fps[:n]:
            if bin(a ^ b).count("1") <= 3:
                parent[find(a)] = find(b)
    groups, got = {}, {}
    for x in fps:
        groups.setdefault(find(x), set()).add(x)
        got.setdefault(roots.get(signed(x), signed(x)), set()).add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, got.values()))


def test_long_fingerprints_agree():
    rng = random.Random(6)
    text = " ".join(rng.choice("abcdefgh") + rng.choice("xyz") for _ in range(5_000))
    assert simhash.fingerprint(text.encode()) == brute.simhash(text)


def test_drop_near(spark):
    rng = random.Random(8)
    base = prose(rng, "en", 400)
    rows = [(4, base), (2, base + " end"), (9, prose(rng, "de", 300)), (None, None), (7, None), (7, None)]
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in simhash.drop_near(clashing(spark.createDataFrame(rows, "doc_id bigint, text string"))).collect())
    assert got == [(False, 2), (False, 7), (False, 9)]


# -- op10 ---------------------------------------------------------------------------------------------------------------


def test_targets(spark):
    rng = random.Random(5)
    for _ in range(4):
        sizes = {f"s{i:02d}": rng.choice((0, 1, 10, 500, 3_000)) for i in range(rng.randint(1, 9))} | {None: rng.choice((0, 70))}
        df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size bigint")
        got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
        assert got == pytest.approx(brute.targets(sizes))


def test_mix(spark, docs, plain, tmp_path):
    path = write(spark, tmp_path, clashing(docs).drop("size"))
    rows = mixing.op10_query(spark, path).collect()
    sizes = {i: len(brute.WORD.findall(t or "")) for i, t in plain}
    assert {r["doc_id"]: r["size"] for r in rows} == sizes
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    per = {}
    for i, n in sizes.items():
        per[source[i]] = per.get(source[i], 0) + n
    want = brute.targets(per)
    assert {r["doc_id"]: r["target"] for r in rows} == pytest.approx({i: want[source[i]] for i in sizes})
    assert all(r["taken"] % max(r["size"], 1) == 0 and r["taken"] <= 3 * r["size"] for r in rows)
    for s in per:
        taken, most = sum(r["taken"] for r in rows if source[r["doc_id"]] == s), max(sizes[i] for i in sizes if source[i] == s)
        assert abs(taken - want[s]) <= 3 * most
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.op10_query(spark, path).collect()))


def test_mix_equals_a_plain_systematic_sample(spark, docs):
    """Copies by summing up expected copies row by row, whatever the session's partitions; rows repeated, null ids and sources."""
    import hashlib
    import math

    rows = docs.select("doc_id", "text", "source").union(docs.select("doc_id", "text", "source").where("doc_id % 6 = 0"))
    rows = rows.union(spark.createDataFrame([(None, "a b", "src0"), (None, "a b c", "src0"), (None, "a b", None), (None, None, None)], "doc_id bigint, text string, source string"))
    plain = [(r["doc_id"], r["text"], r["source"]) for r in rows.collect()]
    size = lambda t: len(brute.WORD.findall(t or ""))
    per = {}
    for _, t, s in plain:
        per[s] = per.get(s, 0) + size(t)
    want, expected = brute.targets(per), []
    for s in per:
        def place(row):
            digits = f"{size(row[1]) + 1:b}"
            return len(digits), digits[1:4].ljust(3, "0"), hashlib.md5(f"{'' if row[0] is None else row[0]}:{row[1] or ''}".encode()).hexdigest()

        rate = want[s] / per[s] if per[s] else 0.0
        at = int(hashlib.md5(f"20240601:{chr(0) if s is None else s}".encode()).hexdigest()[:13], 16) / 2.0**52
        for n, row in enumerate(sorted((r for r in plain if r[2] == s), key=place), 1):
            expected.append((str(row), math.floor(n * rate + at) - math.floor((n - 1) * rate + at)))
    was = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for partitions in ("4", "37"):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            got = [(str((r["row"]["doc_id"], r["row"]["text"], r["row"]["source"])), r["copies"]) for r in mixing.mix(rows, cell_rows=20).collect()]
            assert sorted(got) == sorted(expected)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


def test_mix_takes_each_its_share(spark):
    df = spark.createDataFrame([(i, "w " * 10, "a" if i < 600 else "b") for i in range(900)], "doc_id bigint, text string, source string")
    out = mixing.mixed_documents(df, weights=(1, 2))
    got = {r["source"]: r["n"] for r in out.groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert abs(got["a"] - 300) <= 1 and abs(got["b"] - 600) <= 1 and out.columns == df.columns


# -- all ----------------------------------------------------------------------------------------------------------------


def test_empty_tables(spark, tmp_path):
    path = write(spark, tmp_path, spark.createDataFrame([], SCHEMA))
    for run in (suffix_dedup.op2_query, language.op3_query, packing.op4_query, pii.op5_query, exact_dedup.op7_query, simhash.op8_query, mixing.op10_query):
        assert run(spark, path).count() == 0
