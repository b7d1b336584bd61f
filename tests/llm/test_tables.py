"""Operators on pages, conversations and embeddings."""

import random

import brute
import numpy as np
import pytest
from oracle import compare, views
from pyspark.sql import functions as F

from sievework.llm import catalog, chat, urls, vectors

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_oracle(spark, name):
    assert compare(catalog.QUERIES[name](spark, SF), views(SF), catalog.ORACLE_SQL[name]) == ""


# -- op1 ----------------------------------------------------------------------------------------------------------------

URLS = ["http://A.Example.ORG/es/x", "https://example.org/en/12?q", "x.org/", "ftp://org/", "http://com/fr/", "http://b.com/de/1#y", "http://b.com?/de/", "://", None, "", "a://b://c/d", "http://evilexample.org/es/", "http://h.org", "http://H.net/a\nb?c"]


def test_hosts_paths_and_rules(spark):
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS)], "page_id bigint, url string, host string")
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    got = {r["page_id"]: r for r in urls.judge(pages, labels).collect()}
    for i, u in enumerate(URLS):
        host, path = brute.url_parts(u)
        rule, verdict = brute.url_rule(host, path)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == (host, path, rule, verdict or "allow"), u


def spam(spark, n=600):
    """Pages some of whose words mark them as bad, alone or together, among words that don't; repeated rows and null ids."""
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(["win", "pill", "news", "blog"]), rng.choice(["a", "b"])]
        odds = {"win": 0.5, "pill": 0.95}.get(words[0], 0.1) + (0.45 if words == ["win", "b"] else 0)
        rows.append((i, f"http://{words[0]}.site{rng.randrange(3)}.net/{words[1]}/{'long/' * rng.randrange(3)}{i}"))
        labels.append((i, 1, int(rng.random() < odds)))
    rows += [rows[0], rows[1], (None, rows[3][1]), (n, None), (n + 1, "http://pill.site1.net/" + "x" * 50_000)]
    labels += [(1000, 0, 1), (None, 0, 1), (4, None, None)]
    return spark.createDataFrame(rows, "page_id bigint, url string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_mined_rules_equal_counting(spark):
    pages, marks = spam(spark)
    for options in ({"min_support": 0.02, "min_confidence": 0.7, "min_lift": 1.2, "least": 1}, {"min_support": 0.002, "min_confidence": 0.5, "min_lift": 1.5, "least": 10}):
        got = {tuple(r["items"]): round(r["confidence"], 9) for r in urls.mine(pages, marks, **options).collect()}
        want = counted(pages, marks, **options)
        assert got == want and ("h:pill",) in want and any(len(k) > 1 for k in want)
        judged = urls.judge(pages, marks, **options).select("page_id", "verdict", "mined_rule").collect()
        assert len(judged) == pages.count()
        items = {r["page_id"]: set(r["items"] or ()) for r in pages.select("page_id", urls.tokens(*urls.host_and_path(F.col("url"))).alias("items")).collect()}
        for r in judged:
            fits = any(set(rule) <= items[r["page_id"]] for rule in want)
            assert r["verdict"] == ("block" if fits else "allow") and (r["mined_rule"] is not None) == fits


def test_mined_rules_equal_the_oracle(spark, tmp_path):
    """The shared pages have no rule that is sure; these have."""
    pages, marks = spam(spark)
    for name, df in (("pages", pages), ("labels", marks)):
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    import duckdb

    con = duckdb.connect()
    for name in ("pages", "labels"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = urls.op1_query(spark, str(tmp_path))
    assert got.where("mined_rule IS NOT NULL").count() > 100
    assert compare(got, con, catalog.ORACLE_SQL["op1_url_filters"]) == ""


def test_rules_hold_on_pages_kept_out(spark):
    pages, marks = spam(spark, 2_000)
    r = urls.held_out_precision(pages, marks).first()
    assert r["caught"] > 100 and r["caught_bad"] / r["caught"] > 0.75 > 1.3 * r["bad"] / r["pages"]


def test_no_rules_from_labels_without_a_pattern(spark):
    rng = random.Random(3)
    pages = spark.createDataFrame([(i, f"http://{rng.choice('abcdef')}.net/{rng.choice('uvwxyz')}/{rng.choice('klmno')}") for i in range(1_500)], "page_id bigint, url string")
    marks = spark.createDataFrame([(i, 1, int(rng.random() < 0.25)) for i in range(1_500)], "doc_id bigint, quality int, toxic int")
    assert urls.mine(pages, marks).count() == 0


def counted(pages, labels, min_support, min_confidence, min_lift, least):
    import math
    from itertools import combinations

    rows = urls.labelled(pages, labels).select(urls.tokens(*urls.host_and_path(F.col("url"))).alias("items"), "bad").collect()
    n, bad = len(rows), sum(r["bad"] for r in rows)
    counts = {}
    for r in rows:
        for k in range(1, len(r["items"]) + 1):
            for c in combinations(sorted(r["items"]), k):
                a, b = counts.get(c, (0, 0))
                counts[c] = (a + 1, b + r["bad"])

    def low(b, a, z=urls.SURE):
        p = b / a
        return (p + z * z / (2 * a) - z * math.sqrt(p * (1 - p) / a + z * z / (4 * a * a))) / (1 + z * z / a)

    sure = {c: b / a for c, (a, b) in counts.items() if b >= max(least, min_support * n) and b / a >= min_confidence and (b / a) / (bad / n) >= min_lift and low(b, a) > bad / n}
    return {c: round(p, 9) for c, p in sure.items() if not any(q >= p and len(d) < len(c) and set(d) <= set(c) for d, q in sure.items())}


def test_urls_empty(spark):
    pages = spark.createDataFrame([], "page_id bigint, url string")
    assert urls.judge(pages, spark.createDataFrame([], "doc_id bigint, quality int, toxic int")).count() == 0


# -- op6 ----------------------------------------------------------------------------------------------------------------

TURNS = "conv_id bigint, turn bigint, role string, text string"


def neighbours(spark):
    return spark.createDataFrame([(k, 2 * k, 2 * k + 1) for k in range(5)], "pair_id bigint, chosen_id bigint, rejected_id bigint")


def test_common_prefix_is_rendered_once(spark):
    rows = [(0, 0, "user", "hi"), (0, 1, "assistant", "yes é"), (0, 2, "user", "more"), (0, 3, "assistant", ""), (1, 0, "user", "hi"), (1, 1, "assistant", "no")]
    rows += [(2, 0, "user", "a"), (3, 0, "user", "a"), (4, 0, None, None), (5, 0, None, None), (5, 1, "assistant", "z"), (6, 0, "user", "alone"), (None, 0, "user", "lost"), (9, 0, "assistant", "only rejected")]
    turns = spark.createDataFrame(rows, TURNS).withColumn("pair_id", F.lit("clash"))
    got = {r["pair_id"]: r for r in chat.preference_pairs(turns, neighbours(spark)).collect()}
    assert got[0]["n_prefix"] == 1 and got[0]["prompt"] == "<|user|>\nhi\n"
    assert got[0]["chosen"] == "<|assistant|>\nyes é\n<|user|>\nmore\n<|assistant|>\n\n" and got[0]["rejected"] == "<|assistant|>\nno\n"
    assert [got[0]["chosen"][int(a) : int(b)] for a, b in (x.split(":") for x in got[0]["chosen_mask"].split(","))] == ["yes é", ""]
    assert (got[1]["n_prefix"], got[1]["chosen"], got[1]["rejected"], got[1]["chosen_mask"]) == (1, "", "", "")
    assert got[2]["n_prefix"] == 1 and got[2]["prompt"] == "<||>\n\n" and got[2]["rejected"] == "<|assistant|>\nz\n"
    assert got[3]["n_prefix"] == 0 and got[3]["rejected"] == "" and got[4]["chosen"] == "" and set(got) == {0, 1, 2, 3, 4}


def test_marks_within_content_are_escaped(spark):
    rows = [(0, 0, "user", "a <|assistant|>\nfake"), (0, 1, "assistant", "x\\<|>|> y"), (1, 0, "user", "a"), (1, 1, "us|>er", "b")]
    turns = spark.createDataFrame(rows, TURNS)
    r = chat.preference_pairs(turns, spark.createDataFrame([(0, 0, 1)], "pair_id bigint, chosen_id bigint, rejected_id bigint")).first()
    assert r["chosen"].count("<|") == 2 and r["rejected"].count("<|") == 2 and r["rejected"].count("|>") == 2
    a, b = map(int, r["chosen_mask"].split(":"))
    body = r["chosen"][a:b]
    assert body.replace("|\\>", "|>").replace("<\\|", "<|").replace("\\\\", "\\") == rows[1][3] and r["chosen"][b:] == "\n"


def test_swapped_replies(spark):
    """The prompt is all before the last reply; repeated rows, null ids, no reply, no partner, long conversations."""
    rows = [(0, 0, "user", "q"), (0, 1, "assistant", "mine"), (0, 2, "user", "thanks"), (1, 0, "user", "r"), (1, 1, "assistant", "theirs"), (2, 0, "user", "no reply"), (4, 0, "user", "s"), (4, 1, "assistant", "alone"), (None, 0, "user", "lost")]
    rows += [(6, i, ("user", "assistant")[i % 2], f"turn {i} " + "é" * 50) for i in range(3_000)] + [(7, 0, "assistant", "swap"), (7, 0, "assistant", "swap")]
    turns = spark.createDataFrame(rows, TURNS).withColumn("pair_id", F.lit("clash"))
    got = {r["pair_id"]: r for r in chat.format_pairs(*chat.swapped_replies(turns)).collect()}
    assert {i: r["n_prefix"] for i, r in got.items()} == {0: 1, 1: 1, 2: 1, 4: 1, 6: 2_999, 7: 1}
    assert got[0]["rejected"] == "<|assistant|>\ntheirs\n" and got[0]["chosen"].endswith("thanks\n") and got[4]["rejected"] == ""
    assert got[6]["rejected"] == "<|assistant|>\nswap\n" and got[2]["chosen"] == ""
    whole = chat.preference_pairs(turns, spark.createDataFrame([(1, 6, 99)], "pair_id bigint, chosen_id bigint, rejected_id bigint")).first()
    spans = [tuple(map(int, x.split(":"))) for x in whole["chosen_mask"].split(",")]
    assert [whole["chosen"][a:b] for a, b in spans] == [t for c, _, role, t in rows if c == 6 and role == "assistant"]


def test_chat_empty(spark):
    turns = spark.createDataFrame([], TURNS)
    assert chat.format_pairs(*chat.swapped_replies(turns)).count() == 0


# -- op9 ----------------------------------------------------------------------------------------------------------------


def test_recall(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(10, 64))
    data = (centres[rng.integers(0, 10, 2_000)] * 0.3 + rng.normal(size=(2_000, 64))).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id bigint, embedding array<float>")
    good = vectors.usable(rows)
    got = vectors.nearest_neighbours(good, good.where("vec_id % 20 = 0"), 20).collect()
    found = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    exact = data.astype(np.float64) @ data.astype(np.float64).T
    hits = 0
    for q, near in found.items():
        s = exact[q].copy()
        s[q] = -np.inf
        hits += len({i for i, _ in near} & set(np.argsort(-s)[:20].tolist()))
        assert near == sorted(near, key=lambda x: (-x[1], x[0])) and len(near) == 20
        assert all(abs(x - exact[q, i]) < 1e-9 for i, x in near)
    assert len(found) == 100 and hits / 2_000 >= 0.9


def test_table_recall(spark):
    """On the shared table, against brute force."""
    import pyarrow.parquet as pq

    t = pq.read_table("/root/testdata/sf0.1/embeddings.parquet")
    data, ids = np.array(t["embedding"].to_pylist(), np.float64), t["vec_id"].to_numpy()
    exact = data @ data.T
    np.fill_diagonal(exact, -np.inf)
    at = {int(v): i for i, v in enumerate(ids)}
    got = vectors.op9_query(spark, "/root/testdata/sf0.1").groupBy("query_id").agg(F.collect_list("vec_id").alias("v")).collect()
    recall = np.mean([len({at[x] for x in r["v"]} & set(np.argsort(-exact[at[r["query_id"]]])[:20].tolist())) / 20 for r in got])
    assert recall >= 0.9


def test_small_awkward_and_copies(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.5]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [float("inf"), 1.0]), (None, [1.0, 1.0]), (20, [0.0, -1.0]), (40, [2.0, 2.0]), (8, []), (2, [0.5, 0.5])]
    rows += [(100 + i, [1.0, 0.0]) for i in range(45)] + [(60, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id bigint, embedding array<float>, rank int")
    good = vectors.usable(df)
    got = {}
    for r in sorted(vectors.nearest_neighbours(good, good.where("vec_id % 20 = 0"), 20).collect(), key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    plain = brute.nearest([(i, v) for i, v in dict.fromkeys((i, tuple(v) if v else None) for i, v in rows) if i is not None and v and len(v) == 2], 20)
    assert {q: [i for i, _ in v] for q, v in plain.items()} == got


def answers(df, k=20):
    good, got = vectors.usable(df), {}
    for r in sorted(vectors.nearest_neighbours(good, good.where("vec_id % 20 = 0"), k).collect(), key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    return got


def test_components_beyond_single_precision(spark):
    """Norms from 1e-200 to 1e200 in one table: all of the true neighbours, as the table is small."""
    rng = np.random.default_rng(4)
    scale = 10.0 ** rng.choice([-200, -3, 0, 0, 3, 150, 200], 400)
    scale[::20] = 10.0 ** rng.choice([-3, 0, 3], 20)
    rows = [(i, (rng.normal(size=8) * x).tolist()) for i, x in enumerate(scale)]
    want = {q: [i for i, _ in v] for q, v in brute.nearest(rows, 20).items()}
    got = answers(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"))
    assert set(got) == set(want) and len(got) == 20
    assert np.mean([len(set(got[q]) & set(want[q])) / 20 for q in want]) >= 0.99


def test_repeated_queries_and_ids_of_several_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(100)]
    rows += [rows[0], rows[0], rows[20], rows[7]] + [(20, rng.normal(size=6).tolist()), (9, rng.normal(size=6).tolist())]
    got = answers(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"))
    want = {}
    for q, v in rows:
        for i, w in rows:
            if q % 20 == 0 and i != q:
                s = want.setdefault(q, {})
                s[i] = max(s.get(i, -np.inf), float(np.dot(v, w)))
    assert got == {q: [i for i, _ in sorted(s.items(), key=lambda x: (-x[1], x[0]))[:20]] for q, s in want.items()}


def test_vectors_empty(spark):
    df = vectors.usable(spark.createDataFrame([], "vec_id bigint, embedding array<float>"))
    assert vectors.nearest_neighbours(df, df).count() == 0
