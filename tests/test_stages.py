"""Stages with a stub provider, state files, sources and the stream."""

import json
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from sievework.operators import callgraph, experiments, stages
from sievework.session import staged
from sievework.sources import functions_dir, programs, state
from sievework.streaming import ingest

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers have no tests folder

FUNCTIONS = "binary_id string, name string, code string"
BODY = "int {0}(int param_1)\n{{\n  int iVar1;\n  iVar1 = {1}(param_1);\n  return iVar1;\n}}"


@pytest.fixture(scope="module")
def chain(spark):
    rows = [("b", "top", BODY.format("top", "mid")), ("b", "mid", BODY.format("mid", "low")), ("b", "low", BODY.format("low", "printf"))]
    return staged(spark.createDataFrame(rows, FUNCTIONS), "chain")


def seeing():
    """Answers with the code; says in a comment which signatures it was shown; fails for mid on demand."""

    def answer(prompt):
        code = prompt.rsplit("\n\n", 1)[-1]
        if "int low" in code:
            return "```cpp\n" + code.replace("low(", "lowest(") + "\n```"
        return code + ("\n// saw callees" if "Callees:" in prompt else "")

    return answer


def failing():
    def answer(prompt):
        if "int mid" in prompt.rsplit("\n\n", 1)[-1]:
            raise RuntimeError("no")
        return "int broken( {" if "int top" in prompt else prompt.rsplit("\n\n", 1)[-1]

    return answer


def todo(df):
    return df.select("binary_id", "name", F.lit(1.0).alias("score"))


def test_callers_see_callees(spark, chain):
    edges = staged(callgraph.build(chain), "calls")
    none = spark.createDataFrame([], "binary_id string, name string, answer string")
    out, symbols = stages.improve(chain, edges, todo(chain), none, seeing)
    got = {r["name"]: r for r in out.collect()}
    assert {n: r["status"] for n, r in got.items()} == {"top": "improved", "mid": "improved", "low": "improved"}
    assert "saw callees" in got["mid"]["answer"] and "saw callees" not in got["low"]["answer"]
    assert {r["original"]: r["new_name"] for r in symbols.collect()}["low"] == "lowest"


def test_failures_are_rows(spark, chain):
    edges = staged(callgraph.build(chain), "calls")
    none = spark.createDataFrame([], "binary_id string, name string, answer string")
    got = {r["name"]: (r["status"], r["answer"]) for r in stages.improve(chain, edges, todo(chain), none, failing)[0].collect()}
    assert got["mid"] == got["top"] == ("failed", None)
    assert got["low"][0] == "improved"
    limited = stages.improve(chain, edges, todo(chain), none, seeing, limit=1)[0].collect()
    assert [r["name"] for r in limited] == ["low"]


def test_refine_keeps_what_fails(spark, chain):
    heads = spark.createDataFrame([("b", "project.h", "struct A { int x; };", "ok", "")], stages.ANSWER)
    context = spark.createDataFrame([], "binary_id string, name string, context string")
    got = {r["name"]: (r["status"], r["code"]) for r in stages.refine(chain, heads, context, failing).collect()}
    assert got["low"][0] == "refined" and got["mid"] == ("kept", BODY.format("mid", "low"))


def test_synthesize(spark):
    files = spark.createDataFrame([("b", "f", "struct A { int x; };"), ("c", "g", "int g() { return 1; }")], "binary_id string, name string, answer string")
    got = stages.synthesize(files, lambda: lambda p: "struct A { int x; };" if "// From f.cpp" in p else "bad {").collect()
    assert [(r["binary_id"], r["status"]) for r in got] == [("b", "ok")]


def named():
    return lambda p: "reads_input" if "printf" in p else ("uses_reads" if "reads_input" in p else "UNKNOWN")


def test_naming_goes_leaves_first(spark):
    rows = [("b", "FUN_0010a0", BODY.format("FUN_0010a0", "FUN_0010b0")), ("b", "FUN_0010b0", BODY.format("FUN_0010b0", "printf"))]
    files = staged(spark.createDataFrame(rows, FUNCTIONS), "files")
    symbols = spark.createDataFrame([], "binary_id string, original string, new_name string, signature string")
    out, renames = stages.name_all(files, staged(callgraph.build(files), "calls"), symbols, named)
    assert {r["old"]: r["new"] for r in renames.collect()} == {"FUN_0010b0": "reads_input", "FUN_0010a0": "uses_reads"}
    assert all("FUN_" not in r["code"] for r in out.collect())


def test_naming_leaves_no_function_out(spark):
    """However many proposals are the same, each placeholder gets a name: numbers go on past 99."""
    from sievework.operators import naming

    n = 250
    stems = [f"FUN_{i:06x}" for i in range(n)]
    files = staged(spark.createDataFrame([("b", s, BODY.format(s, "printf")) for s in stems] + [("b", "taken", "int taken() { return 1; }")], FUNCTIONS), "files")
    symbols = spark.createDataFrame([("b", "taken", "reads_input_120", "")], "binary_id string, original string, new_name string, signature string")
    out, renames = stages.name_all(files, staged(callgraph.build(files), "calls"), symbols, named)
    free = ["reads_input"] + [f"reads_input_{i}" for i in range(2, n + 2) if i != 120]
    assert {r["old"]: r["new"] for r in renames.collect()} == dict(zip(stems, free, strict=True))
    assert all("FUN_" not in r["code"] for r in out.collect())
    assert naming.unique_name("f", {"f", *(f"f_{i}" for i in range(2, 500))}, last=None) == "f_500"
    assert naming.unique_name("for", set(), last=None) is None


def test_renames_cost_a_text_its_own_words(spark):
    """Many renames and texts: no text meets a rename that it has no word of; equal and null texts, unknown binaries."""
    import time

    from sievework.operators import naming

    n, words = 20_000, 60
    renames = spark.range(n).selectExpr("'b' AS binary_id", "concat('FUN_', hex(id)) AS old", "concat('name_', id) AS new").union(spark.createDataFrame([("b", "same", "same"), ("c", "FUN_0", "other")], "binary_id string, old string, new string"))
    text = " + ".join(f"FUN_%1$X({i})" for i in range(words))
    files = spark.range(n + 1).selectExpr("CASE WHEN id = 0 THEN 'd' ELSE 'b' END AS binary_id", "concat('f', id) AS name", f"printf('{text} same XFUN_1', id) AS code")
    few = spark.createDataFrame([("b", "x", "FUN_0;"), ("b", "x", "FUN_0;"), ("b", "null", None), ("c", "y", "FUN_0 FUN_1"), ("b", "empty", "")], "binary_id string, name string, code string")
    began = time.time()
    got = naming.apply(files.union(few), renames)
    assert got.groupBy().count().first()[0] == n + 6
    told = {(r["binary_id"], r["name"]): r["code"] for r in got.where(f"name IN ('x', 'null', 'y', 'empty', 'f0', 'f9', 'f{n}')").collect()}
    assert told[("b", "x")] == "name_0;" and told[("b", "null")] is None and told[("c", "y")] == "other FUN_1" and told[("b", "empty")] == ""
    assert told[("b", "f9")] == " + ".join(f"name_9({i})" for i in range(words)) + " same XFUN_1"
    assert told[("d", "f0")].startswith("FUN_0(0)") and f"FUN_{n:X}(0)" in told[("b", f"f{n}")]
    changed = got.where("contains(code, 'name_')").count()
    assert changed == n - 1 + 2 and time.time() - began < 60


def test_taken_numbers_are_tried_once(spark):
    """Each next name is the first free one, also where numbers are taken, up to 99."""
    from sievework.operators import naming

    proposals = spark.createDataFrame([("b", f"FUN_{i:04x}", "name" if i % 2 else "int", i) for i in range(300)] + [("b", "FUN_ffff", "name_3", 400)], "binary_id string, old string, proposal string, pos int")
    taken = spark.createDataFrame([("b", "name_2"), ("b", "name_50")], "binary_id string, name string")
    used, want = {"name_2", "name_50"}, []
    for i in range(1, 300, 2):
        new = naming.unique_name("name", used)
        used |= {new} - {None}
        want += [(f"FUN_{i:04x}", new)] if new else []
    assert sorted((r["old"], r["new"]) for r in naming.assign(proposals, taken).collect()) == sorted([*want, ("FUN_ffff", "name_3_2")]) and len(want) == 97


def test_state(spark, tmp_path):
    (tmp_path / "ok.json").write_text(json.dumps([{"timestamp": "t", "stage": "s", "model": "m", "improved": 3}]))
    (tmp_path / "bad.json").write_text("{not json")
    assert [r["improved"] for r in state.runs(spark, str(tmp_path / "ok.json")).collect()] == [3]
    assert state.runs(spark, str(tmp_path / "bad.json")).count() == 0
    (tmp_path / "flat.json").write_text(json.dumps({"a": "b"}))
    (tmp_path / "names.json").write_text(json.dumps({"functions": {"a": "b"}, "files": {"c": "d"}}))
    assert [tuple(r) for r in state.names(spark, str(tmp_path / "flat.json")).collect()] == [("functions", "a", "b")]
    assert sorted(tuple(r) for r in state.names(spark, str(tmp_path / "names.json")).collect()) == [("files", "c", "d"), ("functions", "a", "b")]
    assert state.names(spark, str(tmp_path / "bad.json")).count() == 0


def test_sources(spark, tmp_path):
    d = tmp_path / "decomps"
    d.mkdir()
    (d / "f-0010.c").write_bytes(b"int f()\r\n{ }\n")
    (d / "g[abi").write_bytes(b"")
    got = functions_dir.read_functions(spark, str(d), "b").collect()
    assert [(r["name"], r["code"]) for r in got] == [("f-0010", "int f()\n{ }\n")]
    assert functions_dir.lost_files(spark, str(d)).count() == 1
    rows = [("p", "b.cpp", False, "b.cpp", "B"), ("p", "a.h", True, "z/a.h", "A"), ("q", "q.cpp", False, "q.cpp", "Q")]
    a = programs.assembled(spark.createDataFrame(rows, "id string, name string, is_header boolean, path string, text string"))
    assert {r["id"]: r["source"] for r in programs.source_of(a).collect()} == {"p": "// ===== a.h =====\nA\n// ===== b.cpp =====\nB", "q": "Q"}
    entries = [{"id": "x", "tier": 1, "path": "x.cpp"}, {"id": "y", "tier": 2, "path": "y"}]
    assert [r["id"] for r in programs.manifest(spark, entries, tier=2, ids=["x", "y"]).collect()] == ["y"]
    blobs = programs.blobs(spark.createDataFrame([("k", "b.c", "3"), ("k", "z.cpp", "1"), ("k", "a.cc", "2")], "case string, path string, text string"))
    assert blobs.first()["text"] == "1\n\n2\n\n3"
    names = spark.createDataFrame([("Store-O2",), ("other",)], "name string")
    assert {r["name"]: r["case"] for r in programs.inferred(names, spark.createDataFrame([("store",)], "case string")).collect()} == {"Store-O2": "store", "other": None}


def test_stream_admits_each_function_once(spark, tmp_path):
    folder, table = tmp_path / "in" / "bin1", str(tmp_path / "table")
    folder.mkdir(parents=True)
    (folder / "f.c").write_text("int f() { }")
    for n in range(2):
        q = ingest.watch(spark, str(tmp_path / "in"), table, str(tmp_path / f"check{n}")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert [(r["binary_id"], r["name"]) for r in spark.read.parquet(table).collect()] == [("bin1", "f")]


def test_split_is_stable(spark):
    rows = spark.createDataFrame([("p", f"f{i}") for i in range(10)], "program_id string, name string")
    first, again = (sorted(map(tuple, experiments.split(rows, 0.3).collect())) for _ in range(2))
    assert first == again and sum(r[-1] == "val" for r in first) == 3


def test_means_halfway_do_not_depend_on_order(spark, tmp_path):
    """Means of 64 scores that lie halfway between two sixth decimals: rounded up, whatever a sum of doubles makes of them."""
    import random
    from decimal import ROUND_HALF_UP, Decimal

    from pyspark.sql import functions as F

    from sievework.plans import catalog

    rows, want = [], {}
    for seed in (0, 2, 3, 10, 11, 13, 16):
        rng = random.Random(seed)
        tenths = [rng.randrange(0, 11) for _ in range(64)]
        want[f"s{seed}"] = float((Decimal(sum(tenths)) / 640).quantize(Decimal("0.000001"), ROUND_HALF_UP))
        rows += [(seed, part, t / 100) for part, t in enumerate(tenths)]
    for folder, turn in (("there", 1), ("back", -1)):
        spark.createDataFrame(rows[::turn], "l_suppkey bigint, l_partkey bigint, l_discount double").coalesce(1).write.parquet(str(tmp_path / folder / "lineitem.parquet"))
        got = {r["candidate"]: r["rank"] for r in catalog.QUERIES["e_leaderboard"](spark, str(tmp_path / folder)).collect()}
        assert got == {c: i for i, c in enumerate(sorted(want, key=lambda c: (-want[c] if not c.endswith("7") else 1, c)), 1)}
        assert {r["candidate"]: r["mean"] for r in catalog._means(spark, str(tmp_path / folder)).collect()} == want
    odd = [("none", None), ("nan", float("nan")), ("nan", 0.5), ("minus", -0.5), ("minus", -0.25), ("some", None), ("some", 0.5), ("far", 1e300)]
    means = spark.createDataFrame(odd, "c string, score double").groupBy("c").agg(experiments.mean(F.col("score"), 4, 6).alias("m")).collect()
    assert {r["c"]: str(r["m"]) for r in means} == {"none": "None", "nan": "nan", "minus": "-0.375", "some": "0.5", "far": "1e+300"}


def test_groups_keep_null_keys_and_equal_names(spark):
    """Null is a group; two groups whose representatives share a name stay apart; a repeated row is one representative."""
    from sievework.operators import dedup

    rows = spark.createDataFrame([("x", 1, "f"), ("y", 2, "f"), (None, 3, "f"), (None, 4, "g"), ("x", 5, "h"), ("x", 1, "f")], "k string, o int, n string")
    assert sorted((r["k"] or "", r["o"], r["rep"], r["members"]) for r in dedup.groups(rows, "k", "o", "n").collect()) == [("", 3, "f", 2), ("", 4, "f", 2), ("x", 1, "f", 3), ("x", 1, "f", 3), ("x", 5, "f", 3), ("y", 2, "f", 1)]
    asked = []

    def apply(reps):
        asked.append(reps.count())
        return reps.selectExpr("k", "n", "coalesce(k, 'null') AS result")

    got = sorted((r["k"] or "", r["o"], r["result"]) for r in dedup.fan_out(rows, "k", "o", "n", apply).collect())
    assert got == [("", 3, "null"), ("", 4, "null"), ("x", 1, "x"), ("x", 1, "x"), ("x", 5, "x"), ("y", 2, "y")] and asked == [3]


def test_stream_names_binaries_by_the_first_folder(spark, tmp_path):
    for path in ("in/alpha/one.c", "in/alpha/deep/two.c", "in/beta/in/three.c"):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text("int f(void) { return 1; }")
    table = str(tmp_path / "table")
    ingest.watch(spark, str(tmp_path / "in"), table, str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    assert sorted((r["binary_id"], r["name"]) for r in spark.read.parquet(table).collect()) == [("alpha", "one"), ("alpha", "two"), ("beta", "three")]
