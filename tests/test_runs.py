"""The judge, the chain of stages and the layouts of candidates."""

import sys

import pytest
from pyspark import cloudpickle

from sievework.operators import judging, runs
from sievework.sources import programs

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers have no tests folder


def rating():
    def answer(prompt):
        if "broken" in prompt:
            raise RuntimeError("down")
        return 'So:\n```json\n{"correctness": 1, "readability": 0.5, "naming": 0.5, "types": 0}\n```' if "good" in prompt else "no idea"

    return answer


def test_judge(spark):
    pairs = spark.createDataFrame([("b", n, "int f();", n) for n in ("good", "vague", "broken")] + [("b", "none", None, None)], "binary_id string, name string, original string, candidate string")
    got = {r["name"]: r for r in judging.judge(pairs, rating).collect()}
    assert (got["good"]["score"], got["good"]["types"], got["good"]["detail"]) == (0.5, 0.0, "")
    assert got["vague"]["score"] == got["none"]["score"] == 0.0 and got["vague"]["detail"] == "reply is no JSON object"
    assert (got["broken"]["score"], got["broken"]["detail"], got["broken"]["types"]) == (0.0, "RuntimeError: down", None)


def test_header_scores(spark):
    headers = spark.createDataFrame([("p", False, True, 0.5), ("q", False, False, 1.0), ("r", False, True, None), ("s", True, True, 1.0)], "program_id string, failed boolean, parses boolean, judge double")
    kind = "program_id string, name string, ord int, fields array<string>"
    original = spark.createDataFrame([("p", "A", 0, ["x", "y"]), ("p", "B", 1, ["z"]), ("q", "A", 0, ["x"])], kind)
    found = spark.createDataFrame([("p", "T", 0, ["x"])], kind)
    scored = judging.header_scores(headers, original, found)
    got = {r["program_id"]: (r["structs"], round(r["score"], 6)) for r in scored.collect()}
    assert got == {"p": (2, round(0.6 * 0.25 + 0.4 * 0.5, 6)), "q": (1, 0.0), "r": (0, 1.0), "s": (0, 0.0)}
    assert {r["program_id"] for r in judging.header_control(scored).collect()} == {"p", "q", "s"}


def working():
    def answer(prompt):
        if "merge" in prompt:
            return "struct Merged { int x; };"
        code = prompt.rsplit("\n\n", 1)[-1]
        if "refine" in prompt:
            return code.replace("total", "sum") if "Merged" in prompt else "broken("
        if "lost" in code:
            raise RuntimeError("no")
        return code.replace("iVar1", "total") + "\nstruct A { int x; };"

    return answer


def test_chain(spark):
    from sievework.operators.stages import Prompts

    body = "int {0}(int a)\n{{\n  int iVar1 = a;\n  return iVar1;\n}}"
    rows = [("b", "f", body.format("f")), ("b", "g", body.format("g")), ("b", "lost", "int lost(void)\n{\n  return 7;\n}"), ("c", "f", body.format("f"))]
    done, headers = runs.chain(spark.createDataFrame(rows, "binary_id string, name string, code string"), working, Prompts(improve="improve", refine="refine", merge="merge"))
    got = {(r["binary_id"], r["name"]): r for r in done.collect()}
    assert len(got) == 4 and got["b", "g"]["rep"] == "f" and got["c", "f"]["rep"] == "f"
    assert "sum" in got["b", "g"]["refined"] and "total" in got["b", "g"]["improved"]
    assert (got["b", "lost"]["improved"], got["b", "lost"]["refined"]) == (rows[2][2], rows[2][2])
    assert {(r["binary_id"], r["status"]) for r in headers.collect()} == {("b", "ok"), ("c", "ok")}


def test_planned_order(spark):
    outcomes = spark.createDataFrame([("b", "x", "improved"), ("b", "y", "improved"), ("b", "z", "failed"), ("b", "new", "improved")], "binary_id string, name string, status string")
    plan = spark.createDataFrame([("b", "y", 0), ("b", "z", 1), ("b", "x", 2)], "binary_id string, name string, pos int")
    assert {r["name"]: r["turn"] for r in runs.in_planned_order(outcomes, plan).collect()} == {"y": 1, "x": 2, "new": 3, "z": 1}


@pytest.mark.parametrize(
    ("root", "files", "want"),
    [
        ("/out", {"store.cpp": "A", "store.c": "B", "graph/b.c": "C", "graph/sub/a.cpp": "D", "other.cpp": "E"}, {"store": "A", "graph": "D\n\nC"}),
        ("/w/store-O2", {"improved/f.cpp": "A", "improved/a.cpp": "B", "raw/f.cpp": "C"}, {"store": "B\n\nA"}),
        ("/w/graph.exe/improved", {"f.cpp": "A"}, {"graph": "A"}),
        ("/w", {"store-O2/improved/f.cpp": "A", "store-O2/raw/f.cpp": "B", "store-gcc/f.cpp": "C", "graph/readme.md": "D", "tool/f.cpp": "E"}, {"store": "A"}),
        ("/w", {"tool/f.cpp": "E", "store.txt": "F"}, {}),
    ],
)
def test_candidates(spark, root, files, want):
    found = programs.candidates(spark.createDataFrame(list(files.items()), "path string, text string"), spark.createDataFrame([("store",), ("graph",)], "case string"), root)
    assert {r["case"]: r["text"] for r in found.collect()} == want


def test_candidates_of_a_named_case(spark):
    files = spark.createDataFrame([("improved/f.cpp", "A"), ("raw/f.cpp", "B")], "path string, text string")
    none = spark.createDataFrame([], "case string")
    assert [tuple(r) for r in programs.candidates(files, none, "/x", case="store").collect()] == [("store", "A")]
