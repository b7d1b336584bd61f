"""The parser, identities, resolution and text functions."""

import pytest
from pyspark.sql import functions as F

from sievework.functions import codeparse, identity, text
from sievework.operators import callgraph, gate, naming, resolve, similarity

LONG = "int f(int param_1)\n{\n  int iVar1;\n  iVar1 = param_1 + 1;\n  return iVar1;\n}"


def column(spark, values, expr, name="x"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"{name} string").select(expr).collect()]


def test_scan_kinds_and_calls():
    code = "struct P { int x; int area() { return mul(x, x); } };\nclass C;\nint g;\nlong run(P *p) { if (p) { return ns::go<int>(p->area()); } return 0; }"
    items = codeparse.scan(code)
    assert [(i.kind, i.name) for i in items if i.kind != "declaration"] == [("struct", "P"), ("function", "area"), ("class", "C"), ("function", "run")]
    assert next(i for i in items if i.name == "run").calls == ["ns::go<int>", "p->area"]
    assert next(i for i in items if i.name == "area").calls == ["mul"]
    assert ("declaration", "g") in [(i.kind, i.name) for i in items]
    assert "area" not in [i.name for i in codeparse.scan(code, top_level_only=True)]


@pytest.mark.parametrize(("code", "good"), [(LONG, True), ("", False), ("  \n", False), (LONG[:-1], False), ("Here is the improved code you asked for:\n" + LONG, False), ("struct P { int x; };", True), ("enum E { A, B };", True), ('char *s = "a{b";', True), ("void f() { x(; }", False), ("int f() { return 1 }", False)])
def test_valid(code, good):
    assert codeparse.is_valid(code) is good


def test_complexity_counts_branches():
    m = codeparse.complexity("int f(int a) { for (;;) { if (a && g(a)) return h(a) ? 1 : 2; } do { a--; } while (a); switch (a) { case 1: break; } return 0; }")
    assert m["cyclomatic"] == 1 + 6
    assert m["calls"] == 2


def test_number_forms():
    assert [codeparse.number(x) for x in ("0x2a", "42U", "0x2f", "1.5f")] == ["42", "42", "47", "1.5"]
    assert [codeparse.number(x, compat=True) for x in ("0x2f", "0xff")] == ["2", "0xff"]


@pytest.mark.parametrize(
    ("sig", "key"),
    [
        ("ns::Cls::meth(int, char*) const", ("ns::Cls", "meth", 2, ["int", "char"])),
        ("std::vector<int, std::allocator<int> >::size() const", ("std::vector<int,std::allocator<int>>", "size", 0, [])),
        ("std::string describe(const RunRecord &record)", ("", "describe", 1, ["RunRecord"])),
        ("void f(void)", ("", "f", 0, [])),
        ("T *glued(int)", ("", "glued", 1, ["int"])),
        ("bool ns::operator<(A const&, B)", ("ns", "operator<", 2, ["A", "B"])),
        ("f(unsigned)", ("", "f", 1, [""])),
        ("plain", ("", "plain", -1, [])),
        ("", None),
    ],
)
def test_signature(sig, key):
    assert identity.parse_signature(sig) == key


def test_names(spark):
    assert column(spark, ["visit-00104000", "some-name", "f-00ab12", "A::b(int)-0010"], text.normalize_name(F.col("x"))) == ["visit", "somename", "f", "b"]
    assert column(spark, ["inventory-O2", "inventory-clang-O0", "inventory-O2-852ebd", "hello_world.exe"], text.infer_case(F.col("x"))) == ["inventory"] * 3 + ["hello_world"]
    assert column(spark, ["foo", "`bar_baz`", "void qux(int)", "UNKNOWN", "", "two words()"], text.proposal_of_reply(F.col("x"))) == ["foo", "bar_baz", "qux", None, None, "words"]
    secs = spark.createDataFrame([(0.4,), (42.9,), (92.0,), (4210.0,), (-1.0,)], "s double").select(text.duration(F.col("s")))
    assert [r[0] for r in secs.collect()] == ["0.4s", "42s", "1m32s", "1h10m", "0.0s"]


def test_fingerprint_ignores_name_and_address(spark):
    df = spark.createDataFrame([("aaa_fn-00101000", "void aaa_fn(void)\n{ g(0x00101000); }"), ("bbb_fn-00102000", "void bbb_fn(void) { g(0x00102000); }"), ("ccc_fn-00102000", "void ccc_fn(void) { g(0x10); }")], "n string, c string")
    got = [r[0] for r in df.select(text.body_fingerprint(F.col("n"), F.col("c"))).collect()]
    assert got[0] == got[1] != got[2]


CASES = [
    ("short", "FUN_1", "void FUN_1(void) { }", "short"), ("thunk", "thunk_x", LONG.replace("f(", "thunk_x("), "named_thunk"), ("clean", "total", "int total(int a)\n{\n  int b;\n  b = a;\n  b++;\n  return b;\n}", "named_and_clean"),
    ("kept", "FUN_001", LONG, None), ("std", "std::vector::push_back-0010", LONG, "library"), ("crt", "_start", LONG, "library"), ("named", "f", LONG, None), ("blank", "f", " \n", "blank"),
    ("stub", "f", "// a\nvoid f(int param_1)\n\n{\n\n  halt_baddata();\n\n}\n// b\n", "short"),
    ("forward", "strlen", "int strlen(char *param_1)\n{\n  int iVar1;\n  iVar1 = strlen(param_1);\n  return iVar1;\n}", "forwarding_thunk"),
    ("recursion", "walk", "int walk(int param_1)\n{\n  int iVar1;\n  if (param_1) iVar1 = walk(param_1 - 1);\n  return iVar1;\n}", None),
    ("mine", "Store::add-0010", LONG, None),
]


def test_gate(spark):
    df = spark.createDataFrame([(a, b, c) for a, b, c, _ in CASES], "id string, name string, code string")
    df = df.withColumn("s", codeparse.shape(F.col("code"))).select("*", "s.parsed_name", "s.calls", "s.cyclomatic")
    assert {r["id"]: r["reason"] for r in gate.gate(df).collect()} == {a: r for a, _, _, r in CASES}


def test_callgraph_does_not_guess(spark):
    rows = [
        ("b", "caller-00105000", "int caller(int x) { return helper(x) + size(x) + taskflow::Graph::size(x); }"), ("b", "helper-00104000", "int helper(int x) { return x; }"),
        ("b", "size-00101000", "/* taskflow::Graph::size(int) */\nint size(int x) { return x; }"), ("b", "size-00102000", "/* std::vector<int>::size(int) */\nint size(int x) { return x; }"),
    ]
    edges = callgraph.build(spark.createDataFrame(rows, "binary_id string, name string, code string")).collect()
    assert sorted((r["src"], r["dst"]) for r in edges) == [("caller-00105000", "helper-00104000"), ("caller-00105000", "size-00101000")]


def test_ambiguous(spark):
    f = spark.createDataFrame([("b", "x-1", "A::x", "x", 1), ("b", "x-2", "B::x", "x", 2), ("b", "y", "y", "y", 0)], "binary_id string, name string, qualified string, base string, arity int")
    assert [(r["base"], r["names"]) for r in resolve.ambiguous(f).collect()] == [("x", ["x-1", "x-2"])]


def test_candidates_are_listed_after_calls_are_decided(spark, monkeypatch):
    """Against all pairs one by one: common names, unknown and null arities, exact stems, repeated calls, ways in parts."""
    import random

    rng = random.Random(3)
    pick = lambda *xs: xs[rng.randrange(len(xs))]
    functions = [(pick("b", "c"), f"{base}-{i}", f"{space}::{base}", base, pick(-1, 0, 1, 2, None)) for i, (base, space) in enumerate((pick("f", "f", "f", "g", f"h{k}"), pick("A", "B")) for k in range(120))]
    calls = []
    for i in range(300):
        base, space = pick("f", "f", "g", "h1", "h7", "none"), pick("A", "B", "", None)
        calls.append((i, pick("b", "c"), pick(base, base, f"{base}-{i % 120}"), space, f"{space}::{base}" if space else base, base, pick(-1, -1, 0, 1, 2, 7)))
    calls += calls[:5]
    want = []
    for n, binary, text, space, qualified, base, wanted in calls:
        mine = [f for f in functions if f[0] == binary]
        copies = calls.count((n, binary, text, space, qualified, base, wanted))
        hits = [f for f in mine if f[1] == text]
        if not hits:
            hits = [f for f in mine if (f[2] == qualified if space else f[3] == base)]
            fit = [f for f in hits if f[4] is not None and (f[4] == wanted or space and f[4] == -1)]
            if wanted >= 0 and (space or len(hits) * copies > 1) and fit:
                hits = fit
        want += [(n, f[1]) for f in hits]
    c = spark.createDataFrame(calls, "call_id long, binary_id string, text string, qualifier string, qualified string, base string, arity int")
    f = spark.createDataFrame(functions, "binary_id string, name string, qualified string, base string, arity int")
    for in_parts in (False, True):
        if in_parts:
            monkeypatch.setattr(resolve, "_ROWS_A_PART", 50)
            monkeypatch.setattr(resolve, "_CALLS_A_PART", 2)
        got = resolve.candidates(c, f)
        assert sorted((r["call_id"], r["name"]) for r in got.collect()) == sorted(want)
        assert "Window" not in got._jdf.queryExecution().toString()  # pairs are written out, not sorted and counted
    assert len(want) > 1_000


def test_unique_names(spark):
    assert naming.unique_name("find", {"find", "find_2"}) == "find_3"
    assert [naming.unique_name(x, set()) for x in ("for", "FUN_12", "1x", None)] == [None] * 4
    assert naming.unique_name("f", {"f", *(f"f_{i}" for i in range(2, 100))}) is None


def test_renames_are_whole_words(spark):
    files = spark.createDataFrame([("b", "FUN_1(FUN_12); x.FUN_1;")], "binary_id string, code string")
    renames = spark.createDataFrame([("b", "FUN_1", "go")], "binary_id string, old string, new string")
    assert naming.apply(files, renames).first()["code"] == "go(FUN_12); x.go;"


RAW = 'undefined8 FUN_1(long param_1)\n{\n  int iVar1;\n  iVar1 = *(int *)(param_1 + 0x2a);\n  printf("total %d", iVar1);\n  return 0;\n}'
ORIGINAL = 'void show(const Item &item)\n{\n  int unit_price = item.price(42);\n  printf("total %d", unit_price);\n}'
IMPROVED = 'void show(const Item &item)\n{\n  int unitPrice = item.price(42);\n  printf("total %d", unitPrice);\n}'


def test_similarity_orders(spark):
    df = spark.createDataFrame([("same", ORIGINAL), ("improved", IMPROVED), ("raw", RAW), ("blank", " ")], "k string, c string")
    pairs = df.select("k", codeparse.parsed(F.lit(ORIGINAL)).alias("original"), codeparse.parsed(F.col("c")).alias("candidate"))
    got = {r["k"]: r for r in similarity.compare(pairs).collect()}
    assert got["same"]["overall"] > 0.99
    assert got["improved"]["overall"] > got["raw"]["overall"] + 0.15
    assert got["blank"]["overall"] == 0.0 and got["blank"]["identifier_recovery"] is None
    assert got["improved"]["identifier_recovery"] == 1.0


def test_structs():
    assert codeparse.structs("struct A { int x; char name[8]; void go(int q) { int y; } };\nstruct B;\nclass D { public: long z; };") == [("A", 0, ["go", "name", "x"]), ("D", 1, ["z"])]


def test_long_template_arguments():
    long = "Table<" + ", ".join(f"T{i}" for i in range(400)) + ">"
    (item,) = codeparse.scan(f"void f() {{ {long}::make(1); }}")
    assert [c.replace(" ", "") for c in item.calls] == [f"{long}::make".replace(" ", "")]
