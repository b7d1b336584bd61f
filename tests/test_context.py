"""Context, datasets and the prompt search."""

from sievework.operators import context, optimize

SOURCE = "struct A { int x; };\nstruct B { int y; };\nint low(int v) { return v; }\nint low(long v) { return 2; }\nint top(A *a) { return low(a->x); }\nint main() { return top(0); }"


def make(spark):
    sources = spark.createDataFrame([("p", SOURCE)], "program_id string, code string")
    rows = [("p", "top-0010", "int top(A *param_1) { return low(*param_1); }", "int top(A *a) { return low(a->x); }")]
    return sources, spark.createDataFrame(rows, "program_id string, name string, code string, original string")


def test_contexts(spark):
    sources, ex = make(spark)
    static = context.static_context(ex, sources).first()["context"]
    assert "struct A" in static and "struct B" not in static and "int low(int v);" in static and "int low(long v);" in static and "int top" not in static
    types, sigs = context.distractors(5)
    full = context.full_context(ex, sources, types, sigs).first()["context"]
    assert "struct B" in full and "Spare4" in full and "int main();" in full and "int top" not in full
    assert context.distractors(5) == (types, sigs) != context.distractors(5, seed=1)
    assert context.levels("0,20, 80") == [0, 20, 80] and context.levels("") == [0]


def test_examples_pair_by_identity(spark):
    sources, ex = make(spark)
    names = sorted(r["name"] for r in context.originals(sources).collect())
    assert names == ["low", "low#::low(1:long)", "main", "top"]
    got = context.examples(ex.drop("original"), sources).collect()
    assert [(r["name"], r["original"]) for r in got] == [("top-0010", "int top(A *a) { return low(a->x); }")]


def test_search_keeps_the_best():
    long = " and say why each step is taken"
    best, tried = optimize.search("seed prompt", lambda p: {"a": min(1.0, len(p) / 200), "b": 0.5}, lambda p, cases, k: [p + long, "short"], rounds=3)
    assert best.score == max(c.score for c in tried) and best.name != "seed" and all(len(c.prompt) > 40 for c in tried[1:])


def test_evaluate_asks_once(spark):
    ex = spark.createDataFrame([("p", "f"), ("p", "g")], "program_id string, name string")
    cache = spark.createDataFrame([("q", "p", "f", 0.25)], "prompt_id string, program_id string, name string, score double")
    asked = []

    def score(df):
        asked.extend(r["name"] for r in df.collect())
        return df.selectExpr("program_id", "name", "1.0D AS score")

    got = {r["name"]: r["score"] for r in optimize.evaluate(ex, "q", cache, score).collect()}
    assert got == {"f": 0.25, "g": 1.0} and asked == ["g"]
