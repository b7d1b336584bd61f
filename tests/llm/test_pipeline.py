"""The pipeline against its stages done plainly."""

import brute
import corpus_pipeline
from pyspark.sql import functions as F
from test_documents import check_places, corpus
from test_near import leads

from sievework.llm import language, mixing


def test_run(spark, tmp_path):
    docs = corpus(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    rows = [r.asDict() for r in docs.collect()]
    model = language.train(language.learnable(docs.select("doc_id", "text", "lang")))
    ok = {r["doc_id"] for r in language.identify(docs, model).where("lang_pred <> 'und' AND NOT ambiguous").select("row.doc_id").collect()}
    clear = [r for r in rows if r["doc_id"] in ok]
    assert not {200, 201, 202, 203} & ok
    last = {}
    for r in sorted(clear, key=lambda r: r["doc_id"]):
        last[(r["text"] or "").translate(brute.LOWER)] = r
    single = list(last.values())
    lead = leads([(r["doc_id"], r["text"]) for r in single])
    kept = {r["doc_id"] for r in single if lead[r["doc_id"]] == r["doc_id"]}
    taken = {r["row"]["doc_id"]: r["copies"] for r in mixing.mix(docs.where(F.col("doc_id").isin(list(kept)))).collect()}
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {i: n for i, n in taken.items() if n} == {i: sum(1 for r in out if r["doc_id"] == i and r["piece"] == 0) for i in {r["doc_id"] for r in out}}
    check_places(out)


def test_stages_keep_columns(spark, tmp_path):
    docs = corpus(spark)
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns


def test_empty(spark, tmp_path):
    corpus(spark).where("false").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
