import corpus_pipeline
from pyspark.sql import functions as F

from quire.llm.common import written
from quire.llm.queries import ORACLE, QUERIES

from .helpers import nasty_docs, prose, rows_of

SF = "/root/testdata/sf0.01"


def test_stages_in_order_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_duplicates", "benchmark_decontamination", "pack_sequences"]
    left = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, SF), name)
        assert docs.columns == columns
        now = {r.doc_id for r in docs.select("doc_id").collect()}
        assert now <= ids
        ids = now
        left.append(docs.count())
    assert left == sorted(left, reverse=True) and left[0] < 1000 and left[-1] < left[-2] < left[-3]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == ids
    known = spark.read.parquet(f"{SF}/labels.parquet")
    kept = docs.join(known, "doc_id")
    assert kept.where("quality = 0").count() == 0
    clean = known.where("quality = 1 and toxic = 0")
    assert kept.where("toxic = 0").count() > 0.85 * clean.count()


def test_stages_take_awkward_documents(spark):
    """Extra columns with operators' own names; null, empty and long texts; repeated rows."""
    for name, stage in corpus_pipeline.STAGES:
        docs = nasty_docs(spark)
        out = stage(spark, docs, SF)
        if name == "pack_sequences":
            assert out.count() > docs.count() and out.where("length > 2048").count() == 0
        else:
            assert out.columns == docs.columns and set(rows_of(out, "doc_id")) <= set(rows_of(docs, "doc_id"))
        none = stage(spark, docs.limit(0), SF)
        assert none.columns == out.columns and none.count() == 0


def test_every_operator_is_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14)) and set(ORACLE) <= set(QUERIES)


def test_run_returns_pieces(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.agg(F.min("offset")).first()[0] == 0 and out.count() > 0


def test_one_of_a_group_of_copies_is_left(spark):
    texts = ["\n".join(" ".join(prose(900 * g + i, (50, 3, 45, 2, 8, 9)[(i + g) % 6])) for i in range(g + 1)) for g in range(10)]
    docs = spark.createDataFrame([(10 * g + k, t, len(t)) for g, t in enumerate(texts) for k in range(4)],
                                 "doc_id long, text string, n_chars long")
    for stage in (corpus_pipeline.line_dedup, corpus_pipeline.near_duplicates):
        docs = written(stage(spark, docs, SF), "stage")
    left = {r.doc_id: r.text for r in docs.collect()}
    assert sorted(d // 10 for d in left) == list(range(10)) and all(left[d] == texts[d // 10] for d in left)
