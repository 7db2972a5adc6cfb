import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.llm import importance as I

from .helpers import empty_docs, labels, nasty_docs, prose, rows_of


def test_weights_against_plain_python():
    ratio = np.random.default_rng(1).normal(size=1 << I.BITS).astype(np.float32)
    texts = ["a b, a a!! C", None, "", " ".join(prose(1, 100)), "... ?? x"]
    kinds = I.features(pa.array(texts))
    for segment in (3, 24):
        got = I.weigh(pa.array(texts), ratio, segment)
        for r in range(len(texts)):
            sums = {}
            for bucket, rows, place in kinds:
                for b, p in zip(bucket[rows == r], place[rows == r]):
                    sums[p // segment] = sums.get(p // segment, 0.0) + float(ratio[b])
            assert got[r] == pytest.approx(min(sums.values(), default=0.0), abs=1e-3)


def test_top_k_is_exact_and_keeps_ties(spark):
    values = [float(x) for x in np.random.default_rng(2).normal(0, 50, 500).round(2)] + [7.5] * 20 + [-1e9, 1e9]
    scored = spark.createDataFrame([(v,) for v in values], "score float")
    for k in (0, 1, 2, 100, 250, len(values), 10 * len(values)):
        kept = [r[0] for r in scored.where(I.top_k(scored, k)).collect()]
        order = sorted(np.float32(values), reverse=True)
        want = [] if k == 0 else [v for v in order if v >= order[min(k, len(order)) - 1]]
        assert sorted(kept, reverse=True) == want
    assert I._place({}, 3) == (-1, 0)


def test_cut_off_parts_the_classes():
    assert I.cut_off(np.array([-5.0, -4, 1, 2]), np.array([False, False, True, True])) == -1.5
    assert I.cut_off(np.array([1.0, 2]), np.array([True, True])) == float("-inf")
    assert I.cut_off(np.array([2.0, 2, 2]), np.array([True, False, True])) in (float("-inf"), float("inf"))


def test_gumbel_noise_is_gumbel_and_fixed(spark):
    d = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit(0.0).alias("log_weight"))
    x = np.array([r[0] for r in d.select(I.gumbel(1.0)).collect()])
    assert abs(x.mean() - 0.5772) < 0.05 and abs(x.var() - np.pi**2 / 6) < 0.1
    assert (x == np.array([r[0] for r in d.select(I.gumbel(1.0)).collect()])).all()


def test_held_out_accuracy(spark):
    """Labels of half the documents are hidden from the fit; most of those are judged right."""
    sf = "/root/testdata/sf0.1"
    docs, known = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    hidden = F.pmod(F.xxhash64("doc_id", F.lit(77)), F.lit(2)) == 0
    out = I.resample(docs, known.where(~hidden)).join(known.where(hidden), "doc_id")
    clean = (F.col("quality") == 1) & (F.col("toxic") == 0)
    share = {r[0]: r[1] for r in out.groupBy(F.when(F.col("quality") == 0, "junk").when(clean, "clean").otherwise("toxic"))
             .agg(F.avg(F.col("kept").cast("int"))).collect()}
    assert share["clean"] > 0.93 and share["junk"] < 0.03 and share["toxic"] < 0.35


def test_awkward_rows_and_labels(spark):
    docs = nasty_docs(spark)
    some = labels(spark, [(0, 1, 0), (1, 1, 0), (2, 0, 0), (4, None, 0), (5, 1, None), (None, 1, 0), (6, 1, 0), (6, 0, 1), (11, 1, 0),
                          (12, 0, 0), (13, 1, 1), (14, 0, 0), (8, 1, 0), (9, 1, 0)])
    out = I.resample(docs, some)
    assert out.count() == docs.count() and out.where("text is null").count() if "text" in out.columns else True
    assert out.where("kept is null or score is null").count() == 0
    left = I.accepted_documents(docs, some)
    assert left.columns == docs.columns and set(rows_of(left, "*")) <= set(rows_of(docs, "*"))
    for none in (labels(spark), labels(spark, [(0, 1, 0), (1, 1, 0)]), labels(spark, [(0, 0, 0)])):
        assert rows_of(I.accepted_documents(docs, none), "*") == rows_of(docs, "*")
    assert I.resample(empty_docs(spark), some).count() == 0 and I.accepted_documents(empty_docs(spark), some).count() == 0


def test_k_is_kept(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    known = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    out = I.resample(docs, known, k=50)
    assert out.where("kept").count() == 50
    assert out.where("kept").agg(F.min("score")).first()[0] >= out.where("not kept").agg(F.max("score")).first()[0]


def test_clean_documents_are_kept_whatever_their_length(spark):
    """Held out, by length class: the weight doesn't fall with length, nor does the share that is kept."""
    sf = "/root/testdata/sf0.1"
    docs, known = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    hidden = F.pmod(F.xxhash64("doc_id", F.lit(77)), F.lit(2)) == 0
    out = I.resample(docs, known.where(~hidden), keep=["doc_id", "text"])
    n = F.size(F.split("text", "[ \\t-\\r]+"))
    seen = (out.join(known.where(hidden).where("quality = 1 and toxic = 0"), "doc_id")
            .groupBy(F.when(n < 100, 0).when(n < 500, 1).when(n < 2000, 2).otherwise(3).alias("size"))
            .agg(F.count("*").alias("n"), F.avg(F.col("kept").cast("int")).alias("kept"), F.median("log_weight").alias("weight"))
            .orderBy("size").collect())
    print(seen)
    assert all(r.kept > 0.95 for r in seen[:3]) and seen[3].kept > 0.8
    assert max(r.weight for r in seen) - min(r.weight for r in seen) < 1.5


def test_a_repeated_id_counts_once(spark):
    docs = spark.createDataFrame([(i, " ".join(prose(i, 40))) for i in range(60)], "doc_id long, text string")
    known = labels(spark, [(i, int(i % 3 > 0), 0) for i in range(60)])
    sample = I.labelled(known)
    held = [r.doc_id for r in sample.where("held").collect()]
    often = docs.unionByName(docs.where(F.col("doc_id").isin(held[:2] + [1, 2, 3])).crossJoin(spark.range(200)).select("doc_id", "text"))
    assert (I.fit(often, sample) == I.fit(docs, sample)).all()
    kept = lambda d: set(rows_of(I.resample(d, known).where("kept"), "doc_id", "log_weight"))
    assert kept(often) == kept(docs)
