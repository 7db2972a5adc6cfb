"""Bucketed tables, sorted listings and VARIANT metadata."""

import os

import pytest
from pyspark.sql import functions as F

from quire.operators import assemble, store
from quire.sources.layouts import SortedListing, bucketed_table


def documents(spark, n):
    return spark.range(n).select(F.format_string("%05d", (F.col("id") * 7919) % n).alias("file_id"), F.col("id").alias("v"))


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_bucketed_tables_join_and_group_without_an_exchange(spark, scratch, no_broadcast):
    d = bucketed_table(documents(spark, 60), "file_id", os.path.join(scratch, "d"), 4)
    p = bucketed_table(spark.range(200).select(F.format_string("%05d", F.col("id") % 50).alias("document_id"), F.col("id").alias("page_number"),
                                               F.lit("t").alias("content")), "document_id", os.path.join(scratch, "p"), 4)
    j1, j4 = assemble.documents_with_pages(d, p), assemble.pages_with_document(p, d)
    assert j1.count() == 200 + 10 and j4.count() == 200
    for df in (j1, j4, p.groupBy("document_id").count()):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Bucketed: true" in plan and "Exchange" not in plan, plan


@pytest.mark.parametrize("skip,limit", [(0, 10), (95, 30), (990, 100), (1000, 5), (0, 2000), (333, 0)])
def test_sorted_listing_gives_the_same_pages(spark, scratch, skip, limit):
    rows = documents(spark, 1000)
    listing = SortedListing(spark, os.path.join(scratch, "listing")).build(rows, 7)
    assert [n for _, n in listing.counts()] and sum(n for _, n in listing.counts()) == 1000
    want = [r.file_id for r in store.list_documents(rows, skip, limit).collect()]
    assert [r.file_id for r in listing.page(skip, limit).collect()] == want


def test_a_deep_page_reads_its_own_range(spark, scratch):
    listing = SortedListing(spark, os.path.join(scratch, "deep")).build(documents(spark, 2000), 10)
    sizes = dict(listing.counts())
    at = 1_500
    df = listing.page(at, 1)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if "Adaptive" in plan.nodeName() else plan
    leaves = plan.collectLeaves()
    read = sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))
    assert read in sizes.values() and read < 500


def test_variant_metadata_gives_what_text_gives(spark, scratch):
    values = ['{"src":"a","n":1,"x":{"y":2},"b":true,"z":null}', "{}", None, "not json", '{"a.b":"dot","it\'s":"q","c]d":"br","e\\\\f":"bs"}', "[1]"]
    df = spark.createDataFrame([(v,) for v in values], "metadata string")
    path = os.path.join(scratch, "variant")
    store.with_variant_metadata(df.withColumn("text", F.col("metadata"))).write.parquet(path)
    back = spark.read.parquet(path)
    assert dict(back.dtypes)["metadata"] == "variant"
    for key in ("src", "n", "b", "z", "a.b", "it's", "c]d", "nope"):
        got = back.select("text", store.variant_value(F.col("metadata"), key).alias("v")).collect()
        for r in got:
            want = None if r.text in (None, "not json", "[1]") else df.where(F.col("metadata") == r.text).select(
                store.metadata_value(F.col("metadata"), key)).first()[0]
            assert r.v == want, (key, r)
