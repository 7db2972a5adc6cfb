import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from quire.operators import assemble, checks, store
from quire.sources.docstore import DocumentStore

NOW = "2024-06-01 00:00:00"
T0 = dt.datetime(2024, 1, 1)


def docs(spark, rows):
    return spark.createDataFrame([(n, n, T0, T0, m) for n, m in rows],
                                 "file_id string, file_name string, created_at timestamp_ntz, "
                                 "updated_at timestamp_ntz, metadata string")


def pages(spark, rows):
    return spark.createDataFrame(rows, "document_id string, page_number long, content string")


def test_upsert_documents_new_existing_and_repeated(spark):
    stored = docs(spark, [("a", '{"src":"s"}'), ("b", '{"src":"s"}')])
    incoming = spark.createDataFrame([("a", '{"run":"r2"}', 1), ("c", None, 1), ("d", '{"k":1}', 1),
                                      ("d", '{"k":2}', 2)], "file_name string, metadata string, seq long")
    out = {r.file_name: r for r in store.upsert_documents(stored, incoming, NOW, seq="seq").collect()}
    now = dt.datetime(2024, 6, 1)
    assert out["a"].created_at == T0 and out["a"].updated_at == now
    assert out["a"].metadata == '{"run":"r2","overwrite":true}'
    assert out["b"].updated_at == T0 and out["b"].metadata == '{"src":"s"}'
    assert (out["c"].file_id, out["c"].created_at, out["c"].metadata) == ("c", now, "{}")
    assert out["d"].metadata == '{"k":2,"overwrite":true}'  # repeated in the batch: last wins, overwritten


def test_upsert_twice_same_pages(spark):
    stored = pages(spark, [("a", 1, "old"), ("a", 2, "old2"), ("b", 1, "keep")])
    incoming = pages(spark, [("a", 1, "new")])
    arriving = spark.createDataFrame([("a",), ("c",)], "file_id string")
    once = store.upsert_pages(stored, incoming, arriving)
    twice = store.upsert_pages(once, incoming, arriving)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == \
        [("a", 1, "new", "{}"), ("b", 1, "keep", "{}")]


def test_an_emptied_document_loses_its_pages_and_metadata_is_kept(spark):
    stored = spark.createDataFrame([("a", 1, "old", '{"x":1}'), ("b", 1, "keep", '{"y":2}')],
                                   "document_id string, page_number long, content string, metadata string")
    none = stored.limit(0)
    got = store.upsert_pages(stored, none, spark.createDataFrame([("a",)], "file_id string"))
    assert [tuple(r) for r in got.collect()] == [("b", 1, "keep", '{"y":2}')]
    ups = spark.createDataFrame([("a", 1, "n", None), ("b", 1, "m", '{"z":3}')],
                                "document_id string, page_number long, content string, metadata string")
    assert sorted(map(tuple, store.update_pages(stored, ups).collect())) == [("a", 1, "n", '{"x":1}'), ("b", 1, "m", '{"z":3}')]


def test_a_repeated_key_never_makes_two_rows(spark):
    stored = docs(spark, [("a", "{}")])
    twice = spark.createDataFrame([("a", '{"k":1}'), ("a", '{"k":2}'), ("b", None), ("b", None)], "file_name string, metadata string")
    out = {r.file_name: r.metadata for r in store.upsert_documents(stored, twice, NOW).collect()}
    assert len(store.upsert_documents(stored, twice, NOW).collect()) == 2 and out["a"] == '{"k":2,"overwrite":true}'
    saved = store.save_documents(stored, store.new_documents(twice, NOW))
    assert sorted(r.file_id for r in saved.collect()) == ["a", "b"]
    p = pages(spark, [("a", 1, "x")])
    ups = pages(spark, [("a", 1, "u"), ("a", 1, "v")])
    assert [tuple(r) for r in store.update_pages(p, ups).collect()] == [("a", 1, "v", "{}")]


def test_the_first_of_several_pages_is_taken(spark):
    p = spark.createDataFrame([("a", 1, "late", 2), ("a", 1, "early", 1), ("b", 1, "x", 1)],
                              "document_id string, page_number long, content string, seq long")
    keys = spark.createDataFrame([("a", 1), ("a", 1), ("c", 1)], "document_id string, page_number long")
    got = sorted((r.document_id, r.content) for r in store.get_pages(p, keys, order="seq").collect())
    assert got == [("a", "early"), ("a", "early"), ("c", None)]
    assert {r.content for r in store.get_pages(p, keys).collect()} == {"early", None}


def test_listing_goes_on_behind_a_key(spark):
    stored = docs(spark, [(f"d{i:02}", "{}") for i in range(30)])
    first = [r.file_id for r in store.list_documents(stored, 0, 10).collect()]
    assert [r.file_id for r in store.list_documents(stored, 0, 10, after=first[-1]).collect()] == [
        r.file_id for r in store.list_documents(stored, 10, 10).collect()]


def test_metadata_keys_of_any_characters(spark):
    row = spark.createDataFrame([('{"a.b":"1","it\'s":"2","x":{"y":3},"[0]":"4","p":"5"}',)], "m string")
    got = row.select(*(store.metadata_value(F.col("m"), k).alias(f"c{i}") for i, k in enumerate(["a.b", "it's", "[0]", "p", "none", "x.y"])))
    assert tuple(got.first()) == ("1", "2", "4", "5", None, None)


def test_save_by_key_incoming_wins(spark):
    stored = docs(spark, [("a", "{}"), ("b", "{}")])
    incoming = store.new_documents(spark.createDataFrame([("a", '{"x":1}')], "file_name string, metadata string"), NOW)
    got = {r.file_id: r.metadata for r in store.save_documents(stored, incoming).collect()}
    assert got == {"a": '{"x":1}', "b": "{}"}


def test_update_page_missing_document_and_page(spark):
    stored_pages = pages(spark, [("a", 1, "p1"), ("a", 2, "p2")])
    stored_docs = docs(spark, [("a", "{}"), ("b", "{}")])
    ups = pages(spark, [("a", 2, "fixed"), ("a", 9, "nope"), ("zz", 1, "nope")])
    assert sorted(map(tuple, store.update_pages(stored_pages, ups).collect())) == [
        ("a", 1, "p1", "{}"), ("a", 2, "fixed", "{}")]
    flags = {(r.document_id, r.page_number): r.updated for r in store.update_flags(stored_pages, ups).collect()}
    assert flags == {("a", 2): True, ("a", 9): False, ("zz", 1): False}
    touched = {r.file_id: r.updated_at for r in store.touch_documents(stored_docs, stored_pages, ups, NOW).collect()}
    assert touched == {"a": dt.datetime(2024, 6, 1), "b": T0}


def test_delete_and_lookups(spark):
    stored = docs(spark, [("a", "{}"), ("b", "{}")])
    stored_pages = pages(spark, [("a", 1, "x"), ("b", 1, "y"), ("b", 2, "z")])
    keys = spark.createDataFrame([("b",), ("nope",), ("b",)], "file_id string")
    assert [r.file_id for r in store.delete_documents(stored, keys).collect()] == ["a"]
    assert [tuple(r) for r in store.delete_cascade_pages(stored_pages, keys).collect()] == [("a", 1, "x")]
    assert {r.file_id: r.deleted for r in store.delete_flags(stored, keys).collect()} == {"b": True, "nope": False}
    listed = [tuple(r) for r in store.list_pages(stored_pages, keys).collect()]
    assert listed == [("b", 1, "y"), ("b", 2, "z")]
    found = {r.key: r.file_name for r in store.get_documents(stored, keys.distinct()).collect()}
    assert found == {"b": "b", "nope": None}


def test_nest_unnest_round_trip_keeps_every_page(spark):
    p = pages(spark, [("a", 2, "two"), ("a", 1, "one"), ("b", 1, None)])
    nested = assemble.nest_pages(p)
    assert sorted(map(tuple, assemble.unnest_pages(nested).collect()), key=str) == \
        sorted(map(tuple, p.collect()), key=str)
    text = {r.file_id: (r.n_pages, r.n_failed_pages, r.text) for r in
            assemble.document_text(p.withColumnRenamed("document_id", "file_id")).collect()}
    assert text == {"a": (2, 0, "one\ntwo"), "b": (1, 1, "")}


def test_checks(spark):
    d = spark.createDataFrame([("1", "x"), ("1", "y"), ("2", None), ("3", None)], "file_id string, file_name string")
    assert [tuple(r) for r in checks.duplicates(d, "file_id").collect()] == [("1", 2)]
    assert checks.duplicates(d, "file_name").count() == 0
    nulls = {r.column: r.n for r in checks.null_counts(d, ["file_id", "file_name"], "documents").collect()}
    assert nulls == {"file_id": 0, "file_name": 2}
    status = spark.createDataFrame([("db", T0, True), ("db", dt.datetime(2024, 2, 1), None), ("llm", T0, True)],
                                   "component string, ts timestamp_ntz, healthy boolean")
    r = checks.health_rollup(status).first()
    assert (r.n_components, r.n_unhealthy, r.healthy, r.status) == (2, 1, False, "degraded")


def doc_rows(spark, rows):
    return spark.createDataFrame(rows, "file_name string, metadata string")


def page_rows(spark, rows):
    return spark.createDataFrame(rows, "file_name string, page_number long, content string")


def stored_pages(kept):
    return sorted((r.document_id, r.page_number, r.content) for r in kept.pages().collect())


def test_store_round_trip_and_idempotence(spark, scratch):
    kept = DocumentStore(spark, os.path.join(scratch, "store"))
    assert kept.documents().count() == kept.pages().count() == 0
    inc = doc_rows(spark, [("a", None), ("b", '{"m":1}')])
    inc_pages = page_rows(spark, [("a", 1, "a1"), ("a", 2, "a2"), ("b", 1, "b1")])
    assert kept.upsert(inc, inc_pages, NOW, writer="w", commit=0) is True
    assert kept.upsert(inc, inc_pages, NOW, writer="w", commit=0) is False  # replayed: no second effect
    assert kept.upsert(doc_rows(spark, [("a", None)]), page_rows(spark, [("a", 1, "new")]), "2024-07-01 00:00:00", writer="w", commit=1)
    cur = {r.file_name: r for r in kept.documents().collect()}
    assert cur["a"].created_at == dt.datetime(2024, 6, 1) and cur["a"].updated_at == dt.datetime(2024, 7, 1)
    assert cur["a"].metadata == '{"overwrite":true}' and cur["b"].metadata == '{"m":1}'
    assert stored_pages(kept) == [("a", 1, "new"), ("b", 1, "b1")]
    assert kept.delete(spark.createDataFrame([("b",)], "file_id string"))
    assert [r.file_name for r in kept.documents().collect()] == ["a"] and stored_pages(kept) == [("a", 1, "new")]
    assert kept.compact() and len(kept.state()["pages"]) == 1
    assert stored_pages(kept) == [("a", 1, "new")]
    assert kept.upsert(doc_rows(spark, [("c", None)]), page_rows(spark, [("c", 1, "c1")]), "2024-08-01 00:00:00", writer="v", commit=0)
    assert sorted(r.file_name for r in kept.documents().collect()) == ["a", "c"]
    assert stored_pages(kept) == [("a", 1, "new"), ("c", 1, "c1")]
    assert kept.upsert(doc_rows(spark, [("a", None)]), page_rows(spark, []), NOW)  # emptied
    assert stored_pages(kept) == [("c", 1, "c1")]


def test_a_reader_keeps_its_version_and_a_lost_file_is_an_error(spark, scratch):
    root = os.path.join(scratch, "store_view")
    kept = DocumentStore(spark, root)
    kept.upsert(doc_rows(spark, [("a", None)]), page_rows(spark, [("a", 1, "one")]), NOW)
    before = kept.documents()
    kept.delete(spark.createDataFrame([("a",)], "file_id string"))
    assert before.count() == 1 and kept.documents().count() == 0
    kept.upsert(doc_rows(spark, [("b", None)]), page_rows(spark, [("b", 1, "two")]), NOW)
    pages_before = kept.pages()
    gone = next(os.path.join(d, f) for d, _, names in os.walk(os.path.join(
        root.removeprefix("file:"), "pages", f"w={kept.state()['pages'][-1]}")) for f in names if f.endswith(".parquet"))
    os.remove(gone)
    with pytest.raises(Exception):
        pages_before.collect()


def folders(root, kind):
    path = os.path.join(root.removeprefix("file:"), kind)
    return sorted(os.listdir(path)) if os.path.isdir(path) else []


def test_a_crashed_write_is_invisible_and_goes_with_vacuum(spark, scratch):
    root = os.path.join(scratch, "store_crash")
    kept = DocumentStore(spark, root)
    # a crashed attempt: documents and pages written, commit missing
    docs(spark, [("zombie", "{}")]).write.parquet(os.path.join(root, "documents", "w=dead", "created_date=2024-01-01"))
    pages(spark, [("zombie", 1, "half")]).write.parquet(os.path.join(root, "pages", "w=dead"))
    assert kept.documents().count() == 0 and kept.pages().count() == 0
    assert kept.upsert(doc_rows(spark, [("a", None)]), page_rows(spark, [("a", 1, "good")]), NOW)
    assert [r.file_name for r in kept.documents().collect()] == ["a"] and stored_pages(kept) == [("a", 1, "good")]
    assert kept.vacuum() == 0 and kept.vacuum(older_than_hours=-1) == 2
    assert "w=dead" not in folders(root, "documents") + folders(root, "pages")
    assert stored_pages(kept) == [("a", 1, "good")]


@pytest.mark.parametrize("first", ["upsert", "delete", "update_pages"])
def test_of_two_writes_at_once_one_wins_and_nothing_of_it_is_lost(spark, scratch, first):
    root = os.path.join(scratch, f"store_race_{first}")
    one, other = DocumentStore(spark, root), DocumentStore(spark, root)
    one.upsert(doc_rows(spark, [("base", None)]), page_rows(spark, [("base", 1, "b")]), NOW)

    writes = {"upsert": lambda s: s.upsert(doc_rows(spark, [("a.png", None)]), page_rows(spark, [("a.png", 1, "A")]), NOW),
              "delete": lambda s: s.delete(spark.createDataFrame([("base",)], "file_id string")),
              "update_pages": lambda s: s.update_pages(pages(spark, [("base", 1, "new")]), "2024-07-01 00:00:00")}
    before = other.state()
    assert writes[first](one)
    want = names_and_pages(one)
    other.state = lambda: before
    for name in sorted(writes):
        with pytest.raises(RuntimeError, match="in between"):
            writes[name](other)
    del other.state
    assert names_and_pages(one) == names_and_pages(other) == want
    assert len(folders(root, "documents")) <= 2 and writes["upsert"](other)
    assert "a.png" in names_and_pages(one)[0]


def names_and_pages(kept):
    return sorted(r.file_name for r in kept.documents().collect()), stored_pages(kept)


def test_days_that_a_write_does_not_touch_stay_and_old_folders_go(spark, scratch):
    root = os.path.join(scratch, "store_days")
    kept = DocumentStore(spark, root)
    kept.upsert(doc_rows(spark, [("a", None), ("b", None)]), page_rows(spark, [("a", 1, "a"), ("b", 1, "b")]), "2024-01-01 00:00:00")
    first = kept.state()["days"]["2024-01-01"]
    for k in range(12):
        kept.upsert(doc_rows(spark, [(f"c{k % 2}", None)]), page_rows(spark, [(f"c{k % 2}", 1, str(k))]), "2024-02-01 00:00:00")
    state = kept.state()
    assert state["days"]["2024-01-01"] == first and set(state["days"]) == {"2024-01-01", "2024-02-01"}
    assert names_and_pages(kept) == (["a", "b", "c0", "c1"], [("a", 1, "a"), ("b", 1, "b"), ("c0", 1, "10"), ("c1", 1, "11")])
    assert len(folders(root, "commits")) <= 2 * 10 + 2  # with the checksums that a local file system keeps
    live = [f for f in folders(root, "documents") if os.listdir(os.path.join(root.removeprefix("file:"), "documents", f)) and any(
        "created_date" in x for x in os.listdir(os.path.join(root.removeprefix("file:"), "documents", f)))]
    assert len(live) <= 11
    kept.upsert(doc_rows(spark, [("a", None)]), page_rows(spark, [("a", 1, "again")]), "2024-03-01 00:00:00")
    assert kept.state()["days"]["2024-01-01"] != first and kept.state()["days"]["2024-02-01"] == state["days"]["2024-02-01"]
    kept.delete(spark.createDataFrame([("c0",), ("c1",)], "file_id string"))
    assert set(kept.state()["days"]) == {"2024-01-01"}  # a day without documents is gone
    assert kept.compact() and names_and_pages(kept) == (["a", "b"], [("a", 1, "again"), ("b", 1, "b")])


def test_a_write_that_breaks_a_constraint_leaves_the_store_as_it_was(spark, scratch):
    from quire.sources.docstore import ConstraintViolation

    root = os.path.join(scratch, "store_checks")
    kept = DocumentStore(spark, root)
    kept.upsert(doc_rows(spark, [("a", None)]), page_rows(spark, [("a", 1, "a")]), NOW)
    before, want = kept.state(), names_and_pages(kept)
    for documents, given, what in (
            ([("b", None)], [("b", 1, "x"), ("b", 1, "y")], "pages: 2 repeated keys"),
            ([("b", None)], [("b", None, "x")], "pages: 1 null page_number"),
            ([(None, None)], [], "documents: 1 null file_id; documents: 1 null file_name"),
    ):
        with pytest.raises(ConstraintViolation, match=what):
            kept.upsert(doc_rows(spark, documents), page_rows(spark, given), NOW)
        assert kept.state() == before and names_and_pages(kept) == want
    assert len(folders(root, "pages")) == len(folders(root, "documents")) == 1  # what was written for them is gone
    # a stored document whose id is another's name: saving that name would make the id twice
    other = DocumentStore(spark, os.path.join(scratch, "store_checks_2"))
    other.upsert(doc_rows(spark, [("x", None)]), page_rows(spark, []), "2024-01-01 00:00:00")
    state = other.state()
    other._write(state, sorted(state["days"]), other._documents(state).withColumn("file_name", F.lit("renamed")), F.lit(False), None)
    with pytest.raises(ConstraintViolation, match="documents: 2 repeated keys"):
        other.upsert(doc_rows(spark, [("x", None)]), page_rows(spark, []), "2024-05-01 00:00:00")
    assert [r.file_name for r in other.documents().collect()] == ["renamed"]


def test_checks_on_write_cost_no_extra_scan(spark, scratch):
    """Rows are counted in the job that writes them: its plan holds the observed counts."""
    seen = []

    class Spy(DocumentStore):
        def _checked(self, rows, *more):
            out = super()._checked(rows, *more)
            seen.append(out._jdf.queryExecution().optimizedPlan().toString())
            return out

    kept = Spy(spark, os.path.join(scratch, "store_observe"))
    kept.upsert(doc_rows(spark, [("a", None)]), page_rows(spark, [("a", 1, "a")]), NOW)
    assert len(seen) == 2 and all("CollectMetrics" in p for p in seen)


def test_store_time_range_prunes_days(spark, scratch):
    kept = DocumentStore(spark, os.path.join(scratch, "store_k6"))
    none = page_rows(spark, [])
    kept.upsert(doc_rows(spark, [("a", None), ("b", None)]), none, "2024-01-01 00:00:00")
    kept.upsert(doc_rows(spark, [("c", None)]), none, "2024-03-01 00:00:00")
    kept.upsert(doc_rows(spark, [("a", None)]), none, "2024-05-01 00:00:00")  # overwrite keeps created_at
    got = kept.documents_created_between("2023-12-31 00:00:00", "2024-02-01 00:00:00")
    assert sorted(r.file_name for r in got.collect()) == ["a", "b"]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(created_date" in plan and "PushedFilters: [IsNotNull(created_at)" in plan


def test_store_update_pages(spark, scratch):
    kept = DocumentStore(spark, os.path.join(scratch, "store_t6"))
    kept.upsert(doc_rows(spark, [("a", None), ("b", None)]),
                page_rows(spark, [("a", 1, "a1"), ("a", 2, "a2"), ("b", 1, "b1")]), NOW)
    ups = pages(spark, [("a", 2, "fixed"), ("b", 9, "missing page"), ("zz", 1, "missing doc")])
    assert kept.update_pages(ups, "2024-07-01 00:00:00")
    cur = {r.file_name: r.updated_at for r in kept.documents().collect()}
    assert cur == {"a": dt.datetime(2024, 7, 1), "b": dt.datetime(2024, 6, 1)}
    assert stored_pages(kept) == [("a", 1, "a1"), ("a", 2, "fixed"), ("b", 1, "b1")]


def test_created_between_uses_date_partition_pruning(spark, scratch):
    stored = docs(spark, [("a", "{}")]).withColumn("created_date", F.to_date("created_at"))
    path = os.path.join(scratch, "by_date")
    stored.write.partitionBy("created_date").parquet(path)
    q = store.documents_created_between(spark.read.parquet(path), "2024-01-01 00:00:00", "2024-01-02 00:00:00")
    assert q.count() == 1
    assert "PartitionFilters: [isnotnull(created_date" in q._jdf.queryExecution().executedPlan().toString()


def test_documents_with_pages_keeps_documents_without_pages(spark):
    d = docs(spark, [("a", "{}"), ("b", "{}")])
    p = pages(spark, [("a", 1, "x"), ("a", 2, "y")])
    got = sorted((r.file_id, r.page_number, r.content) for r in assemble.documents_with_pages(d, p).collect())
    assert got == [("a", 1, "x"), ("a", 2, "y"), ("b", None, None)]


def test_upsert_same_batch_twice_sets_overwrite(spark):
    stored = docs(spark, [("a", "{}")])
    incoming = spark.createDataFrame([("b", '{"run":"r"}')], "file_name string, metadata string")
    once = store.upsert_documents(stored, incoming, NOW)
    twice = {r.file_name: r for r in store.upsert_documents(once, incoming, NOW).collect()}
    first = {r.file_name: r for r in once.collect()}
    assert first["b"].metadata == '{"run":"r"}'
    assert twice["b"].metadata == '{"run":"r","overwrite":true}'
    assert twice["b"].created_at == first["b"].created_at


def test_hot_document_is_gathered_in_chunks(spark, monkeypatch):
    rows = [("hot", n, f"p{n}") for n in range(1, 26)] + [("hot", 26, None), ("hot", 27, None), ("cold", 1, "c")]
    p = pages(spark, rows[::-1])
    got = assemble.ordered_collect(p, ["document_id"], "page_number", ["content"], chunk_size=4)
    items = {r.document_id: [x.page_number for x in r["items"]] for r in got.collect()}
    assert items["hot"] == list(range(1, 28)) and items["cold"] == [1]
    monkeypatch.setattr(assemble, "CHUNK_PAGES", 4)  # pages 24..27 share a chunk; 26, 27 are NULL
    text = {r.file_id: (r.n_pages, r.n_failed_pages, r.text) for r in
            assemble.document_text(p.withColumnRenamed("document_id", "file_id")).collect()}
    assert text["hot"] == (27, 2, "\n".join(f"p{n}" for n in range(1, 26)))
    assert text["cold"] == (1, 0, "c")


def test_single_key_lookups_push_filters_to_the_scan(spark, scratch):
    d = docs(spark, [("a", "{}"), ("b", "{}")])
    p = pages(spark, [("a", 2, "y"), ("a", 1, "x"), ("b", 1, "z")])
    d.write.parquet(os.path.join(scratch, "d"))
    p.write.parquet(os.path.join(scratch, "p"))
    d, p = spark.read.parquet(os.path.join(scratch, "d")), spark.read.parquet(os.path.join(scratch, "p"))
    q = store.get_by_id(d, "a")
    assert [r.file_id for r in q.collect()] == ["a"]
    assert "PushedFilters: [IsNotNull(file_id), EqualTo(file_id,a)]" in q._jdf.queryExecution().executedPlan().toString()
    assert store.get_by_name(d, "zz").count() == 0
    assert [r.content for r in store.get_page(p, "a", 2).collect()] == ["y"]
    assert [r.page_number for r in store.pages_of(p, "a").collect()] == [1, 2]


def test_gathering_plan_splits_hot_documents(spark):
    p = pages(spark, [("a", 1, "x")])
    plan = assemble.nest_pages(p)._jdf.queryExecution().executedPlan().toString()
    # level one groups by (document, chunk), level two by document: two separate aggregation exchanges
    assert plan.count("Exchange hashpartitioning") == 2
    assert "FLOOR" in plan.upper()


def scanned_rows(df):
    """Rows that the scan of the plan that ran has given."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if "AdaptiveSparkPlan" in plan.nodeName() else plan
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_point_lookups_skip_row_groups_by_bloom_filters(spark, scratch):
    kept = DocumentStore(spark, os.path.join(scratch, "store_bloom"))
    names = [f"{(i * 7919) % 1000:04d}.pdf" for i in range(0, 1000, 2)]
    kept.upsert(doc_rows(spark, [(n, None) for n in names]), page_rows(spark, [(n, 1, n) for n in names]), NOW)
    # between the least and the greatest name of every file, so only the filters can rule it out
    assert scanned_rows(kept.find("file_id", "0500.pdf~")) == scanned_rows(kept.find("file_name", "0500.pdf~")) == 0
    assert kept.find("file_name", names[3]).count() == 1 and 0 < scanned_rows(kept.find("file_id", names[3])) <= 500
    pages = spark.read.parquet(os.path.join(kept.root, "pages")).filter(F.col("document_id") == "0500.pdf~")
    assert scanned_rows(pages) == 0
    assert [r.content for r in kept.find_pages(names[5], 1).collect()] == [names[5]] and kept.find_pages(names[5]).count() == 1
