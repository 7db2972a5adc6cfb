"""Property tests: Spark operators against small sequential models of the specified behaviour."""

import datetime as dt
import json

from hypothesis import given, settings
from hypothesis import strategies as st

from quire.operators import intake, store

NAME_PARTS = st.sampled_from(["a", "B", ".", "pdf", "PDF", "png", "Png", "tif", "tiff", "jpeg", "x", "gif", ""])
names = st.one_of(st.none(), st.lists(NAME_PARTS, max_size=5).map("".join))
mimes = st.one_of(st.none(), st.sampled_from(["", "image/png", "IMAGE/PNG", "image/webp", "application/pdf",
                                              "text/plain", "image/tif", "application/x"]))


def model_route(name, mime, forced):
    image = (mime in intake.IMAGE_MIME_TYPES) or bool(name and name.lower().split(".")[-1] in intake.IMAGE_EXTENSIONS)
    pdf = mime == "application/pdf" or bool(name and name.lower().endswith(".pdf"))
    if image:
        return "image"
    if pdf:
        return "searchable_pdf" if forced else "native_pdf"
    return "unsupported"


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(names, mimes, st.booleans()), min_size=1, max_size=30))
def test_routing_matches_model(spark, rows):
    df = spark.createDataFrame([(i, n, m, f) for i, (n, m, f) in enumerate(rows)],
                               "file_id long, file_name string, content_type string, force_ocr boolean")
    # every file has a fully covered page, so only force_ocr sends a PDF to recognition
    rects = spark.createDataFrame([(i, 1, 1.0, 1.0) for i in range(len(rows))],
                                  "file_id long, page_number int, width double, height double")
    blocks = spark.createDataFrame([(i, 1, 0.0, 0.0, 1.0, 1.0) for i in range(len(rows))],
                                   "file_id long, page_number int, x0 double, y0 double, x1 double, y1 double")
    got = {r.file_id: r.route for r in intake.route(df, intake.text_coverage(rects, blocks)).collect()}
    assert got == {i: model_route(n, m, f) for i, (n, m, f) in enumerate(rows)}


T0, NOW = dt.datetime(2024, 1, 1), "2024-06-01 00:00:00"


def model_upsert(stored: dict, batch: list):
    docs = {k: dict(v) for k, v in stored.items()}
    for name, meta in batch:  # one save_result call per row, in order
        given_meta = json.loads(meta) if meta else {}
        if name in docs:
            docs[name]["metadata"] = {**given_meta, "overwrite": True}
            docs[name]["updated_at"] = dt.datetime(2024, 6, 1)
        else:
            docs[name] = {"created_at": dt.datetime(2024, 6, 1), "updated_at": dt.datetime(2024, 6, 1),
                          "metadata": given_meta}
    return docs


@settings(max_examples=6, deadline=None)
@given(st.sets(st.sampled_from("abcdef"), max_size=4),
       st.lists(st.tuples(st.sampled_from("abcdefgh"), st.sampled_from([None, '{"r":1}', '{"r":2,"s":"x"}'])),
                max_size=12))
def test_upsert_matches_sequential_saves(spark, stored_names, batch):
    stored = {n: {"created_at": T0, "updated_at": T0, "metadata": {"src": n}} for n in stored_names}
    store_df = spark.createDataFrame([(n, n, T0, T0, json.dumps({"src": n})) for n in stored_names],
                                     "file_id string, file_name string, created_at timestamp_ntz, "
                                     "updated_at timestamp_ntz, metadata string")
    inc = spark.createDataFrame([(n, m, i) for i, (n, m) in enumerate(batch)],
                                "file_name string, metadata string, seq long")
    got = {r.file_name: r for r in store.upsert_documents(store_df, inc, NOW, seq="seq").collect()}
    want = model_upsert(stored, batch)
    assert set(got) == set(want)
    for name, w in want.items():
        r = got[name]
        assert (r.file_id, r.created_at, r.updated_at) == (name, w["created_at"], w["updated_at"])
        assert json.loads(r.metadata) == w["metadata"]


from pyspark.sql import functions as F  # noqa: E402

from quire.operators import assemble, extract  # noqa: E402

PAGE_TEXT = st.text(alphabet=st.sampled_from(list(" \t\n\x1c　\xa0ab.")), max_size=6)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(PAGE_TEXT, max_size=6), min_size=1, max_size=8))
def test_native_pages_match_model(spark, docs):
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "file_id long, pages array<string>")
    got = sorted(tuple(r) for r in extract.keep_text_pages(df, F.col("pages")).collect())
    want = sorted((i, n + 1, src, text) for i, d in enumerate(docs)
                  for n, (src, text) in enumerate([(k + 1, p) for k, p in enumerate(d) if p.strip()]))
    assert got == want


@settings(max_examples=5, deadline=None)
@given(st.dictionaries(st.sampled_from("xyz"),
                       st.dictionaries(st.integers(min_value=1, max_value=40),
                                       st.one_of(st.none(), st.text(alphabet="ab ", max_size=3)), min_size=1,
                                       max_size=12), min_size=1))
def test_two_level_document_text_matches_model(spark, docs):
    rows = [(d, n, c) for d, pages in docs.items() for n, c in pages.items()]
    df = spark.createDataFrame(rows, "file_id string, page_number long, content string")
    saved, assemble.CHUNK_PAGES = assemble.CHUNK_PAGES, 3  # many chunks per document
    try:
        got = {r.file_id: (r.n_pages, r.n_failed_pages, r.text) for r in assemble.document_text(df).collect()}
    finally:
        assemble.CHUNK_PAGES = saved
    want = {d: (len(p), sum(c is None for c in p.values()),
                "\n".join(c for _, c in sorted(p.items()) if c is not None)) for d, p in docs.items()}
    assert got == want
