from pyspark.sql import functions as F

from quire import api
from quire.__main__ import main as cli


def uploads(spark):
    rows = [(1, "scan.png", None, b" hello image ", False, "eng"),
            (2, "doc.pdf", "application/pdf", b"first. . second", False, None),
            (3, "notes.txt", "text/plain", b"x", False, None)]
    return spark.createDataFrame(rows, "file_id long, file_name string, content_type string, content binary, "
                                       "force_ocr boolean, language string")


def cols():
    text = F.decode(F.col("content"), "UTF-8")
    return F.split(text, "[.]"), F.transform(F.split(text, "\n"), lambda x: F.encode(x, "UTF-8"))


def layout(spark):
    rects = spark.createDataFrame([(2, 1, 10.0, 10.0)], "file_id long, page_number int, width double, height double")
    blocks = spark.createDataFrame([(2, 1, 0.0, 0.0, 10.0, 5.0)],
                                   "file_id long, page_number int, x0 double, y0 double, x1 double, y1 double")
    return rects, blocks


def test_upload_files(spark):
    native, images = cols()
    rects, blocks = layout(spark)
    got = {r.file_name: (r.content, r.error) for r in
           api.upload_files(uploads(spark), native, images, rects, blocks).collect()}
    assert got["scan.png"] == (["hello image"], None)
    assert got["doc.pdf"] == (["first", " second"], None)  # native text, blank page dropped, not stripped
    assert got["notes.txt"] == (None, "Unsupported file type: text/plain")


def test_files_without_pages_and_string_ids(spark):
    native, images = cols()
    rows = [("f1", "blank.pdf", "application/pdf", b" . .\n", False, None), ("f2", "a.png", None, b"x", False, None)]
    up = spark.createDataFrame(rows, "file_id string, file_name string, content_type string, content binary, "
                                     "force_ocr boolean, language string")
    rects = spark.createDataFrame([("f1", 1, 10.0, 10.0)], "file_id string, page_number int, width double, height double")
    blocks = spark.createDataFrame([("f1", 1, 0.0, 0.0, 10.0, 5.0)],
                                   "file_id string, page_number int, x0 double, y0 double, x1 double, y1 double")
    got = {r.file_name: (r.content, r.error) for r in api.upload_files(up, native, images, rects, blocks).collect()}
    assert got == {"blank.pdf": ([], None), "a.png": (["x"], None)}
    parsed = {r.file_id: (r.filename, r.content, r.error) for r in
              api.parse_with_model(up, native, images, None, "mock", rects, blocks).collect()}
    assert parsed == {"f1": ("blank.pdf", "This is a mock response from the LLM.", None),
                      "f2": ("a.png", "This is a mock response from the LLM.", None)}


def test_parse_with_model_and_enhance(spark):
    native, images = cols()
    rects, blocks = layout(spark)
    got = {r.filename: r for r in api.parse_with_model(uploads(spark), native, images, F.lit(None).cast("string"),
                                                       "mock", rects, blocks).collect()}
    assert got["doc.pdf"].content == "This is a mock response from the LLM." and got["doc.pdf"].llm_model == "mock"
    assert got["notes.txt"].error == "Unsupported file type: text/plain"
    req = spark.createDataFrame([(1, "héllo wörld", "Summarize")], "request_id long, text string, instruction string")
    r = api.enhance_text(req).first()
    assert (r.original_length, r.llm_model, r.error) == (11, "mock", None)


def test_health_and_mock_upload(spark):
    import datetime as dt
    status = spark.createDataFrame([("db", dt.datetime(2024, 1, 1), True)], "component string, ts timestamp_ntz, "
                                                                             "healthy boolean")
    r = api.health(status).first()
    assert r.status == "healthy" and r.components["db"].healthy and r.components["db"].status == "healthy"
    r = api.mock_upload(uploads(spark), F.lit(0)).first()
    assert (r.received_count, r.file_names) == (3, "doc.pdf,notes.txt,scan.png")


def test_cli_lists_queries(capsys):
    cli(["list"])
    out = capsys.readouterr().out
    assert "document_usage" in out and "read_uploads\n" in out and "no SQL twin" not in out
