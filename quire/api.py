"""The service's endpoints as batch jobs: each takes a DataFrame of requests and returns one of results.

| endpoint              | function             | result columns                                    |
|-----------------------|----------------------|---------------------------------------------------|
| upload one/many files | ``upload_files``     | file_id, file_name, content (ARRAY<STRING>), error |
| parse with a model    | ``parse_with_model`` | file_id, filename, content, llm_model, error      |
| enhance text          | ``enhance_text``     | request_id, original_length, enhanced_text, llm_model, error |
| health                | ``health``           | n_components, n_unhealthy, healthy, status, components |
| mock upload           | ``mock_upload``      | batch_id, status, received_count, file_names      |

Inputs are the relations the operators use: ``uploads(file_id, file_name,
content_type, content BINARY, force_ocr, language)`` plus optional layout
tables for the scanned test. Page text of PDFs comes from the caller's
columns (``native_pages`` / ``page_images``), because PDF parsing and
rendering are per-row libraries outside Spark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators import assemble, checks, completion, extract, intake, prompts

# Fixed value: the language the model path asks the recogniser for.
PARSE_LANGUAGE = "eng"


def _route(uploads: DataFrame, page_rects: DataFrame | None, page_blocks: DataFrame | None,
           force_ocr: str | bool) -> DataFrame:
    coverage = None
    if page_rects is not None and page_blocks is not None:
        coverage = intake.text_coverage(page_rects, page_blocks)
    return intake.route(uploads, coverage, force_ocr)


def upload_files(uploads: DataFrame, native_pages: Column, page_images: Column,
                 page_rects: DataFrame | None = None, page_blocks: DataFrame | None = None,
                 available_languages: DataFrame | None = None, recogniser: str = "utf8") -> DataFrame:
    """Per file, its page texts in order; unsupported files get an ``error`` instead of failing the batch."""
    routed = _route(uploads, page_rects, page_blocks, "force_ocr")
    language = None
    if available_languages is not None:
        routed = extract.resolve_language(routed, available_languages)
        language = F.col("resolved_language")
    results = extract.file_results(routed, native_pages, page_images, F.col("content"), recogniser, language).withColumn(
        "error", F.lit(None).cast("string"))
    errors = intake.unsupported_files(routed, keep=("file_name",)).select(
        "file_id", "file_name", F.lit(None).cast("array<string>").alias("content"), "error")
    return results.unionByName(errors)


def parse_with_model(uploads: DataFrame, native_pages: Column, page_images: Column, prompt: Column | None = None,
                     provider: str = "mock", page_rects: DataFrame | None = None,
                     page_blocks: DataFrame | None = None, available_languages: DataFrame | None = None,
                     recogniser: str = "utf8") -> DataFrame:
    """Extract (never forcing OCR), join pages with newlines, prompt the model, report per file.

    The recogniser language is ``eng`` per row when available (the service set
    it globally); ``provider`` names a registered provider function. File name
    and prompt ride along with the pages and the completion, so nothing is
    joined back.
    """
    up = uploads.withColumn("force_ocr", F.lit(False)).withColumn("language", F.lit(PARSE_LANGUAGE)).withColumn(
        "_prompt", prompt if prompt is not None else F.lit(None).cast("string"))
    routed = _route(up, page_rects, page_blocks, False)
    language = None
    if available_languages is not None:
        routed = extract.resolve_language(routed, available_languages)
        language = F.col("resolved_language")
    keep = ("file_name", "_prompt")
    pages = extract.ingest_pages(routed, native_pages, page_images, F.col("content"), recogniser, language)
    supported = routed.filter(F.col("route") != intake.ROUTE_UNSUPPORTED)
    text = assemble.document_text(pages, carry=keep, files=supported).withColumnRenamed("file_id", "request_id")
    done = completion.complete_batch(text, prompts.parse_prompt(F.col("_prompt"), F.col("text")), provider,
                                     carry=("file_name",))
    out = done.select(F.col("request_id").alias("file_id"), F.col("file_name").alias("filename"), "content",
                      F.lit(provider.lower()).alias("llm_model"), F.col("error_message").alias("error"))
    errors = intake.unsupported_files(routed, keep=("file_name",)).select(
        "file_id", F.col("file_name").alias("filename"), F.lit(None).cast("string").alias("content"),
        F.lit(provider.lower()).alias("llm_model"), "error")
    return out.unionByName(errors)


def enhance_text(requests: DataFrame, provider: str = "mock") -> DataFrame:
    """``requests(request_id, text, instruction)`` -> enhanced text, original length (code points), provider."""
    req = requests.withColumn("original_length", F.length("text").cast("bigint"))
    done = completion.complete_batch(req, prompts.enhance_prompt(F.col("instruction"), F.col("text")), provider,
                                     carry=("original_length",))
    return done.select("request_id", "original_length", F.col("content").alias("enhanced_text"),
                       F.lit(provider.lower()).alias("llm_model"), F.col("error_message").alias("error"))


def health(component_status: DataFrame) -> DataFrame:
    return checks.health_rollup(component_status, components=True)


def mock_upload(uploads: DataFrame, batch: Column) -> DataFrame:
    return intake.upload_receipt(uploads, batch)
