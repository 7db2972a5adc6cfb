"""Shape changes between page rows, nested documents and assembled text.

A document's pages are gathered only where the result *is* one value per
document (nested pages, assembled text). Such a group is bounded by the one
document it came from; counts and sizes are computed with plain partial
aggregates, which Spark combines map-side before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAGE_SEPARATOR = "\n"
# Pages per first-level group when gathering a document's pages: a document
# with more pages than this is assembled by several tasks, then merged.
CHUNK_PAGES = 4096


def ordered_collect(df: DataFrame, key: list[str], order: str, values: list[str],
                    chunk_size: int = CHUNK_PAGES) -> DataFrame:
    """Per ``key``: ``items ARRAY<STRUCT<order, values...>>`` sorted by ``order``.

    Built in two levels so a hot key is split: level one gathers and sorts
    (key, order // chunk_size) groups in parallel, level two only puts the
    already sorted chunks in order and concatenates them.
    """
    chunk = F.floor(F.col(order) / F.lit(chunk_size)).alias("_chunk")
    lvl1 = df.groupBy(*key, chunk).agg(
        F.array_sort(F.collect_list(F.struct(order, *values))).alias("_items"))
    lvl2 = lvl1.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("_chunk", "_items"))).alias("_chunks"))
    return lvl2.select(*key, F.flatten(F.transform("_chunks", lambda c: c["_items"])).alias("items"))


def _apart(pages: DataFrame) -> DataFrame:
    """A page's own metadata next to its document's: ``page_metadata``."""
    return pages.withColumnRenamed("metadata", "page_metadata")


def documents_with_pages(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """Each document with its pages; a document without pages keeps one row with NULL page columns.

    Written as (pages inner documents) + (documents anti page keys) rather than
    one left outer join: a document holding a large share of all pages would
    otherwise be buffered in one task, and AQE cannot split the non-preserved
    side of an outer join. The inner join streams pages and can be split on a
    hot key; the anti side only sees distinct page keys (deduplicated map-side).
    """
    pages = _apart(pages)
    page_cols = [c for c in pages.columns if c != "document_id"]
    docs_renamed = documents.withColumnRenamed("file_id", "document_id")
    matched = pages.join(docs_renamed, "document_id", "inner").withColumnRenamed("document_id", "file_id")
    keys = pages.select("document_id").distinct()
    lonely = docs_renamed.join(keys, "document_id", "left_anti").withColumnRenamed("document_id", "file_id")
    for c in page_cols:
        lonely = lonely.withColumn(c, F.lit(None).cast(pages.schema[c].dataType))
    return matched.unionByName(lonely)


def pages_with_document(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """Each page with its parent document (inner)."""
    pages = _apart(pages)
    return pages.join(documents, pages["document_id"] == documents["file_id"], "inner")


def nest_pages(pages: DataFrame, key: str = "document_id", extra: list[str] | None = None) -> DataFrame:
    """Flat pages -> one row per document with ``pages ARRAY<STRUCT<page_number, content, ...>>``.

    Ordering comes from sorting by ``page_number``, never from row order; a
    document with very many pages is gathered in chunks (:func:`ordered_collect`).
    """
    values = ["content"] + list(extra or [])
    return ordered_collect(pages, [key], "page_number", values).withColumnRenamed("items", "pages")


def unnest_pages(nested: DataFrame, key: str = "document_id") -> DataFrame:
    """Nested -> flat; ``inline_outer`` keeps documents with no pages as one NULL row."""
    return nested.select(key, F.inline_outer("pages"))


def join_pages(pages_col: str = "pages", separator: str = PAGE_SEPARATOR) -> F.Column:
    """``separator.join(page.content ...)`` over a sorted page array (NULL pages are skipped)."""
    return F.array_join(F.transform(F.col(pages_col), lambda p: p["content"]), separator)


def document_text(pages: DataFrame, key: str = "file_id", carry: tuple[str, ...] = (),
                  files: DataFrame | None = None) -> DataFrame:
    """A3: pages joined by newline in page order, plus the count of NULL (failed) pages.

    ``carry`` names per-document columns (functionally dependent on ``key``)
    kept through the aggregation, which saves joining them back afterwards.
    ``files`` (with the key and ``carry``) lists the files asked for: one
    without pages then has the empty text and 0 pages instead of no row.
    """
    if files is not None:
        found = document_text(pages.drop(*carry), key)
        none = F.lit(0).cast("bigint")
        return files.select(key, *carry).join(found, key, "left").select(
            key, *carry, F.coalesce("n_pages", none).alias("n_pages"),
            F.coalesce("n_failed_pages", none).alias("n_failed_pages"), F.coalesce("text", F.lit("")).alias("text"))
    keys = [key, *carry]
    chunk = F.floor(F.col("page_number") / F.lit(CHUNK_PAGES)).alias("_chunk")
    # level one: text of each chunk of pages (a chunk with only NULL pages contributes nothing)
    parts = pages.groupBy(*keys, chunk).agg(
        F.array_sort(F.collect_list(F.struct("page_number", "content"))).alias("pages"),
        F.count(F.lit(1)).alias("n"), F.count("content").alias("n_ok"))
    parts = parts.select(*keys, "_chunk", "n", (F.col("n") - F.col("n_ok")).alias("n_bad"),
                         F.when(F.col("n_ok") > 0, join_pages()).alias("part"))
    # level two: chunks in order
    doc = parts.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("_chunk", "part"))).alias("parts"),
        F.sum("n").alias("n_pages"), F.sum("n_bad").alias("n_failed_pages"))
    text = F.array_join(F.transform("parts", lambda p: p["part"]), PAGE_SEPARATOR)
    return doc.select(key, *carry, "n_pages", "n_failed_pages", text.alias("text"))


def upload_results(pages: DataFrame, files: DataFrame, key: str = "file_id", name: str = "file_name") -> DataFrame:
    """A2: per file of ``files`` (key and name), ``{filename, content: [page texts in page order]}``.

    A file without pages has an empty list.
    """
    nested = ordered_collect(pages, [key], "page_number", ["content"])
    found = nested.select(key, F.transform("items", lambda x: x["content"]).alias("content"))
    return files.select(key, name).join(found, key, "left").select(
        key, name, F.coalesce("content", F.array().cast("array<string>")).alias("content"))
