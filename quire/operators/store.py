"""Document/page store as pure table transforms.

Every write is ``old x incoming -> new``: a join plus a union, never an
in-place update (Parquet tables have no UPDATE/MERGE). ``now`` is a parameter,
one value per run, so a rerun of the same batch computes the same rows.
Lookups take a key *table* and join it, so one job answers any number of
lookups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DOCUMENT_COLUMNS = ["file_id", "file_name", "created_at", "updated_at", "metadata"]
PAGE_COLUMNS = ["document_id", "page_number", "content", "metadata"]
# Fixed value: the default page size of a listing.
DEFAULT_PAGE_SIZE = 100


def _ts(now: str | Column) -> Column:
    return F.lit(now).cast("timestamp_ntz") if isinstance(now, str) else now


def with_overwrite(metadata: Column) -> Column:
    """``(metadata or {})`` with ``"overwrite": true`` set, as JSON text.

    Parsed as ``MAP<STRING, VARIANT>`` so every other key keeps its JSON type
    and order; an existing ``overwrite`` key is replaced (it moves to the end).
    """
    parsed = F.from_json(F.coalesce(metadata, F.lit("{}")), "map<string,variant>")
    kept = F.map_filter(parsed, lambda k, v: k != F.lit("overwrite"))
    return F.to_json(F.map_concat(kept, F.create_map(F.lit("overwrite"), F.parse_json(F.lit("true")))))


def new_documents(incoming: DataFrame, now: str | Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """A document saved for the first time: ``file_id = file_name``, both times ``now``, ``{}`` metadata."""
    ts = _ts(now)
    return incoming.select(F.col("file_name").alias("file_id"), "file_name", ts.alias("created_at"),
                           ts.alias("updated_at"), F.coalesce("metadata", F.lit("{}")).alias("metadata"), *keep)


def save_documents(store: DataFrame, incoming: DataFrame, seq: str | None = None) -> DataFrame:
    """Save by primary key; an incoming document replaces the stored one with the same ``file_id``.

    Of several incoming rows of one key the last stays (by ``seq``, else by ``updated_at``).
    """
    kept = store.join(incoming.select("file_id"), "file_id", "left_anti")
    return kept.select(*DOCUMENT_COLUMNS).unionByName(latest_by_id(incoming, seq))


def latest_by_id(documents: DataFrame, seq: str | None) -> DataFrame:
    """One row per ``file_id``: the last by ``seq``, else by ``updated_at`` and then the other columns."""
    order = ([F.col(seq)] if seq is not None else []) + [F.col(c) for c in ("updated_at", "metadata", "created_at", "file_name")]
    last = F.max(F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)), F.struct(*DOCUMENT_COLUMNS).alias("d")))
    return documents.groupBy(F.col("file_id").alias("_id")).agg(last.alias("_last")).select("_last.d.*")


def with_page_metadata(pages: DataFrame) -> DataFrame:
    """Page rows with a ``metadata`` column (``{}`` where none is given)."""
    given = F.col("metadata") if "metadata" in pages.columns else F.lit(None).cast("string")
    return pages.withColumn("metadata", F.coalesce(given, F.lit("{}")))


def latest_per_name(incoming: DataFrame, seq: str | None) -> DataFrame:
    """Collapse a batch to one row per ``file_name`` (the last by ``seq``) and count repeats.

    Without ``seq`` the largest metadata wins, so a repeated name never makes
    two rows. ``max_by`` is a partial aggregate: a name repeated millions of
    times is combined map-side, not gathered into one task.
    """
    order = F.col(seq) if seq is not None else F.lit(0)
    last = F.max(F.struct(order.alias("seq"), F.col("metadata").alias("metadata")))
    return incoming.groupBy("file_name").agg(last.alias("_last"), F.count(F.lit(1)).alias("n_in_batch")).select(
        "file_name", F.col("_last.metadata").alias("metadata"), F.col("_last.seq").alias("last_seq"), "n_in_batch")


def upsert_documents(store: DataFrame, incoming: DataFrame, now: str | Column, seq: str | None = None,
                     carry: tuple[str, ...] = (), mark: str | None = None) -> DataFrame:
    """Upsert results by ``file_name``.

    New name: a T2 document. Existing name (or a name repeated in the batch):
    ``file_id`` and ``created_at`` kept, metadata = given or ``{}`` plus
    ``overwrite: true``, ``updated_at = now``. Untouched documents pass through.
    One full outer join on ``file_name``. ``carry`` names more columns of the store that stay (null on new
    documents); ``mark`` names a flag of those that the batch has.
    """
    ts = _ts(now)
    inc = latest_per_name(incoming, seq).select(
        F.col("file_name").alias("_in_name"), F.col("metadata").alias("_in_meta"), "n_in_batch")
    j = store.join(inc, store["file_name"] == inc["_in_name"], "full_outer")
    existing, arriving = F.col("file_id").isNotNull(), F.col("_in_name").isNotNull()
    overwritten = arriving & (existing | (F.col("n_in_batch") > 1))
    return j.select(
        F.coalesce(F.col("file_id"), F.col("_in_name")).alias("file_id"),
        F.coalesce(F.col("file_name"), F.col("_in_name")).alias("file_name"),
        F.when(existing, F.col("created_at")).otherwise(ts).alias("created_at"),
        F.when(arriving, ts).otherwise(F.col("updated_at")).alias("updated_at"),
        F.when(overwritten, with_overwrite(F.col("_in_meta")))
        .when(arriving, F.coalesce(F.col("_in_meta"), F.lit("{}")))
        .otherwise(F.col("metadata")).alias("metadata"), *carry, *([arriving.alias(mark)] if mark else []))


def upsert_pages(store_pages: DataFrame, incoming_pages: DataFrame, incoming_documents: DataFrame) -> DataFrame:
    """T4: the pages of every incoming document (``file_id``) are replaced as a whole, also by none; others stay."""
    arriving = incoming_documents.select(F.col("file_id").alias("document_id")).distinct()
    kept = with_page_metadata(store_pages).join(arriving, "document_id", "left_anti")
    fresh = with_page_metadata(incoming_pages).join(arriving, "document_id", "left_semi")
    return kept.select(*PAGE_COLUMNS).unionByName(fresh.select(*PAGE_COLUMNS))


def delete_documents(store: DataFrame, keys: DataFrame) -> DataFrame:
    """T5: documents whose ``file_id`` is not among the keys."""
    return store.join(keys.select("file_id"), "file_id", "left_anti")


def delete_cascade_pages(store_pages: DataFrame, keys: DataFrame) -> DataFrame:
    """T5: pages of deleted documents go with them."""
    return store_pages.join(keys.select(F.col("file_id").alias("document_id")), "document_id", "left_anti")


def delete_flags(store: DataFrame, keys: DataFrame) -> DataFrame:
    """T5: per distinct key, whether a document existed (and so was deleted)."""
    asked = keys.select("file_id").distinct()
    found = store.select("file_id").join(asked, "file_id", "left_semi").distinct().withColumn("_found", F.lit(True))
    return asked.join(found, "file_id", "left").select("file_id", F.coalesce("_found", F.lit(False)).alias("deleted"))


def latest_updates(updates: DataFrame, seq: str | None) -> DataFrame:
    """One update per page: the last by ``seq``, else the largest content. A null ``metadata`` leaves the page's."""
    meta = F.col("metadata") if "metadata" in updates.columns else F.lit(None).cast("string")
    order = F.col(seq) if seq is not None else F.lit(0)
    last = F.max(F.struct(order.alias("seq"), F.col("content").alias("content"), meta.alias("metadata")))
    return updates.groupBy("document_id", "page_number").agg(last.alias("_last")).select(
        "document_id", "page_number", F.col("_last.content").alias("content"), F.col("_last.metadata").alias("metadata"))


def update_pages(store_pages: DataFrame, updates: DataFrame, seq: str | None = None) -> DataFrame:
    """New content for the pages that match (document_id, page_number)."""
    u = latest_updates(updates, seq).select(
        "document_id", "page_number", F.col("content").alias("_new"), F.col("metadata").alias("_meta"),
        F.lit(True).alias("_hit"))
    return with_page_metadata(store_pages).join(u, ["document_id", "page_number"], "left").select(
        "document_id", "page_number",
        F.when(F.col("_hit"), F.col("_new")).otherwise(F.col("content")).alias("content"),
        F.coalesce("_meta", "metadata").alias("metadata"))


def matched_updates(store_pages: DataFrame, updates: DataFrame) -> DataFrame:
    return updates.select("document_id", "page_number").join(
        store_pages.select("document_id", "page_number"), ["document_id", "page_number"], "left_semi")


def touch_documents(store: DataFrame, store_pages: DataFrame, updates: DataFrame, now: str | Column) -> DataFrame:
    """``updated_at = now`` on documents that had a page actually updated."""
    touched = matched_updates(store_pages, updates).select(F.col("document_id").alias("file_id")).distinct() \
        .withColumn("_touched", F.lit(True))
    return store.join(touched, "file_id", "left").withColumn(
        "updated_at", F.when(F.col("_touched"), _ts(now)).otherwise(F.col("updated_at"))).drop("_touched")


def update_flags(store_pages: DataFrame, updates: DataFrame) -> DataFrame:
    """Per update, whether its page existed (false for a missing page or document)."""
    key = ["document_id", "page_number"]
    asked = updates.select(*key).distinct()
    found = store_pages.select(*key).join(asked, key, "left_semi").distinct().withColumn("_found", F.lit(True))
    return updates.select(*key).join(found, key, "left").select(*key, F.coalesce("_found", F.lit(False)).alias("updated"))


# --- reads ---

def get_documents(store: DataFrame, keys: DataFrame, by: str = "file_id") -> DataFrame:
    """K1/K2: one row per key; document columns NULL when there is no match."""
    k = keys.select(F.col(by).alias("key"))
    return k.join(store, k["key"] == store[by], "left")


def first_pages(pages: DataFrame, order: str | None = None) -> DataFrame:
    """O3: the first page of each (document_id, page_number): by ``order``, else by content and metadata.

    A minimum per key, combined map-side, so a key repeated often isn't gathered.
    """
    rows = with_page_metadata(pages)
    by = F.col(order) if order is not None else F.lit(0)
    first = F.min(F.struct(by.alias("by"), F.col("content").alias("content"), F.col("metadata").alias("metadata")))
    return rows.groupBy("document_id", "page_number").agg(first.alias("_first")).select(
        "document_id", "page_number", F.col("_first.content").alias("content"), F.col("_first.metadata").alias("metadata"))


def get_pages(store_pages: DataFrame, keys: DataFrame, order: str | None = None) -> DataFrame:
    """K4: one page per (document_id, page_number) key, the first of several (O3); NULL content when missing."""
    key = ["document_id", "page_number"]
    asked = keys.select(*key)
    found = first_pages(store_pages.join(asked.distinct(), key, "left_semi"), order)
    return asked.join(found, key, "left").select(*key, "content", "metadata")


def list_pages(store_pages: DataFrame, keys: DataFrame) -> DataFrame:
    """K5/O1: all pages of the given documents ordered by document and page number."""
    k = keys.select(F.col("file_id").alias("document_id"))
    return store_pages.join(k, "document_id", "left_semi").orderBy("document_id", "page_number")


def list_documents(store: DataFrame, skip: int = 0, limit: int = DEFAULT_PAGE_SIZE,
                   after: str | None = None) -> DataFrame:
    """K3/O2: one page of the listing ordered by ``file_id`` (a bounded top-(skip+limit) per task).

    ``after`` is the last ``file_id`` of the page before: the filter is pushed into the scan and the page costs
    ``limit`` rows however deep it lies, where ``skip`` costs skip + limit.
    """
    rows = store if after is None else store.filter(F.col("file_id") > F.lit(after))
    return rows.orderBy("file_id").offset(skip).limit(limit)


def get_by_id(store: DataFrame, file_id: str) -> DataFrame:
    """K1 for one key: a literal filter, pushed into the Parquet scan (row groups pruned by min/max)."""
    return store.filter(F.col("file_id") == F.lit(file_id))


def get_by_name(store: DataFrame, file_name: str) -> DataFrame:
    """K2 for one key."""
    return store.filter(F.col("file_name") == F.lit(file_name))


def get_page(store_pages: DataFrame, file_id: str, page_number: int) -> DataFrame:
    """K4 for one key; at most one row when (document_id, page_number) is unique (V2)."""
    return store_pages.filter((F.col("document_id") == F.lit(file_id)) & (F.col("page_number") == F.lit(page_number)))


def pages_of(store_pages: DataFrame, file_id: str) -> DataFrame:
    """K5 for one key: the document's pages by page number (empty when it has none)."""
    return store_pages.filter(F.col("document_id") == F.lit(file_id)).orderBy("page_number")


def documents_created_between(store: DataFrame, start: str, end: str) -> DataFrame:
    """K6: a time-range read; on a store partitioned by ``created_date`` the date bounds prune files."""
    lo, hi = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    pred = (F.col("created_at") >= lo) & (F.col("created_at") < hi)
    if "created_date" in store.columns:
        pred = pred & F.col("created_date").between(lo.cast("date"), hi.cast("date"))
    return store.filter(pred)


def metadata_value(metadata: Column, key: str) -> Column:
    """K7: a top-level metadata field as text, whatever characters its name has (none of them makes a path)."""
    if any(c in key for c in ".[]'\"\\"):
        value = F.element_at(F.from_json(metadata, "map<string,variant>"), F.lit(key))
        return F.try_variant_get(value, "$", "string")
    return F.get_json_object(metadata, f"$['{key}']")


def with_variant_metadata(documents: DataFrame, column: str = "metadata") -> DataFrame:
    """``column`` as VARIANT, so that its fields are read from Parquet without parsing text; text that isn't JSON is null."""
    return documents.withColumn(column, F.try_parse_json(column))


def variant_value(metadata: Column, key: str) -> Column:
    """K7 on a VARIANT: a top-level field as text, whatever characters its name has."""
    name = key.replace("\\", "\\\\").replace("'", "\\'")
    if name == key and "]" not in key:
        return F.try_variant_get(metadata, f"$['{key}']", "string")
    fields = F.try_variant_get(metadata, "$", "map<string,variant>")
    return F.try_variant_get(F.element_at(fields, F.lit(key)), "$", "string")
