"""Input relations derived from the test tables (see FIXTURES.md).

Each relation exists twice: as a Spark DataFrame built from the base tables
(``spark_*`` functions, lazy, so Catalyst prunes and pushes filters through
them) and as DuckDB SQL text (``DUCK``), which the oracle queries prepend as
CTEs. The ``%`` expressions only spread documents over fixture cases (which
file type, which documents are already stored, ...); every relation covers
the whole ``documents``/``events`` tables, so the work grows with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import completion
from quire.sources.tables import read_table

# Fixed values for the fixtures: the run's "now", the store's time origin.
NOW = "2024-06-01 00:00:00"
STORE_ORIGIN = "2024-01-01 00:00:00"


def documents(spark: SparkSession, root: str) -> DataFrame:
    return read_table(spark, root, "documents")


def uploads(spark: SparkSession, root: str) -> DataFrame:
    return documents(spark, root).selectExpr(
        "doc_id AS file_id",
        "concat('doc_', cast(doc_id AS string), CASE doc_id % 8 WHEN 0 THEN '.pdf' WHEN 1 THEN '.PDF'"
        " WHEN 2 THEN '.png' WHEN 3 THEN '.jpeg' WHEN 4 THEN '.TIFF' WHEN 5 THEN '.txt' WHEN 6 THEN ''"
        " ELSE '.tif' END) AS file_name",
        "CASE doc_id % 5 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'image/png' WHEN 2 THEN NULL"
        " WHEN 3 THEN 'text/plain' ELSE 'IMAGE/PNG' END AS content_type",
        "doc_id % 7 = 0 AS force_ocr",
        "CASE doc_id % 4 WHEN 0 THEN 'eng' WHEN 1 THEN 'ara' WHEN 2 THEN 'xyz' ELSE NULL END AS language",
        "lang", "n_chars", "text")


def page_rects(spark: SparkSession, root: str) -> DataFrame:
    d = documents(spark, root).filter("doc_id % 11 <> 0")
    return (d.select(F.col("doc_id").alias("file_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("page_number"))
            .filter("page_number = 1 OR file_id % 2 = 0")
            .select("file_id", "page_number",
                    F.lit(612.0).alias("width"), F.lit(792.0).alias("height")))


def page_blocks(spark: SparkSession, root: str) -> DataFrame:
    d = documents(spark, root).filter("doc_id % 11 <> 0")
    return (d.select(F.col("doc_id").alias("file_id"), "n_chars",
                     F.explode(F.array(F.lit(0), F.lit(1))).alias("b"))
            .selectExpr("file_id", "1 AS page_number", "cast(0 AS double) AS x0",
                        "cast(36 * b AS double) AS y0", "cast(n_chars AS double) AS x1",
                        "cast(36 * b + 36 AS double) AS y1"))


def page_text(spark: SparkSession, root: str) -> DataFrame:
    """Per-page native text: documents cut at every '.' (blank pieces included)."""
    return documents(spark, root).select(
        F.col("doc_id").alias("file_id"),
        F.posexplode(F.split("text", "[.]")).alias("pos", "content")).selectExpr(
        "file_id", "cast(pos + 1 AS bigint) AS page_number", "content")


def page_arrays(spark: SparkSession, root: str) -> DataFrame:
    """``page_text`` before it is exploded: one row per document, pages in order."""
    return documents(spark, root).select(F.col("doc_id").alias("file_id"),
                                         F.split("text", "[.]").alias("pages"))


def store_documents(spark: SparkSession, root: str) -> DataFrame:
    return documents(spark, root).filter("doc_id % 3 <> 0").selectExpr(
        "concat('doc_', cast(doc_id AS string)) AS file_id",
        "concat('doc_', cast(doc_id AS string)) AS file_name",
        f"timestamp_ntz'{STORE_ORIGIN}' + make_dt_interval(0, 0, cast(doc_id AS int), 0) AS created_at",
        f"timestamp_ntz'{STORE_ORIGIN}' + make_dt_interval(0, 0, cast(doc_id AS int), 0) AS updated_at",
        "concat('{\"src\":\"', source, '\"}') AS metadata")


def _line_pages(spark: SparkSession, root: str, keep: str, suffix: str, metadata: str) -> DataFrame:
    return (documents(spark, root).filter(keep)
            .select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("document_id"),
                    F.posexplode(F.split("text", "\n")).alias("pos", "p"))
            .select("document_id", (F.col("pos") + 1).cast("bigint").alias("page_number"),
                    F.concat("p", F.lit(suffix)).alias("content"))
            .withColumn("metadata", F.expr(metadata)))


def store_pages(spark: SparkSession, root: str) -> DataFrame:
    return _line_pages(spark, root, "doc_id % 3 <> 0", "", "concat('{\"no\":', cast(page_number AS string), '}')")


def repeated_pages(spark: SparkSession, root: str) -> DataFrame:
    """Stored pages with ``seq``; every third page number is there twice."""
    pages = store_pages(spark, root)
    return pages.withColumn("seq", F.explode(F.expr(
        "if(page_number % 3 = 0, array(2, 1), array(1))"))).withColumn(
        "content", F.concat("content", F.lit("#"), F.col("seq").cast("string")))


def incoming_pages(spark: SparkSession, root: str) -> DataFrame:
    """Pages of the incoming documents; a seventh of those arrive without any."""
    return _line_pages(spark, root, "doc_id % 2 = 0 AND doc_id % 14 <> 0", "!",
                       "CASE WHEN page_number % 2 = 0 THEN NULL ELSE '{\"new\":true}' END")


def incoming_documents(spark: SparkSession, root: str) -> DataFrame:
    """Every third of them arrives twice; ``seq`` says which came last."""
    return documents(spark, root).filter("doc_id % 2 = 0").selectExpr(
        "doc_id", "explode(if(doc_id % 6 = 0, array(2, 1), array(1))) AS seq").selectExpr(
        "concat('doc_', cast(doc_id AS string)) AS file_name",
        "CASE WHEN doc_id % 4 = 0 THEN NULL ELSE concat('{\"run\":\"r', cast(seq AS string), '\"}') END AS metadata", "seq")


def lookup_keys(spark: SparkSession, root: str) -> DataFrame:
    return documents(spark, root).filter("doc_id % 10 = 0").selectExpr(
        "concat('doc_', cast(doc_id AS string)) AS file_id")


def page_updates(spark: SparkSession, root: str) -> DataFrame:
    return documents(spark, root).filter("doc_id % 5 = 0").selectExpr(
        "concat('doc_', cast(doc_id AS string)) AS document_id",
        "cast(1 + doc_id % 3 AS bigint) AS page_number",
        "concat('fixed ', cast(doc_id AS string)) AS content",
        "CASE WHEN doc_id % 15 = 0 THEN '{\"fixed\":true}' END AS metadata")


def dirty_documents(spark: SparkSession, root: str) -> DataFrame:
    return documents(spark, root).selectExpr(
        "concat('doc_', cast(doc_id - doc_id % 20 * cast(doc_id % 3 = 0 AS int) AS string)) AS file_id",
        "CASE WHEN doc_id % 13 = 0 THEN NULL ELSE concat(source, '_', cast(doc_id - doc_id % 40 AS string)) END AS file_name")


def dirty_pages(spark: SparkSession, root: str) -> DataFrame:
    return documents(spark, root).selectExpr(
        "concat('doc_', cast(doc_id AS string)) AS document_id",
        "cast(1 AS bigint) AS page_number",
        "CASE WHEN doc_id % 17 = 0 THEN NULL ELSE text END AS content")


def llm_requests(spark: SparkSession, root: str) -> DataFrame:
    return documents(spark, root).selectExpr(
        "doc_id AS request_id", "text",
        "CASE doc_id % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'Summarize: ' END AS prompt",
        "concat('Translate to ', lang) AS instruction",
        "CASE doc_id % 5 WHEN 0 THEN 'ollama' WHEN 1 THEN 'LiteLLM' WHEN 2 THEN 'MOCK' WHEN 3 THEN 'unknown'"
        " ELSE 'mock' END AS provider",
        "CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'openai/gpt-4' WHEN 2 THEN 'llama3.2' ELSE '' END AS model",
        "CASE WHEN doc_id % 6 = 0 THEN NULL ELSE cast(doc_id % 30 AS double) / 10 END AS temperature",
        "CASE WHEN doc_id % 7 = 0 THEN NULL ELSE doc_id % 9 - 1 END AS max_tokens",
        "CASE WHEN doc_id % 8 = 0 THEN NULL ELSE doc_id % 10 END AS timeout",
        "CASE WHEN doc_id % 9 = 0 THEN concat('answer ', lang) ELSE NULL END AS mock_response")


def raw_responses(spark: SparkSession, root: str) -> DataFrame:
    return read_table(spark, root, "events").selectExpr(
        "event_id",
        "CASE event_id % 3 WHEN 0 THEN 'local_complete' WHEN 1 THEN 'local_chat' ELSE 'gateway' END AS shape",
        """CASE WHEN event_id % 17 = 0 THEN 'not json'
          WHEN event_id % 19 = 0 THEN '{"response":null,"message":{"content":null},"prompt_eval_count":"x","eval_count":2.5,"usage":{"total_tokens":null}}'
          WHEN event_id % 23 = 0 THEN '[{"response":"x"}]'
          WHEN event_id % 3 = 0 AND event_id % 2 = 0 THEN concat('{"response":"r', cast(event_id AS string),
               '","prompt_eval_count":', cast(user_id AS string), ',"eval_count":2}')
          WHEN event_id % 3 = 0 THEN '{"done":true}'
          WHEN event_id % 3 = 1 AND event_id % 2 = 0 THEN concat('{"message":{"role":"assistant","content":"m',
               cast(event_id AS string), '"},"eval_count":', cast(user_id AS string), '}')
          WHEN event_id % 3 = 1 THEN '{"message":{}}'
          WHEN event_id % 2 = 0 THEN concat('{"choices":[{"message":{"content":"g', cast(event_id AS string),
               '"}}],"usage":{"prompt_tokens":3,"completion_tokens":4,"total_tokens":7}}')
          ELSE '{"choices":[{"message":{"content":null}}]}' END AS raw""")


def component_status(spark: SparkSession, root: str) -> DataFrame:
    return read_table(spark, root, "events").selectExpr(
        "concat('component_', cast(user_id AS string)) AS component", "ts",
        "CASE event_type WHEN 'error' THEN false WHEN 'view' THEN NULL ELSE true END AS healthy")


def tag_replies(spark: SparkSession, root: str) -> DataFrame:
    """Logged replies of the model-list endpoint, one per event (for L17)."""
    return read_table(spark, root, "events").selectExpr(
        "event_id",
        "CASE user_id % 3 WHEN 0 THEN 'llama3.2' WHEN 1 THEN 'mistral' ELSE 'm7' END AS model",
        """CASE event_id % 5 WHEN 0 THEN '{}'
          WHEN 1 THEN '{"models":[{"name":"llama3.2"},{"size":1}]}'
          WHEN 2 THEN concat('{"models":[{"name":"m', cast(user_id % 10 AS string), '"},{"name":"mistral"}]}')
          WHEN 3 THEN '{"models":[]}'
          ELSE concat('{"models":[{"name":"llama3.2"},{"name":"m', cast(event_id % 9 AS string), '"}]}') END
          AS reply""")


# --- providers: settings and functions ---

#: Registered providers in registration order: provider, model, temperature, max_tokens, timeout, host.
PROVIDERS = [
    ("ollama", "llama3.2", 0.7, 2048, 120, "http://localhost:11434/"),
    ("litellm", "openai/gpt-4", 0.2, 1024, 60, None),
    ("mock", "mock/model", 0.7, 2048, 120, None),
]


def unreachable(prompt, options: dict) -> dict:
    """The local server doesn't run here."""
    raise completion.ConnectionFailed(options.get("host"))


def moody(prompt: str, options: dict) -> dict:
    """A gateway by the prompt's words: an HTTP error, a crash or an answer that names the options it was given."""
    n = len(prompt.split())
    if n % 3 == 0:
        raise completion.HttpError(503, "busy")
    if n % 3 == 1:
        raise ValueError("no answer")
    said = f"{options['model']} {options['max_tokens']} {options['timeout']}"
    return {"content": said, "model": options["model"], "prompt_tokens": n, "completion_tokens": 3, "total_tokens": n + 3,
            "raw": {"prompt": prompt}}


def provider_registry() -> completion.ProviderRegistry:
    return completion.ProviderRegistry(list(PROVIDERS))


FUNCTIONS = {"ollama": unreachable, "litellm": moody, "mock": completion.mock_provider}


# --- readers of the uploads' bytes (plug-ins of the file and stream queries) ---

def text_layer(data: bytes) -> list[str]:
    """A native PDF's pages: cut at every '.'."""
    return data.decode("utf-8").split(".")


def line_images(data: bytes) -> list[bytes]:
    """A scanned PDF's page images: its lines."""
    return [x.encode() for x in data.decode("utf-8").split("\n")]


# --- DuckDB text of the same relations ---

DUCK: dict[str, str] = {
    "uploads": """SELECT doc_id AS file_id,
 concat('doc_', CAST(doc_id AS VARCHAR), CASE doc_id % 8 WHEN 0 THEN '.pdf' WHEN 1 THEN '.PDF' WHEN 2 THEN '.png'
   WHEN 3 THEN '.jpeg' WHEN 4 THEN '.TIFF' WHEN 5 THEN '.txt' WHEN 6 THEN '' ELSE '.tif' END) AS file_name,
 CASE doc_id % 5 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'image/png' WHEN 2 THEN NULL WHEN 3 THEN 'text/plain'
   ELSE 'IMAGE/PNG' END AS content_type,
 doc_id % 7 = 0 AS force_ocr,
 CASE doc_id % 4 WHEN 0 THEN 'eng' WHEN 1 THEN 'ara' WHEN 2 THEN 'xyz' ELSE NULL END AS language,
 lang, n_chars, text FROM documents""",
    "page_rects": """SELECT file_id, page_number, CAST(612 AS DOUBLE) AS width, CAST(792 AS DOUBLE) AS height
 FROM (SELECT doc_id AS file_id, unnest([1, 2]) AS page_number FROM documents WHERE doc_id % 11 <> 0)
 WHERE page_number = 1 OR file_id % 2 = 0""",
    "page_blocks": """SELECT file_id, 1 AS page_number, CAST(0 AS DOUBLE) AS x0, CAST(36 * b AS DOUBLE) AS y0,
 CAST(n_chars AS DOUBLE) AS x1, CAST(36 * b + 36 AS DOUBLE) AS y1
 FROM (SELECT doc_id AS file_id, n_chars, unnest([0, 1]) AS b FROM documents WHERE doc_id % 11 <> 0)""",
    "page_text": """SELECT doc_id AS file_id, CAST(generate_subscripts(string_split(text, '.'), 1) AS BIGINT) AS page_number,
 unnest(string_split(text, '.')) AS content FROM documents""",
    "store_documents": """SELECT concat('doc_', CAST(doc_id AS VARCHAR)) AS file_id,
 concat('doc_', CAST(doc_id AS VARCHAR)) AS file_name,
 TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id) AS created_at,
 TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id) AS updated_at,
 concat('{"src":"', source, '"}') AS metadata FROM documents WHERE doc_id % 3 <> 0""",
    "store_pages": """SELECT document_id, page_number, concat(p, '') AS content,
 concat('{"no":', CAST(page_number AS VARCHAR), '}') AS metadata FROM (
 SELECT concat('doc_', CAST(doc_id AS VARCHAR)) AS document_id,
 CAST(generate_subscripts(string_split(text, chr(10)), 1) AS BIGINT) AS page_number,
 unnest(string_split(text, chr(10))) AS p FROM documents WHERE doc_id % 3 <> 0)""",
    "repeated_pages": """SELECT document_id, page_number, concat(content, '#', CAST(seq AS VARCHAR)) AS content, metadata, seq
 FROM (SELECT *, unnest(CASE WHEN page_number % 3 = 0 THEN [2, 1] ELSE [1] END) AS seq FROM store_pages)""",
    "incoming_pages": """SELECT document_id, page_number, concat(p, '!') AS content,
 CASE WHEN page_number % 2 = 0 THEN NULL ELSE '{"new":true}' END AS metadata FROM (
 SELECT concat('doc_', CAST(doc_id AS VARCHAR)) AS document_id,
 CAST(generate_subscripts(string_split(text, chr(10)), 1) AS BIGINT) AS page_number,
 unnest(string_split(text, chr(10))) AS p FROM documents WHERE doc_id % 2 = 0 AND doc_id % 14 <> 0)""",
    "incoming_documents": """SELECT concat('doc_', CAST(doc_id AS VARCHAR)) AS file_name,
 CASE WHEN doc_id % 4 = 0 THEN NULL ELSE concat('{"run":"r', CAST(seq AS VARCHAR), '"}') END AS metadata, seq
 FROM (SELECT doc_id, unnest(CASE WHEN doc_id % 6 = 0 THEN [2, 1] ELSE [1] END) AS seq FROM documents WHERE doc_id % 2 = 0)""",
    "lookup_keys": """SELECT concat('doc_', CAST(doc_id AS VARCHAR)) AS file_id FROM documents WHERE doc_id % 10 = 0""",
    "page_updates": """SELECT concat('doc_', CAST(doc_id AS VARCHAR)) AS document_id,
 CAST(1 + doc_id % 3 AS BIGINT) AS page_number, concat('fixed ', CAST(doc_id AS VARCHAR)) AS content,
 CASE WHEN doc_id % 15 = 0 THEN '{"fixed":true}' END AS metadata
 FROM documents WHERE doc_id % 5 = 0""",
    "dirty_documents": """SELECT concat('doc_', CAST(doc_id - doc_id % 20 * CAST(doc_id % 3 = 0 AS INTEGER) AS VARCHAR)) AS file_id,
 CASE WHEN doc_id % 13 = 0 THEN NULL ELSE concat(source, '_', CAST(doc_id - doc_id % 40 AS VARCHAR)) END AS file_name
 FROM documents""",
    "dirty_pages": """SELECT concat('doc_', CAST(doc_id AS VARCHAR)) AS document_id, CAST(1 AS BIGINT) AS page_number,
 CASE WHEN doc_id % 17 = 0 THEN NULL ELSE text END AS content FROM documents""",
    "llm_requests": """SELECT doc_id AS request_id, text,
 CASE doc_id % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'Summarize: ' END AS prompt,
 concat('Translate to ', lang) AS instruction,
 CASE doc_id % 5 WHEN 0 THEN 'ollama' WHEN 1 THEN 'LiteLLM' WHEN 2 THEN 'MOCK' WHEN 3 THEN 'unknown' ELSE 'mock' END
   AS provider,
 CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'openai/gpt-4' WHEN 2 THEN 'llama3.2' ELSE '' END AS model,
 CASE WHEN doc_id % 6 = 0 THEN NULL ELSE CAST(doc_id % 30 AS DOUBLE) / 10 END AS temperature,
 CASE WHEN doc_id % 7 = 0 THEN NULL ELSE doc_id % 9 - 1 END AS max_tokens,
 CASE WHEN doc_id % 8 = 0 THEN NULL ELSE doc_id % 10 END AS timeout,
 CASE WHEN doc_id % 9 = 0 THEN concat('answer ', lang) ELSE NULL END AS mock_response FROM documents""",
    "raw_responses": """SELECT event_id,
 CASE event_id % 3 WHEN 0 THEN 'local_complete' WHEN 1 THEN 'local_chat' ELSE 'gateway' END AS shape,
 CASE WHEN event_id % 17 = 0 THEN 'not json'
  WHEN event_id % 19 = 0 THEN '{"response":null,"message":{"content":null},"prompt_eval_count":"x","eval_count":2.5,"usage":{"total_tokens":null}}'
  WHEN event_id % 23 = 0 THEN '[{"response":"x"}]'
  WHEN event_id % 3 = 0 AND event_id % 2 = 0 THEN concat('{"response":"r', CAST(event_id AS VARCHAR),
       '","prompt_eval_count":', CAST(user_id AS VARCHAR), ',"eval_count":2}')
  WHEN event_id % 3 = 0 THEN '{"done":true}'
  WHEN event_id % 3 = 1 AND event_id % 2 = 0 THEN concat('{"message":{"role":"assistant","content":"m',
       CAST(event_id AS VARCHAR), '"},"eval_count":', CAST(user_id AS VARCHAR), '}')
  WHEN event_id % 3 = 1 THEN '{"message":{}}'
  WHEN event_id % 2 = 0 THEN concat('{"choices":[{"message":{"content":"g', CAST(event_id AS VARCHAR),
       '"}}],"usage":{"prompt_tokens":3,"completion_tokens":4,"total_tokens":7}}')
  ELSE '{"choices":[{"message":{"content":null}}]}' END AS raw FROM events""",
    "component_status": """SELECT concat('component_', CAST(user_id AS VARCHAR)) AS component, ts,
 CASE event_type WHEN 'error' THEN false WHEN 'view' THEN NULL ELSE true END AS healthy FROM events""",
    "tag_replies": """SELECT event_id,
 CASE user_id % 3 WHEN 0 THEN 'llama3.2' WHEN 1 THEN 'mistral' ELSE 'm7' END AS model,
 CASE event_id % 5 WHEN 0 THEN '{}'
  WHEN 1 THEN '{"models":[{"name":"llama3.2"},{"size":1}]}'
  WHEN 2 THEN concat('{"models":[{"name":"m', CAST(user_id % 10 AS VARCHAR), '"},{"name":"mistral"}]}')
  WHEN 3 THEN '{"models":[]}'
  ELSE concat('{"models":[{"name":"llama3.2"},{"name":"m', CAST(event_id % 9 AS VARCHAR), '"}]}') END AS reply
 FROM events""",
    "provider_config": """SELECT * FROM (VALUES ('ollama', 'llama3.2', CAST(0.7 AS DOUBLE), 2048, 120,
 'http://localhost:11434/', 0), ('litellm', 'openai/gpt-4', CAST(0.2 AS DOUBLE), 1024, 60, NULL, 1),
 ('mock', 'mock/model', CAST(0.7 AS DOUBLE), 2048, 120, NULL, 2))
 AS t(provider, model, temperature, max_tokens, timeout, host, ordinal)""",
    "available_languages": """SELECT * FROM (VALUES ('eng'), ('ara'), ('osd')) AS t(language)""",
}


def with_ctes(query: str, *names: str) -> str:
    """Prefix ``query`` with the DuckDB fixture CTEs it names."""
    if not names:
        return query
    ctes = ",\n".join(f"{n} AS ({DUCK[n]})" for n in names)
    return f"WITH {ctes}\n{query}"
