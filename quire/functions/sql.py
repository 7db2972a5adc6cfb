"""The column helpers as Spark SQL functions, for users who write SQL.

``register_sql_functions(spark)`` defines temporary SQL functions whose bodies
are plain SQL expressions (inlined by the analyzer, so they stay in the JVM
and in whole-stage codegen). They use the same fixed values as the Python
helpers, so SQL and DataFrame code give identical results.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from quire.functions.text import PY_WHITESPACE
from quire.operators import intake, prompts


def sql_literal(value: str) -> str:
    """A Spark SQL string literal for ``value`` (non-ASCII and control characters as \\uXXXX)."""
    out = []
    for ch in value:
        if ch in "'\\" or not (0x20 <= ord(ch) < 0x7F):
            out.append("\\u%04x" % ord(ch))
        else:
            out.append(ch)
    return "'" + "".join(out) + "'"


def _definitions() -> dict[str, str]:
    ws = sql_literal(PY_WHITESPACE)
    spaces = sql_literal(" " * len(PY_WHITESPACE))
    mimes = ", ".join(sql_literal(m) for m in intake.IMAGE_MIME_TYPES)
    exts = ", ".join(sql_literal(e) for e in intake.IMAGE_EXTENSIONS)
    return {
        "py_strip(s STRING) RETURNS STRING": f"btrim(s, {ws})",
        "py_is_blank(s STRING) RETURNS BOOLEAN": f"btrim(s, {ws}) = ''",
        "py_token_count(s STRING) RETURNS BIGINT":
            f"CAST(size(array_remove(split(translate(coalesce(s, ''), {ws}, {spaces}), ' '), '')) AS BIGINT)",
        "parse_prompt(prompt STRING, content STRING) RETURNS STRING":
            f"concat(coalesce(nullif(prompt, ''), {sql_literal(prompts.DEFAULT_PARSE_PROMPT)}), content)",
        "enhance_prompt(instruction STRING, text STRING) RETURNS STRING":
            f"concat(instruction, {sql_literal(prompts.ENHANCE_SEPARATOR)}, text)",
        "is_image_file(content_type STRING, file_name STRING) RETURNS BOOLEAN":
            f"coalesce(content_type IN ({mimes}), false)"
            f" OR coalesce(element_at(split(lower(file_name), '[.]'), -1) IN ({exts}), false)",
        "is_pdf_file(content_type STRING, file_name STRING) RETURNS BOOLEAN":
            f"coalesce(content_type = {sql_literal(intake.PDF_MIME_TYPE)}, false)"
            " OR coalesce(endswith(lower(file_name), '.pdf'), false)",
        "unsupported_message(content_type STRING, file_name STRING) RETURNS STRING":
            f"concat({sql_literal(intake.UNSUPPORTED_PREFIX)}, coalesce(nullif(content_type, ''), file_name, 'None'))",
    }


def register_sql_functions(spark: SparkSession) -> list[str]:
    """Create (or replace) the temporary SQL functions; returns their names."""
    names = []
    for signature, body in _definitions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
        names.append(signature.split("(")[0])
    return names
