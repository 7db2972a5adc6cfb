"""The registered queries ``opN_<name>`` and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (alignment, chat, decontaminate, importance, jaccard, linechunks, packing, pseudolikelihood, rules, substrings,
               targeted, urls, zipwarc)
from .common import table, written


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted, and what is read back from it; conversation -7 holds control strings."""
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                  F.lit("\\### Assistant: </turn> ok").alias("text"))
    out = chat.format_conversations(said.unionByName(extra))
    told = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return out.select("conv_id", F.size("read").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
                      F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
                      F.length("formatted").cast("long").alias("formatted_chars"))


def op2_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's summed conditional log-probabilities under the model of all documents."""
    out = pseudolikelihood.fitted_scores(table(spark, sf_dir, "documents"))
    return out.withColumn("log_prob_per_word", F.col("log_prob") / F.greatest("n_words", F.lit(1)))


def op3_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's statistics, the base rules' result and the learned decision list's verdict."""
    out, _ = rules.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_zip_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written as a WARC record into ZIP archives, then read back from them by ranges."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url", F.encode("html", "UTF-8").alias("payload"))
    manifest = zipwarc.write_archives(zipwarc.with_record_types(pages), zipwarc.shared_folder(spark))
    out = zipwarc.resolved(written(zipwarc.read_archives(manifest), "records"))
    return out.select(F.col("id").cast("long").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"),
                      "record_type", F.col("refers_to").cast("long").alias("refers_to"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's class of near copies and its number of links."""
    out = jaccard.with_class_id(jaccard.join(table(spark, sf_dir, "documents")))
    return out.select("doc_id", "class_id", "n_links", "n_shingles")


#: Rules given for the pages: host, path, allowed.
URL_RULES = [("com", "/", True), ("example.com", "/en/", False), ("www.example.com", "/en/", True),
             ("net", "/es/", False), ("net", "/fr/", False)]


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL judged by the rules, and by its host's path templates where none fits."""
    return urls.judged(table(spark, sf_dir, "pages"), URL_RULES).select(
        "page_id", "host", "path", "rule", "verdict", "template", "purity")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document, placed in sequences of at most 2048 tokens."""
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text without repeated passages and line chunks; n_removed counts lines."""
    out = linechunks.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), linechunks.PASSAGE)
    return out.select("_in.doc_id", "text", "n_removed", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars_left"))


def op9_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log importance weight, its Gumbel score and whether it is kept."""
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document judged against every benchmark item."""
    out = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.coalesce("items", F.array().cast("array<string>"))
    return out.select("doc_id", "n_words", "n_hit", F.size(items).cast("long").alias("n_items"),
                      F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
                      decontaminate.contaminated().alias("contaminated"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens by two tokenizers, cut into groups, and how its links stand in the corpus."""
    import public_tokenizers

    return alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                           public_tokenizers.path("piece_bpe_32k.model"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words that 35-word windows found elsewhere cover."""
    return substrings.cut_repeats(table(spark, sf_dir, "documents"))


def op13_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's gain towards the benchmark's words, its score, and the rank of those drawn."""
    return targeted.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_features", "weight", "score", "rank")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_format": op1_chat_format,
    "op2_pseudo_likelihood": op2_pseudo_likelihood,
    "op3_decision_list": op3_decision_list,
    "op4_zip_warc": op4_zip_warc,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_url_filter": op6_url_filter,
    "op7_packing": op7_packing,
    "op8_line_chunks": op8_line_chunks,
    "op9_importance": op9_importance,
    "op10_decontaminate": op10_decontaminate,
    "op11_token_alignment": op11_token_alignment,
    "op12_substring_dedup": op12_substring_dedup,
    "op13_target_resampling": op13_target_resampling,
}

ORACLE: dict[str, str] = {
    "op1_chat_format": r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS given FROM conversations
  UNION ALL SELECT -7, turn, role, '\### Assistant: </turn> ok', role FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(turn, role)),
p AS (SELECT conv_id, count(*) AS n_turns,
  string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, given NULLS FIRST, text) AS told,
  coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, given NULLS FIRST, text) FILTER (role = 'assistant'), '') AS loss,
  sum(length('<|turn|>' || replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n') || chr(10)
      || replace(replace(text, '\', '\\'), '<|', '<\|') || '<|end|>' || chr(10))) AS chars,
  string_agg(coalesce(given, '?'), ',' ORDER BY turn NULLS FIRST, given NULLS FIRST, text) AS roles
  FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(told) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(chars AS BIGINT) AS formatted_chars FROM p""",
    "op4_zip_warc": r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body) AS n, sha256(body) AS digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to FROM f""",
    "op10_decontaminate": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') AS w,
             row_number() OVER () AS r FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), 13) AS n,
         unnest(list_transform(range(1, len(w) - least(len(w), 13) + 2),
                lambda i: array_to_string(w[i:i + least(len(w), 13) - 1], ' '))) AS g FROM b WHERE len(w) > 0),
n AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, n.n, unnest(list_transform(range(1, len(w) - n.n + 2), lambda i:
         {'i': i, 'g': array_to_string(w[i:i + n.n - 1], ' ')}), recursive := true) FROM d, n WHERE len(w) >= n.n),
h AS (SELECT r, i, dw.n, item FROM dw JOIN bw USING (n, g)),
c AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM h) GROUP BY r),
t AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN t USING (r)""",
    "op12_substring_dedup": r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r,
             regexp_extract_all(coalesce(text, ''), '[^\x{20}\x{09}-\x{0D}]+') AS w FROM documents),
g AS (SELECT r, p, md5(array_to_string(w[p:p + 34], chr(10))) AS h
      FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS p FROM d WHERE len(w) >= 35)),
again AS (SELECT h FROM g GROUP BY h HAVING count(*) > 1),
covered AS (SELECT DISTINCT r, unnest(range(p, p + 35)) AS p FROM g JOIN again USING (h)),
words AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS text
         FROM words ANTI JOIN covered USING (r, p) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)""",
    "op13_target_resampling": r"""
WITH crc_step AS (SELECT list_transform(range(0, 256), lambda b: list_reduce(range(0, 8),
        lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)) AS t),
d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') AS w FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') AS w FROM benchmark),
dw AS (SELECT r, unnest(w) AS word FROM d), bw AS (SELECT unnest(w) AS word FROM b),
each AS (SELECT DISTINCT word, hex(encode(word)) AS h FROM (SELECT word FROM dw UNION ALL SELECT word FROM bw)),
coded AS (SELECT word, xor(list_reduce(list_transform(range(1, len(h), 2), lambda i: CAST(('0x' || h[i:i + 1]) AS BIGINT)),
        lambda c, x: xor(c >> 8, t[CAST(xor(c & 255, x) AS INTEGER) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) % 10000 AS bucket
      FROM each, crc_step),
s AS (SELECT bucket, count(*) AS s FROM dw JOIN coded USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM bw JOIN coded USING (word) GROUP BY bucket),
n AS (SELECT (SELECT count(*) FROM dw)::DOUBLE AS ds, (SELECT count(*) FROM bw)::DOUBLE AS bs),
gain AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * (ds + 10000)
        / ((coalesce(s, 0) + 1.0::DOUBLE) * (bs + 10000)))) AS BIGINT) AS gain
      FROM s FULL JOIN t USING (bucket), n),
weights AS (SELECT r, sum(gain) AS total FROM dw JOIN coded USING (word) JOIN gain USING (bucket) GROUP BY r),
scored AS (SELECT doc_id, r, CAST(len(w) AS BIGINT) AS n_features,
        CASE WHEN len(w) = 0 THEN 0 ELSE CAST(floor(coalesce(total, 0)::DOUBLE / len(w)) AS BIGINT) END AS weight,
        CAST(floor(-1000 * ln(-ln((CAST('0x' || sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), ''))[1:8] AS BIGINT) + 0.5::DOUBLE)
          / 4294967296.0::DOUBLE))) AS BIGINT) AS noise FROM d LEFT JOIN weights USING (r)),
ranked AS (SELECT r, row_number() OVER (ORDER BY weight + noise DESC, doc_id NULLS LAST, r) AS rank,
        count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, CAST(weight + noise AS BIGINT) AS score,
       CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM scored LEFT JOIN ranked USING (r)""",
}
