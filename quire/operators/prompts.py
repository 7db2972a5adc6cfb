"""Prompt construction (L1-L5): string columns built in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The default parse prompt, the enhance separator and the chat
# context prefix.
DEFAULT_PARSE_PROMPT = "Extract and summarize the key information from the following document:\n\n"
ENHANCE_SEPARATOR = ":\n\n"
CHAT_CONTEXT_PREFIX = "You are analyzing a document. Document content:\n\n"
ROLE_SYSTEM = "system"


def parse_prompt(prompt: Column, content: Column) -> Column:
    """``f"{prompt or default}{content}"``: NULL and '' both select the default; no separator."""
    return F.concat(F.coalesce(F.nullif(prompt, F.lit("")), F.lit(DEFAULT_PARSE_PROMPT)), content)


def enhance_prompt(instruction: Column, text: Column) -> Column:
    return F.concat(instruction, F.lit(ENHANCE_SEPARATOR), text)


def chat_context(document_text: Column) -> Column:
    return F.concat(F.lit(CHAT_CONTEXT_PREFIX), document_text)


#: What a conversation about an unknown document gets instead of messages.
NO_DOCUMENT = "Document not found"


def chat_requests(conversations: DataFrame, documents: DataFrame) -> DataFrame:
    """L3 as one row per conversation: ``(conv_id, error, messages ARRAY<STRUCT<role, content>>)``, system first.

    A conversation whose document isn't there has an ``error``; its messages mustn't be sent.
    """
    from quire.operators.assemble import ordered_collect

    msgs = ordered_collect(conversations.withColumnRenamed("text", "content"), ["conv_id"], "turn",
                           ["role", "content"]).withColumnRenamed("items", "msgs")
    docs = documents.select(F.col("doc_id").alias("conv_id"), F.col("text").alias("doc_text"), F.lit(True).alias("_known"))
    return msgs.join(docs, "conv_id", "left").select(
        "conv_id", F.when(F.col("_known").isNull(), F.lit(NO_DOCUMENT)).alias("error"),
        F.concat(F.array(F.struct(F.lit(ROLE_SYSTEM).alias("role"), chat_context(F.col("doc_text")).alias("content"))),
                 F.transform("msgs", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))))
        .alias("messages"))


def chat_messages(conversations: DataFrame, documents: DataFrame) -> DataFrame:
    """L3: each conversation's messages in turn order with a system message prepended.

    ``conversations(conv_id, turn, role, text)``, ``documents(doc_id, text)``;
    output ``(conv_id, position, role, content)``, position 0 being the system
    message. The message list is gathered per conversation in turn chunks (a
    very long conversation is split over tasks) and joined to its document once.
    """
    full = chat_requests(conversations, documents).filter(F.col("error").isNull())
    return full.select("conv_id", F.posexplode("messages").alias("position", "m")).select(
        "conv_id", F.col("position").cast("bigint").alias("position"),
        F.col("m.role").alias("role"), F.col("m.content").alias("content"))
