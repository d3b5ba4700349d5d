"""Conversations as Markdown, compact XML or JSON: one row for each message, in order, so that no conversation has to fit in a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parleyspark.operators.branches import main_branch


def escape(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def sections(a) -> DataFrame:
    """(conversation_uuid, place, markdown, xml, json) of the messages on main branches."""
    m = a.messages.select(F.col("uuid").alias("message_uuid"), "sender", "text", "created_at")
    t = main_branch(a).join(m, "message_uuid")
    who = F.when(F.lower(F.trim("sender")).isin("human", "user"), "Human").otherwise("Assistant")
    text = F.coalesce("text", F.lit(""))
    tag = F.when(F.lower(F.trim("sender")).isin("human", "user"), "human").otherwise("assistant")
    return t.select(
        "conversation_uuid", "place", F.concat(F.lit("### **"), who, F.lit("** — "), F.coalesce("created_at", F.lit("")), F.lit("\n\n"), text, F.lit("\n")).alias("markdown"),
        F.concat(F.lit("<"), tag, F.lit(">"), escape(text), F.lit("</"), tag, F.lit(">")).alias("xml"), F.to_json(F.struct("sender", "text", "created_at"), {"ignoreNullFields": "false"}).alias("json"),
    )


def headers(a) -> DataFrame:
    """(conversation_uuid, markdown, xml) of what stands before the messages of a conversation."""
    n = main_branch(a).groupBy("conversation_uuid").agg(F.count("*").alias("n"))
    t = a.conversations.select(F.col("uuid").alias("conversation_uuid"), F.coalesce(F.nullif("name", F.lit("")), F.lit("Untitled")).alias("title"), F.coalesce("created_at", F.lit("")).alias("at")).join(n, "conversation_uuid", "left")
    markdown = F.concat(F.lit("# "), "title", F.lit("\n\n**ID:** "), "conversation_uuid", F.lit("\n**Created:** "), "at", F.lit("\n**Messages:** "), F.coalesce("n", F.lit(0)).cast("string"), F.lit("\n\n---\n"))
    xml = F.concat(F.lit('<conversation title="'), escape(F.col("title")), F.lit('" id="'), "conversation_uuid", F.lit('">'))
    return t.select("conversation_uuid", markdown.alias("markdown"), xml.alias("xml"))


def tool_sections(a, use_chars: int = 300, result_chars: int = 600) -> DataFrame:
    """(id, message_uuid, line): tool calls and results in one line each, cut."""
    cut = lambda c, n: F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("…"))).otherwise(c)
    use = F.concat(F.lit("[tool_use:"), F.coalesce("tool_name", F.lit("")), F.lit("] "), cut(F.coalesce("tool_input", F.lit("")), use_chars))
    got = F.concat(F.lit("[tool_result] "), cut(F.coalesce("text_content", F.lit("")), result_chars))
    return a.blocks.where("block_type in ('tool_use', 'tool_result')").select("id", "message_uuid", F.when(F.col("block_type") == "tool_use", use).otherwise(got).alias("line"))
