"""Titles for conversations that have none."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parleyspark.functions.text import extract_title, title_case
from parleyspark.operators.relational import untitled


def _first(a, sender: str, skip: bool) -> DataFrame:
    """The title that the first message of a sender gives; a minimum by key, with partial aggregates."""
    t = a.messages.where(F.col("sender") == sender).groupBy(F.col("conversation_uuid").alias("uuid")).agg(F.min(F.struct("created", F.col("uuid").alias("m"), "text")).alias("f"))
    return t.select("uuid", extract_title(F.col("f.text"), skip).alias("title"))


def generate_titles(a) -> DataFrame:
    """(uuid, title, source) of untitled conversations: from the first answer, else the three most frequent topics, else the first question."""
    given = _first(a, "assistant", True).where(F.length("title") >= 10).select("uuid", F.col("title").alias("t1"))
    n = a.entities.where("type = 'topic'").groupBy(F.col("conversation_uuid").alias("uuid"), "entity").agg(F.count("*").alias("n"))
    r = F.row_number().over(Window.partitionBy("uuid").orderBy(F.desc("n"), "entity"))
    topics = n.withColumn("r", r).where("r <= 3").groupBy("uuid").agg(F.array_sort(F.collect_list(F.struct("r", title_case(F.col("entity")).alias("e")))).alias("x"))
    topics = topics.select("uuid", F.array_join(F.transform("x", lambda x: x["e"]), ", ").alias("t2")).where(F.length("t2") >= 3)
    asked = _first(a, "human", False).where(F.length("title") >= 5).select("uuid", F.col("title").alias("t3"))
    t = untitled(a).select("uuid").join(given, "uuid", "left").join(topics, "uuid", "left").join(asked, "uuid", "left")
    source = F.when(F.col("t1").isNotNull(), "assistant").when(F.col("t2").isNotNull(), "entities").when(F.col("t3").isNotNull(), "human")
    return t.select("uuid", F.coalesce("t1", "t2", "t3").alias("title"), source.alias("source")).where("title is not null")


def rename_untitled(a, dry_run: bool = False, limit: int | None = None) -> DataFrame:
    """All conversations, untitled ones with their new title where there is one; the last updated ones only with ``limit``.
    A dry run gives the renamings alone, (uuid, title, source)."""
    t = generate_titles(a)
    if limit:
        t = t.join(untitled(a, limit).select("uuid"), "uuid", "left_semi")
    if dry_run:
        return t
    t = t.select("uuid", F.col("title").alias("new_name"))
    return a.conversations.join(t, "uuid", "left").select("uuid", F.coalesce("new_name", "name").alias("name"), F.col("new_name").isNotNull().alias("renamed"))
