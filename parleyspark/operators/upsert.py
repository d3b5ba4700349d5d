"""Upserts and deletions over immutable tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parleyspark.operators.relational import empty


def replace(base: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """INSERT OR REPLACE: rows of ``new`` take the place of those of the same key; the last of ``new`` by ``seq`` if it has one."""
    if "seq" in new.columns:
        w = Window.partitionBy(*key).orderBy(F.desc_nulls_last("seq"))
        new = new.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r", "seq")
    return base.join(new.select(*key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def ignore(base: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """INSERT OR IGNORE: only rows of ``new`` whose key is new."""
    return base.unionByName(new.dropDuplicates(key).join(base.select(*key), key, "left_anti"), allowMissingColumns=True)


def accumulate(base: DataFrame, new: DataFrame, key: list[str], column: str) -> DataFrame:
    """Upsert that adds ``column`` up; all else stays as it was first."""
    rest = [c for c in base.columns if c not in (*key, column)]
    both = base.withColumn("__o", F.lit(0)).unionByName(new.withColumn("__o", F.lit(1)), allowMissingColumns=True)
    return both.groupBy(*key).agg(F.sum(column).alias(column), *[F.min_by(c, "__o").alias(c) for c in rest])


def delete_conversations(a, conversations: DataFrame, graph: tuple[DataFrame, DataFrame] | None = None) -> dict[str, DataFrame]:
    """The archive's tables without some conversations (uuid), and of the graph (nodes, edges) what isn't theirs: their
    nodes go, and the edges that name them as their conversation or touch their node."""
    tables = {"conversations": (a.conversations, "uuid"), "messages": (a.messages, "conversation_uuid"), "content_blocks": (a.blocks, "conversation_uuid"), "entities": (a.entities, "conversation_uuid")}
    left = cascade_delete(tables, conversations)
    if graph:
        n, e = graph
        ids = conversations.select(F.concat(F.lit("conv:"), "uuid").alias("id"))
        left["graph_nodes"] = n.join(ids, "id", "left_anti")
        kept = e.join(conversations.select(F.col("uuid").alias("conversation_uuid")), "conversation_uuid", "left_anti")
        kept = kept.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_anti").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_anti")
        left["graph_edges"] = kept.select(e.columns)
    return left


def delete_empty(a, dry_run: bool = True, limit: int = 10_000) -> DataFrame | dict[str, DataFrame]:
    """Conversations without messages: those that would go (dry run), or the tables without them. The oldest ``limit`` at once."""
    gone = empty(a).orderBy("created_at", "uuid").limit(limit)
    return gone if dry_run else delete_conversations(a, gone.select("uuid"))


def cascade_delete(tables: dict[str, tuple[DataFrame, str]], conversations: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows of some conversations (uuid); each table comes with the column of its conversation."""
    return {k: t.join(conversations.select(F.col("uuid").alias(c)), c, "left_anti") for k, (t, c) in tables.items()}
