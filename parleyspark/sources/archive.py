"""The archive's canonical tables: what an upsert by primary key leaves of the stored rows."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parleyspark.functions.keys import instant
from parleyspark.sources.tables import table


def latest_by(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """Last-wins upsert: one row for each key. The rank is limited before the shuffle, so that hot keys stay small."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")


#: What orders the stored versions of a message, last first.
VERSION = ["updated", "loaded_at", "created_at", "updated_at"]


@dataclass
class Archive:
    spark: SparkSession
    root: str

    def raw(self, name: str) -> DataFrame:
        return table(self.spark, self.root, name)

    def restricted(self, conversations: DataFrame) -> Archive:
        """The archive with the messages, blocks and entities of some conversations (conversation_uuid) only."""
        whole, part = self, Archive(self.spark, self.root)

        def raw(name: str) -> DataFrame:
            t = whole.raw(name)
            return t.join(conversations, "conversation_uuid", "left_semi").select(t.columns) if name in ("messages", "content_blocks", "entities") else t

        part.raw = raw
        return part

    def has(self, name: str) -> bool:
        """Whether the archive holds this table; older ones lack some."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root.rstrip('/')}/{name}.parquet")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    @cached_property
    def conversations(self) -> DataFrame:
        t = self.raw("archive_conversations").where("uuid is not null")
        t = t.withColumn("created", instant(F.col("created_at"))).withColumn("updated", instant(F.col("updated_at")))
        return latest_by(t, ["uuid"], [F.desc_nulls_last("updated"), F.desc_nulls_last("name"), F.desc_nulls_last("updated_at"), F.desc_nulls_last("created_at")])

    def message_versions(self) -> DataFrame:
        """All stored versions, with instants; what is computed from their texts here need not shuffle the texts."""
        t = self.raw("messages").where("uuid is not null")
        return t.withColumn("created", instant(F.col("created_at"))).withColumn("updated", instant(F.col("updated_at")))

    @staticmethod
    def last_versions(versions: DataFrame) -> DataFrame:
        return latest_by(versions, ["uuid"], [F.desc_nulls_last(c) for c in VERSION])

    @cached_property
    def messages(self) -> DataFrame:
        return self.last_versions(self.message_versions())

    def messages_with(self, *columns) -> DataFrame:
        """(uuid, *columns) of the messages; the columns are made of the stored versions where they are read, so that texts needn't be shuffled."""
        v = self.message_versions().select("uuid", F.struct(*columns).alias("__made"), *[F.col(c).alias(f"__{c}") for c in VERSION])
        w = Window.partitionBy("uuid").orderBy(*[F.desc_nulls_last(f"__{c}") for c in VERSION])
        return v.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").select("uuid", "__made.*")

    def block_versions(self) -> DataFrame:
        return self.raw("content_blocks").where("id is not null")

    @cached_property
    def blocks(self) -> DataFrame:
        return self.raw("content_blocks").where("id is not null").dropDuplicates(["id"])

    @cached_property
    def entities(self) -> DataFrame:
        t = self.raw("entities").where("entity is not null and trim(entity) != '' and message_uuid is not null")
        t = t.withColumn("entity", F.lower(F.trim("entity")))
        return t.groupBy("entity", "type", "message_uuid").agg(F.min("conversation_uuid").alias("conversation_uuid"))

    @cached_property
    def projects(self) -> DataFrame:
        t = self.raw("projects").where("uuid is not null").withColumn("fetched", instant(F.col("fetched_at")))
        return latest_by(t, ["uuid"], [F.desc_nulls_last("fetched"), F.desc_nulls_last("name")])


#: The same tables in DuckDB: conversations c, messages m, content blocks b, entities e, projects p.
CANON = """c AS (SELECT *, created_at::TIMESTAMPTZ AS created, updated_at::TIMESTAMPTZ AS updated FROM archive_conversations WHERE uuid IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY uuid ORDER BY updated_at::TIMESTAMPTZ DESC NULLS LAST, name DESC NULLS LAST, updated_at DESC NULLS LAST, created_at DESC NULLS LAST) = 1),
m AS (SELECT *, created_at::TIMESTAMPTZ AS created, updated_at::TIMESTAMPTZ AS updated FROM messages WHERE uuid IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY uuid ORDER BY updated_at::TIMESTAMPTZ DESC NULLS LAST, loaded_at DESC NULLS LAST, created_at DESC NULLS LAST, updated_at DESC NULLS LAST) = 1),
b AS (SELECT * FROM content_blocks WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id) = 1),
e AS (SELECT lower(trim(entity)) AS entity, type, message_uuid, min(conversation_uuid) AS conversation_uuid FROM entities WHERE entity IS NOT NULL AND trim(entity) <> '' AND message_uuid IS NOT NULL GROUP BY 1, 2, 3),
p AS (SELECT * FROM projects WHERE uuid IS NOT NULL QUALIFY row_number() OVER (PARTITION BY uuid ORDER BY fetched_at::TIMESTAMPTZ DESC NULLS LAST, name DESC NULLS LAST) = 1)"""
