"""Storing an archive: imports become tables, attachments and artifacts become files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parleyspark.operators.relational import artifacts, attachments
from parleyspark.operators.upsert import ignore, replace
from parleyspark.sources.archive import Archive

#: The key of each table, and whether a stored row stays as it is when its key comes again.
KEYS = {"conversations": (["uuid"], False), "messages": (["uuid"], False), "content_blocks": (["message_uuid", "block_index"], False), "entities": (["entity", "type", "message_uuid"], True), "projects": (["uuid"], False), "conversation_profiles": (["conversation_uuid"], False)}
#: The names of their folders.
NAMES = {"conversations": "archive_conversations"}


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def store(spark: SparkSession, tables: dict[str, DataFrame], root: str) -> None:
    """Upsert tables of an import into the archive at ``root``.

    All tables are written beside the old ones first; only when every write has ended do they change places, each by a
    rename. An import that fails leaves the archive as it was. Rows of the import take the place of stored ones of the
    same key (entities stay). Blocks of a message that comes again are replaced as a whole. Of repeated keys within an import one counts, the last by
    ``updated_at`` where there is such a column.
    """
    root, run = root.rstrip("/"), uuid.uuid4().hex
    fs, path = _fs(spark, root)
    moves = []
    try:
        for name, new in tables.items():
            key, keep = KEYS[name]
            target = f"{root}/{NAMES.get(name, name)}.parquet"
            new = new.where(" and ".join(f"{c} is not null" for c in key))
            if not keep:
                order = F.max_by(F.struct(*new.columns), F.struct(F.col("updated_at").try_cast("timestamp"), *[c for c in new.columns if c != "updated_at" and new.schema[c].dataType.typeName() != "variant"])) if "updated_at" in new.columns else F.max(F.struct(*new.columns))
                new = new.groupBy(*[F.col(c).alias(f"__{c}") for c in key]).agg(order.alias("__row")).select("__row.*")
            if fs.exists(path(target)):
                old = spark.read.parquet(target)
                if name == "content_blocks":
                    new = old.join(tables["messages"].select(F.col("uuid").alias("message_uuid")) if "messages" in tables else new.select("message_uuid"), "message_uuid", "left_anti").unionByName(new, allowMissingColumns=True)
                else:
                    new = ignore(old, new, key) if keep else replace(old, new, key)
            new.write.parquet(f"{target}.{run}")
            moves.append(target)
    except BaseException:
        for name in tables:
            fs.delete(path(f"{root}/{NAMES.get(name, name)}.parquet.{run}"), True)
        raise
    for target in moves:
        if fs.exists(path(target)):
            fs.rename(path(target), path(f"{target}.{run}.old"))
        fs.rename(path(f"{target}.{run}"), path(target))
    for target in moves:
        fs.delete(path(f"{target}.{run}.old"), True)


def dump_attachments(a: Archive, to: str) -> None:
    """The text of each attachment as a file below conversation_uuid=.../message_uuid=.../place=..."""
    m = a.messages_with("conversation_uuid").withColumnRenamed("uuid", "message_uuid")
    t = attachments(a, 2**31 - 1).join(m, "message_uuid")
    t.select("conversation_uuid", "message_uuid", "place", "content").write.partitionBy("conversation_uuid", "message_uuid", "place").text(to)


def dump_artifacts(a: Archive, to: str) -> None:
    """The content of each document that a tool call created as a file below message_uuid=.../id=..."""
    artifacts(a, 2**31 - 1).select("message_uuid", "id", "content").write.partitionBy("message_uuid", "id").text(to)
