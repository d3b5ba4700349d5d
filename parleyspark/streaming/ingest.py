"""Continuous import of session logs, and mentions by week as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from parleyspark.plans.stage import Stage
from parleyspark.sources.exports import session_tables

ENTRY = "session string, uuid string, parent_uuid string, type string, created_at string, content string"
#: Slots of the table of sessions; a batch rewrites those of its sessions.
SLOTS = 64


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def session_lines(spark: SparkSession, path: str) -> DataFrame:
    """A stream of entries of session logs: new files are taken up as they come."""
    t = spark.readStream.format("text").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").load(path)
    t = t.withColumn("file", F.col("_metadata.file_path")).withColumn("block", F.col("_metadata.file_block_start")).withColumn("j", F.try_parse_json(F.trim("value"))).where("j is not null")
    get = lambda p: F.try_variant_get("j", p, "string")
    t = t.select(F.regexp_extract("file", r"([^/]+)\.jsonl$", 1).alias("session"), get("$.uuid").alias("uuid"), get("$.parentUuid").alias("parent_uuid"), get("$.type").alias("type"), get("$.timestamp").alias("created_at"), get("$.cwd").alias("cwd"), get("$.version").alias("version"), F.try_variant_get("j", "$.message.content", "variant").alias("content"), "file", "block")
    return t.where("type in ('user', 'assistant')")


def import_stream(spark: SparkSession, path: str, target: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Write new logs to Parquet: messages to ``target``, blocks to ``target``_content_blocks, sessions to ``target``_conversations.

    An entry (session and uuid) that an earlier batch or line holds already goes, however old it is; entries without a uuid
    all stay. Messages and blocks are in a folder for each batch, which a repeated batch replaces. A session is one row, made
    of all its entries so far (kept in ``target``_entries): its slot of the table is written anew, from the entries only.
    """
    parts = {"messages": target, "content_blocks": f"{target}_content_blocks"}
    conversations, entries = f"{target}_conversations", f"{target}_entries"

    def write(batch: DataFrame, number: int) -> None:
        s = batch.sparkSession
        t = batch.withColumn("line", F.struct("file", "block", F.monotonically_increasing_id().alias("row")))
        t = t.withColumn("slot", F.pmod(F.xxhash64("session"), F.lit(SLOTS)).cast("int")).withColumn("content", F.to_json("content"))
        first = Window.partitionBy("session", "uuid").orderBy("line")
        t = t.withColumn("r", F.row_number().over(first)).where("uuid is null or r = 1").drop("r")
        if _exists(s, entries):
            old = s.read.parquet(entries).where(F.col("batch") != number)
            t = t.join(old.select("session", "uuid"), ["session", "uuid"], "left_anti")
        new = Stage(t)
        new.df.write.mode("overwrite").parquet(f"{entries}/batch={number}")
        variant = lambda x: x.withColumn("content", F.try_parse_json("content"))
        got = session_tables(variant(new.df))
        for name, folder in parts.items():
            got[name].write.mode("overwrite").parquet(f"{folder}/batch={number}")
        slots = [r[0] for r in new.df.select("slot").distinct().collect()]  # at most SLOTS
        if slots:
            every = s.read.parquet(entries).where(F.col("slot").isin(slots))
            # pieces of a session follow each other by their first instants, lines of a piece by their place
            piece = F.min(F.col("created_at").try_cast("timestamp")).over(Window.partitionBy("session", "batch", "line.file"))
            every = every.withColumn("line", F.struct(piece.alias("at"), "batch", "line"))
            c = session_tables(variant(every))["conversations"].withColumn("slot", F.pmod(F.xxhash64("uuid"), F.lit(SLOTS)).cast("int"))
            c.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("slot").parquet(conversations)
        new.drop()

    w = session_lines(spark, path).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def weekly_mentions(mentions: DataFrame, late: str = "30 days") -> DataFrame:
    """(entity, week, mentions) of a stream of (entity, at): weeks from Monday on, rows late by more than ``late`` left out."""
    # windows count from Thursday, 1970-01-01; Monday is four days later
    week = F.window("at", "7 days", "7 days", "4 days")
    return mentions.withWatermark("at", late).groupBy("entity", week.alias("w")).agg(F.count("*").alias("mentions")).select("entity", F.date_format("w.start", "yyyy-MM-dd").alias("week"), "mentions")
