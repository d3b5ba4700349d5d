"""Entities in texts, and the profile of texts by pattern categories."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parleyspark.functions.patterns import CATEGORIES, ENTITIES, java, python
from parleyspark.plans.stage import Stage, spread

TOPICS = ENTITIES[2][1].removeprefix(r"\b(?:").removesuffix(r")\b").split("|")


_VERSION = ["uuid", "updated", "loaded_at", "created_at", "updated_at"]


def from_texts(a, compute, ordered: bool = False) -> DataFrame:
    """What ``compute`` makes of each text of the archive, once for each message and block.

    ``compute`` maps a table with a column ``text`` to one without it, row by row. It runs on the stored versions, before
    the repeats go, so that only its results and never the texts are shuffled.
    Columns: message_uuid, conversation_uuid, sender (NULL for blocks), and those of ``compute``; with ``ordered`` also ``order``, by
    which the messages of a conversation come before its blocks, each in their order.
    """
    place = lambda kind, at, key: [F.struct(F.lit(kind).alias("kind"), at.cast("bigint").alias("at"), key.alias("key")).alias("order")] if ordered else []
    m = compute(spread(a.message_versions(), "uuid").select(*_VERSION, "conversation_uuid", "sender", "text", F.col("text").isNotNull().alias("held"), *place(0, F.unix_millis("created"), F.col("uuid"))))
    m = a.last_versions(m).where("held").withColumnRenamed("uuid", "message_uuid").drop("held", *_VERSION[1:])
    b = spread(a.block_versions(), "id").where(F.col("block_type").isin("text", "thinking", "voice_note") & F.col("text_content").isNotNull())
    b = compute(b.select("id", "message_uuid", "conversation_uuid", F.lit(None).cast("string").alias("sender"), F.col("text_content").alias("text"), *place(1, F.col("id"), F.lit("")))).dropDuplicates(["id"]).drop("id")
    return m.unionByName(b)


def extract_entities(a) -> DataFrame:
    """(entity, type, message_uuid, conversation_uuid), each entity, type and message once; in the JVM throughout."""
    found = F.array(*[F.struct(F.lit(kind).alias("type"), F.regexp_extract_all("text", F.lit(java(p, False)), F.lit(0)).alias("found")) for kind, p in ENTITIES])
    t = from_texts(a, lambda t: t.withColumn("all", found).drop("text"))
    t = t.select("message_uuid", "conversation_uuid", F.inline("all")).select("message_uuid", "conversation_uuid", "type", F.explode("found").alias("entity"))
    tools = a.blocks.where("block_type = 'tool_use' and tool_name is not null").select("message_uuid", "conversation_uuid", F.lit("tool").alias("type"), F.col("tool_name").alias("entity"))
    both = t.unionByName(tools).withColumn("entity", F.lower("entity"))
    return both.groupBy("entity", "type", "message_uuid").agg(F.min("conversation_uuid").alias("conversation_uuid"))


_NAMES = [c for c, _, _ in CATEGORIES]
_FENCE = r"```(\w*)\s*\n"
_WORD = r"[^\s\p{Z}\x{85}\x0b\x1c-\x1f]+"


def profile_texts(t: DataFrame) -> DataFrame:
    """A table with its ``text`` replaced by one count for each category, code_blocks, langs, words and chars.

    One pass over the Arrow column for all categories, by its automaton-based regex kernel (RE2, which knows ASCII words
    and never backtracks); only texts with a fence become Python strings. Counted text by text: a conversation is never
    gathered into one string, however long it is; a match can't reach from one text into the next.
    """
    fence = python(_FENCE)
    at = t.columns.index("text")
    kept = [c for c in t.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            given = pc.fill_null(b.column(at), "")
            counts = [pc.count_substring_regex(given, p, ignore_case=not case).cast(pa.int64()) for _, p, case in CATEGORIES]
            fenced = pc.match_substring(given, "```").to_pylist()
            langs = [[m.group(1).lower() for m in fence.finditer(given[i].as_py())] if f else [] for i, f in enumerate(fenced)]
            words = pc.count_substring_regex(given, _WORD).cast(pa.int64())
            rest = [pa.array([len(x) for x in langs], pa.int64()), pa.array([sorted({y for y in x if y}) for x in langs], pa.list_(pa.string())), words, pc.utf8_length(given).cast(pa.int64())]
            yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(b.columns) if i != at), *counts, *rest], names=[*kept, *_NAMES, "code_blocks", "langs", "words", "chars"])

    fields = [t.schema[c] for c in kept] + [T.StructField(c, T.LongType()) for c in [*_NAMES, "code_blocks"]] + [T.StructField("langs", T.ArrayType(T.StringType())), T.StructField("words", T.LongType()), T.StructField("chars", T.LongType())]
    return t.mapInArrow(run, T.StructType(fields))


def profiles(a, structure: DataFrame) -> DataFrame:
    """The profile of every conversation: category counts, code blocks, words, primary type, technical density."""
    names = _NAMES
    per = from_texts(a, profile_texts)
    t = per.groupBy("conversation_uuid").agg(*[F.sum(c).alias(c) for c in [*names, "code_blocks", "words", "chars"]], F.count("sender").alias("n_texts"))
    langs = per.where("size(langs) > 0").select("conversation_uuid", F.explode("langs").alias("l")).distinct().groupBy("conversation_uuid").agg(F.array_join(F.array_sort(F.collect_list("l")), ",").alias("code_block_langs"))
    score = {
        "coding": F.col("code_keywords") + F.col("code_identifiers") + 3 * F.col("code_blocks"), "devops": F.col("docker_ops") + F.col("cli_commands") + F.col("git_operations"),
        "research": F.col("definitions") + F.col("doc_references") + F.col("urls"), "qa": F.col("question_patterns") + F.col("error_patterns"),
    }
    best = F.greatest(*score.values())
    kind = F.when(best == 0, "general")
    for k, v in score.items():
        kind = kind.when(v == best, k)
    total = sum(F.col(c) for c in names)
    # texts of a conversation count as joined by one blank
    density = F.least(F.lit(1.0), total / ((F.col("chars")) / 100))
    t = t.withColumn("primary_type", kind).withColumn("technical_density", F.round(F.when(F.col("chars") > 0, density).otherwise(0.0), 9))
    t = t.withColumn("avg_message_length", F.round(F.col("chars") / F.greatest("n_texts", F.lit(1)), 1))
    t = structure.join(t, "conversation_uuid", "left").join(langs, "conversation_uuid", "left")
    zero = [*names, "code_blocks", "words", "chars"]
    return t.select(
        *structure.columns, *[F.coalesce(c, F.lit(0)).alias(c) for c in zero], F.coalesce("code_block_langs", F.lit("")).alias("code_block_langs"), F.coalesce("primary_type", F.lit("general")).alias("primary_type"),
        F.coalesce("technical_density", F.lit(0.0)).alias("technical_density"), F.coalesce("avg_message_length", F.lit(0.0)).alias("avg_message_length"),
    )


def update_profiles(a, structure, existing: DataFrame | None = None, uuids: list[str] | None = None, rebuild: bool = False) -> DataFrame:
    """The table of profiles after a run: of the given conversations, of all (``rebuild``), or of those that ``existing`` hasn't.

    ``structure`` makes structural_metrics of an archive. Other profiles stay as they are. Only texts of the conversations of the run are read
    through; without a table, or with an empty one, the run is a rebuild.
    """
    if existing is None or rebuild or not existing.take(1):
        existing = None
        if uuids is None:
            return profiles(a, structure(a))
    if uuids is not None:
        todo = a.spark.createDataFrame([(u,) for u in uuids], "conversation_uuid string")
    else:
        todo = a.raw("messages").select("conversation_uuid").distinct().join(existing.select("conversation_uuid"), "conversation_uuid", "left_anti")
    part = a.restricted(Stage(todo.where("conversation_uuid is not null")).df)
    new = profiles(part, structure(part))
    return new if existing is None else existing.join(new.select("conversation_uuid"), "conversation_uuid", "left_anti").unionByName(new)


def sender_profiles(a) -> DataFrame:
    """(conversation_uuid, side, category, n): counts apart for human messages and for all else."""
    names = _NAMES
    per = from_texts(a, profile_texts).withColumn("side", F.when(F.col("sender") == "human", "human").otherwise("assistant"))
    t = per.groupBy("conversation_uuid", "side").agg(*[F.sum(c).alias(c) for c in names])
    return t.unpivot(["conversation_uuid", "side"], names, "category", "n").where("n > 0")


def category_details(a, keep: int = 5) -> DataFrame:
    """(conversation_uuid, category, match): the first ``keep`` matches of each category that differ in more than case, as they stand in the text.

    Within a text the first ``keep`` such matches are chosen where it is read; no other can be among the first of its conversation.
    """
    def first(p: str, case: bool) -> Column:
        every = F.regexp_extract_all("text", F.lit(java(p, case)), F.lit(0))
        new = F.slice(F.array_distinct(F.transform(every, F.lower)), 1, keep)
        # the spelling of the first match of each
        return F.transform(new, lambda x: F.element_at(F.filter(every, lambda m: F.lower(m) == x), 1))

    found = F.array(*[F.struct(F.lit(c).alias("category"), first(p, case).alias("found")) for c, p, case in CATEGORIES])
    t = from_texts(a, lambda t: t.withColumn("all", found).drop("text"), ordered=True).select("conversation_uuid", "order", F.inline("all"))
    t = t.select("conversation_uuid", "order", "category", F.posexplode("found").alias("pos", "match")).withColumn("low", F.lower("match"))
    t = t.groupBy("conversation_uuid", "category", "low").agg(F.min(F.struct("order", "pos", "match")).alias("m"))
    r = F.row_number().over(Window.partitionBy("conversation_uuid", "category").orderBy("m"))
    return t.withColumn("r", r).where(F.col("r") <= keep).select("conversation_uuid", "category", "m.match")


def profile_aggregates(p: DataFrame) -> DataFrame:
    """(metric, value): means over the profiles, the number of each type, the sum of each category."""
    names = _NAMES
    one = p.agg(F.round(F.avg("technical_density"), 3).alias("avg_density"), F.round(F.avg("words"), 0).alias("avg_words"), F.round(F.avg("duration_minutes"), 1).alias("avg_duration"), *[F.sum(c).cast("double").alias(c) for c in names])
    kinds = p.groupBy(F.concat(F.lit("type:"), "primary_type").alias("metric")).agg(F.count("*").cast("double").alias("value"))
    return one.unpivot([], one.columns, "metric", "value").unionByName(kinds)


def query_profiles(p: DataFrame, primary_type: str | None = None, min_density: float | None = None, order_by: str = "technical_density", limit: int = 20) -> DataFrame:
    if order_by not in ("technical_density", "code_blocks", "tool_invocations", "words", "duration_minutes"):
        raise ValueError(f"can't order profiles by {order_by}")
    if primary_type:
        p = p.where(F.col("primary_type") == primary_type)
    if min_density is not None:
        p = p.where(F.col("technical_density") >= min_density)
    return p.orderBy(F.desc(order_by), "conversation_uuid").limit(limit)
