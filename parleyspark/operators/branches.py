"""Branches of conversation trees: main branch, all threads, flattening; by pointer doubling over all conversations at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parleyspark.functions.keys import pack_key, unpack_key
from parleyspark.operators.hierarchy import point_at_roots
from parleyspark.operators.relational import NIL
from parleyspark.plans.stage import Stage


def _nodes(a) -> DataFrame:
    """(conv, id, parent, start, created, sender): parents count only within the conversation."""
    start = F.col("parent_message_uuid").isNull() | F.col("parent_message_uuid").isin("", NIL)
    m = a.messages.where("conversation_uuid is not null")
    m = m.select(pack_key(F.col("conversation_uuid")).alias("conv"), pack_key(F.col("uuid")).alias("id"), F.when(~start, pack_key(F.col("parent_message_uuid"))).alias("parent"), start.alias("start"), "created", "sender")
    return Stage(m).df


def _tree(m: DataFrame, first_root: bool = False, with_path: bool = False) -> DataFrame:
    """Of _nodes() those below the chosen start of their conversation: (conv, id, depth, ok, created, sender[, path]). ok: on the branch of latest children."""
    above = m.select(F.col("conv").alias("c2"), F.col("id").alias("p2"))
    linked = m.join(above, (F.col("conv") == F.col("c2")) & (F.col("parent") == F.col("p2")), "left").drop("c2")
    best = m.where("parent is not null").groupBy("conv", "parent").agg(F.max(F.struct("created", "id")).alias("b")).select(F.col("b.id").alias("id"), F.lit(True).alias("best"))
    n = linked.join(best, "id", "left").select("id", F.col("p2").alias("parent"), (F.col("start") | F.col("best").eqNullSafe(True)).alias("ok"))
    walked = point_at_roots(n, with_path)
    pick = F.min if first_root else F.max
    roots = m.where("start").groupBy("conv").agg(pick(F.struct("created", "id")).alias("r")).select("conv", F.col("r.id").alias("root_of"))
    t = m.join(walked, "id").join(roots, "conv").where("root = root_of and depth >= 0")
    return Stage(t.select("conv", "id", "parent", "depth", "ok", "created", "sender", *(["path"] if with_path else []))).df


def _named(t: DataFrame) -> DataFrame:
    return t.select(unpack_key(F.col("conv")).alias("conversation_uuid"), F.col("place").cast("bigint").alias("place"), unpack_key(F.col("id")).alias("message_uuid"))


def _chronological(m: DataFrame) -> DataFrame:
    return m.withColumn("place", F.row_number().over(Window.partitionBy("conv").orderBy(F.asc_nulls_first("created"), "id")))


def main_branch(a) -> DataFrame:
    """From the latest start on to the latest child; conversations without a start in the order of time."""
    m = _nodes(a)
    rootless = m.join(m.where("start").select("conv").distinct(), "conv", "left_anti")
    t = _tree(m).where("ok").withColumn("place", F.col("depth") + 1)
    return _named(t.select("conv", "id", "place").unionByName(_chronological(rootless).select("conv", "id", F.col("place").cast("bigint").alias("place"))))


def flattened(a) -> DataFrame:
    """From the first start on to the latest child; where that covers less than half of several messages, all in the order of time."""
    m = _nodes(a)
    t = _tree(m, first_root=True).where("ok").withColumn("place", F.col("depth") + 1)
    n = m.groupBy("conv").agg(F.count("*").alias("n_all"))
    kept = t.groupBy("conv").agg(F.count("*").alias("n_kept")).join(n, "conv").where("n_all <= 1 or 2 * n_kept >= n_all").select("conv")
    rest = m.join(kept, "conv", "left_anti")
    return _named(t.join(kept, "conv", "left_semi").select("conv", "id", "place").unionByName(_chronological(rest).select("conv", "id", F.col("place").cast("bigint").alias("place"))))


def _threads(a) -> DataFrame:
    """One row for each leaf below the latest start: (conv, leaf, path, devs, created, thread_index)."""
    t = _tree(_nodes(a), with_path=True)
    w = Window.partitionBy("conv", "parent").orderBy(F.asc_nulls_first("created"), "id")
    last = F.lead("id").over(w).isNull()
    turned = t.where("depth > 0").select("id", F.col("depth").alias("fork_depth"), (F.row_number().over(w) - 1).alias("sibling"), last.alias("last")).where("not last").drop("last")
    leaves = t.join(t.select(F.col("parent").alias("id")).where("id is not null").distinct(), "id", "left_anti")
    leaves = Stage(leaves).df
    steps = leaves.select("conv", F.col("id").alias("leaf"), F.explode("path").alias("id"))
    devs = steps.join(turned, "id").groupBy("leaf").agg(F.array_sort(F.collect_list(F.struct("fork_depth", "sibling"))).alias("devs"))
    x = leaves.withColumnRenamed("id", "leaf").join(devs, "leaf", "left").withColumn("devs", F.coalesce("devs", F.array().cast("array<struct<fork_depth:bigint,sibling:int>>")))
    order = Window.partitionBy("conv").orderBy(F.size("devs"), "devs", "leaf")
    return Stage(x.withColumn("thread_index", (F.row_number().over(order) - 1).cast("bigint"))).df


def branches(a) -> DataFrame:
    """All threads of every conversation: index 0 is the main branch, then by number of turns off it and their places."""
    t = _threads(a)
    fork = F.when(F.size("devs") > 0, F.element_at("devs", -1)["fork_depth"]).otherwise(0)
    t = t.select("conv", "thread_index", F.size("path").cast("bigint").alias("message_count"), fork.cast("bigint").alias("fork_depth"), "path", F.unix_millis("created").alias("last_message_ms"))
    t = t.withColumn("fork_point", F.when(F.col("fork_depth") > 0, F.element_at("path", F.col("fork_depth").cast("int")))).withColumn("first", F.element_at("path", (F.col("fork_depth") + 1).cast("int")))
    senders = a.messages.select(pack_key(F.col("uuid")).alias("first"), F.col("sender").alias("first_sender"))
    t = t.join(senders, "first")
    return t.select(unpack_key(F.col("conv")).alias("conversation_uuid"), "thread_index", "message_count", "fork_depth", unpack_key(F.col("fork_point")).alias("fork_point"), "last_message_ms", "first_sender")


def thread_messages(a, thread: int | None = None) -> DataFrame:
    """Messages of all threads (or of one index), in order; shared are those before the thread left the main branch."""
    t = _threads(a)
    if thread is not None:
        t = t.where(F.col("thread_index") == thread)
    fork = F.when(F.size("devs") > 0, F.element_at("devs", -1)["fork_depth"]).otherwise(0)
    t = t.select("conv", "thread_index", fork.alias("fork"), F.posexplode("path").alias("i", "id"))
    return t.select(unpack_key(F.col("conv")).alias("conversation_uuid"), "thread_index", F.col("i").cast("bigint").alias("place"), unpack_key(F.col("id")).alias("message_uuid"), (F.col("i") < F.col("fork")).alias("is_shared"))


def branch_points(a) -> DataFrame:
    """(conversation_uuid, branch_points): parents of several messages, starts of each kind included."""
    p = F.when(F.col("parent_message_uuid").isNull() | (F.col("parent_message_uuid") == ""), "__root__").otherwise(F.col("parent_message_uuid"))
    t = a.messages.where("conversation_uuid is not null").groupBy("conversation_uuid", p.alias("p")).agg(F.count("*").alias("n"))
    return t.groupBy("conversation_uuid").agg(F.count_if(F.col("n") > 1).alias("branch_points"))


def linear_thread(a) -> DataFrame:
    """Each message with the one before it in time: (message_uuid, previous_uuid)."""
    w = Window.partitionBy("conversation_uuid").orderBy(F.asc_nulls_first("created"), "uuid")
    return a.messages.select(F.col("uuid").alias("message_uuid"), F.lag("uuid").over(w).alias("previous_uuid"))
