"""Rebuilding conversations from message rows.

The rows are an event log: creates, edits, deletes and retries of a message share its uuid, and the last version of a
message is the one that counts. Surviving messages are linked to their parents; one pass of pointer doubling over these
links gives each message its depth, its root, and whether it and all above it are the latest child of their parent,
which is what makes the thread. No step gathers a conversation in one task: everything but the ranks of conversations
without links is an aggregate by keys, and those ranks come from ranges of the sorted rows.

Defined cases: rows with a null uuid or conversation are left out; null, empty and nil parents start a conversation; of
equal instants the larger uuid is the later one; instants that can't be read are the earliest; texts without a visible
character don't count as text; an empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parleyspark.functions.keys import instant, pack_key, unpack_key
from parleyspark.operators.hierarchy import point_at_roots
from parleyspark.plans.stage import Stage

NIL = "00000000-0000-4000-8000-000000000000"
#: Characters that can't be seen: white space, controls, formats, fillers.
_UNSEEN = r"[\s\p{Z}\p{C}ᅟᅠ⠀ㅤﾠ︀-️]"


def role(sender: Column) -> Column:
    s = F.lower(F.regexp_replace(sender, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    return F.when(s.isin("human", "user"), "human").when(s == "assistant", "assistant")


def visible(text: Column) -> Column:
    return F.coalesce(F.length(F.regexp_replace(text, _UNSEEN, "")) > 0, F.lit(False))


def fold(log: DataFrame, op: str | None = None) -> DataFrame:
    """The last version of each message of an event log: (id, conv BINARY, parent BINARY, at, role, seen).

    Versions are ordered by updated_at, then by arrival. ``op`` names a column of which the value ``delete`` in the last
    version removes the message. Whatever a message's number of versions, partial aggregates keep one for each task.
    """
    loaded = F.col("loaded_at").cast("timestamp") if "loaded_at" in log.columns else F.lit(None).cast("timestamp")
    gone = (F.lower(F.col(op)) == "delete") if op else F.lit(False)
    start = F.col("parent_message_uuid").isNull() | F.col("parent_message_uuid").isin("", NIL)
    # The order of the fields is the order of versions; the tail only makes the choice between equal versions a fixed one.
    version = F.struct(
        instant(F.col("updated_at")).alias("u"), loaded.alias("l"), F.coalesce(gone, F.lit(False)).alias("gone"), instant(F.col("created_at")).alias("at"),
        F.when(~start, pack_key(F.col("parent_message_uuid"))).alias("parent"), role(F.col("sender")).alias("role"), visible(F.col("text")).alias("seen"),
    )
    rows = log.where("uuid is not null and conversation_uuid is not null").select(pack_key(F.col("uuid")).alias("id"), pack_key(F.col("conversation_uuid")).alias("conv"), version.alias("v"))
    # by message and conversation: a uuid that stands in two conversations is a message of each
    last = rows.groupBy("id", "conv").agg(F.max("v").alias("v")).where("not v.gone")
    return last.select("id", "conv", "v.at", "v.parent", "v.role", "v.seen")


def _linked(m: DataFrame) -> DataFrame:
    """(no, root, depth, on, bits) of all numbered messages ``m``: 8-byte numbers are all that the joins move.

    ``on``: the message and all above it are the latest child of their parent. ``lost``: its parent isn't in its conversation.
    """
    key = lambda c: F.unhex(F.md5(F.concat("conv", c)))  # noqa: E731  of fixed width 16
    human = F.col("role").eqNullSafe("human")
    own = F.col("role").isNull() | ~F.col("seen")
    below = m.where("parent is not null").select(key("parent").alias("k"), "no", "at", "id", F.when(own, 2).when(F.col("role") == "assistant", 1).otherwise(0).cast("tinyint").alias("kind"))
    above = m.select(key("id").alias("k2"), F.col("no").alias("up"), human.alias("after_human"))
    links = below.join(above, F.col("k") == F.col("k2"), "left")
    # wrong on a thread: no role or text, or a human message is followed by something else than an assistant message
    wrong = (F.col("kind") == 2) | (F.coalesce("after_human", F.lit(False)) & (F.col("kind") != 1))
    links = Stage(links.select("no", "up", F.struct("at", "id", "no").alias("when"), wrong.alias("wrong"))).df
    best = links.where("up is not null").groupBy("up").agg(F.max("when").alias("w")).select(F.col("w.no").alias("no"), F.lit(True).alias("best"))
    flagged = links.select("no", "up", "wrong").join(best, "no", "left")
    starts = m.where("parent is null").select("no", F.lit(None).cast("bigint").alias("up"), (own | ~human).alias("wrong"), F.lit(True).alias("best"))
    n = flagged.unionByName(starts).withColumn("bits", F.when(F.col("wrong"), 1).otherwise(0) + F.when(F.col("up").isNull() & ~F.col("best").eqNullSafe(True), 2).otherwise(0))
    nodes = n.select(F.col("no").alias("id"), F.col("up").alias("parent"), F.col("best").eqNullSafe(True).alias("ok"), F.col("bits").cast("tinyint").alias("tag"))
    return point_at_roots(nodes, tag=True)


def _threads(m: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Messages on threads (conv, id, role, turn, wrong), and those of conversations without links."""
    t = m.join(_linked(m).withColumnRenamed("id", "no"), "no")
    t = Stage(t.select("conv", "id", "no", "at", "role", "seen", F.col("parent").isNotNull().alias("linked"), "root", "depth", F.col("ok").alias("on"), "tag")).df
    first = F.max(F.when(~F.col("linked"), F.struct("at", "id", "no"))).alias("first")
    heads = t.groupBy("conv").agg(first, F.max("linked").alias("tree"), F.max((F.col("tag") >= 2) | (F.col("depth") < 0)).alias("broken"))
    heads = Stage(heads.where("not broken and first is not null").select("conv", F.col("first.no").alias("start"), "tree")).df
    on = t.where("on and depth >= 0").join(heads.where("tree"), "conv").where("root = start")
    flat = t.where("not linked").join(heads.where("not tree"), "conv", "left_semi")
    return on.select("conv", "id", "role", (F.col("depth") + 1).alias("turn"), (F.col("tag") % 2 == 1).alias("wrong")), flat.select("conv", "id", "at", "role", "seen")


def _flat(m: DataFrame) -> DataFrame:
    """Messages of conversations without any link, by time. Ranks: within the ranges of a global sort, plus what lies before."""
    n = max(1, int(m.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    ranged = Stage(m.repartitionByRange(n, "conv", "at", "id").withColumn("range", F.spark_partition_id())).df
    w = Window.partitionBy("conv", "range").orderBy("at", "id")
    r = ranged.withColumn("rank", F.row_number().over(w)).withColumn("before", F.lag("role").over(w))
    r = Stage(r).df
    # one row for each conversation and range: as many as there are ranges, for the largest conversation
    parts = r.groupBy("conv", "range").agg(F.count("*").alias("n"), F.max_by("role", "rank").alias("last"))
    ahead = Window.partitionBy("conv").orderBy("range")
    parts = parts.select("conv", "range", F.coalesce(F.sum("n").over(ahead.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"), F.lag("last").over(ahead).alias("carried"))
    t = r.join(parts, ["conv", "range"])
    a_role = F.when(F.col("rank") == 1, F.col("carried")).otherwise(F.col("before"))
    turn = F.col("rank") + F.col("offset")
    wrong = F.col("role").isNull() | ~F.col("seen") | ((turn == 1) & ~(F.col("role").eqNullSafe("human"))) | ((a_role == "human") & ~(F.col("role").eqNullSafe("assistant")))
    return t.select("conv", "id", "role", turn.cast("bigint").alias("turn"), F.coalesce(wrong, F.lit(False)).alias("wrong"))


def rebuild(log: DataFrame, op: str | None = None) -> DataFrame:
    """(conversation_uuid, turn, message_uuid, role) of the conversations that are whole."""
    # numbers by place in the written table: as stable as its files
    m = Stage(Stage(fold(log, op)).df.withColumn("no", F.monotonically_increasing_id())).df
    trees, flat = _threads(m)
    threads = Stage(trees.unionByName(_flat(flat))).df
    # the last message must not be a human one: it has no reply
    kept = threads.groupBy("conv").agg(F.max("wrong").alias("wrong"), F.max_by("role", "turn").alias("last")).where("not wrong and last = 'assistant'")
    return threads.join(kept.select("conv"), "conv", "left_semi").select(unpack_key(F.col("conv")).alias("conversation_uuid"), "turn", unpack_key(F.col("id")).alias("message_uuid"), "role")
