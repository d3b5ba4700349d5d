"""The knowledge graph: nodes, edges, enrichments and queries over them.

Nodes: (id, label, node_type, entity_type). Edges: (source_id, target_id, relation, weight, conversation_uuid), one for
each source, target and relation, their weight the number of times they came up.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parleyspark.operators.ranks import within
from parleyspark.plans.stage import Stage

_TOOL_USE = "block_type = 'tool_use' and tool_name is not null and tool_name != ''"
#: A hop is broadcast while it holds at most this many node ids.
FRONTIER_ROWS = 50_000


def nodes(a) -> DataFrame:
    """Conversations, entities and tools; of equal ids the first kind counts, of an entity under several types the least."""
    c = a.conversations.select(F.concat(F.lit("conv:"), "uuid").alias("id"), F.coalesce(F.nullif("name", F.lit("")), "uuid").alias("label"), F.lit("conversation").alias("node_type"), F.lit(None).cast("string").alias("entity_type"), F.lit(0).alias("p"))
    e = a.entities.select(F.col("entity").alias("id"), F.col("entity").alias("label"), F.lit("entity").alias("node_type"), F.col("type").alias("entity_type"), F.lit(1).alias("p"))
    t = a.blocks.where(_TOOL_USE).select(F.concat(F.lit("tool:"), "tool_name").alias("id"), F.col("tool_name").alias("label"), F.lit("tool").alias("node_type"), F.lit(None).cast("string").alias("entity_type"), F.lit(2).alias("p"))
    both = c.unionByName(e).unionByName(t)
    return both.groupBy("id").agg(F.min(F.struct("p", "entity_type", "node_type", "label")).alias("x")).select("id", "x.label", "x.node_type", "x.entity_type")


def tool_usage(a) -> DataFrame:
    return a.blocks.where(_TOOL_USE).groupBy("conversation_uuid", "tool_name").agg(F.count("*").alias("n_calls"))


def _accumulate(rows: DataFrame) -> DataFrame:
    """Accumulating upsert: weights add up, the first conversation stays."""
    return rows.groupBy("source_id", "target_id", "relation").agg(F.sum("weight").cast("double").alias("weight"), F.min("conversation_uuid").alias("conversation_uuid"))


def edges(a) -> DataFrame:
    use = Stage(tool_usage(a)).df
    uses = use.select(F.concat(F.lit("conv:"), "conversation_uuid").alias("source_id"), F.concat(F.lit("tool:"), "tool_name").alias("target_id"), F.lit("uses_tool").alias("relation"), F.col("n_calls").alias("weight"), "conversation_uuid")
    together = within(use.where("conversation_uuid is not null").select("conversation_uuid", "tool_name"), "conversation_uuid", ["tool_name"]).select(
        F.concat(F.lit("tool:"), "x.tool_name").alias("source_id"), F.concat(F.lit("tool:"), "y.tool_name").alias("target_id"), F.lit("co_occurs").alias("relation"), F.lit(1).cast("bigint").alias("weight"), "conversation_uuid"
    )
    e = Stage(a.entities).df
    # rows of one message in pairs: each row is an entity and type, so equal names of two types make a loop
    pairs = within(e.select("message_uuid", "entity", "type", "conversation_uuid"), "message_uuid", ["entity", "type"]).where("x.entity != y.entity or x.type is not null").select(
        F.col("x.entity").alias("source_id"), F.col("y.entity").alias("target_id"), F.lit("co_occurs").alias("relation"), F.lit(1).cast("bigint").alias("weight"), F.least("x.conversation_uuid", "y.conversation_uuid").alias("conversation_uuid")
    )
    mentioned = e.select(F.col("entity").alias("source_id"), F.concat(F.lit("conv:"), "conversation_uuid").alias("target_id"), F.lit("mentioned_in").alias("relation"), F.lit(1).cast("bigint").alias("weight"), "conversation_uuid")
    return _accumulate(uses.unionByName(together).unionByName(pairs).unionByName(mentioned))


def symmetric(e: DataFrame) -> DataFrame:
    """(id, other, relation, weight): every edge from both its ends, loops once; OR-joins on edges become equi-joins."""
    there = e.select(F.col("source_id").alias("id"), F.col("target_id").alias("other"), "relation", "weight")
    back = e.where("source_id != target_id").select(F.col("target_id").alias("id"), F.col("source_id").alias("other"), "relation", "weight")
    return there.unionByName(back)


def degrees(n: DataFrame, e: DataFrame) -> DataFrame:
    d = symmetric(e).groupBy("id").agg(F.count("*").alias("degree"))
    return n.join(d, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def entity_times(a) -> DataFrame:
    """(entity, first_seen_ms, last_seen_ms) of the messages that mention it."""
    m = a.messages.select(F.col("uuid").alias("message_uuid"), F.unix_millis("created").alias("ms"))
    return a.entities.select("entity", "message_uuid").join(m, "message_uuid").groupBy("entity").agg(F.min("ms").alias("first_seen_ms"), F.max("ms").alias("last_seen_ms"))


def tool_metadata(a) -> DataFrame:
    """(conversation_uuid, tool_count of calls, distinct_tools, tool_names as JSON) of every conversation."""
    t = a.blocks.where(_TOOL_USE).groupBy("conversation_uuid").agg(F.count("*").alias("tool_count"), F.array_sort(F.collect_set("tool_name")).alias("names"))
    t = a.conversations.select(F.col("uuid").alias("conversation_uuid")).join(t, "conversation_uuid", "left")
    return t.select("conversation_uuid", F.coalesce("tool_count", F.lit(0)).alias("tool_count"), F.when(F.col("names").isNull(), 0).otherwise(F.size("names")).cast("bigint").alias("distinct_tools"), F.coalesce(F.to_json("names"), F.lit("[]")).alias("tool_names"))


def profile_metadata(p: DataFrame) -> DataFrame:
    """(id, category, meta as JSON) of conversation nodes."""
    meta = F.to_json(F.struct("technical_density", F.col("words").alias("total_words"), "code_blocks", "tool_invocations", "thinking_blocks", "duration_minutes"))
    return p.select(F.concat(F.lit("conv:"), "conversation_uuid").alias("id"), F.col("primary_type").alias("category"), meta.alias("meta"))


# -- analysis ------------------------------------------------------------------------------------------------------------
def god_nodes(n: DataFrame, top: int | None = 10) -> DataFrame:
    t = n.where("node_type = 'entity'").select("id", "label", "entity_type", "degree")
    return t.orderBy(F.desc("degree"), "id").limit(top) if top else t


def suggest_questions(n: DataFrame, limit: int = 5) -> DataFrame:
    """Questions about the most connected entities, as (place, question); at most 2 * limit nodes are ranked."""
    # The two sentences.
    top = god_nodes(n, 2 * limit).withColumn("r", F.row_number().over(Window.orderBy(F.desc("degree"), "id")))
    nxt = F.lead("label").over(Window.orderBy("r"))
    alone = top.where("r = 1").select(F.lit(0).alias("place"), F.format_string("Find all conversations about '%s' (most connected entity)", "label").alias("question"))
    both = top.withColumn("b", nxt).where("b is not null").select(F.col("r").alias("place"), F.format_string("Search conversations where '%s' and '%s' both appear", "label", "b").alias("question"))
    return alone.unionByName(both).where(F.col("place") < limit)


def topic_hubs(a, n: DataFrame) -> DataFrame:
    t = a.entities.where("type = 'topic'").groupBy(F.col("entity").alias("id")).agg(F.count_distinct("conversation_uuid").alias("conversation_count"))
    return t.join(n.where("node_type = 'entity'"), "id").select(F.col("id").alias("entity"), "conversation_count", "degree")


def temporal_bursts(a, least: int = 5) -> DataFrame:
    """(entity, entity_type, week, mentions): weeks begin on Monday and are counted within their year."""
    m = a.messages.where("created is not null").select(F.col("uuid").alias("message_uuid"), "created")
    week = F.concat(F.year("created"), F.lit("-W"), F.lpad(F.floor((F.dayofyear("created") + 6 - F.weekday("created")) / 7).cast("string"), 2, "0"))
    t = a.entities.join(m, "message_uuid").groupBy("entity", week.alias("week")).agg(F.min("type").alias("entity_type"), F.count("*").alias("mentions"))
    return t.where(F.col("mentions") >= least)


def bridges(n: DataFrame, e: DataFrame, least: int = 3) -> DataFrame:
    """Entities whose co-occurring neighbours lie in several other communities; ``n`` has community_id."""
    s = symmetric(e.where("relation = 'co_occurs'"))
    me = n.where("node_type = 'entity' and community_id is not null").select("id", "entity_type", "degree", F.col("community_id").alias("own"))
    far = n.where("community_id is not null").select(F.col("id").alias("other"), "community_id")
    t = s.join(me, "id").join(far, "other").where("community_id != own").select("id", "entity_type", "degree", "community_id").distinct()
    t = t.groupBy("id", "entity_type", "degree").agg(F.count("*").alias("communities_connected"), F.array_join(F.array_sort(F.collect_list("community_id")), ",").alias("community_ids"))
    return t.where(F.col("communities_connected") >= least).withColumnRenamed("id", "entity")


def surprising(n: DataFrame, e: DataFrame) -> DataFrame:
    """Co-occurring entities of different communities, with the weight of their edge."""
    k = n.where("node_type = 'entity'").select("id", "label", "community_id")
    x = k.select(F.col("id").alias("source_id"), F.col("label").alias("source_label"), F.col("community_id").alias("c1"))
    y = k.select(F.col("id").alias("target_id"), F.col("label").alias("target_label"), F.col("community_id").alias("c2"))
    return e.where("relation = 'co_occurs'").join(x, "source_id").join(y, "target_id").where("c1 != c2").select("source_label", "target_label", "weight")


def tool_stats(n: DataFrame, e: DataFrame) -> DataFrame:
    t = e.where("relation = 'uses_tool'").groupBy(F.col("target_id").alias("id")).agg(F.count_distinct("conversation_uuid").alias("conversation_count"), F.sum("weight").cast("bigint").alias("total_calls"))
    return t.join(n.where("node_type = 'tool'"), "id").select(F.col("label").alias("tool_name"), "conversation_count", "total_calls", "degree")


# -- traversal --------------------------------------------------------------------------------------------------------------
def neighbours(n: DataFrame, e: DataFrame, node: str, limit: int = 20) -> DataFrame:
    """The heaviest outgoing edges, then the incoming ones, cut together: (place, id, relation, weight, direction)."""
    out = e.where(F.col("source_id") == node).select(F.col("target_id").alias("id"), "relation", "weight", F.lit("outgoing").alias("direction"))
    back = e.where(F.col("target_id") == node).select(F.col("source_id").alias("id"), "relation", "weight", F.lit("incoming").alias("direction"))
    order = [F.desc("direction"), F.desc("weight"), "id", "relation"]
    t = out.orderBy(*order).limit(limit).unionByName(back.orderBy(*order).limit(limit)).join(n.select("id"), "id", "left_semi")
    return t.withColumn("place", F.row_number().over(Window.orderBy(*order))).where(F.col("place") <= limit)


def subgraph(n: DataFrame, e: DataFrame, keyword: str, depth: int = 2, seeds: int = 20) -> tuple[DataFrame, DataFrame]:
    """Nodes within ``depth`` hops of the first ``seeds`` nodes (by id) whose label or id holds the keyword, and the edges among them.

    Each hop is one join of the frontier; it is broadcast while it is small by its own count, and cut off in a written table.
    """
    kw = keyword.lower()
    start = n.where(F.lower("label").contains(kw) | F.lower("id").contains(kw)).orderBy("id").limit(seeds).select("id", F.lit(0).alias("hop"))
    s = Stage(symmetric(e).select("id", "other")).df
    seen = frontier = Stage(start).df
    for hop in range(1, depth + 1):
        f = frontier.select("id")
        small = f.count() <= FRONTIER_ROWS
        nxt = s.join(F.broadcast(f) if small else f, "id").select(F.col("other").alias("id")).distinct().join(seen, "id", "left_anti")
        frontier = Stage(nxt.withColumn("hop", F.lit(hop))).df
        seen = seen.unionByName(frontier)
    seen = Stage(seen).df
    ids = seen.select("id")
    inner = e.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    return n.join(seen, "id"), inner


def hop_distances(n: DataFrame, e: DataFrame, source: str, limit: int | None = None, target: str | None = None) -> DataFrame:
    """(id, hops, path): a shortest path from the source to every node it reaches (within ``limit`` hops, if given), the least by ids of equally short ones.
    The walk ends when ``target`` is reached."""
    s = Stage(symmetric(e).where("id != other").select("id", "other").distinct()).df
    seen = frontier = Stage(n.where(F.col("id") == source).select("id", F.lit(0).cast("bigint").alias("hops"), F.array("id").alias("path"))).df
    for hop in count(1) if limit is None else range(1, limit + 1):
        f = frontier.select("id", "path")
        if not f.take(1) or (target is not None and frontier.where(F.col("id") == target).take(1)):
            break
        nxt = s.join(f, "id").groupBy("other").agg(F.min("path").alias("path")).select(F.col("other").alias("id"), F.lit(hop).cast("bigint").alias("hops"), F.concat("path", F.array("other")).alias("path"))
        frontier = Stage(nxt.join(seen.select("id"), "id", "left_anti")).df
        seen = seen.unionByName(frontier)
        if hop % 16 == 0:  # else the plan grows with the hops
            seen = Stage(seen).df
    return seen


def shortest_path(n: DataFrame, e: DataFrame, a: str, b: str) -> DataFrame:
    """One row (path, hops) or none."""
    return hop_distances(n, e, a, target=b).where(F.col("id") == b).select("path", "hops")
