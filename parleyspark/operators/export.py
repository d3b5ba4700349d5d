"""What a picture of the graph shows: which nodes, how they look, where they lie."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parleyspark.operators.graph import subgraph
from parleyspark.plans.stage import Stage

#: Shares of the kinds among the nodes shown.
QUOTAS = {"topic": 0.30, "tool": 0.25, "conversation": 0.25, "url": 0.15, "uuid": 0.05}


def select_nodes(n: DataFrame, max_nodes: int = 200) -> DataFrame:
    """The most connected nodes of each kind up to its quota, then the most connected of those up to max_nodes."""
    t = n.withColumn("kind", F.when(F.col("node_type") == "entity", F.col("entity_type")).otherwise(F.col("node_type")))
    # a limit for each kind: every task keeps no more rows than that
    most = [t.where(F.col("kind") == k).orderBy(F.desc("degree"), "id").limit(max(1, int(max_nodes * q))) for k, q in QUOTAS.items()]
    return reduce(DataFrame.unionByName, most).orderBy(F.desc("degree"), "id").limit(max_nodes).select("id", "label", "node_type", "entity_type", "degree", "kind")


def select_around(n: DataFrame, e: DataFrame, seed: str, depth: int = 2, max_nodes: int = 200) -> DataFrame:
    """At most max_nodes nodes around the first ten nodes (by id) whose label or id holds ``seed``: by hops, then degree; no match raises."""
    near, _ = subgraph(n, e, seed, depth, seeds=10)
    near = Stage(near).df
    if not near.take(1):
        raise ValueError(f"No nodes match {seed!r}")
    return near.orderBy("hop", F.desc("degree"), "id").limit(max_nodes)


# Shapes, border colours and the palette of communities of the pictures.
SHAPES = {"url": "diamond", "uuid": "triangleDown"}
BORDERS = {"topic": "#e94560", "url": "#59a14f", "uuid": "#b07aa1"}
TOOL_BORDER, OTHER_BORDER, NO_COLOUR = "#ff6b35", "#ffffff", "#aaaaaa"
PALETTE = ["#4e79a7", "#f28e2b", "#e15759", "#76b7b2", "#59a14f", "#edc948", "#b07aa1", "#ff9da7", "#9c755f", "#bab0ac"]


def _by(c: Column, values: dict[str, str], otherwise: str) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[c], F.lit(otherwise))


def looks(n: DataFrame) -> DataFrame:
    """Shape, border and size of nodes; the colour of their community where there is one."""
    tool = F.col("node_type") == "tool"
    shape = F.when(F.col("node_type") == "conversation", "square").when(tool, "star").otherwise(_by(F.col("entity_type"), SHAPES, "dot"))
    border = F.when(tool, TOOL_BORDER).otherwise(_by(F.col("entity_type"), BORDERS, OTHER_BORDER))
    size = F.greatest(F.lit(10.0), F.least(F.lit(60.0), 8 + F.sqrt("degree")))
    t = n.withColumn("shape", shape).withColumn("border", border).withColumn("size", F.round(size, 6))
    if "community_id" not in n.columns:
        return t.withColumn("colour", F.lit(NO_COLOUR))
    colour = F.array(*map(F.lit, PALETTE))[F.pmod(F.col("community_id") - 1, F.lit(len(PALETTE))).cast("int")]
    return t.withColumn("colour", F.coalesce(colour, F.lit(NO_COLOUR)))


def temporal_colours(times: DataFrame, entity: str = "entity", at: str = "last_seen_ms") -> DataFrame:
    """(entity, colour): from blue (old) over green and yellow to red (new), grey without a time."""
    # one row
    ends = F.broadcast(times.agg(F.min(at).alias("lo"), F.max(at).alias("hi")))
    ratio = F.col("r")
    t = times.join(ends).withColumn("r", F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(at) - F.col("lo")) / F.coalesce(F.nullif(F.col("hi") - F.col("lo"), F.lit(0)), F.lit(1)))))
    whole = lambda c: F.floor(c + 0.5).cast("int").cast("string")
    late = ratio >= 0.5
    rgb = F.concat(F.lit("rgb("), whole(F.when(late, 255.0).otherwise(ratio * 510)), F.lit(","), whole(F.when(late, 255 * (1 - (ratio - 0.5) * 2)).otherwise(128 + ratio * 255)), F.lit(","), whole(F.when(late, 0.0).otherwise(255 * (1 - ratio * 2))), F.lit(")"))
    return t.select(entity, F.coalesce(rgb, F.lit(NO_COLOUR)).alias("colour"))


def picture(n: DataFrame, e: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a page shows of some nodes and the edges among them, one JSON text for each."""
    nodes = looks(n).select("id", F.to_json(F.struct("id", "label", "shape", "size", F.struct(F.col("colour").alias("background"), "border").alias("color"))).alias("json"))
    ids = n.select("id")
    inner = e.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    return nodes, widths(inner).select("source_id", "target_id", "relation", F.to_json(F.struct(F.col("source_id").alias("from"), F.col("target_id").alias("to"), F.col("relation").alias("title"), "width")).alias("json"))


def widths(e: DataFrame) -> DataFrame:
    return e.select("source_id", "target_id", "relation", F.round(F.greatest(F.lit(0.5), F.least(F.lit(4.0), F.sqrt("weight"))), 6).alias("width"))


def linked_conversations(a, keep: int = 20) -> DataFrame:
    """(entity, conv_count, conversations): newest first, at most ``keep`` of them."""
    c = a.conversations.select(F.col("uuid").alias("conversation_uuid"), "updated")
    t = a.entities.select("entity", "conversation_uuid").distinct().join(c, "conversation_uuid")
    r = F.row_number().over(Window.partitionBy("entity").orderBy(F.desc_nulls_last("updated"), "conversation_uuid"))
    top = t.withColumn("r", r).where(F.col("r") <= keep).groupBy("entity").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "conversation_uuid"))), lambda x: x["conversation_uuid"]), ",").alias("conversations"))
    return t.groupBy("entity").agg(F.count("*").alias("conv_count")).join(top, "entity")


def layout(n: DataFrame, e: DataFrame, max_nodes: int = 200, rounds: int = 200, seed: int = 7) -> DataFrame:
    """(id, x, y) of at most max_nodes nodes by forces between them; so few rows are laid out on the driver."""
    import numpy as np
    import pandas as pd

    ids = [r[0] for r in n.select("id").orderBy("id").limit(max_nodes).collect()]
    place = {x: i for i, x in enumerate(ids)}
    shown = n.sparkSession.createDataFrame([(x,) for x in ids], "id string")
    pairs = e.join(F.broadcast(shown.withColumnRenamed("id", "source_id")), "source_id", "left_semi").join(F.broadcast(shown.withColumnRenamed("id", "target_id")), "target_id", "left_semi").select("source_id", "target_id").distinct().collect()
    rng = np.random.default_rng(seed)
    p = rng.uniform(-1, 1, (len(ids), 2))
    s, t = np.array([place[r[0]] for r in pairs], int), np.array([place[r[1]] for r in pairs], int)
    k = 1 / max(1, len(ids)) ** 0.5
    for r in range(rounds):
        d = p[:, None] - p[None]
        dist = np.maximum(np.sqrt((d**2).sum(2)), 1e-3)
        move = (d / dist[..., None] * (k * k / dist)[..., None]).sum(1)
        if len(s):
            pull = p[s] - p[t]
            pull *= (np.maximum(np.sqrt((pull**2).sum(1)), 1e-3) / k)[:, None]
            np.add.at(move, s, -pull)
            np.add.at(move, t, pull)
        length = np.maximum(np.sqrt((move**2).sum(1)), 1e-9)
        p += move / length[:, None] * np.minimum(length, 0.1 * (1 - r / rounds))[:, None]
    return n.sparkSession.createDataFrame(pd.DataFrame({"id": ids, "x": p[:, 0], "y": p[:, 1]}), "id string, x double, y double")


def filter_nodes(n: DataFrame, types: list[str] | None = None, community: int | None = None, min_degree: int = 0, max_nodes: int | None = None) -> DataFrame:
    """Nodes of some types, of a community, of a degree; the most connected of them."""
    t = n.where(F.col("degree") >= min_degree)
    if types:
        t = t.where(F.coalesce("entity_type", "node_type").isin(types))
    if community is not None:
        t = t.where(F.col("community_id") == community)
    return t.orderBy(F.desc("degree"), "id").limit(max_nodes) if max_nodes else t


def filter_view(n: DataFrame, e: DataFrame, hidden: list[str], min_degree: int, min_weight: float, text: str = "") -> tuple[DataFrame, DataFrame]:
    """What stays of a picture: nodes by type, degree and label, and edges between them by weight."""
    t = n.where(~F.coalesce("entity_type", "node_type").isin(hidden) & (F.col("degree") >= min_degree) & F.lower("label").contains(text.lower()))
    ids = t.select("id")
    inner = e.where(F.col("weight") >= min_weight).join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    return t, inner
