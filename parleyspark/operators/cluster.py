"""Communities and categories: label propagation, k-means, TF-IDF, labels."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from math import isqrt
from operator import or_

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parleyspark.functions.patterns import STOPWORDS, TOOL_CATEGORIES
from parleyspark.operators.graph import entity_times, symmetric
from parleyspark.operators.ranks import numbered
from parleyspark.plans.stage import Stage

ROUNDS, MOVED = 25, 0.01
SPLIT_OVER, SPLIT_SHARE = 200, 0.05
#: The numbers of categories that are tried.
CATEGORY_KS = range(5, 16)
#: The models of vectors of conversations, with the length of their vectors.
MODELS = {"embed-lite-64": 64, "embed-mini-32": 32}


def label_propagation(ids: DataFrame, e: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(id, label): labels spread along edges until fewer than 1 % move; deterministic.

    In a round the nodes of one parity (by hash, in turns) take the label of the largest weight among their neighbours, of equal
    ones their own if it is among them, else the least. Halves by turns keep two-coloured pieces from swapping for ever.
    """
    s = Stage(symmetric(e).where("id != other").groupBy("id", "other").agg(F.sum("weight").alias("w"))).df
    now = Stage(ids.select("id", F.col("id").alias("label"))).df
    n, still = now.count(), 0
    for r in range(rounds):
        votes = s.where(F.pmod(F.xxhash64("id"), F.lit(2)) == r % 2).join(now.select(F.col("id").alias("other"), F.col("label").alias("vote")), "other")
        votes = votes.groupBy("id", "vote").agg(F.sum("w").alias("w"))
        own = now.select("id", F.col("label").alias("own"))
        votes = votes.join(own, "id").groupBy("id").agg(F.min(F.struct((-F.col("w")).alias("w"), (F.col("vote") != F.col("own")).alias("new"), "vote")).alias("b"))
        step = Stage(now.join(votes.select("id", F.col("b.vote").alias("vote")), "id", "left").select("id", F.coalesce("vote", "label").alias("label"), (F.col("vote").isNotNull() & (F.col("vote") != F.col("label"))).alias("moved")))
        moved = step.df.where("moved").count()
        now = step.df.select("id", "label")
        still = still + 1 if moved < MOVED * max(n, 1) else 0
        if still == 2:
            break
    return now


def communities(labels: DataFrame, e: DataFrame, degrees: DataFrame) -> DataFrame:
    """(community_id, node_count, cohesion, top_entities, label): ids by size; cohesion is the exact share of possible edges."""
    size = labels.groupBy("label").agg(F.count("*").alias("node_count"))
    ids = numbered(size, [F.desc("node_count"), "label"], "community_id")
    member = labels.join(ids, "label").select("id", "community_id", "node_count")
    x = member.select(F.col("id").alias("source_id"), "community_id")
    y = member.select(F.col("id").alias("target_id"), F.col("community_id").alias("c2"))
    inner = e.where("source_id != target_id").join(x, "source_id").join(y, "target_id").where("community_id = c2").groupBy("community_id").agg(F.count("*").alias("inner"))
    w = Window.partitionBy("community_id").orderBy(F.desc("degree"), "id")
    top = member.join(degrees.select("id", "degree"), "id").withColumn("r", F.row_number().over(w)).where("r <= 5")
    top = top.groupBy("community_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "id"))), lambda t: t["id"]).alias("top_entities"))
    c = ids.select("community_id", F.col("label").alias("seed"), "node_count").join(inner, "community_id", "left").join(top, "community_id", "left")
    possible = F.col("node_count") * (F.col("node_count") - 1) / 2
    return c.select("community_id", "seed", "node_count", F.when(F.col("node_count") > 1, F.coalesce("inner", F.lit(0)) / possible).otherwise(0.0).alias("cohesion"), "top_entities", F.array_join(F.slice("top_entities", 1, 3), ", ").alias("label"))


def cluster_graph(n: DataFrame, e: DataFrame, split_over: int = SPLIT_OVER) -> DataFrame:
    """(id, community) of entity nodes: label propagation, then once more within communities that are too large, without their
    most connected nodes, which afterwards join the community of their heaviest neighbours."""
    entity = Stage(n.where("node_type = 'entity'").select("id", "degree")).df
    co = Stage(e.where("relation = 'co_occurs'").join(entity.select(F.col("id").alias("source_id")), "source_id", "left_semi").join(entity.select(F.col("id").alias("target_id")), "target_id", "left_semi")).df
    labels = label_propagation(entity, co)
    size = labels.groupBy("label").agg(F.count("*").alias("n"))
    big = Stage(labels.join(size.where(F.col("n") > split_over), "label").join(entity, "id")).df
    if not big.take(1):
        return labels.select("id", F.col("label").alias("community"))
    r = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("degree"), "id"))
    ranked = Stage(big.withColumn("god", r <= F.ceil(F.col("n") * SPLIT_SHARE))).df
    rest = ranked.where("not god")
    x, y = rest.select(F.col("id").alias("source_id"), F.col("label").alias("l1")), rest.select(F.col("id").alias("target_id"), F.col("label").alias("l2"))
    inner = co.join(x, "source_id").join(y, "target_id").where("l1 = l2")
    again = label_propagation(rest.select("id"), inner)
    pull = symmetric(co).join(again.select(F.col("id").alias("other"), "label"), "other").join(ranked.where("god").select("id"), "id", "left_semi").groupBy("id", "label").agg(F.sum("weight").alias("w"))
    gods = pull.groupBy("id").agg(F.min(F.struct((-F.col("w")).alias("w"), "label")).alias("b")).select("id", F.col("b.label").alias("community"))
    new = again.select("id", F.col("label").alias("community")).unionByName(gods)
    return labels.join(new, "id", "left").select("id", F.coalesce("community", "label").alias("community"))


def features(a, n: DataFrame, times: DataFrame) -> DataFrame:
    """Seven numbers for each entity node: degree, kind flags, tool association, first seen, reach; each within 0 and 1."""
    reach = a.entities.groupBy(F.col("entity").alias("id")).agg(F.count_distinct("conversation_uuid").alias("reach"))
    t = n.where("node_type = 'entity'").join(reach, "id", "left").join(times.select(F.col("entity").alias("id"), "first_seen_ms"), "id", "left")
    most = F.broadcast(t.agg(F.max("degree").alias("md"), F.max("reach").alias("mr"), F.min("first_seen_ms").alias("lo"), F.max("first_seen_ms").alias("hi")))
    flag = lambda k: (F.col("entity_type") == k).cast("double")
    seen = F.when(F.col("first_seen_ms").isNull() | (F.col("hi") == F.col("lo")), 0.5).otherwise((F.col("first_seen_ms") - F.col("lo")) / (F.col("hi") - F.col("lo")))
    tool = F.when(F.col("id").startswith("tool:"), 1.0).otherwise(0.0)
    return t.join(most).select("id", F.round(F.col("degree") / F.greatest("md", F.lit(1)), 9).alias("degree"), flag("topic").alias("is_topic"), flag("url").alias("is_url"), flag("uuid").alias("is_uuid"), tool.alias("tool_assoc"), F.round(seen, 9).alias("first_seen"), F.round(F.coalesce("reach", F.lit(0)) / F.greatest("mr", F.lit(1)), 9).alias("reach"))


def _with_vector(rows: DataFrame, columns: list[str] | str) -> DataFrame:
    """``rows`` with the ML vector ``__f`` of some numeric columns, or of one vector column."""
    return rows.withColumn("__f", F.col(columns) if isinstance(columns, str) else array_to_vector(F.array(*[F.col(c).cast("double") for c in columns])))


def _fit(x: DataFrame, k: int, seed: int):
    return KMeans(k=k, maxIter=100, tol=0.0, seed=seed, featuresCol="__f", predictionCol="cluster").fit(x)


def _different(x: DataFrame, enough: int) -> int:
    """The number of different vectors, counted up to ``enough``."""
    return x.select(vector_to_array("__f").alias("f")).distinct().limit(enough).count()


def k_means(rows: DataFrame, columns: list[str] | str, k: int, seed: int = 7) -> DataFrame:
    """``rows`` with ``cluster``: Lloyd's algorithm, at most 100 rounds, from k-means|| with a seed; no more clusters than different rows."""
    x = _with_vector(rows, columns)
    k = min(k, _different(x, k))
    if k < 2:
        return x.drop("__f").withColumn("cluster", F.lit(0))
    return _fit(x, k, seed).transform(x).drop("__f")


def _sample(x: DataFrame, sample: int) -> DataFrame:
    """The first rows with a vector ``__f``, by the hash of its numbers."""
    return x.orderBy(F.xxhash64(vector_to_array("__f"))).limit(sample)


def _score(x: DataFrame) -> float:
    """Mean silhouette (Euclidean) of (cluster, __f), a sample, on the driver."""
    import numpy as np

    rows = x.select("cluster", "__f").collect()
    c, x = np.array([r["cluster"] for r in rows]), np.array([r["__f"].toArray() for r in rows])
    kinds = np.unique(c)
    if len(kinds) < 2:
        return 0.0
    d = np.sqrt(np.maximum((x**2).sum(1)[:, None] + (x**2).sum(1)[None] - 2 * x @ x.T, 0))
    out = []
    for i in range(len(x)):
        own = c == c[i]
        if own.sum() < 2:
            out.append(0.0)
            continue
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, c == k].mean() for k in kinds if k != c[i])
        out.append((b - a) / max(a, b) if max(a, b) > 0 else 0.0)
    return float(np.mean(out))


def silhouette(rows: DataFrame, columns: list[str] | str, sample: int = 500) -> float:
    """Mean silhouette (Euclidean) of the first ``sample`` rows by hash among each other; the sample is the operator's bound."""
    return _score(_sample(_with_vector(rows, columns), sample))


def graph_ks(n: int) -> range:
    """The numbers of clusters that are tried for ``n`` entity nodes."""
    return range(2, min(20, isqrt(n)) + 1)


def auto_k(rows: DataFrame, columns: list[str] | str, ks: Iterable[int], seed: int = 7, sample: int = 500) -> tuple[int, DataFrame]:
    """The k of the best silhouette and its clusters; every k of ``ks`` is fitted to all rows, the silhouettes share one sample.
    There are no more clusters than different rows."""
    x = Stage(_with_vector(rows, columns)).df
    most = _different(x, max(ks))
    if most < 2:
        return 1, x.drop("__f").withColumn("cluster", F.lit(0))
    ks = sorted({min(k, most) for k in ks})
    some = Stage(_sample(x.select("__f"), sample)).df
    best = None
    for k in ks:
        model = _fit(x, k, seed)
        s = _score(model.transform(some))
        if best is None or s > best[0]:
            best = (s, k, model)
    return best[1], best[2].transform(x).drop("__f")


# -- categories -------------------------------------------------------------------------------------------------------------
def conversation_texts(a) -> DataFrame:
    """(uuid, title, msg_count, first_human, topics, tools): what conversations are categorised by."""
    m = a.messages.groupBy(F.col("conversation_uuid").alias("uuid")).agg(F.count("*").alias("msg_count"), F.min(F.when(F.col("sender") == "human", F.struct("created", F.col("uuid").alias("u"), F.substring("text", 1, 1000).alias("t")))).alias("f"))
    topics = a.entities.where("type = 'topic'").select(F.col("conversation_uuid").alias("uuid"), "entity").distinct().groupBy("uuid").agg(F.array_join(F.array_sort(F.collect_list("entity")), ",").alias("topics"))
    tools = a.blocks.where("block_type = 'tool_use' and tool_name != ''").select(F.col("conversation_uuid").alias("uuid"), "tool_name").distinct().groupBy("uuid").agg(F.array_join(F.array_sort(F.collect_list("tool_name")), ",").alias("tools"))
    c = a.conversations.select("uuid", F.col("name").alias("title"))
    t = c.join(m, "uuid").join(topics, "uuid", "left").join(tools, "uuid", "left")
    return t.select("uuid", "title", "msg_count", F.coalesce("f.t", F.lit("")).alias("first_human"), F.coalesce("topics", F.lit("")).alias("topics"), F.coalesce("tools", F.lit("")).alias("tools"))


def words(c) -> F.Column:
    """Lower-case words of letters and digits, of three characters at least, without stop words."""
    ws = F.split(F.regexp_replace(F.lower(c), r"[^a-z0-9 \t\n\f\r]", " "), r"[ \t\n\f\r]+")
    return F.filter(ws, lambda w: (F.length(w) >= 3) & ~w.isin(*sorted(STOPWORDS)))


def tf_idf(docs: DataFrame, key: str, terms: str, top: int = 500) -> DataFrame:
    """(key, term, weight): tf * ln(N / df), each document of length 1; terms in at least 2 and at most 80 % of documents, the ``top`` by df."""
    t = docs.select(key, F.explode(terms).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))
    t = Stage(t).df
    n = docs.count()
    df = t.groupBy("term").agg(F.count("*").alias("df")).where((F.col("df") >= 2) & (F.col("df") <= int(0.8 * n))).orderBy(F.desc("df"), "term").limit(top)
    # the vocabulary has at most ``top`` rows
    x = t.join(F.broadcast(Stage(df).df), "term").withColumn("w", F.col("tf") * F.log(F.lit(float(n)) / F.col("df")))
    norm = x.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return x.join(norm, key).select(key, "term", F.round(F.col("w") / F.col("norm"), 6).alias("weight"))


def tool_flags(t: DataFrame) -> DataFrame:
    """Tool categories, message bucket, whether there are tools and how many, each within 0 and 1: (uuid, ...)."""
    names = F.filter(F.split(F.lower("tools"), ","), lambda x: x != "")

    def holds(parts: list[str]):
        return lambda name: reduce(or_, [name.contains(p) for p in parts])

    has = {k: F.exists(names, holds(v)) for k, v in TOOL_CATEGORIES.items()}
    m = F.col("msg_count")
    bucket = F.when(m <= 2, 0.0).when(m <= 5, 0.2).when(m <= 10, 0.4).when(m <= 20, 0.6).when(m <= 50, 0.8).otherwise(1.0)
    return t.select("uuid", *[v.cast("bigint").alias(f"tool_{k}") for k, v in has.items()], bucket.alias("msg_bucket"), (F.size(names) > 0).cast("bigint").alias("has_tool"), F.least(F.lit(1.0), F.size(names) / 10).alias("tool_diversity"))


def cluster_labels(members: DataFrame) -> DataFrame:
    """(cluster, label, top_terms) of (cluster, uuid, title, tools): the five most frequent title words, and a tool category of more than 40 %."""
    n = members.groupBy("cluster").agg(F.count("*").alias("n"))
    w = members.select("cluster", F.explode(words(F.coalesce("title", F.lit("")))).alias("term")).groupBy("cluster", "term").agg(F.count("*").alias("c"))
    r = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("c"), "term"))
    top = w.withColumn("r", r).where("r <= 5").groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "term"))), lambda x: x["term"]).alias("terms"))
    flags = tool_flags(members.withColumn("msg_count", F.lit(0)))
    tool = members.select("cluster", "uuid").join(flags, "uuid").groupBy("cluster").agg(*[F.sum(f"tool_{k}").alias(k) for k in TOOL_CATEGORIES]).unpivot(["cluster"], list(TOOL_CATEGORIES), "kind", "k")
    tool = tool.groupBy("cluster").agg(F.max(F.struct("k", "kind")).alias("b")).select("cluster", F.col("b.k").alias("k"), F.col("b.kind").alias("kind"))
    t = n.join(top, "cluster", "left").join(tool, "cluster", "left")
    short = F.array_join(F.slice("terms", 1, 3), ", ")
    label = F.when(F.col("k") > 0.4 * F.col("n"), F.concat("kind", F.lit(": "), F.coalesce(short, F.lit("")))).otherwise(F.coalesce(F.nullif(short, F.lit("")), F.lit("uncategorized")))
    return t.select("cluster", label.alias("label"), F.coalesce(F.array_join("terms", ","), F.lit("")).alias("top_terms"))


def text_features(t: DataFrame, top: int = 500) -> DataFrame:
    """(uuid, v) of conversation_texts(): one sparse vector of TF-IDF of title, first question and topics, then the tool flags."""
    terms = words(F.concat_ws(" ", "title", "first_human", "topics"))
    v = Stage(tf_idf(t.select("uuid", terms.alias("terms")), "uuid", "terms", top)).df
    vocabulary = v.select("term").distinct().withColumn("i", F.row_number().over(Window.orderBy("term")) - 1)  # at most ``top`` terms
    vocabulary = Stage(vocabulary).df
    n = vocabulary.count()
    flags = tool_flags(t)
    names = [c for c in flags.columns if c != "uuid"]
    size = n + len(names)
    cells = v.join(F.broadcast(vocabulary), "term").groupBy("uuid").agg(F.array_sort(F.collect_list(F.struct("i", F.col("weight").alias("w")))).alias("c"))
    vector = F.udf(lambda i, w, f: Vectors.sparse(size, [*(i or []), *range(n, size)], [*(w or []), *f]), VectorUDT())
    return flags.join(cells, "uuid", "left").select("uuid", vector(F.col("c.i"), F.col("c.w"), F.array(*[F.col(c).cast("double") for c in names])).alias("v"))


def categorize(a, k: int | None = None, top: int = 500) -> DataFrame:
    """(uuid, cluster, label): TF-IDF of title, first question and topics with the tool flags, k-means, labels."""
    t = Stage(conversation_texts(a)).df
    x = Stage(text_features(t, top)).df
    got = k_means(x, "v", k) if k else auto_k(x, "v", CATEGORY_KS)[1]
    got = Stage(got.select("uuid", "cluster").join(t, "uuid").select("cluster", "uuid", "title", "tools")).df
    return got.select("uuid", "cluster").join(cluster_labels(got).select("cluster", "label"), "cluster")


def cluster(a, n: DataFrame, e: DataFrame, algorithm: str = "label-propagation") -> tuple[DataFrame, DataFrame]:
    """(nodes with community_id, communities): the graph clustered by one algorithm, as it is written back.

    Nodes that aren't clustered have a NULL community_id. Communities are (community_id, node_count, cohesion, top_entities, label), the largest first; for
    'kmeans' cohesion is the silhouette of the whole clustering.
    """
    if algorithm not in ("label-propagation", "kmeans"):
        raise ValueError(f"no clustering {algorithm!r}")
    entity = n.where("node_type = 'entity'")
    if algorithm == "kmeans":
        x = Stage(features(a, n, entity_times(a))).df
        columns = [c for c in x.columns if c != "id"]
        rows = x.count()
        if rows < 4:
            labels, score = x.select("id", F.lit(0).alias("label")), 0.0
        else:
            got = auto_k(x, columns, graph_ks(rows))[1]
            score = silhouette(got, columns)
            labels = got.select("id", F.col("cluster").alias("label"))
    else:
        labels, score = cluster_graph(n, e).withColumnRenamed("community", "label"), None
    labels = Stage(labels).df
    c = communities(labels, e.where("relation = 'co_occurs'"), entity)
    c = Stage(c.withColumn("cohesion", F.lit(score)) if score is not None else c).df
    ids = labels.join(c.select(F.col("seed").alias("label"), "community_id"), "label").select("id", "community_id")
    return n.drop("community_id").join(ids, "id", "left"), c.drop("seed")


def community_meta(communities_: DataFrame, which: int) -> DataFrame:
    """One row (community_id, label, cohesion), or none."""
    return communities_.where(F.col("community_id") == which).select("community_id", "label", "cohesion")


def community(n: DataFrame, which: int) -> DataFrame:
    """The members of a community, the most connected first when shown."""
    return n.where(F.col("community_id") == which).select("id", "label", "node_type", "entity_type", "degree")


def categorize_vectors(a, vectors: DataFrame, models: dict[str, int] = MODELS, k: int | None = None) -> DataFrame:
    """(model, uuid, cluster, label) by given vectors of conversations, with the tool flags at a tenth of their weight.

    Vectors of different models can't be compared: each model (with the length of its vectors) has clusters of its own.
    """
    t = Stage(conversation_texts(a)).df
    flags = tool_flags(t)
    names = [c for c in flags.columns if c != "uuid"]
    out = []
    for model, length in models.items():
        good = vectors.where((F.col("model") == model) & (F.size("embedding") == length) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x)))
        v = good.groupBy("uuid").agg(F.max_by("embedding", F.col("created_at").try_cast("timestamp")).alias("v"))
        x = v.join(flags, "uuid").select("uuid", *[F.col("v")[i].alias(f"v{i}") for i in range(length)], *[(F.col(c) * 0.1).alias(c) for c in names])
        x = Stage(x, dictionary=False).df
        if not x.take(1):
            continue
        columns = [c for c in x.columns if c != "uuid"]
        got = (k_means(x, columns, k) if k else auto_k(x, columns, CATEGORY_KS)[1]).select("uuid", "cluster")
        got = Stage(got.join(t, "uuid").select("cluster", "uuid", "title", "tools")).df
        out.append(got.select(F.lit(model).alias("model"), "uuid", "cluster").join(cluster_labels(got).select("cluster", "label"), "cluster"))
    if not out:
        return t.select(F.lit("").alias("model"), "uuid", F.lit(0).alias("cluster"), F.lit("").alias("label")).where("false")
    return reduce(DataFrame.unionByName, out)
