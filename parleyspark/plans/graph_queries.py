"""Queries of search, the knowledge graph, clustering, export and upserts."""

from __future__ import annotations

from pyspark.sql import functions as F

from parleyspark.functions.patterns import STOPWORDS, TOOL_CATEGORIES
from parleyspark.operators import cluster as cl
from parleyspark.operators import entities as ent
from parleyspark.operators import export as ex
from parleyspark.operators import graph as g
from parleyspark.operators import relational as rel
from parleyspark.operators import render, search, titles, upsert
from parleyspark.plans.archive_queries import _PROFILES, _q, _snippets, _with, snippet_rows
from parleyspark.plans.stage import Stage
from parleyspark.plans.text_queries import _CHRON, _LAST, _MAIN, _N, _TITLES, _rec

SEARCH = "session OR archive NOT preview"
PHRASES = '("session log" OR archiv* OR NEAR(query review, 5)) NOT ^the'


def _graph(f, community: bool = False):
    """A query over the nodes with their degrees, and the edges; a given community where one is needed."""

    def run(a):
        e = Stage(g.edges(a)).df
        n = g.degrees(g.nodes(a), e)
        if community:
            n = n.withColumn("community_id", F.pmod(F.ascii("id"), F.lit(7)).cast("bigint"))
        return f(a, Stage(n).df, e)

    return _q(run)


def _members(a):
    """Conversations with a given cluster: by their number of messages."""
    return cl.conversation_texts(a).withColumn("cluster", F.pmod("msg_count", F.lit(5)).cast("bigint"))


def _k_means_communities(a, n, e):
    x = Stage(cl.features(a, n, g.entity_times(a))).df
    columns = [c for c in x.columns if c != "id"]
    n = x.count()
    if n < 4:  # no k is tried: one community, as in the reference
        return x.select("id", F.lit(0).alias("cluster"), F.lit(0).alias("k"))
    k, got = cl.auto_k(x, columns, cl.graph_ks(n))
    return got.select("id", "cluster").withColumn("k", F.lit(k))


def _communities(a, n, e):
    co = e.where("relation = 'co_occurs'")
    labels = Stage(cl.cluster_graph(n, e)).df
    return cl.communities(labels.withColumnRenamed("community", "label"), co, n).select("community_id", "seed", "node_count", F.round("cohesion", 6).alias("cohesion"), "label")


def _given_communities(a, n, e):
    """The table of communities for given labels."""
    labels = n.where("node_type = 'entity'").select("id", F.col("community_id").alias("label"))
    t = cl.communities(Stage(labels).df, e.where("relation = 'co_occurs'"), n)
    return t.select("community_id", "seed", "node_count", F.round("cohesion", 9).alias("cohesion"), F.array_join("top_entities", ",").alias("top_entities"), "label")


def _deleted(a):
    gone = rel.untitled(a).select("uuid")
    tables = {"conversations": (a.conversations, "uuid"), "messages": (a.messages, "conversation_uuid"), "content_blocks": (a.blocks, "conversation_uuid"), "entities": (a.entities, "conversation_uuid")}
    left = upsert.cascade_delete(tables, gone)
    out = None
    for k, t in left.items():
        one = t.agg(F.count("*").alias("n_rows")).select(F.lit(k).alias("table_name"), "n_rows")
        out = one if out is None else out.unionByName(one)
    return out


def _deleted_graph(a, n, e):
    left = upsert.delete_conversations(a, rel.untitled(a).select("uuid"), (n, e))
    counts = [left[k].agg(F.count("*").alias("n_rows")).select(F.lit(k).alias("table_name"), "n_rows") for k in ("graph_nodes", "graph_edges")]
    return counts[0].unionByName(counts[1])


def _incremental(a):
    old = ent.profiles(a, rel.structure(a)).where("conversation_uuid < '8'")
    return ent.update_profiles(a, rel.structure, Stage(old).df)


def _upserted(a):
    new = a.raw("projects").select("uuid", F.concat("name", F.lit(" (new)")).alias("name"), "fetched_at").where("uuid < '8'")
    return upsert.replace(a.projects.select("uuid", "name", "fetched_at"), new, ["uuid"])


def _ignored(a):
    new = a.raw("projects").select(F.upper("uuid").alias("uuid"), "name", "fetched_at").unionByName(a.raw("projects"))
    return upsert.ignore(a.projects.select("uuid", "name", "fetched_at"), new, ["uuid"])


def _accumulated(a):
    base = a.entities.where("type = 'topic'").groupBy("entity").agg(F.count("*").alias("weight"))
    new = a.entities.where("type != 'topic'").groupBy("entity").agg(F.count("*").alias("weight"))
    return upsert.accumulate(base, new, ["entity"], "weight")


QUERIES = {
    "fts_messages": _q(lambda a: search.search_messages(a, SEARCH)),
    "fts_unstemmed": _q(lambda a: search.search_messages(a, SEARCH, stemmed=False).select("message_uuid", "conversation_uuid", "name", F.round("rank", 9).alias("rank"))),
    "fts_grouped": _q(lambda a: snippet_rows(search.search_messages_grouped(a, SEARCH, stemmed=False))),
    "fts_thinking_grouped": _q(lambda a: snippet_rows(search.search_blocks_grouped(a, "archive", "thinking", stemmed=False))),
    "fts_indexed": _q(lambda a: search.Index(a.messages.select("uuid", "text"), "uuid", "text", stemmed=False).score(SEARCH).select(F.col("id").alias("message_uuid"), F.round("rank", 9).alias("rank"))),
    "fts_phrase_near_unstemmed": _q(lambda a: search.search_messages(a, PHRASES, stemmed=False).select("message_uuid")),
    "postings_unstemmed": _q(lambda a: search.postings(a.messages, "uuid", "text", stemmed=False).groupBy("term").agg(F.count("*").alias("n_places"), F.count_distinct("id").alias("n_texts"), F.sum("pos").alias("sum_of_places"))),
    "fts_thinking": _q(lambda a: search.search_blocks(a, "archive", "thinking", stemmed=False).withColumn("rank", F.round("rank", 9))),
    "fts_content_grouped": _q(lambda a: snippet_rows(search.search_blocks_grouped(a, "archive", stemmed=False))),
    "fts_phrase_near": _q(lambda a: search.search_messages(a, PHRASES)),
    "postings": _q(lambda a: search.postings(a.messages, "uuid", "text").groupBy("term").agg(F.count("*").alias("n_places"), F.count_distinct("id").alias("n_texts"))),
    "tool_usage": _q(g.tool_usage),
    "graph_nodes": _q(g.nodes),
    "graph_edges": _q(g.edges),
    "tool_cooccurrence": _q(lambda a: g.edges(a).where("relation = 'co_occurs' and source_id like 'tool:%' and target_id like 'tool:%'")),
    "node_degree": _graph(lambda a, n, e: n),
    "entity_temporal": _q(g.entity_times),
    "tool_metadata": _q(g.tool_metadata),
    "graph_profiles": _q(lambda a: g.profile_metadata(ent.profiles(a, rel.structure(a))).select("id", "category", F.get_json_object("meta", "$.total_words").cast("bigint").alias("total_words"))),
    "god_nodes": _graph(lambda a, n, e: g.god_nodes(n)),
    "suggest_questions": _graph(lambda a, n, e: g.suggest_questions(n)),
    "topic_hubs": _graph(lambda a, n, e: g.topic_hubs(a, n)),
    "temporal_bursts": _q(g.temporal_bursts),
    "bridge_entities": _graph(lambda a, n, e: g.bridges(n, e), community=True),
    "surprising_connections": _graph(lambda a, n, e: g.surprising(n, e), community=True),
    "tool_usage_stats": _graph(lambda a, n, e: g.tool_stats(n, e)),
    "neighbors": _graph(lambda a, n, e: g.neighbours(n, e, "api")),
    "bfs_subgraph": _graph(lambda a, n, e: g.subgraph(n, e, "storybook", 2)[0].select("id", "hop", "degree")),
    "bfs_subgraph_edges": _graph(lambda a, n, e: g.subgraph(n, e, "storybook", 1)[1].select("source_id", "target_id", "relation", "weight")),
    "bfs_subgraph_depth2_edges": _graph(lambda a, n, e: g.subgraph(n, e, "storybook", 2)[1].select("source_id", "target_id", "relation", "weight")),
    "shortest_path": _graph(lambda a, n, e: g.hop_distances(n, e, "tool:bash").select("id", "hops", F.array_join("path", " > ").alias("path"))),
    "hop_counts": _graph(lambda a, n, e: g.hop_distances(n, e, "tool:bash").select("id", "hops")),
    "given_communities": _graph(_given_communities, community=True),
    "label_propagation": _graph(lambda a, n, e: cl.cluster_graph(n, e)),
    "graph_communities": _graph(_communities),
    "kmeans_features": _graph(lambda a, n, e: cl.features(a, n, g.entity_times(a))),
    "kmeans_communities": _graph(_k_means_communities),
    "conversation_texts": _q(cl.conversation_texts),
    "tfidf": _q(lambda a: cl.tf_idf(cl.conversation_texts(a).select("uuid", cl.words(F.concat_ws(" ", "title", "first_human", "topics")).alias("terms")), "uuid", "terms")),
    "tool_flags": _q(lambda a: cl.tool_flags(cl.conversation_texts(a))),
    "cluster_labels": _q(lambda a: cl.cluster_labels(_members(a))),
    "categorize": _q(lambda a: cl.categorize(a)),
    "export_node_quota": _graph(lambda a, n, e: ex.select_nodes(n)),
    "export_looks": _graph(lambda a, n, e: ex.looks(n).select("id", "shape", "border", "colour", "size"), community=True),
    "export_temporal_colours": _q(lambda a: ex.temporal_colours(g.entity_times(a))),
    "export_around": _graph(lambda a, n, e: ex.select_around(n, e, "storybook", 1, 50).select("id", "hop", "degree")),
    "rendered_headers": _q(render.headers),
    "clustered_nodes": _graph(lambda a, n, e: cl.cluster(a, n, e)[0].select("id", "community_id")),
    "delete_empty_dry_run": _q(lambda a: upsert.delete_empty(a).select("uuid")),
    "delete_untitled_with_graph": _graph(_deleted_graph),
    "profiles_incremental": _q(_incremental),
    "session_titles": _q(lambda a: rel.search_sessions(a.conversations, "log", 20).select("uuid", "name")),
    "rename_dry_run": _q(lambda a: titles.rename_untitled(a, dry_run=True, limit=20)),
    "conversation_files": _q(rel.conversation_files),
    "export_widths": _graph(lambda a, n, e: ex.widths(e)),
    "export_linked_conversations": _q(ex.linked_conversations),
    "force_layout": _graph(lambda a, n, e: ex.layout(ex.select_nodes(n), e)),
    "rendered_messages": _q(render.sections),
    "rendered_tools": _q(render.tool_sections),
    "community_members": _graph(lambda a, n, e: cl.community(n, 3), community=True),
    "export_filtered_nodes": _graph(lambda a, n, e: ex.filter_nodes(n, ["topic", "tool"], 3, 2).select("id", "degree"), community=True),
    "viewer_nodes": _graph(lambda a, n, e: ex.filter_view(n, e, ["uuid", "url"], 2, 2.0, "a")[0].select("id", "degree")),
    "viewer_edges": _graph(lambda a, n, e: ex.filter_view(n, e, ["uuid", "url"], 2, 2.0, "a")[1].select("source_id", "target_id", "relation", "weight")),
    "categorize_vectors": _q(lambda a: cl.categorize_vectors(a, a.raw("conversation_embeddings"))),
    "most_diverse_tools": _q(lambda a: g.tool_metadata(a).where("tool_count > 0").orderBy(F.desc("tool_count"), "conversation_uuid").limit(10)),
    "upsert_latest": _q(_upserted),
    "upsert_ignore": _q(_ignored),
    "accumulating_upsert": _q(_accumulated),
    "cascade_delete_counts": _q(_deleted),
}

_TOOL = "block_type = 'tool_use' AND tool_name <> ''"
_NODES = f"""gn AS (SELECT id, label, node_type, entity_type FROM (
  SELECT 'conv:' || uuid AS id, coalesce(nullif(name, ''), uuid) AS label, 'conversation' AS node_type, NULL AS entity_type, 0 AS p FROM c
  UNION ALL SELECT entity, entity, 'entity', type, 1 FROM e UNION ALL SELECT 'tool:' || tool_name, tool_name, 'tool', NULL, 2 FROM b WHERE {_TOOL})
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY p, entity_type NULLS FIRST) = 1),
tu AS (SELECT conversation_uuid, tool_name, count(*) AS n_calls FROM b WHERE {_TOOL} GROUP BY 1, 2),
raw AS (SELECT 'conv:' || conversation_uuid AS source_id, 'tool:' || tool_name AS target_id, 'uses_tool' AS relation, n_calls AS weight, conversation_uuid FROM tu
  UNION ALL SELECT 'tool:' || x.tool_name, 'tool:' || y.tool_name, 'co_occurs', 1, x.conversation_uuid FROM tu x JOIN tu y ON x.conversation_uuid = y.conversation_uuid AND x.tool_name < y.tool_name
  UNION ALL SELECT x.entity, y.entity, 'co_occurs', 1, least(x.conversation_uuid, y.conversation_uuid) FROM e x JOIN e y ON x.message_uuid = y.message_uuid AND (x.entity < y.entity OR x.entity = y.entity AND x.type < y.type)
  UNION ALL SELECT entity, 'conv:' || conversation_uuid, 'mentioned_in', 1, conversation_uuid FROM e),
ge AS (SELECT source_id, target_id, relation, sum(weight)::DOUBLE AS weight, min(conversation_uuid) AS conversation_uuid FROM raw WHERE target_id IS NOT NULL GROUP BY 1, 2, 3),
sy AS (SELECT source_id AS id, target_id AS other, relation, weight FROM ge UNION ALL SELECT target_id, source_id, relation, weight FROM ge WHERE source_id <> target_id),
nd AS (SELECT gn.*, coalesce(d.degree, 0) AS degree, ascii(gn.id) % 7 AS community_id FROM gn LEFT JOIN (SELECT id, count(*) AS degree FROM sy GROUP BY 1) d USING (id))"""
_GOD = "top AS (SELECT id, label, entity_type, degree, row_number() OVER (ORDER BY degree DESC, id) AS r FROM nd WHERE node_type = 'entity')"
_TOKENS = r"tok AS (SELECT uuid, conversation_uuid, regexp_extract_all(lower(text), '[\p{L}\p{N}\x{300}-\x{36f}]+') AS ts FROM m), st AS (SELECT *, coalesce(len(ts), 0) AS dl FROM tok)"
_BTOKENS = r"tok AS (SELECT id, message_uuid, conversation_uuid, block_type, regexp_extract_all(lower(text_content), '[\p{L}\p{N}\x{300}-\x{36f}]+') AS ts FROM b), st AS (SELECT *, coalesce(len(ts), 0) AS dl FROM tok)"


def _tf(term: str) -> str:
    return f"coalesce(len(list_filter(ts, lambda x: x = '{term}')), 0)"


def _bm25(terms: list[str]) -> str:
    stats = ", ".join(f"greatest(CASE WHEN ln((count(*) - count(*) FILTER (WHERE {_tf(t)} > 0) + 0.5) / (count(*) FILTER (WHERE {_tf(t)} > 0) + 0.5)) > 0 THEN ln((count(*) - count(*) FILTER (WHERE {_tf(t)} > 0) + 0.5) / (count(*) FILTER (WHERE {_tf(t)} > 0) + 0.5)) ELSE 1e-6 END, 0) AS i{k}" for k, t in enumerate(terms))
    return f"stat AS (SELECT avg(dl) AS avgdl, {stats} FROM st)"


def _rank(terms: list[str]) -> str:
    return "round(-(" + " + ".join(f"i{k} * {_tf(t)} * 2.2 / ({_tf(t)} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for k, t in enumerate(terms)) + "), 9)"


_TERMS = ["session", "archive"]
_FTS = f"hit AS (SELECT st.uuid AS message_uuid, st.conversation_uuid, c.name, {_rank(_TERMS)} AS rank FROM st JOIN c ON c.uuid = st.conversation_uuid, stat WHERE {_tf('session')} > 0 OR ({_tf('archive')} > 0 AND {_tf('preview')} = 0))"
_BHIT = f"hit AS (SELECT st.id, message_uuid, conversation_uuid, block_type, {_rank(['archive'])} AS rank FROM st, stat WHERE {_tf('archive')} > 0)"


_MESSAGE_HITS = "SELECT hit.conversation_uuid, hit.message_uuid AS hit, hit.rank, m.sender, substring(m.text, 1, 200) AS text, m.created_at FROM hit JOIN m ON m.uuid = hit.message_uuid"
_BLOCK_HITS = "SELECT hit.conversation_uuid, hit.id AS hit, hit.rank, m.sender, substring(b.text_content, 1, 200) AS text, m.created_at FROM hit JOIN b ON b.id = hit.id JOIN m ON m.uuid = hit.message_uuid"
_AT = "list_filter(range(1, len(ts) + 1), lambda i: ts[i] = '{}')"
_PHRASES = f"""(len(list_filter(range(1, len(ts)), lambda i: ts[i] = 'session' AND ts[i + 1] = 'log')) > 0 OR len(list_filter(ts, lambda x: starts_with(x, 'archiv'))) > 0
  OR len(list_filter({_AT.format("query")}, lambda q: len(list_filter({_AT.format("review")}, lambda r: abs(q - r) <= 6)) > 0)) > 0) AND coalesce(ts[1], '') <> 'the'"""


_STOP = ", ".join(f"'{w}'" for w in sorted(STOPWORDS))


def _words(c: str) -> str:
    return rf"list_filter(regexp_split_to_array(regexp_replace(lower({c}), '[^a-z0-9 \t\n\f\r]', ' ', 'g'), '[ \t\n\f\r]+'), lambda w: length(w) >= 3 AND w NOT IN ({_STOP}))"


_CONV = """ct AS (SELECT c.uuid, c.name AS title, x.msg_count, coalesce(x.t, '') AS first_human, coalesce(tp.topics, '') AS topics, coalesce(tl.tools, '') AS tools FROM c
  JOIN (SELECT conversation_uuid AS uuid, count(*) AS msg_count, max(CASE WHEN hr = 1 AND sender = 'human' THEN substring(text, 1, 1000) END) AS t FROM (SELECT *, row_number() OVER (PARTITION BY conversation_uuid, sender = 'human' ORDER BY created NULLS FIRST, uuid) AS hr FROM m) GROUP BY 1) x USING (uuid)
  LEFT JOIN (SELECT conversation_uuid AS uuid, string_agg(entity, ',' ORDER BY entity) AS topics FROM (SELECT DISTINCT conversation_uuid, entity FROM e WHERE type = 'topic') GROUP BY 1) tp USING (uuid)
  LEFT JOIN (SELECT conversation_uuid AS uuid, string_agg(tool_name, ',' ORDER BY tool_name) AS tools FROM (SELECT DISTINCT conversation_uuid, tool_name FROM b WHERE block_type = 'tool_use' AND tool_name <> '') GROUP BY 1) tl USING (uuid))"""
_NAMES = "list_filter(string_split(lower(tools), ','), lambda x: x <> '')"


def _has(parts: list[str]) -> str:
    return f"(len(list_filter({_NAMES}, lambda x: {' OR '.join(f'contains(x, {chr(39)}{p}{chr(39)})' for p in parts)})) > 0)::BIGINT"


_FLAGS = ", ".join(f"{_has(v)} AS tool_{k}" for k, v in TOOL_CATEGORIES.items())
_VIEW = "vn AS (SELECT * FROM nd WHERE coalesce(entity_type, node_type) NOT IN ('uuid', 'url') AND degree >= 2 AND contains(lower(label), 'a'))"
_ORDER = "direction DESC, weight DESC, id, relation"

SQL = {
    "fts_unstemmed": _with(_TOKENS, _bm25(_TERMS), _FTS) + "SELECT * FROM hit",
    "fts_grouped": _with(_TOKENS, _bm25(_TERMS), _FTS, _snippets(_MESSAGE_HITS, "rank, hit")).rstrip(),
    "fts_thinking": _with(_BTOKENS, _bm25(["archive"]), _BHIT) + "SELECT * FROM hit WHERE block_type = 'thinking'",
    "fts_content_grouped": _with(_BTOKENS, _bm25(["archive"]), _BHIT, _snippets(_BLOCK_HITS, "rank, hit")).rstrip(),
    "fts_thinking_grouped": _with(_BTOKENS, _bm25(["archive"]), _BHIT, _snippets(_BLOCK_HITS + " WHERE hit.block_type = 'thinking'", "rank, hit")).rstrip(),
    "fts_indexed": _with(_TOKENS, _bm25(_TERMS), f"hit AS (SELECT st.uuid AS message_uuid, {_rank(_TERMS)} AS rank FROM st, stat WHERE {_tf('session')} > 0 OR ({_tf('archive')} > 0 AND {_tf('preview')} = 0))") + "SELECT * FROM hit",
    "fts_phrase_near_unstemmed": _with(_TOKENS) + f"SELECT st.uuid AS message_uuid FROM st JOIN c ON c.uuid = st.conversation_uuid WHERE {_PHRASES}",
    "postings_unstemmed": _with(_TOKENS) + "SELECT term, count(*) AS n_places, count(DISTINCT uuid) AS n_texts, sum(pos)::BIGINT AS sum_of_places FROM (SELECT uuid, unnest(ts) AS term, unnest(range(len(ts))) AS pos FROM st) GROUP BY 1",
    "tool_usage": _with() + f"SELECT conversation_uuid, tool_name, count(*) AS n_calls FROM b WHERE {_TOOL} GROUP BY 1, 2",
    "graph_nodes": _with(_NODES) + "SELECT * FROM gn",
    "graph_edges": _with(_NODES) + "SELECT * FROM ge",
    "tool_cooccurrence": _with(_NODES) + "SELECT * FROM ge WHERE relation = 'co_occurs' AND starts_with(source_id, 'tool:') AND starts_with(target_id, 'tool:')",
    "node_degree": _with(_NODES) + "SELECT id, label, node_type, entity_type, degree FROM nd",
    "entity_temporal": _with() + "SELECT entity, min(epoch_ms(created)) AS first_seen_ms, max(epoch_ms(created)) AS last_seen_ms FROM e JOIN m ON m.uuid = e.message_uuid GROUP BY 1",
    "tool_metadata": _with(f"t AS (SELECT conversation_uuid, count(*) AS n, list_sort(list(DISTINCT tool_name)) AS names FROM b WHERE {_TOOL} GROUP BY 1)") + "SELECT c.uuid AS conversation_uuid, coalesce(n, 0) AS tool_count, coalesce(len(names), 0) AS distinct_tools, coalesce(to_json(names)::VARCHAR, '[]') AS tool_names FROM c LEFT JOIN t ON t.conversation_uuid = c.uuid",
    "graph_profiles": _with(_PROFILES) + "SELECT 'conv:' || conversation_uuid AS id, primary_type AS category, words AS total_words FROM profiles",
    "god_nodes": _with(_NODES, _GOD) + "SELECT id, label, entity_type, degree FROM top WHERE r <= 10",
    "suggest_questions": _with(_NODES, _GOD)
    + "SELECT 0 AS place, 'Find all conversations about ''' || label || ''' (most connected entity)' AS question FROM top WHERE r = 1 UNION ALL SELECT x.r::INT, 'Search conversations where ''' || x.label || ''' and ''' || y.label || ''' both appear' FROM top x JOIN top y ON y.r = x.r + 1 WHERE x.r < 5",
    "topic_hubs": _with(_NODES) + "SELECT entity, count(DISTINCT conversation_uuid) AS conversation_count, max(degree) AS degree FROM e JOIN nd ON nd.id = e.entity AND nd.node_type = 'entity' WHERE type = 'topic' GROUP BY 1",
    "temporal_bursts": _with() + "SELECT entity, strftime(created AT TIME ZONE 'UTC', '%Y-W%W') AS week, min(type) AS entity_type, count(*) AS mentions FROM e JOIN m ON m.uuid = e.message_uuid WHERE created IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 5",
    "bridge_entities": _with(_NODES, "x AS (SELECT DISTINCT a.id, a.entity_type, a.degree, o.community_id FROM sy JOIN nd a ON a.id = sy.id AND a.node_type = 'entity' JOIN nd o ON o.id = sy.other WHERE relation = 'co_occurs' AND a.community_id <> o.community_id)")
    + "SELECT id AS entity, entity_type, degree, count(*) AS communities_connected, string_agg(community_id::VARCHAR, ',' ORDER BY community_id) AS community_ids FROM x GROUP BY 1, 2, 3 HAVING count(*) >= 3",
    "surprising_connections": _with(_NODES) + "SELECT x.label AS source_label, y.label AS target_label, weight FROM ge JOIN nd x ON x.id = source_id AND x.node_type = 'entity' JOIN nd y ON y.id = target_id AND y.node_type = 'entity' WHERE relation = 'co_occurs' AND x.community_id <> y.community_id",
    "tool_usage_stats": _with(_NODES) + "SELECT nd.label AS tool_name, count(DISTINCT conversation_uuid) AS conversation_count, sum(weight)::BIGINT AS total_calls, max(degree) AS degree FROM ge JOIN nd ON nd.id = target_id AND node_type = 'tool' WHERE relation = 'uses_tool' GROUP BY 1",
    "neighbors": _with(
        _NODES,
        f"x AS ((SELECT target_id AS id, relation, weight, 'outgoing' AS direction FROM ge WHERE source_id = 'api' ORDER BY {_ORDER} LIMIT 20) UNION ALL (SELECT source_id, relation, weight, 'incoming' FROM ge WHERE target_id = 'api' ORDER BY 4 DESC, 3 DESC, 1, 2 LIMIT 20))",
        f"y AS (SELECT *, row_number() OVER (ORDER BY {_ORDER})::INT AS place FROM x WHERE id IN (SELECT id FROM nd))",
    )
    + "SELECT * FROM y WHERE place <= 20",
    "bfs_subgraph": _with(
        _NODES, "h0 AS (SELECT id FROM nd WHERE contains(lower(label), 'storybook') OR contains(lower(id), 'storybook') ORDER BY id LIMIT 20)", "h1 AS (SELECT DISTINCT other AS id FROM sy WHERE id IN (FROM h0) AND other NOT IN (FROM h0))",
        "h2 AS (SELECT DISTINCT other AS id FROM sy WHERE id IN (FROM h1) AND other NOT IN (FROM h0) AND other NOT IN (FROM h1))", "h AS (SELECT id, 0 AS hop FROM h0 UNION ALL SELECT id, 1 FROM h1 UNION ALL SELECT id, 2 FROM h2)",
    )
    + "SELECT id, hop, degree FROM h JOIN nd USING (id)",
    "bfs_subgraph_edges": _with(
        _NODES, "h0 AS (SELECT id FROM nd WHERE contains(lower(label), 'storybook') OR contains(lower(id), 'storybook') ORDER BY id LIMIT 20)", "h AS (SELECT id FROM h0 UNION SELECT other FROM sy WHERE id IN (FROM h0))",
    )
    + "SELECT source_id, target_id, relation, weight FROM ge WHERE source_id IN (FROM h) AND target_id IN (FROM h)",
    "kmeans_features": _with(
        _NODES, "r AS (SELECT entity AS id, count(DISTINCT conversation_uuid) AS reach FROM e GROUP BY 1)", "s AS (SELECT entity AS id, min(epoch_ms(created)) AS fs FROM e JOIN m ON m.uuid = e.message_uuid GROUP BY 1)",
        "x AS (SELECT nd.*, coalesce(reach, 0) AS reach, fs FROM nd LEFT JOIN r USING (id) LEFT JOIN s USING (id) WHERE node_type = 'entity')", "t AS (SELECT max(degree) AS md, max(reach) AS mr, min(fs) AS lo, max(fs) AS hi FROM x)",
    )
    + "SELECT id, round(degree / greatest(md, 1), 9) AS degree, (entity_type = 'topic')::DOUBLE AS is_topic, (entity_type = 'url')::DOUBLE AS is_url, (entity_type = 'uuid')::DOUBLE AS is_uuid, CASE WHEN starts_with(id, 'tool:') THEN 1.0 ELSE 0.0 END::DOUBLE AS tool_assoc,"
    " round(CASE WHEN fs IS NULL OR hi = lo THEN 0.5 ELSE (fs - lo) / (hi - lo) END, 9) AS first_seen, round(reach / greatest(mr, 1), 9) AS reach FROM x, t",
    "conversation_texts": _with(_CONV) + "SELECT * FROM ct",
    "tfidf": _with(
        _CONV, f"w AS (SELECT uuid, unnest({_words('concat_ws(chr(32), title, first_human, topics)')}) AS term FROM ct)", "tf AS (SELECT uuid, term, count(*) AS tf FROM w GROUP BY 1, 2)", "nn AS (SELECT count(*) AS n FROM ct)",
        "df AS (SELECT term, count(*) AS df FROM tf, nn GROUP BY 1 HAVING count(*) >= 2 AND count(*) <= floor(0.8 * max(n)) ORDER BY 2 DESC, 1 LIMIT 500)", "x AS (SELECT uuid, tf.term, tf * ln(n / df) AS w FROM tf JOIN df ON df.term = tf.term, nn)",
    )
    + "SELECT uuid, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY uuid)), 6) AS weight FROM x",
    "tool_flags": _with(_CONV)
    + f"SELECT uuid, {_FLAGS}, CASE WHEN msg_count <= 2 THEN 0.0 WHEN msg_count <= 5 THEN 0.2 WHEN msg_count <= 10 THEN 0.4 WHEN msg_count <= 20 THEN 0.6 WHEN msg_count <= 50 THEN 0.8 ELSE 1.0 END::DOUBLE AS msg_bucket, (len({_NAMES}) > 0)::BIGINT AS has_tool, least(1.0, len({_NAMES}) / 10)::DOUBLE AS tool_diversity FROM ct",
    "cluster_labels": _with(
        _CONV, "mem AS (SELECT *, msg_count % 5 AS cluster FROM ct)", f"w AS (SELECT cluster, unnest({_words('coalesce(title, chr(32))')}) AS term FROM mem)", "wc AS (SELECT cluster, term, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, term) AS r FROM w GROUP BY 1, 2)",
        "tp AS (SELECT cluster, string_agg(term, ',' ORDER BY r) FILTER (WHERE r <= 5) AS top_terms, string_agg(term, ', ' ORDER BY r) FILTER (WHERE r <= 3) AS short FROM wc GROUP BY 1)",
        f"fl AS (SELECT cluster, {_FLAGS} FROM mem)", "sm AS (SELECT cluster, count(*) AS n, " + ", ".join(f"sum(tool_{k}) AS {k}" for k in TOOL_CATEGORIES) + " FROM fl GROUP BY 1)",
        "un AS (SELECT * FROM (UNPIVOT sm ON " + ", ".join(TOOL_CATEGORIES) + " INTO NAME kind VALUE k) QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY k DESC, kind DESC) = 1)",
    )
    + "SELECT un.cluster, CASE WHEN k > 0.4 * n THEN kind || ': ' || coalesce(short, '') ELSE coalesce(nullif(short, ''), 'uncategorized') END AS label, coalesce(top_terms, '') AS top_terms FROM un LEFT JOIN tp USING (cluster)",
    "export_node_quota": _with(_NODES, "k AS (SELECT *, CASE WHEN node_type = 'entity' THEN entity_type ELSE node_type END AS kind FROM nd)", "r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY degree DESC, id) AS r FROM k)")
    + "SELECT id, label, node_type, entity_type, degree, kind FROM r WHERE r <= CASE kind WHEN 'topic' THEN 60 WHEN 'tool' THEN 50 WHEN 'conversation' THEN 50 WHEN 'url' THEN 30 WHEN 'uuid' THEN 10 END ORDER BY degree DESC, id LIMIT 200",
    "export_looks": _with(_NODES) + "SELECT id, CASE WHEN node_type = 'conversation' THEN 'square' WHEN node_type = 'tool' THEN 'star' WHEN entity_type = 'url' THEN 'diamond' WHEN entity_type = 'uuid' THEN 'triangleDown' ELSE 'dot' END AS shape, CASE WHEN node_type = 'tool' THEN '#ff6b35' WHEN entity_type = 'topic' THEN '#e94560' WHEN entity_type = 'url' THEN '#59a14f' WHEN entity_type = 'uuid' THEN '#b07aa1' ELSE '#ffffff' END AS border, list_extract(['#4e79a7', '#f28e2b', '#e15759', '#76b7b2', '#59a14f', '#edc948', '#b07aa1', '#ff9da7', '#9c755f', '#bab0ac'], ((community_id + 9) % 10 + 1)::BIGINT) AS colour, round(greatest(10.0, least(60.0, 8 + sqrt(degree))), 6)::DOUBLE AS size FROM nd",
    "export_widths": _with(_NODES) + "SELECT source_id, target_id, relation, round(greatest(0.5, least(4.0, sqrt(weight))), 6)::DOUBLE AS width FROM ge",
    "export_linked_conversations": _with("x AS (SELECT DISTINCT e.entity, e.conversation_uuid, c.updated FROM e JOIN c ON c.uuid = e.conversation_uuid)", "r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY updated DESC NULLS LAST, conversation_uuid) AS r FROM x)")
    + "SELECT entity, count(*) AS conv_count, string_agg(conversation_uuid, ',' ORDER BY r) FILTER (WHERE r <= 20) AS conversations FROM r GROUP BY 1",
    "rendered_messages": _rec(_N, _LAST, _MAIN, f"b2 AS (SELECT conv AS conversation_uuid, place, id AS message_uuid FROM main UNION ALL {_CHRON} WHERE conv NOT IN (SELECT conv FROM root))")
    + "SELECT b2.conversation_uuid, place, '### **' || CASE t WHEN 'human' THEN 'Human' ELSE 'Assistant' END || '** — ' || coalesce(created_at, '') || chr(10) || chr(10) || coalesce(text, '') || chr(10) AS markdown,"
    " '<' || t || '>' || replace(replace(replace(replace(coalesce(text, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;') || '</' || t || '>' AS xml, json_object('sender', sender, 'text', text, 'created_at', created_at)::VARCHAR AS json"
    " FROM b2 JOIN (SELECT *, CASE WHEN lower(trim(sender, ' ')) IN ('human', 'user') THEN 'human' ELSE 'assistant' END AS t FROM m) x ON x.uuid = b2.message_uuid",
    "rendered_tools": _with()
    + "SELECT id, message_uuid, CASE WHEN block_type = 'tool_use' THEN '[tool_use:' || coalesce(tool_name, '') || '] ' || CASE WHEN length(coalesce(tool_input, '')) > 300 THEN substring(tool_input, 1, 300) || '…' ELSE coalesce(tool_input, '') END"
    " ELSE '[tool_result] ' || CASE WHEN length(coalesce(text_content, '')) > 600 THEN substring(text_content, 1, 600) || '…' ELSE coalesce(text_content, '') END END AS line FROM b WHERE block_type IN ('tool_use', 'tool_result')",
    "community_members": _with(_NODES) + "SELECT id, label, node_type, entity_type, degree FROM nd WHERE community_id = 3",
    "export_filtered_nodes": _with(_NODES) + "SELECT id, degree FROM nd WHERE community_id = 3 AND degree >= 2 AND coalesce(entity_type, node_type) IN ('topic', 'tool')",
    "viewer_nodes": _with(_NODES, _VIEW) + "SELECT id, degree FROM vn",
    "viewer_edges": _with(_NODES, _VIEW) + "SELECT source_id, target_id, relation, weight FROM ge WHERE weight >= 2 AND source_id IN (SELECT id FROM vn) AND target_id IN (SELECT id FROM vn)",
    "most_diverse_tools": _with(f"t AS (SELECT conversation_uuid, count(*) AS tool_count, list_sort(list(DISTINCT tool_name)) AS names FROM b WHERE {_TOOL} GROUP BY 1)") + "SELECT conversation_uuid, tool_count, len(names) AS distinct_tools, to_json(names)::VARCHAR AS tool_names FROM t WHERE conversation_uuid IN (SELECT uuid FROM c) ORDER BY tool_count DESC, conversation_uuid LIMIT 10",
    "upsert_latest": _with() + "SELECT uuid, name || CASE WHEN uuid < '8' THEN ' (new)' ELSE '' END AS name, fetched_at FROM p",
    "upsert_ignore": _with() + "SELECT uuid, name, fetched_at FROM p UNION ALL SELECT upper(uuid), name, fetched_at FROM projects WHERE upper(uuid) <> uuid",
    "accumulating_upsert": _with() + "SELECT entity, count(*) AS weight FROM e WHERE type IS NOT NULL GROUP BY 1",
    "cascade_delete_counts": _with("d AS (SELECT uuid FROM c WHERE name IS NULL OR name = '')")
    + "SELECT 'conversations' AS table_name, count(*) AS n_rows FROM c WHERE uuid NOT IN (FROM d) UNION ALL SELECT 'messages', count(*) FROM m WHERE conversation_uuid NOT IN (FROM d) UNION ALL SELECT 'content_blocks', count(*) FROM b WHERE conversation_uuid NOT IN (FROM d) UNION ALL SELECT 'entities', count(*) FROM e WHERE conversation_uuid NOT IN (FROM d)",
    "export_temporal_colours": _with("t AS (SELECT entity, max(epoch_ms(created)) AS t_ms FROM e JOIN m ON m.uuid = e.message_uuid GROUP BY 1)", "r AS (SELECT entity, (t_ms - (SELECT min(t_ms) FROM t)) / coalesce(nullif((SELECT max(t_ms) - min(t_ms) FROM t), 0), 1)::DOUBLE AS r FROM t)")
    + "SELECT entity, coalesce('rgb(' || floor(CASE WHEN r < 0.5 THEN r * 510 ELSE 255 END + 0.5)::INT || ',' || floor(CASE WHEN r < 0.5 THEN 128 + r * 255 ELSE 255 * (1 - (r - 0.5) * 2) END + 0.5)::INT || ',' || floor(CASE WHEN r < 0.5 THEN 255 * (1 - r * 2) ELSE 0 END + 0.5)::INT || ')', '#aaaaaa') AS colour FROM r",
    "export_around": _with(_NODES, "s AS (SELECT id FROM nd WHERE contains(lower(label), 'storybook') OR contains(lower(id), 'storybook') ORDER BY id LIMIT 10)", "h AS (SELECT id, 0 AS hop FROM s UNION ALL SELECT DISTINCT other, 1 FROM sy WHERE id IN (FROM s) AND other NOT IN (FROM s))")
    + "SELECT id, hop, degree FROM h JOIN nd USING (id) ORDER BY hop, degree DESC, id LIMIT 50",
    "rendered_headers": _rec(_N, _LAST, _MAIN, f"b2 AS (SELECT conv, id FROM main UNION ALL SELECT conversation_uuid, message_uuid FROM ({_CHRON}) WHERE conversation_uuid NOT IN (SELECT conv FROM root))", "h AS (SELECT c.uuid, coalesce(nullif(c.name, ''), 'Untitled') AS title, coalesce(c.created_at, '') AS t_ms, (SELECT count(*) FROM b2 WHERE b2.conv = c.uuid) AS n FROM c)")
    + "SELECT uuid AS conversation_uuid, '# ' || title || chr(10) || chr(10) || '**ID:** ' || uuid || chr(10) || '**Created:** ' || t_ms || chr(10) || '**Messages:** ' || n || chr(10) || chr(10) || '---' || chr(10) AS markdown,"
    " '<conversation title=\"' || replace(replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') || '\" id=\"' || uuid || '\">' AS xml FROM h",
    "delete_empty_dry_run": _with() + "SELECT uuid FROM c WHERE uuid NOT IN (SELECT conversation_uuid FROM messages WHERE conversation_uuid IS NOT NULL)",
    "delete_untitled_with_graph": _with(_NODES, "d AS (SELECT uuid FROM c WHERE name IS NULL OR name = '')", "dn AS (SELECT 'conv:' || uuid AS id FROM d)")
    + "SELECT 'graph_nodes' AS table_name, count(*) AS n_rows FROM nd WHERE id NOT IN (FROM dn) UNION ALL SELECT 'graph_edges', count(*) FROM ge WHERE coalesce(conversation_uuid NOT IN (FROM d), true) AND source_id NOT IN (FROM dn) AND target_id NOT IN (FROM dn)",
    "profiles_incremental": _with(_PROFILES) + "SELECT * FROM profiles",
    "session_titles": _with() + "SELECT uuid, name FROM c WHERE contains(lower(name), 'log') ORDER BY updated DESC NULLS LAST, uuid LIMIT 20",
    "rename_dry_run": _with(_TITLES, "l AS (SELECT uuid FROM c WHERE name IS NULL OR name = '' ORDER BY updated DESC NULLS LAST, uuid LIMIT 20)") + "SELECT uuid, title, source FROM g WHERE title IS NOT NULL AND uuid IN (FROM l)",
    "conversation_files": _with(
        """x AS (SELECT uuid, conversation_uuid, sender, epoch_ms(created) AS t_ms, from_json(CASE WHEN json_valid(files) THEN files ELSE '[]' END, '[{"file_uuid":"VARCHAR","file_name":"VARCHAR","created_at":"VARCHAR"}]') AS fs FROM m WHERE files IS NOT NULL)""",
        "f AS (SELECT * EXCLUDE (fs), unnest(fs) AS f, unnest(range(len(fs))) AS pos FROM x)",
        "k AS (SELECT *, substring(f.created_at, 1, 10) AS date FROM f WHERE f.file_uuid <> '' QUALIFY row_number() OVER (PARTITION BY conversation_uuid, f.file_uuid ORDER BY coalesce(t_ms, -1), uuid, pos) = 1)",
    )
    + """SELECT conversation_uuid, f.file_uuid AS file_uuid, coalesce(f.file_name, '') AS file_name, CASE WHEN sender IS DISTINCT FROM 'human' THEN 'generated' WHEN lower(string_split(f.file_name, '.')[-1]) IN ('pdf', 'doc', 'docx', 'txt', 'md', 'xlsx', 'csv', 'json', 'xml') THEN 'sources' ELSE 'photos' END AS category,
  CASE WHEN starts_with(lower(f.file_name), 'page_') THEN 'v01' WHEN starts_with(lower(f.file_name), 'v2_') THEN 'v02' WHEN starts_with(lower(f.file_name), 'v3_') THEN 'v03' WHEN starts_with(lower(f.file_name), 'v4_') THEN 'v04' ELSE 'v05-latest' END AS folder, date,
  row_number() OVER (PARTITION BY array_to_string(regexp_split_to_array(trim(regexp_replace(lower(coalesce(c.name, '')), '[^a-z0-9 ]+', ' ', 'g')), ' +')[1:3], '-'), date ORDER BY conversation_uuid, coalesce(t_ms, -1), k.uuid, pos) AS sequence FROM k LEFT JOIN c ON c.uuid = k.conversation_uuid""",
    "hop_counts": _with(_NODES, "lk AS (SELECT DISTINCT id, other FROM sy WHERE id <> other)").replace("WITH ", "WITH RECURSIVE ", 1).rstrip()
    + ", w(id, hops) USING KEY (id) AS (SELECT id, 0::BIGINT FROM gn WHERE id = 'tool:bash' UNION SELECT DISTINCT lk.other, w.hops + 1 FROM w JOIN lk USING (id) WHERE lk.other NOT IN (SELECT id FROM recurring.w)) SELECT id, hops FROM w",
    "given_communities": _with(
        _NODES,
        "l AS (SELECT id, label, degree, community_id AS seed FROM nd WHERE node_type = 'entity')",
        "s AS (SELECT seed, count(*) AS node_count, row_number() OVER (ORDER BY count(*) DESC, seed) AS community_id FROM l GROUP BY 1)",
        "i AS (SELECT x.seed, count(*) AS n FROM ge JOIN l x ON x.id = source_id JOIN l y ON y.id = target_id WHERE relation = 'co_occurs' AND source_id <> target_id AND x.seed = y.seed GROUP BY 1)",
        "t AS (SELECT seed, id, row_number() OVER (PARTITION BY seed ORDER BY degree DESC, id) AS r FROM l)",
        "tt AS (SELECT seed, string_agg(id, ',' ORDER BY r) AS top_entities, string_agg(id, ', ' ORDER BY r) FILTER (WHERE r <= 3) AS label FROM t WHERE r <= 5 GROUP BY 1)",
    )
    + "SELECT community_id, seed, node_count, round(CASE WHEN node_count > 1 THEN coalesce(i.n, 0) / (node_count * (node_count - 1) / 2) ELSE 0 END, 9) AS cohesion, top_entities, tt.label FROM s LEFT JOIN i USING (seed) JOIN tt USING (seed)",
}
