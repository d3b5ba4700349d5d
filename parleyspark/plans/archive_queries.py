"""Queries of the relational, statistics and text operators over the whole archive, with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from parleyspark.functions.patterns import CATEGORIES, ENTITIES, re2
from parleyspark.operators import entities as ent
from parleyspark.operators import relational as rel
from parleyspark.sources.archive import CANON, Archive


def _q(f):
    return lambda spark, root: f(Archive(spark, root))


QUERIES = {
    "conversation_stats": _q(rel.message_totals),
    "audit_counts": _q(rel.audit),
    "untitled_conversations": _q(rel.untitled),
    "empty_conversations": _q(rel.empty),
    "title_search": _q(lambda a: rel.search_conversations(a, "api", after="2024-06-01T00:00:00Z", before="2026-06-01T00:00:00Z")),
    "edit_history": _q(rel.edit_histories),
    "message_siblings": _q(rel.sibling_counts),
    "first_messages": _q(rel.first_messages),
    "topic_scan": _q(rel.topic_scan),
    "attachment_search": _q(lambda a: rel.attachment_search(a, "session", 3)),
    "attachments": _q(rel.attachments),
    "artifacts": _q(rel.artifacts),
    "file_manifest": _q(rel.file_manifest),
    "manifest_counts": _q(lambda a: rel.file_manifest(a).groupBy("category", "folder").agg(F.count("*").alias("n_files"))),
    "random_sample": _q(rel.random_sample),
    "profile_worklist": _q(lambda a: rel.without_profile(a.conversations, a.conversations.where("uuid < '8'").select(F.col("uuid").alias("conversation_uuid"))).select("uuid")),
    "search_tool": _q(lambda a: rel.search_tool(a, "bash")),
    "search_tool_grouped": _q(lambda a: snippet_rows(rel.search_tool_grouped(a, "bash"))),
    "search_by_entity": _q(lambda a: rel.search_entity(a, "api", "topic").drop("created")),
    "search_by_entity_grouped": _q(lambda a: snippet_rows(rel.search_entity_grouped(a, "API", "topic"))),
    "monthly_activity": _q(rel.monthly_activity),
    "top_conversations": _q(rel.top_conversations),
    "top_tools": _q(rel.top_tools),
    "date_range": _q(rel.date_range),
    "blocks_by_type": _q(lambda a: a.blocks.groupBy("block_type").agg(F.count("*").alias("n_blocks"))),
    "entities_by_type": _q(lambda a: a.entities.groupBy("type").agg(F.count("*").alias("n_entities"))),
    "structural_metrics": _q(rel.structure),
    "project_list": _q(rel.projects),
    "conversation_urls": _q(lambda a: a.conversations.select("uuid", rel.conversation_url(F.col("uuid")).alias("url"))),
    "entity_extract": _q(ent.extract_entities),
    "profiles": _q(lambda a: ent.profiles(a, rel.structure(a))),
    "profile_by_sender": _q(ent.sender_profiles),
    "category_details": _q(ent.category_details),
    "profile_aggregates": _q(lambda a: ent.profile_aggregates(ent.profiles(a, rel.structure(a)))),
    "profile_query": _q(lambda a: ent.query_profiles(ent.profiles(a, rel.structure(a)), "coding", 0.01).select("conversation_uuid", "primary_type", "technical_density", "words")),
}

_BLANK = "({0} IS NULL OR {0} = '')"
_TEXTS = """t AS (SELECT uuid AS message_uuid, conversation_uuid, sender, text FROM m WHERE text IS NOT NULL
  UNION ALL SELECT message_uuid, conversation_uuid, NULL, text_content FROM b WHERE block_type IN ('text', 'thinking', 'voice_note') AND text_content IS NOT NULL)"""
_STRUCTURE = """ms AS (SELECT conversation_uuid, count(*) AS message_count, count(*) FILTER (WHERE sender = 'human') AS human_messages, count(*) FILTER (WHERE sender = 'assistant') AS assistant_messages,
  count(*) FILTER (WHERE attachments IS NOT NULL AND attachments NOT IN ('', '[]')) AS attachment_count, greatest(0, max(epoch_ms(created)) - min(epoch_ms(created))) AS ms FROM m GROUP BY 1),
ks AS (SELECT conversation_uuid, count(*) AS branch_points FROM (SELECT conversation_uuid, parent_message_uuid FROM m WHERE parent_message_uuid IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1),
bs AS (SELECT conversation_uuid, count(*) FILTER (WHERE block_type = 'tool_use') AS tool_invocations, count(*) FILTER (WHERE block_type = 'tool_result' AND is_error = 1) AS tool_errors, count(*) FILTER (WHERE block_type = 'thinking') AS thinking_blocks FROM b GROUP BY 1),
structure AS (SELECT conversation_uuid, coalesce(message_count, 0) AS message_count, coalesce(human_messages, 0) AS human_messages, coalesce(assistant_messages, 0) AS assistant_messages, coalesce(attachment_count, 0) AS attachment_count,
  coalesce(branch_points, 0) AS branch_points, coalesce(tool_invocations, 0) AS tool_invocations, coalesce(tool_errors, 0) AS tool_errors, coalesce(thinking_blocks, 0) AS thinking_blocks, round(coalesce(ms, 0) / 60000, 6) AS duration_minutes
  FROM ms LEFT JOIN ks USING (conversation_uuid) FULL JOIN bs USING (conversation_uuid))"""


def _count(p: str, case: bool) -> str:
    return f"len(regexp_extract_all(text, '{re2(p, case)}'))"


_NAMES = [c for c, _, _ in CATEGORIES]
_PER = "per AS (SELECT *, " + ", ".join(f"{_count(p, case)} AS {c}" for c, p, case in CATEGORIES) + r", len(regexp_extract_all(text, '```\w*\s*\n')) AS code_blocks, regexp_extract_all(text, '```(\w*)\s*\n', 1) AS langs, len(regexp_extract_all(text, '[^\s\p{Z}\x{85}\x0b\x1c-\x1f]+')) AS words, length(text) AS chars FROM t)"
_PROFILES = (
    f"{_TEXTS}, {_STRUCTURE}, {_PER}, sums AS (SELECT conversation_uuid, " + ", ".join(f"sum({c})::BIGINT AS {c}" for c in [*_NAMES, "code_blocks", "words", "chars"]) + ", count(sender) AS n_texts FROM per GROUP BY 1),\n"
    "lg AS (SELECT conversation_uuid, string_agg(l, ',' ORDER BY l) AS code_block_langs FROM (SELECT DISTINCT conversation_uuid, lower(unnest(langs)) AS l FROM per) WHERE l <> '' GROUP BY 1),\n"
    "scored AS (SELECT *, code_keywords + code_identifiers + 3 * code_blocks AS s1, docker_ops + cli_commands + git_operations AS s2, definitions + doc_references + urls AS s3, question_patterns + error_patterns AS s4 FROM sums),\n"
    "profiles AS (SELECT structure.*, " + ", ".join(f"coalesce({c}, 0) AS {c}" for c in [*_NAMES, "code_blocks", "words", "chars"]) + ", coalesce(code_block_langs, '') AS code_block_langs,\n"
    "  coalesce(CASE greatest(s1, s2, s3, s4) WHEN 0 THEN 'general' WHEN s1 THEN 'coding' WHEN s2 THEN 'devops' WHEN s3 THEN 'research' WHEN s4 THEN 'qa' END, 'general') AS primary_type,\n"
    f"  coalesce(round(CASE WHEN chars > 0 THEN least(1.0, ({' + '.join(_NAMES)}) / (chars / 100)) ELSE 0.0 END, 9), 0.0)::DOUBLE AS technical_density, coalesce(round(chars / greatest(n_texts, 1), 1), 0.0)::DOUBLE AS avg_message_length\n"
    "  FROM structure LEFT JOIN scored USING (conversation_uuid) LEFT JOIN lg USING (conversation_uuid))"
)
_ATT = """att AS (SELECT *, from_json(CASE WHEN json_valid(attachments) THEN attachments ELSE '[]' END, '[{"file_name":"VARCHAR","file_type":"VARCHAR","file_size":"BIGINT","extracted_content":"VARCHAR"}]') AS xs FROM m WHERE attachments IS NOT NULL AND attachments NOT IN ('', '[]'))"""
_FILE_ROWS = [
    "u AS (SELECT conversation_uuid, uuid, sender, created, substring(created_at, 1, 10) AS date, unnest(xs).file_name AS file_name FROM att)",
    "f AS (SELECT * FROM u WHERE file_name IS NOT NULL QUALIFY row_number() OVER (PARTITION BY conversation_uuid, file_name ORDER BY created NULLS FIRST, uuid) = 1)",
]
_FILES = (
    "SELECT conversation_uuid, file_name, CASE WHEN sender = 'assistant' THEN 'generated' WHEN lower(string_split(file_name, '.')[-1]) IN ('pdf', 'doc', 'docx', 'txt', 'md', 'xlsx', 'csv', 'json', 'xml') THEN 'sources' ELSE 'photos' END AS category,"
    " CASE WHEN lower(file_name) LIKE 'page\\_%' ESCAPE '\\' THEN 'v01' WHEN lower(file_name) LIKE 'v2\\_%' ESCAPE '\\' THEN 'v02' WHEN lower(file_name) LIKE 'v3\\_%' ESCAPE '\\' THEN 'v03' WHEN lower(file_name) LIKE 'v4\\_%' ESCAPE '\\' THEN 'v04' ELSE 'v05-latest' END AS folder,"
    " date, row_number() OVER (PARTITION BY conversation_uuid, date ORDER BY created NULLS FIRST, uuid, file_name) AS sequence FROM f"
)
def snippet_rows(t):
    """A row for each snippet of grouped hits, numbered from 0."""
    t = t.withColumnRenamed("created_at", "conversation_created_at").select("*", F.posexplode("top_snippets").alias("place", "snippet")).drop("top_snippets")
    return t.select("*", "snippet.sender", "snippet.text", "snippet.created_at").drop("snippet")


def _snippets(hits: str, order: str) -> str:
    """Rows of h (conversation_uuid, hit, sender, text, created_at, ...) as snippet_rows() gives them."""
    return f"""h AS ({hits}), top AS (SELECT h.*, row_number() OVER (PARTITION BY conversation_uuid ORDER BY {order}) AS r, count(*) OVER (PARTITION BY conversation_uuid) AS n FROM h)
SELECT top.conversation_uuid, c.name, c.project_uuid, p.name AS project_name, c.created_at AS conversation_created_at, top.n AS hit_count, (top.r - 1)::INT AS place, top.sender, top.text, top.created_at
FROM top JOIN c ON c.uuid = top.conversation_uuid LEFT JOIN p ON p.uuid = c.project_uuid WHERE r <= 3"""


def _with(*parts: str) -> str:
    return "WITH " + ", ".join([CANON, *parts]) + "\n"


SQL = {
    "conversation_stats": _with(
        "v AS (SELECT (SELECT count(*) FROM c) AS conversations, (SELECT count(*) FROM c WHERE " + _BLANK.format("name") + ") AS untitled, (SELECT count(*) FROM c WHERE NOT " + _BLANK.format("project_uuid") + ") AS with_project, (SELECT count(*) FROM m) AS messages,"
        " (SELECT count(*) FROM m WHERE sender = 'human') AS human_messages, (SELECT count(*) FROM m WHERE sender = 'assistant') AS assistant_messages, (SELECT count(*) FROM b) AS content_blocks, (SELECT count(*) FROM b WHERE block_type = 'thinking') AS thinking_blocks,"
        " (SELECT count(*) FROM e) AS entities, (SELECT count(*) FROM c WHERE uuid NOT IN (SELECT conversation_uuid FROM messages WHERE conversation_uuid IS NOT NULL)) AS empty)",
        "w AS (SELECT *, round(messages / nullif(conversations, 0), 1) AS messages_per_conversation, round(thinking_blocks / nullif(assistant_messages, 0), 2) AS thinking_per_assistant FROM v)",
        "x AS (SELECT COLUMNS(*)::DOUBLE FROM w)",
    )
    + "SELECT metric, value FROM (UNPIVOT x ON COLUMNS(*) INTO NAME metric VALUE value)",
    "audit_counts": _with("x AS (SELECT count(*) AS total, count(*) FILTER (WHERE " + _BLANK.format("name") + ") AS untitled, count(*) FILTER (WHERE uuid NOT IN (SELECT conversation_uuid FROM messages WHERE conversation_uuid IS NOT NULL)) AS empty FROM c)")
    + "SELECT *, round(100 * untitled / nullif(total, 0), 1) AS untitled_percent, round(100 * empty / nullif(total, 0), 1) AS empty_percent FROM x",
    "untitled_conversations": _with() + f"SELECT uuid, created_at, updated_at, (SELECT count(*) FROM m WHERE m.conversation_uuid = c.uuid) AS message_count FROM c WHERE {_BLANK.format('name')}",
    "empty_conversations": _with() + "SELECT uuid, name, created_at, updated_at FROM c WHERE NOT EXISTS (SELECT 1 FROM messages x WHERE x.conversation_uuid = c.uuid)",
    "title_search": _with() + "SELECT uuid, name, created_at, updated_at FROM c WHERE contains(lower(name), 'api') AND created BETWEEN '2024-06-01T00:00:00Z'::TIMESTAMPTZ AND '2026-06-01T00:00:00Z'::TIMESTAMPTZ",
    "edit_history": _with() + "SELECT uuid AS message_uuid, uuid AS version_uuid, created_at FROM m UNION ALL SELECT x.uuid, y.uuid, y.created_at FROM m x JOIN m y ON y.parent_message_uuid = x.uuid AND x.uuid <> y.uuid",
    "message_siblings": _with() + "SELECT uuid AS message_uuid, count(*) OVER (PARTITION BY parent_message_uuid) AS n_siblings FROM m WHERE parent_message_uuid IS NOT NULL",
    "first_messages": _with() + r"SELECT conversation_uuid, place::INT AS place, uuid, sender, substring(trim(regexp_replace(text, '[\s\p{Z}]+', ' ', 'g')), 1, 280) AS text FROM (SELECT *, row_number() OVER (PARTITION BY conversation_uuid ORDER BY created NULLS FIRST, uuid) AS place FROM m) WHERE place <= 60",
    "topic_scan": _with("x AS (SELECT unnest([" + ", ".join(f"'{t}'" for t in ent.TOPICS) + "]) AS topic)") + "SELECT topic, count(m.uuid) AS n_messages FROM x LEFT JOIN m ON contains(translate(m.text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), topic) GROUP BY 1",
    "attachment_search": _with("x AS (SELECT *, row_number() OVER (PARTITION BY conversation_uuid ORDER BY created NULLS FIRST, uuid) AS r FROM m WHERE attachments NOT IN ('', '[]') AND contains(lower(attachments), 'session'))") + "SELECT uuid, conversation_uuid, created_at FROM x WHERE r <= 3",
    "attachments": _with(_ATT, "u AS (SELECT uuid, unnest(range(len(xs))) AS i, unnest(xs) AS x FROM att)") + "SELECT uuid AS message_uuid, i + 1 AS place, x.file_name, x.file_type, x.file_size, substring(x.extracted_content, 1, 2000) AS content FROM u WHERE x.extracted_content <> ''",
    "artifacts": _with() + "SELECT id, message_uuid, coalesce(nullif(tool_input ->> '$.title', ''), 'Untitled') AS title, substring(tool_input ->> '$.content', 1, 3000) AS content FROM b WHERE block_type = 'tool_use' AND tool_name = 'artifacts' AND json_valid(tool_input) AND tool_input ->> '$.command' = 'create' AND tool_input ->> '$.content' <> ''",
    "file_manifest": _with(_ATT, *_FILE_ROWS)
    + _FILES,
    "manifest_counts": _with(_ATT, *_FILE_ROWS, f"x AS ({_FILES})") + "SELECT category, folder, count(*) AS n_files FROM x GROUP BY 1, 2",
    "random_sample": _with() + "SELECT uuid, conversation_uuid, sender, text FROM m ORDER BY md5(uuid || '7'), uuid LIMIT 100",
    "profile_worklist": _with() + "SELECT uuid FROM c WHERE uuid >= '8'",
    "search_tool": _with() + "SELECT b.id, b.message_uuid, b.conversation_uuid, c.name, b.block_type FROM b JOIN c ON c.uuid = b.conversation_uuid WHERE tool_name = 'bash' AND block_type IN ('tool_use', 'tool_result') AND message_uuid IN (SELECT uuid FROM m)",
    "search_tool_grouped": _with(_snippets("SELECT b.conversation_uuid, b.id AS hit, m.created, m.sender, m.created_at, substring(b.text_content, 1, 200) AS text FROM b JOIN c ON c.uuid = b.conversation_uuid JOIN m ON m.uuid = b.message_uuid WHERE tool_name = 'bash' AND block_type IN ('tool_use', 'tool_result')", "created DESC NULLS LAST, hit")).rstrip(),
    "search_by_entity": _with() + "SELECT e.entity, e.type, e.message_uuid, e.conversation_uuid, c.name, m.sender, m.created_at FROM e JOIN m ON m.uuid = e.message_uuid JOIN c ON c.uuid = e.conversation_uuid WHERE entity = 'api' AND type = 'topic'",
    "search_by_entity_grouped": _with(_snippets("SELECT e.conversation_uuid, e.message_uuid AS hit, m.created, m.sender, m.created_at, substring(m.text, 1, 200) AS text FROM e JOIN m ON m.uuid = e.message_uuid JOIN c ON c.uuid = e.conversation_uuid WHERE entity = 'api' AND type = 'topic'", "created DESC NULLS LAST, hit")).rstrip(),
    "monthly_activity": _with() + "SELECT strftime(created AT TIME ZONE 'UTC', '%Y-%m') AS month, count(*) AS n_messages FROM m WHERE created IS NOT NULL GROUP BY 1",
    "top_conversations": _with() + "SELECT c.uuid, c.name, count(*) AS n_messages FROM m JOIN c ON c.uuid = m.conversation_uuid GROUP BY 1, 2 ORDER BY n_messages DESC, c.uuid LIMIT 10",
    "top_tools": _with() + "SELECT tool_name, count(*) AS n_calls FROM b WHERE block_type = 'tool_use' AND tool_name <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "date_range": _with() + "SELECT epoch_ms(min(created)) AS first_ms, epoch_ms(max(created)) AS last_ms FROM m",
    "blocks_by_type": _with() + "SELECT block_type, count(*) AS n_blocks FROM b GROUP BY 1",
    "entities_by_type": _with() + "SELECT type, count(*) AS n_entities FROM e GROUP BY 1",
    "structural_metrics": _with(_STRUCTURE) + "SELECT * FROM structure",
    "project_list": _with() + "SELECT p.uuid, p.name, (SELECT count(*) FROM c WHERE c.project_uuid = p.uuid) AS n_conversations FROM p",
    "conversation_urls": _with() + "SELECT uuid, CASE WHEN starts_with(uuid, 'session_') THEN 'https://example.org/code/' ELSE 'https://example.org/chat/' END || uuid AS url FROM c",
    "entity_extract": _with(
        _TEXTS,
        "f AS (" + " UNION ALL ".join(f"SELECT message_uuid, conversation_uuid, '{k}' AS type, unnest(regexp_extract_all(text, '{re2(p, False)}')) AS entity FROM t" for k, p in ENTITIES) + " UNION ALL SELECT message_uuid, conversation_uuid, 'tool', tool_name FROM b WHERE block_type = 'tool_use' AND tool_name IS NOT NULL)",
    )
    + "SELECT lower(entity) AS entity, type, message_uuid, min(conversation_uuid) AS conversation_uuid FROM f GROUP BY 1, 2, 3",
    "profiles": _with(_PROFILES) + "SELECT * FROM profiles",
    "profile_by_sender": _with(_TEXTS, _PER, "s AS (SELECT conversation_uuid, CASE WHEN sender = 'human' THEN 'human' ELSE 'assistant' END AS side, " + ", ".join(f"sum({c})::BIGINT AS {c}" for c in _NAMES) + " FROM per GROUP BY 1, 2)")
    + f"SELECT * FROM (UNPIVOT s ON {', '.join(_NAMES)} INTO NAME category VALUE n) WHERE n > 0",
    "category_details": _with(
        """t AS (SELECT conversation_uuid, 0 AS k, epoch_ms(created) AS t_ms, uuid AS key, text FROM m WHERE text IS NOT NULL
  UNION ALL SELECT conversation_uuid, 1, id, '', text_content FROM b WHERE block_type IN ('text', 'thinking', 'voice_note') AND text_content IS NOT NULL)""",
        "g AS (" + " UNION ALL ".join(f"SELECT conversation_uuid, k, t_ms, key, '{c}' AS category, regexp_extract_all(text, '{re2(p, case)}') AS found FROM t" for c, p, case in CATEGORIES) + ")",
        "f AS (SELECT * EXCLUDE (found), unnest(found) AS match, unnest(range(len(found))) AS pos FROM g)",
        "d AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY conversation_uuid, category, lower(match) ORDER BY k, t_ms NULLS FIRST, key, pos) = 1)",
    )
    + "SELECT conversation_uuid, category, match FROM d QUALIFY row_number() OVER (PARTITION BY conversation_uuid, category ORDER BY k, t_ms NULLS FIRST, key, pos) <= 5",
    "profile_aggregates": _with(_PROFILES, "one AS (SELECT round(avg(technical_density), 3) AS avg_density, round(avg(words), 0) AS avg_words, round(avg(duration_minutes), 1) AS avg_duration, " + ", ".join(f"sum({c})::DOUBLE AS {c}" for c in _NAMES) + " FROM profiles)")
    + "SELECT metric, value FROM (UNPIVOT one ON COLUMNS(*) INTO NAME metric VALUE value) UNION ALL SELECT 'type:' || primary_type, count(*)::DOUBLE FROM profiles GROUP BY primary_type",
    "profile_query": _with(_PROFILES) + "SELECT conversation_uuid, primary_type, technical_density, words FROM profiles WHERE primary_type = 'coding' AND technical_density >= 0.01 ORDER BY technical_density DESC, conversation_uuid LIMIT 20",
}
