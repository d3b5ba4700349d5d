"""Queries of the nested-record operator (problem 2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from parleyspark.operators.nested import NestedTables
from parleyspark.plans.stage import Stage
from parleyspark.sources.tables import table


def p2_found(spark, root):
    t = NestedTables(table(spark, root, "export_records"))
    blocks = t.blocks().select("conversation_uuid", "message_uuid", "block_path", "block_type", "tool_ref", "input_id")
    values = Stage(t.input_values().select("input_id", F.col("path").alias("leaf_path"))).df
    whole = blocks.withColumn("leaf_path", F.lit(""))
    return whole.drop("input_id").unionByName(blocks.join(values, "input_id").drop("input_id")).distinct()


def p2_objects(spark, root):
    t = NestedTables(table(spark, root, "export_records"), all_nodes=True)
    return t.objects().select(F.lower(F.hex("object_id")).alias("object_id"), "kind", "value", "n_occurrences")


def p2_scalars(spark, root):
    """Distinct scalars, each stored once, by kind and value."""
    t = NestedTables(table(spark, root, "export_records"), all_nodes=True)
    return t.objects().where("kind not in ('object', 'array')").select("kind", "value", "n_occurrences")


def p2_tool_links(spark, root):
    return NestedTables(table(spark, root, "export_records")).tool_links()


def p2_conversations(spark, root):
    return NestedTables(table(spark, root, "export_records")).conversations().select("conversation_uuid", "record_id", "n_messages")


def p2_messages(spark, root):
    return NestedTables(table(spark, root, "export_records")).messages().select("conversation_uuid", "message_uuid", "ordinal", "sender")


def p2_input_values(spark, root):
    t = NestedTables(table(spark, root, "export_records"))
    values = Stage(t.input_values()).df
    blocks = t.blocks().select("conversation_uuid", "message_uuid", "block_path", "input_id")
    return blocks.join(values, "input_id").select("conversation_uuid", "message_uuid", "block_path", F.col("path").alias("leaf_path"), "value")


def p2_occurrences(spark, root):
    """The bridge of all occurrences: a node for each value, numbered within its record, with its parent and ordinal."""
    t = NestedTables(table(spark, root, "export_records"), all_nodes=True)
    return t.occurrences().select("record_id", "node", "parent", "member", "ordinal", "kind", "value")


_BLOCKS = """counted AS (SELECT record_id, exported_at, payload::JSON AS j FROM export_records WHERE json_valid(payload) AND json_type(payload) = 'OBJECT'
  AND json_type(payload, '$.uuid') = 'VARCHAR' AND json_extract_string(payload, '$.uuid') <> ''),
last AS (SELECT j ->> '$.uuid' AS conversation_uuid, j FROM counted QUALIFY row_number() OVER (PARTITION BY j ->> '$.uuid' ORDER BY exported_at DESC NULLS LAST, record_id DESC) = 1),
m AS (SELECT conversation_uuid, unnest(json_extract(j, '$.chat_messages[*]')) AS m FROM last WHERE json_type(j, '$.chat_messages') = 'ARRAY'),
mm AS (SELECT conversation_uuid, m ->> '$.uuid' AS message_uuid, json_extract(m, '$.content') AS c FROM m WHERE json_type(m) = 'OBJECT'),
b(conversation_uuid, message_uuid, block_path, b) AS (
  SELECT conversation_uuid, message_uuid, i::VARCHAR, json_extract(c, '$[' || i || ']') FROM (SELECT *, unnest(range(json_array_length(c)::BIGINT)) AS i FROM mm WHERE json_type(c) = 'ARRAY')
  UNION ALL
  SELECT conversation_uuid, message_uuid, block_path || '.' || i, json_extract(c, '$[' || i || ']')
  FROM (SELECT *, json_extract(b, '$.content') AS c, unnest(range(json_array_length(json_extract(b, '$.content'))::BIGINT)) AS i FROM b WHERE json_type(b) = 'OBJECT' AND json_type(b, '$.content') = 'ARRAY')),
blocks AS (
  SELECT conversation_uuid, message_uuid, block_path, coalesce(b ->> '$.type', '') AS block_type, coalesce(nullif(b ->> '$.id', ''), nullif(b ->> '$.tool_use_id', ''), '') AS tool_ref, json_extract(b, '$.input') AS input
  FROM b WHERE json_type(b) = 'OBJECT'
  UNION ALL SELECT conversation_uuid, message_uuid, '0', 'text', '', NULL FROM mm WHERE json_type(c) = 'VARCHAR')"""

_KIND = "CASE type WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END"

QUERIES = {"p2_found": p2_found, "p2_objects": p2_objects, "p2_scalars": p2_scalars, "p2_tool_links": p2_tool_links, "p2_conversations": p2_conversations, "p2_messages": p2_messages, "p2_input_values": p2_input_values, "p2_occurrences": p2_occurrences}
SQL = {
    "p2_found": f"""WITH RECURSIVE {_BLOCKS}
SELECT DISTINCT conversation_uuid, message_uuid, block_path, block_type, tool_ref, '' AS leaf_path FROM blocks
UNION SELECT DISTINCT conversation_uuid, message_uuid, block_path, block_type, tool_ref, replace(t.fullkey, '"', '')
FROM blocks, json_tree(blocks.input) t WHERE blocks.input IS NOT NULL AND t.type NOT IN ('OBJECT', 'ARRAY', 'NULL')""",
    "p2_tool_links": f"""WITH RECURSIVE {_BLOCKS}
SELECT DISTINCT u.conversation_uuid, u.tool_ref, u.message_uuid AS use_message_uuid, u.block_path AS use_path, r.message_uuid AS result_message_uuid, r.block_path AS result_path
FROM (SELECT * FROM blocks WHERE block_type = 'tool_use' AND tool_ref <> '') u
LEFT JOIN (SELECT * FROM blocks WHERE block_type = 'tool_result' AND tool_ref <> '') r ON u.conversation_uuid = r.conversation_uuid AND u.tool_ref = r.tool_ref""",
    "p2_conversations": f"""WITH RECURSIVE {_BLOCKS}, v AS (SELECT *, row_number() OVER (PARTITION BY j ->> '$.uuid' ORDER BY exported_at DESC NULLS LAST, record_id DESC) AS r FROM counted)
SELECT j ->> '$.uuid' AS conversation_uuid, record_id, coalesce((SELECT count(*) FROM m WHERE m.conversation_uuid = v.j ->> '$.uuid' AND json_type(m.m) = 'OBJECT'), 0)::INT AS n_messages FROM v WHERE r = 1""",
    "p2_messages": f"""WITH RECURSIVE {_BLOCKS}, n AS (SELECT conversation_uuid, j, unnest(range(json_array_length(j, '$.chat_messages')::BIGINT)) AS ordinal FROM last WHERE json_type(j, '$.chat_messages') = 'ARRAY'),
o AS (SELECT conversation_uuid, ordinal, json_extract(j, '$.chat_messages[' || ordinal || ']') AS m FROM n)
SELECT conversation_uuid, coalesce(m ->> '$.uuid', '') AS message_uuid, ordinal::INT AS ordinal, m ->> '$.sender' AS sender FROM o WHERE json_type(m) = 'OBJECT'""",
    "p2_input_values": f"""WITH RECURSIVE {_BLOCKS}
SELECT conversation_uuid, message_uuid, block_path, replace(t.fullkey, '"', '') AS leaf_path, t.atom ->> '$' AS value
FROM blocks, json_tree(blocks.input) t WHERE blocks.input IS NOT NULL AND t.type NOT IN ('OBJECT', 'ARRAY', 'NULL')""",
    "p2_scalars": f"""WITH RECURSIVE {_BLOCKS}, t AS (SELECT t.type, t.atom FROM last, json_tree(last.j) t WHERE t.type NOT IN ('OBJECT', 'ARRAY'))
SELECT {_KIND} AS kind, CASE WHEN type = 'NULL' THEN '' ELSE atom ->> '$' END AS value, count(*) AS n_occurrences FROM t GROUP BY 1, 2""",
    "p2_occurrences": f"""WITH RECURSIVE {_BLOCKS}, whole AS (SELECT record_id, j FROM counted QUALIFY row_number() OVER (PARTITION BY j ->> '$.uuid' ORDER BY exported_at DESC NULLS LAST, record_id DESC) = 1),
t AS (SELECT record_id, t.id, t.parent AS above, t.key, t.type, t.atom, row_number() OVER (PARTITION BY record_id ORDER BY t.id) - 1 AS node FROM whole, json_tree(whole.j) t)
SELECT t.record_id, t.node::INT AS node, coalesce(u.node, -1)::INT AS parent, CASE WHEN u.type = 'OBJECT' THEN t.key END AS member,
  CASE WHEN u.node IS NULL THEN 0 ELSE row_number() OVER (PARTITION BY t.record_id, t.above ORDER BY t.id) - 1 END::INT AS ordinal, {_KIND.replace("type", "t.type", 1)} AS kind,
  CASE WHEN t.type IN ('OBJECT', 'ARRAY') THEN NULL WHEN t.type = 'NULL' THEN '' ELSE t.atom ->> '$' END AS value
FROM t LEFT JOIN t u ON u.record_id = t.record_id AND u.id = t.above""",
}
