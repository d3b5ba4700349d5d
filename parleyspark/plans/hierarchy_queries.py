"""Queries of the hierarchy operator (problem 5), with SQL that runs on the same tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from parleyspark.operators.hierarchy import descendant_counts, descendants, hierarchy
from parleyspark.sources.tables import table


def p5_found(spark, root):
    t = hierarchy(table(spark, root, "messages"))
    return t.select(F.col("id").alias("message_uuid"), F.col("root").alias("root_uuid"), "depth")


def p5_paths(spark, root):
    t = descendant_counts(table(spark, root, "messages"))
    return t.select(F.col("id").alias("message_uuid"), F.col("root").alias("root_uuid"), "depth", "path", "n_descendants")


def p5_descendants(spark, root):
    t = descendants(table(spark, root, "messages"))
    return t.select(F.col("ancestor").alias("ancestor_uuid"), F.col("descendant").alias("descendant_uuid"), "distance")


_NODES = """nodes AS (SELECT uuid AS id, min(parent_message_uuid) AS parent FROM messages WHERE uuid IS NOT NULL GROUP BY uuid),
links AS (SELECT n.id, p.id AS parent FROM nodes n LEFT JOIN nodes p ON n.parent = p.id),
down(id, root, depth, path) AS (
  SELECT id, id, 0::BIGINT, id FROM links WHERE parent IS NULL
  UNION ALL SELECT l.id, d.root, d.depth + 1, d.path || '/' || l.id FROM down d JOIN links l ON l.parent = d.id)"""

QUERIES = {"p5_found": p5_found, "p5_paths": p5_paths, "p5_descendants": p5_descendants}
SQL = {
    "p5_found": f"""WITH RECURSIVE {_NODES}
SELECT n.id AS message_uuid, coalesce(d.root, '') AS root_uuid, coalesce(d.depth, -1)::BIGINT AS depth FROM nodes n LEFT JOIN down d ON n.id = d.id""",
    "p5_paths": f"""WITH RECURSIVE {_NODES}, below AS (SELECT a AS id, count(*) AS n FROM (SELECT unnest(list_slice(string_split(path, '/'), 1, -2)) AS a FROM down WHERE depth > 0) GROUP BY a)
SELECT n.id AS message_uuid, coalesce(d.root, '') AS root_uuid, coalesce(d.depth, -1)::BIGINT AS depth, coalesce(d.path, n.id) AS path, coalesce(b.n, 0)::BIGINT AS n_descendants
FROM nodes n LEFT JOIN down d ON n.id = d.id LEFT JOIN below b ON n.id = b.id""",
    "p5_descendants": f"""WITH RECURSIVE {_NODES}
SELECT string_split(path, '/')[i] AS ancestor_uuid, id AS descendant_uuid, (depth - i + 1)::BIGINT AS distance FROM (SELECT id, path, depth, unnest(range(1, depth + 1)) AS i FROM down WHERE depth > 0)""",
}
