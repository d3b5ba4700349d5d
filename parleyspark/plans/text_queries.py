"""Queries of the branch and title operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from parleyspark.functions import text
from parleyspark.functions.patterns import BOILERPLATE, re2
from parleyspark.operators import branches as br
from parleyspark.operators import titles
from parleyspark.plans.archive_queries import _q, _with

QUERIES = {
    "main_branch": _q(br.main_branch),
    "flattened": _q(br.flattened),
    "branches": _q(br.branches),
    "thread_messages": _q(br.thread_messages),
    "branch_points": _q(br.branch_points),
    "linear_thread": _q(br.linear_thread),
    "extract_title": _q(lambda a: a.messages.select("uuid", text.extract_title(F.col("text"), True).alias("title"), text.extract_title(F.col("text")).alias("plain_title"))),
    "generate_titles": _q(titles.generate_titles),
    "rename_untitled": _q(titles.rename_untitled),
    "slugify": _q(lambda a: a.conversations.select("uuid", text.slugify(F.col("name")).alias("slug"), text.descriptor(F.col("name")).alias("descriptor"))),
    "url_templates": _q(lambda a: a.entities.where("type = 'url'").groupBy(text.url_template(F.col("entity")).alias("template")).agg(F.count("*").alias("n_urls"))),
}

_N = """n AS (SELECT conversation_uuid AS conv, uuid AS id, created, sender, CASE WHEN parent_message_uuid IN ('', '00000000-0000-4000-8000-000000000000') THEN NULL ELSE parent_message_uuid END AS parent,
  parent_message_uuid IS NULL OR parent_message_uuid IN ('', '00000000-0000-4000-8000-000000000000') AS start FROM m WHERE conversation_uuid IS NOT NULL),
best AS (SELECT conv, parent, id FROM n WHERE parent IS NOT NULL QUALIFY row_number() OVER (PARTITION BY conv, parent ORDER BY created DESC NULLS LAST, id DESC) = 1)"""
_ROOT = "root AS (SELECT conv, id FROM n WHERE start QUALIFY row_number() OVER (PARTITION BY conv ORDER BY created {} , id {}) = 1)"
_MAIN = "main(conv, id, place) AS (SELECT conv, id, 1::BIGINT FROM root UNION ALL SELECT m.conv, b.id, m.place + 1 FROM main m JOIN best b ON b.conv = m.conv AND b.parent = m.id)"
_CHRON = "SELECT conv AS conversation_uuid, row_number() OVER (PARTITION BY conv ORDER BY created NULLS FIRST, id) AS place, id AS message_uuid FROM n"
_LAST, _FIRST = _ROOT.format("DESC NULLS LAST", "DESC"), _ROOT.format("NULLS FIRST", "")
_PATHS = """sib AS (SELECT conv, parent, id, row_number() OVER w - 1 AS sibling, lead(id) OVER w IS NULL AS last FROM n WHERE parent IS NOT NULL WINDOW w AS (PARTITION BY conv, parent ORDER BY created NULLS FIRST, id)),
walk(conv, id, path, devs) AS (SELECT conv, id, [id], []::STRUCT(d BIGINT, s BIGINT)[] FROM root
  UNION ALL SELECT w.conv, s.id, list_append(w.path, s.id), CASE WHEN s.last THEN w.devs ELSE list_append(w.devs, {'d': len(w.path), 's': s.sibling}) END FROM walk w JOIN sib s ON s.conv = w.conv AND s.parent = w.id),
leaf AS (SELECT w.*, n.created, row_number() OVER (PARTITION BY w.conv ORDER BY len(devs), devs, w.id) - 1 AS thread_index, CASE WHEN len(devs) > 0 THEN devs[-1].d ELSE 0 END AS fork FROM walk w JOIN n ON n.id = w.id WHERE w.id NOT IN (SELECT parent FROM walk v JOIN sib ON sib.id = v.id))"""


def _rec(*parts: str) -> str:
    return _with(*parts).replace("WITH ", "WITH RECURSIVE ", 1)


def _title(col: str, skip: bool) -> str:
    c = col
    for p, to in text.CLEANING:
        to = to.replace("$1", "\\1")
        c = f"regexp_replace({c}, '{re2(p)}', '{to}', 'g')"
    bad = f"AND NOT regexp_matches(s, '{re2(BOILERPLATE)}')" if skip else ""
    parts = f"list_filter(list_transform(regexp_split_to_array(trim({c}, ' '), '[.!?\\n]+'), lambda s: trim(s, ' ')), lambda s: s <> '')"
    return f"""(SELECT CASE WHEN length(chosen) >= 5 THEN upper(substring(t, 1, 1)) || substring(t, 2) END FROM (SELECT chosen, CASE WHEN length(chosen) > 80 THEN
      (CASE WHEN length(regexp_extract(substring(chosen, 1, 80), '(?s)^(.*) [^ ]*$', 1)) > 40 THEN regexp_extract(substring(chosen, 1, 80), '(?s)^(.*) [^ ]*$', 1) ELSE substring(chosen, 1, 80) END) || '…' ELSE chosen END AS t
      FROM (SELECT coalesce(list_filter(ss, lambda s: length(s) >= 5 {bad})[1], list_filter(ss, lambda s: length(s) = list_max(list_transform(ss, lambda y: length(y))))[1]) AS chosen FROM (SELECT {parts} AS ss))))"""


_FIRSTS = "f AS (SELECT conversation_uuid AS uuid, sender, text FROM m WHERE sender IN ('human', 'assistant') QUALIFY row_number() OVER (PARTITION BY conversation_uuid, sender ORDER BY created NULLS FIRST, uuid) = 1)"
_TITLES = (
    f"{_FIRSTS}, t1 AS (SELECT uuid, {_title('text', True)} AS t FROM f WHERE sender = 'assistant'), t3 AS (SELECT uuid, {_title('text', False)} AS t FROM f WHERE sender = 'human'),\n"
    r"tc AS (SELECT conversation_uuid AS uuid, entity, count(*) AS n FROM e WHERE type = 'topic' GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY conversation_uuid ORDER BY count(*) DESC, entity) <= 3)," + "\n"
    r"t2 AS (SELECT uuid, string_agg(array_to_string(list_transform(regexp_split_to_array(entity, '[\s_-]+'), lambda w: upper(substring(w, 1, 1)) || lower(substring(w, 2))), ' '), ', ' ORDER BY n DESC, entity) AS t FROM tc GROUP BY 1)," + "\n"
    "g AS (SELECT c.uuid, coalesce(CASE WHEN length(t1.t) >= 10 THEN t1.t END, CASE WHEN length(t2.t) >= 3 THEN t2.t END, CASE WHEN length(t3.t) >= 5 THEN t3.t END) AS title,\n"
    "  CASE WHEN length(t1.t) >= 10 THEN 'assistant' WHEN length(t2.t) >= 3 THEN 'entities' WHEN length(t3.t) >= 5 THEN 'human' END AS source\n"
    "  FROM c LEFT JOIN t1 USING (uuid) LEFT JOIN t2 USING (uuid) LEFT JOIN t3 USING (uuid) WHERE c.name IS NULL OR c.name = '')"
)

SQL = {
    "main_branch": _rec(_N, _LAST, _MAIN) + f"SELECT conv AS conversation_uuid, place, id AS message_uuid FROM main UNION ALL {_CHRON} WHERE conv NOT IN (SELECT conv FROM root)",
    "flattened": _rec(_N, _FIRST, _MAIN, "ok AS (SELECT conv FROM (SELECT conv, count(*) AS k FROM main GROUP BY 1) JOIN (SELECT conv, count(*) AS a FROM n GROUP BY 1) USING (conv) WHERE a <= 1 OR 2 * k >= a)")
    + f"SELECT conv AS conversation_uuid, place, id AS message_uuid FROM main WHERE conv IN (SELECT conv FROM ok) UNION ALL {_CHRON} WHERE conv NOT IN (SELECT conv FROM ok)",
    "branches": _rec(_N, _LAST, _PATHS)
    + "SELECT leaf.conv AS conversation_uuid, thread_index, len(path)::BIGINT AS message_count, fork::BIGINT AS fork_depth, CASE WHEN fork > 0 THEN path[fork] END AS fork_point, epoch_ms(leaf.created) AS last_message_ms, d.sender AS first_sender FROM leaf JOIN n d ON d.id = path[fork + 1]",
    "thread_messages": _rec(_N, _LAST, _PATHS, "x AS (SELECT conv, thread_index, fork, unnest(path) AS id, unnest(range(len(path))) AS i FROM leaf)") + "SELECT conv AS conversation_uuid, thread_index, i::BIGINT AS place, id AS message_uuid, i < fork AS is_shared FROM x",
    "branch_points": _with("x AS (SELECT conversation_uuid, coalesce(nullif(parent_message_uuid, ''), '__root__') AS p, count(*) AS n FROM m WHERE conversation_uuid IS NOT NULL GROUP BY 1, 2)") + "SELECT conversation_uuid, count(*) FILTER (WHERE n > 1) AS branch_points FROM x GROUP BY 1",
    "linear_thread": _with() + "SELECT uuid AS message_uuid, lag(uuid) OVER (PARTITION BY conversation_uuid ORDER BY created NULLS FIRST, uuid) AS previous_uuid FROM m",
    "extract_title": _with() + f"SELECT uuid, {_title('text', True)} AS title, {_title('text', False)} AS plain_title FROM m",
    "generate_titles": _with(_TITLES) + "SELECT uuid, title, source FROM g WHERE title IS NOT NULL",
    "rename_untitled": _with(_TITLES) + "SELECT c.uuid, coalesce(g.title, c.name) AS name, g.title IS NOT NULL AS renamed FROM c LEFT JOIN g USING (uuid)",
    "slugify": _with() + "SELECT uuid, substring(regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 40) AS slug, array_to_string(regexp_split_to_array(trim(regexp_replace(lower(name), '[^a-z0-9 ]+', ' ', 'g')), ' +')[1:3], '-') AS descriptor FROM c",
    "url_templates": _with(
        r"u AS (SELECT entity, regexp_extract(entity, '^(https?://[^/?#]+)', 1) AS o, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_extract(entity, '^https?://[^/?#]+([^?#]*)', 1), '/session_[A-Za-z0-9]{20,}', '/{session_id}', 'g'), '(?i)/[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}', '/{uuid}', 'g'), '/[A-Z0-9]{20,}', '/{ulid}', 'g'), '/[0-9]{6,}', '/{n}', 'g') AS q FROM e WHERE type = 'url')"
    )
    + "SELECT CASE WHEN o = '' THEN entity ELSE o || CASE WHEN q = '' THEN '/' ELSE q END END AS template, count(*) AS n_urls FROM u GROUP BY 1",
}
