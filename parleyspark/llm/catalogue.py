"""The queries of problems 1, 3, 4 and 6 to 10, and SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import functions as F

from parleyspark.llm import leaks, lookalike, neighbours, packing, pii, terms, threads
from parleyspark.plans.stage import Stage
from parleyspark.sources.tables import table


def p1_found(spark, root):
    both = pii.find_pii(table(spark, root, "messages"), "uuid", "text", "messages").unionByName(pii.find_pii(table(spark, root, "content_blocks"), "id", "text_content", "content_blocks"))
    return both.select("source_table", "row_key", "pii_type", "start_char")


def p1_texts(spark, root):
    m = table(spark, root, "messages").select(F.lit("messages").alias("source_table"), F.col("uuid").alias("row_key"), F.col("text"))
    b = table(spark, root, "content_blocks").select(F.lit("content_blocks").alias("source_table"), F.col("id").cast("string").alias("row_key"), F.col("text_content").alias("text"))
    return m.unionByName(b).withColumn("text", pii.redacted(F.col("text")))


def p3_found(spark, root):
    return threads.rebuild(table(spark, root, "messages"))


def p4_found(spark, root):
    t = neighbours.most_similar(table(spark, root, "conversation_embeddings"))
    return t.select(F.least("uuid", "other").alias("uuid_a"), F.greatest("uuid", "other").alias("uuid_b")).distinct()


def p4_neighbours(spark, root):
    return neighbours.most_similar(table(spark, root, "conversation_embeddings"))


def p6_found(spark, root):
    return terms.pairs(table(spark, root, "entities")).select("entity_a", "entity_b")


def p6_pairs(spark, root):
    t = terms.pairs(table(spark, root, "entities"))
    return t.withColumn("lift", F.round("lift", 6)).withColumn("log_odds", F.round("log_odds", 6))


def p7_found(spark, root):
    return terms.mark_terms(table(spark, root, "entities")).where("mark is not null").select("entity", "type", "mark")


def p7_terms(spark, root):
    return terms.mark_terms(table(spark, root, "entities"))


def p8_packing(spark, root):
    # the sizes are written, so that counting the items doesn't tokenise twice
    return packing.pack(Stage(packing.token_counts(table(spark, root, "documents"))).df)


def p9_found(spark, root):
    found = leaks.leaks(table(spark, root, "documents"), table(spark, root, "eval_items"))
    return found.where(F.col("exact_words") >= leaks.SPAN).select("doc_id", "item_id").distinct()


def p9_overlaps(spark, root):
    found = leaks.leaks(table(spark, root, "documents"), table(spark, root, "eval_items"))
    return found.where((F.col("overlap_words") >= leaks.SPAN) & (F.col("equal_words") >= 0.75 * F.col("overlap_words")))


def p10_found(spark, root):
    return lookalike.look_alike_pairs(table(spark, root, "documents"))


def p10_classes(spark, root):
    return lookalike.look_alike_classes(table(spark, root, "documents"))


def p10_texts(spark, root):
    return lookalike.canonical_rows(table(spark, root, "documents"))


_TERMS = r"""e AS (SELECT lower(regexp_replace(entity, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) AS entity, type, message_uuid FROM entities WHERE message_uuid IS NOT NULL),
t AS (SELECT * FROM e WHERE entity <> ''), total AS (SELECT count(DISTINCT message_uuid) AS n FROM t)"""
_COUNTS = "c AS (SELECT entity, type, count(*) AS n_rows, count(DISTINCT message_uuid) AS n_records FROM t GROUP BY entity, type)"
_MARK = "CASE WHEN n_records < 3 THEN 'rare' WHEN 100 * n_records > 3 * n THEN 'common' END"
_PAIRS = """d AS (SELECT DISTINCT entity, message_uuid FROM t), n1 AS (SELECT entity, count(*) AS n FROM d GROUP BY entity),
ab AS (SELECT a.entity AS entity_a, b.entity AS entity_b, count(*) AS n_ab FROM d a JOIN d b ON a.message_uuid = b.message_uuid AND a.entity < b.entity GROUP BY 1, 2 HAVING count(*) >= 3),
p AS (SELECT ab.*, x.n AS n_a, y.n AS n_b, total.n AS n_all FROM ab JOIN n1 x ON x.entity = entity_a JOIN n1 y ON y.entity = entity_b, total WHERE n_ab * total.n >= 3 * x.n * y.n)"""

_FROM, _TO = "".join(lookalike.CYRILLIC | lookalike.GREEK), "".join((lookalike.CYRILLIC | lookalike.GREEK).values())
_WIDE, _PLAIN = "".join(chr(c) for c in range(0xFF01, 0xFF5F)), "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))
_SMALL_FROM, _SMALL_TO = "".join(map(chr, leaks._SMALL)), "".join(leaks._SMALL.values())
#: The words of a text: look-alike letters as one, small ones as the capitals' twins, whatever can't be seen left out.
_WORD_LIST = f"""list_transform(regexp_extract_all(lower(nfc_normalize(translate(translate(regexp_replace(text, '[\\x{{00AD}}\\x{{200B}}-\\x{{200F}}\\x{{2060}}-\\x{{2064}}\\x{{FEFF}}]', '', 'g'), '{_WIDE.replace("'", "''")}', '{_PLAIN.replace("'", "''")}'), '{_FROM}', '{_TO}'))), '[\\p{{L}}\\p{{N}}\\p{{M}}]+'), lambda x: translate(x, '{_SMALL_FROM}', '{_SMALL_TO}'))"""
#: Composed letters that hold a look-alike, by their consistent form.
_COMPOSED = {c: f for a, b in ((0xC0, 0x250), (0x370, 0x530), (0x1E00, 0x2000)) for c in map(chr, range(a, b)) if len(f := lookalike.canonical(c) or "") == 1 and f != c}
_GONE = "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in lookalike.IGNORABLE + lookalike._CONTROLS)
_FORM = f"""nfc_normalize(translate(nfc_normalize(regexp_replace(regexp_replace(translate(text, '{_WIDE.replace("'", "''")}', '{_PLAIN.replace("'", "''")}'), '[{_GONE}]', '', 'g'), '\\p{{Zs}}', ' ', 'g')), '{"".join(_COMPOSED)}', '{"".join(_COMPOSED.values())}'))"""
_LOOKS = rf"""d AS (SELECT doc_id, text, {_FORM} AS form FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL), g AS (SELECT * FROM d WHERE length(regexp_replace(form, '[\s\p{{Z}}]', '', 'g')) > 0),
forms AS (SELECT form, text, min(doc_id) AS form_id, count(*) AS n FROM g GROUP BY 1, 2), classes AS (SELECT form, min(form_id) AS class_id, count(*) AS n_forms, sum(n)::BIGINT AS n_all FROM forms GROUP BY 1)"""
_WINDOWS = "SELECT {key}, array_to_string(w[i:i + 11], ' ') AS x FROM (SELECT {key}, w, unnest(range(1, len(w) - 10)) AS i FROM (SELECT {key}, {words} AS w FROM {table} WHERE {key} IS NOT NULL))"

QUERIES = {"p1_found": p1_found, "p1_texts": p1_texts, "p3_found": p3_found, "p4_found": p4_found, "p4_neighbours": p4_neighbours, "p6_found": p6_found, "p6_pairs": p6_pairs, "p7_found": p7_found, "p7_terms": p7_terms, "p8_packing": p8_packing, "p9_found": p9_found, "p9_overlaps": p9_overlaps, "p10_found": p10_found, "p10_classes": p10_classes, "p10_texts": p10_texts}
SQL = {
    "p3_found": r"""WITH RECURSIVE m AS (
  SELECT uuid AS id, conversation_uuid AS conv, created_at::TIMESTAMPTZ AS ts, CASE WHEN parent_message_uuid IN ('', '00000000-0000-4000-8000-000000000000') THEN NULL ELSE parent_message_uuid END AS parent,
    CASE lower(regexp_replace(sender, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) WHEN 'human' THEN 'human' WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'assistant' END AS role,
    coalesce(length(regexp_replace(text, '[\s\p{Z}\p{C}]', '', 'g')) > 0, false) AS seen
  FROM messages WHERE uuid IS NOT NULL AND conversation_uuid IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY uuid, conversation_uuid ORDER BY updated_at::TIMESTAMPTZ DESC, loaded_at DESC) = 1),
kinds AS (SELECT conv, bool_or(parent IS NOT NULL) AS linked FROM m GROUP BY conv),
best AS (SELECT conv, parent, id FROM m WHERE parent IS NOT NULL QUALIFY row_number() OVER (PARTITION BY conv, parent ORDER BY ts DESC, id DESC) = 1),
walk(conv, root, id) AS (SELECT conv, id, id FROM m WHERE parent IS NULL UNION SELECT w.conv, w.root, c.id FROM walk w JOIN m c ON c.conv = w.conv AND c.parent = w.id),
bad AS (SELECT DISTINCT m.conv FROM m LEFT JOIN walk w ON m.conv = w.conv AND m.id = w.id WHERE w.id IS NULL),
start AS (SELECT m.conv, m.id FROM m JOIN kinds k USING (conv) WHERE k.linked AND m.parent IS NULL QUALIFY row_number() OVER (PARTITION BY m.conv ORDER BY m.ts DESC, m.id DESC) = 1),
thread(conv, id, turn) AS (SELECT conv, id, 1::BIGINT FROM start WHERE conv NOT IN (SELECT conv FROM bad) UNION ALL SELECT t.conv, b.id, t.turn + 1 FROM thread t JOIN best b ON b.conv = t.conv AND b.parent = t.id),
flat AS (SELECT m.conv, m.id, row_number() OVER (PARTITION BY m.conv ORDER BY m.ts, m.id) AS turn FROM m JOIN kinds k USING (conv) WHERE NOT k.linked),
both_ AS (SELECT t.conv, t.turn, t.id, m.role, m.seen FROM (SELECT * FROM thread UNION ALL SELECT conv, id, turn FROM flat) t JOIN m ON m.conv = t.conv AND m.id = t.id),
judged AS (SELECT *, role IS NULL OR NOT seen OR (turn = 1 AND role IS DISTINCT FROM 'human') OR (role = 'human' AND lead(role) OVER (PARTITION BY conv ORDER BY turn) IS DISTINCT FROM 'assistant') AS wrong FROM both_)
SELECT conv AS conversation_uuid, turn, id AS message_uuid, role FROM judged WHERE conv NOT IN (SELECT conv FROM judged WHERE wrong)""",
    "p6_found": f"WITH {_TERMS}, {_PAIRS} SELECT entity_a, entity_b FROM p",
    "p6_pairs": f"""WITH {_TERMS}, {_PAIRS} SELECT *, round(n_ab * n_all / (n_a * n_b)::DOUBLE, 6) AS lift,
  round(ln((n_ab + 0.5) * (n_all - n_a - n_b + n_ab + 0.5) / ((n_a - n_ab + 0.5) * (n_b - n_ab + 0.5))), 6) AS log_odds FROM p""",
    "p7_found": f"WITH {_TERMS}, {_COUNTS} SELECT entity, type, {_MARK} AS mark FROM c, total WHERE {_MARK} IS NOT NULL",
    "p7_terms": f"WITH {_TERMS}, {_COUNTS} SELECT entity, type, n_rows, n_records, {_MARK} AS mark FROM c, total",
    "p9_found": f"""WITH d AS ({_WINDOWS.format(key="doc_id", words=_WORD_LIST, table="documents")}), e AS ({_WINDOWS.format(key="item_id", words=_WORD_LIST, table="eval_items")})
SELECT DISTINCT doc_id, item_id FROM d JOIN e USING (x)""",
    "p10_found": f"WITH {_LOOKS} SELECT DISTINCT least(doc_id, form_id) AS doc_id_a, greatest(doc_id, form_id) AS doc_id_b FROM g JOIN forms ON forms.form = g.form AND forms.text <> g.text",
    "p10_classes": f"WITH {_LOOKS} SELECT doc_id, class_id, form_id, n_forms, n_all - n AS n_links FROM g JOIN forms USING (form, text) JOIN classes USING (form)",
    "p10_texts": f"SELECT doc_id, {_FORM} AS text, {_FORM} <> text AS changed FROM documents",
}
