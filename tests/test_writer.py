import glob
import os

import pytest
from pyspark.sql import functions as F

from parleyspark.operators import relational as rel
from parleyspark.operators import upsert
from parleyspark.operators.entities import profiles, update_profiles
from parleyspark.sources import writer
from parleyspark.sources.archive import Archive

CONV = "uuid string, name string, summary string, created_at string, updated_at string, account_uuid string, project_uuid string"
MSG = "uuid string, conversation_uuid string, sender string, text string, created_at string, updated_at string, parent_message_uuid string, attachments string, files string, loaded_at timestamp"
BLOCK = "id bigint, message_uuid string, conversation_uuid string, block_index int, block_type string, text_content string, tool_name string, tool_use_id string, tool_input string, is_error int, meta string"
DAY = "2025-01-0{}T00:00:00Z"
ATT = '[{"file_name": "a.txt", "extracted_content": "line one\\nline two"}]'
FILES = '[{"file_uuid": "f1", "file_name": "v2_x.png", "created_at": "2025-01-02T10:00:00Z"}, {"file_uuid": "f2", "file_name": "y.pdf", "created_at": "2025-01-02T10:00:00Z"}, {"file_uuid": ""}]'


def tables(spark, name="one", day=1, blocks=2):
    c = spark.createDataFrame([("c1", name, None, DAY.format(1), DAY.format(day), None, None), ("c1", "stale", None, DAY.format(1), "2024-01-01T00:00:00Z", None, None), ("c2", None, None, DAY.format(2), DAY.format(2), None, None), (None, "x", None, None, None, None, None)], CONV)
    m = spark.createDataFrame([("m1", "c1", "human", f"text of {name}", DAY.format(1), DAY.format(day), None, ATT, FILES, None), ("m2", "c1", "assistant", "function x() {}", DAY.format(2), DAY.format(day), "m1", "[]", FILES, None)], MSG)
    b = spark.createDataFrame([(i, "m2", "c1", i, "text", f"{name} {i}", None, None, None, None, None) for i in range(blocks)] + [(90, "m1", "c1", 0, "tool_use", None, "artifacts", "t", '{"command": "create", "title": "T", "content": "made"}', None, None)], BLOCK)
    e = spark.createDataFrame([("api", "topic", "m1", "c1")], "entity string, type string, message_uuid string, conversation_uuid string")
    return {"conversations": c, "messages": m, "content_blocks": b, "entities": e}


def test_store_and_store_again(spark, tmp_path):
    root = str(tmp_path / "archive")
    writer.store(spark, tables(spark), root)
    a = Archive(spark, root)
    assert {(r["uuid"], r["name"]) for r in a.raw("archive_conversations").collect()} == {("c1", "one"), ("c2", None)}
    writer.store(spark, tables(spark, "two", 3, 1), root)
    a = Archive(spark, root)
    assert {(r["uuid"], r["name"]) for r in a.raw("archive_conversations").collect()} == {("c1", "two"), ("c2", None)}
    assert {(r["uuid"], r["text"]) for r in a.raw("messages").collect()} == {("m1", "text of two"), ("m2", "function x() {}")}
    # the blocks of a message are replaced as a whole
    assert {(r["message_uuid"], r["block_index"], r["text_content"]) for r in a.raw("content_blocks").collect()} == {("m2", 0, "two 0"), ("m1", 0, None)}
    assert a.raw("entities").count() == 1
    assert not a.has("projects") and sorted(os.listdir(root)) == ["archive_conversations.parquet", "content_blocks.parquet", "entities.parquet", "messages.parquet"]
    # without a table of projects grouped search still gives a row
    (r,) = rel.search_entity_grouped(a, "api").collect()
    assert r["conversation_uuid"] == "c1" and r["hit_count"] == 1 and r["project_name"] is None and r["top_snippets"][0]["text"] == "text of two"


def test_a_failed_import_changes_nothing(spark, tmp_path):
    root = str(tmp_path / "archive")
    writer.store(spark, tables(spark), root)
    bad = tables(spark, "two")
    bad["messages"] = bad["messages"].withColumn("text", F.raise_error(F.lit("broken")).cast("string"))
    with pytest.raises(Exception, match="broken"):
        writer.store(spark, bad, root)
    assert {r["name"] for r in Archive(spark, root).raw("archive_conversations").collect()} == {"one", None}
    assert all(x.endswith(".parquet") for x in os.listdir(root))


def test_files_and_dumps(spark, tmp_path):
    root = str(tmp_path / "archive")
    writer.store(spark, tables(spark), root)
    a = Archive(spark, root)
    got = {(r["file_uuid"], r["file_name"], r["category"], r["folder"], r["date"], r["sequence"]) for r in rel.conversation_files(a).collect()}
    assert got == {("f1", "v2_x.png", "photos", "v02", "2025-01-02", 1), ("f2", "y.pdf", "sources", "v05-latest", "2025-01-02", 2)}
    writer.dump_attachments(a, str(tmp_path / "att"))
    (f,) = glob.glob(str(tmp_path / "att/conversation_uuid=c1/message_uuid=m1/place=1/*.txt"))
    assert open(f).read() == "line one\nline two\n"
    writer.dump_artifacts(a, str(tmp_path / "art"))
    assert [open(f).read() for f in glob.glob(str(tmp_path / "art/message_uuid=m1/id=90/*.txt"))] == ["made\n"]


def test_profiles_by_mode_and_deletion(spark, tmp_path):
    root = str(tmp_path / "archive")
    writer.store(spark, tables(spark), root)
    a = Archive(spark, root)
    whole = profiles(a, rel.structure(a))
    rows = lambda t: sorted(map(tuple, t.collect()), key=str)
    old = whole.withColumn("words", F.lit(-1).cast("bigint"))
    assert rows(update_profiles(a, rel.structure)) == rows(update_profiles(a, rel.structure, old, rebuild=True)) == rows(update_profiles(a, rel.structure, whole.where("false"))) == rows(whole)
    assert rows(update_profiles(a, rel.structure, old)) == rows(old)
    assert rows(update_profiles(a, rel.structure, old, uuids=["c1"])) == rows(whole)
    assert [r["uuid"] for r in upsert.delete_empty(a).collect()] == ["c2"]
    assert [r["uuid"] for r in upsert.delete_empty(a, dry_run=False)["conversations"].collect()] == ["c1"]
