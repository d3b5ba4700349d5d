"""The stream of session logs loses nothing that comes late."""

import json

from parleyspark.streaming.ingest import import_stream


def line(u, at, kind="user", content="hello"):
    return json.dumps({"uuid": u, "type": kind, "timestamp": at, "message": {"content": content}})


def test_late_logs_and_all_tables(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    (src / "again").mkdir(parents=True)

    def run():
        import_stream(spark, str(src), out, str(tmp_path / "cp")).awaitTermination(120)
        read = lambda t: spark.read.parquet(out + t)
        return {(r[0], r[1]) for r in read("").select("conversation_uuid", "uuid").collect()}, {r["uuid"]: r for r in read("_conversations").collect()}, read("_content_blocks").count()

    (src / "new.jsonl").write_text("\n".join([line("n1", "2025-06-01T00:00:00Z", content="New session"), line("n1", "2025-06-01T00:00:00Z", content="New session"), line("n2", "2025-06-01T00:01:00Z", "assistant", [{"type": "text", "text": "x"}, {"type": "text", "text": "y"}])]))
    m, c, blocks = run()
    assert m == {("new", "n1"), ("new", "n2")} and blocks == 3 and c["new"]["name"] == "New session"
    # months older than what came before, a repeat, and a later and an earlier piece of a session
    (src / "old.jsonl").write_text(line("o1", "2025-01-01T00:00:00Z", content="Old session"))
    (src / "again" / "new.jsonl").write_text("\n".join([line("n0", "2025-05-31T00:00:00Z", content="Before"), line("n1", "2025-06-01T00:00:00Z", content="New session")]))
    m, c, blocks = run()
    assert m == {("new", "n0"), ("new", "n1"), ("new", "n2"), ("old", "o1")} and blocks == 5
    assert spark.read.parquet(out).count() == 4 and spark.read.parquet(out + "_conversations").count() == 2
    assert c["old"]["name"] == "Old session" and c["new"]["name"] == "Before" and c["new"]["updated_at"] == "2025-06-01T00:01:00Z"
