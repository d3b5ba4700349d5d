import json

import pytest
from pyspark.sql import functions as F

from parleyspark.operators import upsert
from parleyspark.operators.cluster import label_propagation, silhouette
from parleyspark.operators.graph import hop_distances
from parleyspark.sources import exports
from parleyspark.streaming.ingest import import_stream, weekly_mentions


def test_export_files(spark, tmp_path):
    convs = [{"uuid": "c1", "name": "A", "chat_messages": [{"uuid": "m1", "sender": "human", "text": "", "content": [{"type": "text", "text": "", "thinking": "t"}, {"type": "tool_use", "name": "x", "id": "u", "input": {"k": [1]}}, {"type": "tool_result", "tool_use_id": "u", "is_error": True}], "attachments": [{"a": 1}]}, {"uuid": "m2", "content": "plain"}]}, {"uuid": "c2"}, None]
    (tmp_path / "a.json").write_text(json.dumps(convs))
    (tmp_path / "bad.json").write_text("{")
    t = exports.read_export(spark, str(tmp_path))
    assert sorted(r["uuid"] for r in t["conversations"].collect()) == ["c1", "c2"]
    assert {(r["uuid"], r["text"], r["attachments"]) for r in t["messages"].collect()} == {("m1", None, '[{"a":1}]'), ("m2", None, "[]")}
    b = {r["block_index"]: r for r in t["content_blocks"].collect()}
    assert b[0]["text_content"] == "t" and b[1]["tool_input"] == '{"k":[1]}' and b[1]["tool_use_id"] == "u" and b[2]["is_error"] == 1 and len(b) == 3


LINES = ["", "{broken", json.dumps({"type": "summary"}), json.dumps({"type": "user", "uuid": "1", "timestamp": "2025-01-01T00:00:00Z", "cwd": "/w", "message": {"role": "user", "content": "First line\nmore"}}),
         json.dumps({"type": "assistant", "uuid": "2", "parentUuid": "1", "timestamp": "2025-01-01T00:01:00Z", "message": {"content": [{"type": "text", "text": " a "}, {"type": "tool_use", "name": "bash", "id": "t"}, {"type": "text", "text": "b"}]}})]


def test_session_logs(spark, tmp_path):
    (tmp_path / "abcdefghij.jsonl").write_text("\n".join(LINES))
    e = exports.read_sessions(spark, str(tmp_path))
    t = exports.session_tables(e)
    c = t["conversations"].first()
    assert (c["uuid"], c["name"], c["summary"], c["updated_at"]) == ("abcdefghij", "First line", "/w", "2025-01-01T00:01:00Z")
    assert {(r["uuid"], r["sender"], r["text"], r["parent_message_uuid"]) for r in t["messages"].collect()} == {("1", "human", "First line\nmore", None), ("2", "assistant", "a\n\nb", "1")}
    assert t["content_blocks"].count() == 4
    assert {(r["kind"], r["value"], r["n"]) for r in exports.readout(e).collect()} == {("type", "user", 1), ("type", "assistant", 1), ("tool", "bash", 1)}
    assert exports.import_new(t["conversations"], t)["messages"].count() == 0 and exports.import_new(t["conversations"], t, True)["messages"].count() == 2


def test_dump(spark, tmp_path):
    events = [{"type": "user", "uuid": "a", "message": {"role": "user", "content": "hi"}}, {"type": "system"}, {"type": "assistant", "uuid": "b", "message": {"role": "assistant", "content": [{"type": "thinking", "thinking": "t"}, {"type": "tool_use", "name": "x"}, {"type": "tool_result", "content": [{"text": "y"}, {"text": "z"}]}]}}]
    (tmp_path / "d.json").write_text(json.dumps({"meta": {"id": "s"}, "events": {"data": events}}))
    m, skipped = exports.read_dump(spark, str(tmp_path))
    got = {r["uuid"]: (r["text"], r["parent_message_uuid"]) for r in m.collect()}
    assert got == {"a": ("hi", None), "b": ("t\n\n[tool_use:x]\n\n[tool_result] y\nz", "a")}
    assert [tuple(r) for r in skipped.collect()] == [("system", 1)]


def test_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "s1.jsonl").write_text("\n".join(LINES))
    for _ in range(2):
        import_stream(spark, str(src), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
        assert spark.read.parquet(str(tmp_path / "out")).count() == (2 if _ == 0 else 3)
        (src / "s2.jsonl").write_text(LINES[3])


def test_weeks(spark):
    rows = [("a", "2025-01-06 00:00:00"), ("a", "2025-01-12 23:59:59"), ("a", "2025-01-13 00:00:00")]
    df = spark.createDataFrame(rows, "entity string, at string").withColumn("at", F.col("at").cast("timestamp"))
    assert {tuple(r) for r in weekly_mentions(df).collect()} == {("a", "2025-01-06", 2), ("a", "2025-01-13", 1)}


def test_upserts(spark):
    base = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", 5, 1), ("b", 6, 2), ("c", 7, 1)], "k string, v int, seq int")
    assert {tuple(r) for r in upsert.replace(base, new, ["k"]).collect()} == {("a", 1), ("b", 6), ("c", 7)}
    assert {r[0] for r in upsert.ignore(base, new.drop("seq"), ["k"]).collect()} == {"a", "b", "c"}
    assert {tuple(r) for r in upsert.accumulate(base, new.drop("seq").where("k = 'b'"), ["k"], "v").collect()} == {("a", 1), ("b", 13)}
    left = upsert.cascade_delete({"t": (base, "k")}, spark.createDataFrame([("a",)], "uuid string"))
    assert [tuple(r) for r in left["t"].collect()] == [("b", 2)]


def test_communities_and_paths(spark):
    clique = lambda xs: [(a, b) for a in xs for b in xs if a < b]
    pairs = clique("abcd") + clique("wxyz") + [("d", "w"), ("a", "a")]
    e = spark.createDataFrame([(a, b, "co_occurs", 1.0) for a, b in pairs], "source_id string, target_id string, relation string, weight double")
    n = spark.createDataFrame([(x,) for x in "abcdwxyzq"], "id string")
    labels = {r["id"]: r["label"] for r in label_propagation(n, e).collect()}
    assert len({labels[x] for x in "abcd"}) == 1 and len({labels[x] for x in "wxyz"}) == 1 and labels["q"] == "q"
    hops = {r["id"]: (r["hops"], "".join(r["path"])) for r in hop_distances(n, e, "a").collect()}
    assert hops["a"] == (0, "a") and hops["z"] == (3, "adwz") and "q" not in hops


def test_silhouette(spark):
    df = spark.createDataFrame([(0, 0.0), (0, 0.1), (1, 9.0), (1, 9.1)], "cluster int, x double")
    assert silhouette(df, ["x"]) > 0.97


def test_linear_sessions(spark, tmp_path):
    (tmp_path / "-w--x").mkdir()
    def line(u, p, kind, content, **more):
        return json.dumps({"type": kind, "uuid": u, "parentUuid": p, "message": {"content": content}, **more})

    rows = [line("1", None, "user", "ask"), line("2", "1", "assistant", [{"type": "thinking", "thinking": "t"}, {"type": "text", "text": "old"}]), line("3", "1", "assistant", [{"type": "text", "text": "new"}, {"type": "tool_use", "name": "bash"}]), line("4", "3", "user", "<task-notification> x")]
    (tmp_path / "-w--x" / "abc.jsonl").write_text("\n".join(rows))
    (tmp_path / "-w--x" / "abd.jsonl").write_text("\n".join([line("1", None, "user", "a"), line("2", "gone", "user", "b"), line("3", "2", "assistant", "c"), line("4", "4", "user", "d"), line("5", "3", "user", "e")]))
    e = exports.read_sessions(spark, str(tmp_path))
    got = {s: [(r["uuid"], r["text"]) for r in exports.linear_sessions(e, tools=True).where(f"session = '{s}'").orderBy("place").collect()] for s in ("abc", "abd")}
    assert got["abc"] == [("1", "ask"), ("3", "new\n\n[tool_use:bash]"), ("4", "<task-notification> x")]
    assert [u for u, _ in got["abd"]] == ["1", "2", "3", "4", "5"]
    s = {r["session"]: tuple(r)[1:] for r in exports.session_summary(e).collect()}
    assert s["abc"] == (1, "old", "new") and s["abd"][0] == 4
    assert [(r["session"], r["project"]) for r in exports.find_sessions(spark, str(tmp_path), "session_abc").collect()] == [("abc", "/w/x")]


def test_elements_of_large_arrays():
    v = [{"a": [1, 'x,]}"', {"b": "\\"}]}, None, "s,[", [1, 2], 3.5, {}]
    items = lambda t, k: [*exports.array_items(iter([t[i : i + k] for i in range(0, len(t), k)]))]
    for t in (json.dumps(v), f"  {json.dumps(v, indent=2)}\n"):
        for k in (1, 2, 3, 7, 1000):
            assert [json.loads(x) for x in items(t, k)] == v
    assert items("[]", 1) == items(" [ ] ", 2) == []
    for bad in ("", "{", "{}", "[1", "[1]]", "[1] x", "x[1]", '["a]', "[1}", "1"):
        with pytest.raises(ValueError):
            items(bad, 2)


def test_blocks_of_dumps_and_results(spark, tmp_path):
    events = [{"type": "assistant", "uuid": "b", "message": {"role": "assistant", "content": [{"type": "tool_result", "tool_use_id": "t", "content": [{"text": "y"}, {"text": "z"}]}, {"type": "tool_result", "content": "plain"}]}}]
    (tmp_path / "d.json").write_text(json.dumps({"meta": {"id": "s"}, "events": events}))
    t = exports.dump_tables(spark, str(tmp_path))
    assert [r["uuid"] for r in t["messages"].collect()] == ["b"]
    assert {(r["block_index"], r["text_content"]) for r in t["content_blocks"].collect()} == {(0, "y\nz"), (1, "plain")}
