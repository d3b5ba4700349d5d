"""Numbers of clusters, and features that are whole."""

from parleyspark.operators import cluster as cl
from parleyspark.plans import graph_queries as gq


def test_every_k_is_tried_for_the_graph(spark, monkeypatch):
    assert list(cl.graph_ks(4327)) == list(range(2, 21)) and list(cl.graph_ks(26)) == [2, 3, 4, 5] and list(cl.graph_ks(3)) == []
    # 30 entities in three heaps: the best k is odd
    rows = [(f"n{i}", [0.0, 0.5, 1.0][i % 3] + i / 100_000) for i in range(30)]
    x = spark.createDataFrame(rows, "id string, x double")
    monkeypatch.setattr(cl, "features", lambda a, n, t: x)
    monkeypatch.setattr(gq.g, "entity_times", lambda a: None)
    got = gq._k_means_communities(None, None, None).collect()
    assert {r["k"] for r in got} == {3} and len(got) == 30
    assert len({(int(r["id"][1:]) % 3, r["cluster"]) for r in got}) == 3
    few = spark.createDataFrame(rows[:3], "id string, x double")
    monkeypatch.setattr(cl, "features", lambda a, n, t: few)
    assert [(r["cluster"], r["k"]) for r in gq._k_means_communities(None, None, None).collect()] == [(0, 0)] * 3


def test_rare_terms_count(spark, monkeypatch):
    # 70 terms of three conversations each, and one of two: with 64 terms the last ones had no text at all
    rows = [(f"c{i:03}", f"word{i // 3:03}", 1, "", "", "") for i in range(210)] + [("x", "zebra", 1, "", "", ""), ("y", "zebra", 1, "", "", "")]
    t = spark.createDataFrame(rows, "uuid string, title string, msg_count bigint, first_human string, topics string, tools string")
    v = {r["uuid"]: r["v"] for r in cl.text_features(t).collect()}
    assert len(v) == 212 and all(sum(x.toArray()[:71]) == 1.0 for x in v.values()) and v["x"] == v["y"] != v["c000"]
    monkeypatch.setattr(cl, "conversation_texts", lambda a: t)
    got = {r["uuid"]: r["label"] for r in cl.categorize(None).collect()}
    assert set(got) == set(v) and got["x"] == got["y"]


def test_vectors_of_every_model(spark, monkeypatch):
    rows = [(f"c{i:02}", f"title {i % 6}", 1, "", "", "") for i in range(36)]
    t = spark.createDataFrame(rows, "uuid string, title string, msg_count bigint, first_human string, topics string, tools string")
    monkeypatch.setattr(cl, "conversation_texts", lambda a: t)
    vectors = [(f"c{i:02}", m, [float(j == i % 6) + i / 100_000 for j in range(n)], "2025-01-01") for i in range(36) for m, n in cl.MODELS.items() if i < 24 or n == 32]
    df = spark.createDataFrame(vectors, "uuid string, model string, embedding array<double>, created_at string")
    got = cl.categorize_vectors(None, df).collect()
    assert sorted((r["model"], r["uuid"]) for r in got) == sorted((m, u) for u, m, _, _ in vectors)
    for m in cl.MODELS:  # six heaps, and none of them is cut
        assert len({r["cluster"] for r in got if r["model"] == m}) == len({(r["cluster"], int(r["uuid"][1:]) % 6) for r in got if r["model"] == m}) == 6


def test_fewer_rows_than_clusters(spark):
    df = spark.createDataFrame([(i, float(i % 3), 1.0) for i in range(9)], "i int, x double, y double")
    k, t = cl.auto_k(df, ["x", "y"], range(5, 9))
    assert k == 3 and len({r["cluster"] for r in t.collect()}) == 3 and cl.k_means(df, ["x", "y"], 5).count() == 9
    same = df.where("x = 0")
    assert cl.auto_k(same, ["x", "y"], range(2, 4))[0] == 1 and {r["cluster"] for r in cl.k_means(same, ["x", "y"], 4).collect()} == {0}
