"""Walks of the graph against brute force."""

import random

from conftest import DATA

from parleyspark.operators.graph import hop_distances, shortest_path, subgraph
from parleyspark.plans import catalogue

EDGES = "source_id string, target_id string, relation string, weight double"


def test_edges_within_two_hops(spark, oracle):
    rnd = random.Random(5)
    ids = ["storybook"] + [f"n{i}" for i in range(60)]
    pairs = {(rnd.choice(ids), rnd.choice(ids)) for _ in range(70)} | {("storybook", "n0"), ("n0", "n1"), ("n1", "n2")}
    n = spark.createDataFrame([(x, x) for x in ids], "id string, label string")
    e = spark.createDataFrame([(a, b, "co_occurs", 1.0) for a, b in pairs], EDGES)
    near = {"storybook"}
    for _ in range(2):
        near |= {y for a, b in pairs for x, y in ((a, b), (b, a)) if x in near}
    got = {(r[0], r[1]) for r in subgraph(n, e, "storybook", 2)[1].select("source_id", "target_id").collect()}
    assert got == {(a, b) for a, b in pairs if a in near and b in near} and len(near) < len(ids)
    # the registered query: all edges of the graph among the nodes of its sister
    q = catalogue.QUERIES
    nodes = {r["id"] for r in q["bfs_subgraph"](spark, DATA).collect()}
    want = {(r[0], r[1], r[2]) for r in q["graph_edges"](spark, DATA).select("source_id", "target_id", "relation").collect() if r[0] in nodes and r[1] in nodes}
    assert {(r[0], r[1], r[2]) for r in q["bfs_subgraph_depth2_edges"](spark, DATA).collect()} == want


def test_a_chain_of_more_than_fifty_hops(spark):
    ids = [f"n{i:02}" for i in range(54)]
    n = spark.createDataFrame([(x,) for x in ids], "id string")
    e = spark.createDataFrame([(a, b, "co_occurs", 1.0) for a, b in zip(ids, ids[1:])], EDGES)
    assert [tuple(r) for r in shortest_path(n, e, "n00", "n53").collect()] == [(ids, 53)]
    assert hop_distances(n, e, "n00", 2).count() == 3
