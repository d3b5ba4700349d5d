import random

from parleyspark.operators.hierarchy import descendants, hierarchy


def brute(rows):
    parent = {}
    for i, p in rows:
        if i is not None:
            parent[i] = p if parent.get(i) is None or (p is not None and p < parent[i]) else parent[i]
    out = {}
    for i in parent:
        seen, at, depth = set(), i, 0
        while at not in seen and parent.get(at) in parent:
            seen.add(at)
            at, depth = parent[at], depth + 1
        out[i] = ("", -1) if at in seen else (at, depth)
    return out


def check(spark, rows):
    df = spark.createDataFrame([(i, p, "x", 1) for i, p in rows], "uuid string, parent_message_uuid string, root string, depth int")
    got = {r["id"]: (r["root"], r["depth"]) for r in hierarchy(df).collect()}
    assert got == brute(rows)
    return df


def test_random_forests_with_loops(spark):
    rnd = random.Random(5)
    rows = []
    for t in range(12):
        n = rnd.randint(1, 40)
        for k in range(n):
            p = f"{t}-{rnd.randrange(n)}" if rnd.random() < 0.15 else (f"{t}-{rnd.randrange(k)}" if k else rnd.choice([None, "", "missing"]))
            rows.append((f"{t}-{k}", p))
    check(spark, rows + rows[:9])


def test_long_chain_and_wide_star(spark):
    rows = [("c0", None)] + [(f"c{i}", f"c{i - 1}") for i in range(1, 300)] + [(f"s{i}", "c1") for i in range(500)]
    check(spark, rows)


def test_ends(spark):
    check(spark, [])
    check(spark, [(None, "a"), ("a", "a"), ("b", "a"), ("c", None), ("C", "c")])
    check(spark, [("00000000-0000-4000-8000-000000000001", None), ("b", "00000000-0000-4000-8000-000000000001"), ("00000000-0000-4000-8000-00000000000A", "b")])


def test_paths_and_descendants(spark):
    df = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "a"), ("x", "y"), ("y", "x")], "uuid string, parent_message_uuid string")
    paths = {r["id"]: r["path"] for r in hierarchy(df, with_path=True).collect()}
    assert paths == {"a": ["a"], "b": ["a", "b"], "c": ["a", "b", "c"], "d": ["a", "d"], "x": ["x"], "y": ["y"]}
    below = {(r["ancestor"], r["descendant"], r["distance"]) for r in descendants(df).collect()}
    assert below == {("a", "b", 1), ("a", "c", 2), ("b", "c", 1), ("a", "d", 1)}
