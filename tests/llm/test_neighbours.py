import numpy as np
import pytest

from parleyspark.llm import neighbours as nb

SCHEMA = "uuid string, embedding array<double>, model string, created_at string, key int, v string"
DAY = "2025-01-01T00:00:00Z"


def brute(rows, k=5):
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -9)
    return {rows[i][0]: {rows[j][0] for j in np.argsort(-s[i], kind="stable")[:k]} for i in range(len(rows))}


@pytest.mark.parametrize("fan, leaf_max, cell", [(16, 300, 400), (4, 120, 200)])
def test_recall_and_exact_similarities(spark, monkeypatch, fan, leaf_max, cell):
    """One level of 16 parts, and levels of 4 parts each."""
    monkeypatch.setattr(nb, "FAN", fan)
    monkeypatch.setattr(nb, "LEAF", 40)
    monkeypatch.setattr(nb, "LEAF_MAX", leaf_max)
    monkeypatch.setattr(nb, "CELL", cell)
    monkeypatch.setattr(nb, "SAMPLE", 1500)
    monkeypatch.setattr(nb, "BLOCK", 170)
    assert len(nb.plan(2500)) == (1 if fan == 16 else 3)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(25, 16))
    rows = [(f"u{i:05d}", (centres[i % 25] + 0.5 * rng.normal(size=16)).tolist(), "m", DAY, 0, "") for i in range(2500)]
    got = {}
    for r in nb.most_similar(spark.createDataFrame(rows, SCHEMA), models={"m": 16}).collect():
        got.setdefault(r["uuid"], set()).add(r["other"])
    want = brute(rows)
    assert got.keys() == want.keys() and all(len(v) == 5 for v in got.values())
    assert np.mean([len(got[u] & want[u]) / 5 for u in want]) >= 0.9


def test_a_third_of_equal_vectors(spark, monkeypatch):
    monkeypatch.setattr(nb, "BLOCK", 50)
    rng = np.random.default_rng(2)
    rows = [(f"u{i:03d}", [1.0, 2.0, 3.0] if i % 3 == 0 else rng.normal(size=3).tolist(), "m", DAY, 0, "") for i in range(300)]
    got = {}
    for r in nb.most_similar(spark.createDataFrame(rows, SCHEMA), models={"m": 3}).collect():
        got.setdefault(r["uuid"], []).append((r["rank"], r["other"], r["similarity"]))
    assert len(got) == 300 and all([i for i, *_ in sorted(x)] == [1, 2, 3, 4, 5] for x in got.values())
    for one in ("u000", "u006", "u099", "u297"):
        first = [u for u in ("u000", "u003", "u006", "u009", "u012", "u015") if u != one][:5]
        assert [o for _, o, _ in sorted(got[one])] == first and all(abs(s - 1) < 1e-6 for *_, s in got[one])


def test_which_rows_count(spark):
    rows = [("a", [1.0, 0.0], "m", DAY, 0, ""), ("b", [1.0, 0.1], "m", DAY, 0, ""), ("b", [0.0, 1.0], "m", "2024-01-01T00:00:00Z", 0, ""), ("c", None, "m", DAY, 0, ""), ("d", [0.0, 0.0], "m", DAY, 0, ""), ("e", [float("nan"), 1.0], "m", DAY, 0, ""), ("f", [1.0], "m", DAY, 0, ""),
            ("g", [1.0, None], "m", DAY, 0, ""), ("h", [1.0, 1.0], "other", DAY, 0, ""), ("i", [1e300, 1e300], "m", DAY, 0, ""), (None, [1.0, 1.0], "m", DAY, 0, ""), ("j", [1.0, 1.0], "m", DAY, 0, ""), ("j", None, "m", "2025-01-01T09:00:00+08:00", 0, "")]
    got = {(r["uuid"], r["other"], r["rank"]) for r in nb.most_similar(spark.createDataFrame(rows, SCHEMA), models={"m": 2}).collect()}
    assert {u for u, *_ in got} <= {"a", "b", "i"} and ("a", "b", 1) in got and ("b", "a", 1) in got
    assert nb.most_similar(spark.createDataFrame([], SCHEMA), models={"m": 2}).count() == 0


def test_parts_are_balanced_and_cut_few_links():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 0.3, (200, 8)) for c in rng.normal(0, 2, (8, 8))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = nb.neighbour_graph(x, 8)
    part = nb.balanced_parts(x, g, 8)
    assert np.bincount(part).min() >= 195 and np.bincount(part).max() <= 205
    assert (part[g] == part[:, None]).mean() > 0.6


def test_levels_follow_the_rows():
    assert nb.plan(0) == nb.plan(499) == [] and nb.plan(500) == [2] and nb.plan(35_000) == [64]
    for n in (10**6, 10**8, 10**10):
        leaves = np.prod([float(f) for f in nb.plan(n)])
        assert nb.LEAF / 2 <= n / leaves <= nb.LEAF_MAX
