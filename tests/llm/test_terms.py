import math
import random
from collections import Counter, defaultdict
from itertools import combinations

import pytest

from parleyspark.llm import terms

SCHEMA = "entity string, type string, message_uuid string, n bigint, code bigint"


@pytest.fixture
def rows():
    rnd = random.Random(2)
    out = [(rnd.choice([f"T{int(rnd.paretovariate(0.8)) % 40}", " hot ", "hot", "HOT"]), rnd.choice(["topic", "tool", None]), f"m{rnd.randrange(120)}", 1, 2) for _ in range(1500)]
    return out + [(None, "topic", "m1", 0, 0), ("  ", "topic", "m1", 0, 0), ("x", "topic", None, 0, 0), (" nb ", "topic", "m3", 0, 0)]


def clean(rows):
    return [(e.strip().lower(), t, m) for e, t, m, *_ in rows if e and e.strip() and m]


@pytest.mark.parametrize("counter", [2_000_000, 20])
def test_counts(spark, rows, counter, monkeypatch):
    monkeypatch.setattr(terms, "COUNTER_ROWS", counter)
    got = {(r["entity"], r["type"]): (r["n_rows"], r["n_records"], r["mark"]) for r in terms.mark_terms(spark.createDataFrame(rows, SCHEMA)).collect()}
    c = clean(rows)
    n, ms = Counter((e, t) for e, t, _ in c), defaultdict(set)
    for e, t, m in c:
        ms[(e, t)].add(m)
    total = len({m for *_, m in c})
    assert got == {k: (n[k], len(s), "rare" if len(s) < 3 else "common" if 100 * len(s) > 3 * total else None) for k, s in ms.items()}


@pytest.mark.parametrize("tile, half", [(256, 31), (3, 2)])
def test_pairs(spark, rows, tile, half, monkeypatch):
    monkeypatch.setattr(terms, "TILE", tile)
    monkeypatch.setattr(terms, "HALF", half)
    monkeypatch.setattr(terms, "RUN", 50)
    by = defaultdict(set)
    for e, _, m in clean(rows):
        by[m].add(e)
    n1, n2, total = Counter(e for s in by.values() for e in s), Counter(p for s in by.values() for p in combinations(sorted(s), 2)), len(by)
    for least, lift in ((3, 0.0001), (3, 3.0), (1, 1.0)):
        got = {(r["entity_a"], r["entity_b"]): r for r in terms.pairs(spark.createDataFrame(rows, SCHEMA), least=least, lift=lift).collect()}
        want = {k: v for k, v in n2.items() if v >= least and v * total >= lift * n1[k[0]] * n1[k[1]]}
        assert {k: r["n_ab"] for k, r in got.items()} == want
        for (a, b), r in got.items():
            ab, x, y = want[(a, b)], n1[a], n1[b]
            odds = (ab + 0.5) * (total - x - y + ab + 0.5) / ((x - ab + 0.5) * (y - ab + 0.5))
            assert math.isclose(r["log_odds"], math.log(odds)) and math.isclose(r["lift"], ab * total / (x * y))


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert terms.pairs(df).count() == terms.mark_terms(df).count() == 0
