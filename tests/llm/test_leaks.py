import random
import time

import numpy as np

from parleyspark.llm import leaks as lk

DOCS, ITEMS = "doc_id bigint, text string, item_id string", "item_id bigint, text string, suite string"


def longest_run(a, b):
    best, before = 0, [0] * (len(b) + 1)
    for x in a:
        now = [0] * (len(b) + 1)
        for j, y in enumerate(b):
            if x == y:
                now[j + 1] = before[j] + 1
                best = max(best, now[j + 1])
        before = now
    return best


def test_exact_runs_against_brute_force(spark):
    rnd = random.Random(3)
    vocabulary = [f"w{i}" for i in range(25)] + ["the", "of"]
    items = [(i, " ".join(rnd.choices(vocabulary, k=rnd.randint(0, 60))), "s") for i in range(25)]
    docs = []
    for d in range(150):
        ws = rnd.choices(vocabulary, k=rnd.randint(0, 50))
        if rnd.random() < 0.7:
            src = rnd.choice(items)[1].split()
            k = rnd.randint(0, max(0, len(src) - 9))
            ws[10:10] = src[k : k + rnd.randint(8, 20)]
        docs.append((d, rnd.choice([" ", ", ", "\n- "]).join(w.upper() if rnd.random() < 0.3 else w for w in ws), "x"))
    got = {(r["doc_id"], r["item_id"]): r["exact_words"] for r in lk.leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()}
    want = {}
    for d, t, _ in docs:
        for i, q, _ in items:
            if (n := longest_run([w.decode() for w in lk.words(t)], [w.decode() for w in lk.words(q)])) >= 12:
                want[(d, i)] = n
    assert {k: v for k, v in got.items() if v >= 12} == want and len(want) > 20


def met(doc, item):
    """Diagonals by way of the table of places, as the join gives them."""
    rows = []
    for m in range(len(lk.MASKS)):
        a, b = (list(zip(*(c.tolist() for c in lk._places(h, np.arange(len(h)))))) for h in (lk.window_hashes(doc, m), lk.window_hashes(item, m)))
        rows += [x[1:] + y[1:] for x in a for y in b if x[0] == y[0]]
    return lk.diagonals(np.array(rows, np.int64).reshape(-1, 6), np.zeros(len(rows), np.int64))[1] if rows else np.empty(0, np.int64)


def overlap(doc, item):
    on, zero = met(doc, item), np.zeros(1, np.int64)
    return tuple(int(x[0]) for x in lk.overlaps(doc, zero, zero + len(doc), item, zero, zero + len(item), np.zeros(len(on), np.int64), on)) if len(on) else None


def plain_overlap(doc, item, on):
    best = None
    for d in on:
        lo, hi = max(0, d), min(len(doc), d + len(item))
        same = [doc[i] == item[i - d] for i in range(lo, hi)]
        runs = max(len(r) for r in "".join("x" if x else " " for x in same).split(" "))
        score, segments = max((sum(1 if x else -2 for x in same[i:j]), -j, i) for i in range(len(same) + 1) for j in range(i, len(same) + 1))[:2], None
        i = max(i for i in range(-score[1] + 1) if sum(1 if x else -2 for x in same[i : -score[1]]) == score[0])
        got = (sum(same[i : -score[1]]), -score[1] - i, -(lo + i))
        best = (runs, got) if best is None else (max(runs, best[0]), max(best[1], got))
    return best[0], best[1][1], best[1][0], -best[1][2]


def test_substitutions_and_forms():
    text = "Nobody at Mifmara noticed that the seventh clerk had stored forty uneven letters beneath the narrow staircase since last spring"
    hashing = lk.Words()
    item = hashing.codes(text)
    changed = text.replace("seventh", "third").replace("narrow", "wide")
    run, words, equal, first = overlap(hashing.codes("before that " + changed), item)
    assert run < 12 and words >= 18 and equal == words - 2 and first == 2
    look = text.replace("o", "о").replace("a", "ａ").replace("stored", "sto­red")
    assert overlap(hashing.codes(look.upper()), item)[0] == len(text.split())
    for nothing in (None, "", "a b c"):
        assert overlap(hashing.codes(nothing), item) is None


def test_overlaps_against_all_diagonals():
    rnd = np.random.default_rng(5)
    for _ in range(60):
        doc, item = rnd.integers(0, rnd.integers(1, 4), rnd.integers(12, 60)), rnd.integers(0, 2, rnd.integers(12, 40))
        want = set()
        for m, mask in enumerate(lk.MASKS):
            on = [k for k in range(12) if mask[k] == "1"]
            want |= {p - q for p in range(len(doc) - 11) for q in range(len(item) - 11) if all(doc[p + k] == item[q + k] for k in on)}
        on = met(doc.astype(np.uint64), item.astype(np.uint64))
        assert set(on.tolist()) == want
        if want:
            assert overlap(doc.astype(np.uint64), item.astype(np.uint64)) == plain_overlap(doc, item, sorted(want))


def test_repeated_words_stay_cheap():
    hashing = lk.Words()
    began = time.time()
    assert overlap(hashing.codes("again " * 4000), hashing.codes("again " * 1000))[0] == 1000
    assert overlap(hashing.codes("now and then " * 2000), hashing.codes("now and then " * 300))[0] == 900
    assert time.time() - began < 2


def test_blocks_and_ends(spark, monkeypatch):
    rows = [(i, " ".join(f"x{i}y{k}" for k in range(14)), "s") for i in range(12)] + [(99, None, "s"), (None, "a " * 14, "s")]
    docs = [(i, rows[i][1] + " tail", "") for i in range(12)] + [(50, None, ""), (51, "", ""), (None, rows[0][1], ""), (52, "z " * 200_000 + rows[3][1], ""), (53, "x3y0 " * 14, "")]
    a, b = spark.createDataFrame(docs, DOCS), spark.createDataFrame(rows, ITEMS)
    whole = {tuple(r) for r in lk.leaks(a, b).collect()}
    # a filter that lets nearly everything pass changes nothing
    monkeypatch.setattr(lk, "FILTER_BITS", 64)
    monkeypatch.setattr(lk, "_BATCH_WORDS", 30)
    monkeypatch.setattr(lk, "SHARED_WORDS", 10)
    assert {tuple(r) for r in lk.leaks(a, b).collect()} == whole and len(whole) == 13
    assert lk.leaks(a, b.where("false")).count() == lk.leaks(a.where("false"), b).count() == 0
