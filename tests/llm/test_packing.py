import random
from collections import Counter

from parleyspark.llm import packing


def plain_first_fit(sizes, capacity):
    bins, out = [], []
    for s in sizes:
        for i, room in enumerate(bins):
            if room >= s:
                bins[i] -= s
                out.append(i)
                break
        else:
            bins.append(capacity - s)
            out.append(len(bins) - 1)
    return out


def test_tree_gives_first_fit():
    rnd = random.Random(1)
    for _ in range(60):
        sizes = sorted((rnd.randint(0, 100) for _ in range(rnd.randint(0, 70))), reverse=True)
        assert packing.first_fit_decreasing(sizes, 100) == plain_first_fit(sizes, 100)


def test_pack(spark):
    rnd = random.Random(2)
    rows = [(i, rnd.choice([0, 5, 300, 700, 2048, 2049, 9000, rnd.randint(1, 2000)])) for i in range(600)]
    t = packing.pack(spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint"), group=100).collect()
    room, got, pieces = Counter(), Counter(), Counter()
    for r in t:
        room[r["container"]] += r["n_tokens"]
        got[r["doc_id"]] += r["n_tokens"]
        pieces[r["doc_id"]] += 1
        assert r["token_from"] == r["piece"] * 2048
    assert max(room.values()) <= 2048 and dict(got) == dict(rows)
    assert all(pieces[i] == max(1, -(-n // 2048)) for i, n in rows)
    assert sum(room.values()) / (2048 * len(room)) > 0.95


def test_tokens_and_ends(spark):
    docs = spark.createDataFrame([(1, "Hello, wörld! <|endoftext|>"), (2, ""), (3, None), (4, "word " * 30_000), (None, "x")], "doc_id bigint, text string")
    n = {r["doc_id"]: r["n_tokens"] for r in packing.token_counts(docs).collect()}
    assert n[1] > 4 and n[2] == n[3] == 0 and n[4] >= 30_000 and None in n
    same = {r["doc_id"]: r["n_tokens"] for r in packing.token_counts(docs, tokenizer="/opt/tokenizers/byte_bpe_50k.json").collect()}
    other = {r["doc_id"]: r["n_tokens"] for r in packing.token_counts(docs, tokenizer="/opt/tokenizers/byte_bpe_50k.tiktoken").collect()}
    assert same == other
    assert packing.pack(packing.token_counts(docs)).count() == 4 + -(-n[4] // 2048)
    assert packing.pack(spark.createDataFrame([], "doc_id bigint, n_tokens bigint")).count() == 0


def test_rows_of_one_key_spread(spark):
    df = spark.range(30_000).selectExpr("cast(null as bigint) as doc_id", "100L as n_tokens")
    t = packing.pack(df).selectExpr("split(container, '-')[0] as g").groupBy("g").count().collect()
    assert len(t) == 3 and all(9_000 < r["count"] < 11_000 for r in t)
