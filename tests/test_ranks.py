import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from parleyspark.operators import ranks


@pytest.mark.parametrize("tile", [512, 4])
def test_all_pairs_of_a_group(spark, tile):
    rnd = random.Random(1)
    rows = list({(rnd.choice("abbbbbbb"), f"e{rnd.randrange(25)}", rnd.choice(["x", None])) for _ in range(120)})
    df = spark.createDataFrame([*rows, (None, "e1", "x"), (None, "e2", "x")], "k string, entity string, type string")
    got = [(r["k"], (r["x"]["entity"], r["x"]["type"]), (r["y"]["entity"], r["y"]["type"])) for r in ranks.within(df, "k", ["entity", "type"], tile).collect()]
    order = lambda m: (m[0], m[1] or "")
    want = {(k, *sorted([a, b], key=order)) for k in "ab" for a, b in combinations([r[1:] for r in rows if r[0] == k], 2)}
    assert len(got) == len(set(got)) and set(got) == want
    assert ranks.within(df.where("false"), "k", ["entity"]).count() == 0


def test_numbers_in_order(spark):
    df = spark.range(0, 1000, numPartitions=7).select((F.col("id") * 7919 % 1000).alias("v"))
    t = ranks.numbered(df, [F.desc("v")]).collect()
    assert sorted((r["place"], r["v"]) for r in t) == [(i + 1, 999 - i) for i in range(1000)]
    assert ranks.numbered(df.where("false"), ["v"]).count() == 0
