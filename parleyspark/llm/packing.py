"""Filling containers of fixed capacity: first-fit decreasing over a tournament tree, in randomised groups.

Every item goes to a group by a seeded hash of its key and its row, so that any number of rows of one key spread like others;
groups are packed independently and in parallel, and lose at most about one half-filled container each. A text longer
than the capacity is cut into full containers and a rest.

Defined cases: NULL and empty texts have 0 tokens and lie in a container all the same; ties of size are taken in the
order of the key; a repeated key is packed as often as it comes; an empty table gives an empty result.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import cache

import pandas as pd
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parleyspark.plans.stage import Stage

CAPACITY = 2048
#: Items packed together. Less than one container in GROUP / 10 is lost to the borders of groups at usual sizes.
GROUP = 10_000
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"


@cache
def _encoder(path: str):
    """A public tokenizer: a tiktoken file of ranks, or a JSON file of the tokenizers library."""
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        return lambda text: len(t.encode(text, add_special_tokens=False).ids)
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    # Fixed value: the published splitting pattern of this family of byte-level vocabularies.
    pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    e = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return lambda text: len(e.encode_ordinary(text))


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens BIGINT)."""

    # machines that don't have the file get it from the driver
    spark, name = docs.sparkSession, os.path.basename(tokenizer)
    if not any(x.endswith("/" + name) for x in spark.sparkContext.listFiles):
        spark.sparkContext.addFile(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _encoder(tokenizer if os.path.exists(tokenizer) else SparkFiles.get(name))
        for b in batches:
            n = [count(t) if (t := x.as_py()) else 0 for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    return docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id bigint, n_tokens bigint")


class Tournament:
    """Bins in a complete tree of which each node knows the largest room below it; the first bin with room is a descent."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.room = [capacity] * (2 * self.leaves)
        self.used = 0

    def place(self, size: int) -> int:
        room, at = self.room, 1
        while at < self.leaves:
            at *= 2
            if room[at] < size:
                at += 1
        bin_ = at - self.leaves
        room[at] -= size
        while at > 1:
            at //= 2
            largest = max(room[2 * at], room[2 * at + 1])
            if room[at] == largest:
                break
            room[at] = largest
        self.used = max(self.used, bin_ + 1)
        return bin_


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each item; sizes come in decreasing order and are at most the capacity."""
    tree = Tournament(len(sizes), capacity)
    return [tree.place(s) for s in sizes]


def pack(sizes: DataFrame, capacity: int = CAPACITY, group: int = GROUP, seed: int = 7) -> DataFrame:
    """(doc_id, piece, n_tokens, token_from, container) of (doc_id, n_tokens): a container is '<group>-<number>'."""
    last = F.greatest(F.lit(0), F.ceil(F.col("n_tokens") / capacity) - 1)
    items = sizes.select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(0).cast("bigint"), last.cast("bigint"))).alias("piece"))
    items = items.select("doc_id", "piece", F.least(F.lit(capacity).cast("bigint"), F.col("n_tokens") - F.col("piece") * capacity).alias("n_tokens"), (F.col("piece") * capacity).alias("token_from"))
    # written with the number of each row: a task that runs again must not put a row into another group
    items = Stage(items.withColumn("row", F.monotonically_increasing_id())).df
    groups = max(1, -(-items.count() // group))
    items = items.withColumn("g", F.pmod(F.xxhash64("doc_id", "piece", "row", F.lit(seed)), F.lit(groups)))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "doc_id", "piece", "row"], ascending=[False, True, True, True], kind="stable")
        bins = first_fit_decreasing(pdf["n_tokens"].tolist(), capacity)
        pdf["container"] = [f"{g}-{b}" for g, b in zip(pdf["g"], bins, strict=True)]
        return pdf[["doc_id", "piece", "n_tokens", "token_from", "container"]]

    return items.groupBy("g").applyInPandas(one, "doc_id bigint, piece bigint, n_tokens bigint, token_from bigint, container string")
