"""Frequency of every term, and pairs of terms that appear together.

Defined cases, for both: terms compare trimmed and in lower case; null and blank terms and rows without a record don't
count; repeats of a term in a record count once where records are counted; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parleyspark.functions.keys import pack_key
from parleyspark.plans.stage import Stage

#: A term of more rows than this is counted by several counters, one for each so many rows, before their sums meet.
COUNTER_ROWS = 2_000_000
#: Terms of one record that are paired in one task; larger records are paired tile by tile.
TILE = 256
#: Pair codes sorted at once in a worker: 8 bytes each.
RUN = 2_000_000
#: Bits of a term's number in a pair's code; of larger numbers the upper bits stand beside the code.
HALF = 31


def normal(c: Column) -> Column:
    t = F.lower(F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    return F.when(t != "", t)


def n_records(rows: DataFrame, term: str = "entity", record: str = "message_uuid") -> DataFrame:
    """One row, ``n_all``: the number of records with a term."""
    seen = rows.where(normal(F.col(term)).isNotNull() & F.col(record).isNotNull())
    return seen.select(pack_key(F.col(record)).alias("r")).distinct().agg(F.count("*").alias("n_all"))


def term_counts(rows: DataFrame, term: str = "entity", kind: str = "type", record: str = "message_uuid") -> DataFrame:
    """(entity, type, n_rows, n_records) by last-seen counters.

    Rows are hash-partitioned by term and salt and come ordered by record; a row whose record differs from the last one
    seen of its term adds to the records. A record's rows of a term share a salt, so that sums over salts are exact. Salts follow
    the rows: a first sum, combined before its shuffle, finds the terms of more than COUNTER_ROWS rows, at most one for each so many
    rows of the table. A null type is a type of its own.
    """
    t = rows.select(normal(F.col(term)).alias("entity"), F.col(kind).alias("type"), pack_key(F.col(record)).alias("r")).where("entity is not null and r is not null")
    hot = t.groupBy("entity").agg(F.count("*").alias("n")).where(F.col("n") > COUNTER_ROWS).select(F.col("entity").alias("hot"), F.ceil(F.col("n") / COUNTER_ROWS).alias("salts"))
    t = t.join(Stage(hot).df, F.col("entity") == F.col("hot"), "left").drop("hot")
    t = t.withColumn("salt", F.when(F.col("salts").isNotNull(), F.pmod(F.xxhash64("r"), F.col("salts"))).otherwise(0))
    last = F.lag("r").over(Window.partitionBy("entity", "type", "salt").orderBy("r"))
    counters = t.withColumn("fresh", F.when(last.eqNullSafe(F.col("r")), 0).otherwise(1)).groupBy("entity", "type", "salt").agg(F.count("*").alias("n"), F.sum("fresh").alias("fresh"))
    return counters.groupBy("entity", "type").agg(F.sum("n").cast("bigint").alias("n_rows"), F.sum("fresh").cast("bigint").alias("n_records"))


def mark_terms(rows: DataFrame, rare_below: int = 3, common_percent: int = 3) -> DataFrame:
    """term_counts() with ``mark``: 'rare' below so many records, 'common' above that share of all records, else NULL."""
    # one row, whatever the data
    total = F.broadcast(n_records(rows))
    mark = F.when(F.col("n_records") < rare_below, "rare").when(100 * F.col("n_records") > common_percent * F.col("n_all"), "common")
    return term_counts(rows).join(total).select("entity", "type", "n_rows", "n_records", mark.alias("mark"))


def _numbered(df: DataFrame) -> DataFrame:
    """A written table with ``no``: 0, 1, 2 ... in the order of its files; only one number for each of its partitions meets the driver."""
    base = Stage(df.withColumn("__at", F.monotonically_increasing_id())).df
    part = F.shiftright("__at", 33)
    sizes = {r[0]: r[1] for r in base.groupBy(part.alias("p")).count().collect()}
    starts, at = {}, 0
    for p in sorted(sizes):
        starts[p] = at
        at += sizes[p]
    # a row for each partition of the written table
    offsets = df.sparkSession.createDataFrame([(int(p), n) for p, n in starts.items()], "__part bigint, __start bigint")
    t = base.withColumn("__part", part).join(offsets, "__part")
    return t.withColumn("no", F.col("__start") + F.col("__at").bitwiseAND((1 << 33) - 1)).drop("__at", "__part", "__start")


def _runs(tiles: Iterator[pa.RecordBatch], half: int, run: int) -> Iterator[pa.RecordBatch]:
    """Packed codes of the pairs within (or between) tiles, as sorted runs with counts. Numbers beyond ``half`` bits leave their upper parts in ``block``."""
    held, size, low = [], 0, (1 << half) - 1

    def flush():
        x, y = (np.concatenate(part) for part in zip(*held, strict=True))
        codes, blocks = (x & low) << half | (y & low), x >> half << 31 | y >> half
        order = np.lexsort((codes, blocks)) if blocks.any() else np.argsort(codes, kind="stable")
        codes, blocks = codes[order], blocks[order]
        starts = np.flatnonzero(np.r_[True, (codes[1:] != codes[:-1]) | (blocks[1:] != blocks[:-1])])
        columns = blocks[starts], codes[starts], np.diff(np.r_[starts, len(codes)])
        for i in range(0, len(starts), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 100_000], pa.int64()) for c in columns], names=["block", "code", "n"])

    for batch in tiles:
        a_all, b_all = batch.column(0), batch.column(1)
        for i in range(batch.num_rows):
            a = a_all[i].values.to_numpy(zero_copy_only=False)
            b = b_all[i].values.to_numpy(zero_copy_only=False) if b_all[i].is_valid else None
            if b is None:
                x, y = np.triu_indices(len(a), 1)
                x, y = a[x], a[y]
            else:
                x, y = np.repeat(a, len(b)), np.tile(b, len(a))
            held.append((np.minimum(x, y), np.maximum(x, y)))
            size += len(x)
            if size >= run:
                yield from flush()
                held, size = [], 0
    if size:
        yield from flush()


def _run_lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over equal codes of sorted (block, code, n) rows; the last code waits for the next batch."""
    names = ["block", "code", "n"]
    last = None
    for batch in batches:
        blocks, codes, counts = (c.to_numpy() for c in batch.columns)
        if not len(codes):
            continue
        starts = np.flatnonzero(np.r_[True, (codes[1:] != codes[:-1]) | (blocks[1:] != blocks[:-1])])
        rows = np.stack([blocks[starts], codes[starts], np.add.reduceat(counts, starts)])
        if last is not None:
            if (rows[:2, 0] == last[:2]).all():
                rows[2, 0] += last[2]
            else:
                rows = np.c_[last, rows]
        last = rows[:, -1]
        if rows.shape[1] > 1:
            yield pa.RecordBatch.from_arrays([pa.array(r[:-1], pa.int64()) for r in rows], names=names)
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in last], names=names)


def pairs(rows: DataFrame, term: str = "entity", record: str = "message_uuid", least: int = 3, lift: float = 3.0) -> DataFrame:
    """Pairs of terms that stand together in at least ``least`` records and ``lift`` times as often as by chance.

    (entity_a, entity_b, n_ab, n_a, n_b, n_all, lift, log_odds): log odds ratio with 1/2 added to each cell.

    Terms get numbers, a pair is one 64-bit code, and codes are counted by an external sort: sorted runs in the workers,
    Spark's sort (which spills runs and merges them) within hash partitions of the codes, run lengths at the end.
    Two exact bounds shrink the input first: no pair of a term in fewer than ``least`` records can count, and since
    n_ab <= min(n_a, n_b), none of a term in more than n_all / lift records. Records of more than TILE of the terms left
    are paired in tiles, each a row of its own, so that no task has to hold or pair a whole large record.
    """
    t = rows.select(normal(F.col(term)).alias("entity"), pack_key(F.col(record)).alias("r")).where("entity is not null and r is not null").distinct()
    t = Stage(t).df
    total = t.select("r").distinct().count()
    words = t.groupBy("entity").agg(F.count("*").alias("n_t"))
    kept = words.where((F.col("n_t") >= least) & (F.col("n_t") * lift <= total))
    words = Stage(_numbered(kept)).df
    m = Stage(t.join(words, "entity").select("r", "no")).df
    # tiles by a hash of the term: a record of n terms gives about n / TILE tiles
    width = m.groupBy("r").agg(F.ceil(F.count("*") / TILE).alias("w"))
    tiled = m.join(width.where("w > 1"), "r", "left").select("r", F.coalesce("w", F.lit(1)).alias("w"), "no", F.when(F.col("w") > 1, F.pmod(F.xxhash64("no"), F.col("w"))).otherwise(0).alias("tile"))
    tiles = tiled.groupBy("r", "w", "tile").agg(F.collect_list("no").alias("a"))
    one = tiles.select("a", F.lit(None).cast("array<bigint>").alias("b"))
    large = Stage(tiles.where("w > 1")).df
    other = large.select(F.col("r").alias("r2"), F.col("tile").alias("tile2"), F.col("a").alias("b"))
    two = large.join(other, (F.col("r") == F.col("r2")) & (F.col("tile") < F.col("tile2"))).select("a", "b")
    code = "block bigint, code bigint, n bigint"
    half, run = HALF, RUN
    runs = one.where("size(a) > 1").unionByName(two).mapInArrow(lambda tiles: _runs(tiles, half, run), code)
    counted = runs.repartition("block", "code").sortWithinPartitions("block", "code").mapInArrow(_run_lengths, code).where(F.col("n") >= least)
    upper, lower = lambda c, bits: F.shiftright(c, bits), lambda c, bits: F.col(c).bitwiseAND((1 << bits) - 1)
    counted = counted.select((F.shiftleft(upper("block", 31), HALF) + upper("code", HALF)).alias("no_a"), (F.shiftleft(lower("block", 31), HALF) + lower("code", HALF)).alias("no_b"), F.col("n").alias("n_ab"))
    a = words.select(F.col("no").alias("no_a"), F.col("entity").alias("x"), F.col("n_t").alias("n_x"))
    b = words.select(F.col("no").alias("no_b"), F.col("entity").alias("y"), F.col("n_t").alias("n_y"))
    named = counted.join(a, "no_a").join(b, "no_b").where(F.col("n_ab") * F.lit(total) >= F.col("n_x") * F.col("n_y") * lift)
    swap = F.col("x") > F.col("y")
    cells = [F.col("n_ab"), F.col("n_a") - F.col("n_ab"), F.col("n_b") - F.col("n_ab"), F.lit(total) - F.col("n_a") - F.col("n_b") + F.col("n_ab")]
    c = [x + 0.5 for x in cells]
    return named.select(
        F.when(swap, F.col("y")).otherwise(F.col("x")).alias("entity_a"), F.when(swap, F.col("x")).otherwise(F.col("y")).alias("entity_b"), "n_ab",
        F.when(swap, F.col("n_y")).otherwise(F.col("n_x")).alias("n_a"), F.when(swap, F.col("n_x")).otherwise(F.col("n_y")).alias("n_b"), F.lit(total).cast("bigint").alias("n_all"),
    ).withColumn("lift", F.col("n_ab") * F.col("n_all") / (F.col("n_a") * F.col("n_b"))).withColumn("log_odds", F.log(c[0] * c[3] / (c[1] * c[2])))
