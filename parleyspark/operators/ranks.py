"""Numbers in a global order, and all pairs within groups, without one task for all rows or for a large group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parleyspark.plans.stage import Stage

#: Rows of one group that are paired in one task; larger groups are paired tile by tile.
TILE = 512


def numbered(df: DataFrame, order: list[Column | str], name: str = "place", first: int = 1) -> DataFrame:
    """``df`` with the place of each row in the given order. Rows are split by ranges and sorted within them; only the number
    of rows of each range meets the driver."""
    t = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    t = Stage(t).df.withColumn("__part", F.shiftright("__at", 33))
    sizes, at, starts = {r[0]: r[1] for r in t.groupBy("__part").count().collect()}, first, []
    for p in sorted(sizes):
        starts.append((p, at))
        at += sizes[p]
    offsets = df.sparkSession.createDataFrame(starts, "__part bigint, __start bigint")
    return t.join(offsets, "__part").withColumn(name, F.col("__start") + F.col("__at").bitwiseAND((1 << 33) - 1)).drop("__at", "__part", "__start")


def within(rows: DataFrame, key: str, member: list[str], tile: int = TILE) -> DataFrame:
    """All pairs of different rows of a key: (key, x, y), structs of the other columns, the one with the smaller ``member`` columns first.

    A group of n rows in n / tile tiles is paired in cells of two tiles each, which are keys of their own: no task has to hold
    or pair a whole large group. Groups of at most ``tile`` rows are one cell.
    """
    size = rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > tile).select(key, F.ceil(F.col("n") / tile).cast("int").alias("w"))
    t = rows.join(Stage(size).df, key, "left").withColumn("w", F.coalesce("w", F.lit(1)))
    # null members hash alike and are told apart by the comparison below
    t = t.withColumn("t", F.pmod(F.xxhash64(*member), F.col("w")).cast("int")).select(key, "w", "t", F.struct(*[c for c in rows.columns if c != key]).alias("row"))
    left = t.select(key, F.col("t").alias("i"), F.explode(F.sequence(F.col("t"), F.col("w") - 1)).alias("j"), F.col("row").alias("x"))
    right = t.select(key, F.explode(F.sequence(F.lit(0), F.col("t"))).alias("i"), F.col("t").alias("j"), F.col("row").alias("y"))
    a, b = (F.struct(*[F.col(f"{s}.{c}") for c in member]) for s in ("x", "y"))
    pairs = left.join(right, [key, "i", "j"]).where((F.col("i") < F.col("j")) | (a < b))
    return pairs.select(key, F.when(a < b, F.col("x")).otherwise(F.col("y")).alias("x"), F.when(a < b, F.col("y")).otherwise(F.col("x")).alias("y"))
