"""Parent-child links of unknown depth to full hierarchies, by pointer doubling.

Every row points at its parent. Each round replaces a pointer by the pointer of the row it points at, so that the
distance jumped doubles; a row is done once its pointer is a root. After about log2(depth) rounds all rows that have a
root are done. A round that finishes no row proves that the rest loops: of the rows at the least unfinished depth, some
would have been finished by it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parleyspark.functions.keys import pack_key, unpack_key
from parleyspark.plans.stage import Stage

#: Rows that still wander are broadcast only while their measured size, with 60 bytes a row for the rest, is at most this.
BROADCAST_BYTES = 4_000_000


def _parents(rows: DataFrame, id_col: str, parent_col: str, flag: str | None) -> DataFrame:
    key, up = pack_key(F.col(id_col).cast("string")), pack_key(F.col(parent_col).cast("string"))
    picked = rows.select(key.alias("id"), up.alias("parent"), (F.col(flag) if flag else F.lit(True)).alias("ok"))
    return picked.where("id is not null").groupBy("id").agg(F.min("parent").alias("parent"), F.min("ok").alias("ok"))


def point_at_roots(nodes: DataFrame, with_path: bool = False, tag: bool = False) -> DataFrame:
    """Resolve (id unique, parent of the same type, ok BOOLEAN[, tag]) to (id, root, depth BIGINT, ok BOOLEAN[, path][, tag]).

    A parent that isn't an id makes a root. ``ok`` holds if it holds for the row and all its ancestors. Looping rows have
    root NULL and depth -1. ``path`` holds the ids from the root to the row, and only the row where it loops.
    """
    base = Stage(nodes)
    path = [F.array("id").alias("path")] if with_path else []
    kept = ["tag"] if tag else []
    there = base.df.select(F.col("id").alias("p_id"), F.col("parent").isNotNull().alias("p_up"), F.col("ok").alias("p_ok"))
    n = base.df.where("parent is not null").join(there, F.col("parent") == F.col("p_id"), "left")
    # A row points at its parent; whether that is a root is known for sure only where it has no parent of its own.
    first = n.select(
        "id", F.coalesce("p_id", "id").alias("ptr"), F.when(F.col("p_id").isNull(), 0).otherwise(1).cast("bigint").alias("depth"),
        (F.col("p_id").isNull() | ~F.col("p_up")).alias("done"), (F.col("ok") & F.coalesce("p_ok", F.lit(True))).alias("ok"), *kept,
        *([F.when(F.col("p_id").isNull(), F.array("id")).otherwise(F.array("p_id", "id")).alias("path")] if with_path else []),
    )
    roots = base.df.where("parent is null").select("id", F.col("id").alias("ptr"), F.lit(0).cast("bigint").alias("depth"), F.lit(True).alias("done"), "ok", *kept, *path)
    packed = nodes.schema["id"].dataType.simpleString() in ("binary", "string")
    width = F.lit(60) + (F.octet_length("id") + F.octet_length("ptr") if packed else F.lit(16))
    if with_path:
        width = width + F.aggregate("path", F.lit(0), lambda n, x: n + 16 + (F.octet_length(x) if packed else F.lit(8)))
    # how many rows still move, and their size: counted while they are written
    measure = {"now": F.count_if(~F.col("done")), "size": F.coalesce(F.sum(F.when(~F.col("done"), width)), F.lit(0))}
    state = Stage(first.unionByName(roots), measure=measure)
    base.drop()
    left, finished = None, [state]
    # ``finished`` holds the written tables of which each has the final rows of one round; ``open_`` the rows still moving.
    open_ = state
    known = state.df
    cores = nodes.sparkSession.sparkContext.defaultParallelism
    while True:
        moving = open_.df.where("not done")
        now, size = open_.measured["now"], open_.measured["size"]
        if not now or now == left:
            break
        left = now
        # what a pointer leads to: one row for each id, in its latest state
        look = known.select(F.col("id").alias("t_id"), F.col("ptr").alias("t_ptr"), F.col("depth").alias("t_depth"), F.col("done").alias("t_done"), F.col("ok").alias("t_ok"), *([F.col("path").alias("t_path")] if with_path else []))
        small = size <= BROADCAST_BYTES
        moved = look.join(F.broadcast(moving) if small else moving, F.col("ptr") == F.col("t_id")).select(
            "id", F.col("t_ptr").alias("ptr"), (F.col("depth") + F.col("t_depth")).alias("depth"), F.col("t_done").alias("done"), (F.col("ok") & F.col("t_ok")).alias("ok"), *kept,
            *([F.concat("t_path", F.slice("path", 2, 2**30)).alias("path")] if with_path else []),
        )
        # a broadcast join keeps the partitions of all tables so far; their few rows need no more tasks and files than cores
        step = Stage(moved.coalesce(cores) if small else moved, measure=measure)
        finished.append(step)
        open_ = step
        # rows that moved replace their former state: those of earlier tables count only where they were done
        known = finished[0].df.where("done")
        for s in finished[1:-1]:
            known = known.unionByName(s.df.where("done"))
        known = known.unionByName(step.df)
    out = finished[0].df.where("done")
    for s in finished[1:]:
        out = out.unionByName(s.df.where("done"))
    done = out.select("id", F.col("ptr").alias("root"), "depth", "ok", *kept, *(["path"] if with_path else []))
    loops = open_.df.where("not done").select("id", F.lit(None).cast(nodes.schema["id"].dataType).alias("root"), F.lit(-1).cast("bigint").alias("depth"), "ok", *kept, *path)
    return done.unionByName(loops)


def hierarchy(rows: DataFrame, id_col: str = "uuid", parent_col: str = "parent_message_uuid", with_path: bool = False) -> DataFrame:
    """One row for each distinct id: (id, root, depth[, path]).

    Repeated ids count once, with the least of their parents; rows with a null id are left out; a parent that is null or
    isn't in the table makes a root of depth 0; a row whose parents never end gets root '' and depth -1 (and a path of
    itself alone). Empty tables give an empty result. Other columns, whatever their names, don't matter.
    """
    found = point_at_roots(_parents(rows, id_col, parent_col, None), with_path)
    path = [F.transform("path", unpack_key).alias("path")] if with_path else []
    return found.select(unpack_key(F.col("id")).alias("id"), F.coalesce(unpack_key(F.col("root")), F.lit("")).alias("root"), "depth", *path)


def descendants(rows: DataFrame, id_col: str = "uuid", parent_col: str = "parent_message_uuid") -> DataFrame:
    """One row for each pair of a node and one below it: (ancestor, descendant, distance). Looping rows are in none.

    The rows are the links of the paths, so the result is as large as the sum of the depths and no larger; each path is
    taken apart where it is, without a join or a shuffle.
    """
    t = hierarchy(rows, id_col, parent_col, with_path=True).where("depth > 0")
    t = t.select(F.col("id").alias("descendant"), "depth", F.posexplode("path").alias("at", "ancestor"))
    return t.where("at < depth").select("ancestor", "descendant", (F.col("depth") - F.col("at")).cast("bigint").alias("distance"))


def descendant_counts(rows: DataFrame, id_col: str = "uuid", parent_col: str = "parent_message_uuid") -> DataFrame:
    """hierarchy() with the path joined by '/' and the number of descendants of every row: (id, root, depth, path, n_descendants)."""
    full = Stage(hierarchy(rows, id_col, parent_col, with_path=True)).df
    below = full.where("depth > 0").select(F.explode(F.slice("path", 1, F.size("path") - 1)).alias("id")).groupBy("id").agg(F.count("*").alias("n_descendants"))
    return full.join(below, "id", "left").select("id", "root", "depth", F.array_join("path", "/").alias("path"), F.coalesce("n_descendants", F.lit(0)).cast("bigint").alias("n_descendants"))
