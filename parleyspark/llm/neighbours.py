"""The most similar vectors of every vector, by learned partitions.

A node of the index holds the rows of one part. On a bounded sample of its rows, drawn seeds and the K nearest of all its rows to
each of them (so that the sample is as dense around its seeds as the collection): a graph of nearest neighbours, cut into balanced parts of few crossing links by recursive bisection and swaps; then a small network that predicts, from a vector,
in which of the parts its neighbours lie. The network routes all rows: each is stored in its most probable part and searches
every part whose probability reaches a bound. That bound is measured: with it, held-out seeds find RECALL of their nearest ones. A node has at most FAN parts; parts of more than LEAF_MAX rows are nodes themselves, so that the number
of parts grows with the collection: FAN times as many rows make one more level, and the rows of a part stay as few. Candidates
are reranked by exact cosine. Every row is indexed and every row searches.

Neighbouring parts of one node travel together in cells of about CELL rows; in a cell a row is compared with the parts it
searches only. Cells of any size are split into blocks of at most BLOCK rows, and blocks meet the queries of their cell block
by block, so that no task holds an unbounded part, however many equal vectors there are; the best k of each meeting are merged.

Defined cases: of the rows of one key the latest counts, whatever its model; it takes part only if its vector has the
model's length, finite numbers and is not all zero; ties of similarity go to the smaller key; fewer than k others give
fewer pairs; an empty table gives an empty result; fewer than 2 * LEAF vectors of a model are a single part, all compared.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parleyspark.functions.keys import instant, pack_key, unpack_key
from parleyspark.plans.stage import Stage

K = 5
#: Rows of a node that its parts and its network are fitted on, at most about: seeds and their neighbours. More levels make more nodes, not larger samples.
SAMPLE, INNER_SAMPLE = 9_000, 6_000
#: Parts of a node, at most (a row's parts within a cell are the bits of one BIGINT); rows of a part, at least, and at most before it becomes a node.
FAN, LEAF, LEAF_MAX = 64, 250, 2_000
#: Share of their nearest vectors that held-out rows of a sample must find.
RECALL = 0.98
#: Rows that travel together, about.
CELL = 2_500
#: Stored rows, and searching rows, that meet in one task.
BLOCK = 8_000
#: The models and the lengths of their vectors.
MODELS = {"embed-lite-64": 64, "embed-mini-32": 32}


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest others of each row of unit vectors, (n, k)."""
    out = np.empty((len(x), k), np.int64)
    x = x.astype(np.float32)
    for i in range(0, len(x), 256):
        s = x[i : i + 256] @ x.T
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -np.inf
        out[i : i + 256] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 30) -> np.ndarray:
    """A part for each row; sizes differ by at most a few rows. Bisections start from the main direction, then pairs of
    rows swap sides as long as that cuts fewer links."""
    part = np.zeros(len(x), np.int64)
    done = 1
    n, k = graph.shape
    src, dst = np.repeat(np.arange(n), k), graph.ravel()
    while done < parts:
        for p in range(done):
            rows = np.flatnonzero(part == p)
            if len(rows) < 4:
                continue
            centred = x[rows] - x[rows].mean(0)
            axis = np.linalg.eigh(centred.T @ centred)[1][:, -1]
            order = np.argsort(centred @ axis, kind="stable")
            side = np.zeros(n, np.int8)
            side[rows] = -1
            side[rows[order[len(rows) // 2 :]]] = 1
            inner = (side[src] != 0) & (side[dst] != 0)
            a, b = src[inner], dst[inner]
            step = max(1, len(rows) // 8)
            for _ in range(rounds):
                pull = np.bincount(a, side[b], n) + np.bincount(b, side[a], n)
                gain = -pull * side
                left, right = rows[side[rows] < 0], rows[side[rows] > 0]
                left, right = left[np.argsort(-gain[left], kind="stable")[:step]], right[np.argsort(-gain[right], kind="stable")[:step]]
                m = min(len(left), len(right))
                good = gain[left[:m]] + gain[right[:m]] > 0
                if not good.any():
                    break
                side[left[:m][good]], side[right[:m][good]] = 1, -1
                step = max(1, step * 3 // 4)
            part[rows[side[rows] > 0]] = p + done
        done *= 2
    return part


class Router:
    """A network of one hidden layer: the probability of each part for a vector."""

    def __init__(self, weights: list[np.ndarray]):
        self.weights = weights

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        z = np.maximum(x @ w1 + b1, 0) @ w2 + b2
        z -= z.max(1, keepdims=True)
        e = np.exp(z)
        return e / e.sum(1, keepdims=True)

    @staticmethod
    def fit(x: np.ndarray, target: np.ndarray, hidden: int = 192, epochs: int = 25, batch: int = 256, rate: float = 3e-3, seed: int = 7) -> Router:
        rng = np.random.default_rng(seed)
        d, p = x.shape[1], target.shape[1]
        w = [rng.normal(0, 1.4, (d, hidden)) * (2 / d) ** 0.5, np.zeros(hidden), rng.normal(0, (1 / hidden) ** 0.5, (hidden, p)), np.zeros(p)]
        first, second = [np.zeros_like(v) for v in w], [np.zeros_like(v) for v in w]
        t, steps = 0, epochs * -(-len(x) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), batch):
                rows = order[i : i + batch]
                xb = x[rows]
                h = np.maximum(xb @ w[0] + w[1], 0)
                z = h @ w[2] + w[3]
                z = np.exp(z - z.max(1, keepdims=True))
                delta = (z / z.sum(1, keepdims=True) - target[rows]) / len(rows)
                back = (delta @ w[2].T) * (h > 0)
                grads = [xb.T @ back, back.sum(0), h.T @ delta, delta.sum(0)]
                t += 1
                lr = rate * (1 - t / (steps + 1))
                for v, g, m1, m2 in zip(w, grads, first, second, strict=True):
                    m1 += 0.1 * (g - m1)
                    m2 += 0.001 * (g * g - m2)
                    v -= lr * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)
        return Router([v.astype(np.float32) for v in w])


def fit_node(x: np.ndarray, own: np.ndarray, weight: np.ndarray, drawn: np.ndarray, parts: int, recall: float, k: int = 8, seed: int = 7) -> tuple[Router, float] | None:
    """Router and bound of probability of a node, from a sample of unit vectors that enter it: ``own`` marks those stored there, ``weight`` is the
    probability with which each got here, ``drawn`` the seeds. None if the node isn't split."""
    rng = np.random.default_rng(seed)
    stored = np.flatnonzero(own)
    while parts > 1 and parts * 2 * k > len(stored):
        parts //= 2
    if parts == 1:
        return None
    test = drawn & (rng.random(len(x)) < 0.25)
    learn = np.flatnonzero(own & ~test)
    others = np.flatnonzero(~own & ~test)
    graph = neighbour_graph(x[learn], k)
    part = balanced_parts(x[learn].astype(np.float64), graph, parts)
    rows = np.r_[learn, others]
    links = np.r_[graph, _nearest(x[others], x[learn], k)]
    target = np.zeros((len(rows), parts))
    target[np.arange(len(learn)), part] = 1.0
    np.add.at(target, (np.repeat(np.arange(len(rows)), k), part[links.ravel()]), 1.0)
    router = Router.fit(x[rows], target / target.sum(1, keepdims=True))
    held = np.flatnonzero(test)
    if not len(held):
        return router, 0.0
    # the probability of the parts that hold the nearest ones of rows the network hasn't seen
    home = router.probabilities(x[learn]).argmax(1)
    near = _nearest(x[held], x[learn], min(K, len(learn)))
    got = (router.probabilities(x[held]) * weight[held, None])[np.arange(len(held))[:, None], home[near]].ravel()
    w = np.repeat(weight[held], near.shape[1])
    order = np.argsort(got, kind="stable")
    lost = np.cumsum(w[order])
    return router, float(got[order[np.searchsorted(lost, (1 - recall) * lost[-1])]])


def _nearest(q: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest rows of x for each row of q."""
    out = np.empty((len(q), k), np.int64)
    for i in range(0, len(q), 256):
        out[i : i + 256] = np.argpartition(-(q[i : i + 256].astype(np.float32) @ x.T.astype(np.float32)), k - 1, axis=1)[:, :k]
    return out


def plan(n: int) -> list[int]:
    """Parts of the nodes of each level, for n rows of a model."""
    fans, size = [], n
    while size > LEAF_MAX or (not fans and size >= 2 * LEAF):
        fan = 1
        while fan < FAN and size // (fan * 2) >= LEAF:
            fan *= 2
        fans.append(fan)
        size = -(-size // fan)
    return fans


def usable(rows: DataFrame, models: dict[str, int] = MODELS) -> DataFrame:
    """(key BINARY, model, v ARRAY<FLOAT>) of the vectors that take part."""
    version = F.max(F.struct(instant(F.col("created_at")).alias("at"), F.col("model").alias("model"), F.col("embedding").cast("array<double>").alias("v"))).alias("last")
    last = rows.where("uuid is not null").groupBy(pack_key(F.col("uuid")).alias("key")).agg(version).select("key", "last.model", "last.v")
    length = F.create_map(*[F.lit(x) for kv in models.items() for x in kv])[F.col("model")]
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    peak = F.array_max(F.transform("v", lambda x: F.abs(x)))
    # only numbers that a FLOAT can't hold are scaled; directions stay
    scaled = F.when((peak > 1e30) | (peak < 1e-30), F.transform("v", lambda x: x / peak)).otherwise(F.col("v"))
    return last.where((F.size("v") == length) & ~bad & F.exists("v", lambda x: x != 0)).select("key", "model", scaled.cast("array<float>").alias("v"))


def _matrix(column, dim: int) -> np.ndarray:
    """Unit vectors of an Arrow list column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return _unit(column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64))


def _best(left: pa.Table, right: pa.Table, k: int) -> pa.Table:
    """The k best stored rows (left) of each searching row (right) of one meeting, among the parts that it searches."""
    names = ["q", "b", "sim"]
    kinds = [pa.binary(), pa.binary(), pa.float64()]
    if not left.num_rows or not right.num_rows:
        return pa.table([pa.array([], t) for t in kinds], names=names)
    dim = len(left["v"][0])
    keys = np.array(left["key"].to_pylist(), dtype=object)
    order = np.argsort(keys, kind="stable")
    keys, x, leaf = keys[order], _matrix(left["v"], dim)[order], left["leaf"].to_numpy()[order]
    q_keys, y, masks = np.array(right["q_key"].to_pylist(), dtype=object), _matrix(right["q_v"], dim), right["leaves"].to_numpy()
    place = {key: i for i, key in enumerate(keys)}
    own = np.array([place.get(key, -1) for key in q_keys])
    rows, stored, sims = [], [], []
    for part in np.unique(leaf):
        at = np.flatnonzero(leaf == part)
        asked = np.flatnonzero(masks >> part & 1)
        m = min(k, len(at))
        for i in range(0, len(asked), 512):
            q = asked[i : i + 512]
            s = np.round(y[q] @ x[at].T, 11)
            mine = np.searchsorted(at, own[q])
            hit = np.flatnonzero((own[q] >= 0) & (at[np.minimum(mine, len(at) - 1)] == own[q]))
            s[hit, mine[hit]] = -9
            # of equal similarities the smaller key, as the rows are in the order of their keys
            top = np.argpartition(np.arange(len(at)) * 1e-15 - s, m - 1, axis=1)[:, :m]
            rows.append(np.repeat(q, m)), stored.append(at[top].ravel()), sims.append(np.take_along_axis(s, top, 1).ravel())
    if not rows:
        return pa.table([pa.array([], t) for t in kinds], names=names)
    rows, stored, sims = np.concatenate(rows), np.concatenate(stored), np.concatenate(sims)
    order = np.lexsort((stored, -sims, rows))
    rows, stored, sims = rows[order], stored[order], sims[order]
    rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
    good = (rank < k) & (sims > -9)
    return pa.table([pa.array(q_keys[rows[good]], pa.binary()), pa.array(keys[stored[good]], pa.binary()), pa.array(sims[good])], names=names)


_PROBES = "array<struct<part:bigint,leaves:bigint,p:float>>"


def _route(x: np.ndarray, p_before: np.ndarray, parent: int, fit: tuple[Router, float] | None, cells: int) -> tuple[np.ndarray, ...]:
    """Most probable child of each row; and the children it searches, most probable first, as (counts, part, leaves, p) of flat arrays. In the last level (``cells`` > 0)
    the children of one cell are one entry, its bits the children; the cell of a child is its low bits, which were its first bisections."""
    n = len(x)
    if fit is None:
        p = np.ones((n, 1), np.float32)
        use = np.ones((n, 1), bool)
    else:
        p = fit[0].probabilities(x.astype(np.float32))
        use = p * p_before[:, None] >= fit[1]
    home = p.argmax(1)
    use[np.arange(n), home] = True
    if not cells:
        row, child = np.nonzero(use)
        return home, np.bincount(row, minlength=n), parent * FAN + child, np.zeros(len(row), np.int64), p[row, child] * p_before[row]
    bits = np.zeros((n, cells), np.int64)
    for c in range(p.shape[1]):
        bits[:, c % cells] |= use[:, c].astype(np.int64) << c
    row, cell = np.nonzero(bits)
    return home, np.bincount(row, minlength=n), parent * FAN + cell, bits[row, cell], np.ones(len(row))


def _probes(counts, part, leaves, p) -> pa.Array:
    entries = pa.StructArray.from_arrays([pa.array(part.astype(np.int64)), pa.array(leaves.astype(np.int64)), pa.array(p.astype(np.float32))], names=["part", "leaves", "p"])
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), entries)


class _Level:
    """One level of the index: for each model its parts, whether it is the last, and the cells of a node."""

    def __init__(self, fans: dict[str, list[int]], sizes: dict[str, int], depth: int):
        self.fan = {m: f[depth] if depth < len(f) else 1 for m, f in fans.items()}
        self.last = {m: depth >= len(f) - 1 for m, f in fans.items()}
        self.cells = {}
        for m, f in fans.items():
            rows, cells = sizes[m], 1
            for fan in f[:depth]:
                rows //= fan
            while cells < self.fan[m] and rows // (cells * 2) >= CELL:
                cells *= 2
            self.cells[m] = cells if self.last[m] else 0
        self.recall = {m: RECALL ** (1 / max(1, len(f))) for m, f in fans.items()}


class _Nearest:
    """The K rows nearest to each of some seeds, of rows that come batch by batch."""

    def __init__(self, keys: list[bytes], x: np.ndarray):
        self.keys, self.x, self.place = keys, x.astype(np.float32), {k: i for i, k in enumerate(keys)}
        self.sims = np.full((len(keys), K), -9, np.float32)
        self.rows = np.full((len(keys), K), -1, np.int64)
        self.found_keys, self.found, self.n = [], [], 0

    def add(self, keys: list[bytes], v) -> None:
        s = self.x @ _matrix(v, self.x.shape[1]).astype(np.float32).T
        for j, key in enumerate(keys):
            if (i := self.place.get(key)) is not None:
                s[i, j] = -9
        m = min(K, s.shape[1])
        top = np.argpartition(-s, m - 1, axis=1)[:, :m]
        sims, rows = np.c_[self.sims, np.take_along_axis(s, top, 1)], np.c_[self.rows, top + self.n]
        best = np.argsort(-sims, axis=1, kind="stable")[:, :K]
        self.sims, self.rows = np.take_along_axis(sims, best, 1), np.take_along_axis(rows, best, 1)
        # only rows that are among the nearest so far are kept
        used = np.unique(self.rows[self.rows >= self.n]) - self.n
        self.found_keys.append((self.n + used, [keys[i] for i in used])), self.found.append(v.take(pa.array(used)))
        self.n += len(keys)

    def table(self, model: str, part: int) -> pa.Table:
        names = ["model", "part", "seed", "sim", "key", "v"]
        at = {int(i): (b, k) for b, (rows, _) in enumerate(self.found_keys) for k, i in enumerate(rows)}
        good = self.rows >= 0
        seeds, where = np.nonzero(good)[0], [at[int(i)] for i in self.rows[good]]
        starts = np.cumsum([0, *(len(x) for x in self.found)])
        every = pa.chunked_array([c for x in self.found for c in (x.chunks if isinstance(x, pa.ChunkedArray) else [x])], pa.list_(pa.float32()))
        v = every.take(pa.array([int(starts[b]) + k for b, k in where], pa.int64()))
        columns = [pa.array([model] * len(seeds), pa.string()), pa.array([part] * len(seeds), pa.int64()), pa.array([self.keys[i] for i in seeds], pa.binary()), pa.array(self.sims[good]), pa.array([self.found_keys[b][1][k] for b, k in where], pa.binary()), v]
        return pa.table(columns, names=names)


_FOUND = "model string, part bigint, seed binary, sim float, key binary, v array<float>"


def _sample(asking: DataFrame, limit: int, top: bool) -> DataFrame:
    """(model, part, own, p, drawn, key, v): seeds of each node among the rows that enter it, and the K stored rows nearest to each."""
    enter = asking.groupBy("model", "part").agg(F.count("*").alias("n"))
    rows = asking.join(enter, ["model", "part"])
    seeds = rows.where(F.pmod(F.xxhash64("key", F.lit(5)), F.lit(1 << 20)) < F.lit((limit << 20) // (K + 1)) / F.col("n"))
    seeds = Stage(seeds.select("model", "part", "own", "p", F.lit(True).alias("drawn"), "key", "v"), dictionary=False).df
    if top:
        # one node a model: its seeds go to where the rows are
        given = {}
        for r in seeds.select("model", "key", "v").toLocalIterator():
            given.setdefault(r["model"], ([], []))
            given[r["model"]][0].append(bytes(r["key"])), given[r["model"]][1].append(r["v"])
        given = {m: (keys, _unit(np.array(v, np.float64))) for m, (keys, v) in given.items()}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = {m: _Nearest(*g) for m, g in given.items()}
            for b in batches:
                names = np.array(b.column(0).to_pylist(), dtype=object)
                for m in sorted(set(names) & set(held)):
                    t = pa.Table.from_batches([b]).filter(pa.array(names == m))
                    held[m].add(t["key"].to_pylist(), t["v"].combine_chunks())
            for m, h in held.items():
                if h.n:
                    yield from h.table(m, 0).to_batches()

        found = asking.where("own").select("model", "key", "v").mapInArrow(run, _FOUND)
    else:
        blocks = asking.where("own").groupBy("model", "part").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n_b"))
        node = ["model", "part", "block"]
        left = asking.where("own").join(blocks, ["model", "part"]).select("model", "part", F.pmod(F.xxhash64("key"), "n_b").cast("int").alias("block"), "key", "v")
        right = seeds.join(blocks, ["model", "part"]).select(F.col("model").alias("s_model"), F.col("part").alias("s_part"), F.explode(F.sequence(F.lit(0), F.col("n_b") - 1)).alias("s_block"), F.col("key").alias("s_key"), F.col("v").alias("s_v"))

        def meet(a: pa.Table, b: pa.Table) -> pa.Table:
            if not a.num_rows or not b.num_rows:
                return pa.schema([("model", pa.string()), ("part", pa.int64()), ("seed", pa.binary()), ("sim", pa.float32()), ("key", pa.binary()), ("v", pa.list_(pa.float32()))]).empty_table()
            h = _Nearest(b["s_key"].to_pylist(), _matrix(b["s_v"], len(b["s_v"][0])))
            h.add(a["key"].to_pylist(), a["v"].combine_chunks())
            return h.table(a["model"][0].as_py(), a["part"][0].as_py())

        found = left.groupBy(*node).cogroup(right.groupBy("s_model", "s_part", "s_block")).applyInArrow(meet, _FOUND)
    rank = F.row_number().over(Window.partitionBy("model", "part", "seed").orderBy(F.desc("sim"), "key"))
    near = found.withColumn("r", rank).where(F.col("r") <= K).join(seeds.select("model", "part", "key"), ["model", "part", "key"], "left_anti")
    near = near.groupBy("model", "part", "key").agg(F.first("v").alias("v")).select("model", "part", F.lit(True).alias("own"), F.lit(1.0).cast("float").alias("p"), F.lit(False).alias("drawn"), "key", "v")
    return seeds.unionByName(near)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; the largest number first, so that squares can't overflow or vanish."""
    x = x / np.maximum(np.abs(x).max(1, keepdims=True), 1e-300) if len(x) else x
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _fits(asking: DataFrame, level: _Level, limit: int, top: bool = False) -> DataFrame:
    """(model, part, fit BINARY): the routers of the nodes of a level, each from a sample of the rows that enter it."""
    drawn = _sample(asking, limit, top)

    def fit(t: pa.Table) -> pa.Table:
        # the order of the rows must not depend on the shuffle
        t = t.sort_by("key")
        model = t["model"][0].as_py()
        x = _matrix(t["v"], len(t["v"][0])).astype(np.float32)
        got = fit_node(x, t["own"].to_numpy().astype(bool), t["p"].to_numpy().astype(np.float64), t["drawn"].to_numpy().astype(bool), level.fan[model], level.recall[model])
        return pa.table([pa.array([model]), t["part"].slice(0, 1).combine_chunks(), pa.array([pickle.dumps(got)], pa.binary())], names=["model", "part", "fit"])

    return drawn.groupBy("model", "part").applyInArrow(fit, "model string, part bigint, fit binary")


_ENTRY = pa.list_(pa.struct([("part", pa.int64()), ("leaves", pa.int64()), ("p", pa.float32())]))
_NOTHING = pa.schema([("key", pa.binary()), ("model", pa.string()), ("v", pa.list_(pa.float32())), ("own", pa.bool_()), ("home", pa.int64()), ("leaf", pa.int32()), ("probes", _ENTRY)]).empty_table()
_ROUTED = f"key binary, model string, v array<float>, own boolean, home bigint, leaf int, probes {_PROBES}"


def _routed(model: str, part: int, key, v, own: np.ndarray, p: np.ndarray, fit, level: _Level) -> pa.Table:
    cells = level.cells[model]
    home, counts, child, leaves, p_child = _route(_matrix(v, len(v[0])), p, part, fit, cells)
    place = part * FAN + (home % cells if cells else home)
    columns = [key, pa.array([model] * len(home)), v, pa.array(own), pa.array(place.astype(np.int64)), pa.array(home.astype(np.int32)), _probes(counts, child, leaves, p_child)]
    return pa.table([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], names=["key", "model", "v", "own", "home", "leaf", "probes"])


def _first_level(rows: DataFrame, fits: dict[str, tuple | None], level: _Level) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = np.array(b.column(1).to_pylist(), dtype=object)
            for model in sorted(set(names)):
                t = pa.Table.from_batches([b]).filter(pa.array(names == model))
                n = t.num_rows
                yield from _routed(model, 0, t["key"], t["v"], np.ones(n, bool), np.ones(n), fits[model], level).to_batches()

    return rows.select("key", "model", "v").mapInArrow(run, _ROUTED)


def _next_level(asking: DataFrame, fits: DataFrame, level: _Level) -> DataFrame:
    """The entering rows of each node, block by block, meet the node's router."""
    blocks = asking.groupBy("model", "part").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n"))
    node = ["model", "part", "block"]
    routers = fits.join(blocks, ["model", "part"]).select("model", "part", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("block"), "fit")
    rows = asking.join(blocks, ["model", "part"]).select("model", "part", F.pmod(F.xxhash64("key"), "n").cast("int").alias("block"), "key", "v", "own", "p")

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows:
            return _NOTHING
        fit = pickle.loads(b["fit"][0].as_py()) if b.num_rows else None
        return _routed(a["model"][0].as_py(), a["part"][0].as_py(), a["key"], a["v"], a["own"].to_numpy().astype(bool), a["p"].to_numpy().astype(np.float64), fit, level)

    routers = routers.select(*[F.col(c).alias(f"r_{c}") for c in node], "fit")
    return rows.groupBy(*node).cogroup(routers.groupBy(*[f"r_{c}" for c in node])).applyInArrow(run, _ROUTED)


def _asking(routed: DataFrame) -> DataFrame:
    """A row for each part that a row enters."""
    one = routed.select("key", "model", "v", "own", "home", F.explode("probes").alias("e"))
    return one.select("key", "model", "v", (F.col("own") & (F.col("e.part") == F.col("home"))).alias("own"), F.col("e.part").alias("part"), F.col("e.leaves").alias("leaves"), F.col("e.p").alias("p"))


def index(v: DataFrame, models: dict[str, int]) -> DataFrame:
    """Every row with its place (``home``, ``leaf``; of the rows marked ``own``) and the cells and parts that it searches."""
    sizes = {m: 0 for m in models} | {r["model"]: r["n"] for r in v.groupBy("model").agg(F.count("*").alias("n")).collect()}
    fans = {m: plan(n) for m, n in sizes.items()}
    level = _Level(fans, sizes, 0)
    top = v.where(F.col("model").isin([m for m, f in fans.items() if f])).select("key", "model", "v", F.lit(True).alias("own"), F.lit(0).cast("bigint").alias("part"), F.lit(1.0).cast("float").alias("p"))
    # one router a model
    fits = {m: None for m in models} | {r["model"]: pickle.loads(r["fit"]) for r in _fits(top, level, SAMPLE, top=True).collect()}
    out, routed = None, Stage(_first_level(v, fits, level), dictionary=False).df
    depth = 1
    while any(len(f) > depth for f in fans.values()):
        deeper = F.col("model").isin([m for m, f in fans.items() if len(f) > depth])
        done = routed.where(~deeper)
        out = done if out is None else out.unionByName(done)
        asking = Stage(_asking(routed.where(deeper)), dictionary=False).df
        level = _Level(fans, sizes, depth)
        routed = Stage(_next_level(asking, _fits(asking, level, INNER_SAMPLE), level), dictionary=False).df
        depth += 1
    return routed if out is None else out.unionByName(routed)


def _crowds(v: DataFrame, k: int) -> DataFrame:
    """(model, h1, h2, rep, edge) of the vectors that more than k + 1 rows share: their least key and the one k places on."""
    many = v.groupBy("model", "h1", "h2").agg(F.count("*").alias("n")).where(F.col("n") > k + 1).drop("n")
    rank = F.row_number().over(Window.partitionBy("model", "h1", "h2").orderBy("key"))
    first = v.select("model", "h1", "h2", "key").join(many, ["model", "h1", "h2"]).withColumn("rank", rank).where(F.col("rank") <= k + 1)
    return first.groupBy("model", "h1", "h2").agg(F.min("key").alias("rep"), F.max("key").alias("edge"))


def most_similar(rows: DataFrame, k: int = K, models: dict[str, int] = MODELS) -> DataFrame:
    """(uuid, other, model, rank, similarity): the k most similar others of every vector.

    Of equal vectors only the k + 1 rows of the least keys can be among anyone's k nearest: the others aren't put into the
    index, and take their results from the first. A third of all rows in one vector thus costs one pass, not all its pairs.
    """
    v = Stage(usable(rows, models).withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(9), "v")}), dictionary=False).df
    crowds = Stage(_crowds(v, k)).df
    named = [unpack_key(F.col("q")).alias("uuid"), unpack_key(F.col("b")).alias("other"), "model", "rank", F.col("sim").alias("similarity")]
    if crowds.isEmpty():
        return _search(v.select("key", "model", "v"), k, models).select(*named)
    met = _search(Stage(v.join(crowds, ["model", "h1", "h2"], "left").where("edge is null or key <= edge").select("key", "model", "v"), dictionary=False).df, k, models)
    met = Stage(met).df
    late = v.select("model", "h1", "h2", "key").join(crowds, ["model", "h1", "h2"]).where("key > edge").select("key", "rep", "model")
    lists = met.join(crowds.select(F.col("rep").alias("q")), "q", "left_semi").groupBy(F.col("q").alias("rep")).agg(F.collect_list(F.struct((-F.col("sim")).alias("less"), "b")).alias("found"))
    # at most k entries and the row itself
    found = F.slice(F.array_sort(F.concat("found", F.array(F.struct(F.lit(-1.0).alias("less"), F.col("rep").alias("b"))))), 1, k)
    more = late.join(lists, "rep").select(F.col("key").alias("q"), "model", F.posexplode(found).alias("i", "e")).select("model", "q", F.col("e.b").alias("b"), (-F.col("e")["less"]).alias("sim"), (F.col("i") + 1).alias("rank"))
    return met.unionByName(more).select(*named)


def _search(v: DataFrame, k: int, models: dict[str, int]) -> DataFrame:
    """(model, q, b, sim, rank)"""
    routed = index(v, models)
    stored = routed.where("own").groupBy("model", F.col("home").alias("cell")).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n_b"))
    asked = routed.select("model", F.explode("probes.part").alias("cell")).groupBy("model", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n_q"))
    # a row for each cell, of CELL rows: small, but growing with the data; Spark broadcasts it only below its own bound
    grid = Stage(stored.join(asked, ["model", "cell"])).df
    meeting = ["model", "cell", "b_block", "q_block"]
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    base = routed.where("own").select("model", F.col("home").alias("cell"), "leaf", "key", "v").join(grid, ["model", "cell"])
    base = base.select("model", "cell", F.pmod(F.xxhash64("key"), "n_b").cast("int").alias("b_block"), spread("n_q").alias("q_block"), "leaf", "key", "v")
    asking = _asking(routed).select("model", F.col("part").alias("cell"), "leaves", F.col("key").alias("q_key"), F.col("v").alias("q_v")).join(grid, ["model", "cell"])
    asking = asking.select("model", "cell", spread("n_b").alias("b_block"), F.pmod(F.xxhash64("q_key"), "n_q").cast("int").alias("q_block"), "leaves", "q_key", "q_v")
    met = base.groupBy(*meeting).cogroup(asking.select(*[F.col(c).alias(f"q_{c}") for c in meeting], "leaves", "q_key", "q_v").groupBy(*[f"q_{c}" for c in meeting])).applyInArrow(lambda a, b: _met(a, b, k), "model string, q binary, b binary, sim double")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("sim"), "b"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k)


def _met(a: pa.Table, b: pa.Table, k: int) -> pa.Table:
    t = _best(a, b, k)
    model = a["model"][0].as_py() if a.num_rows else None
    return t.add_column(0, "model", pa.array([model] * t.num_rows, pa.string()))
