"""Evaluation items that leak into a corpus, by spaced-seed hashing.

A seed is a mask over a window of SPAN words that ignores some positions. The windows of the items are hashed under each mask
into a table of seeds. The corpus is read once, whatever the number of items: the windows of each document are hashed under
the same masks, and those that a Bloom filter of the seeds can't rule out stay, with the hashed words of their document. These
meet the seeds in a join on the hash. Each pair of a document and an item that share a seed is verified on its words: the
longest exact run, and along every diagonal that a shared seed lies on the best overlap that tolerates substitutions. A run
of SPAN equal words is hit under every mask, so none is missed.

Words are runs of letters and digits, without case, in the consistent form of ``lookalike``; they are compared by 64-bit hashes.

Defined cases: null and blank texts hold no words; items of fewer than SPAN words can't be found; repeated rows of a
document or an item give repeated results only if their keys differ; empty tables give empty results.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parleyspark.llm.lookalike import CYRILLIC, GREEK, canonical
from parleyspark.plans.stage import Stage

SPAN = 12
#: 1: the word counts, 0: it may differ.
MASKS = ("110101100111", "111011001011", "101110110101")
#: Bits of the filter, at most: 16 MB. It has 64 bits a seed up to two million seeds; with more it lets more pass, and the join rules them out.
FILTER_BITS = 1 << 27
_PROBES = 3
#: Hashes of words kept in a worker.
_KEPT_WORDS = 500_000
#: Words of documents hashed together in a worker, and words compared together.
_BATCH_WORDS = 1_000_000
#: Words of all items that go to the workers whole (8 bytes each); with more of them, items are joined to their pairs.
SHARED_WORDS = 4_000_000

_WORDS = re.compile(r"[^\W_]+")
#: Small letters without a Latin twin whose capitals have one, each with that twin in small. Ν/ν, Υ/υ and Ӏ/ӏ have a twin in either case, and keep them.
_TWINS = CYRILLIC | GREEK
_SMALL = str.maketrans({c.casefold(): t.casefold() for c, t in _TWINS.items() if c.casefold() not in _TWINS} | {"κ": "k", "к": "k"})
_GREEK_OR_CYRILLIC = re.compile("[Ͱ-ԯἀ-῿]")
_ASCII = bytes(ord(chr(i).lower()) if chr(i).isalnum() and i < 128 else 32 for i in range(256))
_FACTORS = np.array([0x9E3779B97F4A7C15 * (2 * k + 1) ** 3 & 0xFFFFFFFFFFFFFFFF | 1 for k in range(SPAN)], np.uint64)


def words(text: str | None) -> list:
    """The words of a text, as UTF-8."""
    if not text:
        return []
    if text.isascii():
        return text.encode().translate(_ASCII).split()
    form = canonical(text).casefold()
    if _GREEK_OR_CYRILLIC.search(form):
        form = unicodedata.normalize("NFC", unicodedata.normalize("NFD", form).translate(_SMALL))
    return [w.encode() for w in _WORDS.findall(form)]


class Words:
    """64-bit hashes of words, the usual ones remembered."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def codes(self, text: str | None) -> np.ndarray:
        known, ws = self.known, words(text)
        if len(known) > _KEPT_WORDS:
            known.clear()
        for w in ws:
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w)
        return np.fromiter(map(known.__getitem__, ws), np.uint64, len(ws))


def window_hashes(codes: np.ndarray, mask_no: int) -> np.ndarray:
    """The hash of each window of SPAN codes under a mask; masks don't share hashes."""
    n = max(0, len(codes) - SPAN + 1)
    h = np.full(n, mask_no + 1, np.uint64)
    for k in range(SPAN):
        if MASKS[mask_no][k] == "1":
            h += codes[k : k + n] * _FACTORS[k]
            h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(31))


def _progressions(at: np.ndarray) -> list[tuple[int, int, int]]:
    """Sorted positions as (first, step, number): what repeats has few of them."""
    out, i = [], 0
    gaps = np.diff(at)
    while i < len(at):
        if i == len(at) - 1:
            out.append((int(at[i]), 1, 1))
            break
        stop = np.flatnonzero(gaps[i:] != gaps[i])
        n = int(stop[0]) + 1 if len(stop) else len(at) - i
        out.append((int(at[i]), int(gaps[i]), n))
        i += n
    return out


def _places(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """(hash, first place, step, number) of hashes that stand at ascending places."""
    order = np.argsort(h, kind="stable")
    h, at = h[order], at[order]
    starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.empty(0, np.int64)
    size = np.diff(np.r_[starts, len(h)])
    single = starts[size == 1]
    many = [(h[i], *p) for i, n in zip(starts[size > 1], size[size > 1], strict=True) for p in _progressions(at[i : i + n])]
    one = np.ones(len(single), np.int64)
    return np.r_[h[single], np.array([x[0] for x in many], np.uint64)].view(np.int64), *(np.r_[a, np.array([x[k] for x in many], np.int64)].astype(np.int32) for k, a in ((1, at[single]), (2, one), (3, one)))


def _seeds(items: DataFrame) -> DataFrame:
    """(item_id, h, at, step, n, length): the hashed windows of each item and where they stand; and its words, in the row where h is NULL."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashing = Words()
        names = ["item_id", "h", "at", "step", "n", "length", "item_words"]
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                codes = hashing.codes(t.as_py())
                if len(codes) < SPAN:
                    continue
                for m in range(len(MASKS)):
                    h = window_hashes(codes, m)
                    columns = _places(h, np.arange(len(h)))
                    n = len(columns[0])
                    yield pa.RecordBatch.from_arrays([pa.array([i] * n, pa.int64()), *map(pa.array, columns), pa.array([len(codes)] * n, pa.int32()), pa.nulls(n, pa.list_(pa.int64()))], names=names)
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.nulls(1, pa.int64()), *[pa.nulls(1, pa.int32())] * 3, pa.array([len(codes)], pa.int32()), pa.array([codes.view(np.int64)], pa.list_(pa.int64()))], names=names)

    return items.mapInArrow(run, "item_id bigint, h bigint, at int, step int, n int, length int, item_words array<bigint>")


def _filter_places(h: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(h >> np.uint64(s)) & np.uint64(bits - 1) for s in (0, 17, 34)[:_PROBES]]


def _filter(seeds: DataFrame) -> np.ndarray:
    """Bloom filter of the seeds, 64 bits a word: filled in the JVM, of at most FILTER_BITS / 64 rows on the driver."""
    # seeds that stand at several places count as often
    n, bits = seeds.count(), 1 << 16
    while bits < min(FILTER_BITS, 64 * n):
        bits *= 2
    places = F.explode(F.array(*[F.shiftrightunsigned("h", s).bitwiseAND(bits - 1) for s in (0, 17, 34)[:_PROBES]]))
    one = F.expr("shiftleft(1L, cast(place & 63 as int))")
    rows = seeds.select(places.alias("place")).groupBy(F.shiftright("place", 6).alias("at")).agg(F.bit_or(one).alias("word")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[rows["at"].to_numpy()] = rows["word"].to_numpy()
    return out.view(np.uint64)


def _passing(codes: np.ndarray, of: np.ndarray, bloom: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash) of the windows that pass; windows that reach over the end of a document don't count. Masks have no hash in common."""
    n = len(codes) - SPAN + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    whole = of[:n] == of[SPAN - 1 :]
    places, hashes = [], []
    for m in range(len(MASKS)):
        h = window_hashes(codes, m)
        at = np.flatnonzero(whole)
        for place in range(_PROBES):
            p = _filter_places(h[at], len(bloom) * 64)[place]
            at = at[(bloom[p >> np.uint64(6)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)]
        places.append(at), hashes.append(h[at])
    places, hashes = np.concatenate(places), np.concatenate(hashes)
    order = np.argsort(places, kind="stable")
    return places[order], hashes[order]


_HITS = pa.list_(pa.struct([("h", pa.int64()), ("at", pa.int32()), ("step", pa.int32()), ("n", pa.int32())]))


def _candidates(docs: DataFrame, bloom: np.ndarray) -> DataFrame:
    """(doc_id, doc_words, hits): documents with a window that passes the filter."""
    shared = docs.sparkSession.sparkContext.broadcast(bloom)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashing, bits = Words(), shared.value
        keys, held, size = [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            lengths = np.array([len(x) for x in held])
            codes, of, begins = np.concatenate(held), np.repeat(np.arange(len(held)), lengths), np.cumsum(lengths) - lengths
            at, h = _passing(codes, of, bits)
            doc = of[at]
            for d in np.unique(doc).tolist():
                lo, hi = np.searchsorted(doc, [d, d + 1])
                hits = pa.StructArray.from_arrays([pa.array(x) for x in _places(h[lo:hi], at[lo:hi] - begins[d])], names=["h", "at", "step", "n"])
                yield pa.RecordBatch.from_arrays([pa.array([keys[d]], pa.int64()), pa.array([held[d].view(np.int64)], pa.list_(pa.int64())), pa.ListArray.from_arrays(pa.array([0, len(hits)], pa.int32()), hits)], names=["doc_id", "doc_words", "hits"])

        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                codes = hashing.codes(t.as_py())
                if len(codes) >= SPAN:
                    keys.append(k), held.append(codes)
                    size += len(codes)
                if size >= _BATCH_WORDS:
                    yield from flush()
                    keys, held, size = [], [], 0
        if held:
            yield from flush()

    return docs.mapInArrow(run, "doc_id bigint, doc_words array<bigint>, hits array<struct<h:bigint,at:int,step:int,n:int>>")


def diagonals(meetings: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pair, diagonal), distinct and sorted: a diagonal is a place in the document less one in the item. ``meetings`` are rows (at, step, n) of a document
    and of an item that share a hash, ``of`` the pair of each. A step that both have gives one progression of diagonals, not all pairs of places."""
    single = (meetings[:, 2] == 1) & (meetings[:, 5] == 1)
    pairs, found = [of[single]], [meetings[single, 0] - meetings[single, 3]]
    for i in np.flatnonzero(~single).tolist():
        p, step, n, q, step2, n2 = meetings[i].tolist()
        if n == 1 or n2 == 1 or step == step2:
            d = p - q + (step if n2 == 1 else step2) * np.arange(1 - n2, n)
        else:
            d = (p + step * np.arange(n)[:, None] - q - step2 * np.arange(n2)[None]).ravel()
        pairs.append(np.full(len(d), of[i])), found.append(d)
    both = np.unique(np.stack([np.concatenate(pairs), np.concatenate(found)], axis=1), axis=0)
    return both[:, 0], both[:, 1]


def overlaps(doc: np.ndarray, doc_at: np.ndarray, doc_n: np.ndarray, item: np.ndarray, item_at: np.ndarray, item_n: np.ndarray, pair: np.ndarray, on: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each pair (longest exact run, words of the best tolerant overlap, of these equal, its first word). Words lie in flat arrays, a pair's from ``_at`` on, ``_n`` of them;
    (``pair``, ``on``) are its diagonals, in order. The best overlap is the segment of a diagonal with the largest sum of +1 for an equal word and -2 for another one."""
    lo = np.maximum(0, on)
    n = np.minimum(doc_n[pair], on + item_n[pair]) - lo
    starts = np.cumsum(n) - n
    # one more place before each diagonal, for the sum of no words
    seg = np.repeat(np.arange(len(n)), n + 1)
    k = np.arange(len(seg)) - np.repeat(starts + np.arange(len(n)), n + 1) - 1
    inside = k >= 0
    i = (doc_at[pair] + lo)[seg] + k
    j = (item_at[pair] + lo - on)[seg] + k
    same = np.zeros(len(seg), bool)
    same[inside] = doc[i[inside]] == item[j[inside]]
    begins = starts + np.arange(len(n))
    # runs: places since the last unequal one, which a diagonal's first place always is
    place = np.arange(len(seg))
    run = np.maximum.reduceat(place - np.maximum.accumulate(np.where(same, -1, place)), begins)
    s = np.cumsum(np.where(same, 1, np.where(inside, -2, 0)))
    s -= np.repeat(s[begins], n + 1)
    # a minimum up to here within the diagonal: each diagonal is lowered below all before it
    drop = seg * (3 * (int(n.max()) + 1))
    low = np.minimum.accumulate(s - drop) + drop
    score = s - low
    best = np.maximum.reduceat(score, begins)
    at_best = np.flatnonzero(score == best[seg])
    end = at_best[np.searchsorted(seg[at_best], np.arange(len(n)))]
    begin = np.maximum.accumulate(np.where(s == low, place, -1))[end]
    equal = np.cumsum(same)
    equal = equal[end] - equal[begin]
    words, first = end - begin, lo + begin - begins
    # the best diagonal of each pair: most equal words, then the longest, then the first
    order = np.lexsort((first, -words, -equal, pair))
    head = order[np.r_[True, pair[order][1:] != pair[order][:-1]]]
    return np.maximum.reduceat(run, np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])), words[head], equal[head], first[head]


_RESULT = ["doc_id", "item_id", "exact_words", "overlap_words", "equal_words", "first_word"]


def _verifier(known: dict[int, np.ndarray] | None):
    """Verifies rows (doc_id, item_id, from, doc_words, met[, item_words]); the words of items that ``known`` doesn't give stand in the row."""

    def flat(c: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = c.value_lengths().to_numpy().astype(np.int64)
        return c.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.cumsum(n) - n, n

    def part(b: pa.RecordBatch) -> pa.RecordBatch:
        doc = flat(b.column(3))
        if known is None:
            item = flat(b.column(5))
        else:
            ids, no = np.unique(b.column(1).to_numpy(), return_inverse=True)
            held = [known[i] for i in ids.tolist()]
            n = np.array([len(x) for x in held])
            item = np.concatenate(held), (np.cumsum(n) - n)[no], n[no]
        met = b.column(4)
        of = np.repeat(np.arange(b.num_rows), met.value_lengths().to_numpy())
        rows = np.stack([c.to_numpy() for c in met.flatten().flatten()], axis=1).astype(np.int64)
        shift = b.column(2).to_numpy().astype(np.int64)
        rows[:, 0] -= shift[of]
        exact, words, equal, first = overlaps(*doc, *item, *diagonals(rows, of))
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(x.astype(np.int64)) for x in (exact, words, equal, first + shift))], names=_RESULT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, at = np.cumsum(b.column(3).value_lengths().to_numpy().astype(np.int64)), 0
            while at < b.num_rows:
                to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + _BATCH_WORDS, "right")))
                yield part(b.slice(at, to - at))
                at = to

    return run


def leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, exact_words, overlap_words, equal_words, first_word) for each document and item that share a seed.

    Neither texts nor the hashes of windows that no item has are shuffled: only the documents that pass the filter, as
    hashes of their words, and their few hits. Seeds, hits and pairs meet in joins on written tables, which AQE splits where
    one is hot. Of a document only the words along its diagonals go to the verification of a pair.
    """
    chosen = items.select(F.col(item_key).cast("bigint").alias("k"), F.col(item_text).alias("t")).where("k is not null and t is not null")
    hashed = Stage(_seeds(chosen)).df
    seeds = hashed.where("h is not null").select("h", "item_id", F.col("at").alias("at2"), F.col("step").alias("step2"), F.col("n").alias("n2"), "length")
    whole = hashed.where("h is null").select("item_id", "item_words", F.col("length").alias("n_words"))
    corpus = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text is not null")
    # a number for each row: a repeated key is verified text by text
    found = Stage(_candidates(corpus, _filter(seeds)).withColumn("no", F.monotonically_increasing_id())).df
    alone = (F.col("n") == 1) & (F.col("n2") == 1)
    place = lambda c, otherwise: F.when(alone, otherwise).otherwise(F.col(c))
    met = F.struct(F.when(alone, F.col("at") - F.col("at2")).otherwise(F.col("at")).alias("at"), *[place(c, F.lit(x)).alias(c) for c, x in (("step", 1), ("n", 1), ("at2", 0), ("step2", 1), ("n2", 1))])
    least, most = F.col("at") - F.col("at2") - F.col("step2") * (F.col("n2") - 1), F.col("at") + F.col("step") * (F.col("n") - 1) - F.col("at2")
    hits = found.select("no", F.inline("hits")).join(seeds, "h").groupBy("no", "item_id").agg(F.collect_set(met).alias("met"), F.greatest(F.min(least), F.lit(0)).alias("from"), F.max(most + F.col("length")).alias("to"))
    rows = hits.join(found.select("no", "doc_id", "doc_words"), "no")
    rows = rows.select("doc_id", "item_id", "from", F.slice("doc_words", F.col("from") + 1, F.least("to", F.size("doc_words")) - F.col("from")).alias("doc_words"), "met")
    if (whole.agg(F.sum("n_words")).first()[0] or 0) <= SHARED_WORDS:
        known = {r["item_id"]: np.array(r["item_words"], np.int64).view(np.uint64) for r in whole.toLocalIterator()} if whole.groupBy("item_id").count().where("count > 1").isEmpty() else None
    else:
        known = None
    if known is None:
        rows = rows.join(whole.select("item_id", "item_words"), "item_id").select("doc_id", "item_id", "from", "doc_words", "met", "item_words")
    return rows.mapInArrow(_verifier(known), ", ".join(f"{c} bigint" for c in _RESULT))
