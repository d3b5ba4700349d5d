"""Full-text search with BM25: a query language, one pass over the texts for a single query, an index for many.

For a single query the stored texts are read once, where they are: an Arrow function tokenises, folds and stems them and
gives each text's length, the number of occurrences of each unit of the query and, of a match, a snippet. What is shuffled
are these few numbers, never texts; corpus statistics are a one-row aggregate. `Index` tokenises once, and answers
a query from the places of its terms.

Query language: terms, "phrases", prefix*, ^first, NEAR(a b, n), column: term, AND, OR, NOT, parentheses. Terms side by side mean AND
and bind tightest, then NOT, AND, OR. Tokens are runs of letters and digits, folded and stemmed; no stop words.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parleyspark.functions.porter import fold, stem
from parleyspark.operators.relational import grouped
from parleyspark.plans.stage import Stage, spread

K1, B = 1.2, 0.75
_TOKEN = re.compile(r"(?:[^\W_]|[̀-ͯ])+")


def tokens(text: str | None, stemmed: bool = True) -> list[str]:
    ts = _TOKEN.findall(text) if text else []
    return [stem(fold(t)) for t in ts] if stemmed else [t.lower() for t in ts]


#: Names that a query may give the searched column: ``text: term``.
COLUMNS = ("text", "text_content")


class SearchError(ValueError):
    """The query can't be read."""


@dataclass(frozen=True)
class Unit:
    """What is counted and ranked as one: words in a row; the last may be a prefix; ``first`` only at the start of a text."""

    words: tuple[str, ...]
    prefix: bool = False
    first: bool = False


class Query:
    """A parsed query: its units, and whether a text's unit counts satisfy it."""

    _LEX = re.compile(r'\s*(?:("(?:[^"]|"")*")|([()+,^*:])|((?:[^\W]|[^\x00-\x7f])+)|(\S))')

    def __init__(self, text: str, stemmed: bool = True, columns: tuple[str, ...] = COLUMNS):
        self.columns = columns
        self.stemmed, self.units, self.near, self.absent = stemmed, [], [], set()
        self.lexemes, at = [], 0
        text = text.rstrip()
        while at < len(text):
            m = self._LEX.match(text, at)
            if m[4]:
                raise SearchError(f"Invalid search query near {m[4]!r}")
            self.lexemes.append(m[1] or m[2] or m[3])
            at = m.end()
        self.at = 0
        if not self.lexemes:
            raise SearchError("Invalid search query: it is empty")
        self.tree = self._or()
        if self.at < len(self.lexemes):
            raise SearchError(f"Invalid search query near {self.lexemes[self.at]!r}")

    def _peek(self) -> str | None:
        return self.lexemes[self.at] if self.at < len(self.lexemes) else None

    def _take(self) -> str:
        x = self._peek()
        if x is None:
            raise SearchError("Invalid search query: it ends too early")
        self.at += 1
        return x

    def _or(self):
        x = self._and()
        while self._peek() == "OR":
            self.at += 1
            x = ("or", x, self._and())
        return x

    def _and(self):
        x = self._not()
        while self._peek() == "AND":
            self.at += 1
            x = ("and", x, self._not())
        return x

    def _not(self):
        x = self._row()
        while self._peek() == "NOT":
            self.at += 1
            kept = len(self.units)
            x = ("not", x, self._row())
            # what must be absent takes no part in the rank
            self.absent.update(range(kept, len(self.units)))
        return x

    def _row(self):
        x = self._atom()
        while (p := self._peek()) not in (None, ")", "AND", "OR", "NOT", ",", "+", "*"):
            x = ("and", x, self._atom())
        return x

    def _words(self, lexeme: str) -> tuple[str, ...]:
        return tuple(tokens(lexeme, self.stemmed))

    def _atom(self):
        x = self._take()
        if self._peek() == ":":
            # texts have one column; naming another is an error
            if x not in self.columns:
                raise SearchError(f"Invalid search query: no such column: {x}")
            self.at += 1
            x = self._take()
        if x == "(":
            inner = self._or()
            if self._take() != ")":
                raise SearchError("Invalid search query: a parenthesis is open")
            return inner
        if x == "NEAR" and self._peek() == "(":
            self.at += 1
            members, distance = [], 10
            while self._peek() not in (")", ",", None):
                members.append(self._phrase(self._take(), False))
            if self._peek() == ",":
                self.at += 1
                n = self._take()
                if not n.isdigit():
                    raise SearchError("Invalid search query: NEAR needs a number")
                distance = int(n)
            if self._take() != ")" or not members:
                raise SearchError("Invalid search query: NEAR")
            self.near.append((tuple(members), distance))
            return ("near", len(self.near) - 1)
        if x in ("AND", "OR", "NOT") or x in (")", ",", "+", "*", ":"):
            raise SearchError(f"Invalid search query near {x!r}")
        first = x == "^"
        return ("unit", self._phrase(self._take() if first else x, first))

    def _phrase(self, lexeme: str, first: bool) -> int:
        if lexeme in ("(", ")", "+", ",", "*", "^"):
            raise SearchError(f"Invalid search query near {lexeme!r}")
        words = self._words(lexeme)
        while self._peek() == "+":
            self.at += 1
            more = self._take()
            if more in ("(", ")", "+", ",", "*", "^"):
                raise SearchError(f"Invalid search query near {more!r}")
            words += self._words(more)
        raw, prefix = lexeme, False
        if self._peek() == "*":
            self.at += 1
            prefix = True
            # a prefix is compared with stems as it stands
            words = (*words[:-1], *(fold(t) if self.stemmed else t.lower() for t in _TOKEN.findall(raw)[-1:]))
        self.units.append(Unit(words, prefix, first))
        return len(self.units) - 1

    def counts(self, words: list[str]) -> list[int]:
        """Occurrences of each unit in the tokens of a text."""
        return [len(self._places(u, words)) for u in self.units]

    def ranked(self, words: list[str], counts: list[int]) -> list[int]:
        """The occurrences that count for the rank: of members of NEAR only those close to the others."""
        out = list(counts)
        for near in self.near:
            for u, places in zip(near[0], self._close(near, words)):
                out[u] = len(places)
        return out

    @staticmethod
    def _places(u: Unit, words: list[str]) -> list[int]:
        n = len(u.words)
        if not n:
            return []
        head = u.words[0]
        out = []
        for i in range(1 if u.first and words else len(words) - n + 1):
            if i + n > len(words):
                break
            if n == 1:
                ok = words[i].startswith(head) if u.prefix else words[i] == head
            else:
                ok = tuple(words[i : i + n - 1]) == u.words[:-1] and (words[i + n - 1].startswith(u.words[-1]) if u.prefix else words[i + n - 1] == u.words[-1])
            if ok:
                out.append(i)
        return out

    def _close(self, near: tuple, words: list[str]) -> list[set[int]]:
        """The places of each member that lie close enough to places of all others; empty sets where there are none.

        A sweep: all members stand at a place; those too far behind the foremost move on; when none is, the places count
        together, and the member whose next place comes first moves on.
        """
        members, distance = near
        places = [self._places(self.units[u], words) for u in members]
        close: list[set[int]] = [set() for _ in members]
        if not all(places):
            return close
        at = [0] * len(members)
        width = [len(self.units[u].words) for u in members]
        while True:
            front = max(p[i] for p, i in zip(places, at))
            behind = [k for k, (p, i) in enumerate(zip(places, at)) if p[i] < front - width[k] - distance]
            for k in behind:
                while at[k] < len(places[k]) and places[k][at[k]] < front - width[k] - distance:
                    at[k] += 1
                if at[k] == len(places[k]):
                    return close
            if behind:
                continue
            for k, i in enumerate(at):
                close[k].add(places[k][i])
            nxt = [p[i + 1] if i + 1 < len(p) else len(words) for p, i in zip(places, at)]
            k = nxt.index(min(nxt))
            at[k] += 1
            if at[k] == len(places[k]):
                return close

    def matches(self, words: list[str], counts: list[int]) -> bool:
        def run(t) -> bool:
            if t[0] == "unit":
                return counts[t[1]] > 0
            if t[0] == "near":
                return any(self._close(self.near[t[1]], words))
            if t[0] == "and":
                return run(t[1]) and run(t[2])
            if t[0] == "or":
                return run(t[1]) or run(t[2])
            return run(t[1]) and not run(t[2])

        return run(self.tree)


def _counted(rows: DataFrame, q: Query, text_col: str, snippet: int) -> DataFrame:
    """The rows with their text replaced by its length (dl), the counts of the query's units (tf, there), whether it matches (ok), and
    of those that do the first ``snippet`` characters."""
    kept = [c for c in rows.columns if c != text_col]
    at = rows.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, counts, there, ok, cut = [], [], [], [], []
            for t in b.column(at).to_pylist():
                ws = tokens(t, q.stemmed)
                c = q.counts(ws)
                fits = q.matches(ws, c)
                length.append(len(ws)), counts.append(q.ranked(ws, c)), there.append([x > 0 for x in c]), ok.append(fits), cut.append(t[:snippet] if fits and t else None)
            made = [pa.array(length, pa.int64()), pa.array(counts, pa.list_(pa.int64())), pa.array(there, pa.list_(pa.bool_())), pa.array(ok, pa.bool_()), pa.array(cut, pa.string())]
            yield pa.RecordBatch.from_arrays([*(x for i, x in enumerate(b.columns) if i != at), *made], names=[*kept, "dl", "tf", "there", "ok", "snippet"])

    made = T._parse_datatype_string("dl bigint, tf array<bigint>, there array<boolean>, ok boolean, snippet string").fields
    return rows.mapInArrow(run, T.StructType([rows.schema[c] for c in kept] + made))


def _ranked(t: DataFrame, q: Query, n: int, avgdl: float | None, there: list[int]) -> DataFrame:
    """The matching rows of _counted() with ``rank``: n texts, of so many words on average, ``there[i]`` of them with unit i."""
    rank = F.lit(0.0)
    for i in sorted(set(range(len(q.units))) - q.absent):
        idf = math.log((n - there[i] + 0.5) / (there[i] + 0.5))
        idf = idf if idf > 0 else 1e-6
        tf = F.col("tf")[i].cast("double")
        rank = rank - F.lit(idf) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.lit(avgdl or 1.0)))
    return t.where("ok").withColumn("rank", rank).drop("dl", "tf", "there", "ok")


def score(hits: DataFrame, query: str, id_col: str, text_col: str, stemmed: bool = True, snippet: int = 0, latest=None) -> DataFrame:
    """The rows whose text matches, with ``rank`` (the lower, the better), ``id`` and ``snippet``, and without the text. A null text counts as empty.

    ``latest`` takes what is read of all stored versions to the last one of each; it meets numbers and snippets, never texts.
    """
    q = Query(query, stemmed)
    t = _counted(hits, q, text_col, snippet)
    t = Stage(latest(t) if latest else t).df
    # one row
    s = t.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col("there")[i]).alias(f"n{i}") for i in range(len(q.units))]).first()
    out = _ranked(t, q, s["n"], s["avgdl"], [s[f"n{i}"] for i in range(len(q.units))])
    return out.withColumn("id", F.col(id_col).cast("string"))


SNIPPET = 200


def _messages(a, query: str, stemmed: bool) -> DataFrame:
    columns = ["conversation_uuid", "sender", "created_at", "created", "updated", "loaded_at", "updated_at", "text"]
    s = score(spread(a.message_versions(), "uuid").select("uuid", *columns), query, "uuid", "text", stemmed, SNIPPET, a.last_versions)
    return s.select(F.col("uuid").alias("message_uuid"), "conversation_uuid", "sender", "created_at", "rank", F.col("snippet").alias("text"))


def search_messages(a, query: str, limit: int | None = None, stemmed: bool = True) -> DataFrame:
    """(message_uuid, conversation_uuid, name, sender, created_at, rank) of matching messages, best first when limited."""
    c = a.conversations.select(F.col("uuid").alias("conversation_uuid"), "name")
    t = _messages(a, query, stemmed).drop("text").join(c, "conversation_uuid").select("message_uuid", "conversation_uuid", "name", "sender", "created_at", "rank")
    return t.orderBy("rank", "message_uuid").limit(limit) if limit else t


def _blocks(a, query: str, stemmed: bool) -> DataFrame:
    b = spread(a.block_versions(), "id").select("id", "message_uuid", "conversation_uuid", "block_type", "text_content")
    return score(b, query, "id", "text_content", stemmed, SNIPPET, lambda t: t.dropDuplicates(["id"])).withColumn("id", F.col("id").cast("bigint"))


def search_blocks(a, query: str, block_type: str | None = None, stemmed: bool = True) -> DataFrame:
    """(id, message_uuid, conversation_uuid, block_type, rank); statistics are those of all blocks, whatever the type asked for."""
    t = _blocks(a, query, stemmed).drop("snippet")
    return t.where(F.col("block_type") == block_type) if block_type else t


def search_messages_grouped(a, query: str, limit: int | None = None, stemmed: bool = True, snippets: int = 3) -> DataFrame:
    """Conversations with matching messages, see ``relational.grouped``; best snippets first."""
    return grouped(a, _messages(a, query, stemmed).withColumnRenamed("message_uuid", "hit"), [F.round("rank", 9), "hit"], snippets, limit)


def search_blocks_grouped(a, query: str, block_type: str | None = None, limit: int | None = None, stemmed: bool = True, snippets: int = 3) -> DataFrame:
    """Conversations with matching blocks (of one type); sender and time are those of the block's message."""
    b = _blocks(a, query, stemmed)
    b = b.where(F.col("block_type") == block_type) if block_type else b
    m = a.messages_with("sender", "created_at").withColumnRenamed("uuid", "message_uuid")
    hits = b.join(m, "message_uuid").select("conversation_uuid", F.col("id").alias("hit"), "rank", F.col("snippet").alias("text"), "sender", "created_at")
    return grouped(a, hits, [F.round("rank", 9), "hit"], snippets, limit)


def postings(rows: DataFrame, id_col: str, text_col: str, stemmed: bool = True) -> DataFrame:
    """The inverted index as a table: (term, id, pos), and nothing for null or empty texts. Repeated ids count as often as they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([tokens(t, stemmed) for t in b.column(1).to_pylist()], pa.list_(pa.string()))], names=["id", "terms"])

    t = rows.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("t")).mapInArrow(run, "id string, terms array<string>")
    return t.select("id", F.posexplode("terms").alias("pos", "term")).select("term", "id", F.col("pos").cast("bigint").alias("pos"))


class Index:
    """A stored inverted index: texts are tokenised once, and a query reads the places of its own terms only.

    ``rows`` hold one row for each id. The postings are ordered by term, so that a query's filter on terms skips most of the files'
    row groups; the words of a text that matter for a query are put back at their places, and judged as ``score`` judges whole texts.
    """

    def __init__(self, rows: DataFrame, id_col: str, text_col: str, stemmed: bool = True):
        self.stemmed = stemmed
        p = postings(rows, id_col, text_col, stemmed)
        ordered = p.groupBy("term", "id").agg(F.array_sort(F.collect_list("pos")).alias("places")).repartitionByRange("term", "id").sortWithinPartitions("term", "id")
        self._terms = Stage(ordered)
        self.terms = self._terms.df
        self._lengths = Stage(self.terms.groupBy("id").agg(F.sum(F.size("places")).alias("dl")))
        self.lengths = self._lengths.df
        # texts without a word count, too
        self.n, self.avgdl = rows.count(), None
        self.avgdl = (self.lengths.agg(F.sum("dl")).first()[0] or 0) / self.n if self.n else None

    def score(self, query: str) -> DataFrame:
        """(id, rank) of the matching texts. A query that texts without any of its terms could match isn't possible in this language."""
        q = Query(query, self.stemmed)
        wanted = F.lit(False)
        for u in q.units:
            for i, w in enumerate(u.words):
                wanted |= F.col("term").startswith(w) if u.prefix and i == len(u.words) - 1 else F.col("term") == w
        found = self.terms.where(wanted).groupBy("id").agg(F.collect_list(F.struct("term", "places")).alias("found")).join(self.lengths, "id")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                counts, there, ok = [], [], []
                for found, dl in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                    ws = [""] * dl
                    for f in found:
                        for place in f["places"]:
                            ws[place] = f["term"]
                    c = q.counts(ws)
                    counts.append(q.ranked(ws, c)), there.append([x > 0 for x in c]), ok.append(q.matches(ws, c))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(counts, pa.list_(pa.int64())), pa.array(there, pa.list_(pa.bool_())), pa.array(ok, pa.bool_())], names=["id", "dl", "tf", "there", "ok"])

        t = Stage(found.select("id", "found", "dl").mapInArrow(run, "id string, dl bigint, tf array<bigint>, there array<boolean>, ok boolean")).df
        s = t.agg(F.count("*").alias("n"), *[F.count_if(F.col("there")[i]).alias(f"n{i}") for i in range(len(q.units))]).first()
        return _ranked(t, q, self.n, self.avgdl, [s[f"n{i}"] for i in range(len(q.units))])

    def drop(self) -> None:
        self._terms.drop()
        self._lengths.drop()
