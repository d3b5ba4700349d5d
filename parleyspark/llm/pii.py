"""Personal data in free text: found by a conditional random field, replaced by typed placeholders.

The tagger is trained once a process from the labelled table of ``pii_table`` and goes to the workers as a closure of
bounded size (its weights, and the words of public tokenizers as a list of common words); texts are tagged where they are, without a shuffle, in batches of about a million characters.
Exact checks on what it proposes follow: the shape that a value of its type must have, and the borders of the value.

Defined cases: null and empty texts hold nothing and stay as they are; texts of any length are read whole; a repeated row
gives one result; other columns don't matter.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parleyspark.llm.crf import _GAP, Crf
from parleyspark.llm.pii_table import TYPES, labelled

PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "street_address": "[ADDRESS]", "person_name": "[NAME]"}
#: Characters tagged together in a worker.
CHARS = 1_000_000

_TITLE = re.compile(r"(?:.*\W)?(?:Dr|Mr|Mrs|Ms|Prof|Herrn?|Frau|Mme|Mlle|Sra?|Srta|Don|Doña)\.?\s+(?=[^\W\d_])|(?:(?:Selon|Avec|Pour|Chez|[a-zà-ÿ]+)\W+)?\W*M\.\s+(?=[^\W\d_]+.*\s)", re.S)
_AT = re.compile(r"\s*(?:@|[\[(]\s*at\s*[\])]|\bat\b)\s*", re.I)
_DOMAIN = re.compile(r"[\w-]+(?:\s*(?:\.|[\[(]\s*dot\s*[\])]|\bdot\b)\s*[\w-]+)+", re.I)
_LOCAL = re.compile(r"[\w.+%-]")
_WORDS = re.compile(r"[^\W\d_](?:[^\W\d_]|['’.-])*")
_PARTICLES = {"von", "van", "der", "de", "la", "du", "della", "del", "di"}
#: Vocabularies of public tokenizers, whose whole words tell ordinary words from proper names and unknown ones.
VOCABULARIES = ("/opt/tokenizers/byte_bpe_50k.tiktoken", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
_UUID = re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}")


@cache
def lexicon(paths: tuple[str, ...] = VOCABULARIES) -> dict[str, str]:
    """c: an ordinary word (also) written small; n: a word written with a capital only."""
    words = set()
    for path in paths:
        with open(path, "rb") as f:
            for line in f:
                t = base64.b64decode(line.split()[0]).decode("utf-8", "replace")
                if t[:1] == " " and len(t) > 2 and t[1:].isalpha():
                    words.add(t[1:])
    small = {w for w in words if w.islower()}
    return dict.fromkeys((w.lower() for w in words if w[0].isupper()), "n") | dict.fromkeys(small, "c")


@cache
def tagger(paths: tuple[str, ...] = VOCABULARIES) -> Crf:
    return Crf.train(labelled(lexicon=lexicon(paths)), TYPES, lexicon(paths))


def _checked(text: str, start: int, end: int, kind: str) -> tuple[int, int] | None:
    """The value's exact borders, or None where it can't be one of its type."""
    value = text[start:end]
    if kind == "email":
        for at in _AT.finditer(value):
            # the local part is what stands before the sign, the domain what follows; both must be there
            stop = begin = start + at.start()
            while begin and _LOCAL.match(text[begin - 1]):
                begin -= 1
            while begin < stop and text[begin] == ".":
                begin += 1
            domain = _DOMAIN.match(text, start + at.end())
            if begin < stop and text[stop - 1] != "." and domain:
                return begin, domain.end()
        return None
    if kind == "person_name":
        if title := _TITLE.match(value):
            start += title.end()
        while start < end and not text[start].isalpha():
            start += 1
        # a name begins where its word does
        while start and (text[start - 1].isalpha() or (text[start - 1] in "-'’" and text[max(0, start - 2) : start - 1].isalpha())):
            start -= 1
        words = [(m[0], m.start()) for m in _WORDS.finditer(text, start, end) if m[0][-1] != "." and m[0] not in _PARTICLES]
        capital = lambda w: w[0].isupper() or w.rpartition("-")[2][:1].isupper()
        names = [w for w, _ in words if capital(w)]
        if names and not capital(words[0][0]):
            # an introducing word before a name in capitals
            start = next(at for w, at in words if capital(w))
        elif not names:
            names = words
        return (start, end) if len(names) > 1 and text[end : end + 1] != "@" and not any(c.isdigit() for c in value) else None
    # numbers within a longer run of characters, or within a uuid, are no values of their own
    for m in _UUID.finditer(text, max(0, start - 36), end + 36):
        if m.start() <= start < m.end():
            return None
        if start < m.start() < end:
            end = m.start()
    value = text[start:end].rstrip()
    end = start + len(value)
    digits = sum(c.isdigit() for c in value)
    if kind == "phone":
        while start and (text[start - 1] in "+(" or text[start - 1].isdigit()):
            start -= 1
        return (start, end) if 7 <= digits <= 20 and not text[start - 1 : start].isalpha() else None
    if start and text[start - 1].isalnum():
        return None
    if kind == "id_number":
        return (start, end) if digits >= 2 and len(value) >= 6 else None
    return (start, end) if digits and any(c.isalpha() for c in value) else None


def find(texts: list[str], crf: Crf | None = None) -> list[list[tuple[int, int, str]]]:
    """(start, end, type) of the personal data of each text, in order and without overlaps."""
    crf = crf or tagger()
    tokens, _, y = crf.tag(texts)
    out: list[list] = [[] for _ in texts]
    hot = np.flatnonzero(y)
    if not len(hot):
        return out
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)))
    begins = np.cumsum([len(_GAP)] + [len(t) + len(_GAP) for t in texts])[:-1]
    of = np.searchsorted(begins, ends[hot] - 1, "right") - 1
    spans = []
    before = -2
    for k, text_no in zip(hot.tolist(), of.tolist(), strict=True):
        label = crf.labels[y[k]]
        kind, end = label[2:], int(ends[k])
        body = tokens[k].lstrip()
        if not body:
            continue
        if spans and label[0] == "I" and k == before + 1 and spans[-1][0] == text_no and spans[-1][3] == kind:
            spans[-1][2] = end
        else:
            spans.append([text_no, end - len(body), end, kind])
        before = k
    for text_no, start, end, kind in spans:
        at = int(begins[text_no])
        got = _checked(texts[text_no], start - at, end - at, kind)
        if got and (not out[text_no] or out[text_no][-1][1] <= got[0]):
            out[text_no].append((*got, kind))
    return out


def redact_text(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, done = [], 0
    for start, end, kind in spans:
        out += (text[done:start], PLACEHOLDERS[kind])
        done = end
    return "".join([*out, text[done:]])


def _batches(column: pa.Array, keys: pa.Array) -> Iterator[tuple[list, list[str]]]:
    held_keys, held, chars = [], [], 0
    for k, t in zip(keys.to_pylist(), column, strict=True):
        text = t.as_py()
        if text:
            held_keys.append(k), held.append(text)
            chars += len(text)
            if chars > CHARS:
                yield held_keys, held
                held_keys, held, chars = [], [], 0
    if held:
        yield held_keys, held


def find_pii(rows: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """(source_table, row_key STRING, pii_type, start_char BIGINT, end_char BIGINT): one row for each occurrence."""
    crf = tagger()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for keys, texts in _batches(b.column(1), b.column(0)):
                found = [(source, k, kind, s, e) for k, spans in zip(keys, find(texts, crf), strict=True) for s, e, kind in spans]
                if found:
                    cols = list(zip(*found, strict=True))
                    kinds = [pa.string()] * 3 + [pa.int64()] * 2
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["source_table", "row_key", "pii_type", "start_char", "end_char"])

    chosen = rows.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t")).where("t is not null and k is not null")
    return chosen.mapInArrow(run, "source_table string, row_key string, pii_type string, start_char bigint, end_char bigint").distinct()


def redacted(c: Column) -> Column:
    """A text column with every piece of personal data replaced by the placeholder of its type; all else as it was."""
    crf = tagger()

    def run(texts: pd.Series) -> pd.Series:
        given = texts.tolist()
        at = [i for i, t in enumerate(given) if t]
        for i, spans in zip(at, find([given[i] for i in at], crf), strict=True):
            if spans:
                given[i] = redact_text(given[i], spans)
        return pd.Series(given, index=texts.index, dtype=object)

    # the annotations are text under the future import; pandas_udf needs the types themselves
    run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, T.StringType())(c)
