"""One consistent character form for texts that look the same.

Almost all text is stable already. A quick check by character properties (NFC_Quick_Check, decomposition type, default
ignorable, space separator, look-alike letter) finds the unstable characters; each run of them, with the starter before
it as boundary context, is a segment; only segments are normalised, and they are spliced into the unchanged rest. What
follows a segment is stable and never a combining character, so the splice can't create a new composition.

The form: full- and half-width forms become plain, accents are composed (NFC), letters of Greek and Cyrillic that look
like Latin ones become those, every space separator becomes a space, invisible characters go. Case, accents, line breaks,
tabs and the number of spaces stay. Other compatibility forms (ligatures, superscripts) look different and stay.

Defined cases: NULL stays NULL, the empty text stays empty; applying it twice changes nothing more.
"""

from __future__ import annotations

import re
import unicodedata
from functools import cache, lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parleyspark.plans.stage import Stage

# Letters that look the same, each with the Latin letter it becomes (of two without a Latin twin, the Cyrillic one).
CYRILLIC = {
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y", "Ү": "Y",
    "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W", "Ѵ": "V", "Ӏ": "I",
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y",
}
GREEK = {
    "Α": "A", "Β": "B", "Ϲ": "C", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Ϳ": "J", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "α": "a", "ϲ": "c", "ι": "i", "ϳ": "j", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "χ": "x", "κ": "к", "Γ": "Г", "Π": "П", "Φ": "Ф",
}
#: Default ignorable code points, first and last.
IGNORABLE = [
    (0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164),
    (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF),
]
#: Controls that can't be seen; tabs and line breaks can.
_CONTROLS = [(0x00, 0x08), (0x0E, 0x1F), (0x7F, 0x84), (0x86, 0x9F)]
#: What may need work: anything but printable ASCII, tab and line breaks. For the JVM's check of whole texts.
SUSPECT = r"[^\t-\r\x20-\x7E]"


@cache
def _tables() -> tuple:
    """(unstable characters, their runs, widths, twins, ignorable), from the properties of all code points."""
    twins = CYRILLIC | GREEK
    width = {}
    for cp in [0x3000, *range(0xFF01, 0xFFE7)]:
        tag, _, rest = unicodedata.decomposition(chr(cp)).partition(" ")
        if tag in ("<wide>", "<narrow>"):
            width[cp] = "".join(chr(int(x, 16)) for x in rest.split())
    gone = {chr(cp) for a, b in IGNORABLE + _CONTROLS for cp in range(a, b + 1)}
    # letters that hold a look-alike with an accent
    composed = {chr(cp) for a, b in ((0x370, 0x530), (0x1F00, 0x2000)) for cp in range(a, b) if unicodedata.normalize("NFD", chr(cp))[0] in twins}
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    unstable = {*regex.findall(r"[\p{NFC_QC=N}\p{NFC_QC=M}\p{M}\p{Zs}]", every), *gone, *twins, *composed, *map(chr, width)} - {" "}
    points, ranges = sorted(map(ord, unstable)), []
    for p in points:
        if ranges and ranges[-1][1] == p - 1:
            ranges[-1][1] = p
        else:
            ranges.append([p, p])
    runs = re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges) + "]+")
    spaces = dict.fromkeys(map(ord, regex.findall(r"\p{Zs}", every)), " ")
    return frozenset(unstable), runs, width | dict.fromkeys(map(ord, gone)), str.maketrans(twins) | spaces


@lru_cache(100_000)
def _segment(s: str) -> str:
    _, _, first, then = _tables()
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", s.translate(first)).translate(then))


def canonical(text: str | None) -> str | None:
    """The consistent form of one text."""
    if not text:
        return text
    unstable, runs, _, _ = _tables()
    if unstable.isdisjoint(set(text)):
        return text
    out, done = [], 0
    for m in runs.finditer(text):
        at = max(done, m.start() - 1)
        out += (text[done:at], _segment(text[at : m.end()]))
        done = m.end()
    out.append(text[done:])
    return "".join(out)


def _canonical_series(texts: pd.Series) -> pd.Series:
    return texts.map(canonical, na_action="ignore")


def canonical_text(c: Column) -> Column:
    """canonical() as a column; texts that the JVM finds stable don't go to Python."""
    return F.coalesce(F.pandas_udf(_canonical_series, T.StringType())(F.when(c.rlike(SUSPECT), c)), c)


def _hashed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, look, exact) of the texts with a visible character: 128-bit hashes of the consistent form and of the text, written."""
    form = canonical_text(F.col(text))
    t = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("id"), F.col(text).alias("raw"), form.alias("form"))
    # blank texts get no hash and go after the write: a filter before it would be pushed down and run the Python function twice
    shown = F.length(F.regexp_replace("form", r"[\s\p{Z}]", "")) > 0
    t = t.select("id", F.when(shown, F.unhex(F.md5("form"))).alias("look"), F.unhex(F.md5("raw")).alias("exact"))
    return Stage(t).df.where("look is not null")


def look_alike_pairs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id_a, doc_id_b), smaller key first: texts that look the same and differ in code points.

    Texts without a visible character and null keys or texts don't count. Exact copies: every document is paired with
    the first document (by key) of each other text of its class, so that copies cost rows in proportion to their number
    and no link between two texts is lost. Only 128-bit hashes are shuffled, never texts. A class of many different texts
    has as many rows as links; ``look_alike_classes`` holds the same links in a row for each document.
    """
    t = _hashed(docs, key, text)
    first = t.groupBy("look", "exact").agg(F.min("id").alias("first"))
    many = first.groupBy("look").agg(F.count("*").alias("n")).where("n > 1").select("look")
    first = Stage(first.join(many, "look", "left_semi")).df
    other = first.select("look", F.col("exact").alias("exact2"), F.col("first").alias("id2"))
    p = t.join(other, "look").where("exact != exact2")
    return p.select(F.least("id", "id2").alias("doc_id_a"), F.greatest("id", "id2").alias("doc_id_b")).distinct()


def look_alike_classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, class_id, form_id, n_forms, n_links): a row for each document with a visible character.

    class_id is the first document of those that look the same, form_id the first of those with the same code points; n_forms
    counts the class's different texts, n_links the documents of its other texts. Rows grow with the documents, however
    many forms a class has; a class of any size is a sum, and a hot one is split by AQE in the joins.
    """
    t = _hashed(docs, key, text)
    forms = Stage(t.groupBy("look", "exact").agg(F.min("id").alias("form_id"), F.count("*").alias("n"))).df
    classes = forms.groupBy("look").agg(F.min("form_id").alias("class_id"), F.count("*").alias("n_forms"), F.sum("n").alias("n_all"))
    p = t.join(forms, ["look", "exact"]).join(classes, "look")
    return p.select(F.col("id").alias("doc_id"), "class_id", "form_id", "n_forms", (F.col("n_all") - F.col("n")).alias("n_links"))


def canonical_rows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, changed): every text in its consistent form."""
    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("raw"), canonical_text(F.col(text)).alias("text")).select("doc_id", "text", (F.col("raw") != F.col("text")).alias("changed"))
