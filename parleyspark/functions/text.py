"""Titles, slugs and templates of texts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parleyspark.functions.patterns import BOILERPLATE

# Fixed values: (pattern, replacement), applied in order: code fences, inline code, links, headers, emphasis, tags, bullets, numbers, white space.
CLEANING = [
    (r"(?s)```.*?```", " "), (r"`[^`]+`", " "), (r"\[([^\]]+)\]\([^)]+\)", "$1"), (r"(?m)^#+[ \t\n\f\r]*", ""), (r"[*_]{1,3}", ""), (r"<[^>]+>", " "),
    (r"(?m)^[ \t\n\f\r]*[-*•][ \t\n\f\r]+", ""), (r"(?m)^[ \t\n\f\r]*[0-9]+[.)][ \t\n\f\r]+", ""), (r"[\s\p{Z}]+", " "),
]
LONGEST, CUT, SHORTEST = 80, 40, 5


def extract_title(text: Column, skip_boilerplate: bool = False) -> Column:
    """The first sentence of at least 5 characters that is no boilerplate, else the longest; cut at 80; NULL if too short."""
    c = text
    for pattern, to in CLEANING:
        c = F.regexp_replace(c, F.lit(pattern), F.lit(to))
    sentences = F.filter(F.transform(F.split(F.trim(c), r"[.!?\n]+"), lambda s: F.trim(s)), lambda s: s != "")
    good = F.filter(sentences, lambda s: (F.length(s) >= SHORTEST) & (~s.rlike(BOILERPLATE) if skip_boilerplate else F.lit(True)))
    # of equally long sentences the first
    longest = F.array_max(F.transform(sentences, lambda s, i: F.struct(F.length(s).alias("n"), (-i).alias("i"), s.alias("s"))))["s"]
    chosen = F.coalesce(F.try_element_at(good, F.lit(1)), longest)
    head = F.substring(chosen, 1, LONGEST)
    at_word = F.regexp_extract(head, r"^(.*) [^ ]*$", 1)
    cut = F.concat(F.when(F.length(at_word) > CUT, at_word).otherwise(head), F.lit("…"))
    title = F.when(F.length(chosen) > LONGEST, cut).otherwise(chosen)
    return F.when(F.length(chosen) >= SHORTEST, F.concat(F.upper(F.substring(title, 1, 1)), F.substring(title, 2, 2**30)))


def title_case(c: Column) -> Column:
    return F.array_join(F.transform(F.split(c, r"[\s_-]+"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 2**30)))), " ")


def slugify(c: Column, length: int = 40) -> Column:
    s = F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "-")
    return F.substring(F.regexp_replace(s, r"^-+|-+$", ""), 1, length)


def descriptor(c: Column) -> Column:
    """The first three words of a name, joined by '-'."""
    s = F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9 ]+", " "))
    return F.array_join(F.slice(F.split(s, " +"), 1, 3), "-")


def url_template(url: Column) -> Column:
    """Origin and path of a URL, ids replaced by placeholders; what isn't a URL stays."""
    # The patterns of ids and their placeholders.
    origin = F.regexp_extract(url, r"^(https?://[^/?#]+)", 1)
    p = F.regexp_extract(url, r"^https?://[^/?#]+([^?#]*)", 1)
    p = F.regexp_replace(p, r"/session_[A-Za-z0-9]{20,}", "/{session_id}")
    p = F.regexp_replace(p, r"(?i)/[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", "/{uuid}")
    p = F.regexp_replace(p, r"/[A-Z0-9]{20,}", "/{ulid}")
    p = F.regexp_replace(p, r"/[0-9]{6,}", "/{n}")
    return F.when(origin == "", url).otherwise(F.concat(origin, F.when(p == "", "/").otherwise(p)))
