"""Folding and Porter's stemming algorithm (1980), as a function of one token."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

_STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("logi", "log"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")]
_STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
_STEP4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic", "ou"]


def fold(token: str) -> str:
    """Lower case without diacritics."""
    return "".join(c for c in unicodedata.normalize("NFD", token.lower()) if not unicodedata.combining(c))


def _consonant(w: str, i: int) -> bool:
    c = w[i]
    if c in "aeiou":
        return False
    return i == 0 or not _consonant(w, i - 1) if c == "y" else True


def _measure(w: str) -> int:
    kinds = [_consonant(w, i) for i in range(len(w))]
    return sum(1 for a, b in zip(kinds, kinds[1:]) if not a and b)


def _vowel(w: str) -> bool:
    return any(not _consonant(w, i) for i in range(len(w)))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _consonant(w, len(w) - 1)


def _cvc(w: str) -> bool:
    n = len(w)
    return n > 2 and _consonant(w, n - 1) and not _consonant(w, n - 2) and _consonant(w, n - 3) and w[-1] not in "wxy"


@lru_cache(200_000)
def stem(token: str) -> str:
    """The stem of a folded token; tokens of other letters, of up to 2 or of more than 64 characters stay as they are."""
    w = token
    if not 2 < len(w) <= 64 or not w.isascii() or not w.isalnum():
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    more = False
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    elif w.endswith("ed") and _vowel(w[:-2]):
        w, more = w[:-2], True
    elif w.endswith("ing") and _vowel(w[:-3]):
        w, more = w[:-3], True
    if more:
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif _double(w) and w[-1] not in "lsz":
            w = w[:-1]
        elif _measure(w) == 1 and _cvc(w):
            w += "e"
    if w.endswith("y") and _vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        for end, to in sorted(table, key=lambda x: -len(x[0])):
            if w.endswith(end):
                if _measure(w[: -len(end)]) > 0:
                    w = w[: -len(end)] + to
                break
    if w.endswith("ion") and w[-4:-3] in ("s", "t"):
        if _measure(w[:-3]) > 1:
            w = w[:-3]
    else:
        for end in _STEP4:
            if w.endswith(end):
                if _measure(w[: -len(end)]) > 1:
                    w = w[: -len(end)]
                break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _cvc(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w
