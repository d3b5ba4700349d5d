"""A linear-chain conditional random field over word-shape features, trained and decoded in numpy.

Tokens get a signature: the tuple of their features (word if known, shape, what stands before it, known suffix). The
score of a label at a position is a sum over the signatures of the tokens around it and over pairs of neighbouring
classes, so that scoring a batch of texts is a handful of table lookups. Decoding first proves the label O wherever it
beats all others by more than transitions could ever make up for; only the stretches between such tokens go through
Viterbi, which therefore still finds the best path of the whole text.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np

TOKEN = re.compile(r"\s*(?:(?:[^\W\d_]|[̀-ͯ])+|\d+|[^\w\s]|_|\w)|\s+")
SEP = "\0"
#: Separators between texts: no window of features reaches over them.
_GAP = SEP * 4
REACH = 3
_KEPT_TOKENS = 300_000


def shape(body: str) -> str:
    c = body[0]
    if c.isdigit():
        n = len(body)
        return f"d{n}" if n <= 16 else "d17+"
    if c.isalpha():
        if len(body) == 1:
            return "A" if c.isupper() else "a"
        if body.isupper():
            return "AA"
        if body.islower():
            return "aa"
        return "Aa" if c.isupper() and body[1:].islower() else "aA"
    return c if c < "\x7f" or c in "☎°º№–‑" else "?"


def glue(lead: str) -> str:
    return "n" if not lead else "l" if "\n" in lead or "\r" in lead else "s"


def features(token: str, words: set[str], suffixes: set[str], lexicon: dict[str, str]) -> tuple[str, ...]:
    body = token.lstrip()
    if not body:
        return ("blank",)
    s, g = shape(body), glue(token[: len(token) - len(body)])
    low = body.lower()
    # how a list of common words knows it: as an ordinary word, with a capital only, or not at all
    known = lexicon.get(low, "u") if s[0] in "aA" and len(body) > 1 else ""
    out = [f"s={s}", f"g={g}", f"c={s}{g}{known}"]
    if known:
        out += [f"l={known}", f"l={known}{s}"]
    if low in words:
        out += [f"w={low}", f"w={low}{s}"]
    elif s[0] == "d" and body[0] == "0":
        out.append(f"z={body[:2] if len(body) > 1 else '0'}")
    if s in ("Aa", "AA", "aa", "aA") and len(body) > 4:
        out += [f"x{k}={low[-k:]}" for k in (3, 4) if low[-k:] in suffixes]
    return tuple(out)


class Crf:
    def __init__(self, labels: list[str], words: set[str], suffixes: set[str], lexicon: dict[str, str]):
        self.labels, self.words, self.suffixes, self.lexicon = labels, words, suffixes, lexicon
        self.signatures: dict[tuple, int] = {}
        self.classes: dict[str, int] = {}
        self.of: list[tuple[str, ...]] = []
        self.cls: list[int] = []
        self.lead: dict[int, int] = {}
        self.tokens: dict[str, int] = {}

    # -- tokens and signatures -------------------------------------------------------------------------------------
    def signature(self, token: str) -> int:
        f = features(token, self.words, self.suffixes, self.lexicon)
        i = self.signatures.get(f)
        if i is None:
            i = self.signatures[f] = len(self.of)
            self.of.append(f)
            self.cls.append(self.classes.setdefault(f[2] if len(f) > 2 else f[0], len(self.classes)))
        if len(self.tokens) > _KEPT_TOKENS:
            self.tokens.clear()
        self.tokens[token] = i
        return i

    def encode(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Tokens of all texts, between separators, and their signatures."""
        # a text may hold the separator itself
        joined = _GAP + _GAP.join(t.replace(SEP, "\1") for t in texts) + _GAP
        tokens = TOKEN.findall(joined)
        known, make = self.tokens, self.signature
        ids = [known[t] if t in known else make(t) for t in tokens]
        return tokens, np.array(ids, np.int64)

    # -- training ------------------------------------------------------------------------------------------------------
    @classmethod
    def train(cls, table: list[tuple[str, list[tuple[int, int, str]]]], types: tuple[str, ...], lexicon: dict[str, str], epochs: int = 12, batch: int = 400, rate: float = 0.25, l2: float = 1e-4, seed: int = 3, hide: float = 0.4, blank: float = 0.3) -> Crf:
        """Fit by AdaGrad on the log-likelihood. Words of names are hidden at random, and in a share ``blank`` of the texts most words around the values,
        so that shapes and the lexicon have to do, too."""
        labels = ["O", *(f"{p}-{t}" for t in types for p in "BI")]
        counts, suffix = Counter(), Counter()
        for text, spans in table:
            inside = [(a, b) for a, b, t in spans if t != "street_address"]
            for m in TOKEN.finditer(text):
                body = m[0].lstrip()
                if body and body[0].isalpha():
                    counts[body.lower()] += 1
                    at = m.end() - len(body)
                    if len(body) > 4 and any(a <= at < b for a, b in inside):
                        suffix.update((body.lower()[-3:], body.lower()[-4:]))
        words = {w for w, n in counts.items() if n >= 4} | set("()[]{}<>@.,:;#=+-/_'\"`☎&?!°")
        self = cls(labels, words, {x for x, n in suffix.items() if n >= 8}, lexicon)
        L, index = len(labels), {x: i for i, x in enumerate(labels)}
        rng = np.random.default_rng(seed)
        seqs = []
        for text, spans in table:
            tokens, _ = self.encode([text])
            at, y, sig = -len(_GAP), [], []
            around = 0.7 if rng.random() < blank else 0.0
            for t in tokens:
                body = t.lstrip()
                start = at + len(t) - len(body)
                at += len(t)
                label = next(((f"{'B' if start == a else 'I'}-{k}") for a, b, k in spans if a <= start < b), "O") if body else "O"
                y.append(index[label])
                hidden = rng.random() < (hide if body[:1].isupper() else 0) if label[2:] == "person_name" else label == "O" and body[:1].isalpha() and rng.random() < around
                sig.append(self.signature(t) if not hidden else self._hidden(t))
            seqs.append((np.array(sig), np.array(y)))
        self.tokens.clear()
        n, c = len(self.of), len(self.classes)
        # features of signatures as a padded matrix
        names: dict[str, int] = {}
        rows = [[names.setdefault(f, len(names)) for f in fs] for fs in self.of]
        width = max(map(len, rows))
        none = len(names)
        F = np.full((n, width), none)
        for i, r in enumerate(rows):
            F[i, : len(r)] = r
        klass = np.array(self.cls)
        O = 2 * REACH + 1
        W = np.zeros((O, none + 1, L))
        P = np.zeros((2, c * c, L))
        T = np.zeros((L, L))
        hW, hP, hT = np.full_like(W, 1e-6), np.full_like(P, 1e-6), np.full_like(T, 1e-6)
        order = sorted(range(len(seqs)), key=lambda i: len(seqs[i][0]))
        batches = [order[i : i + batch] for i in range(0, len(order), batch)]
        for epoch in range(epochs):
            for bi in rng.permutation(len(batches)):
                rows_ = [seqs[i] for i in batches[bi]]
                t_max = max(len(s) for s, _ in rows_)
                B = len(rows_)
                sig, y, mask = np.zeros((B, t_max), np.int64), np.zeros((B, t_max), np.int64), np.zeros((B, t_max), bool)
                for b, (s, lab) in enumerate(rows_):
                    sig[b, : len(s)], y[b, : len(s)], mask[b, : len(s)] = s, lab, True
                    sig[b, len(s) :] = s[0]
                # scores and gradients meet once for each signature of the batch, not for each token
                u, inv = np.unique(sig, return_inverse=True)
                inv, own = inv.reshape(sig.shape), F[u]
                places = [np.roll(inv, -o, axis=1) for o in range(-REACH, REACH + 1)]
                kl = klass[sig]
                pairs = [np.roll(kl, 1, 1) * c + kl, kl * c + np.roll(kl, -1, 1)]
                E = sum(W[k][own].sum(1)[at] for k, at in enumerate(places)) + P[0][pairs[0]] + P[1][pairs[1]]
                G, gT = _gradient(E, T, y, mask)
                flat = G.reshape(-1, L)
                for k, at in enumerate(places):
                    by = np.stack([np.bincount(at.ravel(), flat[:, j], len(u)) for j in range(L)], axis=1)
                    g = np.stack([np.bincount(own.ravel(), np.repeat(by[:, j], width), none + 1) for j in range(L)], axis=1)
                    g[none] = 0
                    g += l2 * B * W[k]
                    hW[k] += g * g
                    W[k] -= rate * g / np.sqrt(hW[k])
                for k, p in enumerate(pairs):
                    g = np.stack([np.bincount(p.ravel(), flat[:, j], c * c) for j in range(L)], axis=1)
                    g += 3 * l2 * B * P[k]
                    hP[k] += g * g
                    P[k] -= rate * g / np.sqrt(hP[k])
                gT += l2 * B * T
                hT += gT * gT
                T -= rate * gT / np.sqrt(hT)
        self.feature_names, self.W, self.P, self.T, self.c = names, W.astype(np.float32), P.reshape(2, c, c, L).astype(np.float32), T.astype(np.float32), c
        self._start()
        return self

    def _hidden(self, token: str) -> int:
        body = token.lstrip().lower()
        had = body in self.words
        self.words.discard(body)
        self.tokens.pop(token, None)
        i = self.signature(token)
        self.tokens.pop(token, None)
        if had:
            self.words.add(body)
        return i

    # -- scoring ---------------------------------------------------------------------------------------------------------
    def _start(self) -> None:
        self.known_classes = dict(self.classes)
        self.table = np.zeros((0, 2 * REACH + 1, len(self.labels)), np.float32)
        self.klass = np.zeros(0, np.int64)
        T = self.T
        # what a label other than O could gain by transitions over O, at most
        gain = (T[:, :, None] + T[None, :, :]) - (T[:, :1, None] + T[None, :1, :])
        self.bound = np.maximum(gain.max(axis=(0, 2)), 0)

    def __getstate__(self) -> dict:
        return {k: getattr(self, k) for k in ("labels", "words", "suffixes", "lexicon", "feature_names", "W", "P", "T", "c", "known_classes")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.signatures, self.classes, self.of, self.cls, self.tokens = {}, dict(state["known_classes"]), [], [], {}
        self._start()

    def _grow(self) -> None:
        """Score rows of the signatures that are new."""
        done = len(self.table)
        if done == len(self.of):
            return
        new = np.zeros((len(self.of) - done, 2 * REACH + 1, len(self.labels)), np.float32)
        for i, fs in enumerate(self.of[done:]):
            known = [self.feature_names[f] for f in fs if f in self.feature_names]
            if known:
                new[i] = self.W[:, known].sum(1)
        self.table = np.concatenate([self.table, new])
        # a class never seen in training scores like none
        self.klass = np.array([k if k < self.c else self.c for k in self.cls])

    def emissions(self, sig: np.ndarray) -> np.ndarray:
        self._grow()
        n, table = len(sig), self.table
        E = table[sig, REACH].copy()
        for o in range(1, REACH + 1):
            E[:-o] += table[sig[o:], REACH + o]
            E[o:] += table[sig[:-o], REACH - o]
        P = np.zeros((2, self.c + 1, self.c + 1, len(self.labels)), np.float32)
        P[:, : self.c, : self.c] = self.P
        k = self.klass[sig]
        E[1:] += P[0][k[:-1], k[1:]]
        E[:-1] += P[1][k[:-1], k[1:]]
        return E

    def tag(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(tokens, starts of tokens with their white space in the joined string, labels) of a batch of texts."""
        tokens, sig = self.encode(texts)
        E = self.emissions(sig)
        rest = E[:, 1:] + self.bound[1:] - E[:, :1]
        y = np.zeros(len(sig), np.int64)
        open_ = rest.max(1) >= 0
        y_open = viterbi_stretches(E, self.T, open_)
        y[open_] = y_open
        return tokens, sig, y


def viterbi_stretches(E: np.ndarray, T: np.ndarray, open_: np.ndarray) -> np.ndarray:
    """Best labels of the open positions; all others have label 0. Stretches of like length are decoded together."""
    at = np.flatnonzero(open_)
    if not len(at):
        return np.zeros(0, np.int64)
    first = np.flatnonzero(np.r_[True, np.diff(at) > 1])
    length = np.diff(np.r_[first, len(at)])
    out = np.zeros(len(at), np.int64)
    order = np.argsort(length, kind="stable")
    i = 0
    while i < len(order):
        # a group: up to 4000 stretches, the longest at most half again as long as the shortest
        short = length[order[i]]
        j = i + min(4000, int(np.searchsorted(length[order[i:]], max(short + 2, short * 1.5), "right")))
        rows = order[i:j]
        lens, t_max = length[rows], int(length[rows].max())
        begin = first[rows]
        score = T[0][None, :] + E[at[begin]]
        back = np.zeros((t_max, len(rows), E.shape[1]), np.int8)
        ends = np.empty(len(rows), np.int64)
        for t in range(1, t_max + 1):
            stop = lens == t
            if stop.any():
                ends[stop] = np.argmax(score[stop] + T[:, 0][None, :], axis=1)
            if t == t_max:
                break
            step = score[:, :, None] + T[None]
            back[t] = step.argmax(1)
            e = E[at[np.minimum(begin + t, len(at) - 1)]]
            score = step.max(1) + e
        label = np.zeros(len(rows), np.int64)
        for t in range(t_max - 1, -1, -1):
            last = lens == t + 1
            label[last] = ends[last]
            live = lens > t
            out[begin[live] + t] = label[live]
            if t:
                label[live] = back[t][live, label[live]]
        i = j
    return out


def _gradient(E: np.ndarray, T: np.ndarray, y: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the negative log-likelihood by emissions and transitions; sequences begin and end with label 0's transitions."""
    B, n, L = E.shape
    expT = np.exp(T)
    shift = E.max(2, keepdims=True)
    X = np.exp(E - shift)
    alpha, beta = np.zeros((B, n, L)), np.zeros((B, n, L))
    a = X[:, 0] * expT[0]
    alpha[:, 0] = a / a.sum(1, keepdims=True)
    for t in range(1, n):
        a = (alpha[:, t - 1] @ expT) * X[:, t]
        a /= a.sum(1, keepdims=True)
        alpha[:, t] = np.where(mask[:, t, None], a, alpha[:, t - 1])
    last = mask.sum(1) - 1
    b = np.repeat(expT[:, 0][None], B, 0)
    beta[:, n - 1] = b / b.sum(1, keepdims=True)
    gT = np.zeros((L, L))
    for t in range(n - 2, -1, -1):
        nxt = (X[:, t + 1] * beta[:, t + 1]) @ expT.T
        nxt /= nxt.sum(1, keepdims=True)
        beta[:, t] = np.where(mask[:, t + 1, None], nxt, b / b.sum(1, keepdims=True))
    G = alpha * beta
    G /= G.sum(2, keepdims=True)
    for t in range(1, n):
        live = mask[:, t]
        if not live.any():
            break
        p = alpha[live, t - 1][:, :, None] * expT[None] * (X[live, t] * beta[live, t])[:, None, :]
        p /= p.sum((1, 2), keepdims=True)
        gT += p.sum(0)
        np.add.at(gT, (y[live, t - 1], y[live, t]), -1)
    G[np.arange(B)[:, None], np.arange(n)[None], y] -= 1
    G *= mask[:, :, None]
    # padding takes no part; the transition from and to 0 at the ends is left as it is
    _ = last
    return G, gT
