"""Toxicity by a linear classifier with a counterfactual penalty.

Features are the words of a text and their beginnings, present or not, hashed.
Every training text gets counterfactual pairs: an identity term put into it and
another of its kind in its place, and, where it mentions a group itself, a copy
with the mention swapped. The squared change of the score between the two is
penalised beside the usual loss, so that which group is mentioned says nothing;
that keeps neutral sentences about a group from being flagged.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.llm.bytesets import Prefix, chunks, letters, lowered, runs
from quayside.llm.common import bounded_batches
from quayside.llm.samples import labelled_sample, sigmoid

BITS = 20
STEMS = (2, 3, 4, 5, 6)
#: The training sample: labelled rows of each class, and bytes of their texts.
PER_CLASS = 4000
MAX_BYTES = 24 << 20
FEATURES = 512
LEAST_DOCS = 4
PENALTY = 4.0

#: Identity terms by kind; a term is swapped for others of its kind.
IDENTITY = (
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist", "catholic"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists", "catholics"),
    ("black", "white", "asian", "african", "european", "latino", "arab"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("man", "woman"),
    ("men", "women"),
    ("young", "old", "elderly", "disabled", "blind", "deaf"),
    ("mexican", "german", "french", "spanish", "chinese", "indian", "russian"),
    ("chrétiens", "musulmans", "juifs", "hindous", "bouddhistes", "athées", "catholiques"),
    ("noirs", "blancs", "asiatiques", "africains", "européens", "arabes"),
    ("hommes", "femmes"),
    ("jeunes", "vieux", "handicapés", "aveugles", "sourds"),
    ("christen", "muslime", "juden", "buddhisten", "atheisten", "katholiken"),
    ("schwarze", "weiße", "asiaten", "afrikaner", "europäer", "araber"),
    ("männer", "frauen"),
    ("junge", "alte", "behinderte", "blinde", "gehörlose"),
    ("cristianos", "musulmanes", "judíos", "hindúes", "budistas", "ateos", "católicos"),
    ("negros", "blancos", "asiáticos", "africanos", "europeos", "árabes"),
    ("hombres", "mujeres"),
    ("jóvenes", "viejos", "discapacitados", "ciegos", "sordos"),
)
_KIND = {t: kind for kind in reversed(IDENTITY) for t in kind}
_TERMS = [(kind, i) for kind in IDENTITY for i in range(len(kind))]
#: Pairs of terms that are put into each training text.
PLACED = 2
_MENTION = re.compile(r"\b(" + "|".join(sorted(_KIND)) + r")\b", re.IGNORECASE)


def swapped(text: str, turn: int) -> str | None:
    """The text with each mention replaced by another of its kind, or None."""
    out, n = _MENTION.subn(
        lambda m: (k := _KIND[m[0].lower()])[(k.index(m[0].lower()) + 1 + turn % (len(k) - 1)) % len(k)], text
    )
    return out if n else None


def placed(n: int) -> tuple[str, str]:
    """The ``n``-th choice of a term and another of its kind, all terms in turn."""
    kind, i = _TERMS[n % len(_TERMS)]
    return kind[i], kind[(i + 1 + n // len(_TERMS) % (len(kind) - 1)) % len(kind)]


def _features(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text number, feature) of all words and stems of one run of texts."""
    low = lowered(data)
    start, end = runs(letters(low), at)
    if not len(start):
        return
    hashed, doc = Prefix(low), np.searchsorted(at, start, "right") - 1
    yield doc, (hashed.of(start, end, 1) >> np.uint64(64 - BITS)).astype(np.int64)
    for n in STEMS:
        long = end - start > n
        yield doc[long], (hashed.of(start[long], start[long] + n, n + 1) >> np.uint64(64 - BITS)).astype(np.int64)


def present(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The distinct (text number, feature) pairs, run by run of the texts."""
    for i in range(0, len(texts), 500):
        for first, _, data, at in chunks(pa.array(texts[i : i + 500], pa.large_string())):
            own = [((d << BITS) | f) for d, f in _features(data, at)]
            if own:
                pairs = np.unique(np.concatenate(own))
                yield (pairs >> BITS) + first + i, pairs & ((1 << BITS) - 1)


@dataclass
class ToxicityModel:
    slots: np.ndarray  # feature -> weight number, -1 if it has none
    weights: np.ndarray
    bias: float
    #: Counterfactual pairs that it was learned with.
    pairs: int = 0

    def logits(self, texts: pa.Array) -> np.ndarray:
        out = np.full(len(texts), self.bias)
        for first, end, data, at in chunks(texts):
            pairs = []
            for doc, feature in _features(data, at):
                slot = self.slots[feature]
                known = slot >= 0
                pairs.append(doc[known] * len(self.weights) + slot[known])
            if pairs and len(self.weights):
                own = np.unique(np.concatenate(pairs))
                out[first:end] += np.bincount(own // len(self.weights), self.weights[own % len(self.weights)], end - first)
        return out

    def scores(self, texts: pa.Array) -> np.ndarray:
        return sigmoid(self.logits(texts))


def fit(rows: list[tuple[str, int]], penalty: float = PENALTY, rounds: int = 300) -> ToxicityModel:
    """Learn from (text, label) pairs; scores hold for labels that are equally common.

    With rows of one label only every text scores just on that label's side,
    without any rows just below a half.
    """
    y = np.array([float(r[1]) for r in rows])
    if not len(y) or y.min() == y.max():
        return ToxicityModel(np.full(1 << BITS, -1, np.int32), np.zeros(0), 0.1 if len(y) and y[0] else -0.1)
    # Two passes over the texts: all features of all of them are never held.
    n1, n0 = y.sum(), len(y) - y.sum()
    pos, neg = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for doc, feature in present([r[0] for r in rows]):
        pos += np.bincount(feature, y[doc], 1 << BITS)
        neg += np.bincount(feature, 1 - y[doc], 1 << BITS)
    p1, p0 = (pos + 0.5) / (n1 + 1), (neg + 0.5) / (n0 + 1)
    gain = np.abs(np.log(p1 / p0)) * np.abs(pos / n1 - neg / n0)
    gain[pos + neg < LEAST_DOCS] = 0
    best = np.argsort(-gain, kind="stable")[:FEATURES]
    best = best[gain[best] > 0]
    slots = np.full(1 << BITS, -1, np.int32)
    slots[best] = np.arange(len(best))

    def matrix(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts = [(np.zeros(0, np.int64), np.zeros(0, np.int32))]
        for d, f in present(texts):
            own = slots[f]
            parts.append((d[own >= 0], own[own >= 0]))
        return tuple(np.concatenate(c) for c in zip(*parts, strict=True))

    d, s = matrix([r[0] for r in rows])
    pairs = [(i, c) for i, r in enumerate(rows) for t in (0, 1) if (c := swapped(r[0], i + t))]
    whose = np.array([i for i, _ in pairs], np.int64)
    cd, cs = matrix([c for _, c in pairs])

    size = len(best)
    # A text with either term in it has its own features and the term's, so the
    # scores differ by what one term adds to the text and the other does not.
    terms = {t: set(matrix([t])[1].tolist()) for kind in IDENTITY for t in kind}
    put = []
    for n in range(PLACED * len(rows)):
        one, other = (terms[t] for t in placed(n))
        put += [(n, f, 1.0) for f in sorted(one - other)] + [(n, f, -1.0) for f in sorted(other - one)]
    pn, ps, sign = (np.array(c) for c in zip(*put, strict=True)) if put else (np.zeros(0, np.int64),) * 3
    fresh = ~np.isin(pn // PLACED * size + ps, d * size + s)
    pn, ps, sign = pn[fresh], ps[fresh], sign[fresh]
    w, b = np.zeros(size), 0.0
    weight = np.where(y > 0, len(y) / (2 * n1), len(y) / (2 * n0)) / len(y)
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, rounds + 1):
        z = np.bincount(d, w[s], len(y)) + b
        g = (sigmoid(z) - y) * weight
        gw = np.bincount(s, g[d], size) + 1e-5 * w
        if pairs:
            change = z[whose] - np.bincount(cd, w[cs], len(pairs)) - b
            pull = 2 * penalty * change / len(y)
            own = np.bincount(whose, pull, len(y))
            gw += np.bincount(s, own[d], size) - np.bincount(cs, pull[cd], size)
        if len(pn):
            change = np.bincount(pn, sign * w[ps], PLACED * len(rows))
            gw += np.bincount(ps, sign * (2 * penalty * change / len(y))[pn], size)
        grad = np.append(gw, g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
        w = np.sign(w) * np.maximum(np.abs(w) - 0.005, 0)  # a weight must earn its place
    used = np.flatnonzero(w)
    slots = np.full(1 << BITS, -1, np.int32)
    slots[best[used]] = np.arange(len(used))
    return ToxicityModel(slots, w[used], b, len(pairs) + PLACED * len(rows))


def train(docs: DataFrame, labels: DataFrame, held: Column, **bounds) -> ToxicityModel:
    """A model from a bounded sample of the labelled rows that ``held`` leaves."""
    per_class = bounds.get("per_class", PER_CLASS)
    rows, _ = labelled_sample(docs, labels, "toxic", [0, 1], per_class, bounds.get("max_bytes", MAX_BYTES), held)
    return fit(rows)


def score(docs: DataFrame, model: ToxicityModel, text: Column) -> Column:
    """The score of a whole text, 0 to 1; null scores as the empty text.

    Repeated rows score alike, a text of any length is read in pieces, other
    columns take no part, and an empty table has no scores.
    """
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(sent.value.scores(texts))

    return scored(text)
