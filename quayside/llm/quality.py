"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages. Each passage is encoded from counts over its
words and characters; a gated attention, learned from document labels alone,
weighs the passages, and the weighted sum of their encodings is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.llm.bytesets import Prefix, chunks, lowered, runs
from quayside.llm.common import bounded_batches
from quayside.llm.samples import labelled_sample, sigmoid

PASSAGE = 40  # words
HASHED = 32
ENCODED = 32
GATE = 16
THRESHOLD = 0.3
EPOCHS = 30
#: The training sample: labelled rows of each class, and bytes of their texts.
PER_CLASS = 2500
MAX_BYTES = 32 << 20

_SIGNS = np.array([b for b in range(33, 127) if not chr(b).isalnum()])
_COLUMNS = 10 + len(_SIGNS) + HASHED


def passages(data: np.ndarray, at: np.ndarray, size: int = PASSAGE) -> tuple[np.ndarray, np.ndarray]:
    """The text number of every passage of one run of texts, and its counts.

    All words take part; a text without words has one passage of zeros.
    """
    texts = len(at) - 1
    start, end = runs((data > 0x20) & (data != 0x7F), at)
    doc = np.searchsorted(at, start, "right") - 1
    words = np.bincount(doc, minlength=texts)
    number = np.maximum(-(-words // size), 1)
    first = np.concatenate(([0], np.cumsum(number)))[:-1]
    owner = np.repeat(np.arange(texts), number)
    rank = np.arange(len(start)) - np.repeat(np.concatenate(([0], np.cumsum(words)))[:-1], words)
    at_word = first[doc] + rank // size
    bags = len(owner)

    def total(mark: np.ndarray) -> np.ndarray:
        if not len(start):
            return np.zeros(bags)
        upto = np.concatenate(([0], np.cumsum(mark, dtype=np.int64)))
        return np.bincount(at_word, upto[end] - upto[start], bags)

    n = np.maximum(np.bincount(at_word, minlength=bags), 1)
    size_bytes = np.bincount(at_word, end - start, bags)
    chars = np.maximum(size_bytes, 1)
    low = lowered(data)
    word = Prefix(low).of(start, end) if len(start) else np.zeros(0, np.uint64)
    same = np.zeros(len(word), bool)
    same[1:] = (word[1:] == word[:-1]) & (at_word[1:] == at_word[:-1])
    second = np.zeros(len(word), bool)
    second[2:] = (word[2:] == word[:-2]) & (at_word[2:] == at_word[:-2])
    keyed = np.sort((at_word.astype(np.uint64) << np.uint64(40)) | (word >> np.uint64(24)))
    again = np.zeros(len(keyed), bool)
    again[1:] = keyed[1:] == keyed[:-1]
    repeats = np.bincount((keyed >> np.uint64(40)).astype(np.int64)[again], minlength=bags)
    upper, digit, wide = (data >= 65) & (data <= 90), (data >= 48) & (data <= 57), data >= 0x80
    first_upper = np.bincount(at_word, upper[start], bags) if len(start) else np.zeros(bags)
    short = np.bincount(at_word, end - start <= 2, bags) if len(start) else np.zeros(bags)
    columns = [
        n / size,
        np.log1p(size_bytes / n),
        total(upper) / chars,
        total(digit) / chars,
        total(wide) / chars,
        first_upper / n,
        short / n,
        np.bincount(at_word, same, bags) / n,
        np.bincount(at_word, second, bags) / n,
        repeats / n,
    ]
    sign = np.full(256, -1)
    sign[_SIGNS] = np.arange(len(_SIGNS))
    marks = np.zeros((bags, len(_SIGNS)))
    found = np.flatnonzero(sign[data] >= 0)
    if len(found):
        bag = at_word[np.searchsorted(start, found, "right") - 1]
        marks += np.bincount(bag * len(_SIGNS) + sign[data[found]], minlength=marks.size).reshape(marks.shape)
    mixed = np.bincount(at_word * HASHED + (word >> np.uint64(59)).astype(np.int64), minlength=bags * HASHED)
    hashed = mixed.reshape(bags, HASHED) / n[:, None]
    return owner, np.column_stack([*columns, np.minimum(marks / n[:, None], 3), hashed]).astype(np.float32)


@dataclass
class QualityModel:
    """Parameters by name, and the scaling of the counts."""

    p: dict[str, np.ndarray]
    mean: np.ndarray
    spread: np.ndarray
    shift: float

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        """Scores of bags whose passages lie in a row from ``first`` on."""
        p = self.p
        x = (x - self.mean) / self.spread
        h = np.maximum(x @ p["enc"] + p["enc_b"], 0)
        a, b = np.tanh(h @ p["tan"]), sigmoid(h @ p["gate"])
        e = (a * b) @ p["attend"]
        bag = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(x))))
        e = np.exp(e - np.maximum.reduceat(e, first)[bag])
        share = e / np.add.reduceat(e, first)[bag]
        z = np.add.reduceat(share[:, None] * h, first, axis=0)
        return {"x": x, "h": h, "a": a, "b": b, "bag": bag, "share": share, "z": z, "logit": z @ p["out"] + p["out_b"] + self.shift}

    def scores(self, texts: pa.Array) -> np.ndarray:
        out = np.zeros(len(texts))
        for first, end, data, at in chunks(texts):
            owner, x = passages(data, at)
            out[first:end] = sigmoid(self.forward(x, np.searchsorted(owner, np.arange(end - first)))["logit"])
        return out


def _gradients(model: QualityModel, x: np.ndarray, first: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
    p, f = model.p, model.forward(x, first)
    g = (sigmoid(f["logit"]) - y) * weight
    gz = g[:, None] * p["out"][None, :]
    on = gz[f["bag"]]
    gs = (on * f["h"]).sum(axis=1)
    ge = f["share"] * (gs - np.add.reduceat(f["share"] * gs, first)[f["bag"]])
    gated = ge[:, None] * p["attend"][None, :]
    ga, gb = gated * f["b"] * (1 - f["a"] ** 2), gated * f["a"] * f["b"] * (1 - f["b"])
    gh = f["share"][:, None] * on + ga @ p["tan"].T + gb @ p["gate"].T
    gh[f["h"] <= 0] = 0
    return {
        "out": f["z"].T @ g,
        "out_b": g.sum(keepdims=True),
        "attend": (f["a"] * f["b"]).T @ ge,
        "tan": f["h"].T @ ga,
        "gate": f["h"].T @ gb,
        "enc": f["x"].T @ gh,
        "enc_b": gh.sum(axis=0),
    }


def fit(rows: list[tuple[str, int]], prior: float, seed: int = 3) -> QualityModel:
    """Learn from (text, label) pairs; ``prior`` is the share of label 1 in all rows.

    Without both labels every text gets the prior.
    """
    rng = np.random.default_rng(seed)
    p = {
        "enc": rng.normal(0, 0.15, (_COLUMNS, ENCODED)),
        "enc_b": np.zeros(ENCODED),
        "tan": rng.normal(0, 0.2, (ENCODED, GATE)),
        "gate": rng.normal(0, 0.2, (ENCODED, GATE)),
        "attend": rng.normal(0, 0.2, GATE),
        "out": rng.normal(0, 0.2, ENCODED),
        "out_b": np.zeros(1),
    }
    y = np.array([float(r[1]) for r in rows])
    base = float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6)))
    if not len(y) or y.min() == y.max():
        p["out"] *= 0
        return QualityModel(p, np.zeros(_COLUMNS, np.float32), np.ones(_COLUMNS, np.float32), base)
    bags, owner = [], []
    for first, _, data, at in chunks(pa.array([r[0] for r in rows], pa.large_string())):
        own, x = passages(data, at)
        bags.append(x)
        owner.append(own + first)
    x, owner = np.concatenate(bags), np.concatenate(owner)
    model = QualityModel(p, x.mean(axis=0), x.std(axis=0) + 0.05, 0.0)
    edges = np.searchsorted(owner, np.arange(len(y) + 1))
    weight = np.where(y > 0, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    step, batch = 0, 64
    for epoch in range(EPOCHS):
        order = rng.permutation(len(y))
        for i in range(0, len(order), batch):
            some = order[i : i + batch]
            n = edges[some + 1] - edges[some]
            first = np.concatenate(([0], np.cumsum(n)))[:-1]
            rows_at = np.repeat(edges[some] - first, n) + np.arange(n.sum())
            grads = _gradients(model, x[rows_at], first, y[some], weight[some] / len(some))
            step += 1
            rate = 0.004 * (1 - epoch / EPOCHS)
            for k, g in grads.items():
                g = g + 1e-4 * p[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    model.shift = base
    return model


def train(docs: DataFrame, labels: DataFrame, held: Column, per_class: int = PER_CLASS, max_bytes: int = MAX_BYTES) -> QualityModel:
    """A model from a bounded sample of the labelled rows that ``held`` leaves."""
    rows, counts = labelled_sample(docs, labels, "quality", [0, 1], per_class, max_bytes, held)
    total = sum(counts.values())
    return fit(rows, counts.get(1, 0) / total if total else 0.5)


def score(docs: DataFrame, model: QualityModel, text: Column) -> Column:
    """The score of a whole text, 0 to 1; null scores as the empty text."""
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(sent.value.scores(texts))

    return scored(text)
