"""Language identification by averaged hashed subword embeddings.

A text is the average of the embeddings of its subwords (runs of two to four
bytes within words, blanks at the edges included), hashed into a table; a linear
softmax gives the languages. Both are trained together by stochastic gradient
descent. Scores are calibrated on rows kept back, and so is the score below
which a text is better called undetermined.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.llm.bytesets import Prefix, chunks, letters, lowered
from quayside.llm.common import bounded_batches, col
from quayside.llm.samples import labelled_sample

UND = "und"
BITS = 16
WIDTH = 16
ORDERS = (2, 3, 4)
EPOCHS = 6
RATE = 2.0
#: The training sample: rows of each language, and bytes of their texts.
PER_LANGUAGE = 800
MAX_BYTES = 24 << 20
#: The most languages learned, the commonest first; a bound on the model alone.
MAX_LANGUAGES = 1000
#: Share of rightly named texts the rejection threshold may turn away.
REJECTED = 0.01


def _subwords(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(position, bucket) of the subwords of one run of texts, order by order."""
    low = lowered(data)
    inside = letters(low)
    low[~inside] = 0x20
    hashed = Prefix(low)
    for n in ORDERS:
        h = hashed.grams(n)
        if not len(h):
            continue
        k = len(h)
        fine = inside[:k] | inside[n - 1 : n - 1 + k]
        for i in range(1, n - 1):
            fine &= inside[i : i + k]
        for edge in at[1:-1]:  # none reaches into the next text
            fine[max(edge - n + 1, 0) : edge] = False
        position = np.flatnonzero(fine)
        yield position, (h[position] >> np.uint64(64 - BITS)).astype(np.int64)


def _counts(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text its buckets and their shares."""
    out = []
    for t in texts:
        raw = np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8)
        own = [b for _, b in _subwords(raw, np.array([0, len(raw)]))] if len(raw) else []
        ids, n = np.unique(np.concatenate(own), return_counts=True) if own else (np.zeros(0, np.int64), np.zeros(0))
        out.append((ids, n / max(n.sum(), 1)))
    return out


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # bucket -> what it adds to each language
    heat: float
    least: float

    def probabilities(self, texts: pa.Array) -> np.ndarray:
        out = np.zeros((len(texts), len(self.languages)))
        for first, end, data, at in chunks(texts):
            total, n = np.zeros((end - first, len(self.languages))), np.zeros(end - first)
            for position, bucket in _subwords(data, at):
                cut = np.searchsorted(position, at)
                full = np.flatnonzero(cut[1:] > cut[:-1])
                if len(full):
                    total[full] += np.add.reduceat(self.table[bucket], cut[full], axis=0)
                n += np.diff(cut)
            out[first:end] = total / np.maximum(n, 1)[:, None]
        return _softmax(out / self.heat)


def fit(rows: list[tuple[str, str]], seed: int = 5) -> LanguageModel:
    """Learn from (text, language) pairs; a fifth is kept back for calibration.

    Without rows every text is undetermined; one language is always that one.
    """
    languages = sorted({r[1] for r in rows})
    if not languages:
        return LanguageModel([UND], np.zeros((1 << BITS, 1), np.float32), 1.0, 0.0)
    index = {lang: i for i, lang in enumerate(languages)}
    rng = np.random.default_rng(seed)
    counted, y = _counts([r[0] for r in rows]), np.array([index[r[1]] for r in rows])
    order = rng.permutation(len(rows))
    kept, learned = order[: len(rows) // 5], order[len(rows) // 5 :]
    e = rng.normal(0, 0.1, (1 << BITS, WIDTH)).astype(np.float32)
    w = np.zeros((WIDTH, len(languages)), np.float32)
    steps, step = EPOCHS * max(len(learned), 1), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(learned):
            ids, share = counted[i]
            rate = RATE * (1 - step / steps)
            step += 1
            if not len(ids):
                continue
            h = share @ e[ids]
            g = _softmax(h @ w)
            g[y[i]] -= 1
            back = w @ g
            w -= rate * np.outer(h, g).astype(np.float32)
            e[ids] -= rate * np.outer(share, back).astype(np.float32)
    table = e @ w
    z = np.array([share @ table[ids] if len(ids) else np.zeros(len(languages)) for ids, share in (counted[i] for i in kept)])
    heat, least = 1.0, 0.0
    if len(kept):
        heats = 2.0 ** np.arange(-6, 4, 0.5)
        loss = [-np.log(np.maximum(_softmax(z / t)[np.arange(len(kept)), y[kept]], 1e-12)).mean() for t in heats]
        heat = float(heats[int(np.argmin(loss))])
        p = _softmax(z / heat)
        right = p.max(axis=1)[p.argmax(axis=1) == y[kept]]
        least = float(np.quantile(right, REJECTED)) if len(right) else 0.0
    return LanguageModel(languages, table.astype(np.float32), heat, least)


def train(docs: DataFrame, held: Column, lang: str = "lang", per_language: int = PER_LANGUAGE, max_bytes: int = MAX_BYTES) -> LanguageModel:
    """A model from a bounded sample of the rows that ``held`` leaves, on a column doc_id."""
    known = docs.select("doc_id", col(lang).alias("lang")).where(F.col("lang").isNotNull() & ~held)
    common = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES).collect()
    languages = [r.lang for r in common]
    if not languages:
        return fit([])
    rows, _ = labelled_sample(docs, known, "lang", languages, per_language, max_bytes, F.lit(False))
    return fit(rows)


def identify(docs: DataFrame, model: LanguageModel, text: Column) -> Column:
    """A struct of ``lang``, ``score`` and ``rejected``.

    ``lang`` is the likeliest language; null texts and texts without a letter
    are ``und`` with score 0. ``rejected`` marks those and the texts whose score
    is below the calibrated threshold.
    """
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("lang string, score double")
    def named(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = sent.value
        for texts in batches:
            p = own.probabilities(texts)
            best = p.argmax(axis=1)
            lang = pa.array([own.languages[i] for i in best], pa.string())
            yield pa.StructArray.from_arrays([lang, pa.array(p[np.arange(len(best)), best])], ["lang", "score"])

    found = named(text)
    letter = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    return F.struct(
        F.when(letter, found["lang"]).otherwise(UND).alias("lang"),
        F.when(letter, found["score"]).otherwise(0.0).alias("score"),
        (~letter | (found["score"] < model.least) | (found["lang"] == UND)).alias("rejected"),
    )
