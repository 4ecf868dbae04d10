"""Benchmark decontamination by one Aho-Corasick automaton.

The patterns are the word windows of all benchmark items, each fenced by blanks
so that it matches whole words. A text is normalised byte for byte, scanned
once, and every match is mapped back over the word offsets to the text as given.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.llm.common import bounded_batches, col, fresh
from quayside.session import materialize

WINDOW = 13
#: Benchmark text in one automaton. A larger benchmark is cut into slices by
#: item, each with an automaton and a scan of its own, so results stay exact.
SLICE_BYTES = 512 << 10

_KEEP = set(range(0x30, 0x3A)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
_FOLD = bytes(
    (b + 32 if 0x41 <= b <= 0x5A else b if b in _KEEP else 0x20) for b in range(256)
)
_RESULT = (
    "n_words bigint, n_hit bigint, items array<string>, "
    "spans array<struct<start:int,end:int>>, hits array<int>"
)


def words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def windows(text: bytes, size: int = WINDOW) -> set[bytes]:
    """The windows of an item: all of ``size`` words, or its words if fewer."""
    w = words(text)
    return {b" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


@lru_cache(maxsize=2)
def _automaton(items: tuple[tuple[str, bytes], ...], size: int) -> ahocorasick.Automaton:
    owners: dict[bytes, set[str]] = {}
    for item, text in items:
        for w in windows(text, size):
            owners.setdefault(w, set()).add(item)
    made = ahocorasick.Automaton()
    for w, who in owners.items():
        made.add_word(f" {w.decode('latin-1')} ", (w.count(b" ") + 1, tuple(sorted(who))))
    if owners:
        made.make_automaton()
    return made


def scan(text: bytes, automaton: ahocorasick.Automaton) -> tuple[int, np.ndarray, set[str]]:
    """Number of words, the hit ones as marks (empty if none), the items found."""
    w = words(text)
    found: set[str] = set()
    if not w or not len(automaton):
        return len(w), np.zeros(0, bool), found
    line = b" " + b" ".join(w) + b" "
    ends, sizes = [], []
    for end, (size, who) in automaton.iter(line.decode("latin-1")):
        ends.append(end)
        sizes.append(size)
        found.update(who)
    if not ends:
        return len(w), np.zeros(0, bool), found
    blanks = np.flatnonzero(np.frombuffer(line, np.uint8) == 0x20)
    last = np.searchsorted(blanks, np.array(ends))
    depth = np.zeros(len(w) + 1, np.int64)
    np.add.at(depth, last - np.array(sizes), 1)
    np.add.at(depth, last, -1)
    return len(w), np.cumsum(depth)[:-1] > 0, found


def original_spans(text: bytes, hit: np.ndarray) -> list[dict]:
    """Runs of hit words as character ranges of the text as given."""
    folded = np.frombuffer(text.translate(_FOLD), np.uint8) != 0x20
    edge = np.diff(np.concatenate(([0], folded.view(np.int8), [0])))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    run = np.diff(np.concatenate(([0], hit.view(np.int8), [0])))
    first, last = np.flatnonzero(run == 1), np.flatnonzero(run == -1) - 1
    raw = np.frombuffer(text, np.uint8)
    chars = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    return [
        {"start": int(chars[starts[a]]), "end": int(chars[ends[b]])}
        for a, b in zip(first, last, strict=True)
    ]


def _measured(text: str | None, before: dict | None, automaton) -> dict:
    raw = (text or "").encode("utf-8", "surrogatepass")
    n, hit, items = scan(raw, automaton)
    if before:
        items |= set(before["items"])
        if before["hits"]:
            hit = hit if len(hit) else np.zeros(n, bool)
            hit[before["hits"]] = True
    return {
        "n_words": n,
        "n_hit": int(hit.sum()),
        "items": sorted(items),
        "spans": original_spans(raw, hit) if len(hit) else [],
        "hits": np.flatnonzero(hit).tolist() if len(hit) else [],
    }


def _slices(benchmark: DataFrame, item_id: str, text: str, limit: int) -> Iterator[tuple]:
    """The items in groups of bounded size, each small enough to send to all tasks.

    One group at a time is on the driver, whatever the size of the benchmark.
    """
    parts = benchmark.select(
        F.coalesce(col(item_id).cast("string"), F.lit("")).alias("item"), col(text).alias("text")
    ).where("text IS NOT NULL")
    size = parts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("s")).first().s
    n = -(-int(size) // limit) if size > limit else 1
    for i in range(n):
        rows = parts.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == i).collect()
        yield tuple(sorted((r.item, r.text.encode("utf-8", "surrogatepass")) for r in rows))


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    slice_bytes: int = SLICE_BYTES,
    out: str = "contamination",
) -> tuple[DataFrame, str]:
    """``docs`` with one more column, and that column's name.

    The column holds the number of words, how many are hit, the items found
    (ids as sorted text), the hit stretches as character ranges of the text and
    the numbers of the hit words. Null and empty texts have no words; items
    without words have no window. Repeated rows are each measured, repeated
    items count once. Whole texts are scanned, in one pass for each slice.
    """
    bounded_batches(docs.sparkSession)
    name = fresh(docs, out)
    for i, items in enumerate(_slices(benchmark, item_id, item_text, slice_bytes)):
        kind = pa.struct(
            [
                ("n_words", pa.int64()),
                ("n_hit", pa.int64()),
                ("items", pa.list_(pa.string())),
                ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                ("hits", pa.list_(pa.int32())),
            ]
        )

        def measure(batches, items=items, kind=kind):
            automaton = _automaton(items, window)
            for batch in batches:
                texts, before = batch if isinstance(batch, tuple) else (batch, None)
                olds = before if before is not None else [None] * len(texts)
                yield pa.array(
                    [
                        _measured(t.as_py(), b.as_py() if b is not None else None, automaton)
                        for t, b in zip(texts, olds, strict=True)
                    ],
                    kind,
                )

        if i == 0:

            @F.arrow_udf(_RESULT)
            def first(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
                return measure(batches)

            docs = docs.withColumn(name, first(col(text)))
        else:

            @F.arrow_udf(_RESULT)
            def further(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
                return measure(batches)

            # Written out between passes: one automaton in memory at a time.
            docs = materialize(docs, "contamination").withColumn(name, further(col(text), col(name)))
    return docs, name


def contaminated(hit: str) -> Column:
    """A text is contaminated when at least a twentieth of its words is hit."""
    c = col(hit)
    return (c["n_hit"] > 0) & (c["n_hit"] * 20 >= c["n_words"])


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


__all__ = ["contaminated", "find_contamination", "items_digest", "windows", "words"]
