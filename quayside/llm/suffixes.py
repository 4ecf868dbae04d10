"""Removal of byte strings that earlier documents also hold, by a suffix sort.

Every 50-byte string of a text has one *anchor*, its 16 leading bytes of least
hash, chosen by content alone: equal strings have equal anchors at equal places.
A suffix is therefore sorted under the tokens at its anchor, and one record
serves all strings that share the anchor.

1. Anchors whose tokens occur in a single document cannot belong to a repeated
   string and are left out; this only compares hashes and loses nothing.
2. The suffixes of the others are range-partitioned by their leading tokens at
   splitters taken from a sample. Tokens that fill more than a partition by
   themselves are dealt out by the whole string instead.
3. A bucket sorts its strings by multikey quicksort, eight bytes at a time, in
   blocks that are cut where the tokens change, so equal strings never lie
   across a boundary; neighbours in the order are compared in full.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quayside.llm.bytesets import Prefix, chunks
from quayside.llm.common import bounded_batches, col, partitions
from quayside.session import materialize, new_path

LENGTH = 50
LEAD = 16
#: Leading tokens sampled for each partition that is to be cut.
SAMPLE_PER_PARTITION = 200
#: Strings that a bucket sorts at a time, unless they share their tokens.
BLOCK = 300_000
_NULL_ID = (1 << 63) - 1
_PLACE = 24  # bits of a position; longer texts are anchored in pieces
_LOW48 = np.uint64((1 << 48) - 1)


# -- anchors -----------------------------------------------------------------


def anchors(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of one run of texts: anchor, first and last string of it, key of its tokens.

    Strings first..last (by their positions) have this anchor.
    """
    empty = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return empty, empty, empty, empty.astype(np.uint64)
    if len(data) >= 1 << _PLACE:
        piece = 1 << (_PLACE - 1)
        parts = []
        for start in range(0, len(data) - LENGTH + 1, piece):
            stop = min(start + piece + LENGTH - 1, len(data))
            edges = np.unique(np.clip(at, start, stop)) - start
            a, first, last, key = anchors(data[start:stop], edges)
            parts.append((a + start, first + start, last + start, key))
        return tuple(np.concatenate(c) for c in zip(*parts, strict=True))
    h = Prefix(data).grams(LEAD)
    if len(h) < len(data) - LEAD + 1:
        raise AssertionError("a hash for every position")
    low = (h >> np.uint64(_PLACE) << np.uint64(_PLACE)) | np.arange(len(h), dtype=np.uint64)
    width, span = LENGTH - LEAD + 1, 1
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    place = (low & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
    fine = np.ones(len(place), bool)
    for edge in at[1:-1]:
        fine[max(edge - LENGTH + 1, 0) : edge] = False
    strings = np.flatnonzero(fine)
    if not len(strings):
        return empty, empty, empty, empty.astype(np.uint64)
    own = place[strings]
    new = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]) | (strings[1:] != strings[:-1] + 1))))
    first, last = strings[new], strings[np.append(new[1:], len(strings)) - 1]
    return own[new], first, last, h[own[new]] & _LOW48


# -- multikey quicksort ------------------------------------------------------


def tokens(rows: np.ndarray) -> np.ndarray:
    """Byte rows as big-endian words, so that words compare as the bytes do."""
    spare = -rows.shape[1] % 8
    if spare:
        rows = np.concatenate([rows, np.zeros((len(rows), spare), np.uint8)], axis=1)
    return np.ascontiguousarray(rows).view(">u8").astype(np.uint64)


def multikey_sort(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the rows, and for each place whether it equals the one before.

    Rows are sorted by their first word; only rows that tie go on to the next.
    """
    order = np.argsort(words[:, 0], kind="stable")
    same = np.zeros(len(order), bool)
    same[1:] = words[order[1:], 0] == words[order[:-1], 0]
    for k in range(1, words.shape[1]):
        tied = same.copy()
        tied[:-1] |= same[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        group = np.cumsum(~same[at])
        rows = order[at]
        inner = np.lexsort((words[rows, k], group))
        order[at] = rows[inner]
        value = words[order[at], k]
        same[at[1:]] &= (value[1:] == value[:-1]) | (group[1:] != group[:-1])
        # A place that began a group still does.
    return order, same


# -- packed columns of the shuffles ------------------------------------------


def _pack(values: np.ndarray) -> bytes:
    """Numbers with their high halves first, which hardly differ and compress."""
    v = values.astype(np.int64)
    return (v >> 32).astype("<i4").tobytes() + (v & 0xFFFFFFFF).astype("<u4").tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    n = len(raw) // 8
    return (np.frombuffer(raw, "<i4", n).astype(np.int64) << 32) | np.frombuffer(raw, "<u4", n, 4 * n).astype(np.int64)


def _cut(order_key: np.ndarray, n: int) -> np.ndarray:
    return np.searchsorted(order_key, np.arange(n + 1))


def _texts(batch: pa.RecordBatch) -> pa.Array:
    plain = zstandard.ZstdDecompressor()
    return pa.array([plain.decompress(z) for z in batch.column("packed").to_pylist()], pa.large_binary())


# -- the stages --------------------------------------------------------------


def _stored_texts(base: DataFrame, least: DataFrame, n: int) -> DataFrame:
    """Distinct texts, each with the least id that has it, in buckets by that id.

    ``least`` names that id for each tid; an id may have several texts and be
    the least of only some of them, null ids above all. The table is bucketed
    once so that later joins on the id move no text.
    Columns doc, ord (among different texts of one id), tid, packed.
    """
    spark = base.sparkSession

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            docs, tids, raw = batch.column("doc").to_numpy(), batch.column("tid").to_pylist(), batch.column("raw")
            least: dict[bytes, int] = {}
            for i, t in enumerate(tids):
                if t not in least or docs[i] < docs[least[t]]:
                    least[t] = i
            keep = sorted(least.values())
            if keep:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(docs[keep]),
                        pa.array([tids[i] for i in keep], pa.binary()),
                        pa.array([engine.compress(raw[i].as_py()) for i in keep], pa.binary()),
                    ],
                    ["doc", "tid", "packed"],
                )

    rows = base.where(F.col("n_bytes") >= LENGTH).select("doc", "tid", "raw").mapInArrow(packed, "doc bigint, tid binary, packed binary")
    marks = least.select(F.col("least").alias("doc"), "tid", F.lit(None).cast("binary").alias("packed"), F.lit(True).alias("mark"))
    # One row is kept for each mark, the one that comes next to it. No text moves again for that.
    after = Window.partitionBy("doc", "tid").orderBy(F.desc("mark"))
    distinct = (
        rows.withColumn("mark", F.lit(False))
        .unionByName(marks)
        .repartition(n, "doc")
        .withColumn("marked", F.lag("mark").over(after))
        .where("marked AND NOT mark")
        .withColumn("ord", F.row_number().over(Window.partitionBy("doc").orderBy("tid")))
        .select("doc", "ord", "tid", "packed")
    )
    return _bucketed(distinct, n, "texts")


def _bucketed(df: DataFrame, n: int, label: str) -> DataFrame:
    """Written in ``n`` buckets by doc, which ``df`` is partitioned by already."""
    spark = df.sparkSession
    name = f"quayside_{label}_{uuid.uuid4().hex}"
    writer = df.write.bucketBy(n, "doc").sortBy("doc").option("compression", "zstd")
    writer.option("path", new_path(spark, label)).saveAsTable(name)
    return spark.table(name)


def _shared_anchors(texts: DataFrame, n: int) -> DataFrame:
    """(doc, key) of all anchors whose key occurs in two documents at least."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = batch.column("doc").to_numpy()
            keys, owners = [], []
            for first, _, data, at in chunks(_texts(batch)):
                a, _, _, key = anchors(data, at)
                keys.append(key)
                owners.append(docs[first + np.searchsorted(at, a, "right") - 1])
            if not keys:
                continue
            key, doc = np.concatenate(keys), np.concatenate(owners)
            order = np.lexsort((doc, key))
            key, doc = key[order], doc[order]
            fresh = np.ones(len(key), bool)
            fresh[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
            key, doc = key[fresh], doc[fresh]
            if not len(key):
                continue
            start = np.concatenate(([True], key[1:] != key[:-1]))
            many = np.zeros(len(key), bool)
            many[:-1] = ~start[1:]
            # 0: alone here; 1: the first of several here; 2: another of them,
            # known to be shared and dealt out by its document.
            kind = np.where(start, many.astype(np.int64), 2)
            home = np.where(
                kind < 2, ((key >> np.uint64(16)) * np.uint64(n)) >> np.uint64(32), (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(n)
            ).astype(np.int64)
            place = home * 3 + kind
            order = np.argsort(place, kind="stable")
            key, doc, place = key[order].astype(np.int64), doc[order], place[order]
            cut = _cut(place, 3 * n)
            full = np.flatnonzero(cut[1:] > cut[:-1])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array((full // 3).astype(np.int32)),
                    pa.array((full % 3).astype(np.int32)),
                    pa.array([_pack(key[cut[i] : cut[i + 1]]) for i in full], pa.binary()),
                    pa.array([_pack(doc[cut[i] : cut[i + 1]]) for i in full], pa.binary()),
                ],
                ["bucket", "kind", "keys", "docs"],
            )

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, docs, known = [], [], []

        def out(doc: np.ndarray, key: np.ndarray) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(doc), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(doc[i : i + 100_000]), pa.array(key[i : i + 100_000])], ["doc", "key"])

        for batch in batches:
            for kind, k, d in zip(*(batch.column(c).to_pylist() for c in ("kind", "keys", "docs")), strict=True):
                key, doc = _unpack(k), _unpack(d)
                if kind == 2:
                    yield from out(doc, key)
                else:
                    keys.append(key)
                    docs.append(doc)
                    known.append(np.full(len(key), kind == 1))
        if not keys:
            return
        key, doc, several = np.concatenate(keys), np.concatenate(docs), np.concatenate(known)
        order = np.argsort(key, kind="stable")
        key, doc, several = key[order], doc[order], several[order]
        start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.append(start, len(key)))
        shared = (np.minimum.reduceat(doc, start) != np.maximum.reduceat(doc, start)) | np.logical_or.reduceat(several, start)
        hit = np.repeat(shared, size)
        yield from out(doc[hit], key[hit])

    cells = texts.select("doc", "packed").mapInArrow(emit, "bucket int, kind int, keys binary, docs binary")
    return cells.repartitionById(n, F.col("bucket")).mapInArrow(pick, "doc bigint, key bigint")


class _Records:
    """Anchors of one batch as records: doc, ord, first string, offset, context.

    The context runs from the anchor's first string to the end of its last.
    """

    width = 2 * LENGTH - LEAD

    def __init__(self, doc, ord_, first, offset, count, rows):
        self.doc, self.ord, self.first, self.offset, self.count, self.rows = doc, ord_, first, offset, count, rows

    def take(self, i) -> _Records:
        return _Records(self.doc[i], self.ord[i], self.first[i], self.offset[i], self.count[i], self.rows[i])

    @staticmethod
    def of(batch: pa.RecordBatch) -> _Records:
        docs, ords, wanted = batch.column("doc").to_numpy(), batch.column("ord").to_numpy(), batch.column("keys")
        parts = []
        for begin, _, data, at in chunks(_texts(batch)):
            a, first, last, key = anchors(data, at)
            text = np.searchsorted(at, a, "right") - 1
            cut = _cut(text, len(at) - 1)
            keep = np.zeros(len(a), bool)
            for t in np.flatnonzero(cut[1:] > cut[:-1]):
                own = wanted[int(begin + t)].values.to_numpy(zero_copy_only=False)
                keep[cut[t] : cut[t + 1]] = np.isin(key[cut[t] : cut[t + 1]].astype(np.int64), own)
            a, first, last, text = a[keep], first[keep], last[keep], text[keep]
            span = last - first + LENGTH
            padded = np.concatenate([data, np.zeros(_Records.width, np.uint8)])
            rows = np.lib.stride_tricks.sliding_window_view(padded, _Records.width)[first].copy()
            rows[np.arange(_Records.width)[None, :] >= span[:, None]] = 0
            parts.append((docs[begin + text], ords[begin + text].astype(np.int64), first - at[text], a - first, last - first + 1, rows))
        if not parts:
            e = np.zeros(0, np.int64)
            return _Records(e, e, e, e, e, np.zeros((0, _Records.width), np.uint8))
        return _Records(*(np.concatenate(c) for c in zip(*parts, strict=True)))

    def leads(self) -> np.ndarray:
        if not len(self.doc):
            return np.zeros(0, f"S{LEAD}")
        at = self.offset[:, None] + np.arange(LEAD)[None, :]
        return np.ascontiguousarray(np.take_along_axis(self.rows, at, axis=1)).view(f"S{LEAD}")[:, 0]

    def split(self) -> _Records:
        """A record of its own for each string."""
        which = np.repeat(np.arange(len(self.doc)), self.count)
        step = np.arange(len(which)) - np.repeat(np.cumsum(self.count) - self.count, self.count)
        rows = np.zeros((len(which), _Records.width), np.uint8)
        if len(which):
            rows[:, :LENGTH] = np.take_along_axis(self.rows[which], step[:, None] + np.arange(LENGTH)[None, :], axis=1)
        zero = np.zeros(len(which), np.int64)
        return _Records(self.doc[which], self.ord[which], self.first[which] + step, zero, zero + 1, rows)

    def spread(self) -> tuple[np.ndarray, _Records]:
        """Which records no smaller document here repeats whole, and the others."""
        if not len(self.doc):
            return np.zeros(0, np.int64), self
        marks = np.stack([self.offset, self.count], axis=1).astype(np.uint8)
        order, same = multikey_sort(tokens(np.concatenate([marks, self.rows], axis=1)))
        start = np.flatnonzero(~same)
        least = np.repeat(np.minimum.reduceat(self.doc[order], start), np.diff(np.append(start, len(order))))
        repeated = self.doc[order] > least
        return order[~repeated], self.take(order[repeated])


_CELL = "bucket int, kind int, docs binary, ords binary, firsts binary, shape binary, rows binary"


def _cells(kind: int, bucket: np.ndarray, r: _Records, n: int) -> Iterator[tuple]:
    order = np.argsort(bucket, kind="stable")
    cut = _cut(bucket[order], n)
    engine = zstandard.ZstdCompressor(level=3)
    for b in np.flatnonzero(cut[1:] > cut[:-1]):
        own = r.take(order[cut[b] : cut[b + 1]])
        shape = own.offset.astype(np.uint8).tobytes() + own.count.astype(np.uint8).tobytes()
        used = np.arange(_Records.width)[None, :] < (own.count + LENGTH - 1)[:, None]
        rows = engine.compress(own.rows[used].tobytes()) if kind == 0 else b""
        yield int(b), kind, _pack(own.doc), _pack(own.ord), _pack(own.first), shape, rows


def _opened(kind, docs, ords, firsts, shape, rows) -> _Records:
    n = len(shape) // 2
    offset = np.frombuffer(shape, np.uint8, n).astype(np.int64)
    count = np.frombuffer(shape, np.uint8, n, n).astype(np.int64)
    full = np.zeros((n if kind == 0 else 0, _Records.width), np.uint8)
    if kind == 0:
        used = np.arange(_Records.width)[None, :] < (count + LENGTH - 1)[:, None]
        full[used] = np.frombuffer(zstandard.ZstdDecompressor().decompress(rows), np.uint8)
    return _Records(_unpack(docs), _unpack(ords), _unpack(firsts), offset, count, full)


def _covers(r: _Records, covered: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of covered strings: doc, ord, first byte, end; ``covered`` by string."""
    which = np.repeat(np.arange(len(r.doc)), r.count)
    step = np.arange(len(which)) - np.repeat(np.cumsum(r.count) - r.count, r.count)
    on = np.flatnonzero(covered)
    if not len(on):
        e = np.zeros(0, np.int64)
        return e, e, e, e
    new = np.concatenate(([True], (which[on][1:] != which[on][:-1]) | (on[1:] != on[:-1] + 1)))
    a, b = on[new], on[np.append(np.flatnonzero(new)[1:], len(on)) - 1]
    row = which[a]
    return r.doc[row], r.ord[row], r.first[row] + step[a], r.first[row] + step[b] + LENGTH


def _sorted_covers(r: _Records) -> tuple[np.ndarray, ...]:
    """The strings of the records that a smaller document among them also holds."""
    which = np.repeat(np.arange(len(r.doc)), r.count)
    step = np.arange(len(which)) - np.repeat(np.cumsum(r.count) - r.count, r.count)
    strings = np.lib.stride_tricks.sliding_window_view(r.rows, LENGTH, axis=1)[which, step]
    order, same = multikey_sort(tokens(strings))
    start = np.flatnonzero(~same)
    doc = r.doc[which[order]]
    least = np.repeat(np.minimum.reduceat(doc, start), np.diff(np.append(start, len(order))))
    covered = np.zeros(len(order), bool)
    covered[order] = doc > least
    return _covers(r, covered)


def _route(n: int, splitters: np.ndarray, hot: np.ndarray):
    """Records of the joined texts, dealt out to the buckets they are sorted in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            r = _Records.of(batch)
            keep, known = r.spread()
            r = r.take(keep)
            lead = r.leads()
            burning = np.isin(lead, hot) if len(hot) else np.zeros(len(lead), bool)
            cells = []
            if len(known.doc):
                cells += _cells(1, (np.arange(len(known.doc)) * n) // len(known.doc), known, n)
            cool = r.take(~burning)
            if len(cool.doc):
                cells += _cells(0, np.searchsorted(splitters, lead[~burning], "left").astype(np.int64), cool, n)
            if burning.any():
                alone = r.take(burning).split()
                keep, known = alone.spread()
                alone = alone.take(keep)
                mixed = tokens(alone.rows[:, :LENGTH]) @ np.array([0x9E3779B97F4A7C15 * (2 * i + 1) % (1 << 64) for i in range(7)], np.uint64)
                cells += _cells(0, ((mixed >> np.uint64(24)) % np.uint64(n)).astype(np.int64), alone, n)
                if len(known.doc):
                    cells += _cells(1, (np.arange(len(known.doc)) * n) // len(known.doc), known, n)
            if cells:
                names = [c.split()[0] for c in _CELL.split(", ")]
                kinds = [pa.int32(), pa.int32()] + [pa.binary()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*cells, strict=True), kinds, strict=True)], names)

    return run


def _sort_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(found: tuple) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(found[0]), 100_000):
            yield pa.RecordBatch.from_arrays(
                [pa.array(f[i : i + 100_000], t) for f, t in zip(found, (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)],
                ["doc", "ord", "start", "end"],
            )

    held = []
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("kind", "docs", "ords", "firsts", "shape", "rows")]
        for cell in zip(*columns, strict=True):
            r = _opened(*cell)
            if cell[0] == 1:
                yield from out((r.doc, r.ord, r.first, r.first + r.count - 1 + LENGTH))
            else:
                held.append(r)
    if not held:
        return
    r = _Records(*(np.concatenate([getattr(h, k) for h in held]) for k in ("doc", "ord", "first", "offset", "count", "rows")))
    held.clear()
    at = r.offset[:, None] + np.arange(LEAD)[None, :]
    order, same = multikey_sort(tokens(np.take_along_axis(r.rows, at, axis=1)))
    r = r.take(order)
    groups = np.append(np.flatnonzero(~same), len(order))
    upto = np.concatenate(([0], np.cumsum(r.count)))[groups]
    g = 0
    while g < len(groups) - 1:
        stop = max(int(np.searchsorted(upto, upto[g] + BLOCK, "right")) - 1, g + 1)
        yield from out(_sorted_covers(r.take(slice(groups[g], groups[stop]))))
        g = stop


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        plain = zstandard.ZstdDecompressor()
        for tid, packed, starts, ends in zip(*(batch.column(c) for c in ("tid", "packed", "starts", "ends")), strict=True):
            raw = plain.decompress(packed.as_py())
            a, b = (x.values.to_numpy(zero_copy_only=False) for x in (starts, ends))
            depth = np.zeros(len(raw) + 1, np.int64)
            np.add.at(depth, a, 1)
            np.add.at(depth, b, -1)
            gone = np.cumsum(depth)[:-1] > 0
            spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
            kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
            rows.append((tid.as_py(), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
        if rows:
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["tid", "n_removed", "n_spans", "kept"]
            )


def _splitters(spark: SparkSession, joined: DataFrame, n: int, pairs: int) -> tuple[np.ndarray, np.ndarray]:
    """Cuts between the buckets, and the tokens that would fill one by themselves."""
    share = min(1.0, n * SAMPLE_PER_PARTITION / max(pairs, 1))

    def leads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            r = _Records.of(batch)
            keep, _ = r.spread()
            lead = r.take(keep).leads()
            if len(lead):
                raw = np.ascontiguousarray(lead).view(np.uint8).reshape(-1, LEAD)
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in raw], pa.binary())], ["lead"])

    some = joined.where(F.pmod(F.xxhash64("tid"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) + 1))
    found = [r.lead for r in some.mapInArrow(leads, "lead binary").collect()]
    if not found:
        return np.zeros(0, f"S{LEAD}"), np.zeros(0, f"S{LEAD}")
    ordered = np.sort(np.array(found, f"S{LEAD}"))
    cuts = ordered[(np.arange(1, n) * len(ordered)) // n]
    return np.unique(cuts), np.unique(cuts[1:][cuts[1:] == cuts[:-1]])


def repeated_bytes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs`` what is left without the strings of earlier documents.

    Columns doc_id, n_bytes, n_removed, n_spans, kept_sha256. A byte goes when a
    50-byte string over it also starts in a document with a smaller id. A null
    text is empty; a null id counts as larger than all others; rows of one id,
    repeated ones among them, do not take from each other. Texts are compared
    whole, of exact copies only the one with the least id.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    n = partitions(spark)
    raw = F.coalesce(col(text).cast("binary"), F.lit(b""))
    base = docs.select(
        col(doc_id).alias("doc_id"),
        F.coalesce(col(doc_id).cast("bigint"), F.lit(_NULL_ID)).alias("doc"),
        raw.alias("raw"),
        F.octet_length(raw).cast("bigint").alias("n_bytes"),
        F.unhex(F.sha2(raw, 256)).alias("tid"),
    )
    all_docs = materialize(base.select("doc_id", "doc", "n_bytes", "tid"), "suffix-docs")
    least = materialize(all_docs.groupBy("tid").agg(F.min("doc").alias("least")), "suffix-least")
    # Of equal texts only the first can take from others or lose to others.
    firsts = _stored_texts(base, least, n)
    pairs = _shared_anchors(firsts, n).repartition(n, "doc").groupBy("doc").agg(F.collect_list("key").alias("keys"))
    shared = _bucketed(pairs, n, "anchors")
    count = shared.agg(F.coalesce(F.sum(F.size("keys")), F.lit(0)).alias("n")).first().n
    joined = firsts.join(shared, "doc").select("doc", "ord", "tid", "packed", "keys")
    splitters, hot = _splitters(spark, joined, n, count)
    cells = joined.mapInArrow(_route(n, splitters, hot), _CELL)
    covers = cells.repartitionById(n, F.col("bucket")).mapInArrow(_sort_buckets, "doc bigint, ord int, start bigint, end bigint")
    lost = covers.repartition(n, "doc").groupBy("doc", "ord").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))
    cut = firsts.join(lost.withColumnRenamed("ord", "at"), "doc").where("ord = at").select("tid", "doc", "packed", "starts", "ends")
    result = (
        cut.select("tid", "packed", "starts", "ends").mapInArrow(_removed, "tid binary, n_removed bigint, n_spans bigint, kept string")
    )
    done = materialize(result, "suffix-removed")
    known = least.join(done, "tid", "left")
    whole = (F.col("doc") > F.col("least")) & (F.col("n_bytes") >= LENGTH)
    nothing = hashlib.sha256(b"").hexdigest()
    return all_docs.join(known, "tid").select(
        "doc_id",
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("bigint").alias("n_spans"),
        F.when(whole, F.lit(nothing)).otherwise(F.coalesce("kept", F.lower(F.hex("tid")))).alias("kept_sha256"),
    )
