"""Phrases whose words occur together more often than apart.

Candidates are found by Misra-Gries summaries of hashed n-grams. The hash space
is cut into partitions; a summary has for each partition a capacity beyond the
partition's mass divided by the threshold, and takes the same number from all
counters when there are more. Summaries merge by the same rule, so what is taken
from a partition altogether stays below the threshold and an n-gram that reaches
the threshold keeps its counter. The survivors become a bit filter; a second
pass counts what passes it exactly, word by word.

Single words and pairs go first; longer n-grams have mass only where every pair
in them has survived.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quayside.llm.common import bounded_batches, col, partitions
from quayside.session import materialize

LONGEST = 5
THRESHOLD = 100
TOP = 2000
#: Words in which 100 * f(longer) reaches this many times f(phrase) stand for it.
INSIDE = 100

#: Text whose words are looked at together.
BLOCK_BYTES = 4 << 20
#: Counters of a hash partition: at least so many, and at least so many times its
#: mass divided by the threshold. The more there are, the fewer survivors fall
#: short of the threshold.
ROOM, TIMES = 1 << 19, 2
#: That quotient for one hash partition, roughly, and the finest cut of the hash space.
PARTITION_COUNTERS = 1 << 17
CELL_BITS = 16
#: N-grams a task collects before it merges them, and counters after which it
#: passes its summary on and begins another.
MERGE_AFTER, FLUSH_AFTER = 1 << 20, 1 << 21
#: The bit filter has this many bits a survivor, and never more than the second.
BITS_EACH, MOST_BITS = 32, 1 << 28

_MULTIPLIER = 0x9E3779B97F4A7C15
_SPREAD = 0xD6E8FEB86659FD93

_BLANK, _BREAK = 1, 2
_KIND = np.zeros(256, np.uint8)
_KIND[list(b" \t")] = _BLANK
_KIND[list(b".,;:!?\n\x0b\x0c\r")] = _BREAK
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


# -- words and n-grams of a batch --------------------------------------------


class Words:
    """The words of some text: where they lie, their hash, piece and text."""

    def __init__(self, data: np.ndarray, last: bool):
        self.data = _LOWER[data]
        kind = _KIND[data]
        edge = np.flatnonzero(np.diff(kind == 0, prepend=False, append=False))
        self.begin, self.end = edge[::2], edge[1::2]
        self.n = len(self.begin)
        self.piece = np.searchsorted(np.flatnonzero(kind == _BREAK), self.begin)
        #: N-grams that begin at later words are left to the next block.
        self.counted = self.n if last else max(self.n - LONGEST + 1, 0)
        #: The text of each word, by :func:`blocks`.
        self.text = np.zeros(0, np.int64)

    def hashes(self) -> np.ndarray:
        """A hash of each word: a polynomial over its bytes, mixed."""
        powers, inverse = _powers(len(self.data))
        sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * powers, out=sums[1:])
        return _mix((sums[self.end] - sums[self.begin]) * inverse[self.begin])

    def codes(self) -> tuple[np.ndarray, pa.Array]:
        """The number of each word among the distinct words, exactly."""
        size = self.end - self.begin
        after = np.cumsum(size)
        kept = self.data[np.repeat(self.begin - after + size, size) + np.arange(after[-1])]
        offsets = np.concatenate([[0], after]).astype(np.int64)
        made = pa.Array.from_buffers(pa.large_binary(), self.n, [None, pa.py_buffer(offsets), pa.py_buffer(kept)])
        coded = made.dictionary_encode()
        return coded.indices.to_numpy().astype(np.int64), coded.dictionary


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(_SPREAD)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(_SPREAD)
    return h ^ (h >> np.uint64(32))


_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64."""
    if len(_POWERS[0]) < n + 1:
        for i, base in enumerate((_MULTIPLIER, pow(_MULTIPLIER, -1, 1 << 64))):
            steps = np.full(n + 1, base, np.uint64)
            steps[0] = 1
            _POWERS[i] = np.cumprod(steps)
    return _POWERS[0][:n], _POWERS[1]


def _word_end(data: np.ndarray, at: int) -> int:
    """The first place from ``at`` on that is in no word, or the end."""
    while at < len(data):
        gap = np.flatnonzero(_KIND[data[at : at + (1 << 16)]])
        if len(gap):
            return at + int(gap[0])
        at += 1 << 16
    return len(data)


def blocks(texts: Sequence[bytes]) -> Iterator[Words]:
    """The words of ``texts`` block by block.

    A block ends where a word does; its last four words come again at the head
    of the next one, which counts the n-grams that begin with them. One of
    fewer than five words is taken again with more behind it.
    """
    data = np.frombuffer(b"\n".join(texts), np.uint8)
    starts = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
    at, size = 0, BLOCK_BYTES
    while at < len(data):
        stop = _word_end(data, at + size)
        words = Words(data[at:stop], stop == len(data))
        if words.counted:
            words.text = np.searchsorted(starts, words.begin + at, "right") - 1
            yield words
        if stop == len(data):
            return
        if words.counted:
            at, size = at + int(words.begin[words.counted]), BLOCK_BYTES
        elif words.n:
            size *= 2
        else:
            at = stop


class Filter:
    """Bits of the keys that may pass; a set bit may also be another key's."""

    def __init__(self, bits: int, words: np.ndarray):
        self.shift, self.words = np.uint64(64 - bits), words

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = keys >> self.shift
        return (self.words[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def ngrams(words: Words, seeds: np.ndarray, orders: Sequence[int], pairs: Filter | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each order the key at each word, and where an n-gram of it counts.

    ``seeds`` has a number for each text, so that groups have keys of their own.
    """
    h = words.hashes()
    key = _mix(h ^ seeds[words.text])
    alive = linked = np.ones(words.n, bool)
    for order in range(1, max(orders) + 1):
        m = words.n - order + 1
        if m <= 0:
            return
        if order > 1:
            key = _mix(key[:m] * np.uint64(_MULTIPLIER) + h[order - 1 :])
        ok = words.piece[:m] == words.piece[order - 1 :]
        if pairs is not None and order > 1:
            if order == 2:
                linked = ok & pairs.has(key)
            alive = alive[:m] & linked[order - 2 :]
            if order > 2:
                ok &= alive
        if order in orders:
            ok[words.counted :] = False
            yield order, key, ok


# -- summaries ---------------------------------------------------------------


class Summary:
    """Misra-Gries counters of all hash partitions, in order of their keys."""

    def __init__(self, capacity: np.ndarray):
        self.capacity = capacity
        self.bits = max(len(capacity) - 1, 0).bit_length()
        self.taken = np.zeros(len(capacity), np.int64)
        self._keys, self._counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self._waiting: list[np.ndarray] = []
        self._n = 0
        #: Occurrences added so far.
        self.mass = 0

    def add(self, keys: np.ndarray) -> None:
        """Occurrences, one key each."""
        self._waiting.append(keys)
        self._n += len(keys)
        self.mass += len(keys)
        if self._n >= MERGE_AFTER:
            self.settle()

    def settle(self) -> None:
        if self._waiting:
            keys = np.sort(np.concatenate(self._waiting))
            self._waiting, self._n = [], 0
            first = np.flatnonzero(np.diff(keys, prepend=~keys[:1]))
            self.merge(keys[first], np.diff(np.append(first, len(keys))), None)

    def merge(self, keys: np.ndarray, counts: np.ndarray, taken: np.ndarray | None) -> None:
        """Another summary's counters, and what has been taken from it."""
        keys, counts = np.concatenate([self._keys, keys]), np.concatenate([self._counts, counts])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        if len(keys):
            first = np.flatnonzero(np.diff(keys, prepend=~keys[:1]))
            keys, counts = keys[first], np.add.reduceat(counts, first)
        if taken is not None:
            self.taken += taken
        edges = self._edges(keys)
        for p in np.flatnonzero(np.diff(edges) > self.capacity):
            own = counts[edges[p] : edges[p + 1]]
            at = len(own) - int(self.capacity[p]) - 1
            # The largest counter without a place; all lose as much.
            less = np.partition(own, at)[at]
            own -= less
            self.taken[p] += less
        keep = counts > 0
        self._keys, self._counts = keys[keep], counts[keep]

    def _edges(self, keys: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.array([0, len(keys)])
        starts = np.arange(len(self.capacity), dtype=np.uint64) << np.uint64(64 - self.bits)
        return np.append(np.searchsorted(keys, starts), len(keys))

    def __len__(self) -> int:
        return len(self._keys)

    def parts(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
        edges = self._edges(self._keys)
        for p in range(len(self.capacity)):
            some = slice(edges[p], edges[p + 1])
            if edges[p + 1] > edges[p] or self.taken[p]:
                yield p, self._keys[some], self._counts[some], int(self.taken[p])


# -- on Spark ----------------------------------------------------------------


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, Words]]:
    """Block by block: the batch's groups, each text's group and seed, the words."""
    for batch in batches:
        if not batch.num_rows:
            continue
        coded = batch.column("lang").dictionary_encode()
        group = coded.indices.to_numpy().astype(np.int64)
        named = np.array([_seed(g) for g in coded.dictionary.to_pylist()], np.uint64)
        for words in blocks(batch.column("text").to_pylist()):
            yield coded.dictionary, group, named[group], words


def _seed(name: str) -> int:
    h = 0
    for b in name.encode("utf-8", "surrogatepass"):
        h = ((h ^ (b + 1)) * _MULTIPLIER) % (1 << 64)
    return h


def _masses(rows: DataFrame, orders: Sequence[int], pairs) -> DataFrame:
    """Words of each group (cell null) and n-grams of each cell of the hash space."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, groups = np.zeros(1 << CELL_BITS, np.int64), {}
        for names, group, seeds, words in _texts(batches):
            own = np.bincount(group[words.text[: words.counted]], minlength=len(names))
            for name, n in zip(names.to_pylist(), own.tolist(), strict=True):
                groups[name] = groups.get(name, 0) + n
            for _, key, ok in ngrams(words, seeds, orders, pairs and pairs.value):
                cells += np.bincount((key[ok] >> np.uint64(64 - CELL_BITS)).astype(np.int64), minlength=len(cells))
        seen = np.flatnonzero(cells)
        names = list(groups)
        yield pa.RecordBatch.from_pydict(
            {
                "lang": pa.array([None] * len(seen) + names, pa.string()),
                "cell": pa.array(seen.tolist() + [None] * len(names), pa.int32()),
                "n": pa.array(cells[seen].tolist() + [groups[g] for g in names], pa.int64()),
            }
        )

    made = rows.mapInArrow(count, "lang string, cell int, n bigint")
    return materialize(made.groupBy("lang", "cell").agg(F.sum("n").alias("n")), "phrase-mass")


def _survivors(rows: DataFrame, masses: DataFrame, orders: Sequence[int], pairs, threshold: int) -> DataFrame:
    """Keys of all n-grams that may reach the threshold, and of few others."""
    spark = rows.sparkSession
    # At most one row for each cell of the hash space.
    found = masses.where("cell IS NOT NULL").select("cell", "n").toPandas()
    cells = np.zeros(1 << CELL_BITS, np.int64)
    cells[found["cell"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    bits = min(max((int(cells.sum()) // threshold // PARTITION_COUNTERS).bit_length(), 6), CELL_BITS)
    # More than a partition's mass divided by the threshold, so less than the
    # threshold is ever taken from it.
    capacity = np.maximum(ROOM, TIMES * (cells.reshape(1 << bits, -1).sum(axis=1) // threshold + 1))

    def summarize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summary = Summary(capacity)
        for _, _, seeds, words in _texts(batches):
            for _, key, ok in ngrams(words, seeds, orders, pairs and pairs.value):
                summary.add(key[ok])
            if len(summary) >= FLUSH_AFTER or summary.mass >= 1 << 31:
                summary.settle()
                yield from _sent(summary)
                summary = Summary(capacity)
        summary.settle()
        yield from _sent(summary)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, one = None, Summary(capacity[:1])

        def ended() -> Iterator[pa.RecordBatch]:
            for _, keys, counts, taken in one.parts():
                for i in range(0, len(keys), 1 << 18):
                    some = keys[i : i + (1 << 18)][counts[i : i + (1 << 18)] + taken >= threshold]
                    yield pa.RecordBatch.from_pydict({"key": pa.array(some.view(np.int64))})

        for batch in batches:
            for r in batch.to_pylist():
                if r["part"] != at:
                    yield from ended()
                    at, one = r["part"], Summary(capacity[r["part"] : r["part"] + 1])
                keys = np.cumsum(np.frombuffer(_open(r["keys"]), np.uint64))
                one.merge(keys, np.frombuffer(_open(r["counts"]), np.uint32).astype(np.int64), np.array([r["taken"]]))
        yield from ended()

    sent = rows.mapInArrow(summarize, "part int, keys binary, counts binary, taken bigint")
    dealt = sent.repartition(min(1 << bits, partitions(spark)), "part").sortWithinPartitions("part")
    return materialize(dealt.mapInArrow(merge, "key bigint"), "phrase-keys")


def _squeeze(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _open(packed: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(packed)


def _sent(summary: Summary) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for p, keys, counts, taken in summary.parts():
        # Counters are those of one task, some millions of n-grams.
        gaps = _squeeze(np.diff(keys, prepend=np.uint64(0)).tobytes())
        held.append({"part": p, "keys": gaps, "counts": _squeeze(counts.astype(np.uint32).tobytes()), "taken": taken})
        size += 8 * len(keys)
        if size >= 4 << 20:
            yield pa.RecordBatch.from_pylist(held, _SENT)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, _SENT)


_SENT = pa.schema([("part", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("taken", pa.int64())])


def _filter(keys: DataFrame):
    """The keys as a bit filter in every task; of ``MOST_BITS`` at most."""
    spark = keys.sparkSession
    bits = min(max((BITS_EACH * keys.count()).bit_length(), 16), MOST_BITS.bit_length() - 1)
    at = F.shiftrightunsigned("key", 64 - bits)
    mask = F.call_function("shiftleft", F.lit(1).cast("bigint"), (at % 64).cast("int"))
    # A row for each word of the filter that has a bit set.
    found = keys.groupBy(F.shiftright(at, 6).alias("word")).agg(F.bit_or(mask).alias("mask")).toPandas()
    words = np.zeros(1 << (bits - 6), np.uint64)
    words[found["word"].to_numpy(np.int64)] = found["mask"].to_numpy(np.int64).view(np.uint64)
    return spark.sparkContext.broadcast(Filter(bits, words))


def _exact(rows: DataFrame, short, long, expected: int, threshold: int) -> DataFrame:
    """Exact counts of the n-grams that pass the filters and reach the threshold.

    Columns: lang, phrase, words, f. A task adds up what it has seen and sends
    it as one packed table for each part of the hash space; parts are added up
    one by one, and only what reaches the threshold becomes rows.
    """
    bits = max((expected >> 16).bit_length(), 6)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Sums()
        for names, group, seeds, words in _texts(batches):
            for table in _counted(names, group, seeds, words, short.value, long.value):
                part = (table.column("key").to_numpy().view(np.uint64) >> np.uint64(64 - bits)).astype(np.int32)
                held.add(table.drop_columns("key").append_column("part", pa.array(part)))
            if held.rows >= FLUSH_AFTER // 8:
                yield from held.packed()
        yield from held.packed()

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, _Sums()
        for batch in batches:
            for part, packed in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                if part != at:
                    yield from held.frequent(threshold)
                    at = part
                held.add(pa.ipc.open_stream(packed).read_all())
        yield from held.frequent(threshold)

    sent = rows.mapInArrow(count, "part int, counts binary")
    dealt = sent.repartition(min(1 << bits, partitions(rows.sparkSession)), "part").sortWithinPartitions("part")
    return dealt.mapInArrow(add_up, "lang string, phrase string, words int, f bigint")


class _Sums:
    """Tables of part, lang, phrase, words and f, added up when there are many."""

    _KEYS = ["part", "lang", "phrase", "words"]

    def __init__(self) -> None:
        self._tables: list[pa.Table] = []
        self.rows = self._waiting = 0

    def add(self, table: pa.Table) -> None:
        self._tables.append(table.select([*self._KEYS, "f"]))
        self._waiting += table.num_rows
        if self._waiting >= max(1 << 18, self.rows):
            self._settle()

    def _settle(self) -> pa.Table:
        whole = pa.concat_tables(self._tables)
        whole = whole.group_by(self._KEYS).aggregate([("f", "sum")]).rename_columns([*self._KEYS, "f"])
        self._tables, self.rows, self._waiting = [whole], whole.num_rows, 0
        return whole

    def _all(self) -> pa.Table | None:
        whole = self._settle() if self._tables else None
        self._tables, self.rows = [], 0
        return whole

    def packed(self) -> Iterator[pa.RecordBatch]:
        """One row for each part, its counts as a compressed Arrow stream."""
        whole = self._all()
        if whole is None:
            return
        whole = whole.sort_by("part").combine_chunks()
        part = whole.column("part").to_numpy()
        edges = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(part))
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for a, b in zip(edges, edges[1:], strict=False):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, whole.schema, options=options) as out:
                out.write_table(whole.slice(a, b - a))
            yield pa.RecordBatch.from_pydict(
                {"part": pa.array([part[a]], pa.int32()), "counts": pa.array([sink.getvalue().to_pybytes()], pa.binary())}
            )

    def frequent(self, threshold: int) -> Iterator[pa.RecordBatch]:
        whole = self._all()
        if whole is not None:
            kept = whole.filter(pc.field("f") >= threshold).drop_columns("part")
            kept = kept.set_column(1, "phrase", kept.column("phrase").cast(pa.string()))
            yield from kept.to_batches(max_chunksize=10_000)


def _counted(
    names: pa.Array, group: np.ndarray, seeds: np.ndarray, words: Words, short: Filter, long: Filter
) -> Iterator[pa.Table]:
    """Exact counts within a block of the n-grams that pass the filters, with their keys."""
    code, distinct = words.codes()
    # Numbers of n-grams grow from those of their first words, so equal numbers
    # are equal words; no hash decides here.
    number = group[words.text] * len(distinct) + code
    for order, key, ok in ngrams(words, seeds, range(1, LONGEST + 1), short):
        # A first part that has not passed is not frequent either.
        at = np.flatnonzero(ok if order == 1 else ok & (number[: len(key)] >= 0))
        at = at[(short if order < 3 else long).has(key[at])]
        whole = number[at] if order == 1 else number[at] * len(distinct) + code[at + order - 1]
        _, first, inverse, n = np.unique(whole, return_index=True, return_inverse=True, return_counts=True)
        number = np.full(words.n, -1, np.int64)
        number[at] = inverse
        if not len(first):
            continue
        at = at[first]
        parts = [distinct.take(pa.array(code[at + i])) for i in range(order)]
        phrase = pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.large_binary())) if order > 1 else parts[0]
        yield pa.table(
            {
                "lang": names.take(pa.array(group[words.text[at]])).cast(pa.string()),
                "phrase": phrase.cast(pa.binary()),
                "words": pa.array(np.full(len(at), order, np.int32)),
                "f": pa.array(n.astype(np.int64)),
                "key": pa.array(key[at].view(np.int64)),
            }
        )


def frequent_phrases(
    docs: DataFrame, *, text: str = "text", lang: str = "lang", threshold: int = THRESHOLD
) -> tuple[DataFrame, DataFrame]:
    """All phrases of one to five words with their counts, and each group's words.

    The first frame has lang, phrase, words, f, exact, for every f of at least
    ``threshold``; the second lang, n. Null texts are empty, null groups are
    ``und``; repeated rows count each time. Texts are read in blocks whatever
    their length. An empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(
        F.coalesce(col(lang).cast("string"), F.lit("und")).alias("lang"),
        F.coalesce(col(text), F.lit("")).cast("binary").alias("text"),
    )
    masses = _masses(rows, (1, 2), None)
    few = _survivors(rows, masses, (1, 2), None, threshold)
    short = _filter(few)
    longer = range(3, LONGEST + 1)
    more = _survivors(rows, _masses(rows, longer, short), longer, short, threshold)
    counted = _exact(rows, short, _filter(more), few.count() + more.count(), threshold)
    counted = materialize(counted, "phrase-counts")
    return counted, masses.where("cell IS NULL").select("lang", "n")


def score(a: Column, n: Column, l: Column, r: Column) -> Column:
    """floor(1000 * a * n / (l * r)), exactly: products of two longs fit 38 digits."""
    big = lambda c, d: c.cast(f"decimal({d},0)")
    return F.call_function("div", big(a * 1000, 19) * big(n, 19), big(l, 19) * big(r, 19))


def collocations(
    docs: DataFrame,
    *,
    text: str = "text",
    lang: str = "lang",
    threshold: int = THRESHOLD,
    top: int = TOP,
    inside: int = INSIDE,
) -> DataFrame:
    """Each group's best phrases of two to five words: lang, rank, phrase, a, l, r, n, score.

    A phrase's score is that of its weakest cut into two parts, the earliest of
    equals. A phrase inside a longer one that has at least ``inside`` per cent
    of its count is left out. Ties of score go to the larger count, then to
    the phrase that comes first by its bytes. For nulls, long texts, repeated
    rows and empty tables see :func:`frequent_phrases`.
    """
    counted, totals = frequent_phrases(docs, text=text, lang=lang, threshold=threshold)
    parts = F.split("phrase", " ")
    found = counted.where("words > 1").withColumn("w", parts)
    cuts = found.select("lang", "phrase", "words", "w", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select(
        "lang",
        "phrase",
        "a",
        "k",
        F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("head"),
        F.array_join(F.slice("w", F.col("k") + 1, F.col("words") - F.col("k")), " ").alias("tail"),
    )
    of = lambda part, f: counted.select("lang", F.col("phrase").alias(part), F.col("f").alias(f))
    cuts = cuts.join(of("head", "l"), ["lang", "head"]).join(of("tail", "r"), ["lang", "tail"]).join(totals, "lang")
    scored = cuts.withColumn("score", score(F.col("a"), F.col("n"), F.col("l"), F.col("r")))
    best = scored.groupBy("lang", "phrase").agg(
        F.max("a").alias("a"), F.max("n").alias("n"), F.min(F.struct("score", "k", "l", "r")).alias("cut")
    )
    # Whatever lies in a longer phrase lies in one longer by a single word,
    # which occurs at least as often.
    less = F.col("words") - 1
    shorter = F.array(*[F.array_join(F.slice("w", F.lit(i), less), " ") for i in (1, 2)])
    around = found.where("words > 2").select("lang", F.explode(shorter).alias("phrase"), "f")
    around = around.groupBy("lang", "phrase").agg(F.max("f").alias("around"))
    kept = best.join(around, ["lang", "phrase"], "left").where(
        F.col("around").isNull() | (100 * F.col("around") < inside * F.col("a"))
    )
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    return (
        kept.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= top)
        .select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    )
