"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints within ``radius`` bits agree on at least ``blocks - radius`` of
any ``blocks`` blocks of their bits, so grouping by every choice of that many
blocks brings each close pair together at least once. Inside a group the bit
planes of all members are stored vertically, one machine word for 64 members;
carry-save counters update all their distances plane by plane, and a block of
members is left as soon as each is beyond the radius.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quayside.llm.common import bounded_batches, col, fresh, partitions
from quayside.session import materialize

SHINGLE = 3
RADIUS = 3
SEED = 42
#: Blocks of the 64 bits; 20 groupings by three of the six.
BLOCKS = 6
#: A larger group is grouped again by some of the bits left. One with fifteen bits
#: left has no more members than this.
GROUP_LIMIT = 1 << 15
#: Edges that one task of a star round writes.
TASK_EDGES = 1 << 18
_QUERIES, _WORDS = 256, 64


# -- fingerprints ------------------------------------------------------------


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The majority bits of the hashes of all shingles, as an unsigned number.

    Words end at ASCII white space; A-Z are lower-cased. Fewer words than a
    shingle count as one; a null text or one without words gives zero.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        parts = [b" ".join(words)]
    else:
        parts = [b" ".join(p) for p in zip(*(words[i:] for i in range(shingle)), strict=False)]
    ones = np.zeros(64, np.int64)
    hashed = xxhash.xxh64_intdigest
    for i in range(0, len(parts), 1 << 16):
        some = parts[i : i + (1 << 16)]
        h = np.fromiter((hashed(p, SEED) for p in some), ">u8", len(some))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(parts)).tobytes(), "big")


def fingerprints(text: Column, shingle: int = SHINGLE) -> Column:
    """The fingerprint as a signed 64-bit number."""

    @F.arrow_udf("bigint")
    def made(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            values = np.fromiter((fingerprint(t.as_py(), shingle) for t in texts), np.uint64, len(texts))
            yield pa.array(values.view(np.int64))

    return made(text)


# -- comparison inside a group -----------------------------------------------


def bit_planes(values: np.ndarray) -> np.ndarray:
    """Plane b holds bit b of every value, 64 values in a word."""
    planes = np.zeros((64, -(-len(values) // 64) * 8), np.uint8)
    for b in range(64):
        bits = ((values >> np.uint64(b)) & np.uint64(1)).astype(np.uint8)
        packed = np.packbits(bits, bitorder="little")
        planes[b, : len(packed)] = packed
    return planes.view(np.uint64)


def near(
    values: np.ndarray, planes: np.ndarray, asked: np.ndarray, bits: list[int], radius: int, together: bool = False
) -> np.ndarray:
    """For each asked value a row of words marking the values within the radius.

    Distances are counted over ``bits`` alone; the others are known to agree.
    ``together`` makes one row that marks what is near any of the asked ones.
    """
    words = planes.shape[1]
    out = np.zeros((1 if together else len(asked), words), np.uint64)
    levels = int(radius + 1).bit_length()
    start = (1 << levels) - (radius + 1)  # the counter runs over at radius + 1
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    for q in range(0, len(asked), _QUERIES):
        some = asked[q : q + _QUERIES]
        flips = [np.where((some >> np.uint64(b)) & np.uint64(1), full, np.uint64(0))[:, None] for b in bits]
        for w in range(0, words, _WORDS):
            block = planes[:, w : w + _WORDS]
            shape = (len(some), block.shape[1])
            count = [np.full(shape, full if start >> i & 1 else 0, np.uint64) for i in range(levels)]
            over = np.zeros(shape, np.uint64)
            for i in range(0, len(bits), 2):
                x = block[bits[i]] ^ flips[i]
                y = block[bits[i + 1]] ^ flips[i + 1] if i + 1 < len(bits) else np.zeros_like(x)
                # Two planes and the counter's lowest digit make a sum and a carry.
                half = x ^ y
                carry = (x & y) | (count[0] & half)
                count[0] ^= half
                for k in range(1, levels):
                    carry, count[k] = count[k] & carry, count[k] ^ carry
                over |= carry
                if (over == full).all():
                    break
            if together:
                out[0, w : w + _WORDS] |= np.bitwise_or.reduce(~over, axis=0)
            else:
                out[q : q + _QUERIES, w : w + _WORDS] = ~over
    spare = -len(values) % 64
    if spare:
        out[:, -1] &= full >> np.uint64(spare)
    return out


def forest(values: np.ndarray, bits: list[int], radius: int) -> list[tuple[int, int]]:
    """Links that connect what the pairs within the radius connect.

    The search goes from member to member and never lists the pairs of a group.
    Each member it reaches is linked to the one it began with, so there is at
    most one link for each member.
    """
    planes = bit_planes(values)
    left = np.full(planes.shape[1], 0xFFFFFFFFFFFFFFFF, np.uint64)
    if len(values) % 64:
        left[-1] >>= np.uint64(-len(values) % 64)
    everyone = near(values, planes, values, bits, radius) if len(values) <= 512 else None
    links = []
    for first in range(len(values)):
        if not left[first >> 6] >> np.uint64(first & 63) & np.uint64(1):
            continue
        left[first >> 6] &= ~(np.uint64(1) << np.uint64(first & 63))
        front = np.array([first])
        while len(front):
            if everyone is not None:
                new = np.bitwise_or.reduce(everyone[front], axis=0) & left
            else:
                new = near(values, planes, values[front], bits, radius, together=True)[0] & left
            left &= ~new
            front = np.flatnonzero(np.unpackbits(new.view(np.uint8), bitorder="little"))
            links += [(int(values[first]), int(values[i])) for i in front]
    return links


# -- groups over Spark -------------------------------------------------------


def _blocks(width: int, start: int, count: int) -> list[list[int]]:
    cuts = [start + width * i // count for i in range(count + 1)]
    return [list(range(a, b)) for a, b in itertools.pairwise(cuts)]


def _mask(bits: list[int]) -> int:
    m = sum(1 << b for b in bits)
    return m - (1 << 64) if m >> 63 else m


def _groupings(radius: int) -> list[list[int]]:
    """The bits that each grouping goes by."""
    blocks = _blocks(64, 0, max(BLOCKS, radius + 3))
    keep = max(len(blocks) - radius, 1)
    return [sum(c, []) for c in itertools.combinations(blocks, keep)] if radius < len(blocks) else [[]]


def _compare(radius: int, keyed: list[list[int]], limit: int):
    """Rows (grouping, key, fp) sorted by the first two, to links and leftovers.

    A group beyond ``limit`` is passed on piece by piece and never held whole,
    unless no more than fifteen bits are left to differ in.
    """
    schema = pa.schema([("grouping", pa.int32()), ("a", pa.int64()), ("b", pa.int64())])
    free = [[b for b in range(64) if b not in set(bits)] for bits in keyed]
    most = [max(limit, 1 << 15) if len(bits) <= 15 else limit for bits in free]

    def closed(grouping: int, values: np.ndarray, out: list) -> None:
        if len(values) > 1:
            made = forest(values, free[grouping], radius)
            out += [(None, a - (a >> 63 << 64), b - (b >> 63 << 64)) for a, b in made]

    def linked(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    def left(grouping: int, values: np.ndarray) -> pa.RecordBatch:
        n = len(values)
        parts = [pa.array(np.full(n, grouping, np.int32)), pa.array(values.view(np.int64)), pa.nulls(n, pa.int64())]
        return pa.RecordBatch.from_arrays(parts, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, wide = None, [], False
        for batch in batches:
            g, k, v = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            if not len(g):
                continue
            edges = np.flatnonzero((g[1:] != g[:-1]) | (k[1:] != k[:-1])) + 1
            out: list[tuple] = []
            starts, ends = np.r_[0, edges], np.r_[edges, len(g)]
            single = ends - starts == 1
            single[0] = single[-1] = False
            for s, e in zip(starts[~single], ends[~single], strict=True):
                now = (int(g[s]), int(k[s]))
                if now != last:
                    if held:
                        closed(last[0], np.concatenate(held), out)
                    last, held, wide = now, [], False
                held.append(v[s:e].view(np.uint64))
                if wide or sum(map(len, held)) > most[now[0]]:
                    yield left(now[0], np.concatenate(held))
                    held, wide = [], True
            if out:
                yield linked(out)
        out = []
        if held:
            closed(last[0], np.concatenate(held), out)
        if out:
            yield linked(out)

    return run


def _grouped(rows: DataFrame, radius: int, keyed: list[list[int]], limit: int) -> DataFrame:
    ordered = rows.repartition("grouping", "key").sortWithinPartitions("grouping", "key")
    made = ordered.select("grouping", "key", "fp").mapInArrow(
        _compare(radius, keyed, limit), "grouping int, a bigint, b bigint"
    )
    return materialize(made, "simhash-links")


def links(distinct: DataFrame, radius: int = RADIUS, limit: int = GROUP_LIMIT) -> DataFrame:
    """Pairs (a, b) that connect all fingerprints (column fp) within the radius.

    The two of a pair reach each other over steps within the radius.

    A group beyond ``limit`` members is not compared at once: it is grouped
    again by each of ``radius + 1`` parts of the bits that are left free, one of
    which agrees in every close pair. With fewer bits left there are fewer
    distinct members, so this ends after a few rounds.
    """
    keyed = _groupings(radius)
    spread = distinct.select(
        "fp",
        F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_mask(bits))) for bits in keyed])).alias("grouping", "key"),
    )
    made = None
    while True:
        found = _grouped(spread, radius, keyed, limit)
        own = found.where("grouping IS NULL").select("a", "b")
        made = own if made is None else made.unionByName(own)
        large = found.where("grouping IS NOT NULL")
        wide = sorted(r.grouping for r in large.select("grouping").distinct().collect())
        if not wide:
            return made
        finer, masks = [], []
        for g in wide:
            rest = [b for b in range(64) if b not in set(keyed[g])]
            for part in range(radius + 1):
                bits = keyed[g] + rest[len(rest) * part // (radius + 1) : len(rest) * (part + 1) // (radius + 1)]
                masks.append((g, len(finer), _mask(bits)))
                finer.append(bits)
        # No more rows than there are groupings.
        table = distinct.sparkSession.createDataFrame(masks, "was int, grouping int, mask bigint")
        again = large.select(F.col("a").alias("fp"), F.col("grouping").alias("was")).join(F.broadcast(table), "was")
        spread = again.select("fp", "grouping", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
        keyed = finer


# -- components --------------------------------------------------------------


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on edges (v, u) with u < v."""
    if large:
        both = edges.unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
    else:
        both = edges
    least = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
    out = both.join(least, "v")
    moved = out.where("u > v") if large else out
    pairs = moved.select(F.col("u").alias("v"), F.col("m").alias("u"))
    if not large:
        pairs = pairs.unionByName(least.select("v", F.col("m").alias("u")))
    return pairs.where("u < v").distinct()


def components(pairs: DataFrame) -> DataFrame:
    """Columns node, root: every node of ``pairs`` with the least one it reaches.

    Alternating large and small stars; each round is a written table, and the
    rounds end when one changes nothing.
    """
    edges = materialize(
        pairs.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(),
        "simhash-edges",
    )

    def state(e: DataFrame):
        return e.agg(F.count("*"), F.bit_xor(F.xxhash64("v", "u")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    seen = state(edges)
    while seen[0]:
        # One file for a task's worth of edges, not one for each shuffle partition.
        tasks = min(-(-seen[0] // TASK_EDGES), partitions(edges.sparkSession))
        edges = materialize(_star(_star(edges, True), False).coalesce(tasks), "simhash-star")
        now = state(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("v").alias("node"), F.col("u").alias("root"))


def cluster(prints: DataFrame, doc_id: str = "doc_id", fp: str = "fp", radius: int = RADIUS) -> DataFrame:
    """Columns doc_id, fp, component_id and root (the least fingerprint) for every row.

    Equal fingerprints are compared once, whatever the number of copies. A
    component's id is the least document id in it; null ids do not count, and
    a component of null ids only has a null id. Empty input, empty result.
    """
    rows = prints.select(col(doc_id).alias("doc_id"), col(fp).alias("fp"))
    nodes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    roots = components(links(nodes.select("fp"), radius))
    placed = nodes.join(roots, nodes["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    ids = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = placed.join(ids, "root").select("fp", "root", "component_id")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id", "root")


def fingerprint_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` but those near a row of a smaller id.

    Of repeated rows, and of rows that share the least id of a component, one
    stays.
    """
    bounded_batches(docs.sparkSession)
    fp = fresh(docs, "__fp")
    held = materialize(docs.withColumn(fp, fingerprints(col(text), shingle)), "simhash-docs")
    found = cluster(held, doc_id, fp, radius)
    kept = (
        found.where("doc_id <=> component_id")
        .groupBy("root")
        .agg(F.min("fp").alias("__kept_fp"), F.first("doc_id").alias("__kept_id"))
        .select("__kept_fp", "__kept_id")
    )
    same = held[doc_id].eqNullSafe(kept["__kept_id"]) & (held[fp] == kept["__kept_fp"])
    one = held.join(kept, same, "left_semi")
    rank = fresh(one, "__rank")
    order = Window.partitionBy(col(doc_id), col(fp)).orderBy(col(text))
    return one.withColumn(rank, F.row_number().over(order)).where(col(rank) == 1).select(*[col(c) for c in docs.columns])
