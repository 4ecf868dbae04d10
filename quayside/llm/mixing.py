"""Mixing sources to target weights as a min-cost flow.

Documents are aggregated by the set of sources they belong to. In the network a
membership pattern can send its words to any of its sources once for nothing,
and again for a price that rises with every repetition; each source takes its
quota. The cheapest flow repeats as little text as the targets allow. What a
pattern has to send is then filled with documents in a seeded order.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quayside.llm.common import col, fresh
from quayside.session import materialize

MAX_REPEAT = 3
SEED = 17
#: The network is solved on the driver; more patterns than this are an error.
MAX_PATTERNS = 200_000

#: Slices after the first that does not fit whole in which one round picks documents.
FILL_SLICES = 8
#: More picked documents than this are joined by a shuffle, not a broadcast.
BROADCAST_REFS = 500_000

_PICK = "pattern string, ref bigint, size bigint"

WORD = r"[^\x20\x09-\x0D]+"


def cyclic_weights(sources: list[str | None]) -> dict[str | None, int]:
    """1, 2, 3, repeating, over the sources by code point, null last."""
    ordered = sorted(s for s in sources if s is not None) + [None] * (None in sources)
    return {s: i % 3 + 1 for i, s in enumerate(ordered)}


def capped_targets(
    sizes: dict[str | None, int],
    weights: dict[str | None, float],
    cap: float = MAX_REPEAT,
    total: int | None = None,
) -> dict[str | None, float]:
    """Shares of the total by weight; none above ``cap`` times its source's size.

    What a capped source cannot take goes to the others by weight, until none
    is above its cap. ``total`` defaults to the sum of all sizes.
    """
    whole = sum(sizes.values()) if total is None else total
    out: dict[str | None, float] = {}
    left, free = float(whole), dict(weights)
    while free:
        share = sum(free.values())
        over = [s for s in free if left * free[s] / share > cap * sizes[s]]
        if not over:
            return out | {s: left * w / share for s, w in free.items()}
        for s in over:
            out[s] = float(cap * sizes[s])
            del free[s]
        left = float(whole) - sum(out.values())
    return out


def whole_quotas(targets: dict[str | None, float]) -> dict[str | None, int]:
    """Targets as whole words of the same sum, by largest remainder."""
    base = {s: math.floor(t) for s, t in targets.items()}
    short = round(sum(targets.values())) - sum(base.values())
    by_rest = sorted(targets, key=lambda s: (base[s] - targets[s], s is None, s or ""))
    for s in by_rest[: max(short, 0)]:
        base[s] += 1
    return base


class _Network:
    """Min-cost flow by successive cheapest paths, in whole units."""

    def __init__(self, nodes: int):
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []

    def edge(self, a: int, b: int, room: int, cost: int) -> int:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def solve(self, source: int, sink: int) -> None:
        """All costs are non-negative at first, so Dijkstra with potentials holds."""
        n = len(self.out)
        potential = [0] * n
        while True:
            far = [math.inf] * n
            via = [-1] * n
            far[source] = 0
            queue: list[tuple[float, int]] = [(0, source)]
            while queue:
                d, a = heapq.heappop(queue)
                if d > far[a]:
                    continue
                for e in self.out[a]:
                    b = self.to[e]
                    at = d + self.cost[e] + potential[a] - potential[b]
                    if self.room[e] > 0 and at < far[b]:
                        far[b], via[b] = at, e
                        heapq.heappush(queue, (at, b))
            if via[sink] < 0:
                return
            for a in range(n):
                if far[a] < math.inf:
                    potential[a] += far[a]
            path, b = [], sink
            while b != source:
                path.append(via[b])
                b = self.to[via[b] ^ 1]
            send = min(self.room[e] for e in path)
            for e in path:
                self.room[e] -= send
                self.room[e ^ 1] += send


def _apart(patterns: dict[tuple[str | None, ...], int], quotas: dict[str | None, int]) -> list[tuple[dict, dict]]:
    """Patterns and quotas in groups that share no source, not even through others."""
    leader = {s: s for s in quotas}

    def find(s: str | None) -> str | None:
        while leader[s] != s:
            leader[s] = leader[leader[s]]
            s = leader[s]
        return s

    known = {p: [s for s in p if s in leader] for p in patterns}
    for own in known.values():
        for s in own[1:]:
            leader[find(s)] = find(own[0])
    groups: dict[str | None, tuple[dict, dict]] = {}
    for s, quota in quotas.items():
        groups.setdefault(find(s), ({}, {}))[1][s] = quota
    for p, own in known.items():
        if own:
            groups[find(own[0])][0][p] = patterns[p]
    return list(groups.values())


def route(
    patterns: dict[tuple[str | None, ...], int],
    quotas: dict[str | None, int],
    repeats: int = MAX_REPEAT,
) -> dict[tuple[tuple[str | None, ...], str | None], int]:
    """Words that each pattern of ``patterns`` (its size) sends to each source.

    Groups without a source in common have networks of their own, so sources
    that do not overlap cost a few edges each.
    """
    out: dict[tuple[tuple[str | None, ...], str | None], int] = {}
    for own, quota in _apart(patterns, quotas):
        out |= _route(own, quota, repeats)
    return out


def _route(patterns: dict, quotas: dict, repeats: int) -> dict:
    names = list(quotas)
    first_pattern = 2 + len(names)
    net = _Network(first_pattern + len(patterns))
    node = {s: 2 + i for i, s in enumerate(names)}
    for s in names:
        net.edge(node[s], 1, quotas[s], 0)
    sent = {}
    for i, (members, size) in enumerate(sorted(patterns.items(), key=lambda x: [(m is None, m or "") for m in x[0]])):
        at = first_pattern + i
        for lap in range(repeats):
            net.edge(0, at, size, lap * lap)
        for s in members:
            if s in node:
                sent[(members, s)] = net.edge(at, node[s], repeats * size, 0)
    net.solve(0, 1)
    return {k: net.room[e ^ 1] for k, e in sent.items()}


@dataclass
class Plan:
    """Words and target of each source; words each pattern sends to each source."""

    sizes: dict[str | None, int]
    targets: dict[str | None, float]
    flow: dict[tuple[tuple[str | None, ...], str | None], int]


def _pattern_sizes(sized: DataFrame) -> list:
    rows = (
        sized.groupBy("pattern")
        .agg(F.first("members").alias("members"), F.sum("size").alias("words"), F.count("*").alias("n"))
        .limit(MAX_PATTERNS + 1)
        .collect()
    )
    if len(rows) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    return rows


def _fill(rows: pd.DataFrame) -> pd.DataFrame:
    """Of the given slices, in seeded order, the documents that still fit."""
    left, picked = int(rows["room"].iloc[0]), []
    for at, ref, size in sorted(zip(rows["slice"], rows["ref"], rows["size"], strict=True)):
        if size <= left:
            left -= size
            picked.append((rows["pattern"].iloc[0], ref, size))
    return pd.DataFrame(picked, columns=["pattern", "ref", "size"])


def _cuts(sums: DataFrame) -> list:
    """Of each pattern the first slice that does not fit whole, and the room before it.

    Columns pattern, slice, room, words; a pattern that fits has no row.
    """
    upto = Window.partitionBy("pattern").orderBy("slice")
    return (
        sums.withColumn("rest", F.col("room") - F.sum("words").over(upto) + F.col("words"))
        .where("rest >= 0 AND rest < words")
        .select("pattern", F.col("slice").alias("cut"), F.col("rest").alias("room"))
        .collect()
    )


def _picked(units: DataFrame, cuts: list) -> DataFrame:
    """What is taken of the cut slices and the next few, document by document."""
    spark = units.sparkSession
    at = spark.createDataFrame(cuts, "pattern string, cut int, room bigint")
    return (
        units.join(F.broadcast(at), "pattern")
        .where(F.col("slice").between(F.col("cut"), F.col("cut") + FILL_SLICES))
        .groupBy("pattern")
        .applyInPandas(_fill, _PICK)
    )


def _fill_up(sliced: DataFrame, cuts: list) -> DataFrame:
    """The references that fill the room from the cut slices on, in seeded order.

    Each round takes whole slices up to the next cut and decides the cut and a
    few more document by document. What did not fit will not fit later, so the
    next round looks at the slices behind alone and at documents no larger than
    the room; it goes on until no such document is left.
    """
    spark = sliced.sparkSession
    first = spark.createDataFrame(cuts, "pattern string, cut int, room bigint")
    edge = sliced.join(F.broadcast(first), "pattern").where(F.col("slice").between(F.col("cut"), F.col("cut") + FILL_SLICES))
    units = edge.groupBy("pattern", "slice", "ref").agg(F.sum("size").alias("size"))
    found = [materialize(_picked(units, cuts), "mix-picked")]
    state = {r.pattern: (r.cut + FILL_SLICES, r.room) for r in cuts}
    behind = None
    while True:
        for r in found[-1].groupBy("pattern").agg(F.sum("size").alias("size")).collect():
            if r.pattern in state:  # else all that was left fitted
                state[r.pattern] = (state[r.pattern][0], state[r.pattern][1] - r.size)
        state = {p: x for p, x in state.items() if x[1] > 0}
        if not state:
            break
        open_ = spark.createDataFrame([(p, *x) for p, x in state.items()], "pattern string, edge int, room bigint")
        fits = "slice > edge AND size > 0 AND size <= room"
        if behind is None:
            # Rows that are repeated as a whole are one unit, so their sum must fit.
            behind = materialize(
                sliced.join(F.broadcast(open_), "pattern")
                .where(fits)
                .groupBy("pattern", "slice", "ref", "room")
                .agg(F.sum("size").alias("size"))
                .where("size <= room")
                .drop("room"),
                "mix-behind",
            )
        left = behind.join(F.broadcast(open_), "pattern").where(fits)
        sums = left.groupBy("pattern", "slice", "room").agg(F.sum("size").alias("words"))
        cuts = _cuts(sums)
        cut = {r.pattern: r.cut for r in cuts}
        rule = [(p, edge, room, cut.get(p)) for p, (edge, room) in state.items()]
        rules = spark.createDataFrame(rule, "pattern string, edge int, room bigint, cut int")
        whole = behind.join(F.broadcast(rules), "pattern").where(fits).where("cut IS NULL OR slice < cut").select("pattern", "ref", "size")
        fill = behind.join(F.broadcast(rules.drop("cut")), "pattern").where(fits).select("pattern", "slice", "ref", "size")
        found.append(materialize(whole.unionByName(_picked(fill, cuts)) if cuts else whole, "mix-picked"))
        state = {p: (cut[p] + FILL_SLICES, room) for p, (_, room) in state.items() if p in cut}
    return reduce(DataFrame.unionByName, found).select("pattern", "ref")


def _slice(ref: str, slices: str):
    """The slice of a seeded hash: its place in the whole range, rounded down."""
    return F.floor(F.shiftrightunsigned(col(ref), 11) / F.lit(float(1 << 53)) * col(slices)).cast("int")


def mix(
    docs: DataFrame,
    members: Column,
    *,
    key: str = "doc_id",
    text: str = "text",
    weights: Callable[[list], dict] = cyclic_weights,
    repeats: int = MAX_REPEAT,
    seed: int = SEED,
    out: str = "mix",
) -> tuple[DataFrame, str, Plan]:
    """The rows of ``docs`` with a struct column, its name, and the plan behind it.

    ``members`` is the array of the sources each row belongs to; null is a
    source like any other. The struct holds ``size``, ``copies`` (0 to
    ``repeats``), ``taken = size * copies`` and ``pattern``. Sizes are numbers of
    words; null and empty texts have none.

    A pattern that has to send ``f`` words of its ``s`` is taken ``f // s``
    times as a whole and filled up in the order of a seeded hash of key and
    text, so reruns agree and repeated rows are taken alike. Only sums by
    pattern reach the driver. A pattern has as many slices of that order as the
    square root of its documents; whole slices go by their sums, and only the
    next few are filled document by document, so no task sees more than some
    multiple of that root, whatever a hot source holds. That is repeated over
    the slices behind until the room is smaller than every document there. An
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    name, pattern, ref, size = (fresh(docs, n) for n in (out, "__pattern", "__ref", "__size"))
    sized = docs.withColumns(
        {
            pattern: F.to_json(F.array_sort(F.array_distinct(members))),
            ref: F.xxhash64(F.lit(seed), col(key).cast("string"), col(text)),
            size: F.coalesce(F.regexp_count(col(text), F.lit(WORD)), F.lit(0)).cast("bigint"),
        }
    )
    held = materialize(
        sized.select(
            col(pattern).alias("pattern"), members.alias("members"), col(ref).alias("ref"), col(size).alias("size")
        ),
        "mix-sizes",
    )
    rows = _pattern_sizes(held)
    known = {r.pattern: tuple(dict.fromkeys(r.members)) for r in rows}
    patterns: dict[tuple, int] = {known[r.pattern]: int(r.words) for r in rows}
    sources = {s for p in patterns for s in p}
    sizes = {s: sum(w for p, w in patterns.items() if s in p) for s in sources}
    targets = capped_targets(sizes, weights(list(sources)), repeats, sum(patterns.values()))
    flow = route(patterns, whole_quotas(targets), repeats)
    plan = []
    for r in rows:
        words = int(r.words)
        send = sum(flow.get((known[r.pattern], s), 0) for s in sources)
        laps, rest = divmod(send, words) if words else (0, 0)
        plan.append((r.pattern, int(laps), int(rest), max(1, math.isqrt(int(r.n)))))
    plans = spark.createDataFrame(plan, "pattern string, laps int, rest bigint, slices int")

    sliced = held.join(F.broadcast(plans), "pattern").withColumn("slice", _slice("ref", "slices"))
    sums = sliced.where("rest > 0").groupBy("pattern", "slice", F.col("rest").alias("room")).agg(F.sum("size").alias("words"))
    first = _cuts(sums)
    cuts = spark.createDataFrame(first, "pattern string, cut int, room bigint").drop("room")
    picked = materialize(_fill_up(sliced, first).distinct(), "mix-refs")
    small = picked.count() <= BROADCAST_REFS
    rules = plans.join(cuts, "pattern", "left").select(
        F.col("pattern").alias(pattern),
        F.struct("laps", "slices", "cut", F.lit(True).alias("known")).alias("__rule"),
    )
    chosen = picked.select(F.col("pattern").alias(pattern), F.col("ref").alias(ref), F.lit(True).alias("__picked"))
    extra = F.when(F.col("__picked") | (_slice(ref, "__slices") < F.col("__cut")), 1).otherwise(0)
    taken = (
        sized.join(F.broadcast(rules), pattern, "left")
        .join(F.broadcast(chosen) if small else chosen, [pattern, ref], "left")
        .withColumns({"__slices": F.col("__rule.slices"), "__cut": F.col("__rule.cut")})
        .withColumn("__copies", (F.col("__rule.laps") + extra).cast("int"))
    )
    return (
        taken.select(
            *[col(c) for c in docs.columns],
            F.struct(
                col(size).alias("size"),
                F.col("__copies").alias("copies"),
                (col(size) * F.col("__copies")).alias("taken"),
                col(pattern).alias("pattern"),
            ).alias(name),
        ),
        name,
        Plan(sizes, targets, flow),
    )
