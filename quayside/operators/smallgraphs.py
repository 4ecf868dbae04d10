"""Waiting graphs that fit one task, all of a scope's edges in one row.

A process list rarely has more than a few thousand waits. Scopes of at most
``LIMIT`` edges are gathered, one row for each, and walked in Python within an
Arrow batch; a scope beyond that takes the written rounds of
:mod:`quayside.operators.reach` and :mod:`quayside.operators.blocking`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Edges of a scope that are gathered; sets of so many bits are half a kilobyte.
LIMIT = 4096

Scope = Sequence[str]


def split(edges: DataFrame, scope: Scope, limit: int = LIMIT) -> tuple[DataFrame, DataFrame | None]:
    """Edges of the scopes that can be gathered, and the others if there are any.

    ``edges`` should be a written table, as it is read twice. Nulls of the scope
    are a scope of their own among the gathered ones.
    """
    large = edges.groupBy(*scope).agg(F.count("*").alias("n")).where(F.col("n") > limit).select(*scope)
    if large.isEmpty():
        return edges, None
    return edges.join(large, list(scope), "left_anti"), edges.join(large, list(scope), "left_semi")


def gathered(edges: DataFrame, scope: Scope, columns: Sequence[str]) -> DataFrame:
    """One row for each scope, its edges as the list ``edges`` of the columns."""
    return edges.groupBy(*scope).agg(F.collect_list(F.struct(*columns)).alias("edges"))


def per_scope(
    rows: DataFrame, scope: Scope, schema: str, work: Callable[[pa.StructArray], pa.RecordBatch]
) -> DataFrame:
    """``work`` on the edges of each scope, its rows beside the scope's columns."""
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in scope]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("edges")
            at, made = [], []
            for i in range(batch.num_rows):
                out = work(lists[i].values)
                if out.num_rows:
                    made.append(out)
                    at.append(np.full(out.num_rows, i))
            if made:
                whole = pa.Table.from_batches(made).combine_chunks()
                index = pa.array(np.concatenate(at))
                for c in reversed(scope):
                    whole = whole.add_column(0, c, batch.column(c).take(index))
                yield from whole.to_batches()

    # Lists are bounded by the limit, so batches of few rows bound the memory.
    return rows.select(*scope, "edges").mapInArrow(run, ", ".join([*kept, schema]))


class Graph:
    """Nodes of one scope, numbered, and what hangs below each of them."""

    def __init__(self, above: Sequence, below: Sequence):
        self.names = sorted(set(above) | set(below))
        number = {name: i for i, name in enumerate(self.names)}
        self.below: list[list[int]] = [[] for _ in self.names]
        self.hangs = [False] * len(self.names)
        for a, b in zip(above, below, strict=True):
            if a != b:
                self.below[number[a]].append(number[b])
                self.hangs[number[b]] = True

    def reached(self) -> list[int]:
        """For each node a set of bits: itself and all it leads to.

        Circles are found by Tarjan's method; one is complete only after all it
        leads to, so its set is the union of theirs.
        """
        n = len(self.names)
        order, low, sets = [0] * n, [0] * n, [0] * n
        waiting: list[int] = []
        seen = 0
        for begin in range(n):
            if order[begin]:
                continue
            path = [(begin, iter(self.below[begin]))]
            seen += 1
            order[begin] = low[begin] = seen
            waiting.append(begin)
            while path:
                node, rest = path[-1]
                for to in rest:
                    if not order[to]:
                        seen += 1
                        order[to] = low[to] = seen
                        waiting.append(to)
                        path.append((to, iter(self.below[to])))
                        break
                    if not sets[to]:
                        low[node] = min(low[node], order[to])
                else:
                    path.pop()
                    if path:
                        low[path[-1][0]] = min(low[path[-1][0]], low[node])
                    if low[node] == order[node]:
                        circle = waiting[waiting.index(node) :] if waiting[-1] != node else [node]
                        del waiting[len(waiting) - len(circle) :]
                        whole = 0
                        for c in circle:
                            whole |= 1 << c
                        for c in circle:
                            for to in self.below[c]:
                                whole |= sets[to]
                        for c in circle:
                            sets[c] = whole
        return sets

    def members(self, bits: int) -> list:
        row = np.frombuffer(bits.to_bytes(-(-len(self.names) // 8), "little"), np.uint8)
        return [self.names[i] for i in np.flatnonzero(np.unpackbits(row, bitorder="little"))]


def _graph(edges: pa.StructArray, above: str, below: str) -> Graph:
    return Graph(edges.field(above).to_pylist(), edges.field(below).to_pylist())


def reach_counts(edges: DataFrame, scope: Scope) -> DataFrame:
    """scope, node, reached for edges (scope, child, parent) of gathered scopes."""
    edges = edges.where("child <> parent")
    kind = edges.schema["parent"].dataType.simpleString()

    def work(some: pa.StructArray) -> pa.RecordBatch:
        graph = _graph(some, "parent", "child")
        counts = [s.bit_count() - 1 for s in graph.reached()]
        return pa.RecordBatch.from_arrays(
            [pa.array(graph.names, some.field("parent").type), pa.array(counts, pa.int64())], ["node", "reached"]
        )

    return per_scope(gathered(edges, scope, ["child", "parent"]), scope, f"node {kind}, reached bigint", work)


def members(edges: DataFrame, scope: Scope, roots_only: bool) -> DataFrame:
    """scope, root, node: everything below each node, or below those that hang from none."""
    edges = edges.where("child <> parent")
    kind = edges.schema["parent"].dataType.simpleString()

    def work(some: pa.StructArray) -> pa.RecordBatch:
        graph = _graph(some, "parent", "child")
        roots, nodes = [], []
        for i, bits in enumerate(graph.reached()):
            if graph.hangs[i] and roots_only:
                continue
            found = graph.members(bits & ~(1 << i))
            roots += [graph.names[i]] * len(found)
            nodes += found
        own = some.field("parent").type
        return pa.RecordBatch.from_arrays([pa.array(roots, own), pa.array(nodes, own)], ["root", "node"])

    return per_scope(gathered(edges, scope, ["child", "parent"]), scope, f"root {kind}, node {kind}", work)


def walks(steps: DataFrame, scope: Scope, max_rows: int) -> DataFrame:
    """The rows of :func:`quayside.operators.blocking.walk` for gathered scopes.

    ``steps`` has at, to, ord, present and wait_on.
    """
    kind = steps.schema["at"].dataType.simpleString()
    schema = (
        f"root {kind}, row_no int, depth int, pid {kind}, present boolean, cycle boolean, wait_on string, "
        "truncated boolean, remaining bigint"
    )

    def work(some: pa.StructArray) -> pa.RecordBatch:
        at, to, place, present = (some.field(c).to_pylist() for c in ("at", "to", "ord", "present"))
        after: dict = {}
        for i in sorted(range(len(at)), key=lambda i: (place[i], to[i])):
            after.setdefault(at[i], []).append(i)
        reached = graph = None
        out: list[tuple] = []
        picked: list[int | None] = []
        for root, first in after.items():
            rows = 0
            shown = set()
            path = [root]
            # What is still to be listed at each depth.
            levels = [iter(first)]
            while levels:
                i = next(levels[-1], None)
                if i is None:
                    levels.pop()
                    path.pop()
                    continue
                rows += 1
                depth, node = len(levels) - 1, to[i]
                if rows > max_rows:
                    if graph is None:
                        graph = Graph(at, to)
                        reached = dict(zip(graph.names, graph.reached(), strict=True))
                    rest = reached[root].bit_count() - 1 - len(shown - {root})
                    out.append((root, rows, depth, None, False, False, True, rest))
                    picked.append(None)
                    break
                cycle = node in path
                out.append((root, rows, depth, node, present[i], cycle, False, 0))
                picked.append(i)
                shown.add(node)
                if present[i] and not cycle:
                    levels.append(iter(after.get(node, ())))
                    path.append(node)
        columns = list(zip(*out, strict=True)) if out else [()] * 8
        own, flag = some.field("at").type, pa.bool_()
        kinds = [own, pa.int32(), pa.int32(), own, flag, flag, flag, pa.int64()]
        made = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
        made.insert(6, some.field("wait_on").take(pa.array(picked, pa.int64())))
        names = ["root", "row_no", "depth", "pid", "present", "cycle", "wait_on", "truncated", "remaining"]
        return pa.RecordBatch.from_arrays(made, names)

    columns = ["at", "to", "ord", "present", "wait_on"]
    return per_scope(gathered(steps.where("at IS NOT NULL AND to IS NOT NULL"), scope, columns), scope, schema, work)
