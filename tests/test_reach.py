"""Counts and chains of waiting graphs, by rounds and gathered, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from quayside.operators import blocking, smallgraphs
from quayside.operators.reach import reach_counts, root_members

EDGES = "scope int, child bigint, parent bigint"


def below(edges):
    """(scope, node) -> everything below it, itself left out."""
    after = {}
    nodes = set()
    for s, c, p in edges:
        if s is not None and c is not None and p is not None and c != p:
            after.setdefault((s, p), set()).add(c)
            nodes |= {(s, c), (s, p)}
    found = {}
    for s, n in nodes:
        seen, front = set(), [n]
        while front:
            for to in after.get((s, front.pop()), ()):
                if to not in seen:
                    seen.add(to)
                    front.append(to)
        found[s, n] = seen - {n}
    return found


@pytest.fixture(scope="module")
def graphs():
    """Trees, diamonds, circles of one and of several parents, repeated and odd edges."""
    rng = random.Random(11)
    edges = []
    for s in range(40):
        n = rng.randrange(2, 14)
        for c in range(n):
            for _ in range(rng.choice([0, 1, 1, 1, 1, 2, 3])):
                edges.append((s, c, rng.randrange(n)))
        # A circle, a way into it, and a tail below.
        if s % 3 == 0:
            edges += [(s, 100, 101), (s, 101, 102), (s, 102, 100), (s, 103, 101), (s, 104, 103)]
        if s % 6 == 0:
            edges += [(s, 0, 104), (s, 105, 100), (s, 105, 0)]
    return edges + edges[:20] + [(1, None, 2), (1, 2, None), (2, 7, 7)]


def test_counts_by_rounds(spark, graphs):
    got = reach_counts(spark.createDataFrame(graphs, EDGES), ["scope"], blocking.closure).collect()
    assert {(r.scope, r.node): r.reached for r in got} == {k: len(v) for k, v in below(graphs).items()}
    assert len(got) == len(below(graphs))


def test_counts_of_gathered_scopes(spark, graphs):
    got = smallgraphs.reach_counts(spark.createDataFrame(graphs, EDGES), ["scope"]).collect()
    assert sorted((r.scope, r.node, r.reached) for r in got) == sorted((*k, len(v)) for k, v in below(graphs).items())


@pytest.mark.parametrize("rounds", [True, False])
def test_members_of_roots(spark, graphs, rounds):
    frame = spark.createDataFrame(graphs, EDGES)
    found = root_members(frame, ["scope"], blocking.closure) if rounds else smallgraphs.members(frame, ["scope"], True)
    waiting = {(s, c) for s, c, p in graphs if c is not None and p is not None and c != p}
    want = [(s, r, n) for (s, r), nodes in below(graphs).items() if (s, r) not in waiting for n in nodes]
    assert sorted((r.scope, r.root, r.node) for r in found.collect()) == sorted(want)


def test_all_pairs_of_gathered_scopes(spark, graphs):
    found = smallgraphs.members(spark.createDataFrame(graphs, EDGES), ["scope"], False).collect()
    assert sorted((r.scope, r.root, r.node) for r in found) == sorted((*k, n) for k, v in below(graphs).items() for n in v)


def test_empty_table(spark):
    none = spark.createDataFrame([], EDGES)
    assert reach_counts(none, ["scope"], blocking.closure).count() == 0
    assert root_members(none, ["scope"], blocking.closure).count() == 0
    assert smallgraphs.reach_counts(none, ["scope"]).count() == 0


def test_long_chain_and_wide_star(spark):
    """Beyond the gathered size; a list of all pairs would have fifty million rows."""
    chain = spark.range(10_000).select(F.lit(1).alias("snapshot"), F.col("id").alias("pid"), (F.col("id") + 1).alias("blocker_pid"))
    star = spark.range(1, 100_001).select(F.lit(2).alias("snapshot"), F.col("id").alias("pid"), F.lit(0).cast("bigint").alias("blocker_pid"))
    edges = chain.unionByName(star)
    got = blocking.behind_counts(edges, ["snapshot"])
    assert "CartesianProduct" not in got._jdf.queryExecution().executedPlan().toString()
    counts = {(r.snapshot, r.pid): r.blocking_count for r in got.where("snapshot = 1 OR pid = 0").collect()}
    assert counts[2, 0] == 100_000
    assert all(counts[1, p] == p for p in range(10_001))
    roots = blocking.root_counts(edges, ["snapshot"]).collect()
    assert sorted((r.snapshot, r.root, r.blocked_count) for r in roots) == [(1, 10_000, 10_000), (2, 0, 100_000)]


def test_walk_by_levels_equals_gathered(spark, graphs, monkeypatch):
    rows = [(s, c, p, i) for i, (s, c, p) in enumerate(dict.fromkeys(graphs)) if None not in (s, c, p)]
    edges = spark.createDataFrame(rows, "snapshot int, pid bigint, blocker_pid bigint, ord int")
    sessions = edges.select("snapshot", "pid").distinct().withColumns(
        {"wait_event_type": F.lit("Lock"), "wait_event": F.lit("tuple")}
    )
    gathered = blocking.walk(sessions, edges, ["snapshot"], max_rows=3).collect()
    monkeypatch.setattr(smallgraphs.split, "__defaults__", (0,))
    levels = blocking.walk(sessions, edges, ["snapshot"], max_rows=3).collect()
    assert sorted(map(repr, gathered)) == sorted(map(repr, levels))
