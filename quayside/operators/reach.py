"""How much lies behind each node of a waiting graph, without listing pairs.

Edges say that ``child`` hangs below ``parent``, within a scope. A node with one
parent points to it; pointers double every round, so a chain of d nodes takes
log2(d) rounds, and the sums below each node double along with them. A node with
several parents heads a tree of its own and keeps its parents as entries. So
does the least node of a circle of single parents: cutting its pointer turns the
circle into a chain. Sets are kept only for the nodes above an entry: which
heads hang below them, directly or through other heads.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.session import materialize

Scope = Sequence[str]
Closure = Callable[[DataFrame, Scope], DataFrame]


@dataclass
class Forest:
    """``nodes``: scope, node, top (the head of its tree), below (nodes of its
    subtree, itself included), root (whether it has no parent). ``entries``:
    scope, node, head, a parent of each head that has any. ``jumps[k]``: scope,
    node, to, the ancestor 2^k steps up or the head if that is nearer."""

    scope: list[str]
    nodes: DataFrame
    entries: DataFrame
    jumps: list[DataFrame]


def forest(edges: DataFrame, scope: Scope) -> Forest:
    """The trees of ``edges`` (scope, child, parent).

    Repeated edges count once; edges of a node to itself and edges with a null
    end are left out. Every round is a written table.
    """
    scope = list(scope)
    pairs = edges.where("child <> parent").select(*scope, "child", "parent").distinct()
    ends = pairs.select(*scope, F.col("child").alias("node"), "parent").unionByName(
        pairs.select(*scope, F.col("parent").alias("node"), F.lit(None).cast(pairs.schema["parent"].dataType).alias("parent"))
    )
    # Parents of a node with several are read again from the pairs below.
    found = ends.groupBy(*scope, "node").agg(F.count("parent").alias("parents"), F.min("parent").alias("parent"))
    nodes = materialize(found.withColumn("cut", F.lit(False)), "reach-nodes")
    while True:
        jumps, last, rings = _double(nodes, scope)
        if rings is None:
            break
        # The least node of each circle becomes a head; what was summed is void.
        rings = rings.select(*scope, "node", F.lit(True).alias("ring"))
        nodes = materialize(
            nodes.join(rings, [*scope, "node"], "left")
            .withColumn("cut", F.col("cut") | F.coalesce("ring", F.lit(False)))
            .drop("ring"),
            "reach-nodes",
        )
    heads = nodes.where("parents > 1 OR cut").select(*scope, F.col("node").alias("head"), "parents", "parent")
    single = heads.where("parents = 1").select(*scope, F.col("parent").alias("node"), "head")
    several = pairs.select(*scope, F.col("child").alias("head"), F.col("parent").alias("node")).join(
        heads.where("parents > 1").select(*scope, "head"), [*scope, "head"], "left_semi"
    )
    entries = materialize(several.select(*scope, "node", "head").unionByName(single), "reach-entries")
    roots = nodes.select(*scope, "node", (F.col("parents") == 0).alias("root"))
    final = last.select(*scope, "node", F.col("to").alias("top"), "below").join(roots, [*scope, "node"])
    return Forest(scope, final, entries, jumps)


def _double(nodes: DataFrame, scope: list[str]) -> tuple[list[DataFrame], DataFrame, DataFrame | None]:
    """Jump tables, the last round's state, and the least nodes of circles if there are any.

    ``far`` says that a jump is exactly 2^k steps, ``low`` is the least node on
    it, its begin not counted. Where that is the node itself, the jump has come
    round to it.
    """
    points = (F.col("parents") == 1) & ~F.col("cut")
    state = nodes.select(
        *scope,
        "node",
        F.when(points, F.col("parent")).otherwise(F.col("node")).alias("to"),
        points.alias("far"),
        F.when(points, F.col("parent")).alias("low"),
        F.lit(1).cast("bigint").alias("below"),
    )
    jumps = []
    while True:
        jumps.append(state.select(*scope, "node", "to"))
        moving = state.agg(F.count_if("far").alias("n"), F.count_if(F.col("far") & (F.col("low") == F.col("node"))).alias("rings")).first()
        if moving.rings:
            return jumps, state, state.where("far AND low = node").select(*scope, "node")
        if not moving.n:
            return jumps, state, None
        added = state.where("far").groupBy(*scope, F.col("to").alias("node")).agg(F.sum("below").alias("added"))
        # The pointers of the pointed-to; nodes that have arrived join nothing.
        above = state.select(*scope, F.col("node").alias("via"), F.col("to").alias("to2"), F.col("far").alias("far2"), F.col("low").alias("low2"))
        met = state.withColumn("via", F.when(F.col("far"), F.col("to"))).join(above, [*scope, "via"], "left")
        state = materialize(
            met.join(added, [*scope, "node"], "left").select(
                *scope,
                "node",
                F.coalesce("to2", "to").alias("to"),
                (F.col("far") & F.coalesce("far2", F.lit(False))).alias("far"),
                F.least("low", "low2").alias("low"),
                (F.col("below") + F.coalesce("added", F.lit(0))).alias("below"),
            ),
            "reach-round",
        )


def _above(trees: Forest) -> DataFrame:
    """scope, node, head: for each entry of a head, the entry and all above it in its tree."""
    scope = trees.scope
    found = trees.entries.distinct()
    for k, jump in enumerate(trees.jumps):
        step = jump.where("node <> to")
        up = found.join(step, [*scope, "node"]).select(*scope, F.col("to").alias("node"), "head")
        found = found.unionByName(up).distinct()
        if k % 3 == 2:
            found = materialize(found, "reach-above")
    return materialize(found, "reach-above")


def reach_counts(edges: DataFrame, scope: Scope, closure: Closure) -> DataFrame:
    """scope, node, reached: the distinct other nodes below each node, at any depth.

    A node of a circle reaches all others of it. Nodes without an edge do not
    appear; an empty table gives no rows. ``closure`` lists the pairs of the
    heads' graph alone.
    """
    trees = forest(edges, scope)
    scope, nodes = trees.scope, trees.nodes
    plain = nodes.select(*scope, "node", (F.col("below") - 1).alias("reached"))
    if trees.entries.isEmpty():
        return plain
    nodes = materialize(nodes, "reach-trees")
    direct = _above(trees)
    heads = trees.entries.select(*scope, "head").distinct()
    steps = direct.join(heads.withColumnRenamed("head", "node"), [*scope, "node"], "left_semi")
    further = closure(steps.select(*scope, F.col("node").alias("at"), F.col("head").alias("to")), scope)
    via = further.select(*scope, F.col("root").alias("head"), F.col("node").alias("next"))
    sets = direct.unionByName(
        direct.join(via, [*scope, "head"]).select(*scope, "node", F.col("next").alias("head"))
    ).distinct()
    sizes = nodes.join(heads.withColumnRenamed("head", "node"), [*scope, "node"], "left_semi").select(
        *scope, F.col("node").alias("head"), F.col("below").alias("size")
    )
    tops = nodes.select(*scope, "node", "top")
    summed = (
        sets.join(sizes, [*scope, "head"])
        .join(tops, [*scope, "node"])
        .groupBy(*scope, "node")
        .agg(F.sum("size").alias("behind"), F.max(F.col("head") == F.col("top")).alias("own"))
    )
    # Below one of its own tree's head there is the node's subtree already.
    own = F.when(F.coalesce("own", F.lit(False)), F.lit(-1)).otherwise(F.col("below") - 1)
    return nodes.join(summed, [*scope, "node"], "left").select(
        *scope, "node", (own + F.coalesce("behind", F.lit(0))).alias("reached")
    )


def root_members(edges: DataFrame, scope: Scope, closure: Closure) -> DataFrame:
    """scope, root, node: every node below a root, once for each root above it.

    The roots of a tree are those of its head, found on the heads' graph; a
    circle that no root holds has no rows.
    """
    trees = forest(edges, scope)
    scope, nodes = trees.scope, trees.nodes
    below = nodes.where("node <> top").select(*scope, F.col("top").alias("root"), "node")
    if trees.entries.isEmpty():
        return below
    nodes = materialize(nodes, "reach-trees")
    roots = nodes.where("root").select(*scope, F.col("node").alias("root"))
    tops = nodes.select(*scope, "node", "top")
    steps = trees.entries.join(tops, [*scope, "node"]).select(*scope, F.col("head").alias("at"), F.col("top").alias("to"))
    upward = closure(steps, scope).select(*scope, F.col("root").alias("head"), F.col("node").alias("root"))
    of_head = upward.join(roots, [*scope, "root"], "left_semi")
    own = roots.select(*scope, F.col("root").alias("head"), "root")
    named = nodes.select(*scope, F.col("top").alias("head"), "node").join(of_head.unionByName(own), [*scope, "head"])
    return named.where("node <> root").select(*scope, "root", "node")
