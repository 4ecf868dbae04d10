"""Who blocks whom: chains, trees and counts over session snapshots.

Sessions are told apart by ``scope`` (the snapshot, and the instance where
process ids repeat between instances) and ``pid``. An edge says that ``pid``
waits for ``blocker_pid``; ``ord`` is the place in the waiter's list.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quayside.functions.labels import wait_label
from quayside.operators import smallgraphs
from quayside.operators.reach import reach_counts, root_members
from quayside.session import materialize

Scope = Sequence[str]


def wait_edges(sessions: DataFrame, scope: Scope) -> DataFrame:
    """One row per entry of ``blocked_by``."""
    return sessions.select(
        *scope, "pid", F.posexplode("blocked_by").alias("ord", "blocker_pid")
    )


def _is_empty(df: DataFrame) -> bool:
    return not df.head(1)


def closure(steps: DataFrame, scope: Scope) -> DataFrame:
    """All (root, node) pairs that steps ``at`` -> ``to`` lead to, with their distance.

    Distances double every round: a pair that is between n and 2n steps apart
    consists of a pair exactly n apart and one at most n apart, so joining
    these two finds every new pair, and a chain finds it once. A chain of d
    sessions takes log2(d) rounds, all snapshots at once. Pairs already known
    are dropped, so cycles end and a diamond counts once. Each round is a
    written table, which keeps plans short and lets a lost executor reread
    instead of recompute.
    """
    pair = [*scope, "root", "node"]
    first = steps.select(
        *scope, F.col("at").alias("root"), F.col("to").alias("node")
    ).where("root <> node")
    known = materialize(first.distinct().withColumn("distance", F.lit(1)), "closure")
    n = 1
    while True:
        edge = known.where(F.col("distance") == n)
        if _is_empty(edge):
            return known
        left = edge.select(*scope, "root", F.col("node").alias("via"))
        right = known.select(*scope, F.col("root").alias("via"), "node", "distance")
        longer = (
            left.join(right, [*scope, "via"])
            .where("root <> node")
            .groupBy(*pair)
            .agg((F.min("distance") + n).alias("distance"))
        )
        fresh = longer.join(known, pair, "left_anti")
        known = known.unionByName(materialize(fresh, "closure"))
        n *= 2


def _hanging(edges: DataFrame, scope: Scope) -> DataFrame:
    """Each waiter as a child of its blockers, written, since scopes are sized first."""
    pairs = edges.select(*scope, F.col("pid").alias("child"), F.col("blocker_pid").alias("parent"))
    return materialize(pairs.where("child <> parent").distinct(), "wait-edges")


def downstream(edges: DataFrame, scope: Scope) -> DataFrame:
    """Every session with every session stuck behind it, directly or not."""
    small, large = smallgraphs.split(_hanging(edges, scope), scope)
    pairs = smallgraphs.members(small, scope, roots_only=False)
    if large is not None:
        steps = large.select(*scope, F.col("parent").alias("at"), F.col("child").alias("to"))
        pairs = pairs.unionByName(closure(steps, scope).drop("distance"))
    return pairs


def root_chains(edges: DataFrame, scope: Scope) -> DataFrame:
    """Blockers that wait for no one, each with all sessions behind them.

    A snapshot where all sessions wait in a circle has no root.
    """
    small, large = smallgraphs.split(_hanging(edges, scope), scope)
    chains = smallgraphs.members(small, scope, roots_only=True)
    if large is not None:
        chains = chains.unionByName(root_members(large, scope, closure))
    return chains


def _reached(pairs: DataFrame, scope: Scope) -> DataFrame:
    small, large = smallgraphs.split(pairs, scope)
    counted = smallgraphs.reach_counts(small, scope)
    if large is not None:
        counted = counted.unionByName(reach_counts(large, scope, closure))
    return counted


def behind_counts(edges: DataFrame, scope: Scope) -> DataFrame:
    """scope, pid, blocking_count of every session that has an edge.

    No pair of sessions is listed: small snapshots count bits in one task,
    others are sums over trees.
    """
    counted = _reached(_hanging(edges, scope), scope)
    return counted.select(*scope, F.col("node").alias("pid"), F.col("reached").alias("blocking_count"))


def root_counts(edges: DataFrame, scope: Scope) -> DataFrame:
    """scope, root, blocked_count of blockers that wait for no one."""
    waiting = edges.where("pid <> blocker_pid").select(*scope, "pid").distinct()
    counted = behind_counts(edges, scope).where("blocking_count > 0")
    roots = counted.join(waiting, [*scope, "pid"], "left_anti")
    return roots.select(*scope, F.col("pid").alias("root"), F.col("blocking_count").alias("blocked_count"))


def blocking_counts(sessions: DataFrame, edges: DataFrame, scope: Scope) -> DataFrame:
    """Every session with the number of distinct sessions stuck behind it."""
    joined = sessions.join(behind_counts(edges, scope), [*scope, "pid"], "left")
    return joined.withColumn(
        "blocking_count", F.coalesce("blocking_count", F.lit(0).cast("bigint"))
    )


def walk(
    sessions: DataFrame,
    edges: DataFrame,
    scope: Scope,
    upstream: bool = True,
    max_rows: int = 32,
) -> DataFrame:
    """The blocking tree of every session in depth-first order.

    At most ``max_rows`` rows per tree are listed, then one marker row tells
    how many more distinct sessions the tree reaches. A session already on the
    path is marked as a cycle and not followed; one that is gone is not present.

    Snapshots of a few thousand waits are walked in one task each, larger ones
    level by level. Rows of one level that precede a row also precede it in the walk, so a row
    beyond the limit within its level cannot be listed and is not expanded, and
    neither can a row with that many siblings before it. A tree therefore costs
    at most ``max_rows`` rows per level, and a session that blocks very many
    others offers only its first ones to each tree.
    """
    scope = list(scope)
    if upstream:
        step = edges.select(*scope, F.col("pid").alias("at"), F.col("blocker_pid").alias("to"), "ord")
    else:
        step = edges.select(*scope, F.col("blocker_pid").alias("at"), F.col("pid").alias("to"), F.col("pid").alias("ord"))
    label = wait_label(F.col("wait_event_type"), F.col("wait_event"))
    waits = sessions.select(*scope, F.col("pid").alias("waiter"), label.alias("wait_on"))
    present = sessions.select(*scope, F.col("pid").alias("to"), F.lit(True).alias("present"))
    step = materialize(
        step.join(present, [*scope, "to"], "left")
        .withColumn("waiter", F.col("at" if upstream else "to"))
        .join(waits, [*scope, "waiter"], "left")
        .select(
            *scope, "at", "to", "ord", F.coalesce("present", F.lit(False)).alias("present"),
            F.when(F.col("present"), F.col("wait_on")).alias("wait_on"),
        ),
        "walk-steps",
    )
    small, large = smallgraphs.split(step, scope)
    listed = smallgraphs.walks(small, scope, max_rows)
    if large is not None:
        listed = listed.unionByName(_walk_levels(large, scope, max_rows))
    return listed


def _walk_levels(step: DataFrame, scope: list[str], max_rows: int) -> DataFrame:
    """The walk of snapshots of any size, level by level."""
    tree = [*scope, "root"]
    siblings = Window.partitionBy(*scope, "at").orderBy("ord", "to")
    near = materialize(
        step.withColumn("_n", F.row_number().over(siblings))
        .where(F.col("_n") <= max_rows + 1)
        .drop("_n"),
        "walk-near",
    )
    order = Window.partitionBy(*tree).orderBy("place")

    def limited(level: DataFrame) -> DataFrame:
        ranked = level.withColumn("_n", F.row_number().over(order))
        return ranked.where(F.col("_n") <= max_rows + 1).drop("_n")

    level = limited(
        near.select(
            *scope,
            F.col("at").alias("root"),
            F.array("at").alias("path"),
            F.array("ord").alias("place"),
            F.col("to").alias("pid"),
            "present",
            "wait_on",
        ).withColumn("cycle", F.array_contains("path", F.col("pid")))
    )
    level = materialize(level, "walk")
    rows = level
    for _ in range(max_rows):
        open_rows = level.where("present AND NOT cycle").withColumn("at", F.col("pid"))
        deeper = open_rows.drop("present", "wait_on", "cycle", "pid").join(
            near, [*scope, "at"]
        )
        # The row that was open joins the path; its own pid is ``at``.
        level = limited(
            deeper.select(
                *tree,
                F.array_append("path", F.col("at")).alias("path"),
                F.array_append("place", F.col("ord")).alias("place"),
                F.col("to").alias("pid"),
                "present",
                "wait_on",
            ).withColumn("cycle", F.array_contains("path", F.col("pid")))
        )
        level = materialize(level, "walk")
        if _is_empty(level):
            break
        rows = rows.unionByName(level)
    numbered = rows.withColumn("row_no", F.row_number().over(order)).where(
        F.col("row_no") <= max_rows + 1
    )
    listed = numbered.where(F.col("row_no") <= max_rows).select(
        *tree,
        "row_no",
        (F.size("path") - 1).alias("depth"),
        "pid",
        "present",
        "cycle",
        "wait_on",
        F.lit(False).alias("truncated"),
        F.lit(0).cast("bigint").alias("remaining"),
    )
    cut = numbered.where(F.col("row_no") == max_rows + 1).select(
        *tree, "row_no", (F.size("path") - 1).alias("depth")
    )
    if _is_empty(cut):
        return listed
    return listed.unionByName(_markers(cut, listed, step, scope))


def _markers(cut: DataFrame, listed: DataFrame, step: DataFrame, scope: list[str]) -> DataFrame:
    """Marker rows of the trees that were cut, with what they leave out."""
    tree = [*scope, "root"]
    seeds = cut.select(*tree).distinct()
    # Only snapshots that hold a cut tree are looked into.
    near = step.join(seeds.select(*scope).distinct(), scope, "left_semi")
    pairs = near.select(*scope, F.col("to").alias("child"), F.col("at").alias("parent"))
    counted = reach_counts(pairs, scope, closure)
    all_nodes = counted.select(*scope, F.col("node").alias("root"), F.col("reached").alias("total")).join(
        seeds, tree, "left_semi"
    )
    shown = (
        listed.where("pid <> root").groupBy(*tree).agg(F.count_distinct("pid").alias("shown"))
    )
    return (
        cut.join(all_nodes, tree)
        .join(shown, tree, "left")
        .select(
            *tree,
            "row_no",
            "depth",
            F.lit(None).cast("int").alias("pid"),
            F.lit(False).alias("present"),
            F.lit(False).alias("cycle"),
            F.lit(None).cast("string").alias("wait_on"),
            F.lit(True).alias("truncated"),
            (F.col("total") - F.coalesce("shown", F.lit(0))).alias("remaining"),
        )
    )


def collapse_suffixes(rows: DataFrame, scope: Scope) -> DataFrame:
    """Drop a branch whose chain is the tail of another branch of its tree.

    A tree holds at most ``max_rows`` listed rows, which bounds the lists made
    here. Cycle rows count with a negative pid, as a cycle is not the session.
    """
    tree = [*scope, "root"]
    so_far = Window.partitionBy(*tree).orderBy("row_no")
    branched = rows.withColumn(
        "branch", F.sum(F.when(F.col("depth") == 0, 1).otherwise(0)).over(so_far)
    )
    sign = F.when(F.col("cycle"), -F.col("pid")).otherwise(F.col("pid"))
    chains = branched.groupBy(*tree, "branch").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("row_no", F.coalesce(sign, F.lit(0)).alias("p")))),
            lambda r: r["p"],
        ).alias("chain")
    )
    every = chains.groupBy(*tree).agg(F.collect_list("chain").alias("chains"))
    longer = F.exists(
        "chains",
        lambda other: (F.size(other) > F.size("chain"))
        & (F.slice(other, F.size(other) - F.size("chain") + 1, F.size("chain")) == F.col("chain")),
    )
    kept = chains.join(every, tree).where(~longer).select(*tree, "branch")
    return branched.join(kept, [*tree, "branch"], "left_semi").drop("branch")
