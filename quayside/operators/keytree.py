"""Digests of key ranges at several levels, kept as a table, to verify copies by descent.

A tree has one row per range of keys that holds rows: how many, and an order-free
digest of their content. A node of level 0 is a range of ``width`` keys, a node
above it ``fanout`` nodes of the level below. As digests are sums, upper levels
are sums of lower ones and a table is scanned once. Two trees are compared from
the top, and only below nodes that differ; then only rows of the ranges that
differ are read, and a later verification or a refreshed tree reads no others.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.functions.coerce import canonical_text
from quayside.operators.diff import classify_keys, leftover_rows, row_digest
from quayside.operators.joins import join_groups
from quayside.session import materialize

MAX_RUNS = 128  # ranges given as a pushed filter; more are joined
_LOWEST, _HIGHEST = -(2**63), 2**63 - 1
_INTEGERS = ("tinyint", "smallint", "int", "bigint")
_SUMS = ["digest1", "digest2"]


@dataclass(frozen=True)
class KeyRanges:
    """How a table is cut: by ranges of an integer column, which may repeat and be null.

    The top level is as wide as the keys need, so ``levels`` sets how far a
    descent is and never what it finds. Null keys are a range of their own.
    """

    key: str
    width: int = 10_000
    fanout: int = 100
    levels: int = 2

    def leaf(self) -> Column:
        return _floored(F.col(f"`{self.key}`").cast("bigint"), self.width)

    def bounds(self, first: int, last: int) -> tuple[int, int]:
        """The least and greatest key of a run of leaves, both inside."""
        return max(first * self.width, _LOWEST), min(last * self.width + self.width - 1, _HIGHEST)


def _floored(c: Column, by: int) -> Column:
    # Floor by division alone: a product or a sum could leave a long.
    whole = F.call_function("div", c, F.lit(by).cast("bigint"))
    return whole - F.when(F.call_function("mod", c, F.lit(by)) < 0, 1).otherwise(0).cast("bigint")


def leaf_digests(df: DataFrame, ranges: KeyRanges, kinds: Mapping[str, str] | None = None) -> DataFrame:
    """Rows and digest of each range; ``kinds`` as in the row diff.

    Rows are told apart by two 64-bit hashes that see which values are null, and
    their sums by rows too, so repeated rows count and order does not. One row a
    range leaves each task, so a range that holds most rows is no hot key. An
    empty table has no ranges.
    """
    if dict(df.dtypes).get(ranges.key) not in _INTEGERS:
        raise ValueError(f"{ranges.key!r} must be an integer column")
    kinds = kinds or {}
    shown = [canonical_text(F.col(f"`{c}`"), kinds[c]) if c in kinds else F.col(f"`{c}`") for c in sorted(df.columns)]
    hashes = [h.cast("decimal(19,0)").alias(n) for h, n in zip(row_digest(shown), _SUMS, strict=True)]
    return _sums(df.select(ranges.leaf().alias("node"), F.lit(1).cast("bigint").alias("rows"), *hashes))


def _sums(rows: DataFrame) -> DataFrame:
    return rows.groupBy("node").agg(
        F.sum("rows").alias("rows"),
        *[F.sum(c).cast("decimal(38,0)").alias(c) for c in _SUMS],
    )


def write_tree(df: DataFrame, ranges: KeyRanges, path: str, kinds: Mapping[str, str] | None = None) -> DataFrame:
    """Write the tree of a table below ``path`` and return it."""
    return _write_levels(leaf_digests(df, ranges, kinds), ranges, path)


def _write_levels(leaves: DataFrame, ranges: KeyRanges, path: str) -> DataFrame:
    """Each level is summed from the written one before, sorted so that a descent skips row groups."""
    spark = leaves.sparkSession
    level = leaves
    for no in range(ranges.levels + 1):
        ordered = level.repartitionByRange("node").sortWithinPartitions("node")
        ordered.write.parquet(f"{path}/level={no}")
        written = spark.read.schema(level.schema).parquet(f"{path}/level={no}")
        level = _sums(written.withColumn("node", _floored(F.col("node"), ranges.fanout)))
    return read_tree(spark, path)


def read_tree(spark: SparkSession, path: str) -> DataFrame:
    schema = "node bigint, rows bigint, digest1 decimal(38,0), digest2 decimal(38,0), level int"
    return spark.read.schema(schema).parquet(path)


def _runs(nodes: DataFrame) -> list[tuple[int | None, int | None]] | None:
    """Nodes as runs of neighbours; nothing where there are more than fit in a filter."""
    some = nodes.select("node").limit(MAX_RUNS + 1).collect()
    if len(some) > MAX_RUNS:
        return None
    found: list[tuple[int | None, int | None]] = [(None, None)] if any(r["node"] is None for r in some) else []
    for no in sorted(r["node"] for r in some if r["node"] is not None):
        if found and found[-1][1] is not None and found[-1][1] + 1 == no:
            found[-1] = (found[-1][0], no)
        else:
            found.append((no, no))
    return found


def _any(tests: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def _below(level: DataFrame, parents: DataFrame, ranges: KeyRanges) -> DataFrame:
    """The children of some nodes: by a pushed filter if they are few, else by a join."""
    runs = _runs(parents)
    if runs is None:
        wanted = parents.select(F.col("node").alias("_up"))
        placed = level.withColumn("_up", _floored(F.col("node"), ranges.fanout))
        return join_groups(placed, wanted, ["_up"], "left_semi").drop("_up")
    node, f = F.col("node"), ranges.fanout
    return level.where(
        _any([node.isNull() if a is None else node.between(max(a * f, _LOWEST), min(b * f + f - 1, _HIGHEST)) for a, b in runs])
    )


def _unequal(source: DataFrame, target: DataFrame) -> DataFrame:
    """Nodes whose rows or digests differ; stacked and cancelled, no outer join."""

    def side(tree: DataFrame, sign: int) -> DataFrame:
        held = F.col("rows")
        none = F.lit(0).cast("bigint")
        return tree.select(
            "node",
            (held if sign > 0 else none).alias("source_rows"),
            (held if sign < 0 else none).alias("target_rows"),
            *[(F.col(c) * sign).cast("decimal(38,0)").alias(c) for c in _SUMS],
        )

    both = side(source, 1).unionByName(side(target, -1)).groupBy("node")
    summed = both.agg(*[F.sum(c).alias(c) for c in ("source_rows", "target_rows", *_SUMS)])
    differs = (F.col("source_rows") != F.col("target_rows")) | _any([F.col(c) != 0 for c in _SUMS])
    return summed.where(differs).select("node", "source_rows", "target_rows")


def changed_ranges(source: DataFrame, target: DataFrame, ranges: KeyRanges) -> DataFrame:
    """The ranges of two trees that differ, with the rows each side has there.

    One small written table a level; a range only one side has is among them.
    Equal trees, empty ones too, give no rows. ``key_from`` and ``key_to`` are
    null for the range of null keys.
    """
    nodes = None
    for level in range(ranges.levels, -1, -1):
        sides = [t.where(F.col("level") == level).drop("level") for t in (source, target)]
        if nodes is not None:
            sides = [_below(t, nodes, ranges) for t in sides]
        nodes = materialize(_unequal(*sides), "ranges")
    return nodes.select("node", *_edges(ranges), "source_rows", "target_rows")


def _edges(ranges: KeyRanges) -> list[Column]:
    wide = F.col("node").cast("decimal(38,0)") * ranges.width
    low, high = F.greatest(wide, F.lit(_LOWEST).cast("decimal(38,0)")), F.least(wide + ranges.width - 1, F.lit(_HIGHEST).cast("decimal(38,0)"))
    edges = {"key_from": low, "key_to": high}
    return [F.when(F.col("node").isNotNull(), c).cast("bigint").alias(n) for n, c in edges.items()]


def rows_in(df: DataFrame, changed: DataFrame, ranges: KeyRanges) -> DataFrame:
    """The rows of some ranges: few are a filter on the key that reaches the scan, more a join."""
    runs = _runs(changed)
    if runs is None:
        placed = df.withColumn("_leaf", ranges.leaf())
        return join_groups(placed, changed.select(F.col("node").alias("_leaf")), ["_leaf"], "left_semi").drop("_leaf")
    key = F.col(f"`{ranges.key}`")
    return df.where(_any([key.isNull() if a is None else key.between(*ranges.bounds(a, b)) for a, b in runs]))


def changed_keys(
    source: DataFrame,
    target: DataFrame,
    pk: Sequence[str],
    changed: DataFrame,
    ranges: KeyRanges,
    kinds: Mapping[str, str] | None = None,
) -> DataFrame:
    """The keys that differ, by class, reading rows of the changed ranges alone.

    The ranging key must be one of ``pk``, so that no row is compared with one
    of another range.
    """
    if ranges.key not in pk:
        raise ValueError("the key of the ranges must be part of the primary key")
    held = [rows_in(df, changed, ranges) for df in (source, target)]
    return classify_keys(leftover_rows(*held, pk, None, kinds, digest=True), pk)


def verify_again(
    source: DataFrame,
    target: DataFrame,
    changed: DataFrame,
    ranges: KeyRanges,
    kinds: Mapping[str, str] | None = None,
) -> DataFrame:
    """Whether each range that differed is equal now; no other row is read.

    A range that both sides have emptied since is equal.
    """
    left = _unequal(*[leaf_digests(rows_in(df, changed, ranges), ranges, kinds) for df in (source, target)])
    still = left.select("node", F.lit(False).alias("equal"))
    return join_groups(changed.select("node", "key_from", "key_to"), still, ["node"], "left").select(
        "node", "key_from", "key_to", F.coalesce("equal", F.lit(True)).alias("matched")
    )


def refresh_tree(
    tree: DataFrame,
    df: DataFrame,
    changed: DataFrame,
    ranges: KeyRanges,
    path: str,
    kinds: Mapping[str, str] | None = None,
) -> DataFrame:
    """A new tree below ``path`` after a repair of some ranges, from the old tree's other leaves."""
    old = tree.where(F.col("level") == 0).drop("level")
    kept = join_groups(old, changed.select("node"), ["node"], "left_anti")
    return _write_levels(kept.unionByName(leaf_digests(rows_in(df, changed, ranges), ranges, kinds)), ranges, path)
