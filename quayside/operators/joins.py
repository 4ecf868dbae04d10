"""Joins on grouping keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_groups(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Join on keys under which null is a group like any other.

    Grouping keeps a null key, a plain equality join loses it. Null-safe
    equality still runs as a hash or sort-merge join.
    """
    l, r = left.alias("l"), right.alias("r")
    same = [F.col(f"l.`{k}`").eqNullSafe(F.col(f"r.`{k}`")) for k in keys]
    extra = [F.col(f"r.`{c}`") for c in right.columns if c not in keys]
    return l.join(r, same, how).select("l.*", *extra)
