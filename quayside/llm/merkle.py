"""Merkle manifest of a dataset and proofs by descent through its digests.

Leaves are digests of rows, in order within their source; runs of ``FAN``
consecutive nodes become one node until a source has one, and the sources'
nodes likewise become the root. What is stored are records digest -> children,
one for each distinct digest. A proof starts at the root with the rank of a
leaf: each digit of the rank selects a child, the children not selected are the
siblings of that level, and the collected segments are reversed at the end.
Requests that share their leading digits go down together, so a level has one
row for each node on the way to a requested leaf.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quayside.llm.common import col, fresh, partitions
from quayside.session import materialize

FAN = 16
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SEGMENT = "array<struct<left:string,right:string>>"


def field(value: Column) -> Column:
    """One column's part of a leaf: ``-`` if null, else bytes, colon, value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(values: Sequence[Column]) -> Column:
    """The digest of a row from its columns in this order."""
    return F.sha2(F.concat(*[field(v) for v in values]).cast("binary"), 256)


@dataclass
class Tree:
    """A forest of leaves below one root.

    ``leaves``: the rows with the columns that ``names`` tells: rank, size. ``levels[k]``: the
    records of nodes ``k + 1`` steps above the leaves, ``top[k]`` those above
    the sources. ``sources``: source, subroot, number of leaves, place in the
    upper tree. ``root`` is None for an empty table.
    """

    leaves: DataFrame
    names: dict[str, str]
    levels: list[DataFrame]
    top: list[DataFrame]
    sources: DataFrame
    root: str | None


def ranked(df: DataFrame, group: str, order: Sequence[str], rank: str, size: str) -> DataFrame:
    """``df`` written with the place of each row in its group, from 0, and the group's size.

    Rows are range partitioned and numbered inside their partition; the counts
    of earlier partitions are added. No task holds a whole group: what is
    windowed has one row for each partition and group. Rows equal in all of
    ``order`` take their places in any order.
    """
    spark = df.sparkSession
    at, part = fresh(df, "__at"), fresh(df, "__part")
    keys = [group, *order]
    # The spread column parts rows that are equal throughout; being written
    # first, it is the same for a task that runs again.
    spread = fresh(df, "__spread")
    stored = materialize(df.withColumn(spread, F.monotonically_increasing_id()), "merkle-leaves")
    ranged = stored.repartitionByRange(partitions(spark), *[col(k) for k in keys], col(spread))
    sorted_ = ranged.sortWithinPartitions(*[col(k) for k in keys], col(spread)).drop(spread)
    numbered = materialize(
        sorted_.withColumn(at, F.monotonically_increasing_id()).withColumn(part, F.spark_partition_id()), "merkle-order"
    )
    p, g, first, n, shift, total = (fresh(numbered, f"__{c}") for c in ("p", "g", "first", "n", "shift", "total"))
    counts = numbered.groupBy(col(part).alias(p), col(group).alias(g)).agg(F.min(at).alias(first), F.count("*").alias(n))
    whole = Window.partitionBy(g)
    before = counts.select(
        p,
        g,
        (F.sum(n).over(whole.orderBy(p)) - F.col(n) - F.col(first)).alias(shift),
        F.sum(n).over(whole).alias(total),
    )
    same = (col(part) == F.col(p)) & col(group).eqNullSafe(F.col(g))
    kept = [col(c) for c in df.columns]
    return numbered.join(before, same).select(*kept, (col(at) + F.col(shift)).alias(rank), F.col(total).alias(size))


def grow(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Records of each level above ``nodes`` and the last node of each group.

    ``nodes`` has the columns g, rank, n (nodes of the group) and digest. A
    group with one node is done; the others shrink by ``FAN``.
    """
    levels: list[DataFrame] = []
    last = nodes.where("n = 1").select("g", "digest")
    most = nodes.agg(F.max("n")).first()[0] or 0
    current = nodes
    while most > 1:
        runs = (
            current.where("n > 1")
            .groupBy("g", F.floor(F.col("rank") / FAN).alias("up"), "n")
            .agg(F.array_sort(F.collect_list(F.struct("rank", "digest"))).alias("run"))
        )
        children = F.col("run")["digest"]
        made = runs.select(
            "g",
            F.col("up").cast("bigint").alias("rank"),
            F.ceil(F.col("n") / FAN).cast("bigint").alias("n"),
            F.sha2(F.array_join(children, "").cast("binary"), 256).alias("digest"),
            children.alias("children"),
        )
        current = materialize(made, f"merkle-level-{len(levels) + 1}")
        levels.append(current.select("digest", "children"))
        last = last.unionByName(current.where("n = 1").select("g", "digest"))
        most = -(-most // FAN)
    return levels, last


def build(rows: DataFrame, leaf: str, source: str, order: Sequence[str]) -> Tree:
    """The manifest of ``rows``, whose column ``leaf`` holds their digests.

    Leaves ascend by ``order`` (nulls first) within a source, a null source
    being one of its own, and equal ones by their digest. Repeated rows are
    leaves of their own; equal runs share one record. An empty table has no
    root.
    """
    names = {n: fresh(rows, f"__{n}") for n in ("rank", "size")}
    leaves = materialize(ranked(rows, source, [*order, leaf], names["rank"], names["size"]), "merkle-ranked")
    nodes = leaves.select(
        col(source).alias("g"), col(names["rank"]).alias("rank"), col(names["size"]).alias("n"), col(leaf).alias("digest")
    )
    levels, subroots = grow(nodes)
    sizes = nodes.where("rank = 0").select(F.col("g").alias("h"), "n")
    joined = subroots.join(sizes, F.col("g").eqNullSafe(F.col("h"))).select("g", F.col("digest").alias("subroot"), "n")
    sources = materialize(ranked(joined.withColumn("all", F.lit(0)), "all", ["g"], "place", "count"), "merkle-sources")
    upper = sources.select(
        F.col("all").alias("g"), F.col("place").alias("rank"), F.col("count").alias("n"), F.col("subroot").alias("digest")
    )
    top, last = grow(upper)
    found = last.select("digest").first()
    return Tree(leaves, names, levels, top, sources, found and found.digest)


def _descend(front: DataFrame, records: DataFrame, wanted: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """One step down: a row for each wanted child, with the segment of its siblings."""
    distinct = records.dropDuplicates(["digest"])
    met = front.join(distinct, "digest")
    # Ranks of the children follow from the digit that selects them.
    opened = met.select(
        *[c for c in front.columns if c not in ("digest", "path")], "path", "children", F.posexplode("children").alias("digit", "digest")
    )
    path = F.concat("path", F.array(_segment(F.col("children"), F.col("digit"))))
    down = opened.withColumn("path", path).withColumn("rank", F.col("rank") * FAN + F.col("digit"))
    return wanted(down.select(*front.columns))


def _segment(children: Column, digit: Column) -> Column:
    left = F.array_join(F.slice(children, F.lit(1), digit), "")
    right = F.array_join(F.slice(children, digit + 2, F.lit(FAN)), "")
    return F.struct(left.alias("left"), right.alias("right"))


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its segments, from the leaf up, lead to."""
    return F.aggregate(path, leaf, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]).cast("binary"), 256))


def proof_digest(path: Column) -> Column:
    """One digest of all siblings of a proof, left to right and level by level."""
    parts = F.transform(path, lambda s: F.concat(s["left"], s["right"]))
    return F.sha2(F.array_join(parts, "").cast("binary"), 256)


def proofs(tree: Tree, source: str, requests: DataFrame | None = None) -> DataFrame:
    """The rows of ``tree.leaves`` with columns ``subroot`` and ``path``.

    ``path`` holds the siblings left and right of the way, from the leaf up to
    the root; a leaf alone in a dataset has an empty one. ``requests`` chooses
    leaves by the columns g (the source) and rank, distinct or not; without it
    every leaf is requested. An empty table has no rows.
    """
    spark = tree.leaves.sparkSession
    if tree.root is None:
        none = [F.lit(None).cast("string").alias("subroot"), F.lit(None).cast(_SEGMENT).alias("path")]
        return tree.leaves.limit(0).select("*", *none)
    chosen = tree.sources
    if requests is not None:
        asked = requests.select(F.col("g").alias("r"), "rank").distinct()
        chosen = chosen.join(asked, F.col("g").eqNullSafe(F.col("r")), "left_semi")
    front = spark.createDataFrame([(tree.root, 0)], "digest string, rank bigint").withColumn("path", F.array().cast(_SEGMENT))
    for height in range(len(tree.top) - 1, -1, -1):

        def on_way(df: DataFrame, unit: int = FAN**height) -> DataFrame:
            if requests is None:
                return df
            return df.join(chosen.select(F.floor(F.col("place") / unit).cast("bigint").alias("rank")).distinct(), "rank", "left_semi")

        front = materialize(_descend(front, tree.top[height], on_way), "merkle-front")
    here = front.select(F.col("rank").alias("place"), "digest", "path")
    started = here.join(chosen.select("place", "g", "n"), "place").select(
        "g", "n", "digest", F.col("digest").alias("subroot"), F.lit(0).cast("bigint").alias("rank"), "path"
    )
    height_of = F.lit(0)
    for k in range(len(tree.levels)):
        height_of = F.when(F.col("n") > FAN**k, k + 1).otherwise(height_of)
    front = started.withColumn("height", height_of)
    for height in range(len(tree.levels) - 1, 0, -1):

        def on_path(df: DataFrame, unit: int = FAN**height) -> DataFrame:
            if requests is None:
                return df
            met = asked.select("r", F.floor(F.col("rank") / unit).cast("bigint").alias("up")).distinct()
            return df.join(met, F.col("g").eqNullSafe(F.col("r")) & (F.col("rank") == F.col("up")), "left_semi")

        moving = _descend(front.where(F.col("height") == height + 1), tree.levels[height], on_path).withColumn("height", F.lit(height))
        # Lower trees wait for their level.
        front = materialize(moving.unionByName(front.where(F.col("height") <= height)), "merkle-front")
    parents = front.where("height = 1").join(tree.levels[0].dropDuplicates(["digest"]), "digest") if tree.levels else None
    alone = front.where("height = 0").withColumn("children", F.array().cast("array<string>"))
    columns = ["g", "rank", "subroot", "path", "children"]
    ends = alone.select(*columns) if parents is None else parents.select(*columns).unionByName(alone.select(*columns))
    # The last step meets the leaves themselves, so no path is shuffled for each of them.
    leaves, names = tree.leaves, tree.names
    if requests is not None:
        met = col(source).eqNullSafe(F.col("r")) & (col(names["rank"]) == F.col("asked_rank"))
        leaves = leaves.join(asked.withColumnRenamed("rank", "asked_rank"), met, "left_semi")
    up = {n: fresh(leaves, f"__{n}") for n in columns}
    ends = ends.select(*[F.col(c).alias(up[c]) for c in columns])
    joined = leaves.join(
        ends, col(source).eqNullSafe(col(up["g"])) & (F.floor(col(names["rank"]) / FAN) == col(up["rank"]))
    )
    digit = (col(names["rank"]) % FAN).cast("int")
    own = F.when(F.size(col(up["children"])) > 0, F.array(_segment(col(up["children"]), digit))).otherwise(F.array().cast(_SEGMENT))
    whole = F.concat(own, F.reverse(col(up["path"])))
    return joined.select(*[col(c) for c in leaves.columns], col(up["subroot"]).alias("subroot"), whole.alias("path"))


def lowered(text: Column) -> Column:
    """Text with A-Z in lower case and nothing else changed."""
    return F.translate(text, UPPER, UPPER.lower())


def verify(
    docs: DataFrame,
    values: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
    source: str = "source",
    doc_id: str = "doc_id",
    tampered: dict[str, Column] | None = None,
) -> DataFrame:
    """Each row's leaf, subroot, root, proof, and the root its present state folds to.

    ``tampered`` gives changed forms of columns; by default nothing is changed
    and every row verifies. Null and repeated ids, repeated rows, empty and
    long texts are leaves like any other; an empty table gives no rows. Other
    columns of ``docs`` take no part.
    """
    changed = tampered or {}
    before = leaf_digest([col(v) for v in values])
    after = leaf_digest([changed.get(v, col(v)) for v in values])
    rows = docs.select(col(doc_id).alias("doc_id"), col(source).alias("source"), before.alias("leaf"), after.alias("after"))
    # Hardly a row has changed, and only those carry a second digest.
    tree = build(rows.withColumn("after", F.when(F.col("after") != F.col("leaf"), F.col("after"))), "leaf", "source", ["doc_id"])
    root = F.lit(tree.root).cast("string")
    found = proofs(tree, "source").withColumn("folded_root", fold(F.coalesce("after", "leaf"), F.col("path")))
    return found.select(
        "doc_id",
        "leaf",
        "subroot",
        root.alias("root"),
        proof_digest(F.col("path")).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == root).alias("verified"),
    )
