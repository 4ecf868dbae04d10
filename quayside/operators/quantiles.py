"""Exact quantiles per group without gathering a group in one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quayside.operators.joins import join_groups
from quayside.session import materialize

TOP_K = 10_000  # rows a task may keep for a top-k
SKETCH_ITEMS = 400
BRACKET_BYTES = 32 << 20  # what is broadcast of the brackets of all keys


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float]
) -> DataFrame:
    """Interpolated quantiles of ``value`` per key, one column per name.

    The built-in exact percentile keeps all values of a group in one hash map,
    which one hot group breaks. Here equal values are first counted, then the
    distinct (key, value) pairs are range-partitioned and sorted; being
    distinct, they always split evenly. Counts per key and slice give the
    offset of each slice, and only slices that hold a wanted rank are looked
    into row by row.
    """
    keys = list(keys)
    pairs = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).alias("v"))
        .agg(F.count("*").alias("n"))
    )
    return _at_ranks(pairs.withColumn("gap", F.lit(False)), keys, probs).drop("missed")


def _at_ranks(pairs: DataFrame, keys: list[str], probs: Mapping[str, float]) -> DataFrame:
    """Quantiles of counted values; ``missed`` where a rank falls into a gap.

    A gap is one row for all values between two others, as many as it counts.
    """
    # Slices must not move between the two uses, so they are written once.
    ranged = pairs.repartitionByRange(*keys, "v").withColumn(
        "slice", F.spark_partition_id()
    )
    slices = materialize(ranged, "quantile")

    per_slice = slices.groupBy(*keys, "slice").agg(F.sum("n").alias("n"))
    in_order = Window.partitionBy(*keys).orderBy("slice")
    whole = Window.partitionBy(*keys)
    offsets = per_slice.select(
        *keys,
        "slice",
        (F.sum("n").over(in_order) - F.col("n")).alias("before"),
        F.col("n").alias("held"),
        F.sum("n").over(whole).alias("total"),
    )
    # Each quantile lies between two neighbouring 0-based ranks.
    place = {n: F.lit(p) * (F.col("total") - 1) for n, p in probs.items()}
    ranks = [edge(c) for c in place.values() for edge in (F.floor, F.ceil)]
    wanted = F.exists(
        F.array(*ranks),
        lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("held")),
    )
    inside = Window.partitionBy(*keys, "slice").orderBy("v")
    placed = join_groups(slices, offsets.where(wanted), [*keys, "slice"]).select(
        *keys,
        F.col("v").cast("double").alias("v"),
        "n",
        "gap",
        "total",
        (F.col("before") + F.sum("n").over(inside)).alias("upto"),
    )

    def here(rank: Column) -> Column:
        return (rank >= F.col("upto") - F.col("n")) & (rank < F.col("upto"))

    def value_at(rank: Column) -> Column:
        return F.max(F.when(here(rank), F.col("v")))

    hit = reduce(lambda a, b: a | b, [here(r) for r in ranks])
    found = placed.groupBy(*keys).agg(
        F.max("total").alias("total"),
        F.max(F.col("gap") & hit).alias("missed"),
        *[value_at(F.floor(c)).alias(f"{n}_below") for n, c in place.items()],
        *[value_at(F.ceil(c)).alias(f"{n}_above") for n, c in place.items()],
    )

    def between(name: str) -> Column:
        below, above = F.col(f"{name}_below"), F.col(f"{name}_above")
        return below + (above - below) * (place[name] - F.floor(place[name]))

    return found.select(*keys, *[between(n).alias(n) for n in probs], "missed")


def rank_sketch(value: str) -> Column:
    """A mergeable sketch of a numeric column, of bounded size; nulls are passed over."""
    return F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(SKETCH_ITEMS))


def bracketed_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float], sketches: DataFrame | None = None
) -> DataFrame:
    """The same as :func:`exact_quantiles`, shuffling only values near the wanted ranks.

    A sketch a key, from ``sketches`` (a written frame of keys and ``sketch``) or
    one more scan, brackets each rank by twice its error. The scan then counts
    values inside a bracket one by one and all others by the gap they lie in, in
    each task before the shuffle, so about three hundredths a rank of a large
    group's values are left. Ranks that a bracket misses are seen, as they fall
    into a gap; those keys are done again without brackets. Groups no larger
    than a sketch have no bracket. Where keys are so many that their brackets
    pass ``BRACKET_BYTES``, groups are small on average and all pairs are counted.

    Groups without a value give no row; not-a-number is the greatest value.
    """
    keys = list(keys)
    if sketches is None:
        sketches = materialize(df.groupBy(*keys).agg(rank_sketch(value).alias("sketch")), "sketches")
    text = reduce(lambda a, b: a + b, [F.coalesce(F.octet_length(F.col(k).cast("string")), F.lit(0)) for k in keys], F.lit(0))
    size = sketches.agg(F.sum(text + 16 * len(probs) + 16).alias("bytes")).first()["bytes"]
    if (size or 0) > BRACKET_BYTES:
        return exact_quantiles(df, keys, value, probs)

    margin = 2 * 2.296 / SKETCH_ITEMS**0.9723  # published error of one rank, twice
    large = F.kll_sketch_get_n_double("sketch") > SKETCH_ITEMS

    def edge(rank: float, beyond: float) -> Column:
        if not 0 < rank < 1:
            return F.lit(beyond)
        return F.when(large, F.kll_sketch_get_quantile_double("sketch", F.lit(rank))).otherwise(F.lit(beyond))

    lows = [edge(p - margin, float("-inf")).alias(f"_low{i}") for i, p in enumerate(probs.values())]
    highs = [edge(p + margin, float("nan")).alias(f"_high{i}") for i, p in enumerate(probs.values())]
    brackets = sketches.select(*keys, *lows, *highs)

    v = F.col("_v")
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    near = join_groups(rows, F.broadcast(brackets), keys)
    inside = reduce(lambda a, b: a | b, [v.between(F.col(f"_low{i}"), F.col(f"_high{i}")) for i in range(len(probs))])
    passed = reduce(lambda a, b: a + b, [(v > F.col(f"_high{i}")).cast("int") for i in range(len(probs))])
    cells = near.groupBy(*keys, F.when(~inside, passed).alias("_gap"), F.when(inside, v).alias("_at")).agg(
        F.count("*").alias("n"), F.min("_v").alias("v")
    )
    pairs = cells.select(*keys, "v", "n", F.col("_gap").isNotNull().alias("gap"))
    found = materialize(_at_ranks(pairs, keys, probs), "quantiles")
    missed = found.where("missed").select(*keys)
    hit = found.where("NOT missed").drop("missed")
    if missed.isEmpty():
        return hit
    # At most all keys, whose brackets were found to be small enough above.
    again = join_groups(df, F.broadcast(missed), keys, "left_semi")
    return hit.unionByName(exact_quantiles(again, keys, value, probs))


def key_at_rank(df: DataFrame, key: Sequence[str], rank: int):
    """The ``rank``-th smallest key (from 1), or the largest if there are fewer.

    A small rank is a top-k. A large one would gather its rows in one task, so
    then the keys are range-partitioned, and only the slice that holds the rank
    is sorted. The driver sees one count per slice.
    """
    keys = df.select(*key)
    if rank <= TOP_K:
        first = keys.orderBy(*key).limit(rank)
        return first.agg(F.max(F.struct(*key))).first()[0]
    ranged = keys.repartitionByRange(*key).withColumn("slice", F.spark_partition_id())
    slices = materialize(ranged, "ranks")
    before = 0
    counts = slices.groupBy("slice").agg(F.count("*").alias("n")).orderBy("slice").collect()
    for row in counts:
        if before + row["n"] >= rank or row is counts[-1]:
            place = min(rank - before, row["n"])
            inside = Window.partitionBy("slice").orderBy(*key)
            held = slices.where(F.col("slice") == row["slice"])
            numbered = held.withColumn("_n", F.row_number().over(inside))
            return numbered.where(F.col("_n") == place).select(F.struct(*key)).first()[0]
        before += row["n"]
    return None


def approx_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Mapping[str, float],
    accuracy: int = 10_000,
) -> DataFrame:
    """One-pass sketch with a bounded state per group; ranks off by n/accuracy."""
    return df.groupBy(*keys).agg(
        *[F.approx_percentile(value, p, accuracy).cast("double").alias(n) for n, p in probs.items()]
    )
