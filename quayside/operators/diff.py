"""Comparing two copies of a table, row by row and by aggregate checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quayside.functions.coerce import canonical_text, values_equal
from quayside.functions.text import report_value
from quayside.operators.joins import join_groups
from quayside.operators.quantiles import key_at_rank
from quayside.session import materialize

CLASSES = ["mismatched", "extra_source", "extra_target"]


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """One frame, so that many small jobs run as one."""
    return reduce(DataFrame.unionByName, frames)


def side_by_side(frames: Sequence[DataFrame]) -> DataFrame:
    """Frames of one row each as one row: stacked and folded, not joined."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def null_safe_hash(columns: Sequence[Column], salt: int = 0) -> Column:
    """A 64-bit hash of values and of which of them are null.

    The hash alone passes over nulls, so a value that moved to a neighbouring
    null column would not show.
    """
    return F.xxhash64(F.lit(salt), *columns, *[c.isNull() for c in columns])


def row_digest(columns: Sequence[Column]) -> list[Column]:
    return [
        null_safe_hash(columns, 1).alias("_hash1"),
        null_safe_hash(list(reversed(columns)), 2).alias("_hash2"),
    ]


# Row-level difference


def leftover_rows(
    source: DataFrame,
    target: DataFrame,
    pk: Sequence[str],
    compare: Sequence[str] | None = None,
    kinds: Mapping[str, str] | None = None,
    digest: bool = False,
) -> DataFrame:
    """Rows whose number of copies differs between the two sides.

    Both sides are stacked and grouped by key and content, so equal rows cancel
    out in one aggregation. No join is involved: a key that repeats, even a
    third of the table, costs one row per distinct content and never a product.
    Grouping treats nulls as equal. ``kinds`` names the columns to compare in
    their canonical text instead of as they are.

    With ``digest``, rows are told apart by a 128-bit hash of their content, so
    that wide tables shuffle 16 bytes a row beside the key. Two different rows
    of one key then pass for equal with a chance of one in 2^128.
    """
    kinds = kinds or {}
    compare = [c for c in (compare or source.columns) if c not in pk]

    def side(df: DataFrame, in_source: int) -> DataFrame:
        content = [
            canonical_text(F.col(c), kinds[c]).alias(c) if c in kinds else F.col(c)
            for c in compare
        ]
        if digest:
            plain = df.select(*pk, *content)
            content = row_digest([F.col(c) for c in compare])
            df = plain
        return df.select(
            *pk,
            *content,
            F.lit(in_source).cast("bigint").alias("_s"),
            F.lit(1 - in_source).cast("bigint").alias("_t"),
        )

    stacked = side(source, 1).unionByName(side(target, 0))
    if digest:
        compare = ["_hash1", "_hash2"]
    copies = stacked.groupBy(*pk, *compare).agg(
        F.sum("_s").alias("_s"), F.sum("_t").alias("_t")
    )
    paired = F.least("_s", "_t")
    return copies.where("_s <> _t").select(
        *pk,
        *compare,
        (F.col("_s") - paired).alias("source_copies"),
        (F.col("_t") - paired).alias("target_copies"),
    )


def classify_keys(leftover: DataFrame, pk: Sequence[str]) -> DataFrame:
    """Per key, how many rows are mismatched or extra on either side."""
    per_key = leftover.groupBy(*pk).agg(
        F.sum("source_copies").alias("_s"), F.sum("target_copies").alias("_t")
    )
    paired = F.least("_s", "_t")
    return per_key.select(
        *pk,
        paired.alias("mismatched"),
        (F.col("_s") - paired).alias("extra_source"),
        (F.col("_t") - paired).alias("extra_target"),
    )


def first_keys(source: DataFrame, target: DataFrame, pk: Sequence[str], limit: int):
    """Both sides cut to the key range of the first ``limit`` source rows."""
    bound = key_at_rank(source, pk, limit)
    if bound is None:
        return source, target
    key = F.struct(*pk)
    edge = F.struct(*[F.lit(v).alias(c) for c, v in zip(pk, bound)])
    return source.where(key <= edge), target.where(key <= edge)


def sample_keys(keys: DataFrame, pk: Sequence[str], samples: int) -> DataFrame:
    """The first ``samples`` keys of every class.

    The rank limit is applied inside each task before the shuffle, so a class
    that holds most of the table sends only ``samples`` rows per task.
    """
    classes = F.array(*[F.when(F.col(c) > 0, c) for c in CLASSES])
    long = keys.select(*pk, F.explode(F.filter(classes, lambda c: c.isNotNull())).alias("class"))
    by_key = Window.partitionBy("class").orderBy(*pk)
    ranked = long.select("*", F.row_number().over(by_key).alias("rank"))
    return ranked.where(F.col("rank") <= samples)


def sample_rows(
    leftover: DataFrame,
    keys: DataFrame,
    pk: Sequence[str],
    samples: int,
    truncate_at: int | None = None,
) -> DataFrame:
    """The sampled keys with their differing rows as text."""
    content = [c for c in leftover.columns if c not in pk and not c.endswith("_copies")]
    shown = [F.col(c).cast("string") for c in content]
    if truncate_at:
        shown = [F.left(c, F.lit(truncate_at)) for c in shown]
    rows = leftover.select(
        *pk,
        F.when(F.col("source_copies") > 0, "source").otherwise("target").alias("side"),
        *[c.alias(name) for c, name in zip(shown, content)],
    )
    # At most samples x classes keys by construction, so broadcasting is safe.
    return join_groups(rows, F.broadcast(sample_keys(keys, pk, samples)), pk)


def table_diff(
    source: DataFrame,
    target: DataFrame,
    pk: Sequence[str],
    table: str,
    shard: str = "-",
    kinds: Mapping[str, str] | None = None,
    only_pks: bool = False,
    limit: int | None = None,
    samples: int = 10,
    digest: bool = True,
) -> DataFrame:
    """One report row: counts per class and sample keys of each class.

    The report shows keys and no content, so rows are told apart by digest:
    keys and 16 bytes a row are shuffled. Without ``digest`` whole rows are.
    """
    pk = list(pk)
    if limit is not None:
        source, target = first_keys(source, target, pk, limit)
    if only_pks:
        source, target = source.select(*pk), target.select(*pk)
    leftover = leftover_rows(source, target, pk, None, kinds, digest)
    # Only keys that differ are written; counts and samples both read them.
    keys = materialize(classify_keys(leftover, pk), "diff")
    counts = keys.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(f"{c}_rows_count") for c in CLASSES]
    )
    picked = sample_keys(keys, pk, samples).select("class", "rank", F.concat_ws("/", *pk).alias("k"))

    def in_order(name: str) -> Column:
        of_class = F.when(F.col("class") == name, F.struct("rank", "k"))
        listed = F.transform(F.sort_array(F.collect_list(of_class)), lambda p: p["k"])
        return F.nullif(F.array_join(listed, ","), F.lit("")).alias(f"{name}_rows")

    lists = picked.agg(*[in_order(c) for c in CLASSES])
    total = source.agg(F.count("*").alias("source_rows"))
    report = side_by_side([total, counts, lists])
    unpaired = F.col("mismatched_rows_count") + F.col("extra_source_rows_count")
    return report.select(
        F.lit(table).alias("table_name"),
        F.lit(shard).alias("shard"),
        (F.col("source_rows") - unpaired).alias("matched_rows_count"),
        *[f"{c}_rows_count" for c in CLASSES],
        *[f"{c}_rows" for c in CLASSES],
        (unpaired + F.col("extra_target_rows_count") > 0).alias("has_mismatch"),
    )


def diff_tables(
    pairs: Mapping[str, tuple[DataFrame, DataFrame, Sequence[str]]], **options
) -> DataFrame:
    """A report row for every named pair of copies."""
    return union_all(
        [table_diff(s, t, pk, name, **options) for name, (s, t, pk) in pairs.items()]
    )


# Aggregate checks


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows per table; counts come from file footers, no column is read."""
    return union_all(
        [
            df.agg(F.count("*").alias("rows")).select(
                F.lit(name).alias("table_name"), "rows"
            )
            for name, df in tables.items()
        ]
    )


def compare_counts(source: DataFrame, dest: DataFrame) -> DataFrame:
    """Counts of both sides by table, a missing table counting as zero."""
    s = source.withColumnRenamed("rows", "source_rows")
    d = dest.withColumnRenamed("rows", "dest_rows")
    zero = F.lit(0).cast("bigint")
    return s.join(d, "table_name", "full_outer").select(
        "table_name",
        F.coalesce("source_rows", zero).alias("source_rows"),
        F.coalesce("dest_rows", zero).alias("dest_rows"),
        F.coalesce(F.col("source_rows"), zero)
        .eqNullSafe(F.coalesce(F.col("dest_rows"), zero))
        .alias("matched"),
    )


def with_departed_tables(
    source_names: DataFrame, loaded: DataFrame
) -> DataFrame:
    """Source tables plus those loaded earlier that the source no longer has."""
    departed = loaded.select("table_name").distinct().join(
        source_names, "table_name", "left_anti"
    )
    return source_names.select("table_name", F.lit(False).alias("departed")).unionByName(
        departed.select("table_name", F.lit(True).alias("departed"))
    )


def fingerprint(df: DataFrame, pk: str | None = None) -> DataFrame:
    """Row count and, for one integer key, the exact key sum as text."""
    total = F.lit("0")
    if pk and dict(df.dtypes)[pk] in ("tinyint", "smallint", "int", "bigint"):
        total = F.coalesce(F.sum(F.col(pk).cast("decimal(38,0)")).cast("string"), total)
    return df.agg(F.count("*").alias("rows"), total.alias("id_sum"))


def content_fingerprint(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Order-free sum of row hashes; equal copies always give equal sums."""
    row_hash = null_safe_hash([F.col(c) for c in columns or df.columns]).cast("decimal(38,0)")
    return df.agg(
        F.count("*").alias("rows"),
        F.coalesce(F.sum(row_hash), F.lit(0)).cast("string").alias("content_sum"),
    )


def flag_distribution(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """True, false and null counts of all flag columns in one pass."""
    aggs = []
    for c in columns:
        text = F.col(c).cast("string")
        aggs += [
            F.count_if(text.isin("1", "true")).alias(f"{c}__t"),
            F.count_if(text.isin("0", "false")).alias(f"{c}__f"),
            F.count_if(F.col(c).isNull()).alias(f"{c}__n"),
        ]
    rows = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.col(f"{c}__t").alias("true_count"),
            F.col(f"{c}__f").alias("false_count"),
            F.col(f"{c}__n").alias("null_count"),
        )
        for c in columns
    ]
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def identity_check(
    table: str, df: DataFrame, column: str, next_value: int | None
) -> DataFrame:
    """The next generated key must lie above every key present."""
    top = F.max(column).cast("bigint")
    nxt = F.lit(next_value).cast("bigint")
    return (
        df.agg(top.alias("top"))
        .select("top", nxt.alias("nxt"))
        .select(
            F.lit("sequences").alias("check"),
            F.lit(table).alias("table_name"),
            F.lit(column).alias("column_name"),
            F.coalesce(F.col("top") < F.col("nxt"), F.lit(True)).alias("matched"),
            F.concat(F.lit("max="), F.col("top").cast("string")).alias("source"),
            F.concat(F.lit("next="), F.col("nxt").cast("string")).alias("dest"),
            F.when(F.col("top").isNull(), "empty table")
            .when(F.col("nxt").isNull(), "no sequence attached")
            .when(F.col("top") < F.col("nxt"), "ready for new rows")
            .otherwise("next value collides with present rows")
            .alias("message"),
        )
    )


def next_identity(df: DataFrame, column: str) -> DataFrame:
    """The value a reset sequence continues from."""
    top = F.greatest(F.coalesce(F.max(column), F.lit(1)), F.lit(1))
    return df.agg(top.cast("bigint").alias("last_value"))


def sampled_comparison(
    table: str,
    source: DataFrame,
    target: DataFrame,
    pk: Sequence[str],
    kinds: Mapping[str, str] | None = None,
    samples: int = 3,
) -> DataFrame:
    """The first rows by key, compared column by column.

    Values are compared one by one with the rule of their kind, never glued
    into one text, and null is not the empty string.
    """
    kinds = kinds or {}
    pk = list(pk)
    columns = [c for c in source.columns if c not in pk]
    # At most ``samples`` keys go out; the rows that have them do not.
    keys = source.select(*pk).distinct().orderBy(*pk).limit(samples)

    def by_key(df: DataFrame, side: str) -> DataFrame:
        named = keys.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(pk)])
        same = reduce(lambda a, b: a & b, [df[c].eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(pk)])
        rows = df.join(F.broadcast(named), same, "left_semi")
        digest = null_safe_hash([F.col(c) for c in columns]).cast("decimal(38,0)")
        return rows.groupBy(*pk).agg(
            F.min(F.struct(*columns)).alias(side),
            F.struct(F.count("*").alias("n"), F.sum(digest).alias("all")).alias(f"{side}_rows"),
        )

    s, t = by_key(source, "s"), by_key(target, "t").withColumn("found", F.lit(True))

    def unequal(c: str) -> Column:
        kind = kinds.get(c, "text")
        a, b = F.col("s")[c], F.col("t")[c]
        if kind in ("json", "timestamp", "binary"):
            a, b = a.cast("string"), b.cast("string")
        return F.when(~values_equal(a, b, kind), c)

    # Both sides hold at most ``samples`` keys, one row each.
    other = t.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(pk)], "t", "t_rows", "found")
    same = reduce(lambda a, b: a & b, [s[c].eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(pk)])
    joined = s.join(F.broadcast(other), same, "left")
    copies = (F.col("s_rows.n") > 1) | (F.col("t_rows.n") > 1)
    differing = F.when(copies, F.when(F.col("s_rows") != F.col("t_rows"), F.array(F.lit("copies"))).otherwise(F.array().cast("array<string>"))).otherwise(
        F.filter(F.array(*[unequal(c) for c in columns]), lambda c: c.isNotNull())
    )
    found = F.coalesce("found", F.lit(False))

    def shown(side: str) -> Column:
        parts = [
            F.coalesce(report_value(F.col(side)[c].cast("string")), F.lit("NULL"))
            for c in columns
        ]
        return F.concat_ws("|", *parts)

    key = F.concat_ws("/", *[F.col(c).cast("string") for c in pk])
    return joined.select("*", differing.alias("differing")).select(
        F.lit("sample_rows").alias("check"),
        F.lit(table).alias("table_name"),
        F.lit(",".join(pk)).alias("column_name"),
        (found & (F.size("differing") == 0)).alias("matched"),
        F.when(~found | (F.size("differing") > 0), shown("s")).alias("source"),
        F.when(found & (F.size("differing") > 0), shown("t")).alias("dest"),
        F.when(~found, F.concat(F.lit("row missing for "), key))
        .when(
            F.size("differing") > 0,
            F.concat(key, F.lit(" differs in "), F.array_join("differing", ",")),
        )
        .otherwise(F.concat(F.lit("row match for "), key))
        .alias("message"),
    )


def verify_tables(
    pairs: Mapping[str, tuple[DataFrame, DataFrame, Sequence[str]]],
    next_values: Mapping[str, int] | None = None,
    flags: Mapping[str, Sequence[str]] | None = None,
    kinds: Mapping[str, Mapping[str, str]] | None = None,
    samples: int = 3,
) -> DataFrame:
    """All checks of a finished copy as one frame; it passes when all match."""
    next_values, flags, kinds = next_values or {}, flags or {}, kinds or {}
    checks = []
    for name, (source, target, pk) in pairs.items():
        key = pk[0] if len(pk) == 1 else None
        s = fingerprint(source, key)
        t = fingerprint(target, key)
        both = side_by_side([s.select(F.struct("*").alias("s")), t.select(F.struct("*").alias("t"))])
        rows = [F.col(f"{side}.rows") for side in "st"]
        sums = [F.format_string("rows=%d id_sum=%s", f"{x}.rows", f"{x}.id_sum") for x in "st"]
        pair = [
            _check("row_counts", name, None, rows[0] == rows[1], *rows, "rows on both sides"),
            _check("table_fingerprint", name, key, F.col("s") == F.col("t"), *sums, "row count and key sum"),
        ]
        compared = [canonical_text(F.col(f"`{c}`"), kinds.get(name, {}).get(c, "text")).alias(c) for c in source.columns]
        content = [content_fingerprint(df.select(*compared)) for df in (source, target)]
        held = side_by_side([c.select(F.struct("*").alias(x)) for c, x in zip(content, "st", strict=True)])
        totals = [F.col(f"{x}.content_sum") for x in "st"]
        whole = _check("table_content", name, None, F.col("s") == F.col("t"), *totals, "all rows, order-free")
        checks.append(held.select(F.inline(F.array(whole))))
        # Both checks read the same two counts, so each table is scanned once.
        checks.append(both.select(F.inline(F.array(*pair))))
        if name in next_values and key:
            checks.append(identity_check(name, target, key, next_values[name]))
        if flags.get(name):
            checks.append(_flag_checks(name, source, target, flags[name]))
        checks.append(
            sampled_comparison(name, source, target, pk, kinds.get(name), samples)
        )
    return union_all(checks)


def _check(
    check: str, table: str, column: str | None, matched: Column, source: Column, dest: Column, message: str
) -> Column:
    """One row of a check report as a struct."""
    return F.struct(
        F.lit(check).alias("check"),
        F.lit(table).alias("table_name"),
        F.lit(column).cast("string").alias("column_name"),
        matched.alias("matched"),
        source.cast("string").alias("source"),
        dest.cast("string").alias("dest"),
        F.lit(message).alias("message"),
    )


def _flag_checks(
    name: str, source: DataFrame, target: DataFrame, columns: Sequence[str]
) -> DataFrame:
    def text(side: str) -> Column:
        return F.format_string(
            "true=%d false=%d null=%d",
            *[f"{side}.{c}_count" for c in ("true", "false", "null")],
        )

    s = flag_distribution(source, columns).select(
        "column_name", F.struct("*").alias("s")
    )
    t = flag_distribution(target, columns).select(
        "column_name", F.struct("*").alias("t")
    )
    return s.join(t, "column_name").select(
        F.lit("boolean_columns").alias("check"),
        F.lit(name).alias("table_name"),
        "column_name",
        (F.col("s") == F.col("t")).alias("matched"),
        text("s").alias("source"),
        text("t").alias("dest"),
        F.lit("flag distribution").alias("message"),
    )
