"""Trees of key-range digests against plain loops."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from quayside.operators import keytree
from quayside.operators.keytree import KeyRanges, changed_keys, changed_ranges, rows_in, verify_again, write_tree

SCHEMA = "k bigint, part int, v string, w double"
LOW, HIGH = -(2**63), 2**63 - 1


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def leaf(key, width):
    return None if key is None else key // width


def expected(source, target, width):
    nodes = {leaf(r[0], width) for r in source + target}
    sides = {n: [Counter(r for r in side if leaf(r[0], width) == n) for side in (source, target)] for n in nodes}
    return {(n, sum(a.values()), sum(b.values())) for n, (a, b) in sides.items() if a != b}


SOURCE = (
    [(k, k % 3, f"v{k}", k / 7) for k in range(-40, 900)]
    + [(None, 1, "null key", None), (None, 1, "null key", None), (5, 9, "twice", 1.0), (5, 9, "twice", 1.0)]
    + [(LOW, 0, "least", 0.0), (HIGH, 0, "greatest", 0.0)]
)
CHANGES = {
    "value": lambda r: [(r[0], r[1], "other" if r[0] == 333 else r[2], r[3])],
    "null_moved": lambda r: [(r[0], r[1], None if r[0] == 100 else r[2], r[3])],
    "lost": lambda r: [] if r[0] in (-40, 512) else [r],
    "repeated": lambda r: [r, r] if r[0] in (5, 899) else [r],
    "null_key": lambda r: [r, (None, 2, "more", 0.0)] if r[0] == 1 else [r],
    "edges": lambda r: [] if r[0] in (LOW, HIGH) else [r],
    "same": lambda r: [r],
}


@pytest.mark.parametrize("change, runs", [*[(c, 128) for c in CHANGES], ("null_key", 0), ("edges", 0)])
def test_ranges_and_keys_equal_plain_loops(spark, folder, monkeypatch, change, runs):
    monkeypatch.setattr(keytree, "MAX_RUNS", runs)  # no filter at all, or always one
    target = [n for r in SOURCE for n in CHANGES[change](r)]
    ranges = KeyRanges("k", width=10, fanout=4, levels=2)
    s, t = frame(spark, SOURCE), frame(spark, target)
    trees = [write_tree(df, ranges, folder("tree")) for df in (s, t)]
    changed = changed_ranges(*trees, ranges)
    assert {(r["node"], r["source_rows"], r["target_rows"]) for r in changed.collect()} == expected(SOURCE, target, 10)
    a, b = Counter(SOURCE), Counter(target)
    keys = {r[:2] for r in set(SOURCE + target) if a[r] != b[r]}
    found = changed_keys(s, t, ["k", "part"], changed, ranges).collect()
    assert {(r["k"], r["part"]) for r in found} == keys
    assert all(not r["matched"] for r in verify_again(s, t, changed, ranges).collect())
    assert all(r["matched"] for r in verify_again(s, s, changed, ranges).collect())
    fresh = keytree.refresh_tree(trees[1], s, changed, ranges, folder("tree"))
    assert changed_ranges(trees[0], fresh, ranges).isEmpty()


def test_bounds_of_a_range(spark, folder):
    ranges = KeyRanges("k", width=10, levels=1)
    trees = [write_tree(frame(spark, rows), ranges, folder("tree")) for rows in (SOURCE, [])]
    edges = {r["node"]: (r["key_from"], r["key_to"]) for r in changed_ranges(*trees, ranges).collect()}
    assert edges[0] == (0, 9) and edges[-1] == (-10, -1) and edges[None] == (None, None)
    assert edges[leaf(LOW, 10)][0] == LOW and edges[leaf(HIGH, 10)][1] == HIGH


def test_empty_tables_are_equal(spark, folder):
    ranges = KeyRanges("k")
    trees = [write_tree(frame(spark, []), ranges, folder("tree")) for _ in "st"]
    changed = changed_ranges(*trees, ranges)
    assert changed.isEmpty()
    assert rows_in(frame(spark, SOURCE), changed, ranges).isEmpty()


def test_kinds_and_column_order_do_not_matter(spark, folder):
    ranges = KeyRanges("k", width=10)
    one = spark.createDataFrame([(1, '{"a": 1, "b": 2}')], "k bigint, doc string")
    two = spark.createDataFrame([('{"b":2,"a":1}', 1)], "doc string, k bigint")
    trees = [write_tree(df, ranges, folder("tree"), {"doc": "json"}) for df in (one, two)]
    assert changed_ranges(*trees, ranges).isEmpty()
    assert not changed_ranges(*[write_tree(df, ranges, folder("tree")) for df in (one, two)], ranges).isEmpty()


def test_one_changed_row_reads_one_range(spark, folder):
    """The filter on the key reaches the scan, and what it lets through is one leaf."""
    ranges = KeyRanges("l_orderkey", width=50, fanout=5, levels=2)
    path = folder("lines")
    given = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    given.repartitionByRange(8, "l_orderkey").sortWithinPartitions("l_orderkey").write.parquet(path)
    lines = spark.read.parquet(path)
    key = lines.agg(F.max("l_orderkey")).first()[0] // 2
    key = lines.where(F.col("l_orderkey") >= key).agg(F.min("l_orderkey")).first()[0]
    first = (F.col("l_orderkey") == key) & (F.col("l_linenumber") == 1)
    other = lines.withColumn("l_tax", F.when(first, -1.0).otherwise(F.col("l_tax")))
    changed = changed_ranges(*[write_tree(df, ranges, folder("tree")) for df in (lines, other)], ranges)
    assert [r["node"] for r in changed.collect()] == [key // 50]
    held = rows_in(lines, changed, ranges)
    assert held.count() == lines.where(F.floor(F.col("l_orderkey") / 50) == key // 50).count()
    plan = held._jdf.queryExecution().executedPlan().toString()
    assert f"GreaterThanOrEqual(l_orderkey,{key // 50 * 50})" in plan
    found = changed_keys(lines, other, ["l_orderkey", "l_linenumber"], changed, ranges).collect()
    assert [(r["l_orderkey"], r["l_linenumber"]) for r in found] == [(key, 1)]


def test_refuses_other_keys(spark, folder):
    with pytest.raises(ValueError):
        write_tree(frame(spark, SOURCE), KeyRanges("v"), folder("tree"))
    with pytest.raises(ValueError):
        changed_keys(frame(spark, []), frame(spark, []), ["part"], frame(spark, []), KeyRanges("k"))
