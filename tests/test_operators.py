"""Operators on small fixtures, against brute force, and their laws."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quayside.operators import blocking, diagnostics, diff, infer, querylog, sessions
from quayside.operators.quantiles import approx_quantiles, bracketed_quantiles, exact_quantiles
from quayside.plans import copyjobs
from quayside.plans.inputs import load
from quayside.sources import tables

SF = "/root/testdata/sf0.001"


# Comparison


def report(spark, a, b, **options):
    kind = "k int, v string"
    return diff.table_diff(spark.createDataFrame(a, kind), spark.createDataFrame(b, kind), ["k"], "t", **options).first()


def test_equal_tables_do_not_differ(spark):
    orders = load(spark, SF, "orders")
    row = diff.table_diff(orders, orders.repartition(3), ["o_orderkey"], "orders").first()
    assert not row.has_mismatch
    assert row.matched_rows_count == orders.count()


def test_diff_is_symmetric(spark):
    a = [(1, "x"), (2, None), (3, "z"), (4, "w")]
    b = [(1, "x"), (2, ""), (3, "y"), (5, "v")]
    one, two = report(spark, a, b), report(spark, b, a)
    assert (one.mismatched_rows_count, one.extra_source_rows_count, one.extra_target_rows_count) == (2, 1, 1)
    assert one.mismatched_rows == two.mismatched_rows == "2,3"
    assert (one.extra_source_rows, one.extra_target_rows) == (two.extra_target_rows, two.extra_source_rows)


def test_diff_with_one_hot_key(spark):
    """A third of the rows share one key; they pair up one to one."""
    a = [(7, str(i % 5)) for i in range(3000)] + [(i, "a") for i in range(100, 6100)]
    b = [(7, str(i % 5)) for i in range(2990)] + [(7, "new")] * 4 + [(i, "a") for i in range(100, 6100)]
    row = report(spark, a, b)
    assert row.matched_rows_count == 2990 + 6000
    assert (row.mismatched_rows_count, row.extra_source_rows_count, row.extra_target_rows_count) == (4, 6, 0)


def test_moved_values_change_the_hashes(spark):
    kind = "k int, a string, b string"
    one = spark.createDataFrame([(1, None, "x"), (2, "y", None)], kind)
    two = spark.createDataFrame([(1, "x", None), (2, "y", None)], kind)
    assert diff.content_fingerprint(one).first() != diff.content_fingerprint(two).first()
    row = diff.table_diff(one, two, ["k"], "t", digest=True).first()
    assert (row.matched_rows_count, row.mismatched_rows_count, row.mismatched_rows) == (1, 1, "1")


def test_limit_beyond_a_top_k(spark, monkeypatch):
    from quayside.operators import quantiles

    monkeypatch.setattr(quantiles, "TOP_K", 10)
    source = spark.range(0, 1000).select((F.col("id") * 3).alias("k"), F.lit("a").alias("v"))
    target = source.where("k % 7 <> 0").unionByName(spark.createDataFrame([(1, "a"), (5000, "a")], "k bigint, v string"))
    row = diff.table_diff(source, target, ["k"], "t", limit=500).first()
    assert row.matched_rows_count + row.extra_source_rows_count == 500
    assert (row.extra_source_rows_count, row.extra_target_rows_count) == (72, 1)
    assert quantiles.key_at_rank(source, ["k"], 5000).k == 2997


def test_diff_plan_has_no_join_of_the_copies(spark):
    orders = load(spark, SF, "orders")
    plan = diff.leftover_rows(orders, orders, ["o_orderkey"])._jdf.queryExecution().toString()
    assert "Join" not in plan


# Quantiles


@pytest.mark.parametrize("by", [exact_quantiles, bracketed_quantiles])
def test_exact_quantiles_with_a_hot_group(spark, by):
    rng = random.Random(5)
    rows = [("hot", rng.lognormvariate(0, 3)) for _ in range(4000)]
    rows += [(f"k{i % 50}", float(rng.randrange(10))) for i in range(2000)] + [("one", 4.5), ("none", None), (None, 2.0), (None, 3.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(6)
    probs = {"lo": 0.0, "p50": 0.5, "p99": 0.99, "hi": 1.0}
    got = {r.k: r for r in by(df, ["k"], "v", probs).collect()}
    groups = {}
    for k, v in rows:
        if v is not None:
            groups.setdefault(k, []).append(v)
    assert set(got) == set(groups)
    for k, values in groups.items():
        for name, p in probs.items():
            assert got[k][name] == pytest.approx(np.quantile(values, p), rel=1e-12), (k, name)


def test_brackets_leave_few_values_and_missed_ranks_are_found(spark, monkeypatch):
    from quayside.operators import quantiles

    rng = random.Random(7)
    rows = [(("a", "b", None)[i % 3], rng.choice([rng.lognormvariate(0, 3), 4.0])) for i in range(30_000)]
    rows += [("tied", 1.0)] * 2000 + [("nan", float("nan"))] * 600 + [("nan", 1.0)] * 3
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    probs = {"p50": 0.5, "p99": 0.99}
    want = {r.k: (r.p50, r.p99) for r in exact_quantiles(df, ["k"], "v", probs).collect()}
    counted = []
    real = quantiles._at_ranks

    def at_ranks(pairs, *rest):
        counted.append(pairs.count())
        return real(pairs, *rest)

    def agree():
        counted.clear()
        got = {r.k: (r.p50, r.p99) for r in bracketed_quantiles(df, ["k"], "v", probs).collect()}
        assert repr(sorted(got.items(), key=repr)) == repr(sorted(want.items(), key=repr))

    monkeypatch.setattr(quantiles, "_at_ranks", at_ranks)
    agree()
    assert counted[0] < 2500 < df.distinct().count()

    # Sketches of other values: every bracket misses its rank, and says so.
    def elsewhere(value):
        return quantiles.F.kll_sketch_agg_double(F.col(value).cast("double") + 1e9, F.lit(quantiles.SKETCH_ITEMS))

    with monkeypatch.context() as m:
        m.setattr(quantiles, "rank_sketch", elsewhere)
        agree()
    assert len(counted) == 2

    monkeypatch.setattr(quantiles, "BRACKET_BYTES", 0)
    agree()


def test_quantiles_of_nothing(spark):
    empty = spark.createDataFrame([], "k string, v double")
    assert bracketed_quantiles(empty, ["k"], "v", {"p50": 0.5}).collect() == []
    nulls = spark.createDataFrame([("a", None)] * 500, "k string, v double")
    assert bracketed_quantiles(nulls, ["k"], "v", {"p50": 0.5}).collect() == []


def test_approx_quantiles_are_near(spark):
    df = spark.range(10_000).select(F.lit("a").alias("k"), F.col("id").cast("double").alias("v"))
    row = approx_quantiles(df, ["k"], "v", {"p50": 0.5}).first()
    assert abs(row.p50 - 5000) <= 10


# Query log


def test_rankings_reject_unknown_metrics(spark):
    rollup = spark.createDataFrame([("a", 1)], "id string, query_count bigint")
    with pytest.raises(ValueError, match="unknown metric"):
        querylog.top_queries(rollup, "speed")
    with pytest.raises(ValueError):
        querylog.top_queries(rollup, "count", "sideways")


def test_rollup_keeps_null_keys_and_unmeasured_queries(spark):
    log = load(spark, SF, "query_log").where("event_id < 40")
    lost = log.withColumns(
        {
            "fingerprint": F.expr("if(event_id < 10, null, fingerprint)"),
            "latency_ms": F.expr("if(event_id < 20, null, latency_ms)"),
        }
    )
    rows = querylog.rollup_queries(lost).collect()
    assert sum(r.query_count for r in rows) == 40
    assert sum(r.query_count for r in rows if r.fingerprint is None) == 10
    assert all(r.p50_latency is None for r in rows if r.fingerprint is None)


def test_share_has_no_single_task_window(spark):
    log = load(spark, SF, "query_log")
    plan = querylog.share_of_total(log, "latency_ms", "share")._jdf.queryExecution().toString()
    assert "Window" not in plan and "CartesianProduct" not in plan


def test_violations_split_on_gaps(spark):
    minutes = spark.sql(
        """SELECT 'm' AS metric, timestamp_ntz'2024-01-01 00:00:00' + i * INTERVAL '1' MINUTE AS minute, load
        FROM VALUES (0, 9), (1, 9), (2, 1), (3, 9), (5, 9), (6, 9) AS t(i, load)"""
    )
    rows = querylog.violation_periods(minutes, 5).orderBy("period_start").collect()
    assert [(r.period_start.minute, r.minutes_in_violation, r.active) for r in rows] == [(0, 2, False), (3, 1, False), (5, 2, True)]
    assert rows[0].period_end.minute == 2 and rows[2].period_end is None


# Blocking


def edges_frame(spark, edges):
    rows = [(1, pid, i, blocker) for i, (pid, blocker) in enumerate(edges)]
    return spark.createDataFrame(rows, "snapshot int, pid int, ord int, blocker_pid int")


def sessions_frame(spark, pids):
    rows = [(1, p, "Lock", "tuple") for p in pids]
    return spark.createDataFrame(rows, "snapshot int, pid int, wait_event_type string, wait_event string")


def brute_force_reach(edges):
    behind = {}
    for pid, blocker in edges:
        behind.setdefault(blocker, set()).add(pid)
    pairs = set()
    for root in behind:
        seen, stack = set(), [root]
        while stack:
            for nxt in behind.get(stack.pop(), ()):
                if nxt not in seen:
                    seen.add(nxt)
                    stack.append(nxt)
        pairs |= {(root, n) for n in seen if n != root}
    return pairs


@pytest.mark.parametrize("seed", [1, 2])
def test_closure_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(40), rng.randrange(40)) for _ in range(60)]
    edges += [(100 + i, 101 + i) for i in range(37)] + [(300 + i % 7, 300 + (i + 1) % 7) for i in range(7)]
    got = blocking.downstream(edges_frame(spark, edges), ["snapshot"]).select("root", "node")
    assert {tuple(r) for r in got.collect()} == brute_force_reach(edges)


def test_star_counts_once_per_waiter(spark):
    edges = [(i, 1) for i in range(2, 502)] + [(i + 1000, i) for i in range(2, 502)]
    pids = {p for e in edges for p in e}
    counted = blocking.blocking_counts(sessions_frame(spark, pids), edges_frame(spark, edges), ["snapshot"])
    assert {r.pid: r.blocking_count for r in counted.where("pid <= 3").collect()} == {1: 1000, 2: 1, 3: 1}


def test_diamond_and_cycle(spark):
    diamond = [(2, 1), (3, 1), (4, 2), (4, 3)]
    cycle = [(11, 10), (10, 11)]
    frame = edges_frame(spark, diamond + cycle)
    counted = blocking.blocking_counts(sessions_frame(spark, [1, 2, 3, 4, 10, 11]), frame, ["snapshot"])
    assert {r.pid: r.blocking_count for r in counted.collect()} == {1: 3, 2: 1, 3: 1, 4: 0, 10: 1, 11: 1}
    roots = blocking.root_chains(frame, ["snapshot"]).select("root").distinct().collect()
    assert [r.root for r in roots] == [1]


def test_walk_marks_cycles_and_absent_sessions(spark):
    frame = edges_frame(spark, [(1, 2), (2, 1), (1, 99)])
    rows = blocking.walk(sessions_frame(spark, [1, 2]), frame, ["snapshot"]).where("root = 1").orderBy("row_no").collect()
    assert [(r.pid, r.depth, r.present, r.cycle) for r in rows] == [
        (2, 0, True, False), (1, 1, True, True), (99, 0, False, False),
    ]
    assert rows[0].wait_on == "Lock/tuple"


def test_long_chain_is_cut_with_what_remains(spark):
    edges = [(i, i + 1) for i in range(1, 15)]
    frame, who = edges_frame(spark, edges), sessions_frame(spark, range(1, 16))
    walked = blocking.walk(who, frame, ["snapshot"], max_rows=6)
    rows = walked.where("root = 1").orderBy("row_no").collect()
    assert [r.pid for r in rows] == [2, 3, 4, 5, 6, 7, None]
    assert rows[-1].truncated and rows[-1].remaining == 14 - 6
    short = walked.where("root = 9").orderBy("row_no").collect()
    assert len(short) == 6 and not short[-1].truncated


def test_wide_tree_lists_first_rows_in_walk_order(spark):
    """A row late in its level may still come early in the walk."""
    edges = [(1, b) for b in range(100, 140)] + [(100, b) for b in range(200, 240)]
    rows = blocking.walk(sessions_frame(spark, [1, *range(100, 140), *range(200, 240)]), edges_frame(spark, edges), ["snapshot"])
    listed = rows.where("root = 1").orderBy("row_no").collect()
    assert [r.pid for r in listed[:32]] == [100, *range(200, 231)]
    assert listed[32].remaining == 80 - 32


def test_tail_branches_collapse(spark):
    rows = spark.createDataFrame(
        [(1, 9, 1, 0, 30, False), (1, 9, 2, 0, 20, False), (1, 9, 3, 1, 30, False)],
        "snapshot int, root int, row_no int, depth int, pid int, cycle boolean",
    )
    kept = blocking.collapse_suffixes(rows, ["snapshot"]).orderBy("row_no").collect()
    assert [r.pid for r in kept] == [20, 30]


# Sessions


def test_filter_rejects_both_and_unknown_roles(spark):
    df = spark.createDataFrame([("a", "primary")], "instance string, instance_role string")
    meta = spark.createDataFrame([("a", "primary")], "instance string, role string")
    with pytest.raises(ValueError, match="combined"):
        sessions.filter_snapshot(df, meta, "a", "primary")
    with pytest.raises(ValueError, match="role must be"):
        sessions.filter_snapshot(df, meta, role="leader")
    with pytest.raises(ValueError, match="one of: a"):
        sessions.filter_snapshot(df, meta, "b")
    assert sessions.filter_snapshot(df, meta, "a")[0].count() == 1


def test_cursor_steps_stay_in_the_window(spark):
    cases = [(5, 2, 7), (5, 99, 9), (5, -99, 3), (1, 1, 3), (1, -1, 1), (20, -1, 9), (20, 1, 20)]
    df = spark.createDataFrame(cases, "c int, d int, want int")
    moved = sessions.step_cursor(F.col("c"), F.col("d"), F.lit(3), F.lit(9))
    assert df.where(moved != F.col("want")).count() == 0


# Inference


def test_foreign_keys_and_empty_columns_stay_plain(spark):
    raw = spark.createDataFrame([("1", "1", None, ""), ("0", "1", None, "")], "a string, b string, c_at string, d_at string")
    columns = [
        infer.TextColumn("a", "INTEGER"),
        infer.TextColumn("b", "INTEGER", foreign_key=True),
        infer.TextColumn("c_at"),
        infer.TextColumn("d_at"),
    ]
    types = infer.type_map(infer.infer_types(infer.profile(raw, "t", columns)))
    assert types == {"a": "boolean", "b": "bigint", "c_at": "string", "d_at": "timestamp"}


@pytest.mark.parametrize(
    "declared,kind",
    [
        ("POINT", "bigint"), ("NVARCHAR(9)", "string"), ("BLOB", "binary"), ("FLOAT", "double"), ("BOOL", "boolean"),
        ("DECIMAL(10,2)", "decimal(10,2)"), ("NUMERIC", "decimal(38,18)"), ("", "string"), ("DATE", "string"),
    ],
)
def test_declared_types(declared, kind):
    assert infer.TextColumn("x", declared).plain_type() == kind


def test_unknown_passes_a_rule(spark):
    df = spark.createDataFrame([(1,), (None,), (-1,)], "a int")
    row = infer.expectations(df, "t", {"positive": "a > 0"}).first()
    assert (row.rows, row.violations, row.passed) == (3, 1, False)


# Tables and copies


def test_scan_reaches_the_files(spark):
    df = tables.scan(load(spark, SF, "lineitem"), ["l_orderkey", "l_quantity"], where="l_quantity > 49")
    plan = df._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan
    assert "GreaterThan(l_quantity,49.0)" in plan


def test_scan_without_known_columns_fails(spark):
    with pytest.raises(ValueError, match="no valid columns"):
        tables.scan(load(spark, SF, "nation"), ["nope"])
    with pytest.raises(ValueError, match="comes before"):
        tables.table_range(spark.createDataFrame([("a",)], "table_name string"), "b", "a")


def test_ghost_tables_are_dropped(spark):
    ghost = "_vt_hld_" + "6ace8bcef73211ea87e9f875a4d24e90" + "_20200915120410_"
    listing = spark.createDataFrame([(ghost, "BASE TABLE"), ("users", "BASE TABLE"), ("v", "VIEW")], "table_name string, table_type string")
    kept = {r.table_name: r.is_view for r in tables.select_tables(listing).collect()}
    assert kept == {"users": False, "v": True}


def test_resume_goes_on_after_a_failure(spark, folder):
    frames = {n: spark.range(10 + i) for i, n in enumerate("abc")}
    base = folder("load")
    status = copyjobs.LoadStatus(spark, f"{base}/status")
    present = set()

    def save(df, name):
        if name == "c" and "c-broken" not in present:
            present.add("c-broken")
            raise RuntimeError("lost connection")
        df.write.mode("overwrite").parquet(f"{base}/{name}")
        present.add(name)

    def read_back(name):
        return spark.read.parquet(f"{base}/{name}") if name in present else None

    with pytest.raises(RuntimeError, match="lost connection"):
        copyjobs.resumable_load(frames, status, save, read_back, threads=1)
    assert copyjobs.resumable_load(frames, status, save, read_back, resume=True) == {"c": 12}
    assert status.finished() == {"a": 10, "b": 11, "c": 12}
    with pytest.raises(copyjobs.CopyError, match="already there"):
        copyjobs.resumable_load(frames, status, save, read_back)


def test_row_gate():
    assert copyjobs.expect_rows("t", 3, 3) == 3
    with pytest.raises(copyjobs.CopyError):
        copyjobs.expect_rows("t", 2, 3)


# Fleet checks


def test_redundant_indexes_equal_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for i in range(120):
        cols = rng.sample("abcd", rng.randrange(1, 4))
        # One table holds a third of all indexes.
        rows.append(("d", 1 if i % 3 == 0 else rng.randrange(2, 9), "s", "t", f"ix{i:03}", ",".join(cols), rng.random() < 0.3))
    df = spark.createDataFrame(
        rows, "db string, relid int, schema_name string, rel_name string, index_name string, columns string, is_unique boolean"
    )
    want = set()
    for r in rows:
        for d in rows:
            if r[1] != d[1] or r[4] == d[4]:
                continue
            same = r[5] == d[5] and (not d[6], d[4]) < (not r[6], r[4])
            wider = d[5].startswith(r[5] + ",") and not r[6]
            covered = r[5].startswith(d[5] + ",") and d[6]
            if same or wider or covered:
                want.add(r[4])
    got = diagnostics.redundant_indexes(df).collect()
    assert {r.redundant_index_name for r in got} == want
    assert len(got) == len(want)


def test_report_goes_on_after_a_failed_check(spark):
    relations = load(spark, SF, "relations").withColumn("seq_scans", F.raise_error(F.lit("no access")).cast("bigint"))
    rows = diagnostics.report({"relations": relations}, ["seq-scans", "vacuum-stats", "calls"])
    skipped = {r.check: r.skipped for r in rows.where("skipped IS NOT NULL").collect()}
    assert set(skipped) == {"seq-scans", "calls"}
    assert skipped["calls"] == "unavailable: statements"
    assert rows.where("check = 'vacuum-stats' AND skipped IS NULL").count() == 25


def test_table_patterns(spark):
    df = spark.createDataFrame([("public", "a"), ("s", "a"), ("pg_catalog", "x"), ("s", "b")], "s string, t string")

    def kept(spec):
        return {(r.s, r.t) for r in df.where(diagnostics.table_patterns(spec)(F.col("s"), F.col("t"))).collect()}

    assert kept("*") == {("public", "a"), ("s", "a"), ("s", "b")}
    assert kept("a") == {("public", "a")}
    assert kept("s.*, a") == {("public", "a"), ("s", "a"), ("s", "b")}
    assert kept("s.b,") == {("s", "b")}
    assert kept("") == set()


def _some_indexes(spark, n=60):
    return spark.range(n).selectExpr(
        "'d' AS db", "id % 7 AS relid", "'s' AS schema_name", "'t' AS rel_name", "'r' AS table_kind", "concat('i', id) AS index_name",
        "substring('a,b,c', 1, int(id % 3) * 2 + 1) AS columns", "id AS index_bytes", "id % 9 AS scans", "id % 4 = 0 AS is_unique",
        "false AS is_primary", "id % 2 = 0 AS is_valid", "true AS is_ready",
    )


def test_redundant_indexes_read_their_input_once_more(spark):
    found = diagnostics.redundant_indexes(_some_indexes(spark))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 1


def test_report_makes_a_shared_input_once(spark):
    made = spark.sparkContext.accumulator(0)
    plain = _some_indexes(spark)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    names = ["index-sizes", "unused-indexes", "redundant-indexes", "invalid-indexes"]
    rows = diagnostics.report({"indexes": plain.mapInArrow(counted, plain.schema)}, names)
    assert made.value == 60
    apart = {r.check: r.n for r in rows.groupBy("check").agg(F.count("*").alias("n")).collect()}
    assert apart == {"index-sizes": 25, "unused-indexes": 45, "redundant-indexes": 50, "invalid-indexes": 30}


def test_a_fault_in_a_shared_input_stays_with_the_check_that_reads_it(spark):
    torn = _some_indexes(spark).withColumn("is_valid", F.raise_error(F.lit("no such state")).cast("boolean"))
    rows = diagnostics.report({"indexes": torn}, ["index-sizes", "unused-indexes", "invalid-indexes"]).collect()
    assert {r.check for r in rows if r.skipped} == {"invalid-indexes"} and len(rows) == 25 + 45 + 1
