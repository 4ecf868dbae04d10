"""Streams over any layout of a table, scans in parts, and sources that fall silent."""

import time

from pyspark.sql import functions as F

from quayside.operators import sessions as ops
from quayside.plans.catalog import streams  # noqa: F401
from quayside.plans.registry import QUERIES
from quayside.streaming import captures, silence

SF = "/root/testdata/sf0.001"


def test_partitioned_table_is_streamed_whole(spark, folder):
    base = folder("layout")
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.write.partitionBy("event_type").parquet(f"{base}/events.parquet")
    want = QUERIES["g5_hourly_stream"](spark, SF).collect()
    got = QUERIES["g5_hourly_stream"](spark, base).collect()
    assert sum(r.query_count for r in got) == events.count()
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_long_history_is_scanned_in_parts(spark):
    """One source with most rows spreads over the parts and gives what the window gives."""
    rows = spark.range(20_000).select(
        F.when(F.col("id") % 10 < 8, "busy").when(F.col("id") % 10 == 8, "quiet").alias("source"),
        (F.col("id") * 7 % 20_011).alias("snapshot"),
        F.when(F.col("id") % 997 == 3, 0).otherwise(2).cast("bigint").alias("unreachable"),
    )
    got = ops.last_good_snapshot(rows).collect()
    assert len(got) == 20_000
    held, first = {}, {}
    want = set()
    for r in sorted(rows.collect(), key=lambda r: r.snapshot):
        first.setdefault(r.source, r.snapshot)
        if r.unreachable == 0:
            held[r.source] = r.snapshot
        want.add((r.source, r.snapshot, r.unreachable, held.get(r.source, first[r.source])))
    assert {tuple(r) for r in got} == want
    assert ops.last_good_snapshot(rows.limit(0)).count() == 0


def test_silent_source_turns_stale_without_a_row(spark, folder):
    source, out = folder("index"), folder("said")
    spark.createDataFrame([("a", 1), ("a", 3), ("a", 2), (None, 7), ("n", None)], "source string, snapshot bigint").write.parquet(source)

    def write(batch, number):
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    spark.createDataFrame([], silence.TIERS).write.parquet(f"{out}/batch=-1")
    stream = spark.readStream.schema("source string, snapshot bigint").parquet(source)
    with silence.timers_allowed(spark):
        writer = silence.watch_sources(stream, interval_ms=300).writeStream.outputMode("update").foreachBatch(write)
        running = captures.start(writer, folder("checkpoint"), "300 milliseconds")
    end = time.time() + 60
    while time.time() < end and spark.read.parquet(out).where("freshness = 'very stale'").count() < 3:
        time.sleep(1)
    running.stop()
    said = spark.read.parquet(out).orderBy("at_ms").collect()
    for name, snapshot in (("a", 3), (None, 7), ("n", None)):
        own = [r for r in said if r.source == name]
        assert [r.freshness for r in own] == ["fresh", "stale", "very stale"]
        assert {r.snapshot for r in own} == {snapshot}
        assert own[1].at_ms - own[0].at_ms >= 900 and own[2].at_ms - own[0].at_ms >= 3000
