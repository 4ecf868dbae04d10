"""Queries that land snapshots, write and replay traces, and run as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from quayside.operators import sessions as ops
from quayside.operators import spans
from quayside.operators.joins import join_groups
from quayside.plans.catalog.querylog import VIOLATIONS
from quayside.plans.inputs import derive
from quayside.plans.registry import query
from quayside.session import materialize, new_path
from quayside.sinks import trace
from quayside.sources import records
from quayside.streaming import captures, periods, silence

_HEADER = trace.header_line("acme", "shop", "main", "2024-01-01T00:00:00Z", role="primary")


def _documents(sessions, instances):
    """Snapshot documents as a server would hand them out, one per line."""
    text = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"
    at = F.expr("timestamp_ntz'2024-01-01 00:00:00' + snapshot * INTERVAL '1' SECOND")
    session = F.struct(
        "pid", "instance", F.lit("shop").alias("datname"), F.col("username").alias("usename"),
        "state", "wait_event_type", "wait_event", "backend_type",
        F.date_format("xact_start", text).alias("xact_start"), F.date_format("query_start", text).alias("query_start"),
        "duration_ms", F.array(F.col("pid") - 1).alias("blocked_by"), "query_text",
    )
    data = sessions.groupBy("snapshot").agg(F.collect_list(session).alias("data"))
    metas = instances.groupBy("snapshot").agg(
        F.collect_list(F.struct(F.col("instance").alias("id"), "role", "error")).alias("instances")
    )
    joined = data.join(metas, "snapshot")
    document = F.struct(F.lit("postgresql").alias("database_kind"), F.date_format(at, text).alias("captured_at"), "instances", "data")
    return joined.select("snapshot", F.to_json(document).alias("value"))


def _landed(sessions, instances):
    folder = new_path(sessions.sparkSession, "landed")
    _documents(sessions, instances).select("value").write.text(folder)
    return folder


_SESSIONS = """
SELECT TIMESTAMP '2024-01-01 00:00:00' + snapshot * INTERVAL 1 SECOND AS captured_at, CAST(s.pid AS BIGINT) AS pid, s.instance, i.role AS instance_role, s.username, s.state,
       s.xact_start, s.query_start, s.duration_ms, s.query_text, CAST(s.pid - 1 AS STRING) AS blocked_by
FROM sessions s JOIN instances i USING (source, snapshot, instance)
"""


def _plain(rows):
    times = {c: F.col(c).cast("timestamp_ntz") for c in ("captured_at", "xact_start", "query_start")}
    blocked = F.array_join(F.col("blocked_by").cast("array<string>"), ",")
    return rows.withColumns({**times, "blocked_by": blocked}).select(
        "captured_at", "pid", "instance", "instance_role", "username", "state",
        "xact_start", "query_start", "duration_ms", "query_text", "blocked_by",
    )


@query("s5_read_snapshots", ["sessions", "instances"], _SESSIONS)
def _(sessions, instances):
    parsed = records.read_snapshots(sessions.sparkSession, _landed(sessions, instances))
    return _plain(records.snapshot_sessions(parsed))


@query(
    "s5_snapshot_instances",
    ["sessions", "instances"],
    "SELECT TIMESTAMP '2024-01-01 00:00:00' + snapshot * INTERVAL 1 SECOND AS captured_at, instance, role, error FROM instances",
)
def _(sessions, instances):
    parsed = records.read_snapshots(sessions.sparkSession, _landed(sessions, instances))
    rows = records.snapshot_instances(parsed)
    return rows.withColumn("captured_at", F.col("captured_at").cast("timestamp_ntz"))


@query("k5_trace_roundtrip", ["sessions", "instances"], _SESSIONS)
def _(sessions, instances):
    spark = sessions.sparkSession
    folder = new_path(spark, "trace")
    trace.write_trace(records.read_snapshots(spark, _landed(sessions, instances)), folder, _HEADER)
    lines = records.read_trace(spark, folder)
    records.check_trace(lines)
    return _plain(records.trace_sessions(lines))


@query(
    "s6_trace_lines",
    ["sessions", "instances"],
    """
SELECT snapshot, CASE snapshot % 8 WHEN 0 THEN 'torn' WHEN 1 THEN 'malformed' WHEN 2 THEN 'wrong version' WHEN 3 THEN 'wrong type'
  WHEN 4 THEN 'unknown field' WHEN 5 THEN 'unknown field' WHEN 6 THEN 'header' ELSE 'record' END AS kind
FROM (SELECT DISTINCT snapshot FROM sessions)
""",
)
def _(sessions, instances):
    spark = sessions.sparkSession
    folder = new_path(spark, "trace")
    trace.write_trace(records.read_snapshots(spark, _landed(sessions, instances)), folder)
    at = F.unix_timestamp(F.get_json_object("value", "$.at"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    numbered = spark.read.text(folder).select((at - 1704067200).alias("snapshot"), "value")
    spoiled = F.expr(
        """CASE snapshot % 8 WHEN 0 THEN left(value, length(value) - 20) WHEN 1 THEN concat('{oops}', value)
        WHEN 2 THEN '{"type":"capture_start","schema_version":2}' WHEN 3 THEN '{"type":"other"}'
        WHEN 4 THEN replace(value, '"sort":', '"order":') WHEN 5 THEN replace(value, '"pid":', '"process":')
        WHEN 6 THEN '{"type":"capture_start","schema_version":1}' ELSE value END"""
    )
    return records.classify_trace(numbered.withColumn("value", spoiled)).select("snapshot", "kind")


@query("g1_capture_stream", ["sessions", "instances"], _SESSIONS)
def _(sessions, instances):
    spark = sessions.sparkSession
    folder, checkpoint = new_path(spark, "trace"), new_path(spark, "checkpoint")
    run = captures.capture(spark, _landed(sessions, instances), folder, checkpoint, _HEADER)
    run.awaitTermination()
    lines = captures.read_capture(spark, folder)
    records.check_trace(lines)
    return _plain(records.trace_sessions(lines))


@query(
    "g4_replay_sorted",
    ["sessions", "instances"],
    """
SELECT snapshot, CAST(pid AS BIGINT) AS pid, CAST(row_number() OVER (PARTITION BY snapshot ORDER BY xact_start NULLS LAST, query_start NULLS LAST, pid) AS INT) AS position FROM sessions
""",
)
def _(sessions, instances):
    spark = sessions.sparkSession
    folder = new_path(spark, "trace")
    trace.write_trace(records.read_snapshots(spark, _landed(sessions, instances)), folder, _HEADER)
    replayed = records.trace_sessions(records.read_trace(spark, folder))
    placed = ops.with_position(replayed, "transaction", ["captured_at"])
    return placed.select((F.unix_timestamp("captured_at") - 1704067200).alias("snapshot"), "pid", "position")


def _index_stream(index):
    folder = new_path(index.sparkSession, "index")
    index.write.parquet(folder)
    return index.sparkSession.readStream.schema(index.schema).parquet(folder)


@query(
    "g2_last_good_stream",
    ["instances"],
    """
WITH p AS (SELECT source, snapshot, count(*) FILTER (error <> '') AS unreachable FROM instances GROUP BY 1, 2)
SELECT source, snapshot, unreachable,
       coalesce((SELECT max(g.snapshot) FROM p g WHERE g.source = p.source AND g.snapshot <= p.snapshot AND g.unreachable = 0),
                (SELECT min(g.snapshot) FROM p g WHERE g.source = p.source)) AS shown_snapshot
FROM p
""",
)
def _(instances):
    spark = instances.sparkSession
    index = ops.partial_snapshots(instances).select("source", "snapshot", "unreachable")
    folder = new_path(spark, "shown")
    held = captures.hold_last_good(_index_stream(index))
    writer = held.writeStream.format("parquet").option("path", folder).outputMode("append")
    captures.start(writer, new_path(spark, "checkpoint")).awaitTermination()
    return spark.read.parquet(folder)


@query(
    "g3_retained_stream",
    ["sessions"],
    """
WITH ix AS (SELECT DISTINCT source, snapshot FROM sessions),
n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY snapshot) - 1 AS cursor, count(*) OVER (PARTITION BY source) AS c FROM ix)
SELECT source, snapshot, cursor, cursor - greatest(c - 10, 0) + 1 AS position, least(c, 10) AS total FROM n WHERE cursor >= c - 10
""",
)
def _(sessions):
    spark = sessions.sparkSession
    index = ops.snapshot_index(sessions).select("source", "snapshot")
    folder = new_path(spark, "ring")

    def write(batch, number):
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    writer = captures.retain_last(_index_stream(index), keep=10).writeStream.outputMode("update").foreachBatch(write)
    captures.start(writer, new_path(spark, "checkpoint")).awaitTermination()
    rows = spark.read.parquet(folder)
    newest = rows.groupBy("source").agg(F.max("batch").alias("batch"))
    return rows.join(newest, ["source", "batch"]).select("source", "snapshot", "cursor", "position", "total")


@query(
    "g5_hourly_stream",
    ["events"],
    """
SELECT date_trunc('hour', ts) AS hour, event_type || '-' || CAST(user_id % 20 AS STRING) AS fingerprint, count(*) AS query_count,
       count(*) FILTER (event_type = 'error') AS error_count, max(ts) AS last_run_at,
       CAST(sum(CAST(value AS DECIMAL(12,2))) AS DOUBLE) AS sum_total_duration_millis, max(value) AS max_latency,
       CAST(sum(CAST(regexp_extract(props, '([0-9]+)', 1) AS INT)) AS BIGINT) AS sum_rows_read
FROM events GROUP BY 1, 2
""",
)
def _(events):
    spark = events.sparkSession
    stream = captures.table_stream(events, "events.parquet")
    # Structured Streaming keeps watermarks on instants; the session is in UTC.
    log = derive(spark, "query_log", events=stream).withColumn("ts", F.col("ts").cast("timestamp"))
    out = new_path(spark, "hourly")
    captures.hourly_statistics(log, out, new_path(spark, "checkpoint")).awaitTermination()
    rows = captures.read_hourly(spark, out)
    return rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("hour", "last_run_at")})


@query(
    "g5_span_statistics",
    ["events"],
    """
SELECT date_trunc('day', ts) AS span, event_type || '-' || CAST(user_id % 20 AS STRING) AS fingerprint, CAST(count(*) AS BIGINT) AS query_count,
       CAST(count(*) FILTER (event_type = 'error') AS BIGINT) AS error_count, CAST(sum(CAST(value AS DECIMAL(12,2))) AS DOUBLE) AS total_ms,
       max(value) AS max_latency, true AS p50_in_bounds, true AS p99_in_bounds
FROM events GROUP BY 1, 2
""",
)
def _(events):
    """Days merged from the hours a stream has kept, their quantiles held against the log's ranks."""
    spark = events.sparkSession
    probs, error = {"p50": 0.5, "p99": 0.99}, 0.02
    streamed = derive(spark, "query_log", events=captures.table_stream(events, "events.parquet"))
    out = new_path(spark, "hours")

    def write(batch, number):
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    hours = spans.hourly_sketches(streamed.withColumn("ts", F.col("ts").cast("timestamp")))
    writer = hours.writeStream.outputMode("update").foreachBatch(write)
    captures.start(writer, new_path(spark, "checkpoint")).awaitTermination()
    kept = spark.read.parquet(out)
    values = [c for c in kept.columns if c not in ("hour", "fingerprint", "batch")]
    newest = kept.groupBy("hour", "fingerprint").agg(F.max_by(F.struct(*values), "batch").alias("v")).select("hour", "fingerprint", "v.*")
    days = materialize(spans.span_statistics(newest, F.date_trunc("day", "hour").cast("timestamp_ntz"), probs), "days")

    log = derive(spark, "query_log", events=events)
    ranked = log.select(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("span"), "fingerprint", F.col("latency_ms").cast("double").alias("x"))
    joined = join_groups(ranked, days.select("span", "fingerprint", *probs), ["span", "fingerprint"])
    bounds = joined.groupBy("span", "fingerprint").agg(
        *[
            (
                (F.count_if(F.col("x") < F.col(c)) <= F.count("*") * (p + error)) & (F.count_if(F.col("x") <= F.col(c)) >= F.count("*") * (p - error))
            ).alias(f"{c}_in_bounds")
            for c, p in probs.items()
        ]
    )
    return join_groups(days.drop(*probs), bounds, ["span", "fingerprint"])


@query("w5_violation_stream", ["minute_metrics"], VIOLATIONS)
def _(minutes):
    """The periods of a stream whose files each hold intervals of the whole time."""
    spark = minutes.sparkSession
    source, out = new_path(spark, "minutes"), new_path(spark, "periods")
    minutes.repartition(4, "minute").write.parquet(source)
    stream = spark.readStream.schema(minutes.schema).option("maxFilesPerTrigger", 1).parquet(source)
    periods.write_violations(stream, out, new_path(spark, "checkpoint"), 300, "1 hour", "36500 days").awaitTermination()
    rows = periods.read_violations(spark, out)
    return rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("period_start", "period_end")})


@query(
    "g6_silent_sources",
    ["sessions"],
    """
SELECT source, freshness, max(snapshot) AS snapshot
FROM sessions, (VALUES ('fresh'), ('stale'), ('very stale')) AS t(freshness) GROUP BY 1, 2
""",
)
def _(sessions):
    """No row comes after the first batch, and yet every source is told to be stale."""
    spark = sessions.sparkSession
    index = ops.snapshot_index(sessions).select("source", "snapshot")
    sources = index.select("source").distinct().count()
    folder = new_path(spark, "silence")

    def write(batch, number):
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    spark.createDataFrame([], silence.TIERS).write.parquet(f"{folder}/batch=-1")
    stream = _index_stream(index)
    with silence.timers_allowed(spark, partitions=4):
        writer = silence.watch_sources(stream, interval_ms=300).writeStream.outputMode("update").foreachBatch(write)
        running = captures.start(writer, new_path(spark, "checkpoint"), "300 milliseconds")
    try:
        # Timers always have another batch to come, so there is no end to wait for.
        while running.exception() is None:
            said = spark.read.schema(silence.TIERS).parquet(folder)
            if said.where("freshness = 'very stale'").select("source").distinct().count() >= sources:
                break
            running.awaitTermination(1)
    finally:
        running.stop()
    if running.exception() is not None:
        raise running.exception()
    said = spark.read.schema(silence.TIERS).parquet(folder)
    return said.groupBy("source", "freshness").agg(F.max("snapshot").alias("snapshot"))


@query(
    "g6_stream_freshness",
    ["sessions", "instances"],
    "SELECT DISTINCT snapshot, 'very stale' AS freshness FROM sessions",
)
def _(sessions, instances):
    spark = sessions.sparkSession
    parsed = captures.snapshot_stream(spark, _landed(sessions, instances))
    tiered = captures.with_freshness(parsed, "captured_at", 1000)
    number = (F.unix_timestamp("captured_at") - 1704067200).alias("snapshot")
    folder = new_path(spark, "fresh")
    writer = tiered.select(number, "freshness").writeStream.format("parquet").option("path", folder).outputMode("append")
    captures.start(writer, new_path(spark, "checkpoint")).awaitTermination()
    return spark.read.parquet(folder)
