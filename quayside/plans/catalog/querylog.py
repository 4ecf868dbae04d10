"""Queries on the log of query executions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quayside.functions import labels
from quayside.operators import querylog
from quayside.plans.registry import query

_ROLLUP = """
WITH ix AS (SELECT fingerprint, keyspace, index_name, count(*) AS c, sum(count(*)) OVER (PARTITION BY fingerprint, keyspace) AS t
            FROM query_log GROUP BY 1, 2, 3),
ixs AS (SELECT fingerprint, keyspace, string_agg(index_name || ':' || c || ':' || CAST(floor(c * 100.0 / t) AS BIGINT), ',' ORDER BY index_name) AS index_usages
        FROM ix GROUP BY 1, 2),
roll AS (
  SELECT q.fingerprint || '/' || q.keyspace AS id, q.fingerprint, q.keyspace,
         arg_max(normalized_sql, ts) AS normalized_sql,
         string_agg(DISTINCT table_name, ',' ORDER BY table_name) AS tables,
         any_value(index_usages) AS index_usages,
         count(*) AS query_count, count(*) FILTER (is_error) AS error_count, max(ts) AS last_run_at,
         CAST(sum(latency_ms) AS DOUBLE) / count(*) AS time_per_query,
         quantile_cont(CAST(latency_ms AS DOUBLE), 0.5) AS p50_latency,
         quantile_cont(CAST(latency_ms AS DOUBLE), 0.99) AS p99_latency,
         CAST(max(latency_ms) AS DOUBLE) AS max_latency,
         CAST(sum(rows_read) AS BIGINT) AS sum_rows_read, CAST(sum(rows_returned) AS BIGINT) AS sum_rows_returned,
         CAST(sum(rows_affected) AS BIGINT) AS sum_rows_affected,
         CAST(sum(rows_read) AS DOUBLE) / nullif(CAST(sum(rows_returned) AS DOUBLE), 0) AS rows_read_per_returned,
         CAST(sum(latency_ms) AS DOUBLE) AS sum_total_duration_millis,
         CAST(sum(latency_ms) AS DOUBLE) / (SELECT CAST(sum(latency_ms) AS DOUBLE) FROM query_log) * 100 AS sum_total_duration_percent,
         CAST(sum(cpu_ms) AS DOUBLE) AS sum_cpu_duration_millis, CAST(sum(io_ms) AS DOUBLE) AS sum_io_duration_millis,
         CAST(sum(cache_hits) AS DOUBLE) / nullif(CAST(sum(cache_hits) + sum(cache_misses) AS DOUBLE), 0) AS block_cache_hit_ratio,
         max(shards) > 1 AS multishard
  FROM query_log q JOIN ixs USING (fingerprint, keyspace) GROUP BY q.fingerprint, q.keyspace)
"""
_ROUNDED = [
    "time_per_query",
    "p50_latency",
    "p99_latency",
    "rows_read_per_returned",
    "sum_total_duration_percent",
    "sum_cpu_duration_millis",
    "sum_io_duration_millis",
    "block_cache_hit_ratio",
]
_REPLACE = "SELECT * REPLACE (" + ", ".join(f"round({c}, 6) AS {c}" for c in _ROUNDED) + ")"


def _flat(rollup):
    """Lists as text, and doubles rounded where the engines differ in the last bit."""
    usages = F.transform(
        "index_usages",
        lambda u: F.concat_ws(
            ":", u["name"], u["count"].cast("string"), F.floor(u["percent"]).cast("string")
        ),
    )
    out = rollup.withColumn("index_usages", F.array_join(usages, ","))
    if "tables" in rollup.columns:
        out = out.withColumn("tables", F.array_join("tables", ","))
    for c in _ROUNDED:
        if c in out.columns:
            out = out.withColumn(c, F.round(c, 6))
    return out


@query("a5_query_rollup", ["query_log"], _ROLLUP + _REPLACE + " FROM roll")
def _(log):
    return _flat(querylog.rollup_queries(log))


@query(
    "a5_query_rollup_approx",
    ["query_log"],
)
def _(log):
    return _flat(querylog.rollup_queries(log, exact=False))


@query(
    "a5_query_rollup_bounds",
    ["query_log"],
    "SELECT DISTINCT fingerprint, keyspace, true AS p50_latency_in_bounds, true AS p99_latency_in_bounds FROM query_log",
)
def _(log):
    return querylog.quantile_bounds(log, querylog.rollup_queries(log, exact=False))


@query(
    "a6_error_rollup",
    ["query_log"],
    """
SELECT error_fingerprint, count(*) AS error_count, max(ts) AS started_at, arg_max(normalized_sql, ts) AS error_message,
       CAST(sum(latency_ms) AS DOUBLE) AS total_duration_millis,
       CAST(sum(latency_ms) AS DOUBLE) / count(*) AS time_per_query
FROM query_log WHERE error_fingerprint IS NOT NULL GROUP BY 1
""",
)
def _(log):
    return querylog.rollup_errors(log)


for _metric, _column in querylog.METRICS.items():

    @query(
        f"t4_top_by_{_metric.lower()}",
        ["query_log"],
        _ROLLUP
        + f"SELECT id, round({_column}, 6) AS metric FROM roll ORDER BY {_column} DESC NULLS LAST, id LIMIT 15"
        if _metric != "lastRun"
        else _ROLLUP
        + "SELECT id, last_run_at AS metric FROM roll ORDER BY last_run_at DESC NULLS LAST, id LIMIT 15",
    )
    def _(log, metric=_metric, column=_column):
        top = querylog.top_of_log(log, metric)
        shown = F.col(column) if metric == "lastRun" else F.round(column, 6)
        return top.select("id", shown.alias("metric"))


@query(
    "t4_lowest_by_count",
    ["query_log"],
    _ROLLUP + "SELECT id, query_count FROM roll ORDER BY query_count, id LIMIT 40",
)
def _(log):
    return querylog.top_of_log(log, "count", "asc", 40).select("id", "query_count")


_RANKED = " UNION ALL ".join(
    f"""SELECT * FROM (SELECT {n} AS metric_rank, row_number() OVER (ORDER BY {querylog.METRICS[m]} DESC NULLS LAST, id) AS row_rank, *
        FROM roll) WHERE row_rank <= 5"""
    for n, m in enumerate(querylog.OVERVIEW_METRICS)
)


@query(
    "u3_overview",
    ["query_log"],
    _ROLLUP
    + f""", ranked AS ({_RANKED}),
once AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY metric_rank, row_rank) AS n FROM ranked)
SELECT id, CAST(metric_rank AS INT) AS metric_rank, CAST(row_rank AS INT) AS row_rank, query_count,
       sum_total_duration_millis, round(rows_read_per_returned, 6) AS rows_read_per_returned, sum_rows_read,
       round(p99_latency, 6) AS p99_latency, sum_rows_affected, normalized_sql, tables, index_usages, keyspace, last_run_at
FROM once WHERE n = 1
""",
)
def _(log):
    return _flat(querylog.overview(querylog.rollup_queries(log)))


_STATEMENTS = """
WITH st AS (SELECT fingerprint AS query, sum(latency_ms) AS total_exec_ms, count(*) AS ncalls FROM query_log GROUP BY 1)
"""


def _per_statement(log):
    return log.groupBy(F.col("fingerprint").alias("query")).agg(
        F.sum("latency_ms").alias("total_exec_ms"), F.count("*").alias("ncalls")
    )


@query(
    "w1_share_of_total",
    ["query_log"],
    _STATEMENTS
    + """SELECT query, ncalls, CAST(CAST(round(CAST(total_exec_ms AS DOUBLE) / (sum(total_exec_ms) OVER ())::DOUBLE * 100, 1) AS DECIMAL(18,1)) AS STRING) || '%' AS share
FROM st""",
)
def _(log):
    shared = querylog.share_of_total(_per_statement(log), "total_exec_ms", "share")
    return shared.select("query", "ncalls", "share")


VIOLATIONS = """
WITH above AS (SELECT * FROM minute_metrics WHERE load > 300),
runs AS (SELECT *, minute - INTERVAL 1 HOUR * row_number() OVER (PARTITION BY metric ORDER BY minute) AS run FROM above),
p AS (SELECT metric, min(minute) AS period_start, max(minute) + INTERVAL 1 HOUR AS e, count(*) AS minutes_in_violation,
             CAST(max(load) AS DOUBLE) AS peak FROM runs GROUP BY metric, run),
n AS (SELECT metric, max(minute) AS newest FROM minute_metrics GROUP BY 1)
SELECT metric, period_start, CASE WHEN e <= newest THEN e END AS period_end, minutes_in_violation, peak, e > newest AS active
FROM p JOIN n USING (metric)
"""


@query("w5_violation_periods", ["minute_metrics"], VIOLATIONS)
def _(minutes):
    return querylog.violation_periods(minutes, 300, "1 hour")


@query(
    "g5_hourly_rollup",
    ["query_log"],
    """
SELECT date_trunc('hour', ts) AS hour, fingerprint, count(*) AS query_count, count(*) FILTER (is_error) AS error_count,
       max(ts) AS last_run_at, CAST(sum(latency_ms) AS DOUBLE) AS sum_total_duration_millis,
       CAST(max(latency_ms) AS DOUBLE) AS max_latency, CAST(sum(rows_read) AS BIGINT) AS sum_rows_read
FROM query_log GROUP BY 1, 2
""",
)
def _(log):
    return querylog.hourly_rollup(log)


@query(
    "f16_round2",
    ["lineitem"],
    """
SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, floor(l_extendedprice * l_discount * 100 + 0.5) / 100 AS rounded FROM lineitem
""",
)
def _(lineitem):
    return lineitem.select(
        "l_orderkey",
        "l_linenumber",
        "l_suppkey",
        "l_partkey",
        labels.round2(F.col("l_extendedprice") * F.col("l_discount")).alias("rounded"),
    )
