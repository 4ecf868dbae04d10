"""Rollups, rankings and violation periods over a log of query executions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quayside.operators.joins import join_groups
from quayside.operators.quantiles import approx_quantiles, bracketed_quantiles, rank_sketch
from quayside.session import materialize

# The metrics a ranking accepts and the rollup column of each.
METRICS = {
    "totalTime": "sum_total_duration_millis",
    "count": "query_count",
    "errorCount": "error_count",
    "rowsRead": "sum_rows_read",
    "rowsReturned": "sum_rows_returned",
    "rowsAffected": "sum_rows_affected",
    "rowsReadPerReturned": "rows_read_per_returned",
    "p50Latency": "p50_latency",
    "p99Latency": "p99_latency",
    "maxLatency": "max_latency",
    "cpuTime": "sum_cpu_duration_millis",
    "ioTime": "sum_io_duration_millis",
    "lastRun": "last_run_at",
}

# The metrics of the combined overview, and its row fields.
OVERVIEW_METRICS = ["totalTime", "rowsReadPerReturned", "rowsRead", "p99Latency", "rowsAffected"]
OVERVIEW_FIELDS = [
    "query_count",
    "sum_total_duration_millis",
    "rows_read_per_returned",
    "sum_rows_read",
    "p99_latency",
    "sum_rows_affected",
    "normalized_sql",
    "tables",
    "index_usages",
    "keyspace",
    "last_run_at",
]


def _ratio(part: Column, whole: Column) -> Column:
    return part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0))


# How the counters of one index of a query add up to those of the query.
_SUMS = [
    "query_count", "error_count", "total_ms", "sum_rows_read", "sum_rows_returned",
    "sum_rows_affected", "cpu_ms", "io_ms", "hits", "misses",
]


def _per_key(log: DataFrame, keys: Sequence[str], sketched: bool = False) -> DataFrame:
    """All counters per key and the use of its indexes, from one scan.

    With ``sketched`` also the sketch that brackets its latencies' quantiles.

    Counted per (key, index) first, so the list of a key holds one entry per
    index however many executions there were.
    """
    per_index = log.groupBy(*keys, "index_name").agg(
        F.max(F.struct("ts", "event_id", "normalized_sql")).alias("newest"),
        F.count("*").alias("query_count"),
        F.count_if("is_error").alias("error_count"),
        F.sum("latency_ms").alias("total_ms"),
        F.max("latency_ms").alias("max_latency"),
        F.sum("rows_read").alias("sum_rows_read"),
        F.sum("rows_returned").alias("sum_rows_returned"),
        F.sum("rows_affected").alias("sum_rows_affected"),
        F.sum("cpu_ms").alias("cpu_ms"),
        F.sum("io_ms").alias("io_ms"),
        F.sum("cache_hits").alias("hits"),
        F.sum("cache_misses").alias("misses"),
        F.max("shards").alias("shards"),
        F.collect_set("table_name").alias("tables"),
        *([rank_sketch("latency_ms").alias("sketch")] if sketched else []),
    )
    used = F.when(
        F.col("index_name").isNotNull(),
        F.struct(F.col("index_name").alias("name"), F.col("query_count").alias("count")),
    )
    return per_index.groupBy(*keys).agg(
        F.max("newest").alias("newest"),
        *[F.sum(c).alias(c) for c in _SUMS],
        F.max("max_latency").alias("max_latency"),
        F.max("shards").alias("shards"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("tables")))).alias("tables"),
        F.sort_array(F.collect_list(used)).alias("used"),
        *([F.kll_merge_agg_double("sketch").alias("sketch")] if sketched else []),
    )


_KEYS = ["fingerprint", "keyspace"]
_QUANTILES = {"p50_latency": 0.5, "p99_latency": 0.99}


def rollup_queries(log: DataFrame, exact: bool = True) -> DataFrame:
    """Statistics per fingerprint and keyspace, with its share of all time.

    The log is scanned twice, once for the counters and sketches and once for
    the values between the sketches' bounds.
    The counters are written, one row per key, as the grand total needs them too.
    """
    base = materialize(_per_key(log, _KEYS, exact), "rollup")
    return _measures(_with_quantiles(base, log, exact), _total_ms(base))


def _total_ms(base: DataFrame) -> Column:
    return base.agg(F.sum("total_ms").cast("double")).scalar()


def _with_quantiles(base: DataFrame, log: DataFrame, exact: bool) -> DataFrame:
    if exact:
        found = bracketed_quantiles(log, _KEYS, "latency_ms", _QUANTILES, base.select(*_KEYS, "sketch"))
    else:
        found = approx_quantiles(log, _KEYS, "latency_ms", _QUANTILES)
    return join_groups(base, found, _KEYS, "left")


def _measures(rows: DataFrame, total: Column) -> DataFrame:
    """The columns of a rollup from counters and quantiles per key."""
    total_ms = F.col("total_ms").cast("double")
    usages = F.transform(
        "used",
        lambda u: F.struct(
            u["name"].alias("name"),
            u["count"].alias("count"),
            (u["count"] * 100 / F.col("query_count")).alias("percent"),
        ),
    )
    return rows.select(
        F.concat_ws("/", *_KEYS).alias("id"),
        *_KEYS,
        "newest.normalized_sql",
        "tables",
        usages.alias("index_usages"),
        "query_count",
        "error_count",
        F.col("newest.ts").alias("last_run_at"),
        (total_ms / F.col("query_count")).alias("time_per_query"),
        *_QUANTILES,
        F.col("max_latency").cast("double").alias("max_latency"),
        "sum_rows_read",
        "sum_rows_returned",
        "sum_rows_affected",
        _ratio(F.col("sum_rows_read"), F.col("sum_rows_returned")).alias("rows_read_per_returned"),
        total_ms.alias("sum_total_duration_millis"),
        (total_ms / F.nullif(total, F.lit(0.0)) * 100).alias("sum_total_duration_percent"),
        F.col("cpu_ms").cast("double").alias("sum_cpu_duration_millis"),
        F.col("io_ms").cast("double").alias("sum_io_duration_millis"),
        _ratio(F.col("hits"), F.col("hits") + F.col("misses")).alias("block_cache_hit_ratio"),
        (F.col("shards") > 1).alias("multishard"),
    )


def rollup_errors(log: DataFrame) -> DataFrame:
    """Statistics per error fingerprint with its latest message."""
    newest = F.struct("ts", "event_id")
    return (
        log.where("error_fingerprint IS NOT NULL")
        .groupBy("error_fingerprint")
        .agg(
            F.count("*").alias("error_count"),
            F.max("ts").alias("started_at"),
            F.max_by("normalized_sql", newest).alias("error_message"),
            F.sum("latency_ms").cast("double").alias("total_duration_millis"),
            (F.sum("latency_ms").cast("double") / F.count("*")).alias("time_per_query"),
        )
    )


def _order(metric: str, direction: str) -> list[Column]:
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}, one of: {', '.join(METRICS)}")
    if direction not in ("asc", "desc"):
        raise ValueError("direction must be asc or desc")
    column = F.col(METRICS[metric])
    ranked = column.asc_nulls_last() if direction == "asc" else column.desc_nulls_last()
    return [ranked, F.col("id")]


def top_queries(
    rollup: DataFrame, metric: str = "totalTime", direction: str = "desc", limit: int = 15
) -> DataFrame:
    """The first rows by one metric; the id settles ties."""
    return rollup.orderBy(*_order(metric, direction)).limit(limit)


def top_of_log(
    log: DataFrame, metric: str = "totalTime", direction: str = "desc", limit: int = 15, exact: bool = True
) -> DataFrame:
    """The first rows of a log's rollup by one metric.

    Only a ranking by a quantile needs the quantiles of every key. All others
    rank the counters and look for the quantiles of the winners alone, whose
    keys, ``limit`` rows, are broadcast to the second scan.
    """
    base = materialize(_per_key(log, _KEYS, exact), "rollup")
    total = _total_ms(base)
    if METRICS.get(metric) in _QUANTILES:
        return top_queries(_measures(_with_quantiles(base, log, exact), total), metric, direction, limit)
    blank = base.withColumns({c: F.lit(None).cast("double") for c in _QUANTILES})
    winners = F.broadcast(top_queries(_measures(blank, total), metric, direction, limit).select(*_KEYS))
    first = _with_quantiles(
        join_groups(base, winners, _KEYS, "left_semi"), join_groups(log, winners, _KEYS, "left_semi"), exact
    )
    return top_queries(_measures(first, total), metric, direction, limit)


def quantile_bounds(log: DataFrame, rollup: DataFrame, error: float = 0.01) -> DataFrame:
    """Whether each quantile of a rollup has its rank, up to a share of the rows."""
    joined = join_groups(log, rollup.select(*_KEYS, *_QUANTILES), _KEYS)
    value = F.col("latency_ms").cast("double")
    return joined.groupBy(*_KEYS).agg(
        *[
            (
                (F.count_if(value < F.col(c)) <= F.count("*") * (p + error))
                & (F.count_if(value <= F.col(c)) >= F.count("*") * (p - error))
            ).alias(f"{c}_in_bounds")
            for c, p in _QUANTILES.items()
        ]
    )


def overview(rollup: DataFrame, per_metric: int = 5) -> DataFrame:
    """The top rows by each of five metrics, every query listed once.

    Each branch is a top-k, so the stacked frame holds a few dozen rows and
    the deduplicating window is small by construction.
    """
    rollup = materialize(rollup, "rollup")  # read five times
    branches = []
    for no, metric in enumerate(OVERVIEW_METRICS):
        top = top_queries(rollup, metric, "desc", per_metric)
        rank = F.row_number().over(Window.partitionBy(F.lit(no)).orderBy(*_order(metric, "desc")))
        branches.append(top.select(F.lit(no).alias("metric_rank"), rank.alias("row_rank"), "*"))
    stacked = branches[0]
    for branch in branches[1:]:
        stacked = stacked.unionByName(branch)
    first = Window.partitionBy("id").orderBy("metric_rank", "row_rank")
    return (
        stacked.withColumn("_n", F.row_number().over(first))
        .where("_n = 1")
        .select("id", "metric_rank", "row_rank", *OVERVIEW_FIELDS)
    )


def share_of_total(df: DataFrame, value: str, label: str) -> DataFrame:
    """Adds the share of the grand total as percent text.

    The total is a scalar subquery over a partial aggregation; a window without
    partitions would push every row through one task.
    """
    total = df.agg(F.sum(value).cast("double")).scalar()
    ratio = F.col(value).cast("double") / F.nullif(total, F.lit(0.0))
    tenth = F.round(ratio * 100, 1).cast("decimal(18,1)").cast("string")
    return df.withColumn(label, F.concat(tenth, F.lit("%")))


def violation_periods(
    minutes: DataFrame, threshold: float, step: str = "1 minute", keys: Sequence[str] = ("metric",)
) -> DataFrame:
    """Unbroken runs of intervals above a threshold, one row per run.

    Input is one row per key and interval, so a key holds as many rows as time
    has intervals, whatever the event volume was. A run that reaches the last
    interval of its key is still active and has no end.
    """
    keys = list(keys)
    width = F.expr(f"INTERVAL {step}")
    newest = minutes.groupBy(*keys).agg(F.max("minute").alias("newest"))
    above = minutes.where(F.col("load") > F.lit(threshold))
    in_order = Window.partitionBy(*keys).orderBy("minute")
    starts = F.when(F.lag("minute").over(in_order) + width == F.col("minute"), 0).otherwise(1)
    runs = above.withColumn("_start", starts).withColumn("run", F.sum("_start").over(in_order))
    periods = runs.groupBy(*keys, "run").agg(
        F.min("minute").alias("period_start"),
        (F.max("minute") + width).alias("period_end"),
        F.count("*").alias("minutes_in_violation"),
        F.max("load").cast("double").alias("peak"),
    )
    active = F.col("period_end") > F.col("newest")
    return join_groups(periods, newest, keys).select(
        *keys,
        "period_start",
        F.when(~active, F.col("period_end")).alias("period_end"),
        "minutes_in_violation",
        "peak",
        active.alias("active"),
    )


def hourly_rollup(log: DataFrame, watermark: str | None = None) -> DataFrame:
    """Statistics per hour and fingerprint; the same for batch and stream."""
    if log.isStreaming:
        log = log.withWatermark("ts", watermark or "10 minutes")
    hour = F.window("ts", "1 hour")
    return log.groupBy(hour.alias("w"), "fingerprint").agg(
        F.count("*").alias("query_count"),
        F.count_if("is_error").alias("error_count"),
        F.max("ts").alias("last_run_at"),
        F.sum("latency_ms").cast("double").alias("sum_total_duration_millis"),
        F.max("latency_ms").cast("double").alias("max_latency"),
        F.sum("rows_read").alias("sum_rows_read"),
    ).select(F.col("w.start").alias("hour"), "fingerprint", "query_count", "error_count",
             "last_run_at", "sum_total_duration_millis", "max_latency", "sum_rows_read")
