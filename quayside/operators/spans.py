"""Hours of a query log kept with mergeable sketches, for statistics of any span of hours."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.operators.quantiles import rank_sketch


def hourly_sketches(log: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """Counters and a rank sketch of the latency per hour and fingerprint.

    The same for batch and stream. A sketch is no larger than its values and has
    a bounded size, so the kept hours do not grow with the executions in them.
    Sums keep the type of the latency: exact for decimals.
    """
    if log.isStreaming:
        log = log.withWatermark("ts", watermark)
    return log.groupBy(F.window("ts", "1 hour").alias("w"), "fingerprint").agg(
        F.count("*").alias("query_count"),
        F.count_if("is_error").alias("error_count"),
        F.sum("latency_ms").alias("total_ms"),
        F.max("latency_ms").cast("double").alias("max_latency"),
        rank_sketch("latency_ms").alias("sketch"),
    ).select(F.col("w.start").alias("hour"), "fingerprint", "query_count", "error_count", "total_ms", "max_latency", "sketch")


def span_statistics(
    hours: DataFrame, span: Column, probs: Mapping[str, float], keys: Sequence[str] = ("fingerprint",)
) -> DataFrame:
    """Statistics per key and span of hours, merged from the hours and never from the log.

    ``span`` is an expression over ``hour``. Counters are exact; a quantile is a
    value of the log whose rank is off by about one in 150 of the span's
    executions, however many hours were merged. Quantiles of a span without a
    latency are null, and so are spans of a null hour.
    """
    merged = hours.groupBy(span.alias("span"), *keys).agg(
        F.sum("query_count").alias("query_count"),
        F.sum("error_count").alias("error_count"),
        F.sum("total_ms").cast("double").alias("total_ms"),
        F.max("max_latency").alias("max_latency"),
        F.kll_merge_agg_double("sketch").alias("sketch"),
    )
    held = F.kll_sketch_get_n_double("sketch") > 0
    quantiles = [F.when(held, F.kll_sketch_get_quantile_double("sketch", F.lit(p))).alias(n) for n, p in probs.items()]
    return merged.select("span", *keys, "query_count", "error_count", "total_ms", "max_latency", *quantiles)
