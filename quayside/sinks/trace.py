"""Writing session snapshots as a trace of JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.sources.records import TRACE_VERSION

_ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"


def _iso(c: Column) -> Column:
    return F.date_format(c, _ISO)


def header_line(
    org: str, database: str, branch: str, at: str, instance: str = "", role: str = "",
    keyspace: str = "", shard: str = "",
) -> str:
    """The first line of a trace, with the filter and target it was taken under."""
    import json

    head: dict = {
        "type": "capture_start", "at": at, "org": org, "database": database,
        "branch": branch, "schema_version": TRACE_VERSION,
    }
    filtered = {k: v for k, v in (("instance", instance), ("role", role)) if v}
    target = {k: v for k, v in (("keyspace", keyspace), ("shard", shard)) if v}
    if filtered:
        head["filter"] = filtered
    if target:
        head["target"] = target
    return json.dumps(head, separators=(",", ":"))


def _session(c: Column, instances: Column) -> Column:
    """One session as a trace holds it: durations in nanoseconds."""
    match = F.filter(instances, lambda i: i["id"] == c["instance"])
    role = F.try_element_at(match, F.lit(1))["role"]
    blocked = F.when(F.size(c["blocked_by"]) > 0, c["blocked_by"])
    return F.struct(
        c["pid"].alias("pid"),
        F.coalesce(c["instance"], F.lit("")).alias("instance"),
        F.nullif(role, F.lit("")).alias("instance_role"),
        F.coalesce(c["usename"], F.lit("")).alias("username"),
        F.coalesce(c["application_name"], F.lit("")).alias("application_name"),
        F.nullif(c["datname"], F.lit("")).alias("database"),
        *[
            F.coalesce(c[n], F.lit("")).alias(n)
            for n in ("client_addr", "state", "wait_event_type", "wait_event", "backend_type")
        ],
        *[c[n].alias(n) for n in ("xact_start", "query_start", "connection_id", "transaction_id", "query_id")],
        (c["duration_ms"] * 1_000_000).alias("duration"),
        blocked.alias("blocked_by"),
        F.nullif(c["query_text"], F.lit("")).alias("query_text"),
    )


def trace_lines(parsed: DataFrame, sort: str = "xact_start") -> DataFrame:
    """Decoded snapshot documents as trace records; works on a stream too."""
    good = parsed.where("captured_at IS NOT NULL")
    instances = F.col("s.instances")
    at = _iso(F.col("captured_at"))
    capture = F.struct(
        at.alias("captured_at"),
        F.nullif("s.database_kind", F.lit("")).alias("database_kind"),
        F.coalesce(
            F.transform("s.data", lambda c: _session(c, instances)), F.array()
        ).alias("connections"),
        F.lit(sort).alias("sort"),
        F.when(F.size(instances) > 0, instances).alias("instances"),
        F.col("s.topology").alias("topology"),
    )
    return good.select(F.to_json(F.struct(at.alias("at"), capture.alias("capture"))).alias("value"))


def write_header(spark: SparkSession, folder: str, header: str) -> None:
    spark.createDataFrame([(header,)], "value string").coalesce(1).write.mode("append").text(folder)


def write_trace(parsed: DataFrame, folder: str, header: str | None = None) -> None:
    """A finished trace: the header as a file of its own, then the records."""
    if header:
        write_header(parsed.sparkSession, folder, header)
    trace_lines(parsed).write.mode("append").text(folder)
