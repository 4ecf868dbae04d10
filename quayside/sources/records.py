"""Session snapshots, traces and other landed records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quayside.functions.coerce import to_instant
from quayside.sources.quoted import read_quoted

TRACE_VERSION = 1

# The fields of a session as they are in a landed document. Times
# are text, so that a document with an odd time still loads.
_SESSION = """pid BIGINT, instance STRING, datname STRING, usename STRING, application_name STRING,
client_addr STRING, state STRING, wait_event_type STRING, wait_event STRING, backend_type STRING,
xact_start STRING, query_start STRING, connection_id STRING, transaction_id STRING, query_id STRING,
duration_ms BIGINT, blocked_by ARRAY<BIGINT>, query_text STRING"""
_INSTANCES = "ARRAY<STRUCT<id: STRING, role: STRING, error: STRING>>"
_TOPOLOGY = "STRUCT<keyspace: STRING, shard: STRING, tablet: STRING>"


def _struct(fields: str) -> str:
    """``a INT, b STRING`` as a struct type."""
    named = (f.strip().split(" ", 1) for f in fields.replace("\n", " ").split(", "))
    return "STRUCT<" + ", ".join(f"{n}: {t}" for n, t in named) + ">"


SNAPSHOT_SCHEMA = (
    f"database_kind STRING, captured_at STRING, instances {_INSTANCES}, "
    f"topology {_TOPOLOGY}, data ARRAY<{_struct(_SESSION)}>"
)

# The same session in a trace, where a duration is nanoseconds.
_TRACE_SESSION = """pid BIGINT, instance STRING, instance_role STRING, username STRING, application_name STRING,
database STRING, client_addr STRING, state STRING, wait_event_type STRING, wait_event STRING,
backend_type STRING, xact_start STRING, query_start STRING, connection_id STRING, transaction_id STRING,
query_id STRING, duration BIGINT, blocked_by ARRAY<BIGINT>, query_text STRING"""
TRACE_FIELDS = ["at", "capture"]
CAPTURE_FIELDS = ["captured_at", "database_kind", "connections", "sort", "instances", "topology"]
TRACE_SESSION_FIELDS = [
    f.strip().split(" ")[0] for f in _TRACE_SESSION.replace("\n", " ").split(",") if f.strip()
]
TRACE_SCHEMA = (
    f"at STRING, capture STRUCT<captured_at: STRING, database_kind: STRING, "
    f"connections: ARRAY<{_struct(_TRACE_SESSION)}>, sort: STRING, "
    f"instances: {_INSTANCES}, topology: {_TOPOLOGY}>"
)


def _empty_for_null(name: str) -> Column:
    return F.coalesce(f"c.{name}", F.lit("")).alias(name)


_TEXT = ["application_name", "client_addr", "state", "wait_event_type", "wait_event", "backend_type", "query_text"]


def _common(duration: Column, user: str, database: str) -> list[Column]:
    return [
        F.col("c.pid").alias("pid"),
        _empty_for_null("instance"),
        F.coalesce(f"c.{user}", F.lit("")).alias("username"),
        F.coalesce(f"c.{database}", F.lit("")).alias("database"),
        *[_empty_for_null(n) for n in _TEXT],
        to_instant(F.col("c.xact_start")).alias("xact_start"),
        to_instant(F.col("c.query_start")).alias("query_start"),
        "c.connection_id",
        "c.transaction_id",
        "c.query_id",
        duration.alias("duration_ms"),
        F.coalesce("c.blocked_by", F.array().cast("array<int>")).alias("blocked_by"),
    ]


def parse_snapshots(documents: DataFrame) -> DataFrame:
    """Decode one document per row (column ``value``); needs its capture time."""
    parsed = documents.withColumn("s", F.from_json("value", SNAPSHOT_SCHEMA))
    at = to_instant(F.col("s.captured_at"))
    return parsed.withColumn("captured_at", at)


def snapshot_sessions(parsed: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per session, its role looked up among the document's instances."""
    exploded = parsed.where("captured_at IS NOT NULL").select(
        *keep, "captured_at", "s.database_kind", "s.instances", F.explode("s.data").alias("c")
    )
    match = F.filter("instances", lambda i: i["id"] == F.col("c.instance"))
    role = F.coalesce(F.try_element_at(match, F.lit(1))["role"], F.lit("")).alias("instance_role")
    return exploded.select(
        *keep, "captured_at", "database_kind", role,
        *_common(F.col("c.duration_ms"), "usename", "datname"),
    )


def snapshot_instances(parsed: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per instance of each snapshot."""
    return parsed.where("captured_at IS NOT NULL").select(
        *keep, "captured_at", F.explode("s.instances").alias("i")
    ).select(
        *keep, "captured_at", F.col("i.id").alias("instance"), "i.role",
        F.coalesce("i.error", F.lit("")).alias("error"),
    )


def rejected_snapshots(parsed: DataFrame) -> DataFrame:
    """Documents without a readable capture time."""
    return parsed.where("captured_at IS NULL").select("value")


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Landed snapshot documents, one per line, decoded."""
    return parse_snapshots(spark.read.text(path))


def classify_trace(lines: DataFrame) -> DataFrame:
    """Adds to each trace line what it is.

    ``header``, ``record``, or why it is neither: another version, another type,
    an unknown field, or malformed. A line cut off in the middle, as an
    interrupted writer leaves it, is ``torn``: it opens more than it closes.
    """
    # Each stage is used more than once in the next, so it is its own projection
    # and the parsing is done once per line.
    line = F.col("value")
    parsed = lines.where(F.trim("value") != "").select(
        "*",
        F.try_parse_json(line).alias("_doc"),
        F.from_json(line, "type STRING, schema_version INT").alias("_head"),
    )

    def names(path: str) -> Column:
        return F.map_keys(F.try_variant_get("_doc", path, "MAP<STRING, VARIANT>"))

    rows = F.try_variant_get("_doc", "$.capture.connections", "ARRAY<MAP<STRING, VARIANT>>")
    session_names = F.array_distinct(F.flatten(F.transform(rows, F.map_keys)))

    def unknown(found: Column, allowed: list[str]) -> Column:
        extra = F.array_except(found, F.array(*[F.lit(a) for a in allowed]))
        return F.coalesce(F.size(extra) > 0, F.lit(False))

    valid = F.col("_doc").isNotNull()
    checked = parsed.select(
        *lines.columns,
        valid.alias("_valid"),
        "_head",
        F.when(~valid, F.regexp_replace(line, r'"(?:[^"\\]++|\\.)*+"', "")).alias("_bare"),
        (
            unknown(names("$"), TRACE_FIELDS)
            | unknown(names("$.capture"), CAPTURE_FIELDS)
            | unknown(session_names, TRACE_SESSION_FIELDS)
        ).alias("_unknown"),
    )
    opens = F.length(F.regexp_replace("_bare", r"[^{\[]", ""))
    closes = F.length(F.regexp_replace("_bare", r"[^}\]]", ""))
    is_header = F.col("_head.type") == "capture_start"
    kind = (
        F.when(~F.col("_valid") & ((opens > closes) | F.col("_bare").contains('"')), "torn")
        .when(~F.col("_valid"), "malformed")
        .when(is_header & (F.col("_head.schema_version") == TRACE_VERSION), "header")
        .when(is_header, "wrong version")
        .when(F.coalesce(F.col("_head.type"), F.lit("")) != "", "wrong type")
        .when(F.col("_unknown"), "unknown field")
        .otherwise("record")
    )
    return checked.select(*lines.columns, kind.alias("kind"))


def read_trace(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """The lines of a trace, batch or stream, each told what it is."""
    reader = spark.readStream if stream else spark.read
    kept = ["value", F.col("_metadata.file_path").alias("file")]
    if not stream:
        # Row ids grow along a split, and splits are told apart by where they begin.
        row = F.monotonically_increasing_id().alias("row")
        kept.append(F.struct(F.col("_metadata.file_block_start").alias("block"), row).alias("place"))
    return classify_trace(reader.text(path).select(*kept))


def check_trace(lines: DataFrame) -> None:
    """Raise when a trace cannot be replayed.

    A torn line at the end of a file is what an interrupt leaves and is passed
    over; any other bad line, or a trace without records, is an error.
    """
    torn = F.col("kind") == "torn"
    last_torn = F.max_by(torn, "place").cast("int") if "place" in lines.columns else F.lit(1)
    per_file = lines.groupBy("file").agg(
        # One torn line elsewhere counts as two, which is an error like any two.
        (F.count_if(torn) * F.when(last_torn == 1, 1).otherwise(2)).alias("torn"),
        F.count_if(~F.col("kind").isin("record", "header", "torn")).alias("bad"),
        F.count_if(F.col("kind") == "record").alias("records"),
    )
    worst = per_file.agg(F.max("torn"), F.sum("bad"), F.sum("records")).first()
    if (worst[0] or 0) > 1 or (worst[1] or 0) > 0:
        raise ValueError(f"trace has {worst[1]} unreadable and up to {worst[0]} torn lines per file")
    if not worst[2]:
        raise ValueError("trace holds no records")


def trace_sessions(lines: DataFrame) -> DataFrame:
    """One row per session of every record, durations in milliseconds."""
    records = lines.where("kind = 'record'").withColumn("r", F.from_json("value", TRACE_SCHEMA))
    exploded = records.select(
        to_instant(F.col("r.at")).alias("captured_at"),
        "r.capture.database_kind",
        F.explode("r.capture.connections").alias("c"),
    )
    return exploded.select(
        "captured_at", "database_kind",
        F.coalesce("c.instance_role", F.lit("")).alias("instance_role"),
        *_common(F.floor(F.col("c.duration") / 1_000_000), "username", "database"),
    )


def read_query_patterns(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A query-patterns report, CSV or gzipped CSV (by its ``.gz`` ending).

    Without a schema the columns are text, named by the header of one file. A
    report that is not compressed splits between tasks, see :func:`read_quoted`.
    """
    if schema is None:
        schema = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True).schema
    return read_quoted(spark, path, schema)


# The fields of an audit event; its metadata is free.
AUDIT_SCHEMA = """id STRING, type STRING, actor_id STRING, actor_type STRING, actor_display_name STRING,
auditable_id STRING, auditable_type STRING, auditable_display_name STRING, audit_action STRING, action STRING,
location STRING, remote_ip STRING, target_id STRING, target_type STRING, target_display_name STRING,
metadata VARIANT, created_at TIMESTAMP, updated_at TIMESTAMP"""


def read_audit_events(spark: SparkSession, path: str) -> DataFrame:
    """Audit events as JSON lines; ``metadata`` keeps whatever shape it has."""
    return spark.read.json(path, schema=AUDIT_SCHEMA)


def audit_page(
    events: DataFrame,
    actions: tuple[str, ...] = (),
    after: tuple | None = None,
    limit: int = 25,
) -> DataFrame:
    """The next page of events, newest first, with a flag whether more follow.

    ``after`` is the (created_at, id) of the last row seen. One row more than
    the page is fetched to know whether there is a next one.
    """
    if actions:
        events = events.where(F.col("action").isin(*actions))
    if after is not None:
        seen = F.struct(F.lit(after[0]).alias("created_at"), F.lit(after[1]).alias("id"))
        events = events.where(F.struct("created_at", "id") < seen)
    top = events.orderBy(F.desc("created_at"), F.desc("id")).limit(limit + 1)
    # At most limit + 1 rows are left here, so one task may see them all.
    size = F.count("*").over(Window.partitionBy(F.lit(0)))
    page = top.withColumn("has_next", size > limit)
    return page.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)
