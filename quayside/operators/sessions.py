"""Session snapshots: filters, orders, labels and the retained window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quayside.functions import labels
from quayside.functions.text import preview, strip_controls
from quayside.operators.joins import join_groups
from quayside.session import materialize

ROLES = ("primary", "replica")
RETAINED = 300  # snapshots kept for stepping back


def with_roles(sessions: DataFrame, instances: DataFrame, keys=("source", "snapshot", "instance")) -> DataFrame:
    """Adds the role of each session's instance, empty when unknown.

    No hint: instance rows grow with the number of snapshots, so the optimizer
    decides by their size whether to broadcast.
    """
    keys = list(keys)
    roles = instances.select(*keys, F.col("role").alias("instance_role"))
    joined = sessions.join(roles, keys, "left")
    return joined.withColumn("instance_role", F.coalesce("instance_role", F.lit("")))


def unknown_instance(instances: DataFrame, instance: str) -> DataFrame:
    """One row naming the valid ids when no snapshot has this instance."""
    named = instances.groupBy().agg(
        F.count_if(F.col("instance") == instance).alias("hits"),
        F.array_join(F.array_sort(F.collect_set("instance")), ", ").alias("valid"),
    )
    return named.where("hits = 0").select(F.lit(instance).alias("instance"), "valid")


def filter_snapshot(
    sessions: DataFrame, instances: DataFrame, instance: str = "", role: str = ""
) -> tuple[DataFrame, DataFrame]:
    """Both frames cut to one instance or to one role.

    An instance that no snapshot has is an error which lists the valid ones;
    only streams, which may yet bring it, are not looked through for it.
    """
    if instance and role:
        raise ValueError("an instance and a role cannot be combined")
    if role and role not in ROLES:
        raise ValueError(f"role must be one of: {', '.join(ROLES)}")
    if instance and not instances.isStreaming:
        unknown = unknown_instance(instances, instance).first()
        if unknown:
            raise ValueError(f"no instance {instance!r}, one of: {unknown['valid']}")
    if instance:
        picked = F.col("instance") == instance
        return sessions.where(picked), instances.where(picked)
    if role:
        return sessions.where(F.col("instance_role") == role), instances.where(F.col("role") == role)
    return sessions, instances


def session_order(mode: str) -> list[Column]:
    """Sort keys of a mode: transaction, duration or blocked."""
    by_start = [
        F.col("xact_start").asc_nulls_last(),
        F.col("query_start").asc_nulls_last(),
        F.col("pid").asc(),
    ]
    if mode == "transaction":
        return by_start
    if mode == "duration":
        working = labels.has_work(F.col("state"), F.col("query_text"))
        return [F.col("duration_ms").desc(), working.desc(), F.col("pid").asc()]
    if mode == "blocked":
        waiting = F.col("waiting")
        return [
            F.col("blocking_count").desc(),
            ((F.col("state") == "active") & waiting).desc(),
            waiting.desc(),
            *by_start,
        ]
    raise ValueError("mode must be transaction, duration or blocked")


def sort_sessions(sessions: DataFrame, mode: str, scope=("source", "snapshot")) -> DataFrame:
    """A distributed sort: snapshots in order, sessions in the mode's order."""
    return sessions.orderBy(*scope, *session_order(mode))


def with_position(sessions: DataFrame, mode: str, scope=("source", "snapshot")) -> DataFrame:
    """The place of each session in its snapshot.

    A partition of this window is one process list, as large as a server has
    connections; it does not grow with the number of snapshots.
    """
    return sessions.withColumn(
        "position", F.row_number().over(Window.partitionBy(*scope).orderBy(*session_order(mode)))
    )


def display_columns(sessions: DataFrame) -> DataFrame:
    """The text shown for each session."""
    state = F.col("state")
    has_count = "blocking_count" in sessions.columns
    shown = {
        "state_text": labels.state_label(state),
        "command_text": labels.command_label(state),
        "wait_text": labels.wait_label(F.col("wait_event_type"), F.col("wait_event")),
        "duration_text": labels.compact_duration(F.col("duration_ms")),
        "user_text": strip_controls(F.col("username")),
        "query_text_preview": preview(F.col("query_text")),
        "working": labels.has_work(state, F.col("query_text")),
        "process_working": labels.has_work(state, F.col("query_text"), process_list=True),
    }
    if has_count:
        shown["block_text"] = labels.block_label(F.col("blocking_count"), F.col("waiting"))
    return sessions.withColumns(shown)


def partial_snapshots(instances: DataFrame) -> DataFrame:
    """Per snapshot, how many instances there are and which did not answer."""
    failed = F.when(F.col("error") != "", F.col("instance"))
    return instances.groupBy("source", "snapshot").agg(
        F.count("*").alias("instances"),
        F.count_if(F.col("error") != "").alias("unreachable"),
        F.array_join(F.array_sort(F.collect_set(failed)), ", ").alias("unreachable_ids"),
    )


def snapshot_index(sessions: DataFrame) -> DataFrame:
    """One row per snapshot; the windows below run on this, not on sessions."""
    return sessions.groupBy("source", "snapshot").agg(F.count("*").alias("sessions"))


def retained_window(index: DataFrame, keep: int = RETAINED) -> DataFrame:
    """The newest snapshots of each source with their place in the window.

    ``cursor`` counts all snapshots of the source ever seen, so it stays the
    same when older ones fall out.
    """
    newest = Window.partitionBy("source").orderBy(F.col("snapshot").desc())
    kept = index.withColumn("_rank", F.row_number().over(newest)).where(F.col("_rank") <= keep)
    totals = index.groupBy("source").agg(F.count("*").alias("_all"))
    sized = kept.join(totals, "source")
    total = F.least(F.col("_all"), F.lit(keep)).cast("bigint")
    return sized.select(
        "source",
        "snapshot",
        "sessions",
        (F.col("_all") - F.col("_rank")).alias("cursor"),
        (total - F.col("_rank") + 1).alias("position"),
        total.alias("total"),
    )


def with_neighbours(window: DataFrame) -> DataFrame:
    """The snapshots one step back and one step ahead of each."""
    order = Window.partitionBy("source").orderBy("snapshot")
    return window.withColumns(
        {"older": F.lag("snapshot").over(order), "newer": F.lead("snapshot").over(order)}
    )


def step_cursor(cursor: Column, delta: Column, oldest: Column, latest: Column) -> Column:
    """Move a cursor, held within the window.

    From outside, it only moves toward the window and lands on the near edge.
    """
    clamped = F.greatest(oldest, F.least(latest, cursor + delta))
    return (
        F.when(cursor < oldest, F.when(delta > 0, oldest).otherwise(cursor))
        .when(cursor > latest, F.when(delta < 0, latest).otherwise(cursor))
        .otherwise(clamped)
    )


def last_good_snapshot(partials: DataFrame) -> DataFrame:
    """The snapshot to show at each instant.

    A partial snapshot does not replace a complete one; before there is any
    complete one, the first partial is shown. Runs on the index, one row per
    snapshot.

    A scan in two levels: rows are range partitioned, so a source with a long
    history lies in many parts; what each part carries on is scanned over the
    parts, and the rest is looked for inside a part. A null source is a source
    of its own, and an empty index gives no rows.
    """
    parts = int(partials.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = partials.select("source", "snapshot", "unreachable").repartitionByRange(parts, "source", "snapshot")
    dealt = materialize(ranged.withColumn("part", F.spark_partition_id()), "good-parts")
    # Snapshots ascend, so the last good one is the greatest.
    good = F.max(F.when(F.col("unreachable") == 0, F.col("snapshot")))
    own = dealt.groupBy("source", "part").agg(good.alias("good"), F.min("snapshot").alias("first"))
    of_source = Window.partitionBy("source")
    earlier = of_source.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = own.select(
        "source", "part", F.max("good").over(earlier).alias("carried"), F.min("first").over(of_source).alias("first")
    )
    so_far = Window.partitionBy("source", "part").orderBy("snapshot").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    inside = dealt.withColumn("inside", good.over(so_far))
    return join_groups(inside, carried, ["source", "part"]).select(
        "source", "snapshot", "unreachable", F.coalesce("inside", "carried", "first").alias("shown_snapshot")
    )


def long_running(sessions: DataFrame, at: Column, seconds: int = 300) -> DataFrame:
    """Working sessions whose query runs longer than ``seconds``."""
    elapsed = F.timestamp_diff("SECOND", F.col("query_start"), at)
    return sessions.withColumn("elapsed_s", elapsed).where(
        (F.col("state") != "idle")
        & (F.col("backend_type") != "walsender")
        & (F.trim("query_text") != "")
        & (F.timestamp_diff("MICROSECOND", F.col("query_start"), at) > seconds * 1_000_000)
    )


def from_process_list(processes: DataFrame) -> DataFrame:
    """Process-list rows in the columns of sessions."""
    state = F.concat_ws("/", F.nullif("command", F.lit("")), F.nullif("state", F.lit("")))
    kept = [c for c in ("source", "snapshot") if c in processes.columns]
    return processes.select(
        *kept,
        F.col("id").cast("bigint").alias("pid"),
        F.col("user").alias("username"),
        F.col("host").alias("client_addr"),
        F.col("db").alias("database"),
        state.alias("state"),
        (F.col("time") * 1000).cast("bigint").alias("duration_ms"),
        F.coalesce("info", F.lit("")).alias("query_text"),
    )
