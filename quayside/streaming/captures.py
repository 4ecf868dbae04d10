"""Streams of session snapshots and of the query log.

The same DataFrame functions run in batch and here; this module adds sources,
triggers and the one operator that keeps state of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quayside.functions import labels
from quayside.operators.querylog import hourly_rollup
from quayside.sinks.trace import trace_lines, write_header
from quayside.sources.records import classify_trace, parse_snapshots


def start(query, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Run on what is there and stop, or go on at an interval."""
    query = query.option("checkpointLocation", checkpoint)
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return query.trigger(**trigger).start()


def snapshot_stream(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """Snapshot documents as they land, decoded."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder)
    return parse_snapshots(lines)


def table_stream(table: DataFrame, name: str) -> DataFrame:
    """The whole of a Parquet table as a stream, as ``table`` reads it.

    ``name`` is the table's own file or folder. A folder is streamed with all
    below it, partition columns included; a single file by its name, as a
    stream reads folders.
    """
    path = table.inputFiles()[0]
    above = path[: path.rindex(f"/{name}")]
    reader = table.sparkSession.readStream.schema(table.schema)
    if path == f"{above}/{name}":
        return reader.option("pathGlobFilter", name).parquet(above)
    return reader.parquet(f"{above}/{name}")


def capture(
    spark: SparkSession, landed: str, trace: str, checkpoint: str,
    header: str | None = None, interval: str | None = None,
) -> StreamingQuery:
    """Append a trace record for every landed snapshot, the header once.

    The sink keeps a log of its files, so a restart neither loses nor repeats
    a record. The header goes to a folder of its own beside the records.
    """
    if header and not _holds_text(spark, f"{trace}/header"):
        write_header(spark, f"{trace}/header", header)
    records = trace_lines(snapshot_stream(spark, landed))
    writer = records.writeStream.format("text").option("path", f"{trace}/records").outputMode("append")
    return start(writer, checkpoint, interval)


def _holds_text(spark: SparkSession, folder: str) -> bool:
    try:
        return bool(spark.read.text(folder).head(1))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return False


def read_capture(spark: SparkSession, trace: str) -> DataFrame:
    """The lines of a trace written by :func:`capture`."""
    header = spark.read.text(f"{trace}/header").select("value", F.lit("header").alias("file"))
    records = spark.read.text(f"{trace}/records").select("value", F.col("_metadata.file_path").alias("file"))
    return classify_trace(header.unionByName(records))


def hold_last_good(index: DataFrame) -> DataFrame:
    """Per source and snapshot, the snapshot to show.

    Input has one row per snapshot (source, snapshot, unreachable), not one per
    session, so a busy source stays cheap. The state of a source is two numbers:
    the last complete snapshot and the first one of all. Rows of a micro-batch
    are taken in snapshot order; an older snapshot that comes late is answered
    but does not move the state back.
    """
    out = "source string, snapshot bigint, unreachable bigint, shown_snapshot bigint"

    def hold(
        key: tuple, batches: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        good, first = state.get if state.exists else (None, None)
        rows = pd.concat(list(batches)).sort_values("snapshot")
        snapshots = rows["snapshot"].to_numpy()
        first = int(snapshots[0]) if first is None else first
        # The greatest good one so far, or the least number there is.
        before = np.iinfo(np.int64).min if good is None else good
        own = np.where(rows["unreachable"] == 0, snapshots, np.iinfo(np.int64).min)
        held = np.maximum.accumulate(np.maximum(own, before))
        none = held == np.iinfo(np.int64).min
        good = None if none[-1] else int(held[-1])
        state.update((good, first))
        rows = rows.assign(source=key[0], shown_snapshot=np.where(none, first, held))
        yield rows[["source", "snapshot", "unreachable", "shown_snapshot"]]

    return index.groupBy("source").applyInPandasWithState(
        hold, out, "good bigint, first bigint", "append", GroupStateTimeout.NoTimeout
    )


def retain_last(index: DataFrame, keep: int = 300) -> DataFrame:
    """The ids of the newest snapshots of each source, after each micro-batch.

    The state is the ring itself: at most ``keep`` ids, the cursor each got when
    it arrived, and the number of all snapshots seen. A late snapshot takes the
    next cursor and moves no other.
    """
    out = "source string, snapshot bigint, cursor bigint, position bigint, total bigint"

    def ring(
        key: tuple, batches: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        held, seen = (list(zip(state.get[0], state.get[1])), state.get[2]) if state.exists else ([], 0)
        for batch in batches:
            new = sorted(int(s) for s in batch["snapshot"])
            held = sorted([*held, *((s, seen + i) for i, s in enumerate(new))])[-keep:]
            seen += len(new)
        ids, cursors = [s for s, _ in held], [c for _, c in held]
        state.update((ids, cursors, seen))
        n = len(held)
        yield pd.DataFrame(
            {
                "source": key[0],
                "snapshot": ids,
                "cursor": cursors,
                "position": range(1, n + 1),
                "total": n,
            }
        )

    return index.groupBy("source").applyInPandasWithState(
        ring, out, "held array<bigint>, cursors array<bigint>, seen bigint", "update", GroupStateTimeout.NoTimeout
    )


def hourly_statistics(
    log: DataFrame, folder: str, checkpoint: str, watermark: str = "10 minutes", interval: str | None = None
) -> StreamingQuery:
    """Hourly statistics of a growing query log.

    Every micro-batch writes the hours it changed under its batch number. Rows
    later than the watermark are dropped here; a batch run of the same rollup
    over the log repairs them.
    """

    def write(batch: DataFrame, number: int) -> None:
        # A batch replayed after a failure replaces what it wrote before.
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    writer = hourly_rollup(log, watermark).writeStream.outputMode("update").foreachBatch(write)
    return start(writer, checkpoint, interval)


def read_hourly(spark: SparkSession, folder: str) -> DataFrame:
    """The newest state of each hour and fingerprint."""
    rows = spark.read.parquet(folder)
    values = [c for c in rows.columns if c not in ("hour", "fingerprint", "batch")]
    newest = rows.groupBy("hour", "fingerprint").agg(
        F.max_by(F.struct(*values), "batch").alias("v")
    )
    return newest.select("hour", "fingerprint", "v.*")


def with_freshness(stream: DataFrame, at: str, interval_ms: int) -> DataFrame:
    """Adds how stale each snapshot is when its row is processed."""
    age = F.timestamp_diff("MICROSECOND", F.col(at).cast("timestamp"), F.current_timestamp()) / 1000
    return stream.withColumn("freshness", labels.freshness_tier(age, F.lit(interval_ms)))
