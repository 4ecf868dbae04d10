"""Violation periods of a stream: runs of intervals above a threshold, the last one open.

The batch form is ``operators.querylog.violation_periods``; the stream gives the
same periods, whatever order the intervals of the last ``lateness`` come in.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quayside.operators.joins import join_groups
from quayside.streaming.captures import start

_UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86_400}
_OUT = "metric string, first bigint, past bigint, held bigint, peak double, active boolean, final boolean"
_STATE = "newest bigint, firsts array<bigint>, pasts array<bigint>, helds array<bigint>, peaks array<double>"

Run = tuple[int, int, int, float]  # first and past in microseconds, intervals held, peak


def _micros(span: str) -> int:
    number, unit = re.fullmatch(r"(\d+) (second|minute|hour|day)s?", span).groups()
    return int(number) * _UNITS[unit] * 1_000_000


def _runs_of(at: np.ndarray, load: np.ndarray, width: int) -> list[Run]:
    """Unbroken runs of the intervals of one batch."""
    if not len(at):
        return []
    order = np.argsort(at, kind="stable")
    at, load = at[order], load[order]
    begins = np.flatnonzero(np.concatenate([[True], np.diff(at) != width]))
    ends = np.append(begins[1:], len(at))
    peaks = np.maximum.reduceat(load, begins)
    return [(int(at[b]), int(at[e - 1]) + width, int(e - b), float(p)) for b, e, p in zip(begins, ends, peaks, strict=True)]


def _joined(runs: list[Run]) -> list[Run]:
    """Runs of several batches, those that touch made one."""
    out: list[Run] = []
    for first, past, held, peak in sorted(runs):
        if out and first <= out[-1][1]:
            a = out[-1]
            out[-1] = (a[0], max(a[1], past), a[2] + held, max(a[3], peak))
        else:
            out.append((first, past, held, peak))
    return out


def follow_violations(minutes: DataFrame, threshold: float, step: str = "1 minute", lateness: str = "1 hour") -> DataFrame:
    """Each metric's periods after a micro-batch: those now final, once, and all open ones.

    ``minutes`` holds one row per metric, ``minute`` and ``load``. The state of a
    metric is its newest interval and the runs that a row no older than
    ``lateness`` can still extend or join, so its size does not grow with the
    stream. Rows older than that when their batch begins are dropped here; a
    batch run over the table repairs them. A metric without an open run gives a
    row without a period, so that a reader forgets what was open before. Rows
    without an interval are passed over; a null load is not above anything.
    """
    width, late = _micros(step), _micros(lateness)

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        newest, runs = None, []
        if state.exists:
            newest, *columns = state.get
            runs = list(zip(*columns, strict=True))
        oldest = None if newest is None else newest - late
        for batch in batches:
            at, load = batch["at"].to_numpy("int64"), batch["load"].to_numpy("float64", na_value=np.nan)
            if oldest is not None:
                at, load = at[at >= oldest], load[at >= oldest]
            if len(at):
                newest = int(at.max()) if newest is None else max(newest, int(at.max()))
                above = load > threshold
                runs = _joined([*runs, *_runs_of(at[above], load[above], width)])
        if newest is None:
            return
        final = [r for r in runs if r[1] < newest - late]
        runs = [r for r in runs if r[1] >= newest - late]
        columns = [list(c) for c in zip(*runs, strict=True)] or [[], [], [], []]
        state.update((newest, *columns))
        rows = [(key[0], *r, r[1] > newest, i < len(final)) for i, r in enumerate([*final, *runs])]
        if not runs:
            rows.append((key[0], None, None, None, None, False, False))
        out = pd.DataFrame(rows, columns=["metric", "first", "past", "held", "peak", "active", "final"])
        yield out.astype({"first": "Int64", "past": "Int64", "held": "Int64", "peak": "float64"})

    rows = minutes.where("minute IS NOT NULL").select(
        "metric",
        F.unix_micros(F.col("minute").cast("timestamp")).alias("at"),
        F.col("load").cast("double").alias("load"),
    )
    return rows.groupBy("metric").applyInPandasWithState(follow, _OUT, _STATE, "update", GroupStateTimeout.NoTimeout)


def write_violations(
    minutes: DataFrame,
    folder: str,
    checkpoint: str,
    threshold: float,
    step: str = "1 minute",
    lateness: str = "1 hour",
    interval: str | None = None,
) -> StreamingQuery:
    """Keep the periods of a stream in a folder, under the number of each micro-batch."""

    def write(batch: DataFrame, number: int) -> None:
        # A batch replayed after a failure replaces what it wrote before.
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    writer = follow_violations(minutes, threshold, step, lateness).writeStream.outputMode("update").foreachBatch(write)
    return start(writer, checkpoint, interval)


def read_violations(spark: SparkSession, folder: str) -> DataFrame:
    """All final periods, and the open ones of each metric's last batch."""
    rows = spark.read.schema(f"{_OUT}, batch bigint").parquet(folder)
    last = rows.groupBy("metric").agg(F.max("batch").alias("last"))
    shown = join_groups(rows, last, ["metric"]).where("final OR batch = last").where("first IS NOT NULL")
    return shown.select(
        "metric",
        F.timestamp_micros("first").alias("period_start"),
        F.when(~F.col("active"), F.timestamp_micros("past")).alias("period_end"),
        F.col("held").alias("minutes_in_violation"),
        "peak",
        "active",
    )
