"""Violation periods of a stream against the batch form, and statistics of spans of hours."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quayside.operators import querylog, spans
from quayside.streaming import periods

START = datetime.datetime(2024, 1, 1)
SCHEMA = "metric string, minute timestamp, load double"


def minute(n):
    return START + datetime.timedelta(minutes=n)


def streamed(spark, folder, batches, lateness):
    """Periods after each batch, every batch a run of its own that goes on from the state."""
    source, out, checkpoint = folder("minutes"), folder("periods"), folder("checkpoint")
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        periods.write_violations(stream, out, checkpoint, 5.0, "1 minute", lateness).awaitTermination()
    return sorted(map(tuple, periods.read_violations(spark, out).collect()), key=repr)


def batched(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).where("minute IS NOT NULL")
    return sorted(map(tuple, querylog.violation_periods(df, 5.0).collect()), key=repr)


def test_stream_equals_batch_with_late_rows(spark, folder):
    rng = random.Random(3)
    rows = [(m, minute(n), rng.choice([1.0, 9.0, 9.5, None])) for m in ("cpu", "io", None) for n in range(120)]
    rows += [("quiet", minute(n), 1.0) for n in range(3)] + [("cpu", None, 9.0)]
    # Each row up to 30 minutes late: files hold overlapping stretches of time.
    rows.sort(key=lambda r: (r[1] or START) + datetime.timedelta(minutes=rng.randrange(30)))
    batches = [rows[i : i + 130] for i in range(0, len(rows), 130)]
    assert streamed(spark, folder, batches, "1 hour") == batched(spark, rows)


def test_late_row_joins_periods_and_later_ones_are_dropped(spark, folder):
    first = [("cpu", minute(n), 9.0) for n in (0, 1, 3, 4)]
    joining, closing = [("cpu", minute(2), 7.0)], [("cpu", minute(60), 1.0)]
    too_late = [("cpu", minute(5), 99.0)]
    got = streamed(spark, folder, [first, joining, closing, too_late], "10 minutes")
    assert got == batched(spark, first + joining + closing)
    assert [(r[1], r[2], r[3], r[5]) for r in got] == [(minute(0), minute(5), 5, False)]


def test_runs_of_a_batch():
    at, load = np.array([30, 10, 20, 50, 70]), np.array([1.0, 5.0, 3.0, 2.0, 4.0])
    assert periods._runs_of(at, load, 10) == [(10, 40, 3, 5.0), (50, 60, 1, 2.0), (70, 80, 1, 4.0)]
    assert periods._runs_of(at[:0], load[:0], 10) == []
    assert periods._joined([(50, 60, 1, 2.0), (10, 40, 3, 5.0), (40, 50, 1, 1.0)]) == [(10, 60, 5, 5.0)]


def test_spans_are_merged_from_hours(spark, folder):
    rng = random.Random(4)
    rows = [(minute(rng.randrange(2880)), rng.choice(["a", None]), i % 9 == 0, rng.lognormvariate(0, 2)) for i in range(6000)]
    rows += [(minute(7), "unmeasured", False, None), (minute(8), "one", True, 4.0)]
    log = spark.createDataFrame(rows, "ts timestamp, fingerprint string, is_error boolean, latency_ms double")
    path = folder("hours")
    spans.hourly_sketches(log).write.parquet(path)
    days = spans.span_statistics(spark.read.parquet(path), F.to_date("hour"), {"p50": 0.5, "p99": 0.99}).collect()
    for r in days:
        own = [x for x in rows if x[0].date() == r.span and x[1] == r.fingerprint]
        values = np.array([x[3] for x in own if x[3] is not None])
        assert r.query_count == len(own) and r.error_count == sum(x[2] for x in own)
        if not len(values):
            assert r.p50 is None and r.total_ms is None
            continue
        assert r.total_ms == pytest.approx(values.sum()) and r.max_latency == values.max()
        for q, p in ((r.p50, 0.5), (r.p99, 0.99)):
            assert q in values
            assert (values < q).mean() <= p + 0.02 and (values <= q).mean() >= p - 0.02
    assert sum(r.query_count for r in days) == len(rows)
    assert spans.span_statistics(spark.read.parquet(path).limit(0), F.to_date("hour"), {"p50": 0.5}).count() == 0
