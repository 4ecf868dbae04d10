"""Sources that fall silent: freshness by timers, without a new row.

Each source keeps what it last sent and two processing-time timers. A row sets
them anew; one that runs out says that the source has become stale.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quayside.functions.labels import STALE_AFTER, VERY_STALE_AFTER

_PROVIDER_KEY = "spark.sql.streaming.stateStore.providerClass"
_PARTITIONS_KEY = "spark.sql.shuffle.partitions"
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

TIERS = "source string, snapshot bigint, at_ms bigint, freshness string"


class _Watch(StatefulProcessor):
    def __init__(self, interval_ms: int, forget_ms: int):
        self._interval, self._forget = interval_ms, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._last = handle.getValueState("last", "snapshot bigint, seen_ms bigint", ttlDurationMs=self._forget)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        held = self._last.get()[0] if self._last.exists() else None
        for batch in rows:
            # Batch by batch; only the newest snapshot is kept.
            newest = batch["snapshot"].max()
            if not pd.isna(newest):
                held = int(newest) if held is None else max(held, int(newest))
        self._last.update((held, now))
        for old in list(self._handle.listTimers()):
            self._handle.deleteTimer(old)
        for after in (STALE_AFTER, VERY_STALE_AFTER):
            self._handle.registerTimer(now + after * self._interval)
        yield self._said(key, held, now, "fresh")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        if not self._last.exists():
            return
        held, seen = self._last.get()
        very = at - seen >= VERY_STALE_AFTER * self._interval
        yield self._said(key, held, at, "very stale" if very else "stale")

    @staticmethod
    def _said(key, held, at, tier) -> pd.DataFrame:
        row = {"source": key[0], "snapshot": held, "at_ms": at, "freshness": tier}
        return pd.DataFrame([row]).astype({"snapshot": "Int64", "at_ms": "int64"})

    def close(self) -> None:
        pass


def watch_sources(index: DataFrame, interval_ms: int, forget_ms: int = 24 * 3_600_000) -> DataFrame:
    """How fresh each source is, whenever that changes.

    ``index`` has source and snapshot, one row for each snapshot. A source is
    fresh when rows of it arrive, stale three intervals after the last ones and
    very stale ten intervals after them, by the time at which they were
    processed. State of a source that stays away ``forget_ms`` longer expires;
    it begins anew when it comes back. Null snapshots show a source alive and
    move nothing; a null source is a source of its own.

    Needs the state store of :func:`timers_allowed` while the stream starts.
    """
    forget = VERY_STALE_AFTER * interval_ms + forget_ms
    return index.select("source", "snapshot").groupBy("source").transformWithStateInPandas(
        _Watch(interval_ms, forget), TIERS, "update", "processingTime"
    )


@contextmanager
def timers_allowed(spark: SparkSession, partitions: int | None = None) -> Iterator[None]:
    """Streams started inside have the state store that timers need; settings are put back.

    ``partitions`` of the state stay what they are for the life of a checkpoint;
    by default they are the session's shuffle partitions.
    """
    wanted = {_PROVIDER_KEY: _PROVIDER} | ({_PARTITIONS_KEY: str(partitions)} if partitions else {})
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
