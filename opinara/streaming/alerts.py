"""Alerts of a stream of closed windows, with state and timers per series.

Each series keeps a running mean and deviation and two cumulative sums. A row raises `up` or `down` when a sum passes its threshold,
and `drop` when its value lies `drop` or more below the mean so far. A timer stands at the last row plus `silence`: when event time passes
it, or a later row comes first, the series is reported as `silent` at that time and its state goes, so that series which
ended cost nothing. A series that speaks again starts anew. Results do not depend on how rows are cut into batches, as long as
each series' rows come in order.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = "n long, mean double, m2 double, up double, down double, last long"
ALERTS = "series_id string, ds timestamp, kind string, value double"
_SECOND = 1_000_000_000


class AlertProcessor(StatefulProcessor):
    """`silence_ms` is the time without rows after which a series is closed."""

    def __init__(self, silence_ms: int, drift: float, threshold: float, drop: float, warmup: int):
        self.silence_ms, self.drift, self.threshold, self.drop, self.warmup = silence_ms, drift, threshold, drop, warmup

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("series", STATE)

    def _rows(self, key, found: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame([(key[0], pd.Timestamp(ms, unit="ms"), kind, value) for ms, kind, value in found],
                           columns=["series_id", "ds", "kind", "value"])
        return out.astype({"ds": "datetime64[ns]", "value": "float64", "series_id": "object", "kind": "object"})

    def step(self, held: tuple | None, ms: int, y: float) -> tuple[tuple, list[tuple]]:
        """State after a row, and what it raises."""
        found = []
        if held is not None and ms - held[5] > self.silence_ms:
            found.append((held[5] + self.silence_ms, "silent", None))
            held = None
        n, mean, m2, up, down, _ = held or (0, 0.0, 0.0, 0.0, 0.0, ms)
        sd = (m2 / n) ** 0.5 if n else 0.0
        if n >= self.warmup:
            if mean - y >= self.drop:
                found.append((ms, "drop", y - mean))
            if sd > 0:
                z = (y - mean) / sd
                up, down = max(0.0, up + z - self.drift), max(0.0, down - z - self.drift)
                if max(up, down) > self.threshold:
                    found.append((ms, "up" if up >= down else "down", y))
                    up = down = 0.0
        n += 1
        delta = y - mean
        mean += delta / n
        m2 += delta * (y - mean)
        return (n, mean, m2, up, down, ms), found

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = tuple(self.state.get()) if self.state.exists() else None
        if held is not None:
            self.handle.deleteTimer(held[5] + self.silence_ms)
        found: list[tuple] = []
        for pdf in rows:
            pdf = pdf.sort_values("ds")
            for ds, y in zip(pdf["ds"], pdf["y"], strict=True):
                held, more = self.step(held, int(pd.Timestamp(ds).value // (_SECOND // 1000)), float(y))
                found += more
        if held is not None:
            self.state.update(held)
            self.handle.registerTimer(held[5] + self.silence_ms)
        yield self._rows(key, found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        self.state.clear()
        yield self._rows(key, [(at, "silent", None)])

    def close(self) -> None:
        pass


@contextmanager
def timed_state(spark: SparkSession):
    """State with timers needs the embedded store; the setting is put back afterwards."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def alert_stream(windows: DataFrame, silence_days: float = 3.0, drift: float = 0.5, threshold: float = 3.0, drop: float = 0.5,
                 warmup: int = 10, delay: str = "0 seconds") -> DataFrame:
    """Alerts ``(series_id, ds, kind, value)`` of a stream of ``(series_id, ds, y)``; start it inside `timed_state`."""
    processor = AlertProcessor(int(silence_days * 86_400_000), drift, threshold, drop, warmup)
    return (windows.select("series_id", "ds", "y").withWatermark("ds", delay).groupBy("series_id")
            .transformWithStateInPandas(processor, ALERTS, "append", "eventTime"))
