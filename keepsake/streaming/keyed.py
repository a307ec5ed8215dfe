"""Keyed state of streams: what a key keeps between batches, with timers and times to live.

The processors run under ``transformWithState``, which needs the RocksDB state store
(``spark.sql.streaming.stateStore.providerClass``; sessions of this library have it).
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from math import atan2, cos, radians, sin, sqrt
from typing import NamedTuple

from pyspark.sql import Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues


STORE = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """While it holds, queries that start get the store that keyed state needs; for sessions opened elsewhere."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(STORE) if before is None else spark.conf.set(STORE, before)


class Photo(NamedTuple):
    """When and where; the place may be unknown."""

    us: int
    id: int
    lat: float | None
    lon: float | None


def far(a: Photo, b: Photo, km: float) -> bool:
    """Whether two known places are more than ``km`` apart."""
    if None in (a.lat, a.lon, b.lat, b.lon):
        return False
    h = sin(radians(b.lat - a.lat) / 2) ** 2 + cos(radians(a.lat)) * cos(radians(b.lat)) * sin(radians(b.lon - a.lon) / 2) ** 2
    return 2 * 6371.0 * atan2(sqrt(h), sqrt(max(0.0, 1 - h))) > km


def cut(photos: list[Photo], gap_us: int, far_km: float) -> list[list[Photo]]:
    """Photos in order of time, parted after a long gap and by a jump in place."""
    groups: list[list[Photo]] = []
    for p in sorted(photos, key=lambda p: (p.us, p.id)):
        if groups and p.us - groups[-1][-1].us < gap_us and not far(groups[-1][-1], p, far_km):
            groups[-1].append(p)
        else:
            groups.append([p])
    return groups


class DeviceEvents(StatefulProcessor):
    """A device's open photos as they came, and the time at which its oldest event may be over.

    A batch's photos are one append and an ending one rewrite, however many they are: each call of the state
    is a message to the JVM.
    """

    def __init__(self, gap_us: int, far_km: float, least: int) -> None:
        self.gap_us, self.far_km, self.least = gap_us, far_km, least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "id long, us long, lat double, lon double")
        self.due = handle.getValueState("due", "ms long")

    def wake(self, ms: int) -> None:
        """Set the device's one timer."""
        if self.due.exists():
            self.handle.deleteTimer(self.due.get()[0])
        self.handle.registerTimer(ms)
        self.due.update((ms,))

    def over(self, us: int) -> int:
        """The watermark, in ms, at which an event that ends there is over."""
        return -(-(us + self.gap_us) // 1000)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:  # noqa: N803
        came = [(r["id"], r["us"], r["lat"], r["lon"]) for r in rows]
        if came:
            self.open.appendList(came)
        first = min((us for _, us, _, _ in came), default=None)
        if first is not None and (not self.due.exists() or self.over(first) < self.due.get()[0]):
            self.wake(max(self.over(first), timerValues.getCurrentWatermarkInMs() + 1))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:  # noqa: N803
        now = timerValues.getCurrentWatermarkInMs()
        self.due.clear()
        last = {r[0]: Photo(r[1], r[0], r[2], r[3]) for r in self.open.get()}  # one that came twice: as it came last
        groups = cut(list(last.values()), self.gap_us, self.far_km)
        later, stay = [], []
        for g in groups:
            if self.over(g[-1].us) > now:
                later.append(self.over(g[-1].us))
                stay += g
                continue
            if len(g) >= self.least:
                yield Row(device_id=key[0], start_us=g[0].us, end_us=g[-1].us, photo_count=len(g))
        if stay:
            self.open.put([(p.id, p.us, p.lat, p.lon) for p in stay])
        else:
            self.open.clear()
        if later:
            self.wake(max(min(later), now + 1))

    def close(self) -> None:
        pass


class Once(StatefulProcessor):
    """A flag that a key was handled, forgotten by the store after its time to live."""

    def __init__(self, ttl_ms: int, time: str) -> None:
        self.ttl_ms, self.time = ttl_ms, time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handled = handle.getValueState("handled", "yes boolean", self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:  # noqa: N803
        newest = None
        for r in rows:
            if newest is None or newest[self.time] is None or (r[self.time] is not None and r[self.time] > newest[self.time]):
                newest = r
        if newest is not None and not self.handled.exists():
            self.handled.update((True,))
            yield newest

    def close(self) -> None:
        pass
