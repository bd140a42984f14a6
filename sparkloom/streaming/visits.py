"""Visits of users by arbitrary state: what is open is held per user and closed by event-time timers.

The state of a user is a list (events of visits that are still open) and a value (when the timer is
due, and how many visits there have been). Events may come in any order
within the watermark's delay. When the watermark passes the end of a visit by ``gap``, the timer
fires: visits that ended are numbered and put out, the events of later ones stay. So the
state is bounded by a user's open visits. The state store
must be RocksDB, which keeps state on disk. Each call on the state is a message between Python and the JVM,
so there are few of them: four or five when a user's events come, five or six when the timer fires.

Defined cases: null users are one user; events with a null time or kind are left out; events later than
the watermark are dropped by Spark; two events exactly ``gap`` apart belong to different visits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
VISITS = "user_id {kind}, started timestamp_ntz, ended timestamp_ntz, n long, kinds long, nth long"


def use_rocks(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


class Visits(StatefulProcessor):
    def __init__(self, gap_seconds: int):
        self.gap = gap_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "at long, kind string")
        self.told = handle.getValueState("told", "due long, visits long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        first = 1 << 62
        for part in rows:
            at = part["at"].to_numpy("datetime64[us]").astype("int64")
            self.open.appendList(list(zip(at.tolist(), part["kind"].tolist())))
            first = min(first, int(at.min()))
        due, visits = self.told.get() or (None, 0)
        self._wake(first, due, visits)
        yield from ()

    def _wake(self, event: int, due: int | None, visits: int) -> None:
        """A timer at the time at which a visit that ends with ``event`` is over; of two the earlier one stays, and looks again."""
        at = (event + self.gap) // 1000 + 1
        if due is not None:
            if due <= at:
                return
            self.handle.deleteTimer(due)
        self.told.update((at, visits))
        self.handle.registerTimer(at)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        now = timerValues.getCurrentWatermarkInMs() * 1000
        _, before = self.told.get()
        visits: list[list[tuple[int, str]]] = []
        for event in sorted(tuple(e) for e in self.open.get()):
            if not visits or event[0] - visits[-1][-1][0] >= self.gap:
                visits.append([])
            visits[-1].append(event)
        over = [v for v in visits if v[-1][0] + self.gap <= now]
        still = [e for v in visits[len(over) :] for e in v]
        if still:
            self.open.put(still)
            self._wake(visits[len(over)][-1][0], None, before + len(over))
        else:
            self.open.clear()
            self.told.update((None, before + len(over)))
        if over:
            yield self._closed(key, over, before)

    def _closed(self, key: tuple, over: list[list[tuple[int, str]]], before: int) -> pd.DataFrame:
        when = lambda place: np.array([v[place][0] for v in over], "datetime64[us]")
        return pd.DataFrame(
            {"user_id": [key[0]] * len(over), "started": when(0), "ended": when(-1), "n": [len(v) for v in over],
             "kinds": [len({k for _, k in v}) for v in over], "nth": np.arange(before + 1, before + 1 + len(over))}
        )

    def close(self) -> None:
        pass


def visits(events: DataFrame, user: str, time: str, kind: str, gap_seconds: int) -> DataFrame:
    """``user_id, started, ended, n, kinds, nth`` of every visit that the watermark has closed; ``events`` needs a watermark on ``time``."""
    use_rocks(events.sparkSession)
    rows = events.where(F.col(time).isNotNull() & F.col(kind).isNotNull()).select(F.col(user).alias("user_id"), F.col(time).alias("at"), F.col(kind).alias("kind"))
    schema = VISITS.format(kind=dict(rows.dtypes)["user_id"])
    return rows.groupBy("user_id").transformWithStateInPandas(Visits(gap_seconds), schema, "Append", "eventTime")


class LastSeen(StatefulProcessor):
    """The first event of each key, and again once nothing of it has been taken for ``ttl_ms`` of the cluster's time."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "n long", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        n = sum(len(part) for part in rows)
        fresh = not self.seen.exists()
        self.seen.update((n,))
        if fresh:
            yield pd.DataFrame({"key": [key[0]], "n": [n]})

    def close(self) -> None:
        pass


def seen_again(events: DataFrame, key: str, ttl_ms: int) -> DataFrame:
    """``key, n``: keys not seen for ``ttl_ms``, with the number of rows in the batch that brings them. The state of a silent key goes by itself."""
    use_rocks(events.sparkSession)
    rows = events.select(F.col(key).alias("key"))
    return rows.groupBy("key").transformWithStateInPandas(LastSeen(ttl_ms), f"key {dict(rows.dtypes)['key']}, n long", "Update", "processingTime")
