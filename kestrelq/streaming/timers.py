"""Arbitrary state with event-time timers, list and map state, and state that expires (transformWithStateInPandas).

These processors need the RocksDB state store (``rocksdb``).
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "spark.sql.streaming.stateStore.providerClass"


@contextlib.contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside use the RocksDB store; the session's own setting comes back afterwards."""
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(STORE, before)


class TimedSessions(StatefulProcessor):
    """Sessions of users, closed by timers. Rows come grouped by a bucket of users (``bucket``), so calls for state are
    a few for each bucket and batch, not for each user; a bucket's open sessions are one list. One timer stands at the
    bucket's earliest end; when the watermark passes it, all sessions that it has passed are returned, and the next
    timer stands at the earliest end of the rest. Rows of a batch may come in any order.

    Rows before the watermark are dropped by Spark. A task holds one Arrow batch of rows and the open sessions of one
    bucket. Output: user_id, started, ended, n.
    """

    SCHEMA = "user_id long, started timestamp, ended timestamp, n long"

    def __init__(self, gap_seconds: int):
        self.gap = pd.Timedelta(seconds=gap_seconds)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("sessions", "user_id long, started timestamp, ended timestamp, n long")

    def _held(self) -> pd.DataFrame:
        held = pd.DataFrame(list(self.open.get()) if self.open.exists() else [], columns=["user_id", "started", "ended", "n"])
        return held.astype({"user_id": "Int64", "started": "datetime64[us]", "ended": "datetime64[us]", "n": "int64"})

    def _keep(self, sessions: pd.DataFrame, timer: bool) -> None:
        if not len(sessions):
            self.open.clear()
            return
        ids = [None if pd.isna(u) else int(u) for u in sessions.user_id]
        self.open.put(list(zip(ids, *([t.to_pydatetime() for t in sessions[c]] for c in ("started", "ended")), map(int, sessions.n))))
        if timer:
            self.handle.registerTimer(int(_millis(sessions.ended).min()))

    def _merged(self, sessions: pd.DataFrame) -> pd.DataFrame:
        """Sessions that overlap become one."""
        s = sessions.sort_values(["user_id", "started"], kind="stable", ignore_index=True)
        same = s.user_id.eq(s.user_id.shift()).fillna(False).astype(bool) | (s.user_id.isna() & s.user_id.isna().shift(fill_value=False))
        reach = s.groupby((~same).cumsum()).ended.cummax().shift()
        run = (~(same & (s.started < reach))).cumsum()
        return pd.DataFrame({"user_id": s.user_id.groupby(run).head(1).array, "started": s.started.groupby(run).min().array, "ended": s.ended.groupby(run).max().array, "n": s.n.groupby(run).sum().array})

    def handleInputRows(self, key, rows, timerValues):
        held = self._held()
        before = int(_millis(held.ended).min()) if len(held) else None
        for b in rows:
            ts = pd.to_datetime(b["ts"]).astype("datetime64[us]")
            new = pd.DataFrame({"user_id": b["user_id"].astype("Int64"), "started": ts, "ended": ts + self.gap, "n": 1})
            held = self._merged(pd.concat([held, new], ignore_index=True) if len(held) else new)
        # sessions stay until their timers: rows up to the watermark may still join them
        self._keep(held, len(held) and int(_millis(held.ended).min()) != before)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        held = self._held()
        late = _millis(held.ended) <= now
        self._keep(held[~late], bool(late.any()))
        if late.any():
            yield held[late]

    def close(self) -> None:
        pass


def _millis(ended: pd.Series) -> pd.Series:
    """The first millisecond after a session's end, of the clock of the session's zone."""
    return ended.astype("datetime64[us]").astype("int64") // 1000 + 1


class Tallies(StatefulProcessor):
    """Rows of each type per user, in a map state whose entries expire when they have not been written for a time (of
    the clock). Output: a row for each type that a batch has touched, with its count since the entry began."""

    SCHEMA = "user_id long, event_type string, n long"

    def __init__(self, keep_seconds: int):
        self.keep_ms = keep_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getMapState("counts", "event_type string", "n long", self.keep_ms)

    def handleInputRows(self, key, rows, timerValues):
        touched: dict[str, int] = {}
        for b in rows:
            for k, n in b["event_type"].value_counts().items():
                touched[k] = touched.get(k, 0) + int(n)
        for k in touched:
            if self.counts.containsKey((k,)):
                touched[k] += self.counts.getValue((k,))[0]
            self.counts.updateValue((k,), (touched[k],))
        yield pd.DataFrame({"user_id": [key[0]] * len(touched), "event_type": list(touched), "n": list(touched.values())})

    def close(self) -> None:
        pass
