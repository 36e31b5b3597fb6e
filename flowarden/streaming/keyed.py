"""Alert episodes as keyed state: one open representative per type in the state store, closed by an event-time timer.

The other form (``packets.online_episodes``) folds every micro-batch with the distributed operator and is the one for a
type that holds most of the alerts. This one keeps no files of its own, emits an episode as soon as nothing can join it,
and suits many types: a task holds one type's alerts of one micro-batch.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from flowarden.operators.alerts import EPISODE_GAP
from flowarden.streaming.packets import lowest_per_instant

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OPEN = "micros long, score double, row binary"


class EpisodeState(StatefulProcessor):
    """The rule of ``alerts.episodes`` on alerts that come in the order of the watermark."""

    def __init__(self, columns: Sequence[str], gap_seconds: int, ts: str, score: str, tie: Sequence[str]):
        self.columns, self.gap, self.ts, self.score, self.tie = list(columns), max(gap_seconds * 1_000_000, 1), ts, score, list(tie)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", OPEN)

    def _due(self, micros: int) -> int:
        """The millisecond from which nothing can join a representative any more."""
        return (micros + self.gap) // 1000 + 1

    def _table(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=self.columns)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        given = pd.concat(list(rows)).sort_values([self.ts, self.score, *self.tie], kind="stable")
        held = self.open.get()
        best = None if held is None else (held[0], held[1], pickle.loads(held[2]))
        before, closed = best, []
        at, score = self.columns.index(self.ts), self.columns.index(self.score)
        for row in given[self.columns].itertuples(index=False, name=None):
            micros = int(pd.Timestamp(row[at]).value // 1000)
            if best is None or micros - best[0] > self.gap:
                if best is not None:
                    closed.append(best[2])
                best = (micros, row[score], row)
            elif row[score] < best[1]:
                best = (micros, row[score], row)
        if best is not before:
            if before is not None:
                self.handle.deleteTimer(self._due(before[0]))
            self.open.update((best[0], float(best[1]), pickle.dumps(best[2])))
            self.handle.registerTimer(self._due(best[0]))
        if closed:
            yield self._table(closed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.open.get()
        if held is not None and self._due(held[0]) <= expiredTimerInfo.getExpiryTimeInMs():
            self.open.clear()
            yield self._table([pickle.loads(held[2])])

    def close(self) -> None:
        pass


def keep_state_on_disk(spark: SparkSession) -> None:
    """Timers and keyed state need the disk-backed state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def keyed_episodes(alerts: DataFrame, gap_seconds: int = EPISODE_GAP, lateness: str = "1 minute", tie: Sequence[str] = ("src_ip",)) -> DataFrame:
    """Stream of closed episodes of an alert stream (type, timestamp, if_score, …), with the alerts' columns.

    Alerts without a type are one type; an alert without a score never replaces another. Needs ``keep_state_on_disk``.
    """
    lowest = lowest_per_instant(alerts, lateness, tie)
    processor = EpisodeState(alerts.columns, gap_seconds, "timestamp", "if_score", tie)
    return lowest.groupBy(F.col("type")).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=alerts.schema, outputMode="Append", timeMode="EventTime"
    )
