"""Notification policy per place: who gets interrupted, who sees a silent mark.

The highest level interrupts, the middle one is silent, the lowest is not notified. A
notification is held back while one that was sent for the same place is less than six
hours old, unless it is of a higher level than that one. The rule depends on what was
last sent, so it is a state machine over the events of a place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pluvia.operators.tiling import HOURS_PER_TILE, TILE, tile_of, with_previous

INTERRUPT, SILENT = 8, 7
HOLD_SECONDS = 6 * 3600
SENT_SCHEMA = "station long, ts_s long, id long, id_severidade int, canal string"


def decide(times, levels, last: tuple[int, int] | None):
    """Which events of one place, in time order, are sent; and the last one sent."""
    sent = []
    for ts, level in zip(times, levels):
        held = last is not None and ts - last[0] < HOLD_SECONDS and level <= last[1]
        sent.append(not held)
        if not held:
            last = (int(ts), int(level))
    return sent, last


def notifiable(events: DataFrame) -> DataFrame:
    """Events of the two levels that can notify, several of one moment reduced to the first."""
    kept = events.where(F.col("id_severidade") >= SILENT).select(
        F.col("station").cast("long"), F.col("ts_s").cast("long"), F.col("id").cast("long"),
        F.col("id_severidade").cast("int"),
    )
    best = F.min(F.struct((-F.col("id_severidade")).alias("s"), F.col("id").alias("id")))
    return kept.groupBy("station", "ts_s").agg(best.alias("_b")).select(
        "station", "ts_s", F.col("_b.id").alias("id"), (-F.col("_b.s")).cast("int").alias("id_severidade")
    )


def _channel(level) -> str:
    return "interrompe" if level >= INTERRUPT else "silencioso"


def notifications(events: DataFrame) -> DataFrame:
    """Notifications sent, from a table of events.

    A silence of six hours always ends a hold, so the stretches between such silences are
    independent: they are found with windows and run in parallel, also within one place.
    """
    width = HOURS_PER_TILE * 3600
    ordered = notifiable(events)
    gaps = with_previous(ordered, ["station"], "ts_s", "ts_s", "_prev", width).withColumn(
        "_open", F.coalesce(F.col("ts_s") - F.col("_prev") >= HOLD_SECONDS, F.lit(True))
    )
    opened = gaps.withColumn("_mark", F.when(F.col("_open"), F.col("ts_s")))
    stretches = with_stretch(opened, width)
    return (
        stretches.repartition("station", "_stretch")
        .sortWithinPartitions("station", "_stretch", "ts_s")
        .mapInPandas(_walk, SENT_SCHEMA)
    )


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Walk sorted events; the last one sent is forgotten where a new stretch begins."""
    stretch, last = None, None
    for pdf in batches:
        keep = []
        for row in zip(pdf["station"], pdf["_stretch"], pdf["ts_s"], pdf["id_severidade"]):
            if row[:2] != stretch:
                stretch, last = row[:2], None
            sent, last = decide([row[2]], [row[3]], last)
            keep += sent
        out = pdf[keep].assign(canal=[_channel(v) for v in pdf["id_severidade"][keep]])
        yield out[["station", "ts_s", "id", "id_severidade", "canal"]]


def with_stretch(opened: DataFrame, width: int) -> DataFrame:
    """Start second of the stretch each event belongs to."""
    inner = Window.partitionBy("station", TILE).orderBy("ts_s")
    upto = inner.rowsBetween(Window.unboundedPreceding, 0)
    local = opened.withColumn(TILE, tile_of(F.col("ts_s"), width)).withColumn(
        "_stretch", F.last("_mark", ignorenulls=True).over(upto)
    )
    past = Window.partitionBy("station").orderBy(TILE).rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        local.groupBy("station", TILE)
        .agg(F.max("_mark").alias("_m"))
        .select("station", TILE, F.last("_m", ignorenulls=True).over(past).alias("_carry"))
    )
    return (
        local.join(carried, ["station", TILE])
        .withColumn("_stretch", F.coalesce("_stretch", "_carry"))
        .select("station", "ts_s", "id", "id_severidade", "_stretch")
    )


class Notifier(StatefulProcessor):
    """Events of one place wait until the watermark has passed them; a timer judges all that it has passed, in order.

    State: the waiting events, one entry of lists for each batch of rows that came, and the last one sent, which is
    dropped when it cannot hold anything back any more. State is read and written once for a batch and a place, not
    once for an event, since every call goes through a socket. A timer stands at the earliest waiting event.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ts_s array<long>, id array<long>, nivel array<int>")
        self.last = handle.getValueState("last", "ts_s long, nivel int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            whole = pdf[["ts_s", "id", "id_severidade"]].astype("int64")  # fails on a missing value
            self._wait(_first_of_moments(*(whole[c] for c in whole)))
        yield from ()

    def _wait(self, events: np.ndarray) -> None:
        """Store events, if there are any, and be woken when the watermark reaches the first."""
        if len(events):
            self.waiting.appendValue(tuple(events[:, i].tolist() for i in range(3)))
            self.handle.registerTimer(int(events[0, 0]) * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() // 1000
        before = last = self.last.get()
        came = [np.array(entry, np.int64) for entry in self.waiting.get()]
        if came:
            events = _first_of_moments(*np.concatenate(came, axis=1))
            due = int(np.searchsorted(events[:, 0], now, "right"))
            sent, last = decide(events[:due, 0].tolist(), events[:due, 2].tolist(), last)
            self.waiting.clear()
            self._wait(events[due:])
            out = events[:due][np.array(sent, bool)]
            if len(out):
                yield pd.DataFrame(
                    {"station": key[0], "ts_s": out[:, 0], "id": out[:, 1], "id_severidade": out[:, 2],
                     "canal": [_channel(level) for level in out[:, 2]]}
                )
        if last is not None and now - last[0] >= HOLD_SECONDS:
            self.last.clear()
        elif last != before:
            self.last.update(last)
            self.handle.registerTimer((last[0] + HOLD_SECONDS) * 1000)

    def close(self) -> None:
        pass


def _first_of_moments(ts, ids, levels) -> np.ndarray:
    """Rows (second, id, level) in time order; of several of one second the one of highest level, then least id."""
    rows = np.stack([np.asarray(c, np.int64) for c in (ts, ids, levels)], axis=1)
    rows = rows[np.lexsort((rows[:, 1], -rows[:, 2], rows[:, 0]))]
    return rows[np.r_[True, rows[1:, 0] != rows[:-1, 0]]] if len(rows) else rows


def notification_stream(events: DataFrame, *, delay: str = "6 hours") -> DataFrame:
    """The same policy on a stream, by event time.

    An event is judged once the watermark, `delay` behind the newest event, has passed it, so events may arrive in
    any order within the delay; later ones are dropped, which `feeds.LateRows` counts. It needs the RocksDB state
    store: start it with `feeds.run_to_parquet(..., rocksdb=True)` or set `feeds.ROCKSDB`.
    """
    kept = events.where(F.col("id_severidade") >= SILENT).select(
        F.col("station").cast("long"), F.col("ts_s").cast("long"), F.col("id").cast("long"),
        F.col("id_severidade").cast("int"), F.timestamp_seconds("ts_s").alias("momento"),
    )
    return kept.withWatermark("momento", delay).groupBy("station").transformWithStateInPandas(
        Notifier(), SENT_SCHEMA, "Append", "EventTime"
    )


def sent_per_place_and_year(sent: DataFrame) -> DataFrame:
    """Notifications per place and year by channel."""
    year = F.year(F.timestamp_seconds("ts_s"))
    return sent.groupBy("station", year.alias("ano"), "canal").agg(F.count("*").alias("n"))


