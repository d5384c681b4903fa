"""Alert suppression on a stream with keyed state."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from plumbline.operators.alerts import KEY, WINDOW_MINUTES, not_recently_sent, suppress
from plumbline.session import stored
from plumbline.sources.store import Store

OUTPUT = "alert_key string, channel string, sent_at timestamp, severity string, summary string"
COLUMNS = [*KEY, "sent_at", "severity", "summary"]
KEY_GROUPS = 4096  # a trigger calls Python once for each group of keys, not once for each key
SENT = "alert_keys array<string>, channels array<string>, last_us array<bigint>"


def _keep_first(window_us: int):
    def keep(group, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        # only this trigger's alerts of one group of keys; the source's rate limit bounds them
        pdf = pd.concat(list(batches), ignore_index=True)
        keys = list(zip(*(pdf[c].astype(object).where(pdf[c].notna(), None) for c in KEY)))
        us = pdf["sent_at"].to_numpy().astype("datetime64[us]").astype("int64")
        order = np.lexsort((pdf["summary"].to_numpy(str), pdf["severity"].to_numpy(str), us))
        last = {(k, c): at for k, c, at in zip(*state.get)} if state.exists else {}
        sent = []
        for i, at in zip(order.tolist(), us[order].tolist()):
            before = last.get(keys[i])
            if before is None or at >= before + window_us:
                sent.append(i)
                last[keys[i]] = at
        # a key is forgotten once the watermark says that nothing can fall into its window any more
        now, seen = state.getCurrentWatermarkMs(), set(keys)
        last = {k: at for k, at in last.items() if k in seen or at + window_us > now * 1000}
        names, channels = zip(*last)
        state.update((list(names), list(channels), list(last.values())))
        state.setTimeoutTimestamp(max((max(last.values()) + window_us) // 1000, now) + 1)
        if sent:
            yield pdf.take(sent)[COLUMNS]

    return keep


def suppress_stream(alerts: DataFrame, minutes: int = WINDOW_MINUTES, delay: str = "1 hour", buckets: int = KEY_GROUPS) -> DataFrame:
    """Alerts that are sent. State holds one time per key and channel, until the watermark has passed its window.

    Alerts are judged in arrival order between triggers and in time order within one; those more than ``delay`` behind the
    newest are too late. Keys share a state in ``buckets`` groups: more groups mean less state and fewer alerts in one call.
    """
    return (
        alerts.select(*KEY, F.col("sent_at").cast("timestamp").alias("sent_at"), "severity", "summary")
        .withWatermark("sent_at", delay)
        .withColumn("bucket", F.pmod(F.xxhash64(*KEY), F.lit(buckets)).cast("int"))
        .groupBy("bucket")
        .applyInPandasWithState(_keep_first(minutes * 60_000_000), OUTPUT, SENT, "append", GroupStateTimeout.EventTimeTimeout)
    )


ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BUCKETS = 64  # groups of keys that share a state, so that a trigger calls Python once for each and not once for each key


class TimeOrdered(StatefulProcessor):
    """Alerts wait in a list until the watermark has passed them and are then decided in time order, key by key."""

    def __init__(self, window_us: int):
        self.window_us = window_us

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "sent_us long, alert_key string, channel string, severity string, summary string")
        self.sent = handle.getListState("sent", "alert_key string, channel string, last_us long")
        self.wake = handle.getValueState("wake", "at_ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        earliest = []
        for pdf in rows:
            us = pdf["sent_at"].to_numpy().astype("datetime64[us]").astype("int64")
            columns = (pdf[c].astype(object).where(pdf[c].notna(), None) for c in ("alert_key", "channel", "severity", "summary"))
            self.waiting.appendList(list(zip(us.tolist(), *columns)))
            earliest.append(int(us.min()))
        self._wake_by(min(earliest))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        self.wake.clear()
        rows = sorted(self.waiting.get(), key=lambda r: (r[0], r[3] or "", r[4] or ""))
        n = sum(r[0] < passed for r in rows)
        last = {(r[0], r[1]): r[2] for r in self.sent.get()}
        chosen = []
        for row in rows[:n]:
            before = last.get((row[1], row[2]))
            if before is None or row[0] >= before + self.window_us:
                chosen.append(row)
                last[row[1], row[2]] = row[0]
        # a key is forgotten when nothing that can still come falls into its window
        last = {k: us for k, us in last.items() if us + self.window_us > passed}
        if n:
            self.waiting.put(rows[n:]) if n < len(rows) else self.waiting.clear()
        self.sent.put([(*k, us) for k, us in last.items()]) if last else self.sent.clear()
        if n < len(rows):
            self._wake_by(rows[n][0])
        elif last:
            self._wake_by(max(last.values()) + self.window_us)
        if chosen:
            us, alert_key, channel, severity, summary = zip(*chosen)
            at = pd.Series(np.array(us, "datetime64[us]"))
            yield pd.DataFrame({"alert_key": alert_key, "channel": channel, "sent_at": at, "severity": severity, "summary": summary})
        else:
            yield pd.DataFrame()

    def _wake_by(self, us: int) -> None:
        """One timer at most: at the earliest time that was asked for."""
        at = us // 1000 + 1
        if self.wake.exists():
            before = self.wake.get()[0]
            if before <= at:
                return
            self.handle.deleteTimer(before)
        self.handle.registerTimer(at)
        self.wake.update((at,))

    def close(self) -> None:
        pass


def suppress_in_time_order(alerts: DataFrame, minutes: int = WINDOW_MINUTES, delay: str = "1 hour", buckets: int = BUCKETS) -> DataFrame:
    """Alerts that are sent, decided in the order of their times however they arrive between triggers.

    An alert is decided once the watermark, ``delay`` behind the newest one, has passed it; what arrives later than that is left out. State
    holds the undecided alerts and the time of every key's last one until that window is over, in ``buckets`` groups of keys:
    more groups mean less state in one call. The session needs the state store ROCKS_DB
    (``spark.sql.streaming.stateStore.providerClass``). Null keys are keys.
    """
    return (
        alerts.select(*KEY, F.col("sent_at").cast("timestamp").alias("sent_at"), "severity", "summary")
        .withWatermark("sent_at", delay)
        .withColumn("bucket", F.pmod(F.xxhash64(*KEY), F.lit(buckets)).cast("int"))
        .groupBy("bucket")
        .transformWithStateInPandas(TimeOrdered(minutes * 60_000_000), OUTPUT, "append", "eventTime")
    )


def suppress_to_log(
    alerts: DataFrame, store: Store, checkpoint: str, minutes: int = WINDOW_MINUTES, **trigger
) -> StreamingQuery:
    """Exact suppression without Python state: the alert log is the state.

    Every batch drops what the log still covers, suppresses the rest with the batch operator
    (which splits hot keys over time blocks) and adds what is sent to the log.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        name, batch = f"stream-{batch_id}", stored(batch, "micro_batch")
        first = batch.agg(F.min(F.col("sent_at").cast("timestamp"))).first()[0]
        if first is None:
            return
        # of the log only the days that can still matter
        log = store.alerts(without_batch=name, since=first - dt.timedelta(minutes=minutes))
        fresh = not_recently_sent(batch, log, minutes)
        store.put_alerts(suppress(fresh, minutes), name)

    trigger = trigger or {"availableNow": True}
    columns = alerts.select(*KEY, "sent_at", "severity", "summary")
    return columns.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def suppress_approx(alerts: DataFrame, minutes: int = WINDOW_MINUTES) -> DataFrame:
    """Built-in variant without Python: the first alert per key, then nothing for about a window.

    Its window may be extended by the watermark, so it can drop more than the exact form.
    """
    return (
        alerts.withColumn("sent_at", F.col("sent_at").cast("timestamp"))
        .withWatermark("sent_at", f"{minutes} minutes")
        .dropDuplicatesWithinWatermark(KEY)
    )
