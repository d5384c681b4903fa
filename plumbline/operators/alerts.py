"""Alert routing, keys and suppression of repeats.

Suppression is a recurrence: an alert is sent when the last *sent* alert of its key and
channel is at least one window old. Alerts are range-partitioned by key and time into blocks of rows, so a
key with many alerts goes over several blocks. Such a block states how it maps "next alert
allowed from" on entry to the same on exit; these step lists are composed in levels of FAN blocks, entries
are handed down again, and every block then marks what it sends. The raw alerts are read once.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.scalars import DETECTORS, alert_key, rank_of, severity_rank, table_key
from plumbline.operators.report import report_totals
from plumbline.operators.snapshots import SERIES
from plumbline.session import stored

WINDOW_MINUTES = 60
DEFAULT_ROUTES = ("CRITICAL", "HIGH")
KEY = ["alert_key", "channel"]
BLOCK_ROWS = 50_000  # a task's Python holds one block
FAN = 32  # blocks whose step lists meet in one task
FIRST = np.iinfo(np.int64).min  # nothing sent yet
GroupKey = tuple[pa.Scalar, ...]


def route(findings: DataFrame, severities: Sequence[str] = DEFAULT_ROUTES) -> DataFrame:
    """Findings whose severity is switched on."""
    return findings.filter(F.col("severity").isin(list(severities)))


def to_alerts(findings: DataFrame, channel: str, sent_at: Column) -> DataFrame:
    """Alert rows ``(alert_key, channel, sent_at, severity, summary)`` plus the finding's identity."""
    table = table_key(F.col("source"), F.col("table_name"))
    return findings.select(
        alert_key(table, F.col("metric"), F.col("severity")).alias("alert_key"),
        F.lit(channel).alias("channel"),
        sent_at.alias("sent_at"),
        "severity",
        F.concat(F.col("metric"), F.lit(" in "), table).alias("summary"),
        *SERIES,
        "metric",
        "detector",
    )


def report_alerts(
    findings: DataFrame,
    rule_results: DataFrame,
    channel: str,
    sent_at: Column,
    severities: Sequence[str] = DEFAULT_ROUTES,
) -> DataFrame:
    """At most two alerts per run: the anomaly report's status and, as HIGH, failed rules."""
    anomalies = report_totals(findings).select(
        F.lit("anomaly").alias("kind"),
        F.col("overall_status").alias("severity"),
        F.col("total_anomalies").alias("n"),
    )
    rules = rule_results.agg(F.count_if(~F.col("passed")).alias("n")).select(
        F.lit("rules").alias("kind"), F.when(F.col("n") > 0, "HIGH").otherwise("CLEAN").alias("severity"), "n"
    )
    rows = anomalies.unionByName(rules).filter(F.col("severity").isin(list(severities)))
    return rows.select(
        alert_key(F.lit("all"), F.col("kind"), F.col("severity")).alias("alert_key"),
        F.lit(channel).alias("channel"),
        sent_at.alias("sent_at"),
        "severity",
        F.concat(
            F.col("n").cast("string"),
            F.when(F.col("kind") == "anomaly", " anomalies, status ").otherwise(" failed rules, status "),
            F.col("severity"),
        ).alias("summary"),
    )


def not_recently_sent(alerts: DataFrame, log: DataFrame, minutes: int = WINDOW_MINUTES) -> DataFrame:
    """Drop alerts whose key and channel were sent less than ``minutes`` before."""
    last = log.groupBy(*KEY).agg(F.max("sent_at").alias("_last"))
    young = F.unix_micros(F.col("sent_at").cast("timestamp")) < F.unix_micros(
        F.col("_last").cast("timestamp")
    ) + F.lit(minutes * 60_000_000)
    return (
        alerts.join(last, KEY, "left").filter(~F.coalesce(young, F.lit(False))).drop("_last")
    )


def first_per_table(alerts: DataFrame) -> DataFrame:
    """The worst remaining alert of every table."""
    w = Window.partitionBy(*SERIES).orderBy(
        F.desc(severity_rank(F.col("severity"))), rank_of(F.col("detector"), DETECTORS), "metric"
    )
    return alerts.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


# -- suppression -----------------------------------------------------------------------------


def _hops(us: np.ndarray, window: int) -> np.ndarray:
    """For every alert the index of the next one allowed if this one is sent."""
    return np.searchsorted(us, us + window, side="left")


def _steps(us: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Step list of sorted instants: an entry up to ``at`` leaves them as ``leaves``; a later one goes through."""
    n = len(us)
    # jump pointers doubled until every chain has left the block
    hop = np.append(_hops(us, window), n).astype(np.int64)
    last, jump = np.arange(n + 1), hop.copy()
    while (jump[:n] < n).any():
        last = np.where(jump < n, last[jump], last)
        jump = jump[jump]
    return _shortened(us, us[last[:n]] + window, window)


def _shortened(at: np.ndarray, leaves: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Without steps that change nothing. Entries lie before the first instant and one window, so one step past it suffices."""
    m = min(int(np.searchsorted(at, at[0] + window, side="left")) + 1, len(at))
    keep = np.append(leaves[1:m] != leaves[: m - 1], True)
    return at[:m][keep], leaves[:m][keep]


def _through(at: np.ndarray, leaves: np.ndarray, entry: np.ndarray) -> np.ndarray:
    place = np.searchsorted(at, entry, side="left")
    return np.where(place < len(at), leaves[np.minimum(place, len(at) - 1)], entry)


def _blocks(table: pa.Table) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(block, at, leaves) of a key in time order."""
    block, at = table.column("block").to_numpy(), table.column("at").to_numpy()
    order = np.lexsort((at, block))
    block, at, leaves = block[order], at[order], table.column("leaves").to_numpy()[order]
    first = np.flatnonzero(np.append(True, block[1:] != block[:-1])) if len(block) else []
    return [(int(block[i]), at[i:j], leaves[i:j]) for i, j in zip(first, [*first[1:], len(block)])]


def _composed(window: int):
    """The step lists of up to FAN neighbouring blocks of a key as one."""

    def compose(key: GroupKey, table: pa.Table) -> pa.Table:
        (_, at, leaves), *rest = _blocks(table)
        for _, next_at, next_leaves in rest:
            later = next_at > at[-1]
            leaves = np.append(_through(next_at, next_leaves, leaves), next_leaves[later])
            at, leaves = _shortened(np.append(at, next_at[later]), leaves, window)
        n = len(at)
        return pa.table([pa.array([key[0].as_py()] * n, pa.string()), pa.array([key[1].as_py()] * n, pa.int64()), at, leaves], names=["key", "block", "at", "leaves"])

    return compose


def _entries(key: GroupKey, steps: pa.Table, entry: pa.Table) -> pa.Table:
    """What each of up to FAN neighbouring blocks of a key starts with."""
    allowed, out = np.array([entry.column("allowed")[0].as_py()]), []
    for block, at, leaves in _blocks(steps):
        out.append((block, int(allowed[0])))
        allowed = _through(at, leaves, allowed)
    blocks, entries = zip(*out)
    return pa.table([pa.array([key[0].as_py()] * len(out), pa.string()), pa.array(blocks, pa.int64()), pa.array(entries, pa.int64())], names=["key", "block", "allowed"])


def _runs(table: pa.Table) -> tuple[pa.Table, list[tuple[int, int]]]:
    """A block sorted by key and time, and where its keys begin and end."""
    table = table.combine_chunks().sort_by([("key", "ascending"), ("us", "ascending")])
    keys = table.column("key").combine_chunks()
    changed = np.flatnonzero(pa.compute.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)) + 1 if len(keys) > 1 else np.zeros(0, int)
    edges = [0, *changed.tolist(), len(keys)]
    return table, list(zip(edges[:-1], edges[1:]))


def _edge_steps(window: int):
    """Step lists of the first and the last key of a block: only these can go on in another block."""

    def steps(key: GroupKey, table: pa.Table) -> pa.Table:
        table, runs = _runs(table)
        names, us = table.column("key"), table.column("us").to_numpy()
        parts = []
        for i, j in {runs[0], runs[-1]}:
            at, leaves = _steps(us[i:j], window)
            parts.append(pa.table([pa.array([names[i].as_py()] * len(at), pa.string()), pa.array([key[0].as_py()] * len(at), pa.int64()), at, leaves],
                                  names=["key", "block", "at", "leaves"]))
        return pa.concat_tables(parts)

    return steps


def _mark_sent(window: int, names: list[str]):
    def mark(key: GroupKey, rows: pa.Table, entries: pa.Table) -> pa.Table:
        rows, runs = _runs(rows)
        allowed = dict(zip(entries.column("key").to_pylist(), entries.column("allowed").to_pylist()))
        us, sent = rows.column("us").to_numpy(), []
        keys = rows.column("key")
        for i, j in runs:
            at = i + int(np.searchsorted(us[i:j], allowed.get(keys[i].as_py(), FIRST), side="left"))
            while at < j:
                sent.append(at)
                at += int(np.searchsorted(us[at:j], us[at] + window, side="left"))
        return rows.take(pa.array(sent, pa.int64())).select(names)

    return mark


def _block_count(instants: DataFrame) -> int:
    """So many that a block has about BLOCK_ROWS rows, or fewer if that keeps all cores busy."""
    n = instants.count()
    share = n // instants.sparkSession.sparkContext.defaultParallelism
    return max(1, -(-n // min(BLOCK_ROWS, max(BLOCK_ROWS // 5, share))))


def suppress(alerts: DataFrame, minutes: int = WINDOW_MINUTES, *, blocks: int | None = None, fan: int = FAN) -> DataFrame:
    """Alerts that are sent; repeats of a key and channel within ``minutes`` are dropped.

    A repeat after exactly ``minutes`` is sent. Of several alerts of a key at one instant the
    smallest row is sent. Null keys and channels are keys like others, alerts without a time are never sent.
    """
    window = minutes * 60_000_000
    names = alerts.columns
    rest = [c for c in names if c not in (*KEY, "sent_at")]
    # one row per key and instant; duplicates meet in the partial aggregate. A null has no field in the JSON, so the text is never null
    instants = stored(
        alerts.filter(F.col("sent_at").isNotNull())
        .groupBy(*KEY, "sent_at")
        .agg(F.min(F.struct(*rest)).alias("_row"))
        .select(F.to_json(F.struct(*KEY)).alias("key"), F.unix_micros(F.col("sent_at").cast("timestamp")).alias("us"), *KEY, "sent_at", "_row"),
        "alert_instants",
    )
    # counted, because partitions merged by their bytes would make blocks that grow with the input
    ranged = instants.repartitionByRange(blocks or _block_count(instants), "key", "us")
    rows = stored(ranged.withColumn("block", F.spark_partition_id().cast("long")), "alert_blocks")
    times = rows.select("key", "us", "block")

    steps_type = "key string, block long, at long, leaves long"
    levels = [times.groupBy("block").applyInArrow(_edge_steps(window), steps_type)]
    # keys within one block need no chain
    several = levels[0].groupBy("key").agg(F.min("block").alias("low"), F.max("block").alias("high")).filter("low < high").select("key")
    levels = [stored(levels[0].join(several, "key", "left_semi"), "alert_steps")]
    width = levels[0].agg(F.max("block")).first()[0] or 0
    parent = F.expr(f"block div {fan}").alias("block")
    while width:
        width //= fan
        above = levels[-1].groupBy("key", parent.alias("parent")).applyInArrow(_composed(window), steps_type)
        levels.append(stored(above, "alert_steps"))
    entries = levels[-1].select("key", "block").distinct().withColumn("allowed", F.lit(FIRST))
    for level in reversed(levels[:-1]):
        entries = (
            level.groupBy("key", F.expr(f"block div {fan}").alias("parent"))
            .cogroup(entries.groupBy("key", "block"))
            .applyInArrow(_entries, "key string, block long, allowed long")
        )
    marked = (
        rows.groupBy("block")
        .cogroup(entries.groupBy("block"))
        .applyInArrow(_mark_sent(window, [*KEY, "sent_at", "_row"]), rows.select(*KEY, "sent_at", "_row").schema)
    )
    return marked.select(*KEY, "sent_at", "_row.*").select(*names)


def newest_alerts(log: DataFrame, n: int = 50) -> DataFrame:
    """Newest ``n`` log rows."""
    return log.orderBy(F.desc("sent_at"), "channel", "alert_key").limit(n)
