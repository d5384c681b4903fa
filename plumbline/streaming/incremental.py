"""Incremental monitoring: every micro-batch of raw rows becomes snapshots and is analysed."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plumbline.operators.profile import profile_table
from plumbline.operators.snapshots import to_snapshots
from plumbline.plans.monitor import analyse
from plumbline.session import stored
from plumbline.sources.store import Store


def incremental_monitor(
    stream: DataFrame,
    store: Store,
    source: str,
    table_name: str,
    out: str,
    checkpoint: str,
    *,
    batch_time: Column | None = None,
    with_forest: bool = True,
    **trigger,
) -> StreamingQuery:
    """Start the loop; ``batch_time`` is an aggregate that dates a batch (default: now).

    A batch replayed after a failure replaces its own snapshots and alerts, so none counts twice.
    """
    spark = stream.sparkSession
    trigger = trigger or {"availableNow": True}

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch = stored(batch, "micro_batch")  # read several times below
        if batch.isEmpty():
            return
        now = dt.datetime.now(dt.timezone.utc)
        at = batch.agg(batch_time.alias("at")).first()["at"] if batch_time is not None else now
        snaps = to_snapshots(profile_table(batch, source, table_name, F.lit(at).cast("timestamp")))
        name = f"{table_name}-{batch_id}"
        store.put_snapshots(snaps, name)
        analyse(spark, store, f"{out}/batch={batch_id}", at, with_forest=with_forest, batch=name)

    return (
        stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(**trigger).start()
    )
