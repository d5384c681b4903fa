"""Stored tables of the monitor: snapshots, alert log and run log, all append-only parquet."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.snapshots import decode_history

SNAPSHOT_SCHEMA = (
    "table_name string, profiled_at timestamp, row_count bigint, profile_json string, "
    "schema_fingerprint string, source string"
)
HISTORY_SCHEMA = "table_name string, profiled_at timestamp, metric string, value double, source string"
ALERT_SCHEMA = "alert_key string, channel string, sent_at timestamp, severity string, summary string"
RUN_SCHEMA = (
    "run_at timestamp, elapsed_s double, status string, anomalies bigint, sources array<string>, errors array<string>"
)


class Store:
    """Paths of the stored tables under one base folder."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark = spark
        self.base = base.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.base}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            # nothing stored yet
            return self.spark.createDataFrame([], schema)

    def _put(self, df: DataFrame, name: str, *partitions: str) -> None:
        """Write the partitions of ``df``; those of a batch that is written again are replaced."""
        (
            df.write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(*partitions)
            .parquet(f"{self.base}/{name}")
        )

    def put_snapshots(self, snapshots: DataFrame, batch: str | None = None) -> None:
        """Add a batch of snapshots and its rows of the long history; writing a named batch again replaces both."""
        columns = [c.split()[0] for c in SNAPSHOT_SCHEMA.split(", ")]
        batch = batch or uuid.uuid4().hex
        self._put(snapshots.select(*columns).withColumn("batch", F.lit(batch)), "snapshots", "source", "batch")
        fresh = self.snapshots().filter(F.col("batch") == batch)
        self._put(decode_history(fresh).withColumn("batch", F.lit(batch)), "history", "source", "batch")

    def snapshots(self, sources: list[str] | None = None) -> DataFrame:
        """Stored snapshots; a source list prunes to the partitions of these sources."""
        df = self._read("snapshots", f"{SNAPSHOT_SCHEMA}, batch string")
        return df if sources is None else df.filter(F.col("source").isin(sources))

    def history(self, sources: list[str] | None = None) -> DataFrame:
        """The metric history of all stored snapshots, decoded when each was stored."""
        df = self._read("history", f"{HISTORY_SCHEMA}, batch string").drop("batch")
        return df if sources is None else df.filter(F.col("source").isin(sources))

    def put_alerts(self, alerts: DataFrame, batch: str | None = None) -> None:
        """Add sent alerts to the log, in folders by day; writing a named batch again replaces it."""
        columns = [c.split()[0] for c in ALERT_SCHEMA.split(", ")]
        rows = alerts.select(*columns).withColumn("sent_at", F.col("sent_at").cast("timestamp"))
        rows = rows.withColumn("sent_date", F.to_date("sent_at")).withColumn("batch", F.lit(batch or uuid.uuid4().hex))
        self._put(rows, "alert_log", "sent_date", "batch")

    def alerts(self, without_batch: str | None = None, since: dt.datetime | None = None) -> DataFrame:
        """The alert log, optionally as it was before a batch that is written again, or only from the day of ``since`` on."""
        df = self._read("alert_log", f"{ALERT_SCHEMA}, sent_date date, batch string")
        if without_batch is not None:
            df = df.filter(F.col("batch") != without_batch)
        if since is not None:
            df = df.filter(F.col("sent_date") >= F.to_date(F.lit(since)))
        return df.drop("sent_date")

    def append_run(self, *runs: tuple) -> None:
        self.spark.createDataFrame(list(runs), RUN_SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.base}/runs")

    def runs(self, n: int = 100) -> DataFrame:
        """The last ``n`` runs, newest first."""
        return self._read("runs", RUN_SCHEMA).orderBy(F.desc("run_at")).limit(n)
