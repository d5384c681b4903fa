"""Roll-ups for readers: heatmaps, chart series, run history and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.scalars import settle
from plumbline.operators.snapshots import SERIES

NULLS = "null_pct."


def _null_rates(history: DataFrame) -> DataFrame:
    name = F.regexp_replace("metric", "^null_pct\\.", "")
    return history.filter(F.col("metric").startswith(NULLS)).select(
        *SERIES,
        F.concat_ws(".", "table_name", name).alias("column"),
        "profiled_at",
        F.to_date("profiled_at").alias("date"),
        F.col("value").alias("null_pct"),
    )


def null_heatmap(history: DataFrame) -> DataFrame:
    """Mean null rate per (table.column, date), in long form."""
    return _null_rates(history).groupBy("source", "column", "date").agg(F.avg("null_pct").alias("null_pct"))


def null_heatmap_last(history: DataFrame) -> DataFrame:
    """Null rate of the day's last snapshot per (table.column, date)."""
    return (
        _null_rates(history)
        .groupBy("source", "column", "date")
        .agg(settle(F.max_by("null_pct", "profiled_at"), 2).alias("null_pct"))
    )


def heatmap_grid(heatmap: DataFrame, dates: list) -> DataFrame:
    """Heatmap with one column per date; the dates are given so that no extra job finds them."""
    return heatmap.groupBy("source", "column").pivot("date", dates).agg(F.first("null_pct"))


def worst_null_columns(heatmap: DataFrame, n: int = 15) -> DataFrame:
    """Columns with the highest mean null rate over all dates."""
    return (
        heatmap.groupBy("source", "column")
        .agg(settle(F.avg("null_pct"), 2).alias("avg_null_pct"))
        .orderBy(F.desc("avg_null_pct"), "source", "column")
        .limit(n)
    )


def chart_series(history: DataFrame) -> DataFrame:
    """Row counts and null rates per snapshot, long form.

    Null-rate lines exist for the columns of a table's first snapshot; later gaps count as 0.
    """
    first = history.groupBy(*SERIES).agg(F.min("profiled_at").alias("first_at"))
    kept = (
        history.join(first, SERIES)
        .filter((F.col("profiled_at") == F.col("first_at")) & F.col("metric").startswith(NULLS))
        .select(*SERIES, "metric")
    )
    runs = history.filter(F.col("metric") == "row_count").select(*SERIES, "profiled_at")
    lines = (
        runs.join(kept, SERIES)
        .join(history, [*SERIES, "profiled_at", "metric"], "left")
        .select(*SERIES, "profiled_at", "metric", F.coalesce("value", F.lit(0.0)).alias("value"))
    )
    counts = history.filter(F.col("metric") == "row_count").select(*SERIES, "profiled_at", "metric", "value")
    return counts.unionByName(lines).withColumn("date", F.to_date("profiled_at"))


def newest_runs(snapshots: DataFrame, runs: int = 50) -> DataFrame:
    """``run_at`` of the newest ``runs`` runs; a run is what was profiled within one minute."""
    minutes = snapshots.select(F.date_trunc("minute", "profiled_at").alias("run_at")).distinct()
    return minutes.orderBy(F.desc("run_at")).limit(runs)


def run_history(snapshots: DataFrame, runs: int = 50) -> DataFrame:
    """The newest ``runs`` runs, newest first: tables, distinct sources and rows of all their snapshots."""
    return (
        snapshots.groupBy(F.date_trunc("minute", "profiled_at").alias("run_at"))
        .agg(
            F.count(F.lit(1)).alias("table_count"),
            F.count_distinct("source").alias("source_count"),
            F.sum("row_count").alias("row_count"),
        )
        .orderBy(F.desc("run_at"))
        .limit(runs)
    )


def run_tables(snapshots: DataFrame, per_run: int = 20, runs: int = 50) -> DataFrame:
    """The first ``per_run`` tables of each of the newest ``runs`` runs, newest snapshot first."""
    tagged = snapshots.withColumn("run_at", F.date_trunc("minute", "profiled_at"))
    w = Window.partitionBy("run_at").orderBy(F.desc("profiled_at"), *SERIES)
    return (
        tagged.join(newest_runs(snapshots, runs), "run_at", "left_semi")
        .withColumn("rn", F.row_number().over(w))
        .filter(F.col("rn") <= per_run)
        .select("run_at", "rn", *SERIES, "row_count")
    )


def run_totals(snapshots: DataFrame, alerts: DataFrame) -> DataFrame:
    """One row: runs, tables profiled, distinct sources, alerts."""
    runs = snapshots.agg(
        F.count_distinct(F.date_trunc("minute", "profiled_at")).alias("runs"),
        F.count(F.lit(1)).alias("tables_profiled"),
        F.count_distinct("source").alias("sources"),
    )
    return runs.withColumn("alerts", alerts.agg(F.count(F.lit(1)).alias("n")).scalar())


def alerts_per_day(alert_log: DataFrame) -> DataFrame:
    return alert_log.groupBy(F.to_date("sent_at").alias("date")).agg(F.count(F.lit(1)).alias("alerts"))


def alert_totals(alert_log: DataFrame) -> DataFrame:
    return alert_log.agg(
        F.count(F.lit(1)).alias("alerts"),
        F.count_if(F.col("severity") == "CRITICAL").alias("critical_alerts"),
        F.count_distinct("channel").alias("channels"),
    )
