"""Anomaly report: merge the detectors, keep the worst finding per metric, add totals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.scalars import DASH, DETECTORS, plain_number, rank_of, severity_rank, table_key
from plumbline.operators.detect import iqr, zscore
from plumbline.operators.snapshots import SERIES


def merge_findings(*findings: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, findings)


def detect_all(history: DataFrame, with_forest: bool = True) -> DataFrame:
    """Findings of all detectors for the last snapshot of every table."""
    found = [zscore(history), iqr(history)]
    if with_forest:
        from plumbline.operators.iforest import isolation_forest

        found.append(isolation_forest(history))
    return merge_findings(*found)


def best_findings(findings: DataFrame) -> DataFrame:
    """Per (table, metric) the worst finding, on equal severity the earlier detector."""
    w = Window.partitionBy(*SERIES, "profiled_at", "metric").orderBy(
        F.desc(severity_rank(F.col("severity"))), rank_of(F.col("detector"), DETECTORS)
    )
    return findings.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def by_severity(findings: DataFrame) -> DataFrame:
    """Worst first; a total order for readers."""
    return findings.orderBy(F.desc(severity_rank(F.col("severity"))), *SERIES, "metric")


def top_findings(findings: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` worst findings of every table."""
    w = Window.partitionBy(*SERIES).orderBy(
        F.desc(severity_rank(F.col("severity"))), rank_of(F.col("detector"), DETECTORS), "metric"
    )
    return findings.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k)


def severity_counts() -> list[Column]:
    critical = F.count_if(F.col("severity") == "CRITICAL")
    high = F.count_if(F.col("severity") == "HIGH")
    total = F.count("severity")
    return [
        total.alias("total_anomalies"),
        critical.alias("critical"),
        high.alias("high"),
        (total - critical - high).alias("medium"),
    ]


def worst_severity() -> Column:
    return (
        F.when(F.col("critical") > 0, "CRITICAL")
        .when(F.col("high") > 0, "HIGH")
        .when(F.col("medium") > 0, "MEDIUM")
        .otherwise("CLEAN")
    )


def report_totals(findings: DataFrame) -> DataFrame:
    """One row: totals per severity and the overall status."""
    return findings.agg(*severity_counts()).withColumn("overall_status", worst_severity())


def report_tables(history: DataFrame, findings: DataFrame) -> DataFrame:
    """Every known table with its number of findings and status."""
    # one union instead of a join: known tables count zero, findings count one
    known = history.select(*SERIES).distinct().withColumn("hit", F.lit(0))
    hits = findings.select(*SERIES, F.lit(1).alias("hit"))
    return (
        known.unionByName(hits)
        .groupBy(*SERIES)
        .agg(F.sum("hit").alias("anomaly_count"))
        .withColumn("status", F.when(F.col("anomaly_count") > 0, "ANOMALOUS").otherwise("CLEAN"))
    )


def expected_text() -> Column:
    """The expected value or, for IQR findings, the fences as ``lower–upper``."""
    return F.coalesce(
        plain_number(F.col("expected")),
        F.concat(plain_number(F.col("lower_fence")), F.lit("–"), plain_number(F.col("upper_fence"))),
        F.lit(DASH),
    )


def flatten_findings(findings: DataFrame, run_at: Column, *extra: str) -> DataFrame:
    """Flat text rows for readers and exports; ``extra`` columns are carried along."""
    return findings.select(
        F.substring(run_at, 1, 19).alias("detected_at"),
        table_key(F.col("source"), F.col("table_name")).alias("table"),
        "severity",
        "metric",
        "detector",
        F.coalesce(plain_number(F.col("today")), F.lit(DASH)).alias("today"),
        expected_text().alias("expected"),
        F.coalesce(
            *[plain_number(F.col(c)) for c in ("z_score", "iqr_distance", "anomaly_score")], F.lit(DASH)
        ).alias("score"),
        *extra,
    )


def select_findings(
    findings: DataFrame,
    severities: list[str] | None = None,
    tables: list[str] | None = None,
    source: str | None = None,
) -> DataFrame:
    """Reader filter by severity set, table set and source."""
    if severities is not None:
        findings = findings.filter(F.col("severity").isin(severities))
    if tables is not None:
        findings = findings.filter(F.col("table_name").isin(tables))
    if source is not None:
        findings = findings.filter(F.col("source") == source)
    return findings


def counts_by(findings: DataFrame, *keys: str) -> DataFrame:
    return findings.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))

