"""Writers: full-refresh tables, views, JSON reports and CSV exports."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.scalars import table_key
from plumbline.operators.report import flatten_findings


def refresh_table(df: DataFrame, path: str) -> None:
    """Replace the stored table with ``df``."""
    df.write.mode("overwrite").parquet(path)


def as_views(models: Mapping[str, DataFrame]) -> None:
    for name, df in models.items():
        df.createOrReplaceTempView(name)


def save_tables(models: Mapping[str, DataFrame], fmt: str = "parquet") -> None:
    for name, df in models.items():
        df.write.format(fmt).mode("overwrite").saveAsTable(name)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object per row; arrays, maps and structs stay nested."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def scores_for_csv(scores: DataFrame) -> DataFrame:
    return scores.select(
        table_key(F.col("source"), F.col("table_name")).alias("Table"),
        F.col("score").alias("Score"),
        F.col("status").alias("Status"),
        F.concat_ws("; ", "issues").alias("Issues"),
    )


def findings_for_csv(findings: DataFrame, run_at: Column) -> DataFrame:
    """Explained findings as the nine export columns."""
    titles = {
        "detected_at": "Detected At",
        "table": "Table",
        "severity": "Severity",
        "metric": "Metric",
        "detector": "Detector",
        "today": "Today",
        "expected": "Expected",
        "score": "Score",
        "explanation": "Explanation",
    }
    flat = flatten_findings(findings, run_at, "explanation")
    return flat.select(*[F.col(c).alias(t) for c, t in titles.items()])
