"""Table scores 0-100 from findings, null rates and failed rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.scalars import settle
from plumbline.operators.report import report_totals
from plumbline.operators.snapshots import SERIES, latest_values

# Penalty points and status bounds.
FINDING_POINTS = {"CRITICAL": 15, "HIGH": 8, "MEDIUM": 3}
RULE_POINTS = 10
NULL_POINTS = ((20.0, 5), (10.0, 2))
STATUS_BOUNDS = ((90, "HEALTHY"), (70, "WARNING"))
# Issue texts without and with rule penalties.
ISSUES_PLAIN = {"CRITICAL": "CRITICAL: %s", "nulls": "High nulls: %s=%.1f%%"}
ISSUES_WITH_RULES = {
    "CRITICAL": "CRITICAL anomaly: %s",
    "HIGH": "HIGH anomaly: %s",
    "nulls": "High nulls in %s: %.1f%%",
}


def status_of(score: Column) -> Column:
    (healthy, good), (warning, fair) = STATUS_BOUNDS
    return F.when(score >= healthy, good).when(score >= warning, fair).otherwise("CRITICAL")


def table_scores(
    history: DataFrame,
    findings: DataFrame,
    rule_summary: DataFrame | None = None,
) -> DataFrame:
    """``(source, table_name, score, status, issues)`` for every table of the history.

    Penalties of all kinds are long rows added up by one group-by. ``rule_summary``
    ``(source, table_name, failed)`` switches on the penalty for failed rules.
    """
    texts = ISSUES_PLAIN if rule_summary is None else ISSUES_WITH_RULES
    no_issue = F.lit(None).cast("string")

    def rows(df: DataFrame, points: Column, issue: Column) -> DataFrame:
        return df.select(*SERIES, points.cast("bigint").alias("points"), issue.alias("issue"))

    points = reduce(
        lambda rest, kv: F.when(F.col("severity") == kv[0], kv[1]).otherwise(rest), FINDING_POINTS.items(), F.lit(0)
    )
    issue = reduce(
        lambda rest, s: F.when(F.col("severity") == s, F.format_string(texts[s], "metric")).otherwise(rest),
        [s for s in FINDING_POINTS if s in texts],
        no_issue,
    )
    (many, many_points), (some, some_points) = NULL_POINTS
    rate = F.col("value")
    nulls = latest_values(history).filter(F.col("metric").startswith("null_pct.") & (rate > some))
    parts = [
        rows(history.select(*SERIES).distinct(), F.lit(0), no_issue),
        rows(findings, points, issue),
        rows(
            nulls,
            F.when(rate > many, many_points).otherwise(some_points),
            F.when(rate > many, F.format_string(texts["nulls"], "metric", "value")),
        ),
    ]
    if rule_summary is not None:
        # tables that were never profiled have no score, whatever rules say about them
        known = rule_summary.join(history.select(*SERIES).distinct(), SERIES, "left_semi")
        parts.append(rows(known, F.col("failed") * RULE_POINTS, no_issue))
    total = (
        reduce(DataFrame.unionByName, parts)
        .groupBy(*SERIES)
        .agg(F.sum("points").alias("lost"), F.array_sort(F.collect_list("issue")).alias("issues"))
    )
    score = F.greatest(F.lit(0), F.least(F.lit(100), F.lit(100) - F.col("lost"))).cast("int")
    return total.withColumn("score", score).select(
        *SERIES, "score", status_of(F.col("score")).alias("status"), "issues"
    )


def worst_first(scores: DataFrame) -> DataFrame:
    return scores.orderBy("score", *SERIES)


def summary(
    history: DataFrame, findings: DataFrame, scores: DataFrame, rule_results: DataFrame
) -> DataFrame:
    """One row for the overview: average score, finding totals, checks, snapshots, sources.

    The four totals are one row each; a union and a final aggregate bring them together.
    """
    columns = {
        "avg_dq_score": "double",
        "total_anomalies": "bigint",
        "critical": "bigint",
        "high": "bigint",
        "medium": "bigint",
        "overall_status": "string",
        "checks_passed": "bigint",
        "checks_failed": "bigint",
        "total_snapshots": "bigint",
        "source_count": "bigint",
    }

    def padded(df: DataFrame) -> DataFrame:
        return df.select(
            *[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in columns.items()]
        )

    parts = [
        scores.agg(F.coalesce(settle(F.avg("score"), 1), F.lit(0.0)).alias("avg_dq_score")),
        report_totals(findings),
        rule_results.agg(
            F.count_if("passed").alias("checks_passed"), F.count_if(~F.col("passed")).alias("checks_failed")
        ),
        history.filter(F.col("metric") == "row_count").agg(
            F.count(F.lit(1)).alias("total_snapshots"), F.count_distinct("source").alias("source_count")
        ),
    ]
    merged = reduce(DataFrame.unionByName, [padded(p) for p in parts])
    return merged.agg(*[F.max(c).alias(c) for c in columns])
