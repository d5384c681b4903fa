"""Findings of all three detectors in one report: scores, explanations, alerts and exports built on them.

The forest's scores have no SQL form; ``tests/test_merged.py`` compares these queries with a plain merge of the detectors' rows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import alerts as A
from plumbline.operators import annotate as N
from plumbline.operators import report as P
from plumbline.operators import score as C
from plumbline.session import shared_dir, stored
from plumbline.sources import sinks
from workload.anomalies import RUN_AT, SHOWN
from workload.inputs import feed_history, lines_history

KEPT = ["source", "table_name", "profiled_at", "metric", "value"]


def history_of(spark, sf_dir):
    """Daily metrics of the event feed and of the order lines in one history."""
    feed, lines = (h.select(*KEPT).withColumn("profiled_at", F.col("profiled_at").cast("timestamp_ntz")) for h in (feed_history(spark, sf_dir), lines_history(spark, sf_dir)))
    return stored(feed.unionByName(lines), "merged_history")


def merged(history):
    """Worst finding of each metric over z-score, IQR and isolation forest; computed once for all its readers."""
    return stored(P.best_findings(P.detect_all(history)), "merged_findings")


def merged_findings(spark, sf_dir):
    shown = F.transform("top_contributors", lambda c: F.concat_ws("=", c["metric"], c["z_score"].cast("string")))
    rows = merged(history_of(spark, sf_dir))
    return rows.select(*SHOWN, "anomaly_score", F.concat_ws("; ", shown).alias("contributors"))


def merged_report(spark, sf_dir):
    history = history_of(spark, sf_dir)
    return P.report_tables(history, merged(history))


def merged_totals(spark, sf_dir):
    return P.report_totals(merged(history_of(spark, sf_dir)))


def merged_scores(spark, sf_dir):
    history = history_of(spark, sf_dir)
    scores = C.table_scores(history, merged(history))
    return scores.select("source", "table_name", "score", "status", F.concat_ws("; ", "issues").alias("issues"))


def merged_explained(spark, sf_dir):
    findings = merged(history_of(spark, sf_dir))
    causes = N.root_cause(findings).select("source", "table_name", "metric", F.concat_ws(" | ", "causes").alias("causes"), "how_to_fix")
    told = N.explain(findings).select("source", "table_name", "metric", "detector", "explanation")
    return told.join(causes, ["source", "table_name", "metric"])


def merged_alerts(spark, sf_dir):
    alerts = A.to_alerts(A.route(merged(history_of(spark, sf_dir))), "slack", F.lit(RUN_AT).cast("timestamp_ntz"))
    return alerts.select("alert_key", "channel", "severity", "summary")


def merged_csv(spark, sf_dir):
    """The findings as a CSV export and back."""
    path = shared_dir(spark, "merged_csv")
    sinks.write_csv(sinks.findings_for_csv(N.explain(merged(history_of(spark, sf_dir))), F.lit(RUN_AT)), path)
    return spark.read.option("header", True).csv(path)


QUERIES = {
    "merged_findings": merged_findings,
    "merged_report": merged_report,
    "merged_totals": merged_totals,
    "merged_scores": merged_scores,
    "merged_explained": merged_explained,
    "merged_alerts": merged_alerts,
    "merged_csv": merged_csv,
}
ORACLE: dict[str, str] = {}
