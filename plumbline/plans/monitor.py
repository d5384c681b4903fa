"""The scheduled run: profile, store, cross-check, detect, alert, export, log."""

from __future__ import annotations

import datetime as dt
import time
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import alerts as A
from plumbline.operators import crosscheck as X
from plumbline.operators.annotate import explain
from plumbline.operators.profile import profile_table
from plumbline.operators.report import best_findings, detect_all, flatten_findings, report_tables, report_totals
from plumbline.operators.rollups import chart_series, null_heatmap_last, run_history, run_tables
from plumbline.operators.rules import Rule, evaluate
from plumbline.operators.schema import declared_schema, fingerprint, stored_drift
from plumbline.operators.score import summary, table_scores
from plumbline.operators.snapshots import to_snapshots
from plumbline.session import stored
from plumbline.sources.sinks import findings_for_csv, scores_for_csv, write_csv, write_json
from plumbline.sources.specs import Source, scan_sources
from plumbline.sources.store import Store

TABLES_PER_JOB = 20
ALERT_COLUMNS = ["alert_key", "channel", "sent_at", "severity", "summary"]


@dataclass
class RunResult:
    status: str
    anomalies: int
    errors: list


def take_snapshots(spark: SparkSession, tables: Sequence[tuple[str, str, DataFrame]], at: dt.datetime) -> DataFrame:
    """Snapshot rows of several tables as one plan: their profiles run in a single job."""
    when = F.lit(at)
    profiles = reduce(DataFrame.unionByName, [profile_table(df, s, t, when) for s, t, df in tables])
    schemas = reduce(DataFrame.unionByName, [declared_schema(spark, df, s, t) for s, t, df in tables])
    return to_snapshots(profiles, fingerprint(schemas))


def store_snapshots(
    spark: SparkSession,
    tables: Sequence[tuple[str, str, DataFrame]],
    store: Store,
    at: dt.datetime,
    tables_per_job: int = TABLES_PER_JOB,
) -> list[str]:
    """Profile and store all tables, several per job; returns what went wrong.

    When a job fails its tables are tried one by one, so that a table that cannot be read does
    not take others with it. Batches have names, a retry replaces what was written.
    """
    errors = []
    for i in range(0, len(tables), tables_per_job):
        group = tables[i : i + tables_per_job]
        try:
            store.put_snapshots(take_snapshots(spark, group, at), f"{at:%Y%m%dT%H%M%S%f}-{i}")
        except Exception:  # any failure of the job; the single tables tell which one it was
            for j, (source, name, df) in enumerate(group):
                try:
                    store.put_snapshots(take_snapshots(spark, [(source, name, df)], at), f"{at:%Y%m%dT%H%M%S%f}-{i}-{j}")
                except Exception as e:
                    errors.append(f"{source}.{name}: {str(e).splitlines()[0]}")
    return errors


def cross_checks(snapshots: DataFrame, history: DataFrame) -> DataFrame:
    return reduce(
        DataFrame.unionByName,
        [
            X.row_count_consistency(snapshots),
            X.null_rate_consistency(history),
            X.volume_divergence(snapshots),
            X.missing_tables(snapshots),
        ],
    )


def run_suites(tables: Sequence[tuple[str, str, DataFrame]], suites: Mapping[tuple[str, str], Sequence[Rule]]) -> DataFrame | None:
    """Results of the suites of the tables that have one, with source and table."""
    parts = [
        evaluate(df, f"{s}.{t}", t, suites[s, t]).withColumn("source", F.lit(s)) for s, t, df in tables if suites.get((s, t))
    ]
    return reduce(DataFrame.unionByName, parts) if parts else None


def analyse(
    spark: SparkSession,
    store: Store,
    out: str,
    at: dt.datetime,
    channel: str = "scheduler",
    with_forest: bool = True,
    batch: str | None = None,
    rules: DataFrame | None = None,
) -> tuple[str, int]:
    """Everything after the profiles: reports and exports below ``out``, alerts into the store.

    ``rules`` are results of ``run_suites``: failed ones cost points, and the report has alerts of its own.
    """
    snapshots = store.snapshots()
    history = store.history()
    # findings feed six outputs; they are one row per flagged series, written once and read back
    path = f"{out}/findings"
    explain(best_findings(detect_all(history, with_forest))).write.mode("overwrite").parquet(path)
    findings = spark.read.parquet(path)
    write_json(cross_checks(snapshots, history), f"{out}/cross_report")
    write_json(report_tables(history, findings), f"{out}/report_tables")
    write_json(report_totals(findings), f"{out}/report_totals")
    failed = None
    if rules is not None:
        rules = stored(rules, "rule_results")
        failed = rules.groupBy("source", "table_name").agg(F.count_if(~F.col("passed")).alias("failed"))
        write_json(rules, f"{out}/rules")
    scores = table_scores(history, findings, failed)
    checks = rules if rules is not None else spark.createDataFrame([], "passed boolean")
    write_json(summary(history, findings, scores, checks), f"{out}/summary")
    write_json(flatten_findings(findings, F.lit(at.isoformat()), "explanation"), f"{out}/findings_flat")
    write_json(stored_drift(snapshots), f"{out}/drift")
    write_json(scores, f"{out}/scores")
    write_csv(scores_for_csv(scores), f"{out}/scores_csv")
    write_csv(findings_for_csv(findings, F.lit(at.isoformat())), f"{out}/findings_csv")
    write_json(null_heatmap_last(history), f"{out}/null_heatmap")
    write_json(chart_series(history), f"{out}/charts")
    write_json(run_history(snapshots), f"{out}/run_history")
    write_json(run_tables(snapshots), f"{out}/run_tables")

    candidates = A.to_alerts(A.route(findings), channel, F.lit(at))
    since = at - dt.timedelta(minutes=A.WINDOW_MINUTES)
    recent = store.alerts(without_batch=batch, since=since).filter(F.col("sent_at") > F.lit(since))
    sent = A.first_per_table(A.not_recently_sent(candidates, recent)).select(*ALERT_COLUMNS)
    if rules is not None:
        sent = sent.unionByName(A.not_recently_sent(A.report_alerts(findings, rules, channel, F.lit(at)), recent).select(*ALERT_COLUMNS))
    store.put_alerts(sent, batch)
    write_json(A.newest_alerts(store.alerts()), f"{out}/alert_history")
    totals = report_totals(findings).first()
    return totals["overall_status"], totals["total_anomalies"]


def run(
    spark: SparkSession,
    sources: Sequence[Source],
    store: Store,
    out: str,
    at: dt.datetime | None = None,
    with_forest: bool = True,
    suites: Mapping[tuple[str, str], Sequence[Rule]] | None = None,
) -> RunResult:
    """One monitoring run over all tables of all sources; ``suites`` are rules by (source, table)."""
    started = time.time()
    at = at or dt.datetime.now(dt.timezone.utc)
    scan = scan_sources(spark, sources)
    errors = [f"{s}.{t or '*'}: {e}" for s, t, e in scan.errors]
    status, anomalies = "ERROR", 0
    try:
        if scan.tables:
            errors += store_snapshots(spark, scan.tables, store, at)
            rules = run_suites(scan.tables, suites or {})
            status, anomalies = analyse(spark, store, out, at, with_forest=with_forest, rules=rules)
    finally:
        store.append_run(
            (at, round(time.time() - started, 1), status, anomalies, [s.name for s in sources], errors)
        )
    return RunResult(status, anomalies, errors)
