"""Snapshots, cross-source checks, scores and roll-ups."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.operators import crosscheck as X
from plumbline.operators import report as P
from plumbline.operators import rollups as R
from plumbline.operators import score as C
from plumbline.operators import snapshots as S
from plumbline.operators.rules import summarize
from plumbline.session import stored
from workload.anomalies import event_alerts
from workload.inputs import (
    DETECT_CTES,
    FEED_CTES,
    LATEST_CTE,
    LINES_CTES,
    SHOP_CTES,
    SNAPS_CTE,
    ctes,
    feed_history,
    lines_history,
    settle,
    stored_feed_history,
    stored_lines_history,
    table,
)
from workload.quality import RULES_CTE, all_suites


def _feed_and_findings(spark, sf_dir):
    history = stored_feed_history(spark, sf_dir)
    return history, P.best_findings(P.detect_all(history, with_forest=False))


def _line_snapshots(spark, sf_dir):
    return S.row_counts(lines_history(spark, sf_dir))


# -- snapshots --------------------------------------------------------------------------------------


def latest_snapshot(spark, sf_dir):
    return S.latest_snapshot(_line_snapshots(spark, sf_dir))


def recent_history(spark, sf_dir):
    return S.recent_history(_line_snapshots(spark, sf_dir), 14).select("source", "table_name", "profiled_at", "row_count", "rn")


def row_count_delta(spark, sf_dir):
    return S.row_count_delta(_line_snapshots(spark, sf_dir))


def latest_values(spark, sf_dir):
    return S.latest_values(stored_lines_history(spark, sf_dir))


# -- cross-source checks -----------------------------------------------------------------------------


def _issues(df):
    return df.select("check", "subject", "severity", "diff")


def cross_row_count(spark, sf_dir):
    return _issues(X.row_count_consistency(_line_snapshots(spark, sf_dir)))


def cross_row_count_details(spark, sf_dir):
    issues = X.row_count_consistency(_line_snapshots(spark, sf_dir), threshold=0.0, high=80.0)
    return issues.select("subject", F.explode("details").alias("source", "rows"))


def cross_null_rate(spark, sf_dir):
    return _issues(X.null_rate_consistency(stored_lines_history(spark, sf_dir)))


def cross_null_rate_by_table(spark, sf_dir):
    return _issues(X.null_rate_consistency(stored_lines_history(spark, sf_dir), by_table=True))


def source_growth(spark, sf_dir):
    return X.source_growth(_line_snapshots(spark, sf_dir))


def volume_divergence(spark, sf_dir):
    return X.volume_divergence(_line_snapshots(spark, sf_dir)).select("check", "subject", "severity", "diff", "message")


# one source triples in its five newest snapshots, the others fall to a third
_DIVERGED = "row_count * CASE WHEN (source = 'west') = (rn <= 5) THEN 3 ELSE 1 END"


def volume_divergence_planted(spark, sf_dir):
    newest_first = Window.partitionBy(*S.SERIES).orderBy(F.desc("profiled_at"))
    ranked = _line_snapshots(spark, sf_dir).withColumn("rn", F.row_number().over(newest_first))
    planted = ranked.withColumn("row_count", F.expr(_DIVERGED)).drop("rn")
    return X.volume_divergence(planted).select("check", "subject", "severity", "diff", "message")


def missing_tables(spark, sf_dir):
    rows = X.missing_tables(stored(_line_snapshots(spark, sf_dir), "line_snapshots"))
    return rows.select(
        "check", "subject", "severity", F.concat_ws(",", "present_in").alias("present_in"),
        F.concat_ws(",", "missing_from").alias("missing_from"),
    )


def cross_report(spark, sf_dir):
    from plumbline.plans.monitor import cross_checks

    history = stored_lines_history(spark, sf_dir)
    return X.cross_report(cross_checks(S.row_counts(history), history))


# -- scores --------------------------------------------------------------------------------------------


def _scores(df):
    return df.select("source", "table_name", "score", "status", F.concat_ws("; ", "issues").alias("issues"))


def table_scores(spark, sf_dir):
    return _scores(C.table_scores(*_feed_and_findings(spark, sf_dir)))


def table_scores_lines(spark, sf_dir):
    history = stored_lines_history(spark, sf_dir)
    return _scores(C.table_scores(history, P.best_findings(P.detect_all(history, with_forest=False))))


def _rule_summary(spark, sf_dir):
    """Failed rules of the shop suites, charged to the event tables that stand for them."""
    per_table = summarize(all_suites(spark, sf_dir), "table_name")
    event = F.expr("CASE table_name WHEN 'orders' THEN 'purchase' WHEN 'users' THEN 'signup' ELSE 'view' END")
    source = F.when(event == "view", "web").otherwise("shop")
    return per_table.select(source.alias("source"), event.alias("table_name"), "failed")


def table_scores_with_rules(spark, sf_dir):
    history, findings = _feed_and_findings(spark, sf_dir)
    return _scores(C.table_scores(history, findings, _rule_summary(spark, sf_dir)))


def worst_tables(spark, sf_dir):
    """The three worst tables of the score list."""
    return C.worst_first(C.table_scores(*_feed_and_findings(spark, sf_dir))).limit(3).select(
        "source", "table_name", "score", "status"
    )


def summary(spark, sf_dir):
    history, findings = _feed_and_findings(spark, sf_dir)
    return C.summary(history, findings, C.table_scores(history, findings), all_suites(spark, sf_dir))


# -- roll-ups --------------------------------------------------------------------------------------------


def null_heatmap(spark, sf_dir):
    """Monthly snapshots averaged per year would repeat one value per date, so dates are years here."""
    yearly = lines_history(spark, sf_dir).withColumn("profiled_at", F.trunc("profiled_at", "year"))
    heat = R.null_heatmap(yearly)
    return heat.withColumn("null_pct", F.round("null_pct", 4))


def null_heatmap_last(spark, sf_dir):
    return R.null_heatmap_last(feed_history(spark, sf_dir))


# the days that the events of the driver's tables lie in, whatever their number
FEED_DAYS = [f"2024-01-{day:02d}" for day in range(1, 31)]


def null_heatmap_grid(spark, sf_dir):
    """The whole heatmap, a column for each day of the feed."""
    return R.heatmap_grid(R.null_heatmap(stored_feed_history(spark, sf_dir)), FEED_DAYS)


def worst_null_columns(spark, sf_dir):
    return R.worst_null_columns(R.null_heatmap(feed_history(spark, sf_dir)), 10)


def chart_series(spark, sf_dir):
    """The feed's `value` column appears in every first snapshot; gaps show as zero."""
    return R.chart_series(stored_feed_history(spark, sf_dir)).drop("date")


def run_snapshots(spark, sf_dir):
    """Snapshots dated to the minute: one per event type and minute bucket of the day's first events."""
    events = table(spark, sf_dir, "events")
    return events.groupBy(
        F.expr("CASE WHEN event_type IN ('click', 'view') THEN 'web' ELSE 'shop' END").alias("source"),
        F.col("event_type").alias("table_name"),
        F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("profiled_at"),
    ).agg(F.count(F.lit(1)).alias("row_count"))


def run_history(spark, sf_dir):
    runs = R.run_history(run_snapshots(spark, sf_dir))
    return runs.withColumn("run_at", F.col("run_at").cast("timestamp_ntz"))


def run_tables(spark, sf_dir):
    rows = R.run_tables(run_snapshots(spark, sf_dir), per_run=3)
    return rows.withColumn("run_at", F.col("run_at").cast("timestamp_ntz"))


def run_totals(spark, sf_dir):
    return R.run_totals(run_snapshots(spark, sf_dir), event_alerts(spark, sf_dir))


def alerts_per_day(spark, sf_dir):
    return R.alerts_per_day(event_alerts(spark, sf_dir))


def alerts_per_channel(spark, sf_dir):
    return P.counts_by(event_alerts(spark, sf_dir), "channel")


def alert_totals(spark, sf_dir):
    return R.alert_totals(event_alerts(spark, sf_dir))


QUERIES = {
    "latest_snapshot": latest_snapshot,
    "recent_history": recent_history,
    "row_count_delta": row_count_delta,
    "latest_values": latest_values,
    "cross_row_count": cross_row_count,
    "cross_row_count_details": cross_row_count_details,
    "cross_null_rate": cross_null_rate,
    "cross_null_rate_by_table": cross_null_rate_by_table,
    "source_growth": source_growth,
    "volume_divergence": volume_divergence,
    "volume_divergence_planted": volume_divergence_planted,
    "missing_tables": missing_tables,
    "cross_report": cross_report,
    "table_scores": table_scores,
    "table_scores_lines": table_scores_lines,
    "table_scores_with_rules": table_scores_with_rules,
    "worst_tables": worst_tables,
    "summary": summary,
    "null_heatmap": null_heatmap,
    "null_heatmap_last": null_heatmap_last,
    "null_heatmap_grid": null_heatmap_grid,
    "worst_null_columns": worst_null_columns,
    "chart_series": chart_series,
    "run_history": run_history,
    "run_tables": run_tables,
    "run_totals": run_totals,
    "alerts_per_day": alerts_per_day,
    "alerts_per_channel": alerts_per_channel,
    "alert_totals": alert_totals,
}

_LINES = (*LINES_CTES, SNAPS_CTE, LATEST_CTE)
_X1 = (
    "x1",
    f"SELECT lower(table_name) AS subject, {settle('(max(row_count) - min(row_count)) * 1E0 / max(row_count) * 100', 1)} AS diff "
    "FROM (SELECT * FROM snaps QUALIFY row_number() OVER (PARTITION BY source, table_name ORDER BY profiled_at DESC) = 1) "
    "GROUP BY 1 HAVING count(DISTINCT source) >= 2",
)
_RATES = (
    "rates",
    "SELECT source, table_name, lower(replace(metric, 'null_pct.', '')) AS col, value FROM hist JOIN last_at "
    "USING (source, table_name) WHERE profiled_at = today_at AND starts_with(metric, 'null_pct.')",
)


def _x2(subject: str) -> tuple[str, str]:
    return (
        "x2",
        f"SELECT subject, {settle('max(rate) - min(rate)', 1)} AS diff, max(rate) AS top FROM "
        f"(SELECT {subject} AS subject, source, arg_max(value, table_name) AS rate FROM rates GROUP BY 1, 2) "
        "GROUP BY 1 HAVING count(*) >= 2",
    )


_X3 = (
    "growth",
    f"SELECT source, CAST(sum(c) FILTER (newer) AS BIGINT) AS rows_now, CAST(sum(c) FILTER (NOT newer) AS BIGINT) AS rows_before, "
    f"{settle('(sum(c) FILTER (newer) - sum(c) FILTER (NOT newer)) * 1E0 / sum(c) FILTER (NOT newer) * 100', 1)} AS growth_pct "
    "FROM (SELECT source, table_name, rn <= n // 2 AS newer, arg_max(row_count, rn) AS c FROM "
    "(SELECT *, count(*) OVER (PARTITION BY source, table_name) AS n FROM (SELECT *, row_number() OVER (PARTITION BY source, table_name "
    "ORDER BY profiled_at DESC) AS rn FROM snaps) WHERE rn <= 10) WHERE n >= 2 GROUP BY 1, 2, 3) GROUP BY 1 "
    "HAVING sum(c) FILTER (NOT newer) > 0",
)
_PLANTED = (
    "planted",
    f"SELECT source, table_name, profiled_at, CAST({_DIVERGED} AS BIGINT) AS row_count FROM (SELECT *, row_number() OVER "
    "(PARTITION BY source, table_name ORDER BY profiled_at DESC) AS rn FROM snaps)",
)
_X3_ISSUE = (
    "SELECT 'volume_divergence' AS \"check\", string_agg(source, ',' ORDER BY growth_pct < 0, source) FILTER (growth_pct <> 0) AS subject, "
    f"'HIGH' AS severity, {settle('max(growth_pct) - min(growth_pct)', 1)} AS diff, "
    "'Growing: ' || string_agg(source, ', ' ORDER BY source) FILTER (growth_pct > 0) || '; shrinking: ' || "
    "string_agg(source, ', ' ORDER BY source) FILTER (growth_pct < 0) AS message FROM growth "
    "HAVING count(*) >= 2 AND max(growth_pct) - min(growth_pct) > 20 AND max(growth_pct) > 0 AND min(growth_pct) < 0"
)
_X4 = (
    "SELECT 'missing_table' AS \"check\", subject, 'MEDIUM' AS severity, "
    "string_agg(source, ',' ORDER BY source) FILTER (present) AS present_in, "
    "string_agg(source, ',' ORDER BY source) FILTER (NOT present) AS missing_from FROM "
    "(SELECT s.source, t.subject, EXISTS (SELECT 1 FROM snaps x WHERE x.source = s.source AND lower(x.table_name) = t.subject) AS present "
    "FROM (SELECT DISTINCT source FROM snaps) s, (SELECT DISTINCT lower(table_name) AS subject FROM snaps) t) "
    "GROUP BY subject HAVING NOT bool_and(present)"
)
_X1_ISSUE = (
    "SELECT 'row_count_consistency' AS \"check\", subject, CASE WHEN diff > 80 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, diff "
    "FROM x1 WHERE diff > 50"
)
_X2_ISSUE = (
    "SELECT 'null_rate_consistency' AS \"check\", subject, CASE WHEN diff > 60 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, diff "
    "FROM x2 WHERE diff > 30 AND top > 5"
)


def _score_sql(texts: dict[str, str], with_rules: bool) -> str:
    """Penalties as rows, added up per table."""
    parts = [
        "SELECT DISTINCT source, table_name, 0 AS points, CAST(NULL AS VARCHAR) AS issue FROM hist",
        "SELECT source, table_name, CASE severity WHEN 'CRITICAL' THEN 15 WHEN 'HIGH' THEN 8 ELSE 3 END, "
        f"CASE severity WHEN 'CRITICAL' THEN {texts['CRITICAL']} WHEN 'HIGH' THEN {texts['HIGH']} END FROM best",
        f"SELECT source, table_name, CASE WHEN value > 20 THEN 5 ELSE 2 END, CASE WHEN value > 20 THEN {texts['nulls']} END "
        "FROM hist JOIN last_at USING (source, table_name) WHERE profiled_at = today_at AND starts_with(metric, 'null_pct.') AND value > 10",
    ]
    if with_rules:
        parts.append(
            "SELECT CASE WHEN table_name = 'products' THEN 'web' ELSE 'shop' END, CASE table_name WHEN 'orders' THEN 'purchase' "
            "WHEN 'users' THEN 'signup' ELSE 'view' END, 10 * count(*) FILTER (NOT passed), NULL FROM rules GROUP BY table_name"
        )
    return (
        "SELECT source, table_name, score, CASE WHEN score >= 90 THEN 'HEALTHY' WHEN score >= 70 THEN 'WARNING' ELSE 'CRITICAL' END "
        "AS status, issues FROM (SELECT source, table_name, CAST(greatest(0, least(100, 100 - sum(points))) AS INTEGER) AS score, "
        "coalesce(string_agg(issue, '; ' ORDER BY issue), '') AS issues FROM (" + " UNION ALL ".join(parts) + ") GROUP BY 1, 2)"
    )


_PLAIN = {
    "CRITICAL": "'CRITICAL: ' || metric",
    "HIGH": "NULL",
    "nulls": "'High nulls: ' || metric || '=' || printf('%.1f', value) || '%'",
}
_RULED = {
    "CRITICAL": "'CRITICAL anomaly: ' || metric",
    "HIGH": "'HIGH anomaly: ' || metric",
    "nulls": "'High nulls in ' || metric || ': ' || printf('%.1f', value) || '%'",
}
_LINE_DETECT = (*LINES_CTES, *DETECT_CTES[len(FEED_CTES):])
_HEAT = (
    "heat",
    "SELECT source, table_name || '.' || replace(metric, 'null_pct.', '') AS \"column\", profiled_at AS date, value AS null_pct "
    "FROM hist WHERE starts_with(metric, 'null_pct.')",
)
_RUNS = (
    "runs",
    "SELECT CASE WHEN event_type IN ('click', 'view') THEN 'web' ELSE 'shop' END AS source, event_type AS table_name, "
    "date_trunc('hour', ts) AS profiled_at, count(*) AS row_count FROM events GROUP BY 1, 2, 3",
)
_RECENT = ("recent", "SELECT * FROM runs WHERE profiled_at IN (SELECT DISTINCT profiled_at FROM runs ORDER BY 1 DESC LIMIT 50)")
_CHANNEL = "CASE WHEN event_id % 2 = 0 THEN 'slack' ELSE 'email' END"

ORACLE = {
    "latest_snapshot": ctes(*_LINES)
    + "SELECT * FROM snaps QUALIFY row_number() OVER (PARTITION BY source, table_name ORDER BY profiled_at DESC) = 1",
    "recent_history": ctes(*_LINES)
    + "SELECT *, CAST(row_number() OVER (PARTITION BY source, table_name ORDER BY profiled_at DESC) AS INTEGER) AS rn FROM snaps QUALIFY rn <= 14",
    "row_count_delta": ctes(*_LINES)
    + "SELECT source, table_name, row_count AS latest, previous, row_count - previous AS delta FROM (SELECT *, lag(row_count, 1, row_count) "
    "OVER w AS previous, row_number() OVER (PARTITION BY source, table_name ORDER BY profiled_at DESC) AS rn FROM snaps "
    "WINDOW w AS (PARTITION BY source, table_name ORDER BY profiled_at)) WHERE rn = 1",
    "latest_values": ctes(*_LINES)
    + "SELECT source, table_name, profiled_at, metric, value FROM hist JOIN last_at USING (source, table_name) WHERE profiled_at = today_at",
    "cross_row_count": ctes(*_LINES, _X1) + _X1_ISSUE,
    "cross_row_count_details": ctes(*_LINES, _X1)
    + "SELECT subject, source, CAST(row_count AS DOUBLE) AS rows FROM (SELECT *, lower(table_name) AS subject FROM snaps "
    "QUALIFY row_number() OVER (PARTITION BY source, table_name ORDER BY profiled_at DESC) = 1) JOIN x1 USING (subject) WHERE diff > 0",
    "cross_null_rate": ctes(*_LINES, _RATES, _x2("col")) + _X2_ISSUE,
    "cross_null_rate_by_table": ctes(*_LINES, _RATES, _x2("lower(table_name) || '.' || col")) + _X2_ISSUE,
    "source_growth": ctes(*_LINES, _X3) + "SELECT * FROM growth",
    "volume_divergence": ctes(*_LINES, _X3) + _X3_ISSUE,
    "volume_divergence_planted": ctes(*_LINES, _PLANTED, (_X3[0], _X3[1].replace("FROM snaps", "FROM planted"))) + _X3_ISSUE,
    "missing_tables": ctes(*_LINES) + _X4,
    "cross_report": ctes(
        *_LINES, _X1, _RATES, _x2("col"), _X3,
        ("issues", f"SELECT severity FROM ({_X1_ISSUE}) UNION ALL SELECT severity FROM ({_X2_ISSUE}) UNION ALL "
         f"SELECT severity FROM ({_X3_ISSUE}) UNION ALL SELECT severity FROM ({_X4})"),
    )
    + "SELECT count(*) AS total_issues, count(*) FILTER (severity = 'HIGH') AS high, count(*) FILTER (severity = 'MEDIUM') AS medium, "
    "CASE WHEN count(*) = 0 THEN 'CLEAN' WHEN count(*) FILTER (severity = 'HIGH') > 0 THEN 'HIGH' ELSE 'MEDIUM' END AS overall_status FROM issues",
    "table_scores": ctes(*DETECT_CTES) + _score_sql(_PLAIN, False),
    "table_scores_lines": ctes(*_LINE_DETECT) + _score_sql(_PLAIN, False),
    "table_scores_with_rules": ctes(*DETECT_CTES, *SHOP_CTES, RULES_CTE) + _score_sql(_RULED, True),
    "worst_tables": ctes(*DETECT_CTES, ("scores", _score_sql(_PLAIN, False)))
    + "SELECT source, table_name, score, status FROM scores ORDER BY score, source, table_name LIMIT 3",
    "summary": ctes(*DETECT_CTES, *SHOP_CTES, RULES_CTE, ("scores", _score_sql(_PLAIN, False)))
    + f"SELECT (SELECT {settle('avg(score)', 1)} FROM scores) AS avg_dq_score, "
    "(SELECT count(*) FROM best) AS total_anomalies, (SELECT count(*) FROM best WHERE severity = 'CRITICAL') AS critical, "
    "(SELECT count(*) FROM best WHERE severity = 'HIGH') AS high, (SELECT count(*) FROM best WHERE severity = 'MEDIUM') AS medium, "
    "(SELECT coalesce(min(severity) FILTER (severity = 'CRITICAL'), min(severity) FILTER (severity = 'HIGH'), min(severity), 'CLEAN') FROM best) "
    "AS overall_status, (SELECT count(*) FROM rules WHERE passed) AS checks_passed, (SELECT count(*) FROM rules WHERE NOT passed) AS checks_failed, "
    "(SELECT count(*) FROM hist WHERE metric = 'row_count') AS total_snapshots, (SELECT count(DISTINCT source) FROM hist) AS source_count",
    "null_heatmap": ctes(*LINES_CTES)
    + "SELECT source, table_name || '.' || replace(metric, 'null_pct.', '') AS \"column\", CAST(date_trunc('year', profiled_at) AS DATE) AS date, "
    "round(avg(value), 4) AS null_pct FROM hist WHERE starts_with(metric, 'null_pct.') GROUP BY 1, 2, 3",
    "null_heatmap_last": ctes(*FEED_CTES, _HEAT) + "SELECT * FROM heat",
    "null_heatmap_grid": ctes(*FEED_CTES, _HEAT)
    + 'SELECT source, "column", '
    + ", ".join(f"max(null_pct) FILTER (CAST(date AS VARCHAR) = '{day}') AS \"{day}\"" for day in FEED_DAYS)
    + " FROM heat GROUP BY 1, 2",
    "worst_null_columns": ctes(*FEED_CTES, _HEAT)
    + f"SELECT source, \"column\", {settle('avg(null_pct)', 2)} AS avg_null_pct FROM heat GROUP BY 1, 2 "
    "ORDER BY avg_null_pct DESC, source, \"column\" LIMIT 10",
    "chart_series": ctes(*FEED_CTES)
    + "SELECT source, table_name, profiled_at, metric, value FROM hist WHERE metric = 'row_count' UNION ALL "
    "SELECT r.source, r.table_name, r.profiled_at, k.metric, coalesce(h.value, 0) FROM hist r JOIN "
    "(SELECT source, table_name, metric FROM hist h1 WHERE starts_with(metric, 'null_pct.') AND profiled_at = (SELECT min(profiled_at) FROM hist h2 "
    "WHERE h2.source = h1.source AND h2.table_name = h1.table_name)) k ON r.source = k.source AND r.table_name = k.table_name "
    "LEFT JOIN hist h ON h.source = r.source AND h.table_name = r.table_name AND h.profiled_at = r.profiled_at AND h.metric = k.metric "
    "WHERE r.metric = 'row_count'",
    "run_history": ctes(_RUNS)
    + "SELECT date_trunc('minute', profiled_at) AS run_at, count(*) AS table_count, count(DISTINCT source) AS source_count, "
    "CAST(sum(row_count) AS BIGINT) AS row_count FROM runs GROUP BY 1 ORDER BY 1 DESC LIMIT 50",
    "run_tables": ctes(_RUNS, _RECENT)
    + "SELECT profiled_at AS run_at, CAST(row_number() OVER (PARTITION BY profiled_at ORDER BY source, table_name) AS INTEGER) AS rn, "
    "source, table_name, row_count FROM recent QUALIFY rn <= 3",
    "run_totals": ctes(_RUNS)
    + "SELECT count(DISTINCT profiled_at) AS runs, count(*) AS tables_profiled, count(DISTINCT source) AS sources, "
    "(SELECT count(*) FROM events) AS alerts FROM runs",
    "alerts_per_day": "SELECT CAST(ts AS DATE) AS date, count(*) AS alerts FROM events GROUP BY 1",
    "alerts_per_channel": f"SELECT {_CHANNEL} AS channel, count(*) AS n FROM events GROUP BY 1",
    "alert_totals": "SELECT count(*) AS alerts, count(*) FILTER (event_type = 'error') AS critical_alerts, "
    f"count(DISTINCT {_CHANNEL}) AS channels FROM events",
}
