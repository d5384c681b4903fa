"""Detectors, anomaly report, annotation and alerts over the event feed."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions.scalars import alert_key
from plumbline.operators import alerts as A
from plumbline.operators import annotate as N
from plumbline.operators import detect as D
from plumbline.operators import report as P
from plumbline.operators.iforest import eligible_tables, forest_severity, isolation_forest
from plumbline.operators.profile import bucket_history
from plumbline.operators.quantiles import exact_quantiles
from plumbline.session import stored
from workload.inputs import (
    DETECT_CTES,
    FEED_CTES,
    IQR_CTE,
    LATEST_CTE,
    LINES_CTES,
    SHOP_CTES,
    ZSCORE_CTE,
    ctes,
    feed_history,
    number,
    settle,
    stored_feed_history,
    stored_lines_history,
    table,
)
from workload.quality import RULES_CTE, all_suites

SHOWN = [
    "source", "table_name", "profiled_at", "detector", "metric", "severity", "direction", "today", "expected",
    "z_score", "lower_fence", "upper_fence", "iqr_distance",
]
RUN_AT = "2024-01-31T06:00:00.123456"


def found(spark, sf_dir):
    """Best findings of both series detectors."""
    history = stored_feed_history(spark, sf_dir)
    return P.best_findings(P.detect_all(history, with_forest=False))


def zscore_row_count(spark, sf_dir):
    """Monthly order counts; the last month is cut short."""
    orders = table(spark, sf_dir, "orders")
    history = bucket_history(
        orders,
        source=F.lit("driver"),
        table_name=F.lit("orders"),
        profiled_at=F.expr("CAST(date_trunc('month', o_orderdate) AS DATE)"),
    )
    return D.zscore(stored(history, "orders_history")).select(*SHOWN)


def zscore_all_metrics(spark, sf_dir):
    return D.zscore(stored_feed_history(spark, sf_dir)).select(*SHOWN)


def zscore_lines(spark, sf_dir):
    return D.zscore(stored_lines_history(spark, sf_dir)).select(*SHOWN)


def zscore_backtest(spark, sf_dir):
    """Every day of every series against the days before it."""
    return D.zscore_backtest(feed_history(spark, sf_dir)).select(*SHOWN)


def zscore_constant_break(spark, sf_dir):
    return D.zscore(stored_feed_history(spark, sf_dir), flag_constant_break=True).select(*SHOWN)


def iqr_selected(spark, sf_dir):
    """The same findings with quartiles by distributed selection."""
    return D.iqr_selected(stored_feed_history(spark, sf_dir)).select(*SHOWN)


QUANTILES = (0.01, 0.25, 0.5, 0.75, 0.99)
MEASURES = ("l_quantity", "l_extendedprice", "l_discount")


def quantiles_lines(spark, sf_dir):
    """Exact quantiles of three measures of all order lines, by return flag; a flag holds up to half of the rows."""
    measures = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in MEASURES])
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", F.inline(measures))
    found = exact_quantiles(rows, ["l_returnflag", "measure"], "value", QUANTILES)
    shown = [F.round(F.col("q")[i], 4).alias(f"p{round(100 * p)}") for i, p in enumerate(QUANTILES)]
    return found.select("l_returnflag", "measure", "n", *shown)


def iqr_all_metrics(spark, sf_dir):
    return D.iqr(stored_feed_history(spark, sf_dir)).select(*SHOWN)


def iqr_backtest(spark, sf_dir):
    """Every day of every series against the quartiles of the days before it."""
    return D.iqr_backtest(feed_history(spark, sf_dir)).select(*SHOWN)


def iqr_lines(spark, sf_dir):
    return D.iqr(stored_lines_history(spark, sf_dir)).select(*SHOWN)


def iforest_events(spark, sf_dir):
    return isolation_forest(stored_feed_history(spark, sf_dir))


def forest_contributors(spark, sf_dir):
    """Tables that the forest judges, with the metrics that move it most."""
    tables, _ = eligible_tables(stored_feed_history(spark, sf_dir))
    return tables.select("source", "table_name", "n_rows", F.posexplode("top_contributors").alias("rank", "top")).select(
        "source", "table_name", "n_rows", "rank", "top.metric", "top.z_score"
    )


def forest_severities(spark, sf_dir):
    """Severity of scores spread over the range that a forest can give: one for each event."""
    scores = table(spark, sf_dir, "events").select((F.lit(-1.0) * F.pmod("event_id", F.lit(1000)) / 1000).alias("score"))
    return scores.groupBy(forest_severity(F.col("score")).alias("severity")).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("lowest"))


def findings_all(spark, sf_dir):
    history = stored_feed_history(spark, sf_dir)
    return P.merge_findings(D.zscore(history), D.iqr(history)).select(*SHOWN)


def findings_dedup(spark, sf_dir):
    return found(spark, sf_dir).select(*SHOWN)


def report_severity(spark, sf_dir):
    return P.report_totals(found(spark, sf_dir))


def report_tables(spark, sf_dir):
    history = stored_feed_history(spark, sf_dir)
    return P.report_tables(history, P.best_findings(P.detect_all(history, with_forest=False)))


def findings_ranked(spark, sf_dir):
    """Worst first, with the rank made visible."""
    top = P.top_findings(found(spark, sf_dir), 5)
    return top.select("source", "table_name", "metric", "severity", "rn")


def findings_flat(spark, sf_dir):
    return P.flatten_findings(found(spark, sf_dir), F.lit(RUN_AT))


def findings_selected(spark, sf_dir):
    picked = P.select_findings(found(spark, sf_dir), ["CRITICAL", "HIGH"], ["click", "error", "view"], "web")
    return picked.select(*SHOWN)


def severity_counts(spark, sf_dir):
    return P.counts_by(found(spark, sf_dir), "severity")


def table_counts(spark, sf_dir):
    return P.counts_by(found(spark, sf_dir), "source", "table_name")


def explain_findings(spark, sf_dir):
    return N.explain(found(spark, sf_dir)).select("source", "table_name", "metric", "explanation")


def root_cause(spark, sf_dir):
    rows = N.root_cause(found(spark, sf_dir))
    return rows.select(
        "source", "table_name", "metric", "what_happened",
        F.concat_ws(" | ", "causes").alias("causes"), F.concat_ws(" | ", "what_to_check").alias("what_to_check"),
        "how_to_fix",
    )


# -- alerts ---------------------------------------------------------------------------------------

def _at():
    return F.lit("2024-01-31 06:00:00").cast("timestamp_ntz")


def alert_routing(spark, sf_dir):
    rows = A.to_alerts(A.route(found(spark, sf_dir)), "slack", _at())
    return rows.select("alert_key", "channel", "severity", "summary")


def report_alerts(spark, sf_dir):
    rows = A.report_alerts(found(spark, sf_dir), all_suites(spark, sf_dir), "slack", _at())
    return rows.select("alert_key", "channel", "severity", "summary")


def event_alerts(spark, sf_dir, events=None):
    """Every event as an alert of its type and user."""
    e = table(spark, sf_dir, "events") if events is None else events
    severity = F.expr("CASE event_type WHEN 'error' THEN 'CRITICAL' WHEN 'purchase' THEN 'HIGH' ELSE 'MEDIUM' END")
    return e.select(
        alert_key(F.col("event_type"), F.col("user_id").cast("string"), severity).alias("alert_key"),
        F.when(F.col("event_id") % 2 == 0, "slack").otherwise("email").alias("channel"),
        F.col("ts").alias("sent_at"),
        severity.alias("severity"),
        F.concat_ws(" ", "event_type", "user_id").alias("summary"),
    )


DAY = 24 * 60


def alert_suppression(spark, sf_dir):
    return A.suppress(A.route(event_alerts(spark, sf_dir)), minutes=DAY)


def alert_suppression_hot(spark, sf_dir):
    """One key per event type: all keys are heavy and run through the block plan."""
    hot = event_alerts(spark, sf_dir).withColumn("alert_key", F.split("summary", " ")[0]).withColumn("channel", F.lit("slack"))
    return A.suppress(hot, minutes=60)


def not_recently_sent(spark, sf_dir):
    """Candidates at the end of the month against the log of all events sent as alerts."""
    alerts = event_alerts(spark, sf_dir)
    log = alerts.filter(F.col("sent_at") < F.lit("2024-01-30").cast("timestamp_ntz"))
    now = alerts.filter(F.col("sent_at") >= F.lit("2024-01-30").cast("timestamp_ntz"))
    return A.not_recently_sent(now, log, minutes=3 * DAY)


def first_alert_per_table(spark, sf_dir):
    rows = A.first_per_table(A.to_alerts(A.route(found(spark, sf_dir)), "scheduler", _at()))
    return rows.select("source", "table_name", "metric", "severity", "alert_key")


def newest_alerts(spark, sf_dir):
    return A.newest_alerts(event_alerts(spark, sf_dir), 50)


QUERIES = {
    "zscore_row_count": zscore_row_count,
    "zscore_all_metrics": zscore_all_metrics,
    "zscore_lines": zscore_lines,
    "zscore_backtest": zscore_backtest,
    "zscore_constant_break": zscore_constant_break,
    "iqr_all_metrics": iqr_all_metrics,
    "iqr_selected": iqr_selected,
    "quantiles_lines": quantiles_lines,
    "iqr_backtest": iqr_backtest,
    "iqr_lines": iqr_lines,
    "iforest_events": iforest_events,
    "forest_contributors": forest_contributors,
    "forest_severities": forest_severities,
    "findings_all": findings_all,
    "findings_dedup": findings_dedup,
    "report_severity": report_severity,
    "report_tables": report_tables,
    "findings_ranked": findings_ranked,
    "findings_flat": findings_flat,
    "findings_selected": findings_selected,
    "severity_counts": severity_counts,
    "table_counts": table_counts,
    "explain_findings": explain_findings,
    "root_cause": root_cause,
    "alert_routing": alert_routing,
    "report_alerts": report_alerts,
    "alert_suppression": alert_suppression,
    "alert_suppression_hot": alert_suppression_hot,
    "not_recently_sent": not_recently_sent,
    "first_alert_per_table": first_alert_per_table,
    "newest_alerts": newest_alerts,
}

_COLS = ", ".join(SHOWN)
_ORDERS_HIST = (
    "hist",
    "SELECT 'driver' AS source, 'orders' AS table_name, CAST(date_trunc('month', o_orderdate) AS DATE) AS profiled_at, "
    "'row_count' AS metric, CAST(count(*) AS DOUBLE) AS value FROM orders GROUP BY 3",
)
_BACKTEST = (
    "SELECT source, table_name, profiled_at, 'zscore' AS detector, metric, "
    "CASE WHEN abs(z) >= 6 THEN 'CRITICAL' WHEN abs(z) >= 4 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, "
    "CASE WHEN z < 0 THEN 'LOW' ELSE 'HIGH' END AS direction, "
    f"{settle('value', 4)} AS today, {settle('m', 4)} AS expected, {settle('z', 2)} AS z_score, "
    "CAST(NULL AS DOUBLE) AS lower_fence, CAST(NULL AS DOUBLE) AS upper_fence, CAST(NULL AS DOUBLE) AS iqr_distance "
    "FROM (SELECT *, (value - m) / s AS z FROM (SELECT *, count(value) OVER w AS n, avg(value) OVER w AS m, "
    "stddev_samp(value) OVER w AS s FROM hist WINDOW w AS (PARTITION BY source, table_name, metric ORDER BY profiled_at "
    "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE n >= 7 AND s > 1E-9) WHERE abs(z) >= 3"
)
_IQR_BACKTEST = (
    "SELECT source, table_name, profiled_at, 'iqr' AS detector, metric, "
    "CASE WHEN dist >= 4 THEN 'CRITICAL' WHEN dist >= 2 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, "
    "CASE WHEN value < lo THEN 'LOW' ELSE 'HIGH' END AS direction, "
    f"{settle('value', 4)} AS today, CAST(NULL AS DOUBLE) AS expected, CAST(NULL AS DOUBLE) AS z_score, "
    f"{settle('lo', 4)} AS lower_fence, {settle('hi', 4)} AS upper_fence, {settle('dist', 2)} AS iqr_distance "
    "FROM (SELECT *, CASE WHEN value < lo THEN (lo - value) / (q3 - q1) ELSE (value - hi) / (q3 - q1) END AS dist "
    "FROM (SELECT *, q1 - 1.5E0 * (q3 - q1) AS lo, q3 + 1.5E0 * (q3 - q1) AS hi FROM (SELECT *, count(value) OVER w AS n, "
    "quantile_cont(value, 0.25) OVER w AS q1, quantile_cont(value, 0.75) OVER w AS q3 FROM hist "
    "WINDOW w AS (PARTITION BY source, table_name, metric ORDER BY profiled_at ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) "
    "WHERE n >= 7 AND value IS NOT NULL AND q3 <> q1)) WHERE value < lo OR value > hi"
)
_TOTALS = (
    "SELECT count(*) AS total_anomalies, count(*) FILTER (severity = 'CRITICAL') AS critical, "
    "count(*) FILTER (severity = 'HIGH') AS high, count(*) FILTER (severity NOT IN ('CRITICAL', 'HIGH')) AS medium, "
    "CASE WHEN count(*) FILTER (severity = 'CRITICAL') > 0 THEN 'CRITICAL' WHEN count(*) FILTER (severity = 'HIGH') > 0 "
    "THEN 'HIGH' WHEN count(*) > 0 THEN 'MEDIUM' ELSE 'CLEAN' END AS overall_status FROM best"
)
_SEV = "CASE severity WHEN 'CRITICAL' THEN 1 WHEN 'HIGH' THEN 2 ELSE 3 END"
_DET = "CASE detector WHEN 'zscore' THEN 1 ELSE 2 END"
_EXPECTED = f"coalesce({number('expected')}, {number('lower_fence')} || '–' || {number('upper_fence')}, '—')"


_PCT = f"CAST(CAST({settle('abs(today / expected - 1) * 100', 1)} AS DECIMAL(38, 1)) AS VARCHAR)"
_SIDE = "CASE WHEN direction = 'HIGH' THEN ' above' ELSE ' below' END"
_SPOKEN = (
    "CASE WHEN metric = 'row_count' THEN 'row count' "
    + " ".join(f"WHEN starts_with(metric, '{k}.') THEN '{v} ' || regexp_replace(metric, '^[a-z_]+\\.', '')" for k, v in N.LABELS.items() if k != "row_count")
    + " ELSE metric END"
)
_FACT = (
    f"source || '.' || table_name || ': ' || {_SPOKEN} || ' is ' || coalesce({number('today')}, '—') || "
    f"coalesce(', ' || CASE WHEN expected <> 0 THEN {_PCT} END || '%' || {_SIDE} || ' the usual ', ',' || {_SIDE} || ' the usual ') || {_EXPECTED}"
)
# evidence of the table beside every finding, then one row per finding and hypothesis
_CAUSES = (
    ("evidence", "SELECT source, table_name, " + ", ".join(f"{e} AS {n}" for n, e in N.EVIDENCE.items()) + " FROM best GROUP BY 1, 2"),
    (
        "hypotheses",
        " UNION ALL ".join(
            f"SELECT *, {i} AS i, {N.points_sql(h)} AS points, '{h.cause}' AS cause, '{h.check}' AS chk, '{h.remedy}' AS remedy FROM best JOIN evidence USING (source, table_name)"
            for i, h in enumerate(N.HYPOTHESES)
        ),
    ),
    (
        "ranked",
        f"SELECT *, row_number() OVER (PARTITION BY source, table_name, metric ORDER BY points DESC, i) AS rn FROM hypotheses QUALIFY rn <= {N.NAMED}",
    ),
)
_ALERTS_CTE = (
    "alerts",
    "SELECT md5(event_type || '|' || user_id || '|' || severity) AS alert_key, channel, ts AS sent_at, severity, "
    "event_type || ' ' || user_id AS summary FROM (SELECT *, CASE event_type WHEN 'error' THEN 'CRITICAL' "
    "WHEN 'purchase' THEN 'HIGH' ELSE 'MEDIUM' END AS severity, CASE WHEN event_id % 2 = 0 THEN 'slack' ELSE 'email' END "
    "AS channel FROM events)",
)


def greedy_sql(rel: str, interval: str) -> str:
    """Recursive chain per key and channel: the next alert at least one window after the last sent."""
    return (
        "WITH RECURSIVE " + f"{_ALERTS_CTE[0]} AS ({_ALERTS_CTE[1]}), src AS ({rel}), "
        "uniq AS (SELECT alert_key, channel, sent_at, min({'severity': severity, 'summary': summary}) AS r FROM src GROUP BY 1, 2, 3), "
        "chain AS (SELECT alert_key, channel, min(sent_at) AS sent_at FROM uniq GROUP BY 1, 2 UNION ALL "
        "SELECT alert_key, channel, nxt FROM (SELECT c.alert_key, c.channel, (SELECT min(u.sent_at) FROM uniq u "
        f"WHERE u.alert_key = c.alert_key AND u.channel = c.channel AND u.sent_at >= c.sent_at + {interval}) AS nxt FROM chain c) "
        "WHERE nxt IS NOT NULL) "
        "SELECT alert_key, channel, sent_at, r.severity AS severity, r.summary AS summary FROM chain JOIN uniq "
        "USING (alert_key, channel, sent_at)"
    )


_TABLE_KEY = "source || '.' || table_name"
_KEY = f"md5({_TABLE_KEY} || '|' || metric || '|' || severity)"

ORACLE = {
    "zscore_row_count": ctes(_ORDERS_HIST, LATEST_CTE, ZSCORE_CTE) + f"SELECT {_COLS} FROM zscore",
    "zscore_all_metrics": ctes(*FEED_CTES, LATEST_CTE, ZSCORE_CTE) + f"SELECT {_COLS} FROM zscore",
    "zscore_lines": ctes(*LINES_CTES, LATEST_CTE, ZSCORE_CTE) + f"SELECT {_COLS} FROM zscore",
    "zscore_backtest": ctes(*FEED_CTES) + _BACKTEST,
    "zscore_constant_break": ctes(*FEED_CTES, LATEST_CTE, ZSCORE_CTE)
    + f"SELECT {_COLS} FROM zscore UNION ALL SELECT source, table_name, today_at, 'zscore', metric, 'HIGH', "
    f"CASE WHEN today < m THEN 'LOW' ELSE 'HIGH' END, {settle('today', 4)}, {settle('m', 4)}, NULL, NULL, NULL, NULL FROM "
    "(SELECT source, table_name, metric, today_at, count(value) FILTER (profiled_at < today_at) AS n, "
    "min(value) FILTER (profiled_at < today_at) AS m, max(value) FILTER (profiled_at < today_at) AS m2, "
    "max(value) FILTER (profiled_at = today_at) AS today FROM hist JOIN last_at USING (source, table_name) GROUP BY 1, 2, 3, 4) "
    "WHERE n >= 7 AND m = m2 AND today <> m",
    "iqr_all_metrics": ctes(*FEED_CTES, LATEST_CTE, IQR_CTE) + f"SELECT {_COLS} FROM iqr",
    "iqr_selected": ctes(*FEED_CTES, LATEST_CTE, IQR_CTE) + f"SELECT {_COLS} FROM iqr",
    "quantiles_lines": " UNION ALL ".join(
        f"SELECT l_returnflag, '{m}' AS measure, count({m}) AS n, "
        + ", ".join(f"round(quantile_cont(CAST({m} AS DOUBLE), {p}), 4) AS p{round(100 * p)}" for p in QUANTILES)
        + " FROM lineitem GROUP BY l_returnflag"
        for m in MEASURES
    ),
    "iqr_backtest": ctes(*FEED_CTES) + _IQR_BACKTEST,
    "iqr_lines": ctes(*LINES_CTES, LATEST_CTE, IQR_CTE) + f"SELECT {_COLS} FROM iqr",
    "forest_contributors": ctes(*FEED_CTES, LATEST_CTE)
    + "SELECT source, table_name, n_rows, CAST(rn - 1 AS INTEGER) AS rank, metric, "
    + settle("z", 2)
    + " AS z_score FROM (SELECT *, row_number() OVER (PARTITION BY source, table_name ORDER BY z DESC, metric) AS rn FROM "
    "(SELECT *, abs((now - m) / s) AS z, count(*) OVER (PARTITION BY source, table_name) AS n_metrics FROM "
    "(SELECT h.source, h.table_name, h.metric, any_value(r.n_rows) AS n_rows, count(value) AS n_values, "
    "avg(value) FILTER (profiled_at < today_at) AS m, stddev_samp(value) FILTER (profiled_at < today_at) AS s, "
    "max(value) FILTER (profiled_at = today_at) AS now FROM hist h JOIN last_at USING (source, table_name) JOIN "
    "(SELECT source, table_name, count(DISTINCT profiled_at) AS n_rows FROM hist GROUP BY 1, 2) r USING (source, table_name) GROUP BY 1, 2, 3) "
    "WHERE n_values = n_rows AND n_rows >= 10) WHERE n_metrics >= 2 AND s > 0) WHERE rn <= 3",
    "forest_severities": "SELECT severity, count(*) AS n, min(score) AS lowest FROM (SELECT *, CASE WHEN score >= -0.2 THEN 'MEDIUM' "
    "WHEN score >= -0.3 THEN 'HIGH' ELSE 'CRITICAL' END AS severity FROM (SELECT -1.0E0 * (event_id % 1000) / 1000 AS score FROM events)) GROUP BY 1",
    "findings_all": ctes(*DETECT_CTES) + f"SELECT {_COLS} FROM zscore UNION ALL SELECT {_COLS} FROM iqr",
    "findings_dedup": ctes(*DETECT_CTES) + f"SELECT {_COLS} FROM best",
    "report_severity": ctes(*DETECT_CTES) + _TOTALS,
    "report_tables": ctes(*DETECT_CTES)
    + "SELECT source, table_name, count(metric) AS anomaly_count, CASE WHEN count(metric) > 0 THEN 'ANOMALOUS' ELSE 'CLEAN' END "
    "AS status FROM last_at LEFT JOIN best USING (source, table_name) GROUP BY 1, 2",
    "findings_ranked": ctes(*DETECT_CTES)
    + "SELECT source, table_name, metric, severity, CAST(row_number() OVER (PARTITION BY source, table_name ORDER BY "
    f"{_SEV}, {_DET}, metric) AS INTEGER) AS rn FROM best QUALIFY rn <= 5",
    "findings_flat": ctes(*DETECT_CTES)
    + f"SELECT substr('{RUN_AT}', 1, 19) AS detected_at, {_TABLE_KEY} AS \"table\", severity, metric, detector, "
    f"coalesce({number('today')}, '—') AS today, {_EXPECTED} AS expected, "
    f"coalesce({number('z_score')}, {number('iqr_distance')}, '—') AS score FROM best",
    "findings_selected": ctes(*DETECT_CTES)
    + f"SELECT {_COLS} FROM best WHERE severity IN ('CRITICAL', 'HIGH') AND table_name IN ('click', 'error', 'view') AND source = 'web'",
    "severity_counts": ctes(*DETECT_CTES) + "SELECT severity, count(*) AS n FROM best GROUP BY 1",
    "table_counts": ctes(*DETECT_CTES) + "SELECT source, table_name, count(*) AS n FROM best GROUP BY 1, 2",
    "explain_findings": ctes(*DETECT_CTES, *_CAUSES)
    + f"SELECT source, table_name, metric, {_FACT} || '; most likely ' || cause || '.' AS explanation FROM ranked WHERE rn = 1",
    "root_cause": ctes(*DETECT_CTES, *_CAUSES)
    + f"SELECT source, table_name, metric, max({_FACT}) || '.' AS what_happened, string_agg(cause, ' | ' ORDER BY rn) AS causes, "
    "string_agg(chk, ' | ' ORDER BY rn) AS what_to_check, max(remedy) FILTER (rn = 1) AS how_to_fix FROM ranked GROUP BY 1, 2, 3",
    "alert_routing": ctes(*DETECT_CTES)
    + f"SELECT {_KEY} AS alert_key, 'slack' AS channel, severity, metric || ' in ' || {_TABLE_KEY} AS summary "
    "FROM best WHERE severity IN ('CRITICAL', 'HIGH')",
    "report_alerts": ctes(*DETECT_CTES, *SHOP_CTES, RULES_CTE, ("totals", _TOTALS))
    + "SELECT md5('all|' || kind || '|' || severity) AS alert_key, 'slack' AS channel, severity, "
    "n || CASE kind WHEN 'anomaly' THEN ' anomalies, status ' ELSE ' failed rules, status ' END || severity AS summary FROM "
    "(SELECT 'anomaly' AS kind, overall_status AS severity, total_anomalies AS n FROM totals UNION ALL "
    "SELECT 'rules', CASE WHEN count(*) > 0 THEN 'HIGH' ELSE 'CLEAN' END, count(*) FROM rules WHERE NOT passed) "
    "WHERE severity IN ('CRITICAL', 'HIGH')",
    "alert_suppression": greedy_sql("SELECT * FROM alerts WHERE severity IN ('CRITICAL', 'HIGH')", "INTERVAL 24 HOUR"),
    "alert_suppression_hot": greedy_sql(
        "SELECT * REPLACE (split_part(summary, ' ', 1) AS alert_key, 'slack' AS channel) FROM alerts", "INTERVAL 60 MINUTE"
    ),
    "not_recently_sent": ctes(_ALERTS_CTE)
    + "SELECT a.* FROM alerts a LEFT JOIN (SELECT alert_key, channel, max(sent_at) AS last FROM alerts "
    "WHERE sent_at < TIMESTAMP '2024-01-30' GROUP BY 1, 2) l USING (alert_key, channel) "
    "WHERE a.sent_at >= TIMESTAMP '2024-01-30' AND (l.last IS NULL OR a.sent_at >= l.last + INTERVAL 72 HOUR)",
    "first_alert_per_table": ctes(*DETECT_CTES)
    + f"SELECT source, table_name, metric, severity, {_KEY} AS alert_key FROM best WHERE severity IN ('CRITICAL', 'HIGH') "
    f"QUALIFY row_number() OVER (PARTITION BY source, table_name ORDER BY {_SEV}, {_DET}, metric) = 1",
    "newest_alerts": ctes(_ALERTS_CTE) + "SELECT * FROM alerts ORDER BY sent_at DESC, channel, alert_key LIMIT 50",
}

