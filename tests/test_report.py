from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from plumbline.operators import annotate as N
from plumbline.operators import report as P
from plumbline.operators import rollups as R
from plumbline.operators import score as C
from tests.helpers import START, by, findings, history


def test_worst_finding_per_metric_and_ties(spark):
    df = findings(
        spark,
        dict(metric="a", detector="zscore", severity="MEDIUM"),
        dict(metric="a", detector="iqr", severity="HIGH"),
        dict(metric="b", detector="iqr", severity="HIGH"),
        dict(metric="b", detector="zscore", severity="HIGH"),
        dict(metric="b", table_name="other", detector="iqr", severity="MEDIUM"),
    )
    got = by(P.best_findings(df), "table_name", "metric")
    assert got["orders", "a"]["detector"] == "iqr" and got["orders", "b"]["detector"] == "zscore"
    assert len(got) == 3


@pytest.mark.parametrize(
    ("severities", "status"),
    [([], "CLEAN"), (["MEDIUM"], "MEDIUM"), (["ODD"], "MEDIUM"), (["MEDIUM", "HIGH"], "HIGH"), (["HIGH", "CRITICAL"], "CRITICAL")],
)
def test_totals(spark, severities, status):
    df = findings(spark, *[dict(metric=f"m{i}", severity=s) for i, s in enumerate(severities)])
    row = P.report_totals(df).first()
    assert row["overall_status"] == status and row["total_anomalies"] == len(severities)
    assert row["medium"] == sum(s not in ("CRITICAL", "HIGH") for s in severities)


def test_tables_without_findings_are_clean(spark):
    h = history(spark, {"row_count": [1]}, table="a").unionByName(history(spark, {"row_count": [1]}, table="b"))
    got = by(P.report_tables(h, findings(spark, dict(table_name="a"), dict(table_name="a", metric="x"))), "table_name")
    assert (got["a"]["anomaly_count"], got["a"]["status"]) == (2, "ANOMALOUS")
    assert (got["b"]["anomaly_count"], got["b"]["status"]) == (0, "CLEAN")


def test_order_and_top(spark):
    df = findings(spark, *[dict(metric=f"m{i}", severity=s) for i, s in enumerate(["MEDIUM", "CRITICAL", "HIGH", "HIGH"])])
    assert [r["metric"] for r in P.by_severity(df).collect()] == ["m1", "m2", "m3", "m0"]
    assert {r["metric"] for r in P.top_findings(df, 2).collect()} == {"m1", "m2"}


def test_flat_rows(spark):
    df = findings(
        spark,
        dict(today=9.0, expected=1991.3, z_score=-110.2),
        dict(metric="x", detector="iqr", today=45.25, lower_fence=1.0, upper_fence=3.5, iqr_distance=4.0),
        dict(metric="y", detector="isolation_forest", anomaly_score=-0.6123),
        dict(metric="big", today=12345678.0),
    )
    got = by(P.flatten_findings(df, F.lit("2026-03-01T10:00:00.123")), "metric")
    a = got["row_count"]
    assert (a["detected_at"], a["table"]) == ("2026-03-01T10:00:00", "shop.orders")
    assert (a["today"], a["expected"], a["score"]) == ("9.0", "1991.3", "-110.2")
    assert (got["x"]["today"], got["x"]["expected"], got["x"]["score"]) == ("45.25", "1.0–3.5", "4.0")
    assert (got["y"]["today"], got["y"]["expected"], got["y"]["score"]) == ("—", "—", "-0.6123")
    assert got["big"]["today"] == "12345678.0"


def test_reader_filters(spark):
    df = findings(spark, dict(severity="HIGH"), dict(severity="MEDIUM"), dict(source="b", severity="HIGH"))
    assert P.select_findings(df, ["HIGH"]).count() == 2
    assert P.select_findings(df, ["HIGH"], ["orders"], "b").count() == 1
    assert by(P.counts_by(df, "severity"), "severity")["HIGH"]["n"] == 2


# -- scores -------------------------------------------------------------------------------------


def score(spark, rows, nulls=None, rules=None):
    h = history(spark, {"row_count": [1000, 1000], **{f"null_pct.{c}": [99, v] for c, v in (nulls or {}).items()}})
    summary = None if rules is None else spark.createDataFrame([("shop", "orders", rules)], "source string, table_name string, failed long")
    return C.table_scores(h, findings(spark, *rows), summary).first()


CRITICALS = lambda n: [dict(metric=f"m{i}") for i in range(n)]


@pytest.mark.parametrize(("n", "points", "status"), [(0, 100, "HEALTHY"), (1, 85, "WARNING"), (2, 70, "WARNING"), (3, 55, "CRITICAL"), (10, 0, "CRITICAL")])
def test_critical_findings(spark, n, points, status):
    row = score(spark, CRITICALS(n))
    assert (row["score"], row["status"]) == (points, status)


def test_all_penalties(spark):
    row = score(
        spark,
        [dict(metric="a"), dict(metric="b", severity="HIGH"), dict(metric="c", severity="MEDIUM")],
        {"x": 25.0, "y": 20.0, "z": 10.0},
    )
    assert row["score"] == 100 - 15 - 8 - 3 - 5 - 2
    assert row["issues"] == ["CRITICAL: a", "High nulls: null_pct.x=25.0%"]


@pytest.mark.parametrize(("rate", "points"), [(10.0, 100), (10.01, 98), (20.0, 98), (20.01, 95)])
def test_null_steps_use_the_latest_snapshot(spark, rate, points):
    assert score(spark, [], {"x": rate})["score"] == points


def test_rule_penalty_and_texts(spark):
    row = score(spark, [dict(metric="a"), dict(metric="b", severity="HIGH")], {"x": 30.0}, rules=2)
    assert row["score"] == 100 - 15 - 8 - 5 - 20
    assert row["issues"] == ["CRITICAL anomaly: a", "HIGH anomaly: b", "High nulls in null_pct.x: 30.0%"]


@pytest.mark.parametrize(("value", "status"), [(100, "HEALTHY"), (90, "HEALTHY"), (89, "WARNING"), (70, "WARNING"), (69, "CRITICAL"), (0, "CRITICAL")])
def test_status_bounds(spark, value, status):
    assert spark.range(1).select(C.status_of(F.lit(value)).alias("s")).first()["s"] == status


def test_same_table_name_in_two_sources_is_kept_apart(spark):
    h = history(spark, {"row_count": [1]}, source="a").unionByName(history(spark, {"row_count": [1]}, source="b"))
    got = by(C.table_scores(h, findings(spark, dict(source="a"))), "source")
    assert (got["a"]["score"], got["b"]["score"]) == (85, 100)
    assert [r["source"] for r in C.worst_first(C.table_scores(h, findings(spark, dict(source="a")))).collect()] == ["a", "b"]


def test_summary(spark):
    h = history(spark, {"row_count": [1, 2, 3]}).unionByName(history(spark, {"row_count": [1]}, source="b"))
    f = findings(spark, dict(), dict(metric="x", severity="MEDIUM"))
    results = spark.createDataFrame([(True,), (True,), (False,)], "passed boolean")
    row = C.summary(h, f, C.table_scores(h, f), results).first().asDict()
    assert row == {
        "avg_dq_score": 91.0, "total_anomalies": 2, "critical": 1, "high": 0, "medium": 1, "overall_status": "CRITICAL",
        "checks_passed": 2, "checks_failed": 1, "total_snapshots": 4, "source_count": 2,
    }


# -- notes ----------------------------------------------------------------------------------------


def sentence(spark, **kw):
    return N.explain(findings(spark, kw)).first()["explanation"]


def test_row_count_sentences(spark):
    low = sentence(spark, today=9.0, expected=1991.3)
    assert "99.5%" in low and "row" in low and "pipeline" in low and "failure" in low and "shop.orders" in low
    high = sentence(spark, today=9000.0, expected=1000.0, direction="HIGH")
    assert "800.0%" in high and "above" in high and "duplicate" in high
    bare = sentence(spark, today=9.0, lower_fence=1.0, upper_fence=2.0, detector="iqr")
    assert "row count is 9.0, below the usual 1.0–2.0" in bare and "%" not in bare


@pytest.mark.parametrize(
    ("metric", "direction", "words"),
    [
        ("null_pct.total", "HIGH", ["null share of total is 45.2", "upstream", "shop.orders"]),
        ("null_pct.total", "LOW", ["null", "45.2", "default"]),
        ("mean.price", "HIGH", ["mean of price", "2160.0% above the usual 2.0", "unit"]),
        ("mean.price", "LOW", ["below"]),
        ("std.price", "HIGH", ["std of price", "outliers"]),
        ("distinct_count.status", "HIGH", ["distinct", "status", "categories"]),
        ("unknown_metric", "HIGH", ["unknown_metric", "above", "pipeline"]),
    ],
)
def test_sentences(spark, metric, direction, words):
    text = sentence(spark, metric=metric, direction=direction, today=45.2, expected=2.0)
    assert all(w in text for w in words) and text.endswith(".") and "{" not in text


def test_forest_sentence_names_the_leader(spark):
    kw = dict(metric="all_metrics_combined", detector="isolation_forest", direction="MULTIVARIATE")
    assert "row_count" in sentence(spark, top_contributors=[("row_count", 3.5)], **kw)
    text = sentence(spark, **kw)
    assert "no single one" in text and "anomalous" in text and "moved together" in text


@pytest.mark.parametrize(
    ("metric", "direction", "word"),
    [("row_count", "LOW", "pipeline"), ("row_count", "HIGH", "duplicate"), ("null_pct.email", "HIGH", "upstream"),
     ("null_pct.email", "LOW", "pipeline"), ("std.price", "HIGH", "outlier"), ("mean.x", "LOW", "unit")],
)
def test_root_causes(spark, metric, direction, word):
    r = N.root_cause(findings(spark, dict(metric=metric, direction=direction, today=9.0, expected=2.0))).first()
    assert len(r["causes"]) == 3 and len(r["what_to_check"]) == 3 and len(r["how_to_fix"]) > 10
    assert word in " ".join(r["causes"]).lower() and "shop.orders" in r["what_happened"]
    assert not any("{" in t for t in [*r["causes"], *r["what_to_check"], r["how_to_fix"], r["what_happened"]])


def test_causes_follow_the_other_findings_of_the_table(spark):
    """Nulls alone point at the source; with fewer distinct values beside them, at a join."""
    nulls = dict(metric="null_pct.country", direction="HIGH", today=40.0, expected=2.0)
    alone = N.root_cause(findings(spark, nulls)).first()
    beside = by(N.root_cause(findings(spark, nulls, dict(metric="distinct_count.country", direction="LOW", today=2.0, expected=5.0))), "metric")
    assert "leaves the field empty" in alone["causes"][0] and "join" in beside["null_pct.country"]["causes"][0]
    twice = N.root_cause(findings(spark, dict(direction="HIGH", today=2000.0, expected=1000.0))).first()
    assert twice["causes"][0].startswith("duplicate rows from a repeated write") and "second copy" in twice["how_to_fix"]


# -- roll-ups ---------------------------------------------------------------------------------------


def test_heatmaps(spark):
    import datetime as dt

    rows = [("s", "t", START + dt.timedelta(hours=h), "null_pct.a", v) for h, v in ((0, 10.0), (2, 20.0), (24, 5.0))]
    h = spark.createDataFrame(rows, "source string, table_name string, profiled_at timestamp, metric string, value double")
    mean = {str(r["date"]): r["null_pct"] for r in R.null_heatmap(h).collect()}
    last = {str(r["date"]): r["null_pct"] for r in R.null_heatmap_last(h).collect()}
    assert mean == {"2026-03-01": 15.0, "2026-03-02": 5.0} and last == {"2026-03-01": 20.0, "2026-03-02": 5.0}
    grid = R.heatmap_grid(R.null_heatmap(h), ["2026-03-01", "2026-03-02"]).first()
    assert (grid["column"], grid["2026-03-01"], grid["2026-03-02"]) == ("t.a", 15.0, 5.0)
    assert R.worst_null_columns(R.null_heatmap(h)).first()["avg_null_pct"] == 10.0


def test_chart_lines_come_from_the_first_snapshot(spark):
    h = history(spark, {"row_count": [5, 6, 7], "null_pct.a": [1, None, 3], "null_pct.late": [None, 9, 9]})
    got = {(str(r["date"]), r["metric"]): r["value"] for r in R.chart_series(h).collect()}
    assert got[("2026-03-02", "null_pct.a")] == 0.0 and got[("2026-03-03", "null_pct.a")] == 3.0
    assert not any(m == "null_pct.late" for _, m in got) and len(got) == 6


def test_large_runs_are_whole(spark):
    from pyspark.sql import functions as F

    snaps = spark.range(3000).selectExpr(
        "concat('s', id % 3) source", "concat('t', id % 750) table_name", "timestamp '2026-03-01 00:00:00' + make_interval(0, 0, 0, 0, id div 750) profiled_at", "id row_count"
    )
    runs = R.run_history(snaps).collect()
    assert [(r["table_count"], r["source_count"], r["row_count"]) for r in runs] == [(750, 3, sum(range(750 * k, 750 * k + 750))) for k in (3, 2, 1, 0)]
    assert R.run_tables(snaps, per_run=1000, runs=2).groupBy("run_at").agg(F.count("*").alias("n")).where("n = 750").count() == 2


def test_runs(spark):
    import datetime as dt

    t = START
    rows = [("a", "t1", t, 1), ("b", "t2", t + dt.timedelta(seconds=30), 2), ("a", "t1", t + dt.timedelta(minutes=5), 4)]
    snaps = spark.createDataFrame(rows, "source string, table_name string, profiled_at timestamp, row_count long")
    runs = R.run_history(snaps).collect()
    assert [(r["table_count"], r["source_count"], r["row_count"]) for r in runs] == [(1, 1, 4), (2, 2, 3)]
    assert R.run_history(snaps, runs=1).count() == 1 and R.run_tables(snaps, runs=1).count() == 1
    assert R.run_tables(snaps, per_run=1).count() == 2
    log = spark.createDataFrame([(t, "slack", "CRITICAL"), (t, "email", "HIGH")], "sent_at timestamp, channel string, severity string")
    assert tuple(R.run_totals(snaps, log).first()) == (2, 3, 2, 2)
    assert tuple(R.alert_totals(log).first()) == (2, 1, 2)
    assert R.alerts_per_day(log).first()["alerts"] == 2
