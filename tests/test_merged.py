"""The report over all three detectors against a plain merge of their rows."""

from __future__ import annotations

from collections import Counter

import pytest

from plumbline.operators import detect as D
from plumbline.operators.iforest import isolation_forest
from plumbline.operators.score import table_scores
from tests.helpers import by, history
from tests.test_detect import forest_series
from workload import merged as M

WORST = ["MEDIUM", "HIGH", "CRITICAL"]
ORDER = ["zscore", "iqr", "isolation_forest"]


def plain_merge(h):
    """The worst row per table and metric of what the three detectors say, on equal severity the earlier detector's."""
    best = {}
    for r in [*D.zscore(h).collect(), *D.iqr(h).collect(), *isolation_forest(h).collect()]:
        key = (r["source"], r["table_name"], r["profiled_at"], r["metric"])
        rank = (WORST.index(r["severity"]), -ORDER.index(r["detector"]))
        if key not in best or rank > best[key][0]:
            best[key] = (rank, r)
    return {k: r for k, (_, r) in best.items()}


KEY = ("source", "table_name", "profiled_at", "metric")


def test_merge_of_three_detectors_equals_brute_force(spark):
    odd = history(spark, forest_series(row_count=50, null_pct__total=40, mean__total=5000), table="odd")
    joint = history(spark, forest_series(seed=7, row_count=1045, null_pct__total=2.7, mean__total=522), table="joint")
    usual = history(spark, forest_series(seed=9), table="usual")
    h = odd.unionByName(joint).unionByName(usual)
    want, got = plain_merge(h), by(M.merged(h), *KEY)
    assert got == want
    assert {k[3] for k in want if k[1] == "odd"} >= {"row_count", "all_metrics_combined"}
    assert ("odd", "isolation_forest") in {(r["table_name"], r["detector"]) for r in got.values()}


def test_forest_findings_lower_scores(spark):
    h = history(spark, forest_series(row_count=50, null_pct__total=40, mean__total=5000))
    findings = M.merged(h)
    alone = findings.filter("detector = 'isolation_forest'")
    assert alone.count() == 1
    assert table_scores(h, alone).first()["score"] < table_scores(h, findings.limit(0)).first()["score"]


@pytest.fixture(scope="module")
def driver(spark, sf_dir):
    return M.history_of(spark, sf_dir)


@pytest.fixture(scope="module")
def expected(driver):
    return plain_merge(driver)


def test_queries_equal_a_plain_merge(spark, sf_dir, driver, expected):
    rows = by(M.merged_findings(spark, sf_dir), *KEY)
    assert rows.keys() == expected.keys() and len(rows) > 5
    for k, r in expected.items():
        assert all(rows[k][c] == r[c] for c in (*M.SHOWN, "anomaly_score"))
        assert rows[k]["contributors"] == "; ".join(f"{c['metric']}={c['z_score']}" for c in r["top_contributors"] or [])
    severities = Counter(r["severity"] for r in expected.values())
    totals = M.merged_totals(spark, sf_dir).first().asDict()
    assert (totals["total_anomalies"], *(totals[s.lower()] for s in WORST)) == (len(expected), *(severities[s] for s in WORST))
    per_table = Counter(k[:2] for k in expected)
    report = by(M.merged_report(spark, sf_dir), "source", "table_name")
    assert report.keys() == {(r["source"], r["table_name"]) for r in driver.select("source", "table_name").distinct().collect()}
    assert all(r["anomaly_count"] == per_table[k] and (r["status"] == "ANOMALOUS") == (per_table[k] > 0) for k, r in report.items())


def test_scores_causes_and_exports_cover_every_finding(spark, sf_dir, driver, expected):
    scores = by(M.merged_scores(spark, sf_dir), "source", "table_name")
    best = M.merged(driver)
    for k, r in by(table_scores(driver, best), "source", "table_name").items():
        assert (scores[k]["score"], scores[k]["issues"]) == (r["score"], "; ".join(r["issues"]))
    told = M.merged_explained(spark, sf_dir).collect()
    assert {(r["source"], r["table_name"], r["metric"], r["detector"]) for r in told} == {(k[0], k[1], k[3], r["detector"]) for k, r in expected.items()}
    assert len(told) == len(expected) and all(r["explanation"] and r["causes"] and r["how_to_fix"] for r in told)
    exported = Counter((r["Table"], r["Metric"], r["Detector"], r["Severity"]) for r in M.merged_csv(spark, sf_dir).collect())
    assert exported == Counter((f"{k[0]}.{k[1]}", k[3], r["detector"], r["severity"]) for k, r in expected.items())


def test_alerts_are_those_of_the_merged_findings(spark, sf_dir, expected):
    alerts = M.merged_alerts(spark, sf_dir).collect()
    assert 0 < len(alerts) <= len(expected) and len({r["alert_key"] for r in alerts}) == len(alerts)
    loud = [r for r in expected.values() if r["severity"] in ("CRITICAL", "HIGH")]
    assert sum(r["severity"] in ("CRITICAL", "HIGH") for r in alerts) == len(loud)
