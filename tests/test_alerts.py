from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import alerts as A
from plumbline.session import stored
from tests.helpers import START, by, findings, final_plan

SCHEMA = "alert_key string, channel string, sent_at timestamp, severity string, summary string"


def alerts(spark, rows):
    """Rows ``(key, channel, seconds)``."""
    return spark.createDataFrame(
        [(k, c, START + dt.timedelta(seconds=s), "HIGH", f"{k} {s}") for k, c, s in rows], SCHEMA
    )


def seconds(df):
    return sorted((r["alert_key"], r["channel"], int((r["sent_at"] - START).total_seconds())) for r in df.collect())


def greedy(rows, window):
    """Brute force: walk each key in time order."""
    last, out = {}, []
    for k, c, s in sorted(set(rows), key=lambda r: r[2]):
        if (k, c) not in last or s >= last[k, c] + window:
            last[k, c] = s
            out.append((k, c, s))
    return sorted(out)


def test_window_edges(spark):
    rows = [("k", "slack", s) for s in (0, 1, 3599, 3600, 7199, 7201)]
    assert [s for *_, s in seconds(A.suppress(alerts(spark, rows)))] == [0, 3600, 7201]


def test_suppressed_alerts_do_not_extend_the_window(spark):
    rows = [("k", "slack", 40 * 60 * i) for i in range(6)]
    assert [s // 60 for *_, s in seconds(A.suppress(alerts(spark, rows)))] == [0, 80, 160]


def test_keys_and_channels_are_separate(spark):
    rows = [("a", "slack", 0), ("a", "email", 1), ("b", "slack", 2), ("a", "slack", 3)]
    assert seconds(A.suppress(alerts(spark, rows))) == [("a", "email", 1), ("a", "slack", 0), ("b", "slack", 2)]


def test_one_of_equal_instants(spark):
    df = spark.createDataFrame([("k", "c", START, "HIGH", "b"), ("k", "c", START, "HIGH", "a")], SCHEMA)
    assert [r["summary"] for r in A.suppress(df).collect()] == ["a"]


def shapes():
    r = random.Random(5)
    return {
        "dense": [("k", "c", r.randint(0, 40_000)) for _ in range(1500)],
        "sparse": [("k", "c", r.randint(0, 3_000_000)) for _ in range(300)],
        "regular": [("k", "c", 60 * i) for i in range(1200)],  # chains that never merge
        "bursts": [("k", "c", b * 90_000 + r.randint(0, 9_000)) for b in range(12) for _ in range(60)],
        "before 1970": [("k", "c", -1_780_000_000 + 977 * i) for i in range(300)],
        "several": [(r.choice("ab"), r.choice("xy"), r.randint(0, 200_000)) for _ in range(900)],
    }


@pytest.mark.parametrize("name", list(shapes()))
@pytest.mark.parametrize(("blocks", "fan"), [(None, 32), (7, 2), (23, 3)])
def test_suppression_equals_brute_force(spark, name, blocks, fan):
    """Also where a key goes over many blocks and their step lists meet in several levels."""
    rows = shapes()[name]
    assert seconds(A.suppress(alerts(spark, rows), 60, blocks=blocks, fan=fan)) == greedy(rows, 3600)


def test_blocks_do_not_grow_with_the_input(spark, monkeypatch):
    """Partitions merged by their bytes would put all these alerts into one or two blocks."""
    kept = {}
    keep = lambda df, name: kept.setdefault(name, stored(df, name)) if name == "alert_blocks" else stored(df, name)
    monkeypatch.setattr(A, "stored", keep)
    monkeypatch.setattr(A, "BLOCK_ROWS", 200)
    rows = shapes()["dense"]
    assert seconds(A.suppress(alerts(spark, rows))) == greedy(rows, 3600)
    sizes = [r["count"] for r in kept["alert_blocks"].groupBy("block").count().collect()]
    assert len(sizes) > 4 and max(sizes) <= 400


def test_hot_key_beside_small_keys(spark):
    r = random.Random(1)
    rows = [("hot", "c", r.randint(0, 500_000)) for _ in range(400)] + [(f"k{i}", "c", r.randint(0, 9000)) for i in range(200)]
    assert seconds(A.suppress(alerts(spark, rows), blocks=9, fan=2)) == greedy(rows, 3600)


def test_hot_key_of_an_alert_a_second(spark):
    """Chains that never merge: every block has a step for each second of a window."""
    hot = spark.range(0, 100_000).selectExpr("'k' alert_key", "'c' channel", "timestamp '2026-03-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, id) sent_at", "'HIGH' severity", "'' summary")
    sent = [r["sent_at"] for r in A.suppress(hot, 60, blocks=12, fan=3).collect()]
    assert len(sent) == 28 and len({(b - a).total_seconds() for a, b in zip(sorted(sent), sorted(sent)[1:])}) == 1


def test_null_keys_and_channels_are_keys(spark):
    rows = [(k, c, START + dt.timedelta(seconds=s), "HIGH", "x") for k in (None, "k") for c in (None, "c") for s in range(0, 20_000, 97)]
    got = A.suppress(spark.createDataFrame([*rows, ("k", "c", None, "HIGH", "x")], SCHEMA), 60, blocks=5, fan=2)
    want = [s for s in range(0, 20_000, 97)]
    sent, at = [], -3600
    for s in want:
        if s >= at + 3600:
            sent.append(s)
            at = s
    assert got.groupBy("alert_key", "channel").count().collect() and {r["count"] for r in got.groupBy("alert_key", "channel").count().collect()} == {len(sent)}
    assert got.count() == 4 * len(sent)


def test_steps_shrink_when_chains_merge():
    us = np.unique(np.random.default_rng(0).integers(0, 48 * 3_600_000_000, 200_000))
    at, _ = A._steps(us, 3_600_000_000)
    assert len(at) < len(us) / 150


def test_routing_and_alert_rows(spark):
    f = findings(spark, dict(), dict(metric="a", severity="HIGH"), dict(metric="b", severity="MEDIUM"))
    assert {r["metric"] for r in A.route(f).collect()} == {"row_count", "a"}
    assert A.route(f, ["MEDIUM"]).count() == 1
    import hashlib

    row = by(A.to_alerts(f, "slack", F.lit(START)), "metric")["row_count"]
    assert row["alert_key"] == hashlib.md5(b"shop.orders|row_count|CRITICAL").hexdigest()


@pytest.mark.parametrize(("minutes", "kept"), [(59, 0), (60, 1), (61, 1)])
def test_log_window(spark, minutes, kept):
    log = alerts(spark, [("k", "slack", -86_400), ("k", "slack", 0)])
    now = alerts(spark, [("k", "slack", 60 * minutes)])
    assert A.not_recently_sent(now, log).count() == kept
    assert A.not_recently_sent(now.withColumn("channel", F.lit("email")), log).count() == 1
    assert A.not_recently_sent(now, log.limit(0)).count() == 1


def test_first_per_table(spark):
    f = findings(
        spark, dict(metric="b", severity="HIGH"), dict(metric="a", severity="HIGH"), dict(metric="z"), dict(table_name="t2", severity="HIGH")
    )
    got = by(A.first_per_table(A.to_alerts(f, "scheduler", F.lit(START))), "table_name")
    assert got["orders"]["metric"] == "z" and got["t2"]["metric"] == "row_count"


def test_report_alerts(spark):
    failed = spark.createDataFrame([(False,), (True,)], "passed boolean")
    at = F.lit(START)
    rows = by(A.report_alerts(findings(spark, dict()), failed, "slack", at), "severity")
    assert rows["CRITICAL"]["summary"].startswith("1 anomalies") and rows["HIGH"]["summary"].startswith("1 failed rules")
    medium = findings(spark, dict(severity="MEDIUM"))
    assert A.report_alerts(medium, failed.filter("passed"), "slack", at).count() == 0


def test_newest(spark):
    rows = [("k", "c", i) for i in range(9)]
    assert [s for *_, s in seconds(A.newest_alerts(alerts(spark, rows), 3))] == [6, 7, 8]
    assert "TakeOrderedAndProject" in final_plan(A.newest_alerts(alerts(spark, rows), 3))
