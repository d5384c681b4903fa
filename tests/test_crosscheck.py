from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from plumbline.operators import crosscheck as X
from plumbline.operators import schema as K
from plumbline.operators import snapshots as S
from tests.helpers import START, by, final_plan, history

SNAPS = "source string, table_name string, profiled_at timestamp, row_count long"


def snaps(spark, *rows):
    return spark.createDataFrame([(s, t, START + dt.timedelta(days=d), n) for s, t, d, n in rows], SNAPS)


@pytest.mark.parametrize(
    ("small", "severity"), [(500, None), (499, None), (490, "MEDIUM"), (200, "MEDIUM"), (199, "HIGH"), (190, "HIGH"), (1000, None)]
)
def test_row_count_steps(spark, small, severity):
    """Flagged above 50 %, HIGH above 80 %, judged on one decimal."""
    got = X.row_count_consistency(snaps(spark, ("a", "Orders", 0, 1), ("a", "Orders", 1, 1000), ("b", "orders", 1, small))).collect()
    diff = round((1000 - small) / 10, 1)
    expected = None if diff <= 50 else "HIGH" if diff > 80 else "MEDIUM"
    assert (got[0]["severity"] if got else None) == expected
    if severity:
        assert got[0]["severity"] == severity and got[0]["subject"] == "orders"
        assert got[0]["details"] == {"a": 1000.0, "b": float(small)}


def test_row_counts_need_two_sources_and_rows(spark):
    assert X.row_count_consistency(snaps(spark, ("a", "t", 0, 9), ("a", "T", 0, 900))).count() == 0
    assert X.row_count_consistency(snaps(spark, ("a", "t", 0, 0), ("b", "t", 0, 0))).count() == 0


@pytest.mark.parametrize(
    ("low", "high", "severity"), [(0, 30, None), (0, 30.1, "MEDIUM"), (10, 70, "MEDIUM"), (9, 69.1, "HIGH"), (0, 60.1, "HIGH")]
)
def test_null_rate_steps(spark, low, high, severity):
    h = history(spark, {"null_pct.Email": [99, low]}, source="a").unionByName(
        history(spark, {"null_pct.email": [high]}, source="b", table="people")
    )
    got = X.null_rate_consistency(h).collect()
    assert (got[0]["severity"] if got else None) == severity


def test_null_rate_takes_last_table_by_name(spark):
    h = history(spark, {"null_pct.c": [90]}, source="a", table="t1")
    h = h.unionByName(history(spark, {"null_pct.c": [10]}, source="a", table="t2"))
    h = h.unionByName(history(spark, {"null_pct.c": [0]}, source="b", table="t1"))
    assert X.null_rate_consistency(h).count() == 0
    assert by(X.null_rate_consistency(h, by_table=True), "subject")["t1.c"]["diff"] == 90.0


def test_growth_halves(spark):
    """Three rows split 1 / 2; a half takes the oldest row of a table."""
    g = by(X.source_growth(snaps(spark, ("a", "t", 0, 100), ("a", "t", 1, 150), ("a", "t", 2, 220))), "source")
    assert (g["a"]["rows_now"], g["a"]["rows_before"], g["a"]["growth_pct"]) == (220, 100, 120.0)
    assert X.source_growth(snaps(spark, ("a", "t", 0, 100))).count() == 0
    assert X.source_growth(snaps(spark, ("a", "t", 0, 0), ("a", "t", 1, 5))).count() == 0
    many = snaps(spark, *[("a", "t", d, 100 + d) for d in range(14)])
    g = X.source_growth(many).first()
    assert (g["rows_now"], g["rows_before"]) == (109, 104)


def test_growth_compares_the_same_tables(spark):
    """More tables than runs: every table stands in both halves, one with a single run in none."""
    rows = [("a", f"t{i}", d, 100 * (i + 1) + d) for i in range(25) for d in range(4)] + [("a", "single", 3, 9999)]
    g = X.source_growth(snaps(spark, *rows)).first()
    assert (g["rows_now"], g["rows_before"]) == (sum(100 * (i + 1) + 2 for i in range(25)), sum(100 * (i + 1) for i in range(25)))


@pytest.mark.parametrize(
    ("a", "b", "found"), [((100, 130), (100, 90), 1), ((100, 110), (100, 90), 0), ((100, 111), (100, 90), 1), ((100, 150), (100, 101), 0)]
)
def test_volume_divergence(spark, a, b, found):
    s = snaps(spark, ("a", "t", 0, a[0]), ("a", "t", 1, a[1]), ("b", "t", 0, b[0]), ("b", "t", 1, b[1]))
    got = X.volume_divergence(s).collect()
    assert len(got) == found
    if found:
        assert got[0]["severity"] == "HIGH" and got[0]["subject"] == "a,b" and set(got[0]["details"]) == {"a", "b"}


def test_missing_tables(spark):
    s = snaps(spark, ("a", "t", 0, 1), ("b", "T", 0, 1), ("a", "only_a", 0, 1), ("c", "t", 0, 1))
    got = by(X.missing_tables(s), "subject")
    assert set(got) == {"only_a"} and got["only_a"]["missing_from"] == ["b", "c"] and got["only_a"]["present_in"] == ["a"]
    assert X.missing_tables(snaps(spark, ("a", "t", 0, 1))).count() == 0
    text = final_plan(X.missing_tables(s))
    assert "CartesianProduct" not in text and "BroadcastNestedLoop" not in text


def test_report(spark):
    issues = spark.createDataFrame([("MEDIUM",), ("HIGH",)], "severity string")
    assert tuple(X.cross_report(issues).first()) == (2, 1, 1, "HIGH")
    assert X.cross_report(issues.filter("severity = 'MEDIUM'")).first()["overall_status"] == "MEDIUM"
    assert X.cross_report(issues.limit(0)).first()["overall_status"] == "CLEAN"


# -- snapshots ---------------------------------------------------------------------------------------


def test_latest_and_delta(spark):
    s = snaps(spark, ("a", "t", 0, 5), ("a", "t", 1, 8), ("a", "u", 0, 3))
    got = by(S.row_count_delta(s), "table_name")
    assert (got["t"]["latest"], got["t"]["previous"], got["t"]["delta"]) == (8, 5, 3)
    assert (got["u"]["latest"], got["u"]["delta"]) == (3, 0)
    assert by(S.latest_snapshot(s), "table_name")["t"]["row_count"] == 8
    assert S.recent_history(s, 1).count() == 2
    assert "WindowGroupLimit" in final_plan(S.latest_snapshot(s))


def test_tie_break(spark):
    s = snaps(spark, ("a", "t", 0, 5), ("a", "t", 0, 8))
    assert S.latest_snapshot(s, "row_count").first()["row_count"] == 8


# -- schemas -------------------------------------------------------------------------------------------


def test_fingerprint_is_md5_of_sorted_json(spark):
    import hashlib
    import json

    df = spark.createDataFrame([], "b string, a int")
    row = K.fingerprint(K.declared_schema(spark, df, "s", "t")).first()
    text = json.dumps({"b": "STRING", "a": "INT"}, sort_keys=True)
    assert row["columns_json"] == text and row["fingerprint"] == hashlib.md5(text.encode()).hexdigest()
    other = K.fingerprint(K.declared_schema(spark, spark.createDataFrame([], "a int, b string"), "s", "t")).first()
    assert other["fingerprint"] == row["fingerprint"]


def test_drift(spark):
    old = K.declared_schema(spark, spark.createDataFrame([], "a int, b int, c int"), "s", "t")
    new = K.declared_schema(spark, spark.createDataFrame([], "b bigint, c int, d int"), "s", "t")
    got = {r["column"]: r["issue"] for r in K.drift(old, new).collect()}
    assert got == {"a": "DROPPED column: a", "d": "ADDED column: d", "b": "TYPE CHANGED: b  INT -> BIGINT"}
    assert K.drift(old, old).count() == 0


def test_observed_schema(spark):
    df = spark.createDataFrame([("x", 1, None), ("x", None, None), ("y", 1, 2)], "k string, a int, b int")
    got = {(r["k"], r["column"]) for r in K.observed_schema(df, {"k": F.col("k")}, ["a", "b"]).collect()}
    assert got == {("x", "a"), ("y", "a"), ("y", "b")}


def test_last_fingerprint(spark):
    rows = [("s", "t", START, "old"), ("s", "t", START + dt.timedelta(days=1), "new")]
    df = spark.createDataFrame(rows, "source string, table_name string, profiled_at timestamp, schema_fingerprint string")
    assert K.last_fingerprint(df).first()["schema_fingerprint"] == "new"
