from __future__ import annotations

import datetime as dt
import hashlib
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from plumbline.operators.profile import bucket_history, profile_table, value_frequencies
from plumbline.operators.snapshots import decode_history, history_from_profiles, to_snapshots
from tests.helpers import by, final_plan

def at():
    return F.lit("2026-01-01 00:00:00").cast("timestamp")


def prof(df, **kw):
    return by(profile_table(df, "s", "t", at(), **kw), "column")


@pytest.fixture(scope="module")
def mixed(spark):
    rows = [
        (1, 10.0, "a", True, dt.date(2026, 1, 1), None, [1]),
        (2, float("nan"), "b", False, dt.date(2026, 1, 2), None, [1]),
        (3, -0.0, "b", True, None, None, [2]),
        (4, 0.0, None, None, dt.date(2026, 1, 2), None, None),
    ]
    return spark.createDataFrame(
        rows, "id int, x double, s string, flag boolean, d date, empty string, arr array<int>"
    )


def test_counts_and_moments(mixed):
    p = prof(mixed)
    assert p["id"]["row_count"] == 4 and p["id"]["null_count"] == 0
    assert (p["id"]["min"], p["id"]["max"], p["id"]["mean"]) == (1.0, 4.0, 2.5)
    assert p["id"]["std"] == round(math.sqrt(5 / 3), 4)
    assert p["id"]["distinct_pct"] == 100.0
    # NaN is missing; both zeros are one value
    assert (p["x"]["null_count"], p["x"]["null_pct"], p["x"]["distinct_count"]) == (1, 25.0, 2)
    assert p["x"]["mean"] == round(10 / 3, 4)
    assert (p["flag"]["mean"], p["flag"]["distinct_count"]) == (0.6667, 2)
    assert p["d"]["distinct_count"] == 2 and p["d"]["min"] is None
    assert p["arr"]["distinct_count"] == 2
    assert (p["empty"]["null_pct"], p["empty"]["distinct_count"], p["empty"]["distinct_pct"]) == (100.0, 0, 0.0)


def test_positions_and_types(mixed):
    p = prof(mixed)
    assert [c for c, _ in sorted(p.items(), key=lambda kv: kv[1]["position"])] == mixed.columns
    assert p["id"]["dtype"] == "int" and p["x"]["dtype"] == "double"


def test_top_values_only_for_text_and_ties_by_value(spark):
    df = spark.createDataFrame(
        [(v, i) for i, v in enumerate(["z"] * 3 + ["b"] * 2 + ["a"] * 2 + ["c", "d", "e", None])], "s string, n int"
    )
    p = prof(df)
    assert [(t["value"], t["count"]) for t in p["s"]["top_values"]] == [("z", 3), ("a", 2), ("b", 2), ("c", 1), ("d", 1)]
    assert p["n"]["top_values"] is None


def test_empty_table(spark):
    p = prof(spark.createDataFrame([], "a int, s string"))
    assert p["a"]["row_count"] == 0 and p["a"]["null_pct"] is None
    assert p["a"]["distinct_count"] == 0 and p["a"]["distinct_pct"] == 0.0
    assert p["s"]["top_values"] == []


def test_single_row_has_no_std(spark):
    p = prof(spark.createDataFrame([(5.0,)], "a double"))
    assert p["a"]["mean"] == 5.0 and p["a"]["std"] is None


def test_odd_column_names(spark):
    df = spark.createDataFrame([(1, "x"), (1, "y")], "`a.b` int, `it's` string")
    p = prof(df)
    assert p["a.b"]["distinct_count"] == 1 and p["it's"]["distinct_count"] == 2


def test_approximate_distinct(spark):
    p = prof(spark.range(5000).withColumn("k", F.col("id") % 10), approx_distinct=True)
    assert abs(p["id"]["distinct_count"] - 5000) < 250 and p["k"]["distinct_count"] == 10


def test_text_frequencies_are_shuffled_once(spark):
    df = spark.range(100).select(F.col("id").cast("string").alias("s"))
    assert "ReusedExchange" in final_plan(profile_table(df, "s", "t", at()))


def test_top_values_limit_before_shuffle(spark):
    df = spark.range(100).select(F.col("id").cast("string").alias("s"))
    assert final_plan(profile_table(df, "s", "t", at())).count("WindowGroupLimit") >= 2


def run_nodes(df):
    """Collect ``df`` and return the nodes of the plan that ran, each with its class name."""
    df.collect()
    todo, found = [df._jdf.queryExecution().executedPlan()], []
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        found.append((name, node))
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        else:
            todo += [node.children().apply(i) for i in range(node.children().size())]
    return found


def test_columns_are_read_once_beside_the_moments(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    scans = [n for name, n in run_nodes(profile_table(df, "s", "t", at())) if name == "FileSourceScanExec"]
    counts = Counter(c for n in scans for c in n.requiredSchema().fieldNames())
    # no text here is long, so the columns of text are not read for a third time
    assert counts == dict.fromkeys(df.columns, 2)


def long_texts(n):
    head = "<html>" * 30
    return [head + c * 5 for c in "aaaabbbcc" + "".join(chr(0x4E00 + i) for i in range(n))] + ["short", "short", None, "", head[:64], head[:65]]


def test_top_values_of_long_texts_equal_brute_force(spark):
    texts = long_texts(40)
    rows = [(t, i % 2) for i, t in enumerate(texts)]
    p = prof(spark.createDataFrame(rows, "s string, n int").repartition(5))

    def key(t):
        b = t.encode()
        return (t[:32] + hashlib.md5(b).hexdigest() + str(len(b)) if len(b) > 64 else t).encode()

    counts = Counter(t for t in texts if t is not None)
    expected = sorted(counts.items(), key=lambda e: (-e[1], key(e[0])))[:5]
    assert [(t["value"], t["count"]) for t in p["s"]["top_values"]] == expected
    assert p["s"]["distinct_count"] == len(counts) and p["n"]["distinct_count"] == 2


def test_long_texts_are_not_shuffled(spark):
    """The texts are 20 times as large as all that the profile shuffles."""
    df = spark.range(400).select(F.concat(F.repeat(F.lit("x"), 20_000), F.col("id").cast("string")).alias("s"))
    frame = profile_table(df, "s", "t", at())
    sizes = [n.metrics().apply("dataSize").value() for name, n in run_nodes(frame) if name == "ShuffleExchangeExec"]
    assert frame.first()["distinct_count"] == 400 and sizes and sum(sizes) < 400 * 20_000 / 20


def test_frequencies_rename(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,)], "x string")
    assert [tuple(r) for r in value_frequencies(df, {"x": "shown"}).collect()] == [("shown", "a", 2)]


def test_snapshot_json_round_trip(mixed):
    profiles = profile_table(mixed, "s", "t", at())
    snaps = to_snapshots(profiles)
    assert snaps.count() == 1
    a = sorted(map(tuple, decode_history(snaps).collect()))
    b = sorted(map(tuple, history_from_profiles(profiles).collect()))
    assert a == b
    metrics = {r[3]: r[4] for r in a}
    assert metrics["row_count"] == 4.0 and metrics["null_pct.x"] == 25.0 and metrics["distinct_count.s"] == 2.0
    assert "mean.s" not in metrics


def test_bucket_history_matches_profiles(spark):
    rows = [(d, float(v), u) for d, v, u in [("a", 1, 1), ("a", 3, 1), ("a", 5, 2), ("b", 7, 3), ("b", 7, None)]]
    df = spark.createDataFrame(rows, "d string, v double, u int")
    h = bucket_history(
        df, source=F.lit("s"), table_name=F.lit("t"), profiled_at=F.col("d"),
        nulls_of=["u"], stats_of=["v"], distinct_of=["u", "v"],
    )
    got = {(r["profiled_at"], r["metric"]): r["value"] for r in h.collect()}
    assert got[("a", "row_count")] == 3 and got[("b", "row_count")] == 2
    assert got[("b", "null_pct.u")] == 50.0
    assert (got[("a", "mean.v")], got[("a", "std.v")]) == (3.0, 2.0)
    assert got[("b", "std.v")] == 0.0
    assert (got[("a", "distinct_count.u")], got[("b", "distinct_count.u")]) == (2, 1)
    assert got[("b", "distinct_count.v")] == 1


def test_column_named_like_a_key(spark):
    df = spark.createDataFrame([("x", 1), ("y", 1)], "table_name string, d int")
    h = bucket_history(
        df, source=F.lit("s"), table_name=F.lit("t"), profiled_at=F.col("d"), distinct_of=["table_name"]
    )
    assert {r["metric"]: r["value"] for r in h.collect()}["distinct_count.table_name"] == 2


def test_fingerprints_are_json_and_come_back(spark):
    import json

    from plumbline.operators.schema import drift, fingerprint, schema_rows

    rows = spark.createDataFrame([("s", "t", 'a"b\\c', "INT"), ("s", "t", "ü,:", "STRING")], "source string, table_name string, column string, type string")
    stored = fingerprint(rows)
    assert json.loads(stored.first()["columns_json"]) == {'a"b\\c': "INT", "ü,:": "STRING"}
    assert sorted(map(tuple, schema_rows(stored).collect())) == sorted(map(tuple, rows.collect()))
    later = spark.createDataFrame([("s", "t", 'a"b\\c', "BIGINT"), ("s", "t", "new", "INT")], rows.schema)
    changes = {r["change"] for r in drift(schema_rows(stored), schema_rows(fingerprint(later)), ["source", "table_name"]).collect()}
    assert changes == {"ADDED", "DROPPED", "TYPE CHANGED"}


def test_equal_times_are_settled(spark):
    from plumbline.operators.snapshots import latest_snapshot

    rows = spark.createDataFrame([("s", "t", "2026-01-01", 5, "b1"), ("s", "t", "2026-01-01", 4, "b2")], "source string, table_name string, profiled_at string, row_count int, batch string")
    assert latest_snapshot(rows).first()["batch"] == "b2" and latest_snapshot(rows.drop("batch")).first()["row_count"] == 5
