from __future__ import annotations

import datetime as dt
import json
import re

import pytest
from pyspark.sql import functions as F

from plumbline.operators.annotate import explain
from plumbline.plans import monitor
from plumbline.session import shared_dir, stored
from plumbline.sources import sinks
from plumbline.sources import specs as P
from plumbline.sources.store import Store
from tests.helpers import START, findings, plan


@pytest.mark.parametrize(
    ("spec", "url"),
    [
        ({"dialect": "sqlite", "path": "./a.db"}, "jdbc:sqlite:./a.db"),
        ({"dialect": "postgresql", "host": "h", "database": "d"}, "jdbc:postgresql://h:5432/d"),
        ({"dialect": "mysql", "host": "h", "database": "d"}, "jdbc:mysql://h:3306/d"),
        ({"dialect": "mysql", "host": "h", "port": 3307, "database": "d"}, "jdbc:mysql://h:3307/d"),
        ({"dialect": "cloud", "url": "jdbc:any:thing"}, "jdbc:any:thing"),
    ],
)
def test_jdbc_urls(spec, url):
    assert P.from_mapping({"name": "s", **spec}).url == url


def test_unknown_dialect_needs_a_url():
    with pytest.raises(ValueError):
        P.from_mapping({"name": "s", "dialect": "odd"})


def test_jdbc_options_carry_partitioning():
    split = {"partitionColumn": "id", "lowerBound": 1, "upperBound": 9, "numPartitions": 4}
    s = P.from_mapping({"name": "s", "dialect": "mysql", "host": "h", "database": "d", "user": "u", "partitioning": {"t": split}})
    options = P.jdbc_options(s, "t")
    assert options["numPartitions"] == "4" and options["dbtable"] == "t" and options["user"] == "u"
    assert "numPartitions" not in P.jdbc_options(s, "other")
    bad = P.from_mapping({"name": "s", "dialect": "mysql", "host": "h", "database": "d", "partitioning": {"t": {"partitionColumn": "id"}}})
    with pytest.raises(ValueError):
        P.jdbc_options(bad, "t")


def test_sources_file(tmp_path):
    path = tmp_path / "sources.yaml"
    path.write_text("sources:\n- name: a\n  dialect: parquet\n  path: /x\n- name: b\n  dialect: sqlite\n  path: y.db\n  description: second\n")
    a, b = P.load_sources(str(path))
    assert (a.kind, a.path, b.kind, b.description) == ("parquet", "/x", "jdbc", "second")


@pytest.fixture
def files(spark, tmp_path):
    base = tmp_path / "src"
    df = spark.createDataFrame([(i, i % 3, f"v{i % 5}") for i in range(30)], "id long, g long, s string")
    for kind in P.FILE_KINDS:
        writer = df.write.option("header", True)
        writer.format(kind).save(f"{base}/{kind}/one.{kind}")
        writer.format(kind).save(f"{base}/{kind}/two")
    return base


@pytest.mark.parametrize("kind", P.FILE_KINDS)
def test_file_sources(spark, files, kind):
    s = P.Source("s", kind, f"{files}/{kind}")
    assert P.list_tables(spark, s) == ["one", "two"]
    for t in ("one", "two"):
        df = P.read_table(spark, s, t)
        assert df.count() == 30 and set(df.columns) == {"id", "g", "s"}
    assert dict(P.columns_of(P.read_table(spark, P.Source("s", "parquet", f"{files}/parquet"), "one")))["id"] == "bigint"


def test_catalog_source(spark):
    spark.range(3).createOrReplaceTempView("some_view")
    s = P.Source("s", "catalog")
    assert "some_view" in P.list_tables(spark, s)
    assert P.read_table(spark, s, "some_view").count() == 3


def test_one_failure_does_not_stop_the_scan(spark, files):
    good = P.Source("good", "parquet", f"{files}/parquet", tables=("one", "absent"))
    scan = P.scan_sources(spark, [P.Source("gone", "parquet", "/no/such/dir"), good, P.Source("bad", "odd", tables=("t",))])
    assert [(s, t) for s, t, _ in scan.tables] == [("good", "one")]
    assert [(s, t) for s, t, _ in scan.errors] == [("gone", None), ("good", "absent"), ("bad", "t")]


def test_pruning_and_pushdown_reach_the_scan(spark, files):
    df = P.read_table(spark, P.Source("s", "parquet", f"{files}/parquet"), "one").filter("g = 1").select("id", "g")
    text = plan(df)
    assert "EqualTo(g,1)" in text and "ReadSchema: struct<id:bigint,g:bigint>" in text


def test_table_that_breaks_while_reading_does_not_stop_others(spark, tmp_path):
    bad = spark.range(3).selectExpr("CAST(concat('x', id) AS INT) AS n")  # fails only when it runs
    store = Store(spark, str(tmp_path))
    tables = [("s", "a", spark.range(5)), ("s", "bad", bad), ("s", "b", spark.range(6))]
    errors = monitor.store_snapshots(spark, tables, store, START)
    assert len(errors) == 1 and errors[0].startswith("s.bad: ")
    assert {r["table_name"]: r["row_count"] for r in store.snapshots().collect()} == {"a": 5, "b": 6}


@pytest.mark.parametrize(("url", "table"), [("jdbc:sqlite:x", "sqlite_master"), ("jdbc:postgresql://h/d", "information_schema.tables")])
def test_jdbc_catalogue(spark, url, table):
    name, column, condition = P._jdbc_catalogue(url)
    assert name == table
    df = spark.createDataFrame([("table", "t", "t", "public"), ("index", "i", "i", "sys")], "type string, name string, table_name string, table_schema string")
    assert [r[0] for r in df.filter(condition).selectExpr(column).collect()] == ["t"]


def test_shared_folder_comes_from_the_session(spark):
    assert shared_dir(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
    assert stored(spark.range(4), "x").count() == 4
    assert stored(spark.range(0), "x").count() == 0


# -- store and sinks ------------------------------------------------------------------------------


def snapshot_rows(spark, source, day, n):
    row = (source, "t", START + dt.timedelta(days=day), n, json.dumps({"columns": {"a": {"null_pct": 1.5}}}), None)
    return spark.createDataFrame([row], "source string, table_name string, profiled_at timestamp, row_count long, profile_json string, schema_fingerprint string")


def test_snapshot_store(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert store.snapshots().count() == 0 and store.alerts().count() == 0 and store.runs().count() == 0
    store.put_snapshots(snapshot_rows(spark, "a", 0, 1))
    store.put_snapshots(snapshot_rows(spark, "b", 0, 2), "batch-1")
    store.put_snapshots(snapshot_rows(spark, "b", 0, 3), "batch-1")
    assert sorted(r["row_count"] for r in store.snapshots().collect()) == [1, 3]
    # the long history is stored beside, only for what is new, and replaced with its batch
    assert sorted((r["source"], r["metric"], r["value"]) for r in store.history().collect()) == [
        ("a", "null_pct.a", 1.5), ("a", "row_count", 1.0), ("b", "null_pct.a", 1.5), ("b", "row_count", 3.0)
    ]
    only = store.snapshots(["b"])
    assert only.count() == 1 and re.search(r"PartitionFilters: \[[^]]*source", plan(only))


def test_alert_and_run_logs(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    rows = spark.createDataFrame([("k", "c", START, "HIGH", "s")], "alert_key string, channel string, sent_at timestamp, severity string, summary string")
    store.put_alerts(rows)
    store.put_alerts(rows, "b1")
    store.put_alerts(rows, "b1")
    assert store.alerts().count() == 2 and store.alerts(without_batch="b1").count() == 1
    assert store.alerts(since=START).count() == 2 and store.alerts(since=START + dt.timedelta(days=1)).count() == 0
    assert re.search(r"PartitionFilters: \[[^]]*sent_date", plan(store.alerts(since=START)))
    for i in range(4):
        store.append_run((START + dt.timedelta(hours=i), 1.0, "CLEAN", i, ["a"], []))
    assert [r["anomalies"] for r in store.runs(2).collect()] == [3, 2]


def test_exports(spark, tmp_path):
    scores = spark.createDataFrame([("s", "t", 85, "WARNING", ["a", "b"])], "source string, table_name string, score int, status string, issues array<string>")
    sinks.write_csv(sinks.scores_for_csv(scores), f"{tmp_path}/scores")
    row = spark.read.option("header", True).csv(f"{tmp_path}/scores").first()
    assert tuple(row) == ("s.t", "85", "WARNING", "a; b")
    f = sinks.findings_for_csv(explain(findings(spark, dict(today=9.0, expected=100.0, z_score=-8.0))), F.lit("2026-03-01T10:00:00.1"))
    sinks.write_csv(f, f"{tmp_path}/findings")
    back = spark.read.option("header", True).csv(f"{tmp_path}/findings")
    assert back.columns == ["Detected At", "Table", "Severity", "Metric", "Detector", "Today", "Expected", "Score", "Explanation"]
    assert back.first()["Explanation"].endswith(".")
    sinks.write_json(scores, f"{tmp_path}/json")
    assert json.loads(spark.read.text(f"{tmp_path}/json").first()[0])["issues"] == ["a", "b"]
    sinks.refresh_table(scores, f"{tmp_path}/t")
    sinks.refresh_table(scores.limit(0), f"{tmp_path}/t")
    assert spark.read.parquet(f"{tmp_path}/t").count() == 0


# -- whole runs -----------------------------------------------------------------------------------


def test_monitoring_runs_end_to_end(spark, tmp_path):
    """Nine quiet runs, then one in which half the rows are gone and a column turns null."""
    store, out = Store(spark, f"{tmp_path}/store"), f"{tmp_path}/out"
    for day in range(10):
        fault = day == 9
        n = 40 if fault else 200 + day % 3
        rows = [(i, None if fault and i % 2 else float(i % 50 + day % 2), f"k{i % 4}") for i in range(n)]
        spark.createDataFrame(rows, "id long, v double, k string").write.mode("overwrite").parquet(f"{tmp_path}/db/orders.parquet")
        at = START + dt.timedelta(days=day)
        sources = [P.Source("shop", "parquet", f"{tmp_path}/db"), P.Source("gone", "parquet", f"{tmp_path}/none")]
        if day < 8:  # profiles only; the report is checked on the last two days
            scan = P.scan_sources(spark, sources)
            store.put_snapshots(monitor.take_snapshots(spark, scan.tables, at))
        else:
            result = monitor.run(spark, sources, store, out, at, with_forest=fault)
    assert result.status == "CRITICAL" and result.anomalies >= 2
    assert result.errors and result.errors[0].startswith("gone.*")
    found = {r["metric"]: r for r in spark.read.parquet(f"{out}/findings").collect()}
    assert found["row_count"]["severity"] == "CRITICAL" and found["row_count"]["direction"] == "LOW"
    assert found["row_count"]["explanation"].endswith(".")
    assert spark.read.json(f"{out}/scores").first()["score"] < 90
    assert store.alerts().count() == 1
    assert [r["status"] for r in store.runs().collect()][0] == "CRITICAL"
    assert store.snapshots().filter("schema_fingerprint IS NULL").count() == 0
    monitor.analyse(spark, store, out, START + dt.timedelta(days=9, minutes=30), with_forest=False)
    # the first alert is still inside its window, so the table's next finding is sent
    assert store.alerts().count() == store.alerts().select("alert_key").distinct().count() == 2


def test_markers_of_writers_are_no_tables(spark, tmp_path):
    from plumbline.sources.specs import Source, list_tables

    for name in ("orders.parquet", "users", "_SUCCESS", "_delta_log", "_temporary", ".hidden", "notes.txt"):
        (tmp_path / name).mkdir()
    assert list_tables(spark, Source("s", "parquet", str(tmp_path))) == ["orders", "users"]


def test_an_unreadable_log_is_no_empty_log(spark, tmp_path):
    from plumbline.sources.store import Store

    store = Store(spark, str(tmp_path))
    assert store.alerts().count() == 0
    (tmp_path / "alert_log" / "batch=1").mkdir(parents=True)
    (tmp_path / "alert_log" / "batch=1" / "part-0.parquet").write_bytes(b"not parquet")
    with pytest.raises(Exception, match="(?i)parquet"):
        store.alerts().collect()


def test_jdbc_names_carry_their_schema():
    from plumbline.sources.specs import _jdbc_catalogue

    _, name, condition = _jdbc_catalogue("jdbc:postgresql://h:5432/db")
    assert "'public'" in name and "table_schema" in name and "pg_catalog" in condition
    assert _jdbc_catalogue("jdbc:mysql://h:3306/shop?x=1")[2] == "table_schema = 'shop'"


def test_run_with_suites_and_drift(spark, tmp_path):
    """Two sources with several tables: rules feed scores, summary and report alerts, and a changed schema shows as drift."""
    from plumbline.operators.rules import between, in_set

    store, out = Store(spark, f"{tmp_path}/store"), f"{tmp_path}/out"
    suites = {("a", "t"): [between("v", 0, 10), in_set("k", ["x"])], ("b", "u"): [between("w", 0, 5)], ("b", "unknown"): [between("z", 0, 1)]}
    sources = [P.Source("a", "parquet", f"{tmp_path}/a"), P.Source("b", "parquet", f"{tmp_path}/b")]
    for day in range(2):
        late = day == 1
        t = spark.range(50).selectExpr("id v", "'x' k", *(["1 extra"] if late else ["'gone' old"]))
        t.write.mode("overwrite").parquet(f"{tmp_path}/a/t.parquet")
        spark.range(5).selectExpr("id w").write.mode("overwrite").parquet(f"{tmp_path}/b/u.parquet")
        spark.range(3).selectExpr("CAST(id AS DOUBLE) q" if late else "id q").write.mode("overwrite").parquet(f"{tmp_path}/b/plain.parquet")
        result = monitor.run(spark, sources, store, out, START + dt.timedelta(days=day), with_forest=False, suites=suites)
        assert result.errors == [] and result.anomalies == 0
    read = lambda name: spark.read.json(f"{out}/{name}").collect()
    scores = {(r["source"], r["table_name"]): r["score"] for r in read("scores")}
    assert scores == {("a", "t"): 90, ("b", "u"): 100, ("b", "plain"): 100}
    overall = read("summary")[0]
    assert (overall["checks_passed"], overall["checks_failed"], overall["total_snapshots"]) == (2, 1, 6)
    assert {(r["table_name"], r["column"], r["change"]) for r in read("drift")} == {("t", "extra", "ADDED"), ("t", "old", "DROPPED"), ("plain", "q", "TYPE CHANGED")}
    assert [r["severity"] for r in read("alert_history")] == ["HIGH", "HIGH"] and store.alerts().count() == 2
    assert len(read("run_tables")) == 6 and len(read("run_history")) == 2
