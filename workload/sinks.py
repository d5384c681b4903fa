"""Sources and sinks: what is listed, written and read back."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import annotate as N
from plumbline.operators import schema as S
from plumbline.operators import score as C
from plumbline.plans import models as M
from plumbline.session import shared_dir
from plumbline.sources import sinks
from plumbline.sources.specs import Source, columns_of, scan_sources
from plumbline.sources.store import Store
from workload.anomalies import ORACLE as ANOMALIES
from workload.anomalies import RUN_AT, found
from workload.inputs import ctes, orders, stored_feed_history, table
from workload.quality import STG_CTES
from workload.reports import ORACLE as REPORTS

DRIVER_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def multi_source_scan(spark, sf_dir):
    """Every table of a folder found by listing it, with rows and columns; a source that is not there is reported."""
    scan = scan_sources(spark, [Source("driver", "parquet", sf_dir), Source("gone", "parquet", f"{sf_dir}/none")])
    parts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(s).alias("source"), F.lit(t).alias("table_name"), "row_count", F.lit(len(columns_of(df))).cast("long").alias("column_count")
        )
        for s, t, df in scan.tables
    ]
    failed = [(s, t, None, None) for s, t, _ in scan.errors]
    return reduce(DataFrame.unionAll, [*parts, spark.createDataFrame(failed, "source string, table_name string, row_count long, column_count long")])


def json_roundtrip(spark, sf_dir):
    """Table scores as JSON lines and back; issues stay arrays."""
    history, path = stored_feed_history(spark, sf_dir), shared_dir(spark, "json")
    scores = C.table_scores(history, found(spark, sf_dir))
    sinks.write_json(scores, path)
    return spark.read.schema(scores.schema).json(path).withColumn("issues", F.concat_ws("; ", "issues"))


def csv_scores(spark, sf_dir):
    history, path = stored_feed_history(spark, sf_dir), shared_dir(spark, "csv_scores")
    sinks.write_csv(sinks.scores_for_csv(C.table_scores(history, found(spark, sf_dir))), path)
    back = spark.read.option("header", True).csv(path)
    return back.select("Table", F.col("Score").cast("int").alias("Score"), "Status", F.coalesce("Issues", F.lit("")).alias("Issues"))


def csv_findings(spark, sf_dir):
    path = shared_dir(spark, "csv_findings")
    sinks.write_csv(sinks.findings_for_csv(N.explain(found(spark, sf_dir)), F.lit(RUN_AT)), path)
    return spark.read.option("header", True).csv(path)


def refresh_roundtrip(spark, sf_dir):
    """A stored mart replaced by a full refresh: what it held before is gone."""
    path = shared_dir(spark, "refresh")
    mart = M.mart_orders_summary(M.stg_orders(orders(spark, sf_dir)))
    sinks.refresh_table(mart.limit(1), path)
    sinks.refresh_table(mart, path)
    return M.newest_first(spark.read.parquet(path)).select("order_date", "order_status", "total_orders")


def run_log(spark, sf_dir):
    """One log row per day of events; the newest ten are read."""
    store = Store(spark, shared_dir(spark, "run_log"))
    days = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count_if(F.col("event_type") == "error").alias("n"))
    at = lambda day: dt.datetime.combine(day, dt.time(), dt.timezone.utc)
    # one row per day
    store.append_run(*((at(r["day"]), 1.0, "CRITICAL" if r["n"] else "CLEAN", r["n"], ["driver"], []) for r in days.collect()))
    return store.runs(10).select(F.to_date("run_at").alias("day"), "status", "anomalies")


def drift_stored(spark, sf_dir):
    """Two stored schemas of orders, as their values show them, against each other: one column gone, one new, one of another type."""
    keys = {"source": F.lit("driver"), "table_name": F.lit("orders")}
    rows = table(spark, sf_dir, "orders")
    later = rows.drop("o_orderpriority").withColumn("o_comment", F.col("o_orderstatus")).withColumn("o_totalprice", F.col("o_totalprice").cast("decimal(18,2)"))
    kept = []
    for df in (rows, later):
        path = shared_dir(spark, "schemas")
        sinks.refresh_table(S.fingerprint(S.observed_schema(df, keys, df.columns)), path)
        kept.append(S.schema_rows(spark.read.parquet(path)))
    return S.drift(kept[0], kept[1], ["source", "table_name"]).select("source", "table_name", "column", "change", "issue")


QUERIES = {
    "multi_source_scan": multi_source_scan,
    "json_roundtrip": json_roundtrip,
    "csv_scores": csv_scores,
    "csv_findings": csv_findings,
    "refresh_roundtrip": refresh_roundtrip,
    "run_log": run_log,
    "drift_stored": drift_stored,
}

ORACLE = {
    "multi_source_scan": " UNION ALL ".join(
        f"SELECT 'driver' AS source, '{t}' AS table_name, (SELECT count(*) FROM {t}) AS row_count, (SELECT count(*) FROM (DESCRIBE {t})) AS column_count"
        for t in DRIVER_TABLES
    )
    + " UNION ALL SELECT 'gone', NULL, NULL, NULL",
    "json_roundtrip": REPORTS["table_scores"],
    "csv_scores": f"SELECT source || '.' || table_name AS \"Table\", score AS \"Score\", status AS \"Status\", issues AS \"Issues\" FROM ({REPORTS['table_scores']})",
    "csv_findings": "SELECT f.detected_at AS \"Detected At\", f.\"table\" AS \"Table\", f.severity AS \"Severity\", f.metric AS \"Metric\", f.detector AS \"Detector\", "
    "f.today AS \"Today\", f.expected AS \"Expected\", f.score AS \"Score\", e.explanation AS \"Explanation\" "
    f"FROM ({ANOMALIES['findings_flat']}) f JOIN ({ANOMALIES['explain_findings']}) e ON f.\"table\" = e.source || '.' || e.table_name AND f.metric = e.metric",
    "refresh_roundtrip": ctes(*STG_CTES) + "SELECT order_date, order_status, total_orders FROM mart_orders_summary",
    "run_log": "SELECT CAST(ts AS DATE) AS day, CASE WHEN count(*) FILTER (event_type = 'error') > 0 THEN 'CRITICAL' ELSE 'CLEAN' END AS status, "
    "count(*) FILTER (event_type = 'error') AS anomalies FROM events GROUP BY 1 ORDER BY 1 DESC LIMIT 10",
    "drift_stored": "WITH before AS (SELECT column_name AS c, column_type AS t FROM (DESCRIBE orders)), "
    "later AS (SELECT c, CASE c WHEN 'o_totalprice' THEN 'DECIMAL(18,2)' ELSE t END AS t FROM before WHERE c <> 'o_orderpriority' "
    "UNION ALL SELECT 'o_comment', t FROM before WHERE c = 'o_orderstatus'), "
    "both_sides AS (SELECT coalesce(b.c, l.c) AS c, b.t AS was, l.t AS now FROM before b FULL JOIN later l ON b.c = l.c WHERE b.t IS DISTINCT FROM l.t) "
    "SELECT 'driver' AS source, 'orders' AS table_name, c AS \"column\", "
    "CASE WHEN now IS NULL THEN 'DROPPED' WHEN was IS NULL THEN 'ADDED' ELSE 'TYPE CHANGED' END AS change, "
    "CASE WHEN now IS NULL THEN 'DROPPED column: ' || c WHEN was IS NULL THEN 'ADDED column: ' || c "
    "ELSE 'TYPE CHANGED: ' || c || '  ' || was || ' -> ' || now END AS issue FROM both_sides",
}
