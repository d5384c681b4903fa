"""Streaming queries. Each runs to the end of the available files into a parquet sink and reads it back."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.rules import between, in_set, not_null
from plumbline.session import shared_dir
from plumbline.sources.store import Store
from plumbline.streaming.incremental import incremental_monitor
from plumbline.streaming.profile import window_distinct, window_profile
from plumbline.streaming.quarantine import quarantine
from plumbline.streaming.suite import suite_results, suite_stream
from plumbline.streaming.suppression import ROCKS_DB, suppress_in_time_order, suppress_stream, suppress_to_log
from workload.anomalies import DAY, event_alerts, greedy_sql
from workload.profiles import history_sql
from workload.quality import ORACLE as QUALITY_SQL, ORDER_RULES
from workload.inputs import FEED, ORDERS, STATUSES, ctes, project, settle, sql_project, table


def stream_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet file of a table as a file stream of its folder, one file per trigger at most."""
    schema = table(spark, sf_dir, name).schema
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", f"{name}.parquet")
        .option("maxFilesPerTrigger", 1)
        .parquet(sf_dir)
    )


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over all available files into a parquet sink and return what it wrote."""
    spark = stream.sparkSession
    base = shared_dir(spark, name)
    query = (
        stream.writeStream.format("parquet")
        .outputMode(mode)
        .option("path", f"{base}/rows")
        .option("checkpointLocation", f"{base}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A session setting for the length of a query."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def disordered_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream of several triggers, each with events of the next one's first day, and a last trigger ten days later that ends all windows."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    base = shared_dir(spark, "disordered_events")
    days_late = F.pmod(F.xxhash64("event_id"), F.lit(2))
    for trigger in range(4):
        part = events.where(F.floor((F.dayofmonth("ts") - 1 + days_late) / 10) == trigger)
        part.coalesce(1).write.mode("append").parquet(base)
    end = events.agg((F.max("ts") + F.expr("INTERVAL 10 DAYS")).alias("ts"))
    ids = [F.lit(-1).cast("long").alias(c) for c in ("event_id", "user_id")]
    end.select(ids[0], "ts", ids[1], F.lit("end").alias("event_type")).write.mode("append").parquet(base)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(base)


def in_files(spark: SparkSession, sf_dir: str, name: str, key: str, triggers: int = 4) -> DataFrame:
    """A table as a stream of several triggers, dealt by a hash of ``key``; a trigger reads as many files as there are cores."""
    rows = table(spark, sf_dir, name)
    base = shared_dir(spark, f"{name}_in_files")
    files = spark.sparkContext.defaultParallelism
    rows.repartition(triggers * files, key).write.parquet(base)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(base)


def stream_daily_profile(spark, sf_dir):
    events = project(stream_of(spark, sf_dir, "events"), FEED)
    rows = window_profile(
        events, "ts", "1 day", "1 hour", keys=["table_name"], nulls_of=["value"], stats_of=["value"]
    )
    return drain(rows, "stream_daily_profile").withColumn("profiled_at", F.col("profiled_at").cast("date"))


def stream_distinct_users(spark, sf_dir):
    """Exact distinct users per closed day and event type."""
    events = project(stream_of(spark, sf_dir, "events"), FEED)
    rows = window_distinct(events, "ts", "1 day", "1 hour", "user_id", keys=["table_name"])
    return drain(rows, "stream_distinct_users").withColumn("profiled_at", F.col("profiled_at").cast("date"))


def stream_alert_suppression(spark, sf_dir):
    alerts = event_alerts(spark, sf_dir, stream_of(spark, sf_dir, "events"))
    # a trigger without data would only forget keys, and nothing follows it here
    with setting(spark, "spark.sql.streaming.noDataMicroBatches.enabled", "false"):
        kept = drain(suppress_stream(alerts, minutes=DAY), "stream_alert_suppression")
    return kept.withColumn("sent_at", F.col("sent_at").cast("timestamp_ntz"))


def stream_suppression_in_time_order(spark, sf_dir):
    """The same suppression over triggers that overlap in time."""
    alerts = event_alerts(spark, sf_dir, disordered_events(spark, sf_dir))
    with setting(spark, "spark.sql.streaming.stateStore.providerClass", ROCKS_DB):
        kept = drain(suppress_in_time_order(alerts, minutes=DAY, delay="3 days"), "stream_suppression_in_time_order")
    return kept.withColumn("sent_at", F.col("sent_at").cast("timestamp_ntz"))


def stream_suppression_log(spark, sf_dir):
    """The same suppression with the alert log as state."""
    store = Store(spark, shared_dir(spark, "stream_suppression_log"))
    alerts = event_alerts(spark, sf_dir, stream_of(spark, sf_dir, "events"))
    suppress_to_log(alerts, store, f"{store.base}/checkpoint", minutes=DAY).awaitTermination()
    return store.alerts().drop("batch").withColumn("sent_at", F.col("sent_at").cast("timestamp_ntz"))


def stream_incremental(spark, sf_dir):
    """Micro-batches of orders profiled into the store and analysed; the stored history is returned."""
    store = Store(spark, shared_dir(spark, "stream_incremental"))
    orders = project(stream_of(spark, sf_dir, "orders"), ORDERS)
    incremental_monitor(
        orders,
        store,
        "driver",
        "orders",
        f"{store.base}/out",
        f"{store.base}/checkpoint",
        batch_time=F.max("created_at").cast("timestamp"),
    ).awaitTermination()
    return store.history().select("table_name", "metric", "value")


PERIODS = 3
_PERIOD = "least(greatest((year({}) - 1995) {} 3, 0), 2)"  # every row has one, also those without a date


def stream_incremental_runs(spark, sf_dir):
    """Orders that arrive period by period: each start takes the new files only and adds one snapshot to the history."""
    base = shared_dir(spark, "stream_incremental_runs")
    store = Store(spark, f"{base}/store")
    rows = table(spark, sf_dir, "orders")
    for period in range(PERIODS):
        rows.where(F.expr(_PERIOD.format("o_orderdate", "div")) == period).write.mode("append").parquet(f"{base}/in")
        arrived = project(spark.readStream.schema(rows.schema).parquet(f"{base}/in"), ORDERS)
        at = F.max("created_at").cast("timestamp")
        incremental_monitor(arrived, store, "driver", "orders", f"{base}/out", f"{base}/checkpoint", batch_time=at).awaitTermination()
    return store.history().select("table_name", F.col("profiled_at").cast("date").alias("profiled_at"), "metric", "value")


def _runs_sql() -> str:
    whole = history_sql("raw_orders", "orders")
    head, tail = whole.rsplit("\n", 1)  # the common tables, and what is selected from them
    periods = [
        (f"orders_{p}", f"SELECT * FROM raw_orders WHERE {_PERIOD.format('CAST(created_at AS DATE)', '//')} = {p}") for p in range(PERIODS)
    ]
    parts = [
        f"SELECT table_name, (SELECT max(CAST(created_at AS DATE)) FROM orders_{p}) AS profiled_at, metric, value "
        f"FROM ({tail.replace('FROM raw_orders', f'FROM orders_{p}')}) WHERE (SELECT count(*) FROM orders_{p}) > 0"
        for p in range(PERIODS)
    ]
    return head + "".join(f", {n} AS ({q})" for n, q in periods) + "\n" + " UNION ALL ".join(parts)


RULES = [not_null("user_id"), not_null("total"), between("total", 0, 50_000), in_set("status", STATUSES)]


def stream_quarantine(spark, sf_dir):
    orders = project(stream_of(spark, sf_dir, "orders"), ORDERS)
    base = shared_dir(spark, "stream_quarantine")
    for q in quarantine(orders, RULES, f"{base}/good", f"{base}/broken", f"{base}/checkpoint"):
        q.awaitTermination()
    good = spark.read.schema(orders.schema).parquet(f"{base}/good").withColumn("broken", F.lit(""))
    broken = spark.read.parquet(f"{base}/broken").withColumn("broken", F.concat_ws(",", "broken"))
    return good.unionByName(broken).groupBy("broken").agg(
        F.count(F.lit(1)).alias("n"), F.sum("id").alias("id_sum")
    )


def stream_suite(spark, sf_dir):
    """The order suite over several micro-batches, among which repeated ids are spread."""
    base = shared_dir(spark, "stream_suite")
    orders = project(in_files(spark, sf_dir, "orders", "o_orderkey"), ORDERS)
    suite_stream(orders, ORDER_RULES, base, f"{base}/checkpoint").awaitTermination()
    return suite_results(spark, base, "orders_suite", "orders", ORDER_RULES)


QUERIES = {
    "stream_suite": stream_suite,
    "stream_daily_profile": stream_daily_profile,
    "stream_distinct_users": stream_distinct_users,
    "stream_alert_suppression": stream_alert_suppression,
    "stream_suppression_in_time_order": stream_suppression_in_time_order,
    "stream_suppression_log": stream_suppression_log,
    "stream_quarantine": stream_quarantine,
    "stream_incremental": stream_incremental,
    "stream_incremental_runs": stream_incremental_runs,
}

_BROKEN = (
    "concat_ws(',', CASE WHEN user_id IS NULL THEN 'not_null(user_id)' END, CASE WHEN total IS NULL THEN 'not_null(total)' END, "
    "CASE WHEN total < 0 OR total > 50000 THEN 'between(total)' END, "
    f"CASE WHEN status NOT IN ({', '.join(repr(s) for s in STATUSES)}) THEN 'in_set(status)' END)"
)

ORACLE = {
    "stream_suite": QUALITY_SQL["suite_orders"],
    # a window is written once the watermark has passed its end
    "stream_daily_profile": ctes(("feed", sql_project("events", FEED)))
    + f"SELECT table_name, profiled_at, count(*) AS row_count, {settle('100E0 * (count(*) - count(value)) / count(*)', 2)} AS null_pct_value, "
    f"{settle('min(value)', 4)} AS min_value, {settle('max(value)', 4)} AS max_value, {settle('avg(value)', 4)} AS mean_value, "
    f"{settle('stddev_samp(value)', 4)} AS std_value FROM feed "
    "WHERE profiled_at + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR GROUP BY 1, 2",
    "stream_distinct_users": ctes(("feed", sql_project("events", FEED)))
    + "SELECT table_name, profiled_at, count(DISTINCT user_id) AS distinct_count_user_id FROM feed "
    "WHERE profiled_at + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR GROUP BY 1, 2",
    "stream_alert_suppression": greedy_sql("SELECT * FROM alerts", "INTERVAL 24 HOUR"),
    "stream_suppression_in_time_order": greedy_sql("SELECT * FROM alerts", "INTERVAL 24 HOUR"),
    "stream_suppression_log": greedy_sql("SELECT * FROM alerts", "INTERVAL 24 HOUR"),
    "stream_incremental": history_sql("raw_orders", "orders"),
    "stream_incremental_runs": _runs_sql(),
    "stream_quarantine": ctes(("raw_orders", sql_project("orders", ORDERS)))
    + f"SELECT {_BROKEN} AS broken, count(*) AS n, CAST(sum(id) AS BIGINT) AS id_sum FROM raw_orders GROUP BY 1",
}
