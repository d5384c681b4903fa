"""Inputs of the registered queries.

The given tables hold no faults, so faults are planted by projections that Spark and DuckDB
evaluate alike. No row is left out: a lost value becomes NULL, a repeated load doubles rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.profile import bucket_history
from plumbline.session import stored

LAST_DAY = "DATE '2024-01-30'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def project(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.select(*[F.expr(e).alias(n) for n, e in columns.items()])


def sql_project(name: str, columns: dict[str, str]) -> str:
    return "SELECT " + ", ".join(f"{e} AS {n}" for n, e in columns.items()) + f" FROM {name}"


def ctes(*parts: tuple[str, str]) -> str:
    return "WITH " + ",\n".join(f"{n} AS ({q})" for n, q in parts) + "\n"


def settle(x: str, digits: int) -> str:
    """DuckDB form of the engine's rounding: snap to nine decimals, then round half up."""
    return f"CAST(round(CAST({x} AS DECIMAL(38, 9)), {digits}) AS DOUBLE)"


def number(x: str) -> str:
    """DuckDB form of a number as text with one to four decimals."""
    return f"regexp_replace(CAST(CAST({x} AS DECIMAL(38, 4)) AS VARCHAR), '0{{1,3}}$', '')"


# -- shop tables -----------------------------------------------------------------------------

ORDERS = {
    "id": "CASE WHEN o_orderkey % 211 = 0 THEN NULL WHEN o_orderkey % 53 = 0 THEN o_orderkey + 1 ELSE o_orderkey END",
    "user_id": "CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE o_custkey END",
    "product_id": "o_orderkey % 200",
    "total": "CASE WHEN o_orderkey % 37 = 0 THEN NULL WHEN o_orderkey % 41 = 0 THEN 0E0 - o_totalprice "
    "ELSE CAST(floor(o_totalprice / 8E0) AS DOUBLE) END",
    "status": "CASE WHEN o_orderkey % 101 = 0 THEN ' Shipped' WHEN o_orderstatus = 'F' THEN 'paid' "
    "WHEN o_orderstatus = 'O' THEN 'pending' ELSE 'REFUNDED ' END",
    "created_at": "CAST(CAST(o_orderdate AS DATE) AS STRING)",
}
USERS = {
    "id": "CASE WHEN c_custkey % 71 = 0 THEN NULL ELSE c_custkey END",
    "email": "CASE WHEN c_custkey % 29 = 0 THEN NULL WHEN c_custkey % 31 = 0 THEN c_name "
    "WHEN c_custkey % 37 = 0 THEN 'Shared@Mail.com' ELSE ' ' || replace(c_name, '#', '@') || '.com' END",
    "country": "CASE WHEN c_custkey % 43 = 0 THEN NULL WHEN c_mktsegment = 'AUTOMOBILE' THEN 'us ' "
    "WHEN c_mktsegment = 'BUILDING' THEN 'UK' WHEN c_mktsegment = 'FURNITURE' THEN 'LK' "
    "WHEN c_mktsegment = 'HOUSEHOLD' THEN 'IN' ELSE 'MARS' END",
    "age": "CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE 13E0 + c_acctbal / 128E0 END",
    "joined": "CAST(DATE '2022-01-01' + CAST(c_nationkey AS INT) AS STRING)",
}
PRODUCTS = {
    "id": "p_partkey",
    "name": "'  ' || p_name || ' '",
    "category": "' ' || p_type",
    "price": "CASE WHEN p_partkey % 59 = 0 THEN NULL WHEN p_partkey % 61 = 0 THEN 0E0 - p_retailprice ELSE p_retailprice END",
    "stock": "CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_size + 0.5E0 END",
}
STATUSES = ("paid", "pending", "refunded")
COUNTRIES = ("LK", "US", "UK", "IN")
CATEGORIES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project(table(spark, sf_dir, "orders"), ORDERS)


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project(table(spark, sf_dir, "customer"), USERS)


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project(table(spark, sf_dir, "part"), PRODUCTS)


SHOP_CTES = (
    ("raw_orders", sql_project("orders", ORDERS)),
    ("raw_users", sql_project("customer", USERS)),
    ("raw_products", sql_project("part", PRODUCTS)),
)

# -- event feed: one snapshot per day and event type -------------------------------------------

FEED = {
    "source": "CASE WHEN event_type IN ('click', 'view') THEN 'web' ELSE 'shop' END",
    "table_name": "event_type",
    "profiled_at": "CAST(ts AS DATE)",
    "event_id": "event_id",
    "ts": "ts",
    "user_id": f"CASE WHEN CAST(ts AS DATE) = {LAST_DAY} AND event_type = 'signup' THEN user_id % 3 ELSE user_id END",
    "value": f"CASE WHEN event_id % 37 = 0 THEN NULL "
    f"WHEN CAST(ts AS DATE) = {LAST_DAY} AND event_type = 'click' AND event_id % 3 <> 0 THEN NULL "
    f"WHEN CAST(ts AS DATE) = {LAST_DAY} AND event_type = 'error' THEN value * 100E0 ELSE value END",
}
# a double load on the last day
COPIES = f"CASE WHEN CAST(ts AS DATE) = {LAST_DAY} AND event_type IN ('purchase', 'view') THEN 2 ELSE 1 END"


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.expr(COPIES))))
    return project(events, FEED)


def feed_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bucket_history(
        feed(spark, sf_dir),
        source=F.col("source"),
        table_name=F.col("table_name"),
        profiled_at=F.col("profiled_at"),
        nulls_of=["value", "user_id"],
        stats_of=["value"],
        distinct_of=["user_id"],
    )


def stored_feed_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history written once, as in a monitoring run, for plans that read it several times."""
    return stored(feed_history(spark, sf_dir), "feed_history")


FEED_CTE = (
    "feed",
    sql_project("events", FEED)
    + f" UNION ALL {sql_project('events', FEED)} WHERE {COPIES} = 2",
)


def _history_sql(rel: str, nulls_of: list[str], stats_of: list[str], distinct_of: list[str]) -> str:
    """Long history of a tagged relation, one grouped query per metric."""
    parts = [("'row_count'", "CAST(count(*) AS DOUBLE)")]
    parts += [(f"'null_pct.{c}'", settle(f"100E0 * (count(*) - count({c})) / count(*)", 2)) for c in nulls_of]
    for c in stats_of:
        parts.append((f"'mean.{c}'", settle(f"avg({c})", 4)))
        parts.append((f"'std.{c}'", settle(f"stddev_samp({c})", 4)))
    parts += [(f"'distinct_count.{c}'", f"CAST(count(DISTINCT {c}) AS DOUBLE)") for c in distinct_of]
    return " UNION ALL ".join(
        f"SELECT * FROM (SELECT source, table_name, profiled_at, {m} AS metric, {v} AS value FROM {rel} "
        f"GROUP BY 1, 2, 3) WHERE value IS NOT NULL"
        for m, v in parts
    )


FEED_CTES = (FEED_CTE, ("hist", _history_sql("feed", ["value", "user_id"], ["value"], ["user_id"])))

# -- two sources over lineitem: one snapshot per month -------------------------------------------

_WEST = (
    "(l_returnflag = 'R' AND l_linestatus = 'F' AND l_linenumber = 1) OR "
    "(l_returnflag = 'A' AND (l_linestatus = 'F' OR l_shipdate >= TIMESTAMP '2001-09-01'))"
)
LINES = {
    "source": f"CASE WHEN {_WEST} THEN 'west' ELSE 'east' END",
    "table_name": f"CASE WHEN {_WEST} THEN 'Lines_' ELSE 'lines_' END || l_returnflag",
    "profiled_at": "CAST(date_trunc('month', l_shipdate) AS DATE)",
    "quantity": "l_quantity",
    "discount": f"CASE WHEN ({_WEST}) AND l_orderkey % 2 = 0 THEN NULL ELSE l_discount END",
    "tax": f"CASE WHEN ({_WEST}) AND l_orderkey % 10 <> 0 THEN NULL ELSE l_tax END",
}


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project(table(spark, sf_dir, "lineitem"), LINES)


def lines_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bucket_history(
        lines(spark, sf_dir),
        source=F.col("source"),
        table_name=F.col("table_name"),
        profiled_at=F.col("profiled_at"),
        nulls_of=["quantity", "discount", "tax"],
        stats_of=["quantity"],
    )


def stored_lines_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(lines_history(spark, sf_dir), "lines_history")


LINES_CTES = (
    ("lines", sql_project("lineitem", LINES)),
    ("hist", _history_sql("lines", ["quantity", "discount", "tax"], ["quantity"], [])),
)
SNAPS_CTE = (
    "snaps",
    "SELECT source, table_name, profiled_at, CAST(value AS BIGINT) AS row_count FROM hist WHERE metric = 'row_count'",
)
LATEST_CTE = (
    "last_at",
    "SELECT source, table_name, max(profiled_at) AS today_at FROM hist GROUP BY 1, 2",
)

# -- shared oracle steps ------------------------------------------------------------------------

ZSCORE_CTE = (
    "zscore",
    "SELECT source, table_name, today_at AS profiled_at, 'zscore' AS detector, metric, "
    "CASE WHEN abs(z) >= 6 THEN 'CRITICAL' WHEN abs(z) >= 4 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, "
    "CASE WHEN z < 0 THEN 'LOW' ELSE 'HIGH' END AS direction, "
    f"{settle('today', 4)} AS today, {settle('m', 4)} AS expected, {settle('z', 2)} AS z_score, "
    "CAST(NULL AS DOUBLE) AS lower_fence, CAST(NULL AS DOUBLE) AS upper_fence, CAST(NULL AS DOUBLE) AS iqr_distance "
    "FROM (SELECT *, (today - m) / s AS z FROM (SELECT source, table_name, metric, today_at, "
    "count(value) FILTER (profiled_at < today_at) AS n, avg(value) FILTER (profiled_at < today_at) AS m, "
    "stddev_samp(value) FILTER (profiled_at < today_at) AS s, max(value) FILTER (profiled_at = today_at) AS today "
    "FROM hist JOIN last_at USING (source, table_name) GROUP BY 1, 2, 3, 4) "
    "WHERE n >= 7 AND s > 0 AND today IS NOT NULL) WHERE abs(z) >= 3",
)
IQR_CTE = (
    "iqr",
    "SELECT source, table_name, today_at AS profiled_at, 'iqr' AS detector, metric, "
    "CASE WHEN dist >= 4 THEN 'CRITICAL' WHEN dist >= 2 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, "
    "CASE WHEN today < lo THEN 'LOW' ELSE 'HIGH' END AS direction, "
    f"{settle('today', 4)} AS today, CAST(NULL AS DOUBLE) AS expected, CAST(NULL AS DOUBLE) AS z_score, "
    f"{settle('lo', 4)} AS lower_fence, {settle('hi', 4)} AS upper_fence, {settle('dist', 2)} AS iqr_distance "
    "FROM (SELECT *, CASE WHEN today < lo THEN (lo - today) / (q3 - q1) ELSE (today - hi) / (q3 - q1) END AS dist "
    "FROM (SELECT *, q1 - 1.5E0 * (q3 - q1) AS lo, q3 + 1.5E0 * (q3 - q1) AS hi "
    "FROM (SELECT source, table_name, metric, today_at, count(value) FILTER (profiled_at < today_at) AS n, "
    "quantile_cont(value, 0.25) FILTER (profiled_at < today_at) AS q1, "
    "quantile_cont(value, 0.75) FILTER (profiled_at < today_at) AS q3, "
    "max(value) FILTER (profiled_at = today_at) AS today "
    "FROM hist JOIN last_at USING (source, table_name) GROUP BY 1, 2, 3, 4) "
    "WHERE n >= 7 AND today IS NOT NULL AND q3 <> q1)) WHERE today < lo OR today > hi",
)
BEST_CTE = (
    "best",
    "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY source, table_name, metric "
    "ORDER BY CASE severity WHEN 'CRITICAL' THEN 1 WHEN 'HIGH' THEN 2 ELSE 3 END, "
    "CASE detector WHEN 'zscore' THEN 1 ELSE 2 END) AS rn "
    "FROM (SELECT * FROM zscore UNION ALL SELECT * FROM iqr)) WHERE rn = 1",
)
DETECT_CTES = (*FEED_CTES, LATEST_CTE, ZSCORE_CTE, IQR_CTE, BEST_CTE)
