"""Profile and schema queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators.profile import bucket_history, profile_table, value_frequencies
from plumbline.operators.schema import drift, fingerprint, last_fingerprint, observed_schema
from plumbline.operators.snapshots import decode_history, to_snapshots
from workload.inputs import FEED_CTE, FEED_CTES, ctes, feed, feed_history, orders, products, settle, table, users
from workload.inputs import SHOP_CTES, ORDERS, PRODUCTS, USERS

TEXT = ("string",)

_TYPES = {
    "raw_orders": dict.fromkeys(("id", "user_id", "product_id"), "bigint") | {"total": "double"},
    "raw_users": {"id": "bigint", "age": "double"},
    "raw_products": {"id": "bigint", "price": "double", "stock": "double"},
    "lineitem": dict.fromkeys(("l_orderkey", "l_partkey", "l_suppkey"), "bigint")
    | {"l_linenumber": "int"}
    | dict.fromkeys(("l_quantity", "l_extendedprice", "l_discount", "l_tax"), "double"),
    "documents": dict.fromkeys(("doc_id", "n_chars"), "bigint"),
}
_COLUMNS = {
    "raw_orders": list(ORDERS),
    "raw_users": list(USERS),
    "raw_products": list(PRODUCTS),
    "lineitem": [
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
        "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
    ],
    "documents": ["doc_id", "text", "lang", "source", "n_chars"],
}
_STAMPS = {"l_shipdate": "timestamp_ntz"}


def _profile_sql(rel: str, shown: str) -> str:
    rows = []
    for c in _COLUMNS[rel]:
        dtype = _TYPES[rel].get(c) or _STAMPS.get(c, "string")
        if c in _TYPES[rel]:
            stats = ", ".join(
                f"{settle(f'{fn}(CAST({c} AS DOUBLE))', 4)} AS {name}"
                for fn, name in (("min", '"min"'), ("max", '"max"'), ("avg", "mean"), ("stddev_samp", "std"))
            )
        else:
            stats = 'CAST(NULL AS DOUBLE) AS "min", CAST(NULL AS DOUBLE) AS "max", CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS std'
        rows.append(
            f"SELECT '{shown}' AS table_name, '{c}' AS \"column\", '{dtype}' AS dtype, count(*) AS row_count, "
            f"count(*) - count({c}) AS null_count, {settle(f'100E0 * (count(*) - count({c})) / count(*)', 2)} AS null_pct, "
            f"count(DISTINCT {c}) AS distinct_count, {settle(f'100E0 * count(DISTINCT {c}) / count(*)', 2)} AS distinct_pct, "
            f"{stats} FROM {rel}"
        )
    return " UNION ALL ".join(rows)


def _profile(df, name):
    return profile_table(df, "driver", name, F.lit("2024-01-31").cast("timestamp")).select(
        "table_name", "column", "dtype", "row_count", "null_count", "null_pct", "distinct_count", "distinct_pct",
        "min", "max", "mean", "std",
    )


def profile_orders(spark, sf_dir):
    return _profile(orders(spark, sf_dir), "orders")


def profile_customer(spark, sf_dir):
    return _profile(users(spark, sf_dir), "users")


def profile_part(spark, sf_dir):
    return _profile(products(spark, sf_dir), "products")


def profile_lineitem(spark, sf_dir):
    return _profile(table(spark, sf_dir, "lineitem"), "lineitem")


def profile_documents(spark, sf_dir):
    """A table of long texts: they are counted under their digests."""
    return _profile(table(spark, sf_dir, "documents"), "documents")


def profile_all_tables(spark, sf_dir):
    """All shop tables profiled by one plan."""
    return (
        profile_orders(spark, sf_dir)
        .unionByName(profile_customer(spark, sf_dir))
        .unionByName(profile_part(spark, sf_dir))
    )


def _tops(df, name):
    prof = profile_table(df, "driver", name, F.lit("2024-01-31").cast("timestamp"))
    return prof.filter(F.col("top_values").isNotNull()).select(
        "column", F.posexplode("top_values").alias("pos", "t")
    ).select("column", (F.col("pos") + 1).alias("rank"), F.col("t.value").alias("value"), F.col("t.count").alias("n"))


def top_values_orders(spark, sf_dir):
    return _tops(orders(spark, sf_dir), "orders")


def top_values_documents(spark, sf_dir):
    return _tops(table(spark, sf_dir, "documents"), "documents")


def value_frequencies_part(spark, sf_dir):
    return value_frequencies(products(spark, sf_dir), ["category", "name"])


def daily_profile_events(spark, sf_dir):
    """Flagship input: daily metric history of the whole events feed."""
    return bucket_history(
        feed(spark, sf_dir),
        source=F.lit("driver"),
        table_name=F.lit("events"),
        profiled_at=F.col("profiled_at"),
        nulls_of=["value"],
        stats_of=["value"],
        distinct_of=["user_id", "table_name"],
    )


def _daily_sql() -> str:
    parts = [
        ("row_count", "CAST(count(*) AS DOUBLE)"),
        ("null_pct.value", settle("100E0 * (count(*) - count(value)) / count(*)", 2)),
        ("mean.value", settle("avg(value)", 4)),
        ("std.value", settle("stddev_samp(value)", 4)),
        ("distinct_count.user_id", "CAST(count(DISTINCT user_id) AS DOUBLE)"),
        ("distinct_count.table_name", "CAST(count(DISTINCT table_name) AS DOUBLE)"),
    ]
    return ctes(FEED_CTE) + " UNION ALL ".join(
        f"SELECT 'driver' AS source, 'events' AS table_name, profiled_at, '{m}' AS metric, {v} AS value "
        "FROM feed GROUP BY profiled_at"
        for m, v in parts
    )


def metric_history(spark, sf_dir):
    return feed_history(spark, sf_dir)


def profile_json_roundtrip(spark, sf_dir):
    """Column profiles folded into JSON snapshots and decoded to the long history."""
    at = F.lit("2024-01-31").cast("timestamp")
    profiles = profile_table(orders(spark, sf_dir), "driver", "orders", at).unionByName(
        profile_table(users(spark, sf_dir), "driver", "users", at)
    )
    return decode_history(to_snapshots(profiles)).select("table_name", "metric", "value")


def history_sql(*tables: str) -> str:
    """Long history of profiled shop tables, given as relation, shown name, relation, ..."""
    out = []
    for rel, shown in zip(tables[::2], tables[1::2]):
        prof = _profile_sql(rel, shown)
        out.append(f"SELECT DISTINCT '{shown}' AS table_name, 'row_count' AS metric, CAST(row_count AS DOUBLE) AS value FROM ({prof})")
        for m in ("null_pct", "mean", "std", "distinct_count"):
            out.append(
                f"SELECT '{shown}' AS table_name, '{m}.' || \"column\" AS metric, CAST({m} AS DOUBLE) AS value "
                f"FROM ({prof}) WHERE {m} IS NOT NULL"
            )
    return ctes(*SHOP_CTES) + " UNION ALL ".join(out)


# -- schemas: columns that hold values, per event type and day ------------------------------------

_OBSERVED = ["event_id", "ts", "user_id", "clicks", "spend"]
_OBSERVED_EXPR = {
    # a feed that stops filling one column and starts filling another on the last day
    "clicks": "CASE WHEN table_name = 'click' AND profiled_at < DATE '2024-01-30' THEN event_id END",
    "spend": "CASE WHEN table_name IN ('purchase', 'click') AND (table_name = 'purchase' OR profiled_at = DATE '2024-01-30') THEN value END",
}
_OBSERVED_TYPES = {"event_id": "BIGINT", "ts": "TIMESTAMP_NTZ", "user_id": "BIGINT", "clicks": "BIGINT", "spend": "DOUBLE"}


def _observed(spark, sf_dir):
    df = feed(spark, sf_dir)
    df = df.withColumns({n: F.expr(e) for n, e in _OBSERVED_EXPR.items()})
    keys = {k: F.col(k) for k in ("source", "table_name", "profiled_at")}
    return observed_schema(df, keys, _OBSERVED)


_OBSERVED_CTES = (
    FEED_CTE,
    ("wide", "SELECT *, " + ", ".join(f"{e} AS {n}" for n, e in _OBSERVED_EXPR.items()) + " FROM feed"),
    (
        "obs",
        " UNION ALL ".join(
            f"SELECT source, table_name, profiled_at, '{c}' AS \"column\", '{_OBSERVED_TYPES[c]}' AS type FROM wide "
            f"GROUP BY 1, 2, 3 HAVING count({c}) > 0"
            for c in _OBSERVED
        ),
    ),
    (
        "prints",
        "SELECT source, table_name, profiled_at, '{' || string_agg('\"' || \"column\" || '\": \"' || type || '\"', ', ' "
        "ORDER BY \"column\") || '}' AS columns_json FROM obs GROUP BY 1, 2, 3",
    ),
)


def schema_fingerprints(spark, sf_dir):
    return fingerprint(_observed(spark, sf_dir), ["source", "table_name", "profiled_at"])


def schema_drift(spark, sf_dir):
    """Changes of the last day's observed schema against the day before, per table."""
    obs = _observed(spark, sf_dir)
    keys = ["source", "table_name"]
    old = obs.filter(F.col("profiled_at") == F.lit("2024-01-29").cast("date"))
    new = obs.filter(F.col("profiled_at") == F.lit("2024-01-30").cast("date"))
    return drift(old, new, keys).select(*keys, "column", "change", "issue")


def last_fingerprints(spark, sf_dir):
    prints = fingerprint(_observed(spark, sf_dir), ["source", "table_name", "profiled_at"])
    return last_fingerprint(prints.withColumnRenamed("columns_json", "schema_fingerprint"))


QUERIES = {
    "profile_orders": profile_orders,
    "profile_customer": profile_customer,
    "profile_part": profile_part,
    "profile_lineitem": profile_lineitem,
    "profile_documents": profile_documents,
    "profile_all_tables": profile_all_tables,
    "top_values_orders": top_values_orders,
    "top_values_documents": top_values_documents,
    "value_frequencies_part": value_frequencies_part,
    "daily_profile_events": daily_profile_events,
    "metric_history": metric_history,
    "profile_json_roundtrip": profile_json_roundtrip,
    "schema_fingerprints": schema_fingerprints,
    "schema_drift": schema_drift,
    "last_fingerprints": last_fingerprints,
}



def _tops_sql(rel: str, *columns: str) -> str:
    """Ties go by the value, or for one of over 64 bytes by its first characters, digest and length."""
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", CAST(row_number() OVER (ORDER BY count(*) DESC, CASE WHEN strlen({c}) > 64 "
        f"THEN left({c}, 32) || md5({c}) || strlen({c}) ELSE {c} END) AS INT) AS rank, {c} AS value, "
        f"count(*) AS n FROM {rel} WHERE {c} IS NOT NULL GROUP BY {c} QUALIFY rank <= 5"
        for c in columns
    )


ORACLE = {
    "profile_orders": ctes(*SHOP_CTES) + _profile_sql("raw_orders", "orders"),
    "profile_customer": ctes(*SHOP_CTES) + _profile_sql("raw_users", "users"),
    "profile_part": ctes(*SHOP_CTES) + _profile_sql("raw_products", "products"),
    "profile_lineitem": _profile_sql("lineitem", "lineitem"),
    "profile_documents": _profile_sql("documents", "documents"),
    "profile_all_tables": ctes(*SHOP_CTES)
    + " UNION ALL ".join(
        _profile_sql(r, n) for r, n in (("raw_orders", "orders"), ("raw_users", "users"), ("raw_products", "products"))
    ),
    "top_values_orders": ctes(*SHOP_CTES) + _tops_sql("raw_orders", "status", "created_at"),
    "top_values_documents": _tops_sql("documents", "text", "lang", "source"),
    "value_frequencies_part": ctes(*SHOP_CTES)
    + "SELECT 'category' AS \"column\", category AS value, count(*) AS n FROM raw_products GROUP BY category "
    "UNION ALL SELECT 'name', name, count(*) FROM raw_products GROUP BY name",
    "daily_profile_events": _daily_sql(),
    "metric_history": ctes(*FEED_CTES) + "SELECT source, table_name, profiled_at, metric, value FROM hist",
    "profile_json_roundtrip": history_sql("raw_orders", "orders", "raw_users", "users"),
    "schema_fingerprints": ctes(*_OBSERVED_CTES) + "SELECT *, md5(columns_json) AS fingerprint FROM prints",
    "schema_drift": ctes(
        *_OBSERVED_CTES,
        ("a", "SELECT * FROM obs WHERE profiled_at = DATE '2024-01-29'"),
        ("b", "SELECT * FROM obs WHERE profiled_at = DATE '2024-01-30'"),
    )
    + "SELECT coalesce(a.source, b.source) AS source, coalesce(a.table_name, b.table_name) AS table_name, "
    "coalesce(a.\"column\", b.\"column\") AS \"column\", "
    "CASE WHEN a.type IS NULL THEN 'ADDED' WHEN b.type IS NULL THEN 'DROPPED' ELSE 'TYPE CHANGED' END AS change, "
    "CASE WHEN a.type IS NULL THEN 'ADDED column: ' || b.\"column\" WHEN b.type IS NULL THEN 'DROPPED column: ' || a.\"column\" "
    "ELSE 'TYPE CHANGED: ' || a.\"column\" || '  ' || a.type || ' -> ' || b.type END AS issue "
    "FROM a FULL JOIN b ON a.source = b.source AND a.table_name = b.table_name AND a.\"column\" = b.\"column\" "
    "WHERE a.type IS DISTINCT FROM b.type",
    "last_fingerprints": ctes(*_OBSERVED_CTES)
    + "SELECT source, table_name, profiled_at, columns_json AS schema_fingerprint FROM prints "
    "QUALIFY row_number() OVER (PARTITION BY source, table_name ORDER BY profiled_at DESC) = 1",
}
