"""Models, rule suites and model tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions.scalars import settle as settled
from plumbline.operators import rules as R
from plumbline.plans import models as M
from plumbline.plans import suites as S
from plumbline.sources.sinks import as_views
from workload.inputs import (
    CATEGORIES,
    COUNTRIES,
    SHOP_CTES,
    STATUSES,
    ctes,
    orders,
    products,
    settle,
    table,
    users,
)


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


# -- models -----------------------------------------------------------------------------------

STG_CTES = (
    *SHOP_CTES,
    (
        "stg_orders",
        "SELECT id AS order_id, user_id, product_id, total AS order_total, lower(trim(status)) AS order_status, "
        "CAST(created_at AS DATE) AS order_date, CASE WHEN total IS NULL THEN 'missing_total' "
        "WHEN total <= 0 THEN 'invalid_total' WHEN total > 50000 THEN 'suspicious_total' ELSE 'ok' END AS total_flag "
        "FROM raw_orders WHERE id IS NOT NULL",
    ),
    (
        "stg_users",
        "SELECT id AS user_id, lower(trim(email)) AS email, upper(trim(country)) AS country_code, "
        "CAST(age AS INTEGER) AS age, CAST(joined AS DATE) AS joined_date, "
        "CASE WHEN email NOT LIKE '%@%' THEN 'invalid_email' WHEN country IS NULL THEN 'missing_country' ELSE 'ok' END "
        "AS user_flag FROM raw_users WHERE id IS NOT NULL",
    ),
    (
        "stg_products",
        "SELECT id AS product_id, trim(name) AS product_name, trim(category) AS category, price, "
        "CAST(stock AS INTEGER) AS stock_qty, CASE WHEN price IS NULL OR price <= 0 THEN 'invalid_price' "
        "WHEN stock IS NULL THEN 'no_stock_info' ELSE 'ok' END AS product_flag FROM raw_products WHERE id IS NOT NULL",
    ),
    (
        "mart_orders_summary",
        f"SELECT order_date, order_status, count(*) AS total_orders, {settle('sum(order_total)', 2)} AS total_revenue, "
        f"{settle('avg(order_total)', 2)} AS avg_order_value, count(CASE WHEN total_flag <> 'ok' THEN 1 END) AS flagged_orders "
        "FROM stg_orders GROUP BY order_date, order_status",
    ),
    (
        "mart_user_activity",
        "SELECT u.user_id, u.email, u.country_code, u.age, count(o.order_id) AS total_orders, "
        f"{settle('sum(o.order_total)', 2)} AS lifetime_value, max(o.order_date) AS last_order_date, "
        "min(o.order_date) AS first_order_date FROM stg_users u LEFT JOIN stg_orders o ON u.user_id = o.user_id "
        "GROUP BY 1, 2, 3, 4",
    ),
)


def _models(spark, sf_dir):
    return M.build_models(orders(spark, sf_dir), users(spark, sf_dir), products(spark, sf_dir))


def _tested_models(spark, sf_dir):
    return M.with_stored_marts(_models(spark, sf_dir))


def stg_orders(spark, sf_dir):
    return M.stg_orders(orders(spark, sf_dir))


def stg_customer(spark, sf_dir):
    return M.stg_users(users(spark, sf_dir))


def stg_part(spark, sf_dir):
    return M.stg_products(products(spark, sf_dir))


def mart_orders_summary(spark, sf_dir):
    return _models(spark, sf_dir)["mart_orders_summary"]


def mart_user_activity(spark, sf_dir):
    return _models(spark, sf_dir)["mart_user_activity"]


def mart_orders_unrounded(spark, sf_dir):
    """The project variant of the mart keeps full precision; shown here at four digits."""
    mart = M.mart_orders_summary(stg_orders(spark, sf_dir), digits=None)
    return mart.select(
        "order_date", "order_status", "total_orders", settled(F.col("total_revenue"), 4).alias("total_revenue"),
        settled(F.col("avg_order_value"), 4).alias("avg_order_value"), "flagged_orders",
    )


def daily_nonpositive_revenue(spark, sf_dir):
    """Invalid totals are negative; days on which they outweigh the valid ones."""
    only = stg_orders(spark, sf_dir)
    signed = only.withColumn(
        "order_total", F.when(F.col("order_status") == "refunded", -2 * F.abs("order_total")).otherwise(F.col("order_total"))
    )
    days = M.nonpositive_days(M.mart_orders_summary(signed))
    return days.select("order_date", F.round("day_revenue", 2).alias("day_revenue"))


# -- suites -----------------------------------------------------------------------------------

ORDER_RULES = S.orders_rules(STATUSES, rows=(100, 1_000_000_000))
PRODUCT_RULES = S.products_rules(CATEGORIES)
USER_RULES = S.users_rules(COUNTRIES)


def suite_orders(spark, sf_dir):
    return R.evaluate(orders(spark, sf_dir), "orders_suite", "orders", ORDER_RULES)


def suite_part(spark, sf_dir):
    return R.evaluate(products(spark, sf_dir), "products_suite", "products", PRODUCT_RULES)


def suite_customer(spark, sf_dir):
    return R.evaluate(users(spark, sf_dir), "users_suite", "users", USER_RULES)


def all_suites(spark, sf_dir):
    return S.run_suites(
        {
            "orders": (orders(spark, sf_dir), ORDER_RULES),
            "products": (products(spark, sf_dir), PRODUCT_RULES),
            "users": (users(spark, sf_dir), USER_RULES),
        }
    )


def suite_summary(spark, sf_dir):
    return R.summarize(all_suites(spark, sf_dir), "suite", "table_name")


def suite_overall(spark, sf_dir):
    return R.summarize(all_suites(spark, sf_dir))


def rule_sql(rel: str, table_name: str, rules) -> str:
    """One query per rule, written the long way."""
    out = []
    for r in rules:
        c = r.column
        broken = {
            "row_count_between": "count(*)",
            "not_null": f"count(*) - count({c})",
            "unique": f"(SELECT coalesce(sum(n), 0) FROM (SELECT count(*) AS n FROM {rel} WHERE {c} IS NOT NULL GROUP BY {c} HAVING count(*) > 1))",
            "between": f"count(*) FILTER ({c} < {r.low} OR {c} > {r.high})",
            "in_set": f"count(*) FILTER ({c} NOT IN {_in(r.values)})",
            "matches": f"count(*) FILTER (NOT regexp_matches({c}, '{r.pattern}'))",
        }[r.kind]
        total = "count(*)" if r.kind in ("not_null", "row_count_between") else f"count({c})"
        if r.kind == "row_count_between":
            passed = f"observed BETWEEN {r.low} AND {r.high}"
            detail = "'row count out of range'"
        elif r.kind == "unique":
            passed = "observed = 0"
            detail = "observed || ' of ' || total || ' break the rule'"
        else:
            passed = f"total = 0 OR CAST(total - observed AS DOUBLE) / total >= {r.mostly}"
            detail = "observed || ' of ' || total || ' break the rule'"
        out.append(
            f"SELECT '{table_name}_suite' AS suite, '{table_name}' AS table_name, '{c or 'TABLE'}' AS \"column\", "
            f"'{r.kind}' AS rule, {passed} AS passed, observed, CASE WHEN NOT ({passed}) THEN {detail} END AS detail "
            f"FROM (SELECT CAST({broken} AS BIGINT) AS observed, {total} AS total FROM {rel})"
        )
    return " UNION ALL ".join(out)


RULES_CTE = (
    "rules",
    " UNION ALL ".join(
        rule_sql(rel, name, rules)
        for rel, name, rules in (
            ("raw_orders", "orders", ORDER_RULES),
            ("raw_products", "products", PRODUCT_RULES),
            ("raw_users", "users", USER_RULES),
        )
    ),
)


def scalar_checks(spark, sf_dir):
    return S.shop_scalar_checks(
        orders(spark, sf_dir), products(spark, sf_dir), users(spark, sf_dir), STATUSES, COUNTRIES
    )


# -- model tests --------------------------------------------------------------------------------


def schema_tests(spark, sf_dir):
    return R.schema_tests(_tested_models(spark, sf_dir), S.model_catalogue(STATUSES, COUNTRIES, CATEGORIES))


def schema_tests_strict(spark, sf_dir):
    return R.schema_tests(_tested_models(spark, sf_dir), S.strict_catalogue(STATUSES, COUNTRIES, CATEGORIES))


def custom_tests(spark, sf_dir):
    as_views(_models(spark, sf_dir))
    return R.sql_tests(spark, S.MODEL_SQL_TESTS)


def model_report(spark, sf_dir):
    models = _tested_models(spark, sf_dir)
    as_views(models)
    schema = R.schema_tests(models, S.model_catalogue(STATUSES, COUNTRIES, CATEGORIES))
    return R.tests_report(schema.unionByName(R.sql_tests(spark, S.MODEL_SQL_TESTS)))


def _schema_tests_sql(catalogue) -> str:
    out = []
    for model, t in catalogue.items():
        def add(column, test, bad, passed, detail):
            out.append(
                f"SELECT '{model}' AS model, '{column}' AS \"column\", '{test}' AS test, {passed} AS passed, "
                f"CASE WHEN NOT ({passed}) THEN {detail} END AS detail FROM (SELECT {bad} AS bad, count(*) AS total FROM {model})"
            )

        for c in t.unique:
            add(c, "unique",
                f"(SELECT count(*) FROM (SELECT {c} FROM {model} WHERE {c} IS NOT NULL GROUP BY {c} HAVING count(*) > 1))",
                "bad = 0", "bad || ' duplicate(s)'")
        for c in t.not_null:
            add(c, "not_null", f"count(*) FILTER ({c} IS NULL)", "bad = 0", "bad || ' null(s)'")
        for c, share in t.not_null_mostly:
            add(c, f"not_null (≥{int(share * 100)}%)", f"count(*) FILTER ({c} IS NULL)",
                f"total > 0 AND CAST(total - bad AS DOUBLE) / total >= {share}",
                f"bad || ' nulls (' || {settle('(1 - CAST(total - bad AS DOUBLE) / total) * 100', 1)} || '%)'")
        for c, allowed in t.accepted_values:
            add(c, "accepted_values", f"count(*) FILTER ({c} IS NOT NULL AND {c} NOT IN {_in(allowed)})", "bad = 0",
                "bad || ' invalid value(s)'")
    return " UNION ALL ".join(out)


def _custom_sql() -> str:
    failing = {
        "stg_orders.order_total >= 0": "SELECT 1 FROM stg_orders WHERE order_total < 0",
        "mart_orders_summary.total_revenue > 0": "SELECT order_date FROM mart_orders_summary GROUP BY order_date HAVING sum(total_revenue) <= 0",
        "mart_user_activity.total_orders <= 500": "SELECT 1 FROM mart_user_activity WHERE total_orders > 500",
        "stg_products.price > 0": "SELECT 1 FROM stg_products WHERE price <= 0",
    }
    return " UNION ALL ".join(
        f"SELECT 'custom' AS model, '—' AS \"column\", '{t.name}' AS test, n = 0 AS passed, "
        f"CASE WHEN n > 0 THEN n || ' failing row(s): {t.description}' END AS detail "
        f"FROM (SELECT count(*) AS n FROM ({failing[t.name]}))"
        for t in S.MODEL_SQL_TESTS
    )


def value_between(spark, sf_dir):
    return R.value_between(orders(spark, sf_dir), "total", 0, 50_000)


def duplicate_keys(spark, sf_dir):
    return R.duplicate_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


def duplicate_key_count(spark, sf_dir):
    """Number of duplicated ids per unique column of the shop tables."""
    parts = [
        R.duplicate_rows(df, [c]).select(F.lit(name).alias("column"), F.col("values0").alias("duplicates"))
        for name, df, c in (
            ("orders.id", orders(spark, sf_dir), "id"),
            ("users.email", users(spark, sf_dir), "email"),
        )
    ]
    return parts[0].unionByName(parts[1])


def broken_rows(spark, sf_dir):
    """Row rules of the order suite applied row by row."""
    row_rules = [r for r in ORDER_RULES if r.kind not in ("unique", "row_count_between")]
    marked = R.split_rows(orders(spark, sf_dir), row_rules)
    return marked.filter(F.size("broken") > 0).groupBy(F.concat_ws(",", "broken").alias("broken")).agg(
        F.count(F.lit(1)).alias("n")
    )


_BROKEN = (
    "concat_ws(',', CASE WHEN id IS NULL THEN 'not_null(id)' END, CASE WHEN user_id IS NULL THEN 'not_null(user_id)' END, "
    "CASE WHEN total < 0 OR total > 100000 THEN 'between(total)' END, "
    f"CASE WHEN status NOT IN {_in(STATUSES)} THEN 'in_set(status)' END, "
    "CASE WHEN total IS NULL THEN 'not_null(total)' END, CASE WHEN product_id IS NULL THEN 'not_null(product_id)' END)"
)

QUERIES = {
    "stg_orders": stg_orders,
    "stg_customer": stg_customer,
    "stg_part": stg_part,
    "mart_orders_summary": mart_orders_summary,
    "mart_orders_unrounded": mart_orders_unrounded,
    "mart_user_activity": mart_user_activity,
    "daily_nonpositive_revenue": daily_nonpositive_revenue,
    "suite_orders": suite_orders,
    "suite_part": suite_part,
    "suite_customer": suite_customer,
    "suite_summary": suite_summary,
    "suite_overall": suite_overall,
    "scalar_checks": scalar_checks,
    "schema_tests": schema_tests,
    "schema_tests_strict": schema_tests_strict,
    "custom_tests": custom_tests,
    "model_report": model_report,
    "value_between": value_between,
    "duplicate_keys": duplicate_keys,
    "duplicate_key_count": duplicate_key_count,
    "broken_rows": broken_rows,
}

_SUMMARY = "count(*) FILTER (passed) AS passed, count(*) FILTER (NOT passed) AS failed, bool_and(passed) AS success"
_MART_4 = (
    "SELECT order_date, order_status, count(*) AS total_orders, " + settle("sum(order_total)", 4) + " AS total_revenue, "
    + settle("avg(order_total)", 4) + " AS avg_order_value, count(CASE WHEN total_flag <> 'ok' THEN 1 END) AS flagged_orders "
    "FROM stg_orders GROUP BY order_date, order_status"
)
_REPORT_CTE = (
    "tests",
    _schema_tests_sql(S.model_catalogue(STATUSES, COUNTRIES, CATEGORIES)) + " UNION ALL " + _custom_sql(),
)

ORACLE = {
    "stg_orders": ctes(*STG_CTES) + "SELECT * FROM stg_orders",
    "stg_customer": ctes(*STG_CTES) + "SELECT * FROM stg_users",
    "stg_part": ctes(*STG_CTES) + "SELECT * FROM stg_products",
    "mart_orders_summary": ctes(*STG_CTES) + "SELECT * FROM mart_orders_summary",
    "mart_orders_unrounded": ctes(*STG_CTES) + _MART_4,
    "mart_user_activity": ctes(*STG_CTES) + "SELECT * FROM mart_user_activity",
    "daily_nonpositive_revenue": ctes(
        *STG_CTES,
        (
            "signed",
            "SELECT * REPLACE (CASE WHEN order_status = 'refunded' THEN -2 * abs(order_total) ELSE order_total END AS order_total) "
            "FROM stg_orders",
        ),
        ("mart", f"SELECT order_date, order_status, {settle('sum(order_total)', 2)} AS total_revenue FROM signed GROUP BY 1, 2"),
    )
    + "SELECT order_date, round(sum(total_revenue), 2) AS day_revenue FROM mart GROUP BY 1 HAVING sum(total_revenue) <= 0",
    "suite_orders": ctes(*SHOP_CTES, RULES_CTE) + "SELECT * FROM rules WHERE table_name = 'orders'",
    "suite_part": ctes(*SHOP_CTES, RULES_CTE) + "SELECT * FROM rules WHERE table_name = 'products'",
    "suite_customer": ctes(*SHOP_CTES, RULES_CTE) + "SELECT * FROM rules WHERE table_name = 'users'",
    "suite_summary": ctes(*SHOP_CTES, RULES_CTE) + f"SELECT suite, table_name, {_SUMMARY} FROM rules GROUP BY 1, 2",
    "suite_overall": ctes(*SHOP_CTES, RULES_CTE) + f"SELECT {_SUMMARY} FROM rules",
    "scalar_checks": ctes(*SHOP_CTES)
    + " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, '{label}' AS label, {value} AS value, {ok} AS passed FROM raw_{t}"
        for t, label, value, ok in (
            ("orders", "rows: over 100", "count(*)", "count(*) > 100"),
            ("orders", "total: nulls under 10%", "count(*) FILTER (total IS NULL)",
             "CAST(count(*) FILTER (total IS NULL) AS DOUBLE) / count(*) < 0.10"),
            ("orders", f"status: one of {len(STATUSES)} codes", f"count(*) FILTER (status NOT IN {_in(STATUSES)})",
             f"count(*) FILTER (status NOT IN {_in(STATUSES)}) = 0"),
            ("orders", "id: no nulls", "count(*) FILTER (id IS NULL)", "count(*) FILTER (id IS NULL) = 0"),
            ("products", "price: over 0", "count(*) FILTER (price <= 0)", "count(*) FILTER (price <= 0) = 0"),
            ("products", "name: no nulls", "count(*) FILTER (name IS NULL)", "count(*) FILTER (name IS NULL) = 0"),
            ("products", "price: no nulls", "count(*) FILTER (price IS NULL)", "count(*) FILTER (price IS NULL) = 0"),
            ("users", "email: no nulls", "count(*) FILTER (email IS NULL)", "count(*) FILTER (email IS NULL) = 0"),
            ("users", "id: no nulls", "count(*) FILTER (id IS NULL)", "count(*) FILTER (id IS NULL) = 0"),
            ("users", f"country: one of {len(COUNTRIES)} codes", f"count(*) FILTER (country NOT IN {_in(COUNTRIES)})",
             f"count(*) FILTER (country NOT IN {_in(COUNTRIES)}) = 0"),
        )
    ),
    "schema_tests": ctes(*STG_CTES) + _schema_tests_sql(S.model_catalogue(STATUSES, COUNTRIES, CATEGORIES)),
    "schema_tests_strict": ctes(*STG_CTES) + _schema_tests_sql(S.strict_catalogue(STATUSES, COUNTRIES, CATEGORIES)),
    "custom_tests": ctes(*STG_CTES) + _custom_sql(),
    "model_report": ctes(*STG_CTES, _REPORT_CTE)
    + "SELECT count(*) AS total, count(*) FILTER (passed) AS passed, count(*) FILTER (NOT passed) AS failed, "
    "bool_and(passed) AS success FROM tests",
    "value_between": ctes(*SHOP_CTES) + "SELECT total FROM raw_orders WHERE total IS NOT NULL AND (total < 0 OR total > 50000)",
    "duplicate_keys": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem "
    "WHERE l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1",
    "duplicate_key_count": ctes(*SHOP_CTES)
    + "SELECT 'orders.id' AS \"column\", count(*) AS duplicates FROM (SELECT id FROM raw_orders WHERE id IS NOT NULL "
    "GROUP BY id HAVING count(*) > 1) UNION ALL SELECT 'users.email', count(*) FROM (SELECT email FROM raw_users "
    "WHERE email IS NOT NULL GROUP BY email HAVING count(*) > 1)",
    "broken_rows": ctes(*SHOP_CTES)
    + f"SELECT {_BROKEN} AS broken, count(*) AS n FROM raw_orders WHERE {_BROKEN} <> '' GROUP BY 1",
}
