"""Rule suites, scalar checks and model tests of the shop tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.rules import (
    ModelTests,
    Rule,
    ScalarCheck,
    SqlTest,
    between,
    evaluate,
    in_set,
    matches,
    not_null,
    row_count_between,
    scalar_checks,
    unique,
)

# Accepted codes, bounds and shares of the shop tables.
ORDER_STATUSES = ("paid", "pending", "cancelled", "refunded")
CATEGORIES = ("Electronics", "Clothing", "Books", "Home", "Sports")
COUNTRIES = ("LK", "US", "UK", "IN", "AU", "DE")
EMAIL_PATTERN = r"^[^@]+@[^@]+\.[^@]+$"
MIN_ORDERS = 100
MAX_NULL_TOTALS = 0.10


# Bounds and shares of the rules.
def orders_rules(statuses=ORDER_STATUSES, rows=(100, 1_000_000)) -> list[Rule]:
    return [
        row_count_between(*rows),
        unique("id"),
        not_null("id"),
        not_null("user_id"),
        between("total", 0, 100_000, mostly=0.95),
        in_set("status", statuses),
        not_null("total", mostly=0.90),
        not_null("product_id"),
    ]


# Bounds and shares of the rules.
def products_rules(categories=CATEGORIES, rows=(1, 10_000_000)) -> list[Rule]:
    return [
        row_count_between(*rows),
        unique("id"),
        not_null("id"),
        not_null("name"),
        between("price", 0.01, 99_999),
        not_null("price"),
        in_set("category", categories),
        not_null("stock", mostly=0.80),
        between("stock", 0, 100_000, mostly=0.95),
    ]


# Bounds and shares of the rules.
def users_rules(countries=COUNTRIES, rows=(1, 50_000_000)) -> list[Rule]:
    return [
        row_count_between(*rows),
        unique("id"),
        not_null("id"),
        not_null("email"),
        matches("email", EMAIL_PATTERN, mostly=0.99),
        unique("email"),
        in_set("country", countries),
        between("age", 13, 120, mostly=0.95),
        not_null("age", mostly=0.90),
        not_null("joined"),
    ]


def run_suites(suites: dict[str, tuple[DataFrame, list[Rule]]]) -> DataFrame:
    """Rule rows of several tables; each table is read once plus once for its unique columns."""
    return reduce(
        DataFrame.unionByName, [evaluate(df, f"{name}_suite", name, rules) for name, (df, rules) in suites.items()]
    )


def shop_scalar_checks(
    orders: DataFrame,
    products: DataFrame,
    users: DataFrame,
    statuses=ORDER_STATUSES,
    countries=COUNTRIES,
) -> DataFrame:
    """Scalar checks of the shop tables, named after column and condition; shares are taken of the real row count."""
    checks = (
        ("orders", orders, [
            ScalarCheck(f"rows: over {MIN_ORDERS}", None, lambda n, rows: n > MIN_ORDERS),
            _null_share_below("total", MAX_NULL_TOTALS),
            _only_codes("status", statuses),
            _no_nulls("id"),
        ]),
        ("products", products, [_none("price: over 0", F.col("price") <= 0), _no_nulls("name"), _no_nulls("price")]),
        ("users", users, [_no_nulls("email"), _no_nulls("id"), _only_codes("country", countries)]),
    )
    return reduce(DataFrame.unionByName, [scalar_checks(df, name, found) for name, df, found in checks])


def _none(label: str, broken: Column) -> ScalarCheck:
    return ScalarCheck(label, broken, lambda n, rows: n == 0)


def _no_nulls(column: str) -> ScalarCheck:
    return _none(f"{column}: no nulls", F.col(column).isNull())


def _only_codes(column: str, codes) -> ScalarCheck:
    return _none(f"{column}: one of {len(codes)} codes", ~F.col(column).isin(list(codes)))


def _null_share_below(column: str, share: float) -> ScalarCheck:
    return ScalarCheck(f"{column}: nulls under {share:.0%}", F.col(column).isNull(), lambda n, rows: F.try_divide(n, rows) < share)


# Columns, shares and codes of the tests.
def model_catalogue(
    statuses=ORDER_STATUSES, countries=COUNTRIES, categories=CATEGORIES
) -> dict[str, ModelTests]:
    """Schema tests of the five models."""
    return {
        "stg_orders": ModelTests(
            unique=("order_id",),
            not_null=("order_id", "user_id", "product_id", "order_status", "order_date"),
            not_null_mostly=(("order_total", 0.90),),
            accepted_values=(("order_status", tuple(statuses)),),
        ),
        "stg_users": ModelTests(
            unique=("user_id", "email"),
            not_null=("user_id", "email", "joined_date"),
            not_null_mostly=(("age", 0.90),),
            accepted_values=(("country_code", tuple(countries)),),
        ),
        "stg_products": ModelTests(
            unique=("product_id",),
            not_null=("product_id", "product_name", "price", "category"),
            not_null_mostly=(("stock_qty", 0.80),),
            accepted_values=(("category", tuple(categories)),),
        ),
        "mart_orders_summary": ModelTests(not_null=("order_date", "order_status", "total_orders")),
        "mart_user_activity": ModelTests(unique=("user_id",), not_null=("user_id", "email")),
    }


# Columns, shares and codes of the tests.
def strict_catalogue(
    statuses=ORDER_STATUSES, countries=COUNTRIES, categories=CATEGORIES
) -> dict[str, ModelTests]:
    """The stricter variant: no tolerated shares, totals and country codes never null."""
    return {
        "stg_orders": ModelTests(
            unique=("order_id",),
            not_null=("order_id", "user_id", "product_id", "order_total", "order_status", "order_date"),
            accepted_values=(("order_status", tuple(statuses)),),
        ),
        "stg_users": ModelTests(
            unique=("user_id", "email"),
            not_null=("user_id", "email", "country_code", "joined_date"),
            accepted_values=(("country_code", tuple(countries)),),
        ),
        "stg_products": ModelTests(
            unique=("product_id",),
            not_null=("product_id", "product_name", "price", "category"),
            accepted_values=(("category", tuple(categories)),),
        ),
        "mart_orders_summary": ModelTests(not_null=("order_date", "order_status", "total_orders")),
        "mart_user_activity": ModelTests(unique=("user_id",), not_null=("user_id", "email")),
    }


def bound_test(model: str, value: str, keeps: str, *keys: str, total: bool = False) -> SqlTest:
    """Rows of a model, or with ``total`` sums by ``keys``, whose value does not keep a bound such as ``>= 0``."""
    shown = f"sum({value})" if total else value
    broken = f"GROUP BY {', '.join(keys)} HAVING NOT {shown} {keeps}" if total else f"WHERE NOT {value} {keeps}"
    return SqlTest(
        f"{model}.{value} {keeps}",
        f"{shown} {keeps} for every {', '.join(keys)}",
        f"SELECT {', '.join(keys)}, {shown} AS {value} FROM {model} {broken}",
    )


# The bounds that models have to keep.
MODEL_SQL_TESTS = (
    bound_test("stg_orders", "order_total", ">= 0", "order_id"),
    bound_test("mart_orders_summary", "total_revenue", "> 0", "order_date", total=True),
    bound_test("mart_user_activity", "total_orders", "<= 500", "user_id"),
    bound_test("stg_products", "price", "> 0", "product_id"),
)
