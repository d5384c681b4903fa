"""Staging and mart models as DataFrame functions.

Raw tables carry the columns ``orders(id, user_id, product_id, total, status, created_at)``,
``users(id, email, country, age, joined)`` and ``products(id, name, category, price, stock)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.scalars import half_even_int, settle
from plumbline.session import stored

SUSPICIOUS_TOTAL = 50_000


def stg_orders(orders: DataFrame) -> DataFrame:
    total = F.col("total")
    return orders.filter(F.col("id").isNotNull()).select(
        F.col("id").alias("order_id"),
        "user_id",
        "product_id",
        total.cast("double").alias("order_total"),
        F.lower(F.trim("status")).alias("order_status"),
        F.col("created_at").cast("date").alias("order_date"),
        F.when(total.isNull(), "missing_total")
        .when(total <= 0, "invalid_total")
        .when(total > SUSPICIOUS_TOTAL, "suspicious_total")
        .otherwise("ok")
        .alias("total_flag"),
    )


def stg_users(users: DataFrame) -> DataFrame:
    return users.filter(F.col("id").isNotNull()).select(
        F.col("id").alias("user_id"),
        F.lower(F.trim("email")).alias("email"),
        F.upper(F.trim("country")).alias("country_code"),
        half_even_int(F.col("age")).alias("age"),
        F.col("joined").cast("date").alias("joined_date"),
        # a missing e-mail makes the first condition NULL and falls through
        F.when(~F.col("email").like("%@%"), "invalid_email")
        .when(F.col("country").isNull(), "missing_country")
        .otherwise("ok")
        .alias("user_flag"),
    )


def stg_products(products: DataFrame) -> DataFrame:
    price = F.col("price")
    return products.filter(F.col("id").isNotNull()).select(
        F.col("id").alias("product_id"),
        F.trim("name").alias("product_name"),
        F.trim("category").alias("category"),
        price.cast("double").alias("price"),
        half_even_int(F.col("stock")).alias("stock_qty"),
        F.when(price.isNull() | (price <= 0), "invalid_price")
        .when(F.col("stock").isNull(), "no_stock_info")
        .otherwise("ok")
        .alias("product_flag"),
    )


def mart_orders_summary(orders: DataFrame, digits: int | None = 2) -> DataFrame:
    """Orders per date and status; ``digits=None`` leaves sums and means unrounded."""
    shown = (lambda c: c) if digits is None else (lambda c: settle(c, digits))
    return orders.groupBy("order_date", "order_status").agg(
        F.count(F.lit(1)).alias("total_orders"),
        shown(F.sum("order_total")).alias("total_revenue"),
        shown(F.avg("order_total")).alias("avg_order_value"),
        F.count_if(F.col("total_flag") != "ok").alias("flagged_orders"),
    )


def mart_user_activity(users: DataFrame, orders: DataFrame, digits: int | None = 2) -> DataFrame:
    """Order count, lifetime value and order dates per user; users without orders count 0.

    Orders are summed per user before the join, so a user with very many orders is combined
    map-side and the join moves one row per user. The final group-by keeps the partitioning of
    the join key.
    """
    per_user = orders.filter(F.col("user_id").isNotNull()).groupBy("user_id").agg(
        F.count("order_id").alias("n"),
        F.sum("order_total").alias("value"),
        F.max("order_date").alias("last"),
        F.min("order_date").alias("first"),
    )
    shown = (lambda c: c) if digits is None else (lambda c: settle(c, digits))
    return (
        users.join(per_user, "user_id", "left")
        .groupBy("user_id", "email", "country_code", "age")
        .agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("total_orders"),
            shown(F.sum("value")).alias("lifetime_value"),
            F.max("last").alias("last_order_date"),
            F.min("first").alias("first_order_date"),
        )
    )


def newest_first(mart: DataFrame) -> DataFrame:
    """The daily mart as readers show it: newest date first, then by status."""
    return mart.orderBy(F.desc("order_date"), "order_status")


def nonpositive_days(summary: DataFrame) -> DataFrame:
    """Days whose revenue over all statuses is not positive."""
    return (
        summary.groupBy("order_date")
        .agg(F.sum("total_revenue").alias("day_revenue"))
        .filter(F.col("day_revenue") <= 0)
    )


def build_models(orders: DataFrame, users: DataFrame, products: DataFrame) -> dict[str, DataFrame]:
    """All models by name, staging first."""
    so, su, sp = stg_orders(orders), stg_users(users), stg_products(products)
    return {
        "stg_orders": so,
        "stg_users": su,
        "stg_products": sp,
        "mart_orders_summary": mart_orders_summary(so),
        "mart_user_activity": mart_user_activity(su, so),
    }


def with_stored_marts(models: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Write the marts to the shared folder and read them back; staging models stay views.

    Tests read a mart several times, a stored one is computed once.
    """
    return {name: stored(df, name) if name.startswith("mart_") else df for name, df in models.items()}
