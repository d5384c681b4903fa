from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from plumbline.operators import rules as R
from plumbline.plans import models as M
from plumbline.plans import suites as S
from plumbline.sources.sinks import as_views
from tests.helpers import by, final_plan


def one(df, rule):
    return R.evaluate(df, "s", "t", [rule]).first()


@pytest.fixture(scope="module")
def ten(spark):
    """Ten rows: v has one null and two equal values, w is 1..10."""
    rows = [(i, None if i == 10 else min(i, 8), f"k{i % 3}", f"u{i}@x.com" if i < 10 else "broken") for i in range(1, 11)]
    return spark.createDataFrame(rows, "w int, v int, k string, mail string")


@pytest.mark.parametrize(("low", "high", "ok"), [(10, 10, True), (1, 9, False), (11, 20, False)])
def test_row_count(ten, low, high, ok):
    r = one(ten, R.row_count_between(low, high))
    assert (r["passed"], r["observed"], r["column"]) == (ok, 10, "TABLE")


@pytest.mark.parametrize(("mostly", "ok"), [(1.0, False), (0.9, True), (0.91, False)])
def test_not_null_counts_all_rows(ten, mostly, ok):
    r = one(ten, R.not_null("v", mostly))
    assert (r["passed"], r["observed"]) == (ok, 1)


def test_unique_counts_every_row_of_a_repeated_value(ten):
    r = one(ten, R.unique("v"))
    assert (r["passed"], r["observed"], r["detail"]) == (False, 2, "2 of 9 break the rule")
    assert one(ten, R.unique("w"))["passed"]


@pytest.mark.parametrize(("high", "mostly", "ok"), [(8, 1.0, True), (7, 1.0, False), (7, 7 / 9, True), (7, 0.78, False)])
def test_between_ignores_nulls(ten, high, mostly, ok):
    assert one(ten, R.between("v", 1, high, mostly))["passed"] is ok


def test_in_set_and_pattern(ten):
    assert one(ten, R.in_set("k", ["k0", "k1", "k2"]))["passed"]
    assert one(ten, R.in_set("k", ["k0", "k1"]))["observed"] == 3
    assert one(ten, R.matches("mail", S.EMAIL_PATTERN, 0.9))["passed"]
    assert not one(ten, R.matches("mail", S.EMAIL_PATTERN, 0.91))["passed"]


def test_empty_table_passes_everything_but_the_row_count(spark):
    empty = spark.createDataFrame([], "v int, k string")
    rules = [R.row_count_between(1, 5), R.unique("v"), R.not_null("v"), R.between("v", 0, 1), R.in_set("k", ["a"]), R.matches("k", "a")]
    got = {r["rule"]: r["passed"] for r in R.evaluate(empty, "s", "t", rules).collect()}
    assert got.pop("row_count_between") is False and all(got.values()) and len(got) == 5


def test_suites_hold_27_rules():
    assert [len(f()) for f in (S.orders_rules, S.products_rules, S.users_rules)] == [8, 9, 10]


def test_summary(ten):
    res = R.evaluate(ten, "s", "t", [R.unique("v"), R.unique("w"), R.not_null("w")])
    assert tuple(R.summarize(res, "table_name").first()) == ("t", 2, 1, False)
    assert tuple(R.summarize(res.filter("passed")).first()) == (2, 0, True)


def test_one_scan_for_row_rules_and_one_for_unique(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(50).selectExpr("id", "id % 3 AS g", "CAST(id AS STRING) AS s", "id AS unused").write.parquet(path)
    rules = [R.row_count_between(1, 99), R.not_null("id"), R.between("g", 0, 2), R.in_set("g", [0, 1, 2]), R.unique("id"), R.unique("s")]
    text = R.evaluate(spark.read.parquet(path), "s", "t", rules)._jdf.queryExecution().executedPlan().toString()
    assert text.count("FileScan") == 2 and "unused" not in text


def test_split_rows(ten):
    got = by(R.split_rows(ten, [R.not_null("v"), R.between("v", 1, 7), R.in_set("k", ["k0", "k1"])]), "w")
    assert got[1]["broken"] == [] and got[10]["broken"] == ["not_null(v)"]
    assert got[8]["broken"] == ["between(v)", "in_set(k)"]


def test_scalar_checks_use_the_real_row_count(spark):
    orders = spark.range(1, 201).selectExpr("id", "IF(id <= 19, NULL, 5.0) AS total", "IF(id = 3, 'odd', 'paid') AS status")
    products = spark.createDataFrame([(1.0, "a"), (0.0, "b"), (None, "c")], "price double, name string")
    users = spark.createDataFrame([(1, "a@b.c", "LK"), (2, None, None)], "id int, email string, country string")
    got = by(S.shop_scalar_checks(orders, products, users), "table_name", "label")
    assert len(got) == 10
    assert got["orders", "rows: over 100"]["passed"] and got["orders", "total: nulls under 10%"]["passed"]
    assert not got["orders", "status: one of 4 codes"]["passed"]
    assert not got["products", "price: over 0"]["passed"] and not got["products", "price: no nulls"]["passed"]
    assert not got["users", "email: no nulls"]["passed"] and got["users", "country: one of 6 codes"]["passed"]
    more = S.shop_scalar_checks(orders.withColumn("total", F.expr("IF(id <= 20, NULL, 5.0)")), products, users)
    assert not by(more, "table_name", "label")["orders", "total: nulls under 10%"]["passed"]


# -- models ---------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def shop(spark):
    orders = spark.createDataFrame(
        [
            (1, 1, 1, 10.0, " Paid ", "2024-01-01"), (2, 1, 1, None, "PENDING", "2024-01-01"),
            (3, 2, 1, 0.0, "paid", "2024-01-02"), (4, 2, 1, 50000.0, "paid", "2024-01-02"),
            (5, 2, 1, 50000.01, "paid", "2024-01-03"), (6, None, 1, -5.0, "refunded", "2024-01-04"),
            (None, 2, 1, 7.0, "paid", "2024-01-01"),
        ],
        "id int, user_id int, product_id int, total double, status string, created_at string",
    )
    users = spark.createDataFrame(
        [
            (1, " A@x.com ", "lk", 20.5, "2022-01-01"), (2, "nomail", None, 21.5, "2022-01-01"),
            (3, None, None, None, "2022-01-01"), (4, None, "us ", 30.0, "2022-01-01"), (None, "z@z.z", "de", 1.0, "2022-01-01"),
        ],
        "id int, email string, country string, age double, joined string",
    )
    products = spark.createDataFrame(
        [(1, " pen ", " Books", 1.0, 2.5), (2, "x", "Home", 0.0, None), (3, "y", "Home", None, None), (4, "z", "Home", 2.0, None)],
        "id int, name string, category string, price double, stock double",
    )
    return orders, users, products


def test_staging_orders(shop):
    got = by(M.stg_orders(shop[0]), "order_id")
    assert len(got) == 6
    assert [got[i]["total_flag"] for i in range(1, 7)] == [
        "ok", "missing_total", "invalid_total", "ok", "suspicious_total", "invalid_total",
    ]
    assert got[1]["order_status"] == "paid" and str(got[1]["order_date"]) == "2024-01-01"


def test_staging_users_and_products(shop):
    u = by(M.stg_users(shop[1]), "user_id")
    assert u[1]["email"] == "a@x.com" and u[1]["country_code"] == "LK"
    assert (u[1]["age"], u[2]["age"]) == (20, 22)  # ties go to the even neighbour
    # a missing e-mail is not an invalid one
    assert [u[i]["user_flag"] for i in (1, 2, 3, 4)] == ["ok", "invalid_email", "missing_country", "ok"]
    p = by(M.stg_products(shop[2]), "product_id")
    assert [p[i]["product_flag"] for i in (1, 2, 3, 4)] == ["ok", "invalid_price", "invalid_price", "no_stock_info"]
    assert p[1]["product_name"] == "pen" and p[1]["category"] == "Books" and p[1]["stock_qty"] == 2


def test_marts(shop):
    models = M.build_models(*shop)
    s = by(models["mart_orders_summary"], "order_date", "order_status")
    day2 = next(r for (d, st), r in s.items() if str(d) == "2024-01-02")
    assert (day2["total_orders"], day2["total_revenue"], day2["avg_order_value"], day2["flagged_orders"]) == (2, 50000.0, 25000.0, 1)
    a = by(models["mart_user_activity"], "user_id")
    assert len(a) == 4
    assert (a[3]["total_orders"], a[3]["lifetime_value"], a[3]["last_order_date"]) == (0, None, None)
    assert (a[1]["total_orders"], a[1]["lifetime_value"]) == (2, 10.0)
    assert str(a[2]["first_order_date"]) == "2024-01-02" and str(a[2]["last_order_date"]) == "2024-01-03"
    assert [str(r["order_date"]) for r in M.nonpositive_days(models["mart_orders_summary"]).collect()] == ["2024-01-04"]


def test_user_mart_with_repeated_users(spark, shop):
    su = M.stg_users(shop[1]).filter("user_id = 1")
    rows = M.mart_user_activity(su.unionByName(su), M.stg_orders(shop[0])).collect()
    assert len(rows) == 1 and rows[0]["total_orders"] == 4 and rows[0]["lifetime_value"] == 20.0


def test_catalogues():
    count = lambda cat: sum(len(t.unique) + len(t.not_null) + len(t.not_null_mostly) + len(t.accepted_values) for t in cat.values())
    assert count(S.model_catalogue()) == 28 and count(S.strict_catalogue()) == 27


def test_model_tests(shop):
    models = M.with_stored_marts(M.build_models(*shop))
    got = by(R.schema_tests(models, S.model_catalogue()), "model", "column", "test")
    assert len(got) == 28
    assert got["stg_orders", "order_id", "unique"]["passed"]
    assert got["stg_orders", "user_id", "not_null"]["detail"] == "1 null(s)"
    total = got["stg_orders", "order_total", "not_null (≥90%)"]
    assert not total["passed"] and total["detail"] == "1 nulls (16.7%)"
    assert got["stg_users", "country_code", "accepted_values"]["passed"]
    assert got["mart_user_activity", "user_id", "unique"]["passed"]


def test_mostly_fails_on_an_empty_model(spark):
    empty = spark.createDataFrame([], "a int")
    row = R.model_tests(empty, "m", R.ModelTests(not_null_mostly=(("a", 0.5),))).first()
    assert row["passed"] is False and row["detail"] == "0 nulls (100.0%)"


def test_duplicates_count_values(spark):
    df = spark.createDataFrame([(1,), (1,), (1,), (2,), (2,), (3,), (None,), (None,)], "a int")
    assert R.model_tests(df, "m", R.ModelTests(unique=("a",))).first()["detail"] == "2 duplicate(s)"
    assert sorted(map(tuple, R.duplicate_keys(df, ["a"]).collect())) == [(1, 3), (2, 2)]


def test_sql_tests(spark, shop):
    as_views(M.build_models(*shop))
    got = by(R.sql_tests(spark, S.MODEL_SQL_TESTS), "test")
    assert got["stg_orders.order_total >= 0"]["detail"].startswith("1 failing row(s): ")
    assert not got["mart_orders_summary.total_revenue > 0"]["passed"]
    assert got["mart_user_activity.total_orders <= 500"]["passed"] and not got["stg_products.price > 0"]["passed"]
    assert R.failing_rows(spark, S.MODEL_SQL_TESTS[0], 5).count() == 1
    report = R.tests_report(R.sql_tests(spark, S.MODEL_SQL_TESTS)).first()
    assert tuple(report) == (4, 1, 3, False)


def test_value_between(spark):
    df = spark.createDataFrame([(0,), (5,), (10,), (11,), (-1,), (None,)], "a int")
    assert sorted(r["a"] for r in R.value_between(df, "a", 0, 10).collect()) == [-1, 11]


def test_user_mart_shuffles_orders_once_per_key(shop):
    text = final_plan(M.mart_user_activity(M.stg_users(shop[1]), M.stg_orders(shop[0])))
    assert "CartesianProduct" not in text and "BroadcastNestedLoop" not in text


def test_rules_on_dates_decimals_and_empty_sets(spark):
    import datetime as dt
    from decimal import Decimal

    df = spark.sql("SELECT * FROM VALUES (DATE'2024-01-01', TIMESTAMP'2024-01-01 10:00:00', 1.50BD, 'a'), (DATE'2025-01-01', NULL, 9.99BD, NULL) AS t(d, ts, n, s)")
    rules = [
        R.between("d", dt.date(2024, 1, 1), dt.date(2024, 12, 31)), R.between("ts", dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1, 10)),
        R.between("n", Decimal("1.5"), Decimal("2")), R.in_set("s", []), R.in_set("s", [None]), R.in_set("s", ["a", None]),
    ]
    assert [r["observed"] for r in R.evaluate(df, "s", "t", rules).collect()] == [1, 0, 1, 1, 1, 0]
    broken = [len(r["broken"]) for r in R.split_rows(df, rules).orderBy("d").collect()]
    assert broken == [2, 2]
