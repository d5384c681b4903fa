from __future__ import annotations

import datetime as dt
import random
import statistics

import numpy as np
import pytest

from plumbline.operators import detect as D
from plumbline.operators.iforest import grow_tree, isolation_forest, score_forest
from plumbline.operators.report import best_findings, detect_all
from tests.helpers import by, clean_days, final_plan, history, with_today


def metrics(df):
    return by(df, "metric")


# -- scenarios: quiet month plus one day -----------------------------------------------------------


def test_row_crash_is_critical_in_both(spark):
    h = history(spark, with_today(row_count=9))
    for found in (D.zscore(h), D.iqr(h)):
        f = metrics(found)["row_count"]
        assert (f["severity"], f["direction"], f["today"]) == ("CRITICAL", "LOW", 9.0)


def test_small_row_change_is_ignored(spark):
    h = history(spark, with_today(row_count=1970))
    assert "row_count" not in metrics(D.zscore(h)) and "row_count" not in metrics(D.iqr(h))


def test_null_spike(spark):
    h = history(spark, with_today(null_pct__total=45.2))
    assert metrics(D.zscore(h))["null_pct.total"]["direction"] == "HIGH"
    assert metrics(D.iqr(h))["null_pct.total"]["severity"] == "CRITICAL"


def test_small_null_change_is_ignored(spark):
    assert "null_pct.total" not in metrics(D.zscore(history(spark, with_today(null_pct__total=2.8))))


def test_value_explosion(spark):
    h = history(spark, with_today(mean__total=100_000, std__total=40_000))
    assert {"mean.total", "std.total"} <= set(metrics(D.zscore(h)))


def test_wider_spread(spark):
    assert metrics(D.zscore(history(spark, with_today(std__total=4000))))["std.total"]["severity"] == "CRITICAL"


def test_double_load(spark):
    f = metrics(D.zscore(history(spark, with_today(row_count=4000))))["row_count"]
    assert (f["severity"], f["direction"]) == ("CRITICAL", "HIGH")


def test_clean_day_finds_nothing(spark):
    day = with_today(row_count=2005, null_pct__total=2.1, mean__total=1005, std__total=398)
    h = history(spark, day)
    assert D.zscore(h).count() == 0 and D.iqr(h).count() == 0


# -- exact arithmetic and boundaries ------------------------------------------------------------------


def test_zscore_arithmetic(spark):
    prior = [10, 12, 11, 13, 9, 10, 12]
    f = metrics(D.zscore(history(spark, {"row_count": [*prior, 30]})))["row_count"]
    z = (30 - statistics.mean(prior)) / statistics.stdev(prior)
    assert f["z_score"] == round(z, 2) and f["expected"] == round(statistics.mean(prior), 4)


def series_with_z(z):
    """Eight prior values with mean 0 and sample deviation sqrt(8/7), and today at z deviations."""
    prior = [1, -1] * 4
    return [*prior, z * statistics.stdev(prior)]


@pytest.mark.parametrize(
    ("z", "severity"),
    [(2.99, None), (3.001, "MEDIUM"), (-3.001, "MEDIUM"), (3.99, "MEDIUM"), (4.001, "HIGH"), (5.99, "HIGH"), (6.001, "CRITICAL")],
)
def test_zscore_steps(spark, z, severity):
    f = metrics(D.zscore(history(spark, {"row_count": series_with_z(z)})))
    assert (f["row_count"]["severity"] if f else None) == severity
    if f:
        assert f["row_count"]["direction"] == ("LOW" if z < 0 else "HIGH")


@pytest.mark.parametrize(
    ("today", "severity", "distance"),
    [(22.0, None, None), (22.1, "MEDIUM", 0.02), (29.9, "MEDIUM", 1.98), (30, "HIGH", 2.0), (37.9, "HIGH", 3.98),
     (38, "CRITICAL", 4.0), (5.9, "MEDIUM", 0.03), (6.0, None, None)],
)
def test_iqr_steps(spark, today, severity, distance):
    # quartiles 12 and 16, fences 6 and 22
    prior = [10, 11, 12, 13, 14, 15, 16, 17, 18]
    f = metrics(D.iqr(history(spark, {"row_count": [*prior, today]})))
    assert (f["row_count"]["severity"] if f else None) == severity
    if f:
        assert f["row_count"]["iqr_distance"] == pytest.approx(distance, abs=0.011)
        assert (f["row_count"]["lower_fence"], f["row_count"]["upper_fence"]) == (6.0, 22.0)


def test_iqr_quartiles_are_interpolated(spark):
    r = random.Random(3)
    prior = [round(r.uniform(0, 100), 3) for _ in range(10)]
    f = metrics(D.iqr(history(spark, {"row_count": [*prior, 1000]})))["row_count"]
    q1, q3 = np.quantile(prior, [0.25, 0.75])
    assert f["upper_fence"] == round(q3 + 1.5 * (q3 - q1), 4)


@pytest.mark.parametrize(("prior", "found"), [(6, 0), (7, 1)])
def test_warm_up_needs_seven_prior_values(spark, prior, found):
    values = [10, 12, 11, 13, 9, 10, 12][:prior]
    h = history(spark, {"row_count": [*values, 500]})
    assert D.zscore(h).count() == found and D.iqr(h).count() == found


def test_gaps_count_only_known_values(spark):
    h = history(spark, {"row_count": [5] * 9, "mean.x": [1, 2, None, 1, 2, 1, 2, None, 99]})
    assert D.zscore(h).count() == 0
    h = history(spark, {"row_count": [5] * 10, "mean.x": [1, 2, None, 1, 2, 1, 2, None, 1, 99]})
    assert set(metrics(D.zscore(h))) == {"mean.x"}


def test_metric_missing_today_is_not_judged(spark):
    """Today is the last snapshot of the table, not the last value of the metric."""
    h = history(spark, {"row_count": [5, 6] * 5, "mean.x": [1, 2, 1, 2, 1, 2, 1, 2, 99, None]})
    assert D.zscore(h).count() == 0 and D.iqr(h).count() == 0


def test_constant_history(spark):
    h = history(spark, {"null_pct.x": [0] * 10 + [50]})
    assert D.zscore(h).count() == 0 and D.iqr(h).count() == 0
    f = metrics(D.zscore(h, flag_constant_break=True))["null_pct.x"]
    assert (f["severity"], f["direction"], f["z_score"]) == ("HIGH", "HIGH", None)
    assert D.zscore(history(spark, {"null_pct.x": [0.1] * 11}), flag_constant_break=True).count() == 0


def test_many_tables_in_one_plan(spark):
    h = history(spark, with_today(row_count=9), table="a").unionByName(history(spark, with_today(), table="b"))
    assert {r["table_name"] for r in D.zscore(h).collect()} == {"a"}


def test_backtest_agrees_with_today(spark):
    h = history(spark, with_today(row_count=9, null_pct__total=45.2))
    last = {r["metric"]: r["z_score"] for r in D.zscore_backtest(h).collect() if r["today"] in (9.0, 45.2)}
    assert last == {m: f["z_score"] for m, f in metrics(D.zscore(h)).items()}


def long_history(spark, rng, days=400):
    """Series over many months with gaps, repeats, a constant part, jumps and missing values."""
    rows, start = [], dt.date(2022, 1, 1)
    for metric, level in (("mean.v", 1e9), ("row_count", 50.0), ("std.v", 0.1)):
        for day in range(days):
            value = level + (0 if metric == "std.v" and day < 90 else rng.choice([0.0, 1.0, 1.0, rng.gauss(0, 3), 40.0 if day % 97 == 0 else 2.0]))
            if rng.random() < 0.9:
                rows.append(("s", "t", start + dt.timedelta(days=day), metric, None if rng.random() < 0.05 else value))
    return rows, spark.createDataFrame(rows, "source string, table_name string, profiled_at date, metric string, value double")


def test_backtests_look_back_over_all_blocks(spark):
    """Both against plain loops over every earlier value, with blocks of a month and of a week."""
    rows, df = long_history(spark, random.Random(8))
    z, fences = {}, {}
    for metric in {r[3] for r in rows}:
        past = []
        for *_, day, _, value in sorted((r for r in rows if r[3] == metric), key=lambda r: r[2]):
            if value is not None:
                if len(past) >= 7:
                    std = 0 if min(past) == max(past) else statistics.stdev(past)
                    if std and abs(score := (value - statistics.fmean(past)) / std) >= 3:
                        z[metric, day] = score
                    q1, _, q3 = statistics.quantiles(past, n=4, method="inclusive")
                    low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
                    if q3 != q1 and not low <= value <= high:
                        fences[metric, day] = (low, high)
                past.append(value)
    for block in ("month", "week"):
        found = {(r["metric"], r["profiled_at"]): r["z_score"] for r in D.zscore_backtest(df, block=block).collect()}
        assert found.keys() == z.keys() and len(z) > 5
        assert all(found[k] == pytest.approx(z[k], abs=0.006) for k in z)
    found = {(r["metric"], r["profiled_at"]): (r["lower_fence"], r["upper_fence"]) for r in D.iqr_backtest(df).collect()}
    assert found.keys() == fences.keys() and len(fences) > 5
    assert all(found[k] == pytest.approx(fences[k], abs=1e-3) for k in fences)
    assert D.iqr_backtest(df.where("false")).count() == D.zscore_backtest(df.where("false")).count() == 0


def test_rank_counts_find_every_order_statistic():
    rng = random.Random(3)
    for size in (1, 2, 3, 8, 50):
        counts, added = D.RankCounts(size), []
        for rank in rng.sample(range(size), size):
            counts.add(rank)
            added.append(rank)
            assert [counts.smallest(k) for k in range(len(added))] == sorted(added)


def test_detectors_stay_in_the_jvm(spark):
    h = history(spark, with_today(row_count=9))
    for df in (D.zscore(h), D.iqr(h), D.zscore_backtest(h)):
        text = final_plan(df)
        assert "Python" not in text and "CartesianProduct" not in text


# -- isolation forest ------------------------------------------------------------------------------------


def forest_series(n=34, seed=42, **today):
    r = random.Random(seed)
    base = {
        "row_count": [1000 + r.randint(-20, 20) for _ in range(n)],
        "null_pct.total": [2 + r.uniform(-0.3, 0.3) for _ in range(n)],
        "mean.total": [500 + r.uniform(-10, 10) for _ in range(n)],
    }
    usual = {"row_count": 1000, "null_pct.total": 2.0, "mean.total": 500}
    usual.update({k.replace("__", "."): v for k, v in today.items()})
    return {m: [*v, usual[m]] for m, v in base.items()}


def test_forest_finds_joint_outlier(spark):
    h = history(spark, forest_series(row_count=50, null_pct__total=40, mean__total=5000))
    rows = isolation_forest(h).collect()
    assert len(rows) == 1
    f = rows[0]
    assert (f["detector"], f["metric"], f["direction"]) == ("isolation_forest", "all_metrics_combined", "MULTIVARIATE")
    assert f["severity"] == "CRITICAL" and -1 <= f["anomaly_score"] < 0 and f["today"] is None
    zs = [c["z_score"] for c in f["top_contributors"]]
    assert len(zs) == 3 and zs == sorted(zs, reverse=True)
    assert isolation_forest(h).collect() == rows


def test_forest_is_quiet_on_a_usual_day(spark):
    assert isolation_forest(history(spark, forest_series())).count() == 0


def test_forest_needs_ten_rows_and_two_metrics(spark):
    s = forest_series(n=8, row_count=50, null_pct__total=40, mean__total=5000)
    assert isolation_forest(history(spark, s)).count() == 0
    one = {"row_count": [1000 + i % 7 for i in range(30)] + [5]}
    assert isolation_forest(history(spark, one)).count() == 0


def test_forest_skips_metrics_with_gaps(spark):
    s = forest_series(row_count=50, null_pct__total=40, mean__total=5000)
    s["std.total"] = [None, *[1.0] * 33, 1e9]
    f = isolation_forest(history(spark, s)).collect()[0]
    assert "std.total" not in {c["metric"] for c in f["top_contributors"]}


def test_forest_scores_outliers_lower():
    x = np.random.default_rng(0).normal(size=(256, 3))
    trees = [grow_tree(x, seed) for seed in range(100)]
    inner, outer = score_forest(trees, 256, np.array([[0.0, 0, 0], [6.0, -6, 6]]))
    assert outer < -0.6 < inner < 0
    assert all(np.array_equal(a, grow_tree(x, seed)) for seed, a in enumerate(trees))


def test_every_tree_draws_its_own_rows_of_a_long_history(spark):
    """With 700 rows of history and trees of 64: the outlier is found whatever is drawn, and twice alike."""
    h = history(spark, forest_series(n=700, row_count=50, null_pct__total=40, mean__total=5000))
    rows = isolation_forest(h, subsample=64).collect()
    assert len(rows) == 1 and rows[0]["severity"] == "CRITICAL" and isolation_forest(h, subsample=64).collect() == rows


def test_forest_chunks_give_the_same_result(spark, monkeypatch):
    import plumbline.operators.iforest as M

    h = history(spark, forest_series(row_count=50, null_pct__total=40, mean__total=5000))
    whole = isolation_forest(h).collect()
    monkeypatch.setattr(M, "CHUNK_ROWS", 5)
    assert isolation_forest(h).collect() == whole


def test_report_keeps_one_finding_per_metric(spark):
    h = history(spark, with_today(row_count=9))
    best = metrics(best_findings(detect_all(h, with_forest=False)))
    assert best["row_count"]["detector"] == "zscore"
    assert clean_days()["row_count"][0] > 1900
