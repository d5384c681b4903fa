"""Quantiles by distributed selection against numpy, with hot values, short groups and brackets that miss."""

from __future__ import annotations

import random

import numpy as np
import pytest

from plumbline.operators import detect as D
from plumbline.operators.quantiles import exact_quantiles
from tests.helpers import by, final_plan, history, plan, with_today

PROBS = (0.0, 0.05, 0.25, 0.5, 0.75, 0.999, 1.0)


def groups():
    rng = random.Random(5)
    yield "normal", [rng.gauss(0, 10) for _ in range(4000)]
    yield "hot", [7.0] * 1500 + [rng.uniform(0, 20) for _ in range(1500)]
    yield "steps", [float(rng.randrange(4)) for _ in range(900)]
    yield None, [rng.expovariate(1) for _ in range(300)]
    yield "two", [1.0, 2.0]
    yield "one", [5.0]
    yield "huge", [1e300, -1e300, 0.0, 3.0]
    yield "gaps", [None, float("nan"), 4.0, None, 8.0]
    yield "empty", [None, float("nan")]


@pytest.fixture(scope="module")
def rows(spark):
    data = [(g, v, "x") for g, vs in groups() for v in vs]
    random.Random(1).shuffle(data)
    # columns named like those of the plan do no harm
    return spark.createDataFrame(data, "n string, v double, k string").repartition(7)


@pytest.mark.parametrize("accuracy", [10_000, 100, 3])
def test_quantiles_equal_numpy(rows, accuracy):
    """A coarse sketch makes wide brackets, or ones that miss; the result stays exact."""
    got = by(exact_quantiles(rows.withColumnRenamed("n", "grp"), ["grp", "k"], "v", PROBS, accuracy), "grp")
    want = {g: [v for v in vs if v is not None and v == v] for g, vs in groups()}
    assert got.keys() == {g for g, vs in want.items() if vs}
    for g, r in got.items():
        assert (r["n"], r["k"]) == (len(want[g]), "x")
        assert r["q"] == pytest.approx(list(np.quantile(want[g], PROBS)), rel=1e-12, abs=1e-12)


def test_no_groups_and_wrong_probabilities(rows):
    assert exact_quantiles(rows.where("false"), ["k"], "v", (0.5,)).count() == 0
    for probs in ((), (1.5,), (-0.1, 0.5)):
        with pytest.raises(ValueError):
            exact_quantiles(rows, ["k"], "v", probs)


def test_only_values_inside_the_brackets_are_ranked(spark):
    """Of 200,000 values few reach the window, and the plan has no value buffer and no Python."""
    df = spark.range(200_000).selectExpr("'g' AS g", "CAST(pmod(id * 7919, 200000) AS DOUBLE) AS v")
    out = exact_quantiles(df, ["g"], "v", (0.25, 0.75))
    row = out.first()
    assert (row["n"], row["q"]) == (200_000, [49_999.75, 149_999.25])
    text = final_plan(out)
    assert " percentile(" not in text and "Python" not in text and "NestedLoop" not in text


def test_values_stay_where_they_are_read(spark):
    """Large groups meet the few brackets by a broadcast; no task gets, or sorts, all values of a group."""
    df = spark.range(200_000).selectExpr("CAST(id % 2 AS STRING) AS g", "CAST(pmod(id * 7919, 200000) AS DOUBLE) AS v")
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "64k")  # less than the values, more than the brackets
    try:
        out = exact_quantiles(df, ["g"], "v", (0.25, 0.75))
        assert "BroadcastHashJoin" in plan(out) and "SortMergeJoin" not in plan(out)
        assert {g: r["n"] for g, r in by(out, "g").items()} == {"0": 100_000, "1": 100_000}
    finally:
        spark.conf.set(name, before)


def test_selected_quartiles_give_the_same_findings(spark):
    h = history(spark, with_today(row_count=9)).unionByName(history(spark, with_today(row_count=99_999), table="other"))
    want = by(D.iqr(h), "table_name", "metric")
    assert want and by(D.iqr_selected(h), "table_name", "metric") == want
    assert D.iqr_selected(h.where("false")).count() == 0
