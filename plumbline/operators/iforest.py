"""Isolation forest over all metrics of a table at once (Liu, Ting and Zhou, 2008).

Spark prepares standardised vectors once and draws a sample of the history for every tree by
hash; the trees of a table grow in groups of TREES_A_GROUP. A forest, which has a bounded size, is
joined to chunks of the history for scoring; the per-chunk work is numpy. A tree sees ``subsample`` rows
by the algorithm's definition, however long the history is.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.scalars import ladder, settle
from plumbline.operators.detect import as_findings
from plumbline.operators.snapshots import SERIES
from plumbline.session import stored

MIN_ROWS = 10
CONTAMINATION = 0.05
TREES = 100
SUBSAMPLE = 256
SEED = 42
# a row is offered to a tree with a probability that makes 2 * subsample offers likely; too few have a chance of 1e-30
OFFERS = 2
TREES_A_GROUP = 10  # a group holds that many times the subsample in rows
CHUNK_ROWS = 50_000
# Severity steps on the negated score (a lower score is worse).
SCORE_STEPS = ((-0.2, "MEDIUM"), (-0.3, "HIGH"))


def _mean_path(n: np.ndarray | float) -> np.ndarray:
    """Average depth of an unsuccessful search in a binary tree of ``n`` points."""
    n = np.asarray(n, dtype=float)
    big = np.maximum(n, 3.0)
    long = 2.0 * (np.log(big - 1.0) + np.euler_gamma) - 2.0 * (big - 1.0) / big
    return np.where(n > 2, long, np.where(n == 2, 1.0, 0.0))


def _grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> np.ndarray:
    """One tree as rows ``(feature, threshold, left, right, path)``; leaves have feature -1."""
    nodes: list[list[float]] = []
    todo = [(x, 0, -1, 0)]
    while todo:
        rows, depth, parent, side = todo.pop()
        me = len(nodes)
        if parent >= 0:
            nodes[parent][2 + side] = me
        low, high = rows.min(axis=0), rows.max(axis=0)
        open_features = np.flatnonzero(high > low)
        if depth >= limit or len(rows) <= 1 or not len(open_features):
            nodes.append([-1, 0.0, -1, -1, depth + float(_mean_path(len(rows)))])
            continue
        f = int(rng.choice(open_features))
        cut = rng.uniform(low[f], high[f])
        nodes.append([f, cut, -1, -1, 0.0])
        goes_left = rows[:, f] <= cut
        todo.append((rows[~goes_left], depth + 1, me, 1))
        todo.append((rows[goes_left], depth + 1, me, 0))
    return np.array(nodes)


def grow_tree(x: np.ndarray, seed: int) -> np.ndarray:
    """One tree on all rows of ``x``, as deep as a balanced tree of them."""
    return _grow(x, np.random.default_rng(seed), max(1, math.ceil(math.log2(max(len(x), 2)))))


def score_forest(trees: list[np.ndarray], size: int, x: np.ndarray) -> np.ndarray:
    """Scores in [-1, 0): the lower, the easier a point is isolated."""
    depth = np.zeros(len(x))
    every = np.arange(len(x))
    for tree in trees:
        at = np.zeros(len(x), dtype=int)
        while True:
            feature = tree[at, 0].astype(int)
            inner = feature >= 0
            if not inner.any():
                break
            left = x[every, np.maximum(feature, 0)] <= tree[at, 1]
            step = np.where(left, tree[at, 2], tree[at, 3]).astype(int)
            at = np.where(inner, step, at)
        depth += tree[at, 4]
    return -np.power(2.0, -depth / (len(trees) * float(_mean_path(size))))


def _train(pdf: pd.DataFrame) -> pd.DataFrame:
    """The trees of one group: rows of one table drawn for a few trees."""
    grown = []
    for number, rows in pdf.sort_values(["tree", "profiled_at"]).groupby("tree"):
        tree = grow_tree(np.stack(rows["x"].to_numpy()), SEED + int(number))
        grown.append((rows["source"].iloc[0], rows["table_name"].iloc[0], pickle.dumps(tree), len(rows)))
    return pd.DataFrame(grown, columns=["source", "table_name", "tree", "size"])


def _score(rows: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
    if rows.empty or model.empty:
        return pd.DataFrame({"source": [], "table_name": [], "is_today": [], "score": []})
    trees = [pickle.loads(t) for t in model["trees"].iloc[0]]
    scores = score_forest(trees, int(model["size"].iloc[0]), np.stack(rows["x"].to_numpy()))
    return rows[["source", "table_name", "is_today"]].assign(score=scores)


def forest_severity(score: Column) -> Column:
    return ladder(score, SCORE_STEPS, "CRITICAL")


def eligible_tables(history: DataFrame, min_rows: int = MIN_ROWS) -> tuple[DataFrame, DataFrame]:
    """Tables that a forest can judge, with today's three metrics furthest from their past, and the metrics it may use.

    A metric counts if every snapshot of the table has it; a table needs ``min_rows`` snapshots and two such metrics.
    """
    per_table = history.groupBy(*SERIES).agg(
        F.count_distinct("profiled_at").alias("n_rows"), F.max("profiled_at").alias("today_at")
    )
    tagged = history.join(per_table, SERIES)
    prior = F.when(F.col("profiled_at") < F.col("today_at"), F.col("value"))
    stats = (
        tagged.groupBy(*SERIES, "metric", "n_rows", "today_at")
        .agg(
            F.count("value").alias("n_values"),
            F.avg(prior).alias("mean"),
            F.stddev_pop(prior).alias("spread"),
            F.stddev_samp(prior).alias("std"),
            F.max(F.when(F.col("profiled_at") == F.col("today_at"), F.col("value"))).alias("now"),
        )
        .filter((F.col("n_values") == F.col("n_rows")) & (F.col("n_rows") >= min_rows))
    )
    # groups below hold one entry per metric of a table, never its snapshots
    tables = (
        stats.withColumn("z", F.abs(F.try_divide(F.col("now") - F.col("mean"), F.col("std"))))
        .groupBy(*SERIES, "n_rows", "today_at")
        .agg(
            F.count(F.lit(1)).alias("n_metrics"),
            F.collect_list(F.when(F.col("z").isNotNull(), F.struct((-F.col("z")).alias("z"), "metric"))).alias("zs"),
        )
        .filter(F.col("n_metrics") >= 2)
        .select(
            *SERIES,
            "n_rows",
            "today_at",
            F.transform(
                F.slice(F.array_sort("zs"), 1, 3),
                lambda e: F.struct(e["metric"].alias("metric"), settle(-e["z"], 2).alias("z_score")),
            ).alias("top_contributors"),
        )
    )
    return tables, stats


def isolation_forest(
    history: DataFrame, min_rows: int = MIN_ROWS, contamination: float = CONTAMINATION, subsample: int = SUBSAMPLE
) -> DataFrame:
    """At most one finding per table: today's combined metrics are unusually easy to isolate."""
    tables, stats = eligible_tables(history, min_rows)
    unit = F.when(F.col("spread") > 0, F.col("spread")).otherwise(F.lit(1.0))
    vectors = (
        history.join(stats.select(*SERIES, "metric", "n_rows", "today_at", "mean", unit.alias("unit")), [*SERIES, "metric"])
        .groupBy(*SERIES, "profiled_at", "n_rows", "today_at")
        .agg(
            F.array_sort(
                F.collect_list(F.struct("metric", ((F.col("value") - F.col("mean")) / F.col("unit")).alias("x")))
            ).alias("_xs")
        )
        .filter(F.size("_xs") >= 2)
        .select(
            *SERIES,
            "profiled_at",
            "n_rows",
            (F.col("profiled_at") == F.col("today_at")).alias("is_today"),
            F.col("_xs.x").alias("x"),
        )
    )
    vectors = stored(vectors, "forest_vectors")
    spot = F.xxhash64(F.col("profiled_at").cast("string"), F.lit(SEED))
    draw = lambda t: F.pmod(F.xxhash64(F.col("profiled_at").cast("string"), t), F.lit(1 << 30))
    offered = F.filter(F.sequence(F.lit(1), F.lit(TREES)), lambda t: draw(t) * F.col("n_rows") < float(OFFERS * subsample) * (1 << 30))
    drawn = vectors.filter(~F.col("is_today")).select(*SERIES, "profiled_at", "x", F.explode(offered).alias("tree"))
    place = F.row_number().over(Window.partitionBy(*SERIES, "tree").orderBy(draw(F.col("tree")), "profiled_at"))
    trees = (
        drawn.withColumn("place", place)
        .filter(F.col("place") <= subsample)
        .groupBy(*SERIES, F.floor(F.col("tree") / TREES_A_GROUP).alias("group"))
        .applyInPandas(_train, "source string, table_name string, tree binary, size int")
    )
    # TREES trees of at most 2 * subsample nodes per table
    models = trees.groupBy(*SERIES).agg(F.sort_array(F.collect_list("tree")).alias("trees"), F.max("size").alias("size"))
    n_chunks = F.ceil(F.col("n_rows") / F.lit(CHUNK_ROWS)).cast("int")
    chunked = vectors.withColumn("chunk", F.pmod(spot, n_chunks).cast("int"))
    copies = models.join(tables.select(*SERIES, n_chunks.alias("n_chunks")), SERIES).select(
        *SERIES, "trees", "size", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)).alias("chunk")
    )
    scored = (
        chunked.select(*SERIES, "chunk", "is_today", "x")
        .groupBy(*SERIES, "chunk")
        .cogroup(copies.groupBy(*SERIES, "chunk"))
        .applyInPandas(_score, "source string, table_name string, is_today boolean, score double")
    )
    verdict = scored.groupBy(*SERIES).agg(
        F.max(F.when(F.col("is_today"), F.col("score"))).alias("score"),
        F.percentile(F.when(~F.col("is_today"), F.col("score")), F.lit(contamination)).alias("offset"),
    )
    return as_findings(
        verdict.filter(F.col("score") < F.col("offset"))
        .join(tables, SERIES)
        .select(
            *SERIES,
            F.col("today_at").alias("profiled_at"),
            F.lit("isolation_forest").alias("detector"),
            F.lit("all_metrics_combined").alias("metric"),
            forest_severity(F.col("score")).alias("severity"),
            F.lit("MULTIVARIATE").alias("direction"),
            settle(F.col("score"), 4).alias("anomaly_score"),
            "top_contributors",
        )
    )
