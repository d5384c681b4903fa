"""Z-score and IQR detectors over the long metric history.

Both compare the metric value of a table's last snapshot with all earlier values of the
same series. The "today" plans are plain aggregates (partial + final), so any number of
series runs in one job and a series with very many snapshots is combined map-side.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.scalars import ladder, settle
from plumbline.operators.quantiles import exact_quantiles
from plumbline.operators.snapshots import SERIES

MIN_HISTORY = 7
Z_FLAG = 3.0
FENCE_WIDTH = 1.5
BLOCK = "month"  # unit of time in which a series is looked back upon
# Severity steps of the two detectors.
Z_STEPS = ((6.0, "CRITICAL"), (4.0, "HIGH"))
IQR_STEPS = ((4.0, "CRITICAL"), (2.0, "HIGH"))

FINDING_FIELDS = {
    "source": "string",
    "table_name": "string",
    "profiled_at": None,
    "detector": "string",
    "metric": "string",
    "severity": "string",
    "direction": "string",
    "today": "double",
    "expected": "double",
    "z_score": "double",
    "lower_fence": "double",
    "upper_fence": "double",
    "iqr_distance": "double",
    "anomaly_score": "double",
    "top_contributors": "array<struct<metric:string,z_score:double>>",
}


def as_findings(df: DataFrame) -> DataFrame:
    """Give detector output the one finding schema; fields it lacks become NULL."""
    return df.select(
        *[
            F.col(name) if name in df.columns else F.lit(None).cast(kind).alias(name)
            for name, kind in FINDING_FIELDS.items()
        ]
    )


def series_today(history: DataFrame, *stats: Column) -> DataFrame:
    """One row per series: last snapshot time of the table, today's value, prior count, ``stats``.

    ``stats`` are aggregates over the column ``prior`` (the values before the last snapshot).
    """
    last = history.groupBy(*SERIES).agg(F.max("profiled_at").alias("today_at"))
    split = history.join(last, SERIES).select(
        *SERIES,
        "metric",
        "today_at",
        F.when(F.col("profiled_at") < F.col("today_at"), F.col("value")).alias("prior"),
        F.when(F.col("profiled_at") == F.col("today_at"), F.col("value")).alias("now"),
    )
    return split.groupBy(*SERIES, "metric", "today_at").agg(
        F.count("prior").alias("n_prior"), F.max("now").alias("now"), *stats
    )


def _zscore_findings(stats: DataFrame, min_history: int, flag_constant_break: bool) -> DataFrame:
    z = (F.col("now") - F.col("mean")) / F.when(F.col("std") != 0, F.col("std"))
    known = stats.filter((F.col("n_prior") >= min_history) & F.col("now").isNotNull())
    scored = known.withColumn("z", z)
    flagged = F.abs("z") >= Z_FLAG
    severity = ladder(F.abs("z"), Z_STEPS, "MEDIUM")
    if flag_constant_break:
        # the mean of equal doubles may be off in the last bit, their minimum is not
        broke = (F.col("std") == 0) & (F.col("now") != F.col("least"))
        flagged = F.coalesce(flagged, F.lit(False)) | broke
        severity = F.when(broke, "HIGH").otherwise(severity)
    return as_findings(
        scored.filter(flagged).select(
            *SERIES,
            "profiled_at",
            F.lit("zscore").alias("detector"),
            "metric",
            severity.alias("severity"),
            F.when(F.col("now") < F.col("mean"), "LOW").otherwise("HIGH").alias("direction"),
            settle(F.col("now"), 4).alias("today"),
            settle(F.col("mean"), 4).alias("expected"),
            settle(F.col("z"), 2).alias("z_score"),
        )
    )


def zscore(history: DataFrame, min_history: int = MIN_HISTORY, flag_constant_break: bool = False) -> DataFrame:
    """Findings for the last snapshot of every table.

    A series whose history never varied is skipped; ``flag_constant_break`` reports it when
    today's value leaves the constant.
    """
    stats = series_today(
        history,
        F.avg("prior").alias("mean"),
        F.stddev_samp("prior").alias("std"),
        F.min("prior").alias("least"),
    )
    return _zscore_findings(stats.withColumnRenamed("today_at", "profiled_at"), min_history, flag_constant_break)


def zscore_backtest(history: DataFrame, min_history: int = MIN_HISTORY, block: str = BLOCK) -> DataFrame:
    """Findings for every snapshot, each against the snapshots before it.

    A prefix scan over (n, mean, M2): every ``block`` of a series (a unit of time) is reduced to one row, each block takes in the rows
    of the blocks before it, and inside a block the running frame starts from what came before. A task holds the
    snapshots of one block, or one row for each block of a series.
    """
    keys = [*SERIES, "metric", "block"]
    rows = history.withColumn("block", F.date_trunc(block, "profiled_at"))
    totals = rows.groupBy(*keys).agg(*_moments())
    earlier = Window.partitionBy(*SERIES, "metric").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    past = totals.withColumn("past", F.collect_list(F.when(F.col("n") > 0, F.struct("n", "mean", "m2", "least", "most"))).over(earlier))
    n0 = F.aggregate("past", F.lit(0).cast("long"), lambda s, x: s + x["n"])
    mean0 = F.try_divide(F.aggregate("past", F.lit(0.0), lambda s, x: s + x["n"] * x["mean"]), F.col("n0"))
    apart = F.aggregate("past", F.lit(0.0), lambda s, x: s + x["m2"] + x["n"] * F.pow(x["mean"] - F.col("mean0"), F.lit(2.0)))
    carried = past.select(*keys, "past", n0.alias("n0")).withColumn("mean0", mean0).select(
        *keys, "n0", "mean0", apart.alias("m20"), F.array_min("past.least").alias("least0"), F.array_max("past.most").alias("most0")
    )
    before = Window.partitionBy(*keys).orderBy("profiled_at").rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.select(*keys, "profiled_at", F.col("value").alias("now"), *_moments(before))
    n, shift = F.col("n0") + F.col("n"), F.col("mean") - F.col("mean0")
    # without values on one side the other side counts alone
    mean = F.coalesce(F.col("mean0") + shift * F.col("n") / n, "mean", "mean0")
    m2 = F.coalesce("m2", F.lit(0.0)) + F.col("m20") + F.coalesce(F.pow(shift, F.lit(2.0)) * F.col("n0") * F.col("n") / n, F.lit(0.0))
    constant = F.least("least", "least0") == F.greatest("most", "most0")
    stats = inside.join(carried, keys).select(
        *SERIES,
        "metric",
        "profiled_at",
        "now",
        n.alias("n_prior"),
        mean.alias("mean"),
        # the mean of equal doubles may be off in the last bit, their least and greatest are not
        F.when(constant, 0.0).when(n > 1, F.sqrt(m2 / (n - 1))).alias("std"),
    )
    return _zscore_findings(stats, min_history, False)


def _moments(over=None) -> list[Column]:
    """n, mean, M2 (sum of squared deviations), least and greatest of ``value``, of a group or a frame."""
    framed = (lambda c: c.over(over)) if over is not None else (lambda c: c)
    n = framed(F.count("value"))
    return [
        n.alias("n"),
        framed(F.avg("value")).alias("mean"),
        (framed(F.var_pop("value")) * n).alias("m2"),
        framed(F.min("value")).alias("least"),
        framed(F.max("value")).alias("most"),
    ]


def iqr(history: DataFrame, min_history: int = MIN_HISTORY) -> DataFrame:
    """Findings outside ``1.5`` interquartile ranges; exact quartiles, linear between ranks."""
    quartiles = F.expr("percentile(prior, array(0.25D, 0.75D))").alias("q")
    stats = series_today(history, quartiles).withColumnRenamed("today_at", "profiled_at")
    return _iqr_findings(stats.withColumns({"q1": F.col("q")[0], "q3": F.col("q")[1]}), min_history)


def iqr_selected(history: DataFrame, min_history: int = MIN_HISTORY) -> DataFrame:
    """The findings of ``iqr`` with quartiles by distributed selection, for series too long for one task's buffer."""
    key = [*SERIES, "metric"]
    last = history.groupBy(*SERIES).agg(F.max("profiled_at").alias("today_at"))
    past = history.join(last, SERIES).where("profiled_at < today_at")
    quartiles = exact_quantiles(past, key, "value", (0.25, 0.75)).select(*key, F.col("q")[0].alias("q1"), F.col("q")[1].alias("q3"))
    stats = series_today(history).withColumnRenamed("today_at", "profiled_at")
    return _iqr_findings(stats.join(quartiles, key), min_history)


def iqr_backtest(history: DataFrame, min_history: int = MIN_HISTORY) -> DataFrame:
    """IQR findings for every snapshot, each against the exact quartiles of the snapshots before it.

    A series is one group; its values, one for each snapshot, are ranked once and counted in a tree by rank as time goes on, which
    gives any order statistic of what came before in logarithmic time.
    """
    kind = history.schema["profiled_at"].dataType.simpleString()
    shape = f"source string, table_name string, metric string, profiled_at {kind}, now double, n_prior long, q1 double, q3 double"
    rows = history.select(*SERIES, "metric", "profiled_at", F.col("value").cast("double").alias("now"))
    return _iqr_findings(rows.groupBy(*SERIES, "metric").applyInPandas(_prior_quartiles, shape), min_history)


class RankCounts:
    """Counts by rank in a Fenwick tree: a rank is added, and the k-th smallest of those added is found, in logarithmic time."""

    def __init__(self, size: int):
        self.counts, self.top = [0] * (size + 1), 1 << max(size.bit_length() - 1, 0)

    def add(self, rank: int) -> None:
        at = rank + 1
        while at < len(self.counts):
            self.counts[at] += 1
            at += at & -at

    def smallest(self, k: int) -> int:
        """Rank of the k-th smallest, counted from 0."""
        at, step = 0, self.top
        while step:
            if at + step < len(self.counts) and self.counts[at + step] <= k:
                at += step
                k -= self.counts[at]
            step >>= 1
        return at


def _prior_quartiles(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["profiled_at", "now"], kind="stable")
    now = pdf["now"].to_numpy(float, na_value=np.nan)
    order = np.argsort(now, kind="stable")  # missing values come last
    rank = np.empty(len(now), int)
    rank[order] = np.arange(len(now))
    ranked, ranks, known = now[order].tolist(), rank.tolist(), (~np.isnan(now)).tolist()
    counts, n, found = RankCounts(len(now)), 0, []
    for i, is_known in zip(ranks, known):
        at = [(n - 1) * p for p in (0.25, 0.75)]
        pairs = [(h - int(h), counts.smallest(int(h)), counts.smallest(min(int(h) + 1, n - 1))) for h in at] if n else []
        found.append((n, *(ranked[a] + (ranked[b] - ranked[a]) * part for part, a, b in pairs)) if n else (0, None, None))
        if is_known:
            counts.add(i)
            n += 1
    stats = pd.DataFrame(found, columns=["n_prior", "q1", "q3"], index=pdf.index)
    return pd.concat([pdf, stats.astype({"q1": float, "q3": float})], axis=1)


def _iqr_findings(stats: DataFrame, min_history: int) -> DataFrame:
    q1, q3 = F.col("q1"), F.col("q3")
    fenced = (
        stats.filter((F.col("n_prior") >= min_history) & F.col("now").isNotNull())
        .withColumn("width", q3 - q1)
        .filter(F.col("width") != 0)
        .withColumn("lower", q1 - FENCE_WIDTH * F.col("width"))
        .withColumn("upper", q3 + FENCE_WIDTH * F.col("width"))
    )
    low = F.col("now") < F.col("lower")
    beyond = F.when(low, F.col("lower") - F.col("now")).otherwise(F.col("now") - F.col("upper"))
    return as_findings(
        fenced.filter(low | (F.col("now") > F.col("upper")))
        .withColumn("distance", beyond / F.col("width"))
        .select(
            *SERIES,
            "profiled_at",
            F.lit("iqr").alias("detector"),
            "metric",
            ladder(F.col("distance"), IQR_STEPS, "MEDIUM").alias("severity"),
            F.when(low, "LOW").otherwise("HIGH").alias("direction"),
            settle(F.col("now"), 4).alias("today"),
            settle(F.col("lower"), 4).alias("lower_fence"),
            settle(F.col("upper"), 4).alias("upper_fence"),
            settle(F.col("distance"), 2).alias("iqr_distance"),
        )
    )
