"""Continuous profiles: tumbling-window snapshots of a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.scalars import percent, quoted, settle


def window_profile(
    stream: DataFrame,
    time: str,
    window: str,
    delay: str,
    *,
    keys: Sequence[str] = (),
    nulls_of: Sequence[str] = (),
    stats_of: Sequence[str] = (),
    distinct_of: Sequence[str] = (),
) -> DataFrame:
    """One row per closed window and key; ``distinct_of`` counts are approximate, ``window_distinct`` counts exactly."""
    at = F.col(time).cast("timestamp")
    rows_in = F.count(F.lit(1))
    aggs = [rows_in.alias("row_count")]
    aggs += [percent(rows_in - F.count(F.col(quoted(c))), rows_in, 2).alias(f"null_pct_{c}") for c in nulls_of]
    for c in stats_of:
        number = F.col(quoted(c)).cast("double")
        aggs += [
            settle(F.min(number), 4).alias(f"min_{c}"),
            settle(F.max(number), 4).alias(f"max_{c}"),
            settle(F.avg(number), 4).alias(f"mean_{c}"),
            settle(F.stddev_samp(number), 4).alias(f"std_{c}"),
        ]
    aggs += [F.approx_count_distinct(F.col(quoted(c)), 0.01).alias(f"distinct_count_{c}") for c in distinct_of]
    return (
        stream.withColumn("_at", at)
        .withWatermark("_at", delay)
        .groupBy(F.window("_at", window), *keys)
        .agg(*aggs)
        .withColumn("profiled_at", F.col("window.start"))
        .drop("window")
    )


def window_distinct(stream: DataFrame, time: str, window: str, delay: str, column: str, *, keys: Sequence[str] = ()) -> DataFrame:
    """Exact distinct non-null values of ``column`` per closed window and key.

    Values are de-duplicated by window first, with state until the window closes, and counted then.
    """
    once = (
        stream.withColumn("_at", F.col(time).cast("timestamp"))
        .withWatermark("_at", delay)
        .select(F.window("_at", window).alias("window"), *keys, F.col(quoted(column)).alias("_value"))
        .filter(F.col("_value").isNotNull())
        .dropDuplicates(["window", *keys, "_value"])
    )
    counted = once.groupBy("window", *keys).agg(F.count("_value").alias(f"distinct_count_{column}"))
    return counted.withColumn("profiled_at", F.col("window.start")).drop("window")
