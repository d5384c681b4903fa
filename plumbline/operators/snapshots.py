"""Snapshots: one row per (source, table, run), their JSON form and the long history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.profile import METRICS_KEPT

SERIES = ["source", "table_name"]

_COLUMN_JSON = "MAP<STRING, STRUCT<" + ", ".join(f"{m}: DOUBLE" for m in METRICS_KEPT) + ">>"


def to_snapshots(column_profiles: DataFrame, fingerprints: DataFrame | None = None) -> DataFrame:
    """Fold column profiles into snapshot rows holding a JSON document per table."""
    body = F.struct(
        "dtype", "null_count", "null_pct", "distinct_count", "distinct_pct", "min", "max", "mean", "std",
        F.when(
            F.col("top_values").isNotNull(), F.map_from_entries("top_values")
        ).alias("top_values"),
    )
    snaps = (
        column_profiles.withColumn("_entry", F.struct(F.col("column"), body.alias("body")))
        .groupBy(*SERIES, "profiled_at")
        .agg(
            F.max("row_count").alias("row_count"),
            F.count(F.lit(1)).alias("column_count"),
            F.collect_list("_entry").alias("_entries"),
        )
        .select(
            *SERIES,
            "profiled_at",
            "row_count",
            F.to_json(
                F.struct(
                    F.col("table_name").alias("table"),
                    F.date_format("profiled_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("profiled_at"),
                    "row_count",
                    "column_count",
                    F.map_from_entries("_entries").alias("columns"),
                )
            ).alias("profile_json"),
        )
    )
    if fingerprints is None:
        return snaps.withColumn("schema_fingerprint", F.lit(None).cast("string"))
    return snaps.join(
        fingerprints.select(*SERIES, F.col("columns_json").alias("schema_fingerprint")), SERIES, "left"
    )


def decode_history(snapshots: DataFrame) -> DataFrame:
    """Long metric history from snapshot rows: the row count and the kept column metrics."""
    doc = F.from_json("profile_json", f"columns {_COLUMN_JSON}")
    cols = snapshots.select(
        *SERIES,
        "profiled_at",
        F.col("row_count").cast("double").alias("row_count"),
        doc["columns"].alias("cols"),
    )
    rows = cols.select(*SERIES, "profiled_at", F.lit("row_count").alias("metric"), F.col("row_count").alias("value"))
    per_column = cols.select(*SERIES, "profiled_at", F.explode("cols").alias("column", "m"))
    detail = per_column.select(
        *SERIES,
        "profiled_at",
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.concat(F.lit(f"{m}."), "column").alias("metric"), F.col("m")[m].alias("value")
                    )
                    for m in METRICS_KEPT
                ]
            )
        ),
    ).filter(F.col("value").isNotNull())
    return rows.unionByName(detail)


def history_from_profiles(column_profiles: DataFrame) -> DataFrame:
    """The same history straight from column profiles, without a JSON round trip."""
    rows = (
        column_profiles.groupBy(*SERIES, "profiled_at")
        .agg(F.max("row_count").cast("double").alias("value"))
        .select(*SERIES, "profiled_at", F.lit("row_count").alias("metric"), "value")
    )
    detail = column_profiles.select(
        *SERIES,
        "profiled_at",
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.concat(F.lit(f"{m}."), "column").alias("metric"),
                        F.col(m).cast("double").alias("value"),
                    )
                    for m in METRICS_KEPT
                ]
            )
        ),
    ).filter(F.col("value").isNotNull())
    return rows.unionByName(detail)


def row_counts(history: DataFrame) -> DataFrame:
    """``(source, table_name, profiled_at, row_count)``, one row per snapshot."""
    return history.filter(F.col("metric") == "row_count").select(
        *SERIES, "profiled_at", F.col("value").cast("bigint").alias("row_count")
    )


def newest(df: DataFrame, keys: list[str], n: int, *tiebreak: str) -> DataFrame:
    """The newest ``n`` rows per key with their rank; tasks keep ``n`` rows per key before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(F.desc("profiled_at"), *[F.desc(t) for t in tiebreak])
    return df.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n)


def latest_snapshot(snapshots: DataFrame, *tiebreak: str) -> DataFrame:
    """Latest row per (source, table); ``tiebreak`` columns settle equal times, by default the batch and the row count."""
    tiebreak = tiebreak or [c for c in ("batch", "row_count") if c in snapshots.columns]
    return newest(snapshots, SERIES, 1, *tiebreak).drop("rn")


def recent_history(snapshots: DataFrame, n: int = 10, *tiebreak: str) -> DataFrame:
    """Newest ``n`` snapshots of every (source, table)."""
    return newest(snapshots, SERIES, n, *tiebreak)


def row_count_delta(snapshots: DataFrame) -> DataFrame:
    """Latest row count, the one before it (itself when alone) and the difference."""
    two = newest(snapshots, SERIES, 2).groupBy(*SERIES).agg(
        F.max(F.when(F.col("rn") == 1, F.col("row_count"))).alias("latest"),
        F.max(F.when(F.col("rn") == 2, F.col("row_count"))).alias("before"),
    )
    previous = F.coalesce("before", "latest")
    return two.select(*SERIES, "latest", previous.alias("previous"), (F.col("latest") - previous).alias("delta"))


def latest_values(history: DataFrame) -> DataFrame:
    """Metric rows of each table's last snapshot.

    The last time per table is a tiny aggregate; AQE broadcasts it when its measured size
    allows and otherwise splits hot tables in the sort-merge join.
    """
    last = history.groupBy(*SERIES).agg(F.max("profiled_at").alias("today_at"))
    return history.join(last, SERIES).filter(F.col("profiled_at") == F.col("today_at")).drop("today_at")
