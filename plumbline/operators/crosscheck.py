"""Checks of sources against each other.

All inputs are snapshot rows or metric history. Tables and columns are matched by a
group-by on their lower-case name, so no self-join is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.scalars import settle
from plumbline.operators.snapshots import latest_snapshot, latest_values

ISSUE_FIELDS = {
    "check": "string",
    "subject": "string",
    "severity": "string",
    "diff": "double",
    "message": "string",
    "details": "map<string,double>",
    "present_in": "array<string>",
    "missing_from": "array<string>",
}


def as_issues(df: DataFrame) -> DataFrame:
    return df.select(
        *[F.col(n) if n in df.columns else F.lit(None).cast(t).alias(n) for n, t in ISSUE_FIELDS.items()]
    )


def _per_source(value: str) -> Column:
    """Map source -> value; a group holds one row per source."""
    return F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", value))))


def row_count_consistency(snapshots: DataFrame, threshold: float = 50.0, high: float = 80.0) -> DataFrame:
    """Same table name in several sources with row counts more than ``threshold`` % apart."""
    per_source = (
        latest_snapshot(snapshots)
        .groupBy(F.lower("table_name").alias("subject"), "source")
        .agg(F.max_by(F.col("row_count").cast("double"), "table_name").alias("rows"))
    )
    top, bottom = F.col("top"), F.col("bottom")
    return as_issues(
        per_source.groupBy("subject")
        .agg(
            F.count(F.lit(1)).alias("n_sources"),
            F.max("rows").alias("top"),
            F.min("rows").alias("bottom"),
            _per_source("rows").alias("details"),
        )
        .filter((F.col("n_sources") >= 2) & (top != 0))
        .withColumn("diff", settle((top - bottom) / top * 100, 1))
        .filter(F.col("diff") > threshold)
        .withColumn("check", F.lit("row_count_consistency"))
        .withColumn("severity", F.when(F.col("diff") > high, "HIGH").otherwise("MEDIUM"))
        .withColumn("message", F.concat(F.lit("Row counts of the sources are "), "diff", F.lit("% apart")))
    )


def null_rate_consistency(
    history: DataFrame, threshold: float = 30.0, high: float = 60.0, floor: float = 5.0, by_table: bool = False
) -> DataFrame:
    """Same column name in several sources with null rates more than ``threshold`` points apart.

    Columns are matched over all tables of a source, the last table by name speaking for the
    source; ``by_table`` matches only columns of the same table.
    """
    column = F.lower(F.regexp_replace("metric", "^null_pct\\.", ""))
    subject = F.concat_ws(".", F.lower("table_name"), column) if by_table else column
    # the last snapshot of the table decides, also for columns missing from it
    rates = latest_values(history).filter(F.col("metric").startswith("null_pct."))
    per_source = (
        rates.groupBy(subject.alias("subject"), "source").agg(F.max_by("value", "table_name").alias("rate"))
    )
    return as_issues(
        per_source.groupBy("subject")
        .agg(
            F.count(F.lit(1)).alias("n_sources"),
            F.max("rate").alias("top"),
            F.min("rate").alias("bottom"),
            _per_source("rate").alias("details"),
        )
        .filter(F.col("n_sources") >= 2)
        .withColumn("diff", settle(F.col("top") - F.col("bottom"), 1))
        .filter((F.col("diff") > threshold) & (F.col("top") > floor))
        .withColumn("check", F.lit("null_rate_consistency"))
        .withColumn("severity", F.when(F.col("diff") > high, "HIGH").otherwise("MEDIUM"))
        .withColumn("message", F.concat(F.lit("Null rates of the sources are "), "diff", F.lit(" points apart")))
    )


def source_growth(snapshots: DataFrame, last: int = 10) -> DataFrame:
    """Growth in % of each source: the newer half of the last ``last`` runs of each of its tables against the older half.

    Every table with two runs or more counts in both halves, each time with the oldest row of the half.
    """
    per_table = Window.partitionBy("source", "table_name")
    recent = snapshots.withColumn("rn", F.row_number().over(per_table.orderBy(F.desc("profiled_at"), F.desc("row_count")))).filter(F.col("rn") <= last)
    # at most `last` rows per table from here on
    sized = recent.withColumn("n", F.count(F.lit(1)).over(per_table)).filter(F.col("n") >= 2)
    newer = F.col("rn") <= F.floor(F.col("n") / 2)
    per_table = (
        sized.withColumn("newer", newer)
        .groupBy("source", "newer", "table_name")
        .agg(F.max_by("row_count", "rn").alias("rows"))
    )
    total = lambda flag: F.coalesce(F.sum(F.when(F.col("newer") == flag, F.col("rows"))), F.lit(0))
    return (
        per_table.groupBy("source")
        .agg(total(True).alias("rows_now"), total(False).alias("rows_before"))
        .filter(F.col("rows_before") > 0)
        .withColumn(
            "growth_pct",
            settle((F.col("rows_now") - F.col("rows_before")) / F.col("rows_before") * 100, 1),
        )
    )


def volume_divergence(snapshots: DataFrame, spread: float = 20.0) -> DataFrame:
    """One issue when some sources grow while others shrink and the spread exceeds ``spread``."""
    g = F.col("growth_pct")
    sources_where = lambda cond: F.array_sort(F.collect_list(F.when(cond, F.col("source"))))
    return as_issues(
        source_growth(snapshots)
        .agg(
            F.count(F.lit(1)).alias("n_sources"),
            (F.max("growth_pct") - F.min("growth_pct")).alias("diff"),
            sources_where(g > 0).alias("growing"),
            sources_where(g < 0).alias("shrinking"),
            _per_source("growth_pct").alias("details"),
        )
        .filter(
            (F.col("n_sources") >= 2)
            & (F.col("diff") > spread)
            & (F.size("growing") > 0)
            & (F.size("shrinking") > 0)
        )
        .select(
            F.lit("volume_divergence").alias("check"),
            F.concat_ws(",", F.array_union("growing", "shrinking")).alias("subject"),
            F.lit("HIGH").alias("severity"),
            settle(F.col("diff"), 1).alias("diff"),
            F.concat(
                F.lit("Growing: "), F.concat_ws(", ", "growing"), F.lit("; shrinking: "), F.concat_ws(", ", "shrinking")
            ).alias("message"),
            "details",
        )
    )


def missing_tables(snapshots: DataFrame) -> DataFrame:
    """Tables that some sources have and others lack.

    The list of all sources is a scalar subquery; rows are distinct names, not data.
    """
    names = snapshots.select("source", F.lower("table_name").alias("subject")).distinct()
    present = names.groupBy("subject").agg(F.array_sort(F.collect_list("source")).alias("present_in"))
    everyone = names.agg(F.array_sort(F.collect_set("source")).alias("everyone"))
    return as_issues(
        present.withColumn("everyone", everyone.scalar())
        .withColumn("missing_from", F.array_except("everyone", "present_in"))
        .filter(F.size("missing_from") > 0)
        .withColumn("check", F.lit("missing_table"))
        .withColumn("severity", F.lit("MEDIUM"))
        .withColumn(
            "message",
            F.concat(
                F.lit("In "), F.concat_ws(", ", "present_in"), F.lit(" but not in "), F.concat_ws(", ", "missing_from")
            ),
        )
    )


def cross_report(issues: DataFrame) -> DataFrame:
    """Totals per severity and the overall status of the cross-source checks."""
    return issues.agg(
        F.count(F.lit(1)).alias("total_issues"),
        F.count_if(F.col("severity") == "HIGH").alias("high"),
        F.count_if(F.col("severity") == "MEDIUM").alias("medium"),
    ).withColumn(
        "overall_status",
        F.when(F.col("total_issues") == 0, "CLEAN").when(F.col("high") > 0, "HIGH").otherwise("MEDIUM"),
    )

