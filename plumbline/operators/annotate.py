"""Plain-language notes on findings, derived from what the same snapshot shows.

The fact is put together from metric, figures and direction. Its causes are hypotheses about the
table: each one earns points from the finding itself and from the other findings of the table, the best
three are named. Points are conditions over the evidence columns, written in SQL.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.scalars import DASH, plain_number, settle, table_key
from plumbline.operators.report import expected_text
from plumbline.operators.snapshots import SERIES

# what the findings of one table say together: aggregates over its rows
EVIDENCE = {
    "rows_up": "max(CASE WHEN metric = 'row_count' AND direction = 'HIGH' THEN 1 ELSE 0 END)",
    "rows_down": "max(CASE WHEN metric = 'row_count' AND direction = 'LOW' THEN 1 ELSE 0 END)",
    "row_ratio": "max(CASE WHEN metric = 'row_count' AND expected > 0 THEN today / expected END)",
    "nulls_up": "sum(CASE WHEN metric LIKE 'null%' AND direction = 'HIGH' THEN 1 ELSE 0 END)",
    "distinct_up": "sum(CASE WHEN metric LIKE 'distinct%' AND direction = 'HIGH' THEN 1 ELSE 0 END)",
    "distinct_down": "sum(CASE WHEN metric LIKE 'distinct%' AND direction = 'LOW' THEN 1 ELSE 0 END)",
    "means": "sum(CASE WHEN metric LIKE 'mean.%' THEN 1 ELSE 0 END)",
    "spreads": "sum(CASE WHEN metric LIKE 'std.%' THEN 1 ELSE 0 END)",
}
# how a metric is spoken of, by what stands before its column
LABELS = {"row_count": "row count", "null_pct": "null share of", "mean": "mean of", "std": "std of", "distinct_count": "distinct count of"}


@dataclass(frozen=True)
class Hypothesis:
    """A cause, what would confirm it, what removes it, and the points that evidence gives it."""

    cause: str
    check: str
    remedy: str
    points: tuple[tuple[int, str], ...]


HYPOTHESES = (
    Hypothesis(
        "duplicate rows from a repeated write", "compare row count and distinct keys of the last load", "delete the second copy and make the load idempotent",
        ((4, "metric = 'row_count' AND direction = 'HIGH'"), (3, "row_ratio BETWEEN 1.8 AND 2.2"), (2, "rows_up > 0 AND distinct_up = 0"), (1, "rows_up > 0")),
    ),
    Hypothesis(
        "partial load after a pipeline failure", "compare the row count with that of the source for the same period", "rerun the load for the missing period",
        ((5, "metric = 'row_count' AND direction = 'LOW'"), (2, "rows_down > 0"), (1, "rows_down > 0 AND distinct_down > 0")),
    ),
    Hypothesis(
        "rows removed or filtered out on purpose", "look for retention jobs and new filter conditions since the last snapshot", "confirm the rule with its owner, or restore the rows",
        ((3, "metric = 'row_count' AND direction = 'LOW'"), (2, "rows_down > 0 AND distinct_down > 0")),
    ),
    Hypothesis(
        "join without partners upstream", "count the keys of the joined tables that have no match", "repair the join keys and backfill the columns",
        ((3, "metric LIKE 'null%' AND direction = 'HIGH'"), (3, "nulls_up > 0 AND distinct_down > 0"), (2, "nulls_up > 1"), (1, "nulls_up > 0 AND rows_up + rows_down = 0")),
    ),
    Hypothesis(
        "upstream leaves the field empty", "look at the newest rows of the source itself", "have the source deliver it again and guard it with a not-null rule",
        ((4, "metric LIKE 'null%' AND direction = 'HIGH'"), (2, "metric LIKE 'null%' AND today >= 90"), (1, "nulls_up = 1")),
    ),
    Hypothesis(
        "gaps were filled by a default or a backfill", "group the column by value and look for a new frequent one", "keep real values apart from defaults",
        ((5, "metric LIKE 'null%' AND direction = 'LOW'"), (1, "metric LIKE 'distinct%' AND direction = 'LOW'")),
    ),
    Hypothesis(
        "unit or currency changed", "compare a few keys before and after: is the ratio constant?", "convert the affected rows and agree on the unit",
        ((4, "metric LIKE 'mean.%'"), (3, "means > 0 AND spreads > 0"), (2, "metric LIKE 'std.%'")),
    ),
    Hypothesis(
        "outliers entered", "list the rows with the largest and smallest values", "correct or reject them and add a range rule",
        ((4, "metric LIKE 'std.%'"), (2, "spreads > 0 AND means = 0"), (2, "metric LIKE 'mean.%'")),
    ),
    Hypothesis(
        "mix of rows changed", "compare the shares of the main categories with the snapshot before", "split the metric by category, then decide",
        ((2, "metric LIKE 'mean.%'"), (2, "metric LIKE 'std.%'"), (2, "metric LIKE 'distinct%'"), (1, "distinct_up + distinct_down > 0")),
    ),
    Hypothesis(
        "new or misspelt categories", "list the values that the snapshot before did not have", "map them or extend the accepted values",
        ((4, "metric LIKE 'distinct%' AND direction = 'HIGH'"), (1, "distinct_up > 0")),
    ),
    Hypothesis(
        "categories lost or merged", "list the values that are gone since the snapshot before", "restore the mapping or update the accepted values",
        ((4, "metric LIKE 'distinct%' AND direction = 'LOW'"), (1, "distinct_down > 0")),
    ),
    Hypothesis(
        "several columns moved together", "start with the metric that deviates most", "treat the findings of the single metrics first",
        ((4, "detector = 'isolation_forest'"),),
    ),
    Hypothesis("a change in the pipeline code", "read what was deployed since the snapshot before", "revert or adapt the change", ((1, "1 = 1"),)),
    Hypothesis("a change at the source", "ask the owner of the source", "adapt the load to it", ((1, "1 = 1"),)),
)
NAMED = 3


def points_sql(hypothesis: Hypothesis) -> str:
    return " + ".join(f"(CASE WHEN {c} THEN {p} ELSE 0 END)" for p, c in hypothesis.points)


def _with_causes(findings: DataFrame) -> DataFrame:
    """``_ranked``: the NAMED hypotheses with most points, ties in their listed order."""
    evidence = findings.groupBy(*SERIES).agg(*(F.expr(e).alias(f"_e_{n}") for n, e in EVIDENCE.items()))
    joined = findings.join(evidence, SERIES)
    scored = []
    for i, h in enumerate(HYPOTHESES):
        points = points_sql(h)
        points = re.sub(rf"\b({'|'.join(EVIDENCE)})\b", r"_e_\1", points)
        scored.append(F.struct((-F.expr(points)).alias("points"), F.lit(i).alias("i"), F.lit(h.cause).alias("cause"), F.lit(h.check).alias("check"), F.lit(h.remedy).alias("remedy")))
    return joined.withColumn("_ranked", F.slice(F.array_sort(F.array(*scored)), 1, NAMED))


def fact() -> Column:
    """The finding in one clause: what it is today and what it usually is."""
    table, column = table_key(F.col("source"), F.col("table_name")), F.regexp_replace("metric", "^[a-z_]+\\.", "")
    label = F.col("metric")
    for prefix, text in LABELS.items():
        spoken = F.lit(text) if prefix == "row_count" else F.concat(F.lit(f"{text} "), column)
        label = F.when(F.col("metric") == prefix if prefix == "row_count" else F.col("metric").startswith(f"{prefix}."), spoken).otherwise(label)
    side = F.when(F.col("direction") == "HIGH", " above").otherwise(" below")
    change = settle(F.abs(F.try_divide(F.col("today"), F.col("expected")) - 1) * 100, 1).cast("decimal(38,1)").cast("string")
    away = F.coalesce(F.concat(F.lit(", "), change, F.lit("%"), side, F.lit(" the usual ")), F.concat(F.lit(","), side, F.lit(" the usual ")))
    figures = F.concat(table, F.lit(": "), label, F.lit(" is "), F.coalesce(plain_number(F.col("today")), F.lit(DASH)), away, expected_text())
    leader = F.coalesce(F.get(F.col("top_contributors"), F.lit(0))["metric"], F.lit("no single one"))
    joint = F.concat(table, F.lit(": its metrics together are anomalous, most of all "), leader)
    return F.when(F.col("detector") == "isolation_forest", joint).otherwise(figures)


def explain(findings: DataFrame) -> DataFrame:
    """Add ``explanation``: the fact and its most likely cause in one sentence."""
    text = F.concat(fact(), F.lit("; most likely "), F.col("_ranked")[0]["cause"], F.lit("."))
    return _with_causes(findings).withColumn("explanation", text).select(*findings.columns, "explanation")


def root_cause(findings: DataFrame) -> DataFrame:
    """Add ``what_happened``, ``causes`` and ``what_to_check`` (NAMED each, most likely first) and ``how_to_fix``."""
    return _with_causes(findings).select(
        *findings.columns,
        F.concat(fact(), F.lit(".")).alias("what_happened"),
        F.col("_ranked.cause").alias("causes"),
        F.col("_ranked.check").alias("what_to_check"),
        F.col("_ranked")[0]["remedy"].alias("how_to_fix"),
    )
