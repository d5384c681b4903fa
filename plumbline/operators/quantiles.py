"""Exact quantiles by distributed selection.

No task holds the values of a group: a bounded sketch brackets each quantile, one pass counts what lies below and inside the
brackets, and only the values inside, a few ten-thousandths of a large group, are ranked. A bracket that turns out to miss its
ranks is widened to the whole group, so the result never rests on the sketch. Sketches and brackets, one row per group, are stored: Spark
sees their size and broadcasts few of them, so that the values of a large group are neither sent to one task nor sorted there.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.session import stored

ACCURACY = 10_000  # the sketch is off by at most one in so many ranks
LOWEST, HIGHEST = float("-inf"), float("inf")


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], accuracy: int = ACCURACY) -> DataFrame:
    """One row ``(*keys, n, q)`` per group: the count of its values and its quantiles, linear between ranks, in the order of ``probs``.

    Null and NaN values do not count; a group without others has no row. Null keys are keys. Equal values are
    ranked as one row with a count, so a value held by a third of all rows costs no more than another.
    """
    if not probs or not all(0 <= p <= 1 for p in probs):
        raise ValueError("probabilities from 0 to 1 are needed")
    rows = df.select(F.struct(*keys).alias("keys"), F.col(value).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    # a constant key alone would be folded away and leave joins without a condition; this one cannot be
    rows = rows.select(F.struct("keys", F.isnan("v").alias("never")).alias("k"), "v")
    sketched = stored(rows.groupBy("k").agg(F.count("v").alias("n"), _sketch(probs, accuracy).alias("s")), "quantile_sketches")
    first, last = _ranks(probs, F.floor), _ranks(probs, F.ceil)
    # the values are read again twice: once to count, once to pick
    counted = rows.join(sketched, "k").groupBy("k", "n", "s").agg(
        *[F.count_if(F.col("v") < _low(i)).alias(f"below{i}") for i in range(len(probs))],
        *[F.count_if(F.col("v").between(_low(i), _high(i))).alias(f"inside{i}") for i in range(len(probs))],
    )
    spans = []
    for i in range(len(probs)):
        holds = (F.col(f"below{i}") <= first[i]) & (last[i] < F.col(f"below{i}") + F.col(f"inside{i}"))
        spans.append(
            F.struct(
                F.lit(i).alias("i"),
                F.when(holds, _low(i)).otherwise(LOWEST).alias("low"),
                F.when(holds, _high(i)).otherwise(HIGHEST).alias("high"),
                F.when(holds, F.col(f"below{i}")).otherwise(0).alias("below"),
                first[i].alias("first"),
                last[i].alias("last"),
                (F.col("n") - 1) * F.lit(float(probs[i])) - first[i],
            )
        )
    fields = "struct<i:int,low:double,high:double,below:bigint,first:bigint,last:bigint,part:double>"
    brackets = stored(counted.select("k", "n", F.array(*[s.cast(fields) for s in spans]).alias("spans")), "quantile_brackets")
    picked = rows.join(brackets, "k").select(
        "k", "n", "v", F.explode(F.filter("spans", lambda s: (s["low"] <= F.col("v")) & (F.col("v") <= s["high"]))).alias("span")
    )
    each = picked.groupBy("k", "n", "span", "v").agg(F.count(F.lit(1)).alias("times"))
    upto = F.col("span.below") + F.sum("times").over(Window.partitionBy("k", "span.i").orderBy("v"))
    found = each.withColumn("upto", upto).groupBy("k", "n", "span").agg(
        F.min(F.when(F.col("upto") > F.col("span.first"), F.col("v"))).alias("a"), F.min(F.when(F.col("upto") > F.col("span.last"), F.col("v"))).alias("b")
    )
    between = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("a") + (F.col("b") - F.col("a")) * F.col("span.part"))
    # one entry per probability
    ordered = F.array_sort(F.collect_list(F.struct(F.col("span.i").alias("i"), between.alias("q"))))
    return found.groupBy("k", "n").agg(ordered.alias("qs")).select("k.keys.*", "n", F.col("qs.q").alias("q"))


def _sketch(probs: Sequence[float], accuracy: int) -> Column:
    slack = 2 / accuracy
    ends = [e for p in probs for e in (max(0.0, p - slack), min(1.0, p + slack))]
    return F.percentile_approx("v", ends, accuracy)


def _low(i: int) -> Column:
    return F.col("s")[2 * i]


def _high(i: int) -> Column:
    return F.col("s")[2 * i + 1]


def _ranks(probs: Sequence[float], to_rank) -> list[Column]:
    """Ranks from 0 between which the quantiles lie."""
    return [to_rank((F.col("n") - 1) * F.lit(float(p))).cast("long") for p in probs]
