"""Rule suites on a stream, with results for every micro-batch and for all of them.

A micro-batch is written once; the totals of its row rules are observed on the way, so judging costs no
second pass. Totals add up, and so do the frequencies of the columns that must be unique.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plumbline.operators.profile import value_frequencies
from plumbline.operators.rules import Rule, observed_totals, row_results, row_rules, split_rows, unique_columns, unique_results

VALUES = "column string, value string, n bigint"


def record_batch(batch: DataFrame, batch_id: int, rules: Sequence[Rule], base: str) -> None:
    """Write the rows of a batch with the rules they break, its totals and the frequencies of its unique columns.

    A batch that comes again after a failure replaces what it wrote, so it counts once.
    """
    spark = batch.sparkSession
    totals = observed_totals(rules)
    seen = Observation()
    rows = f"{base}/rows/batch={batch_id}"
    observed = batch.observe(seen, *[F.expr(e).alias(name) for name, e in totals.items()])
    split_rows(observed, row_rules(rules)).write.mode("overwrite").parquet(rows)
    found = {name: seen.get.get(name) or 0 for name in totals}  # a batch without rows may observe nothing
    schema = ", ".join(f"{name} bigint" for name in totals)
    spark.createDataFrame([tuple(found.values())], schema).coalesce(1).write.mode("overwrite").parquet(f"{base}/totals/batch={batch_id}")
    if columns := unique_columns(rules):
        written = spark.read.schema(batch.schema).parquet(rows)
        value_frequencies(written, columns).write.mode("overwrite").parquet(f"{base}/values/batch={batch_id}")


def suite_stream(stream: DataFrame, rules: Sequence[Rule], base: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Start judging; rows, totals and frequencies go to ``base``, a folder for each batch."""
    trigger = trigger or {"availableNow": True}

    def handle(batch: DataFrame, batch_id: int) -> None:
        record_batch(batch, batch_id, rules, base)

    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(f"{schema}, batch bigint").parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"{schema}, batch bigint")


def suite_results(
    spark: SparkSession, base: str, suite: str, table_name: str, rules: Sequence[Rule], by_batch: bool = False
) -> DataFrame:
    """Rows as ``rules.evaluate`` gives them, of all batches so far or, with a ``batch`` column, of each.

    A value counts as repeated across batches in the results of all, and within its batch in the results of each.
    """
    keys = ["batch"] if by_batch else []
    names = list(observed_totals(rules))
    totals = _read(spark, f"{base}/totals", ", ".join(f"{n} bigint" for n in names))
    added = totals.groupBy(*keys).agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])
    parts = []
    if any(r.kind != "unique" for r in rules):
        parts.append(row_results(added, suite, table_name, rules, keys))
    if unique_columns(rules):
        values = _read(spark, f"{base}/values", VALUES)
        if not by_batch:
            values = values.groupBy("column", "value").agg(F.sum("n").alias("n"))
        parts.append(unique_results(values, suite, table_name, rules, keys))
    return reduce(DataFrame.unionByName, parts)
