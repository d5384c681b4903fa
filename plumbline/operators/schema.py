"""Schema fingerprints and drift."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.scalars import quoted
from plumbline.operators.snapshots import SERIES, latest_snapshot, newest


def declared_schema(spark: SparkSession, df: DataFrame, source: str, table_name: str) -> DataFrame:
    """Columns and types of a table as rows; reads metadata only."""
    rows = [(source, table_name, f.name, f.dataType.simpleString().upper()) for f in df.schema.fields]
    return spark.createDataFrame(rows, "source string, table_name string, column string, type string")


def observed_schema(df: DataFrame, keys: dict, columns: list[str]) -> DataFrame:
    """Columns that hold at least one value in each group of ``keys``, with their types.

    A column that a feed stops filling disappears from the observed schema even though the
    declared one still lists it. One aggregate over the referenced columns.
    """
    types = {f.name: f.dataType.simpleString().upper() for f in df.schema.fields}
    names = list(keys)
    tagged = df.select(*[c.alias(k) for k, c in keys.items()], *[F.col(quoted(c)) for c in columns])
    counts = tagged.groupBy(*names).agg(*[F.count(F.col(quoted(c))).alias(f"_n{i}") for i, c in enumerate(columns)])
    entries = [
        F.struct(F.lit(c).alias("column"), F.lit(types[c]).alias("type"), F.col(f"_n{i}").alias("filled"))
        for i, c in enumerate(columns)
    ]
    return counts.select(*names, F.inline(F.array(*entries))).filter(F.col("filled") > 0).drop("filled")


def fingerprint(schema_rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """md5 of the name-ordered JSON object ``{"column": "type", ...}`` per table."""
    keys = keys or SERIES
    pairs = F.array_sort(F.collect_list(F.struct("column", "type")))
    # names and types as JSON strings, whatever they hold; a comma and a colon are followed by a space
    quote = lambda text: F.regexp_extract(F.to_json(F.struct(text.alias("s"))), r"^\{\"s\":(.*)\}$", 1)
    entries = F.transform("_pairs", lambda p: F.concat(quote(p["column"]), F.lit(": "), quote(p["type"])))
    text = F.concat(F.lit("{"), F.array_join(entries, ", "), F.lit("}"))
    return (
        schema_rows.groupBy(*keys)
        .agg(pairs.alias("_pairs"))
        .select(*keys, text.alias("columns_json"))
        .withColumn("fingerprint", F.md5(F.col("columns_json").cast("binary")))
    )


def drift(old: DataFrame, new: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """ADDED, DROPPED and TYPE CHANGED columns between two sets of schema rows."""
    keys = list(keys or [])
    a = old.select(*keys, "column", F.col("type").alias("old_type"))
    b = new.select(*keys, "column", F.col("type").alias("new_type"))
    change = (
        F.when(F.col("old_type").isNull(), "ADDED")
        .when(F.col("new_type").isNull(), "DROPPED")
        .when(F.col("old_type") != F.col("new_type"), "TYPE CHANGED")
    )
    # The message formats of the drift report.
    message = (
        F.when(F.col("change") == "ADDED", F.format_string("ADDED column: %s", "column"))
        .when(F.col("change") == "DROPPED", F.format_string("DROPPED column: %s", "column"))
        .otherwise(F.format_string("TYPE CHANGED: %s  %s -> %s", "column", "old_type", "new_type"))
    )
    return (
        a.join(b, [*keys, "column"], "full_outer")
        .withColumn("change", change)
        .filter(F.col("change").isNotNull())
        .withColumn("issue", message)
    )


def schema_rows(stored: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``columns_json`` of stored schemas back to (keys, column, type) rows."""
    keys = keys or SERIES
    return stored.select(*keys, F.explode(F.from_json("columns_json", "map<string,string>")).alias("column", "type"))


def stored_drift(snapshots: DataFrame) -> DataFrame:
    """Drift of every table between its last two stored schemas; a table with one schema has none."""
    tiebreak = [c for c in ("batch",) if c in snapshots.columns]
    two = newest(snapshots.filter(F.col("schema_fingerprint").isNotNull()), SERIES, 2, *tiebreak)
    two = two.withColumn("columns_json", F.col("schema_fingerprint"))
    before = two.filter("rn = 2")
    now = two.filter("rn = 1").join(before.select(*SERIES), SERIES, "left_semi")
    return drift(schema_rows(before), schema_rows(now), SERIES)


def last_fingerprint(snapshots: DataFrame) -> DataFrame:
    """Fingerprint of the latest stored snapshot per (source, table)."""
    return latest_snapshot(snapshots).select(*SERIES, "profiled_at", "schema_fingerprint")
