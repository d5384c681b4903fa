"""Column profiles of whole tables and bucketed metric histories.

A profile reads the moments of all columns once and every column once more for its values:

* one wide aggregate for counts and moments (partial aggregation, one tiny
  shuffle of a single row per task);
* one frequency table ``(column, value) -> n`` per data type for exact distinct counts
  and, for text, top values. Each reads its own columns alone, so none is read twice. Unpivoting first keys the shuffle by column *and* value, so
  neither a hot column nor a hot value lands in one task, and repeated values are combined
  before they are shuffled. A long text is counted under its first characters, a 128-bit digest and
  its length; only the few long texts that a report shows are read again and moved whole.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.scalars import is_numeric, is_text, nan_to_null, percent, quoted, settle, text_literal

METRICS_KEPT = ("null_pct", "mean", "std", "distinct_count")
LONG_TEXT = 64  # bytes; a longer text is counted under a key of its own
HEAD = 32  # its first characters, which lead the key


def _as_text(name: str, dtype: T.DataType) -> str:
    """One text form per distinct value, so that unlike types share one frequency table."""
    c = quoted(name)
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return f"CAST({c} + CAST(0 AS {dtype.simpleString()}) AS STRING)"  # -0.0 and 0.0 are one value
    if isinstance(dtype, T.BinaryType):
        return f"hex({c})"
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        return f"IF({c} IS NOT NULL, to_json({c}), NULL)"
    return f"CAST({c} AS STRING)"


def _counted(df: DataFrame, columns: Sequence[str], names: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Frequency table of expressions of one type: ``(*keys, column, value, n)``.

    Rows are turned into ``(slot number, value)`` pairs; a number is a cheaper key than a name.
    """
    pairs = ", ".join(f"struct({i} AS _slot, {c} AS value)" for i, c in enumerate(columns))
    shown = ", ".join(text_literal(n) for n in names)
    by = [quoted(k) for k in keys]
    return (
        df.selectExpr(*by, f"inline(array({pairs}))")
        .filter("value IS NOT NULL")
        .groupBy(*keys, "_slot", "value")
        .agg(F.count(F.lit(1)).alias("n"))
        .selectExpr(*by, f"get(array({shown}), _slot) AS column", "value", "n")
    )


def value_frequencies(
    df: DataFrame, columns: Sequence[str] | Mapping[str, str], keys: Sequence[str] = ()
) -> DataFrame:
    """``(*keys, column, value, n)`` for the non-null values of ``columns``, values as text.

    A mapping gives columns another name in the output.
    """
    shown = columns if isinstance(columns, Mapping) else {c: c for c in columns}
    types = {f.name: f.dataType for f in df.schema.fields}
    return _counted(df, [_as_text(c, types[c]) for c in shown], list(shown.values()), keys)


def _family(dtype: T.DataType) -> str:
    """Type in which columns can share a frequency table without losing a distinction."""
    if isinstance(dtype, T.IntegralType):
        return "bigint"
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return "double"
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)) or is_text(dtype):
        return "string"
    return dtype.simpleString()


def text_key(text: str) -> str:
    """SQL of the short text that stands for a text: itself, or for a long one its head, digest and length.

    The key of a long text has more than LONG_TEXT bytes, so it is never equal to a short text.
    """
    return f"IF(octet_length({text}) > {LONG_TEXT}, concat(left({text}, {HEAD}), md5(CAST({text} AS BINARY)), octet_length({text})), {text})"


def _typed_frequencies(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Frequency table ``(*keys, _slot, value, n)`` of ``columns``, all of one family; ``_slot`` is the place in ``columns``."""
    types = {f.name: f.dataType for f in df.schema.fields}
    family = _family(types[columns[0]])
    values = [text_key(_as_text(c, types[c])) if family == "string" else f"CAST({quoted(c)} AS {family})" for c in columns]
    rows = ", ".join(f"struct({i} AS _slot, {v} AS value)" for i, v in enumerate(values))
    return (
        df.selectExpr(*[quoted(k) for k in keys], f"inline(array({rows}))")
        .filter("value IS NOT NULL")
        .groupBy(*keys, "_slot", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _by_family(df: DataFrame, columns: Sequence[str]) -> list[list[str]]:
    types = {f.name: f.dataType for f in df.schema.fields}
    groups: dict[str, list[str]] = {}
    for c in columns:
        groups.setdefault(_family(types[c]), []).append(c)
    return list(groups.values())


def _named(slots: DataFrame, names: Sequence[str]) -> DataFrame:
    shown = ", ".join(text_literal(n) for n in names)
    return slots.withColumn("column", F.expr(f"get(array({shown}), _slot)")).drop("_slot")


def _count_values(frequencies: DataFrame, names: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    # reading n, although it is never zero, keeps this plan's exchange equal to that of the top texts
    counts = frequencies.groupBy(*keys, "_slot").agg(F.count_if(F.col("n") > 0).alias("distinct_count"))
    return _named(counts, names).select(*keys, "column", "distinct_count")


def distinct_counts(
    df: DataFrame, columns: Sequence[str] | Mapping[str, str], keys: Sequence[str] = ()
) -> DataFrame:
    """Exact ``(*keys, column, distinct_count)``; long texts are told apart by 128-bit digests."""
    shown = columns if isinstance(columns, Mapping) else {c: c for c in columns}
    parts = [_count_values(_typed_frequencies(df, g, keys), [shown[c] for c in g], keys) for g in _by_family(df, list(shown))]
    return reduce(DataFrame.unionByName, parts)


def _top_texts(df: DataFrame, frequencies: DataFrame, columns: Sequence[str], text: Sequence[str], k: int) -> DataFrame:
    """``(column, rank, value, count)``: the ``k`` most frequent texts per column, ties by their keys.

    ``rank <= k`` lets Spark cut every task to ``k`` rows per column before the shuffle. The long
    texts among them, at most ``k`` per column, are looked up in a second reading; without any, AQE leaves it out.
    """
    slots = [i for i, c in enumerate(columns) if c in text]
    w = Window.partitionBy("_slot").orderBy(F.desc("n"), F.asc("value"))
    tops = (
        # tests n, so that the condition stays above the exchange that the counts share
        frequencies.filter(f"IF(_slot IN ({', '.join(map(str, slots))}), n, 0) > 0")
        .withColumn("rank", F.row_number().over(w))
        .filter(F.col("rank") <= k)
        .select("_slot", "rank", F.col("value").alias("key"), F.col("n").alias("count"))
    )
    texts = ", ".join(f"struct({i} AS _slot, CAST({quoted(columns[i])} AS STRING) AS value)" for i in slots)
    long = F.octet_length("key") > LONG_TEXT
    wanted = tops.filter(long).select("_slot", "key")
    whole = (
        df.selectExpr(f"inline(array({texts}))")
        .filter(F.octet_length("value") > LONG_TEXT)
        .withColumn("key", F.expr(text_key("value")))
        .join(F.broadcast(wanted), ["_slot", "key"])  # k rows of about 100 bytes per text column
        .groupBy("_slot", "key")
        .agg(F.any_value("value").alias("value"))
    )
    # two branches of k rows per column, put together by their common place
    rows = tops.select("_slot", "key", "rank", "count", F.when(~long, F.col("key")).alias("value"))
    merged = rows.unionByName(whole, allowMissingColumns=True).groupBy("_slot", "key").agg(
        F.max("rank").alias("rank"), F.max("count").alias("count"), F.max("value").alias("value")
    )
    return _named(merged, columns).select("column", "rank", "value", "count")


def _moments(df: DataFrame) -> DataFrame:
    """One row per column with counts and, for numbers, min, max, mean and sample std.

    Written as SQL text: a wide table needs hundreds of expressions and text is parsed in one go.
    """
    aggs = ["count(1) AS row_count"]
    rows = []
    for i, f in enumerate(df.schema.fields):
        c = quoted(f.name)
        aggs.append(f"count({c}) AS n{i}")
        stats = dict.fromkeys(("min", "max", "mean", "std"), "CAST(NULL AS DOUBLE)")
        if is_numeric(f.dataType):
            number = f"CAST(CAST({c} AS INT) AS DOUBLE)" if isinstance(f.dataType, T.BooleanType) else f"CAST({c} AS DOUBLE)"
            for stat, function in (("min", "min"), ("max", "max"), ("mean", "avg"), ("std", "stddev_samp")):
                aggs.append(f"{function}({number}) AS {stat}{i}")
                stats[stat] = f"round(round({stat}{i}, 9), 4)"
        shown = ", ".join(f"{v} AS {k}" for k, v in stats.items())
        rows.append(
            f"struct({i} AS position, {text_literal(f.name)} AS column, {text_literal(f.dataType.simpleString())} AS dtype, row_count, "
            f"row_count - n{i} AS null_count, "
            f"round(round(try_divide(100D * (row_count - n{i}), row_count), 9), 2) AS null_pct, {shown})"
        )
    return df.selectExpr(*aggs).selectExpr(f"inline(array({', '.join(rows)}))")


def profile_table(
    df: DataFrame,
    source: str,
    table_name: str,
    profiled_at: Column | None = None,
    *,
    approx_distinct: bool = False,
    k: int = 5,
) -> DataFrame:
    """One row per column of ``df``: counts, percentages, moments and top values."""
    df = nan_to_null(df)
    at = F.current_timestamp() if profiled_at is None else profiled_at
    text = [f.name for f in df.schema.fields if is_text(f.dataType)]
    parts = [_moments(df)]
    if approx_distinct:
        fields = df.schema.fields
        row = df.selectExpr(
            *[f"approx_count_distinct({_as_text(f.name, f.dataType)}, 0.01D) AS _v{i}" for i, f in enumerate(fields)]
        )
        pairs = [f"struct({text_literal(f.name)} AS column, _v{i} AS distinct_count)" for i, f in enumerate(fields)]
        parts.append(row.selectExpr(f"inline(array({', '.join(pairs)}))"))
    for columns in _by_family(df, text if approx_distinct else df.columns):
        # both readers of this table share one exchange
        freq = _typed_frequencies(df, columns)
        if set(text) & set(columns):
            parts.append(_top_texts(df, freq, columns, text, k).select("column", F.struct("rank", "value", "count").alias("top")))
        if not approx_distinct:
            parts.append(_count_values(freq, columns))

    # a handful of rows per column meet in one group-by instead of several joins
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    kept = ("position", "dtype", "row_count", "null_count", "null_pct", "min", "max", "mean", "std")
    tops = "CAST(NULL AS ARRAY<STRUCT<value: STRING, count: BIGINT>>)"
    if text:
        names = ", ".join(text_literal(c) for c in text)
        tops = (
            "transform(array_sort(collect_list(top)), t -> named_struct('value', t.value, 'count', t.count))"
        )
        tops = f"IF(column IN ({names}), {tops}, NULL)"
    return (
        merged.groupBy("column")
        .agg(
            *[F.expr(f"max({c})").alias(c) for c in kept],
            F.expr("coalesce(max(distinct_count), 0)").alias("distinct_count"),
            F.expr(tops).alias("top_values"),
        )
        .select(
            F.lit(source).alias("source"),
            F.lit(table_name).alias("table_name"),
            at.alias("profiled_at"),
            "column",
            "dtype",
            "position",
            "row_count",
            "null_count",
            "null_pct",
            "distinct_count",
            F.expr("coalesce(round(round(try_divide(100D * distinct_count, row_count), 9), 2), 0D)").alias("distinct_pct"),
            "min",
            "max",
            "mean",
            "std",
            "top_values",
        )
    )


def bucket_history(
    df: DataFrame,
    *,
    source: Column,
    table_name: Column,
    profiled_at: Column,
    nulls_of: Sequence[str] = (),
    stats_of: Sequence[str] = (),
    distinct_of: Sequence[str] = (),
) -> DataFrame:
    """Long metric history ``(source, table_name, profiled_at, metric, value)`` of a raw table.

    Every bucket of ``profiled_at`` stands for one snapshot. Hot buckets shrink in the
    partial aggregate before the shuffle; the distinct counts shuffle on bucket and value.
    """
    keys = ["source", "table_name", "profiled_at"]
    slot = {c: f"_c{i}" for i, c in enumerate(dict.fromkeys([*nulls_of, *stats_of, *distinct_of]))}
    tagged = nan_to_null(
        df.select(
            source.alias("source"),
            table_name.alias("table_name"),
            profiled_at.alias("profiled_at"),
            *[F.col(quoted(c)).alias(s) for c, s in slot.items()],
        )
    )
    aggs = [F.count(F.lit(1)).alias("row_count")]
    aggs += [F.count(slot[c]).alias(f"n{slot[c]}") for c in nulls_of]
    for c in stats_of:
        value = F.col(slot[c]).cast("double")
        aggs += [F.avg(value).alias(f"mean{slot[c]}"), F.stddev_samp(value).alias(f"std{slot[c]}")]
    wide = tagged.groupBy(*keys).agg(*aggs)

    rows_in = F.col("row_count")
    metrics: Mapping[str, Column] = {
        "row_count": rows_in.cast("double"),
        **{f"null_pct.{c}": percent(rows_in - F.col(f"n{slot[c]}"), rows_in, 2) for c in nulls_of},
        **{f"{s}.{c}": settle(F.col(f"{s}{slot[c]}"), 4) for c in stats_of for s in ("mean", "std")},
    }
    long = wide.select(
        *keys,
        F.inline(
            F.array(*[F.struct(F.lit(m).alias("metric"), v.alias("value")) for m, v in metrics.items()])
        ),
    ).filter(F.col("value").isNotNull())
    if len(distinct_of) == 1:
        c = distinct_of[0]
        # a single distinct aggregate is planned as bucket+value, then bucket
        counted = tagged.groupBy(*keys).agg(F.count_distinct(slot[c]).cast("double").alias("value"))
        long = long.unionByName(counted.select(*keys, F.lit(f"distinct_count.{c}").alias("metric"), "value"))
    elif distinct_of:
        counted = distinct_counts(tagged, {slot[c]: c for c in distinct_of}, keys)
        long = long.unionByName(
            counted.select(
                *keys,
                F.concat(F.lit("distinct_count."), "column").alias("metric"),
                F.col("distinct_count").cast("double").alias("value"),
            )
        )
    return long
