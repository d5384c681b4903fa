"""Declarative rules compiled into aggregates.

All row rules of a table become expressions of one ``agg`` over one scan; uniqueness rules
of a table share one frequency table. Results are one row per rule.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.scalars import DASH, literal, quoted
from plumbline.operators.profile import value_frequencies


@dataclass(frozen=True)
class Rule:
    """One expectation on a table or a column; ``mostly`` is the share that has to comply."""

    kind: str
    column: str | None = None
    low: float | None = None
    high: float | None = None
    values: tuple = field(default=())
    pattern: str | None = None
    mostly: float = 1.0


def row_count_between(low: int, high: int) -> Rule:
    return Rule("row_count_between", low=low, high=high)


def unique(column: str) -> Rule:
    return Rule("unique", column)


def not_null(column: str, mostly: float = 1.0) -> Rule:
    return Rule("not_null", column, mostly=mostly)


def between(column: str, low: float, high: float, mostly: float = 1.0) -> Rule:
    return Rule("between", column, low=low, high=high, mostly=mostly)


def in_set(column: str, values: Sequence[Any], mostly: float = 1.0) -> Rule:
    return Rule("in_set", column, values=tuple(values), mostly=mostly)


def matches(column: str, pattern: str, mostly: float = 1.0) -> Rule:
    return Rule("matches", column, pattern=pattern, mostly=mostly)


def condition_sql(rule: Rule) -> str:
    """True where a non-null value complies; NULL where the value is missing."""
    c = quoted(rule.column)
    if rule.kind == "not_null":
        return f"{c} IS NOT NULL"
    if rule.kind == "between":
        return f"{c} BETWEEN {literal(rule.low)} AND {literal(rule.high)}"
    if rule.kind == "in_set":
        allowed = [literal(v) for v in rule.values if v is not None]
        # without allowed values none complies; NULL is never compared
        return f"{c} IN ({', '.join(allowed)})" if allowed else f"IF({c} IS NULL, NULL, FALSE)"
    if rule.kind == "matches":
        return f"{c} RLIKE {literal(rule.pattern)}"
    raise ValueError(f"{rule.kind} is not a row rule")


def row_condition(rule: Rule) -> Column:
    return F.expr(condition_sql(rule))


def duplicate_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row with, per column ``i``: non-null rows, rows of duplicated values, duplicated values."""
    return _duplicates(value_frequencies(df, columns), columns)


def _duplicates(frequencies: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    aggs = []
    for i, name in enumerate(columns):
        mine = f"column = {literal(name)}"
        aggs += [
            f"coalesce(sum(IF({mine}, n, 0)), 0) AS filled{i}",
            f"coalesce(sum(IF({mine} AND n > 1, n, 0)), 0) AS repeated{i}",
            f"count_if({mine} AND n > 1) AS values{i}",
        ]
    return frequencies.groupBy(*keys).agg(*[F.expr(a) for a in aggs])


def row_rules(rules: Sequence[Rule]) -> list[Rule]:
    """Rules that judge each row by itself."""
    return [r for r in rules if r.kind not in ("unique", "row_count_between")]


def unique_columns(rules: Sequence[Rule]) -> list[str]:
    return [r.column for r in rules if r.kind == "unique"]


def observed_totals(rules: Sequence[Rule]) -> dict[str, str]:
    """SQL aggregates that the row rules need, by name: ``rows``, and per row rule ``i`` the values ``of`` which how many are ``ok``.

    Totals of parts of a table add up to those of the table.
    """
    totals = {"rows": "count(1)"}
    for i, r in enumerate(row_rules(rules)):
        totals[f"ok{i}"] = f"count_if({condition_sql(r)})"
        totals[f"of{i}"] = f"count({'1' if r.kind == 'not_null' else quoted(r.column)})"
    return totals


def _result(suite: str, table_name: str, rule: Rule, passed: str, observed: str, total: str) -> str:
    detail = (
        "'row count out of range'"
        if rule.kind == "row_count_between"
        else f"concat({observed}, ' of ', {total}, ' break the rule')"
    )
    return (
        f"struct({literal(suite)} AS suite, {literal(table_name)} AS table_name, "
        f"{literal(rule.column or 'TABLE')} AS column, {literal(rule.kind)} AS rule, {passed} AS passed, "
        f"CAST({observed} AS BIGINT) AS observed, IF({passed}, NULL, {detail}) AS detail)"
    )


def row_results(totals: DataFrame, suite: str, table_name: str, rules: Sequence[Rule], keys: Sequence[str] = ()) -> DataFrame:
    """Results of all but the unique rules, from rows of ``observed_totals``."""
    structs = [
        _result(suite, table_name, r, f"(rows BETWEEN {literal(r.low)} AND {literal(r.high)})", "rows", "rows")
        for r in rules
        if r.kind == "row_count_between"
    ]
    for i, r in enumerate(row_rules(rules)):
        share = f"coalesce(try_divide(ok{i}, of{i}), 1D)"
        structs.append(_result(suite, table_name, r, f"({share} >= {float(r.mostly)!r}D)", f"(of{i} - ok{i})", f"of{i}"))
    return totals.selectExpr(*keys, f"inline(array({', '.join(structs)}))")


def unique_results(frequencies: DataFrame, suite: str, table_name: str, rules: Sequence[Rule], keys: Sequence[str] = ()) -> DataFrame:
    """Results of the unique rules, from the frequencies ``(column, value, n)`` of their columns."""
    unique_rules = [r for r in rules if r.kind == "unique"]
    structs = [
        _result(suite, table_name, r, f"(repeated{i} = 0)", f"repeated{i}", f"filled{i}") for i, r in enumerate(unique_rules)
    ]
    return _duplicates(frequencies, unique_columns(rules), keys).selectExpr(*keys, f"inline(array({', '.join(structs)}))")


def evaluate(df: DataFrame, suite: str, table_name: str, rules: Sequence[Rule]) -> DataFrame:
    """Rows ``(suite, table_name, column, rule, passed, observed, detail)``.

    ``observed`` is the row count for the row-count rule, else the number of rows that break
    the rule. Missing values count only in ``not_null``; an empty column passes.
    """
    parts = []
    if any(r.kind != "unique" for r in rules):
        totals = df.selectExpr(*[f"{e} AS {name}" for name, e in observed_totals(rules).items()])
        parts.append(row_results(totals, suite, table_name, rules))
    if columns := unique_columns(rules):
        parts.append(unique_results(value_frequencies(df, columns), suite, table_name, rules))
    return reduce(DataFrame.unionByName, parts)


def summarize(results: DataFrame, *keys: str) -> DataFrame:
    """Passed, failed and success per key, or overall without keys."""
    return results.groupBy(*keys).agg(
        F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed")
    ).withColumn("success", F.col("failed") == 0)


def split_rows(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Add ``broken``: the names of the row rules each row breaks. Works on streams too."""
    checks = [
        F.when(
            ~F.coalesce(row_condition(r), F.lit(True)), F.lit(f"{r.kind}({r.column})")
        )
        for r in rules
    ]
    return df.withColumn("broken", F.array_compact(F.array(*checks)))


# -- scalar checks ---------------------------------------------------------------------------


@dataclass(frozen=True)
class ScalarCheck:
    """Count rows where ``condition`` holds; ``verdict(count, rows)`` says whether that is fine."""

    label: str
    condition: Column | None
    verdict: Callable[[Column, Column], Column]


def scalar_checks(df: DataFrame, table_name: str, checks: Sequence[ScalarCheck]) -> DataFrame:
    """Rows ``(table_name, label, value, passed)`` from one aggregate over the table."""
    rows = F.col("rows")
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(checks):
        aggs.append((F.count(F.lit(1)) if c.condition is None else F.count_if(c.condition)).alias(f"v{i}"))
    structs = [
        F.struct(
            F.lit(table_name).alias("table_name"),
            F.lit(c.label).alias("label"),
            F.col(f"v{i}").alias("value"),
            F.coalesce(c.verdict(F.col(f"v{i}"), rows), F.lit(True)).alias("passed"),
        )
        for i, c in enumerate(checks)
    ]
    return df.agg(*aggs).select(F.inline(F.array(*structs)))


# -- model tests -----------------------------------------------------------------------------


@dataclass(frozen=True)
class ModelTests:
    """Schema tests of one model."""

    unique: tuple[str, ...] = ()
    not_null: tuple[str, ...] = ()
    not_null_mostly: tuple[tuple[str, float], ...] = ()
    accepted_values: tuple[tuple[str, tuple], ...] = ()


def model_tests(df: DataFrame, model: str, tests: ModelTests) -> DataFrame:
    """Rows ``(model, column, test, passed, detail)``; one scan plus one frequency table."""

    def result(column: str, test: str, passed: str, detail: str) -> str:
        return (
            f"struct({literal(model)} AS model, {literal(column)} AS column, {literal(test)} AS test, "
            f"{passed} AS passed, IF({passed}, NULL, concat({detail})) AS detail)"
        )

    aggs, structs = ["count(1) AS rows"], []
    for i, c in enumerate(tests.not_null):
        aggs.append(f"count_if({quoted(c)} IS NULL) AS nn{i}")
        structs.append(result(c, "not_null", f"(nn{i} = 0)", f"nn{i}, ' null(s)'"))
    for i, (c, share) in enumerate(tests.not_null_mostly):
        aggs.append(f"count_if({quoted(c)} IS NULL) AS nm{i}")
        # an empty table has a present share of zero and fails
        present = f"coalesce(try_divide(rows - nm{i}, rows), 0D)"
        missing = f"round(round((1 - {present}) * 100, 9), 1)"
        structs.append(
            result(
                c,
                f"not_null (≥{int(share * 100)}%)",
                f"({present} >= {float(share)!r}D)",
                f"nm{i}, ' nulls (', {missing}, '%)'",
            )
        )
    for i, (c, allowed) in enumerate(tests.accepted_values):
        aggs.append(f"count_if({quoted(c)} NOT IN ({', '.join(literal(v) for v in allowed)})) AS av{i}")
        structs.append(result(c, "accepted_values", f"(av{i} = 0)", f"av{i}, ' invalid value(s)'"))
    parts = []
    if structs:
        parts.append(df.selectExpr(*aggs).selectExpr(f"inline(array({', '.join(structs)}))"))
    if tests.unique:
        structs = [
            result(c, "unique", f"(values{i} = 0)", f"values{i}, ' duplicate(s)'") for i, c in enumerate(tests.unique)
        ]
        parts.append(duplicate_rows(df, tests.unique).selectExpr(f"inline(array({', '.join(structs)}))"))
    return reduce(DataFrame.unionByName, parts)


def schema_tests(models: Mapping[str, DataFrame], catalogue: Mapping[str, ModelTests]) -> DataFrame:
    return reduce(DataFrame.unionByName, [model_tests(models[m], m, t) for m, t in catalogue.items()])


@dataclass(frozen=True)
class SqlTest:
    """A query over the model views that must return no row."""

    name: str
    description: str
    sql: str


def sql_test(spark: SparkSession, test: SqlTest) -> DataFrame:
    failing = F.col("failing")
    passed = failing == 0
    return (
        spark.sql(test.sql)
        .agg(F.count(F.lit(1)).alias("failing"))
        .select(
            F.lit("custom").alias("model"),
            F.lit(DASH).alias("column"),
            F.lit(test.name).alias("test"),
            passed.alias("passed"),
            F.when(
                ~passed, F.concat(failing.cast("string"), F.lit(f" failing row(s): {test.description}"))
            ).alias("detail"),
        )
    )


def sql_tests(spark: SparkSession, tests: Sequence[SqlTest]) -> DataFrame:
    return reduce(DataFrame.unionByName, [sql_test(spark, t) for t in tests])


def failing_rows(spark: SparkSession, test: SqlTest, limit: int | None = None) -> DataFrame:
    """The rows that break a query test, optionally only a sample for display."""
    rows = spark.sql(test.sql)
    return rows if limit is None else rows.limit(limit)


def value_between(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    """Non-null values of ``column`` outside ``[low, high]``; a passing test returns no row."""
    c = F.col(quoted(column))
    return df.filter((c < low) | (c > high)).select(c)


def duplicate_keys(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Non-null key combinations that occur more than once, with their number of rows."""
    keyed = reduce(lambda d, c: d.filter(F.col(quoted(c)).isNotNull()), columns, df)
    return keyed.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def tests_report(results: DataFrame) -> DataFrame:
    """Totals over model-test rows."""
    return results.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("passed").alias("passed"),
        F.count_if(~F.col("passed")).alias("failed"),
    ).withColumn("success", F.col("failed") == 0)
