"""Column expressions shared by the operators. All of them stay in the JVM."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The severity names, worst first.
SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM")
# Detectors in the order in which ties between them are settled.
DETECTORS = ("zscore", "iqr", "isolation_forest")
# Fixed value: the mark shown where a finding has no such number.
DASH = "—"


def quoted(name: str) -> str:
    """Column name safe to resolve even when it holds dots."""
    return "`" + name.replace("`", "``") + "`"


def text_literal(value: str) -> str:
    """SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def literal(value) -> str:
    """SQL literal of a Python value; floats become DOUBLE, None is NULL."""
    if value is None:
        return "NULL"
    if isinstance(value, str):
        return text_literal(value)
    if isinstance(value, dt.datetime):
        return f"TIMESTAMP {text_literal(value.isoformat(' '))}"
    if isinstance(value, dt.date):
        return f"DATE {text_literal(value.isoformat())}"
    if isinstance(value, Decimal):
        return f"{value:f}BD"
    return f"{value!r}D" if isinstance(value, float) else str(value)


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.NumericType, T.BooleanType))


def is_text(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StringType, T.VarcharType, T.CharType))


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing means NULL here: NaN in floating columns becomes NULL."""
    floating = [
        f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))
    ]
    if not floating:
        return df
    return df.selectExpr(
        *[
            f"CASE WHEN NOT isnan({quoted(c)}) THEN {quoted(c)} END AS {quoted(c)}" if c in floating else quoted(c)
            for c in df.columns
        ]
    )


def settle(col: Column, digits: int) -> Column:
    """Round half up after snapping to nine decimals.

    Sums of doubles depend in their last bits on the order of the partial sums; snapping first
    keeps a value that lies on a rounding tie from flipping between runs.
    """
    return F.round(F.round(col.cast("double"), 9), digits)


def percent(part: Column, whole: Column, digits: int) -> Column:
    """``100 * part / whole`` rounded; NULL when ``whole`` is zero."""
    return settle(F.try_divide(part * F.lit(100.0), whole), digits)


def half_even_int(col: Column) -> Column:
    """DOUBLE to INTEGER with ties to the even neighbour (a plain cast truncates)."""
    return F.bround(col.cast("double")).cast("int")


def plain_number(col: Column) -> Column:
    """Number as text with one to four decimals and no exponent: 9 -> 9.0, 45.25 -> 45.25."""
    return F.regexp_replace(col.cast("decimal(38,4)").cast("string"), "0{1,3}$", "")


def ladder(value: Column, steps: Sequence[tuple[float, str]], lowest: str) -> Column:
    """First label whose bound ``value`` reaches; ``steps`` run from high to low."""
    out = F.lit(lowest)
    for bound, label in reversed(steps):
        out = F.when(value >= bound, F.lit(label)).otherwise(out)
    return out


def rank_of(col: Column, names: Sequence[str]) -> Column:
    """Position of a name in ``names`` counted from 1; unknown names come last."""
    out = F.lit(len(names) + 1)
    for i, name in enumerate(names, start=1):
        out = F.when(col == name, F.lit(i)).otherwise(out)
    return out


def severity_rank(col: Column) -> Column:
    """3 for CRITICAL, 2 for HIGH, 1 for MEDIUM, 0 for anything else."""
    return F.lit(len(SEVERITIES) + 1) - rank_of(col, SEVERITIES)


def alert_key(table: Column, metric: Column, severity: Column) -> Column:
    return F.md5(F.concat_ws("|", table, metric, severity).cast("binary"))


def table_key(source: Column, table: Column) -> Column:
    return F.concat_ws(".", source, table)
