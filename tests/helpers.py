"""Small inputs for the tests."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

HISTORY = "source string, table_name string, profiled_at timestamp, metric string, value double"
FINDINGS = (
    "source string, table_name string, profiled_at timestamp, detector string, metric string, severity string, "
    "direction string, today double, expected double, z_score double, lower_fence double, upper_fence double, "
    "iqr_distance double, anomaly_score double, top_contributors array<struct<metric:string,z_score:double>>"
)
START = dt.datetime(2026, 3, 1, 10)


def local(spark, rows, ddl):
    """A small table that needs no Python worker to be read."""
    schema = T._parse_datatype_string(ddl)
    arrow = to_arrow_schema(schema, timestamp_utc=True)
    columns = list(zip(*rows)) if rows else [[] for _ in schema.names]
    arrays = []
    for values, field in zip(columns, arrow):
        if "top_contributors" == field.name:
            values = [None if v is None else [{"metric": m, "z_score": z} for m, z in v] for v in values]
        arrays.append(pa.array(values, type=field.type))
    return spark.createDataFrame(pa.table(arrays, schema=arrow), schema)


def history(spark, series: dict[str, list], source="shop", table="orders"):
    """Metric history of one table: a list of daily values per metric, None for a gap."""
    rows = [
        (source, table, START + dt.timedelta(days=i), metric, float(v))
        for metric, values in series.items()
        for i, v in enumerate(values)
        if v is not None
    ]
    return local(spark, rows, HISTORY)


def clean_days(n=30, seed=42):
    """Quiet days of an orders table: rows 2000±30, mean 1000±50, std 400±20, null 2±0.5 %."""
    r = np.random.RandomState(seed)
    spread = {"row_count": (2000, 30), "mean.total": (1000, 50), "std.total": (400, 20), "null_pct.total": (2.0, 0.5)}
    days = {m: [] for m in spread}
    for _ in range(n):
        for m, (middle, width) in spread.items():
            step = r.randint(-width, width) if m == "row_count" else r.uniform(-width, width)
            days[m].append(round(middle + step, 2))
    return {**days, "null_pct.status": [0.0] * n, "distinct_count.status": [4.0] * n}


def with_today(**today):
    """Quiet history plus one day; metrics not named stay at a usual value."""
    usual = {"row_count": 2000, "null_pct.total": 2.0, "mean.total": 1000, "std.total": 400,
             "null_pct.status": 0, "distinct_count.status": 4}
    usual.update({k.replace("__", "."): v for k, v in today.items()})
    return {m: [*values, usual[m]] for m, values in clean_days().items()}


def finding(**kw):
    base = dict(
        source="shop", table_name="orders", profiled_at=START, detector="zscore", metric="row_count",
        severity="CRITICAL", direction="LOW", today=None, expected=None, z_score=None, lower_fence=None,
        upper_fence=None, iqr_distance=None, anomaly_score=None, top_contributors=None,
    )
    base.update(kw)
    return tuple(base.values())


def findings(spark, *rows):
    return local(spark, [finding(**r) for r in rows], FINDINGS)


def by(df, *keys):
    """Rows as a dict on ``keys``."""
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r for r in df.collect()}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df) -> str:
    df.collect()
    return plan(df)
