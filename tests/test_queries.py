"""Every registered query against its DuckDB form on the smallest driver tables."""

from __future__ import annotations

import re
import time

import pytest

import __spark_entry__ as entry_module
from tests.compare import compare_df, duck
from tests.helpers import final_plan, plan
from workload import merged

# the operators for training data have tests of their own
QUERIES = {n: q for m in entry_module.MODULES if m.__name__.startswith("workload.") for n, q in m.QUERIES.items()}
ORACLE = {n: q for n, q in entry_module.oracle_sql().items() if n in QUERIES}
# queries without a SQL form, with what stands in for it
ROWS_ONLY = {"iforest_events": "tests/test_detect.py", **dict.fromkeys(merged.QUERIES, "tests/test_merged.py")}


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


def test_only_known_queries_lack_sql():
    assert set(QUERIES) - set(ORACLE) == set(ROWS_ONLY) and set(ORACLE) <= set(QUERIES)


PYTHON_NODES = re.compile(r"BatchEvalPython|ArrowEvalPython|MapInPandas|FlatMap\w*In\w+|MapInArrow")
NEEDS_PYTHON = {"iforest_events", "iqr_backtest", "alert_suppression", "alert_suppression_hot"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf_dir, name):
    """Equal rows, and a plan without Python or nested-loop joins where none is needed."""
    df = QUERIES[name](spark, sf_dir)
    ok, message, *_ = compare_df(con, df, ORACLE.get(name), time.time())
    assert ok, message
    text = plan(df)
    assert name in NEEDS_PYTHON or not PYTHON_NODES.search(text)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_entry(spark):
    assert "z_score" in entry_module.entry(spark).columns


def test_scans_read_only_needed_columns(spark, sf_dir):
    text = final_plan(QUERIES["zscore_backtest"](spark, sf_dir))
    assert "props" not in text
    text = final_plan(QUERIES["duplicate_keys"](spark, sf_dir))
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int>" in text
