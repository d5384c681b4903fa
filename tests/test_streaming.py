from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators.rules import between, evaluate, matches, not_null, row_count_between, unique
from plumbline.operators.snapshots import decode_history
from plumbline.sources.store import Store
from plumbline.streaming.incremental import incremental_monitor
from plumbline.streaming.profile import window_distinct, window_profile
from plumbline.streaming.quarantine import quarantine
from plumbline.streaming.suite import record_batch, suite_results, suite_stream
from plumbline.streaming.suppression import ROCKS_DB, suppress_approx, suppress_in_time_order, suppress_stream, suppress_to_log
from tests.helpers import START

ALERTS = "alert_key string, channel string, sent_at timestamp, severity string, summary string"


def write_batches(spark, path, schema, batches):
    """One file per batch; the file source takes them oldest first."""
    import os
    import time

    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))
        for name in os.listdir(path):
            full = os.path.join(path, name)
            if name.endswith(".parquet") and os.path.getmtime(full) > 1_000_000_000 + len(batches):
                os.utime(full, (1_000_000_000 + i, 1_000_000_000 + i))
        time.sleep(0)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def drain(df, tmp_path, mode="append"):
    q = (
        df.writeStream.format("parquet").outputMode(mode).option("path", f"{tmp_path}/out")
        .option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{tmp_path}/out")


def alert(key, minute):
    return (key, "slack", START + dt.timedelta(minutes=minute), "HIGH", f"{key}{minute}")


BATCHES = [[alert("a", 0), alert("a", 30), alert("b", 10)], [alert("a", 59), alert("a", 60), alert("b", 69)], [alert("b", 70), alert("a", 119)]]
KEPT = {"a0", "b10", "a60", "b70"}


def test_state_lasts_over_triggers(spark, tmp_path):
    stream = write_batches(spark, tmp_path / "in", ALERTS, BATCHES)
    assert {r["summary"] for r in drain(suppress_stream(stream), tmp_path).collect()} == KEPT


def test_log_as_state(spark, tmp_path):
    stream = write_batches(spark, tmp_path / "in", ALERTS, BATCHES)
    store = Store(spark, f"{tmp_path}/store")
    suppress_to_log(stream, store, f"{tmp_path}/cp").awaitTermination()
    assert {r["summary"] for r in store.alerts().collect()} == KEPT
    # a second start finds nothing new
    suppress_to_log(stream, store, f"{tmp_path}/cp").awaitTermination()
    assert store.alerts().count() == len(KEPT)


def test_approximate_suppression_keeps_the_first(spark, tmp_path):
    stream = write_batches(spark, tmp_path / "in", ALERTS, [[alert("a", 0), alert("b", 1)], [alert("a", 5)]])
    assert {r["summary"] for r in drain(suppress_approx(stream), tmp_path).collect()} == {"a0", "b1"}


def test_windows_close_with_the_watermark(spark, tmp_path):
    schema = "ts timestamp_ntz, v double"
    at = lambda h: START.replace(hour=0) + dt.timedelta(hours=h)
    batches = [[(at(1), 1.0), (at(2), 3.0), (at(3), None)], [(at(25), 5.0)], [(at(60), 7.0)], [(at(2), 99.0)]]
    stream = write_batches(spark, tmp_path / "in", schema, batches)
    df = window_profile(stream, "ts", "1 day", "1 hour", nulls_of=["v"], stats_of=["v"], distinct_of=["v"])
    got = {r["profiled_at"].day: r for r in drain(df, tmp_path).collect()}
    assert set(got) == {1, 2}  # the third day is still open, the late row is too late
    assert (got[1]["row_count"], got[1]["mean_v"], got[1]["std_v"], got[1]["distinct_count_v"]) == (3, 2.0, 1.4142, 2)
    assert got[1]["null_pct_v"] == pytest.approx(33.33)


def test_quarantine_loses_no_row(spark, tmp_path):
    stream = write_batches(spark, tmp_path / "in", "id int, v int", [[(1, 1), (2, None)], [(3, 99), (4, 5)]])
    for q in quarantine(stream, [not_null("v"), between("v", 0, 10)], f"{tmp_path}/g", f"{tmp_path}/b", f"{tmp_path}/cp"):
        q.awaitTermination()
    good = {r["id"] for r in spark.read.parquet(f"{tmp_path}/g").collect()}
    bad = {r["id"]: r["broken"] for r in spark.read.parquet(f"{tmp_path}/b").collect()}
    assert good == {1, 4} and bad == {2: ["not_null(v)"], 3: ["between(v)"]}


SUITE = [row_count_between(1, 5), unique("id"), not_null("v"), between("v", 0, 10, mostly=0.6), matches("s", "^[a-z]+$"), unique("s")]
SUITE_BATCHES = [[(1, 1, "a"), (2, None, "b"), (2, 3, None)], [(3, 99, "A"), (1, 5, "c")], [(None, None, None)]]


def judged(df, *keys):
    return sorted(map(str, df.select(*keys, "column", "rule", "passed", "observed", "detail").collect()))


def test_suite_over_batches_equals_the_suite_of_the_table(spark, tmp_path):
    """A value that comes again in a later batch is repeated; a batch that comes again counts once."""
    schema, base = "id int, v int, s string", f"{tmp_path}/suite"
    stream = write_batches(spark, tmp_path / "in", schema, SUITE_BATCHES)
    suite_stream(stream, SUITE, base, f"{tmp_path}/cp").awaitTermination()
    record_batch(spark.createDataFrame(SUITE_BATCHES[1], schema), 1, SUITE, base)
    whole = spark.createDataFrame(sum(SUITE_BATCHES, []), schema)
    assert judged(suite_results(spark, base, "x", "t", SUITE)) == judged(evaluate(whole, "x", "t", SUITE))
    each = suite_results(spark, base, "x", "t", SUITE, by_batch=True)
    for i, rows in enumerate(SUITE_BATCHES):
        expected = judged(evaluate(spark.createDataFrame(rows, schema), "x", "t", SUITE))
        # a batch without a value in a unique column has no frequencies and so no row for the unique rules
        got = judged(each.where(f"batch = {i}"))
        assert got == expected if i < 2 else set(got) <= set(expected) and len(got) == 4
    broken = {(r["id"], tuple(r["broken"])) for r in spark.read.parquet(f"{base}/rows").where("size(broken) > 0").collect()}
    assert broken == {(2, ("not_null(v)",)), (3, ("between(v)", "matches(s)")), (None, ("not_null(v)",))}


def test_suite_of_an_empty_stream_and_an_empty_batch(spark, tmp_path):
    empty = spark.createDataFrame([], "id int, v int, s string")
    expected = judged(evaluate(empty, "x", "t", SUITE))
    assert judged(suite_results(spark, f"{tmp_path}/none", "x", "t", SUITE)) == expected
    record_batch(empty, 0, SUITE, f"{tmp_path}/one")
    assert judged(suite_results(spark, f"{tmp_path}/one", "x", "t", SUITE)) == expected


def test_incremental_monitor_adds_one_snapshot_per_batch(spark, tmp_path):
    batches = [[(d, float(i)) for i in range(5 + d)] for d in range(3)]
    stream = write_batches(spark, tmp_path / "in", "day int, v double", batches)
    store = Store(spark, f"{tmp_path}/store")
    at = F.timestamp_seconds(F.max("day") * 86_400)
    query = incremental_monitor(
        stream, store, "s", "t", f"{tmp_path}/out", f"{tmp_path}/cp", batch_time=at, with_forest=False
    )
    query.awaitTermination()
    counts = decode_history(store.snapshots()).filter("metric = 'row_count'").orderBy("profiled_at")
    assert [r["value"] for r in counts.collect()] == [5.0, 6.0, 7.0]


def test_exact_distinct_values_of_closed_windows(spark, tmp_path):
    """Over several triggers, with values that come again, nulls, and a row that is too late."""
    at = lambda h: START.replace(hour=0) + dt.timedelta(hours=h)
    batches = [[(at(1), 1, "a"), (at(2), 1, "a"), (at(3), 2, "b")], [(at(4), 2, "a"), (at(5), None, "a"), (at(30), 9, "a")], [(at(80), 7, "a")], [(at(2), 99, "a")]]
    stream = write_batches(spark, tmp_path / "in", "ts timestamp_ntz, v int, k string", batches)
    df = window_distinct(stream, "ts", "1 day", "1 hour", "v", keys=["k"])
    got = {(r["profiled_at"].day, r["k"]): r["distinct_count_v"] for r in drain(df, tmp_path).collect()}
    assert got == {(1, "a"): 2, (1, "b"): 1, (2, "a"): 1}


def test_stream_suppression_forgets_keys_and_stays_right(spark, tmp_path):
    """Many triggers over hours: a key that has been forgotten starts anew, one inside its window does not."""
    hours = [0, 0.5, 1.0, 1.2, 5, 5.5, 30, 30.2, 31]
    stream = write_batches(spark, tmp_path / "in", ALERTS, [[alert("a", int(h * 60))] for h in hours])
    sent = sorted(int(r["summary"][1:]) for r in drain(suppress_stream(stream), tmp_path).collect())
    assert sent == [0, 60, 300, 1800, 1860]


def test_stream_suppression_calls_python_for_groups_of_keys(spark, tmp_path):
    """Many keys share a few states, over triggers, with null keys and equal times, and are judged as each alone."""
    r = random.Random(3)
    at = lambda m: START + dt.timedelta(minutes=m)
    names = [None, *(f"k{i}" for i in range(150))]
    batches = [[(r.choice(names), r.choice([None, "c"]), at(60 * b + r.randrange(60)), r.choice(["HIGH", None]), r.choice("xyz")) for _ in range(900)] for b in range(3)]
    stream = suppress_stream(write_batches(spark, tmp_path / "in", ALERTS, batches), minutes=45, delay="2 hours", buckets=8)
    assert sorted(map(repr, map(tuple, drain(stream, tmp_path).collect()))) == sorted(map(repr, judged_alone(batches, 45)))
    # the rows of state are those of the groups, not of the keys
    query = (
        stream.writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/cp2").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert 0 < query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 8


def judged_alone(batches, minutes):
    """Brute force: batch by batch, each in the order of time, severity and summary."""
    last = {}
    for rows in batches:
        for row in sorted(rows, key=lambda a: (a[2], str(a[3]), a[4])):
            if row[:2] not in last or row[2] >= last[row[:2]] + dt.timedelta(minutes=minutes):
                last[row[:2]] = row[2]
                yield row


@pytest.fixture
def rocks_db(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, ROCKS_DB)
    yield
    spark.conf.unset(name)


def test_suppression_in_time_order(spark, tmp_path, rocks_db):
    """Alerts that arrive after later ones are decided before them; one behind the watermark is left out; null keys are keys."""
    null = (None, None, START + dt.timedelta(minutes=5), None, None)
    batches = [
        [alert("a", 70), alert("a", 30), alert("b", 69), null],
        [alert("a", 0), alert("a", 59), alert("b", 10), (*null[:2], START + dt.timedelta(minutes=50), "LOW", "n50")],
        [alert("a", 500), alert("b", 400)],
        [alert("a", 530)],
        [alert("a", 20), alert("c", 21)],
        [alert("end", 2000)],
    ]
    stream = write_batches(spark, tmp_path / "in", ALERTS, batches)
    sent = drain(suppress_in_time_order(stream, minutes=60, delay="2 hours", buckets=2), tmp_path).collect()
    # a20 and c21 come two triggers after one that put the watermark at 380 minutes
    assert sorted(str(r["summary"]) for r in sent) == ["None", "a0", "a500", "a70", "b10", "b400"]
    assert all(r["alert_key"] is None for r in sent if r["summary"] is None)
