"""Keyed stream state, timers, observed writes and snapshot tables."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.session import scratch
from tidemark.sources import sinks
from tidemark.sources.snapshots import Conflict, SnapshotTable
from tidemark.streaming import state, streams

T0 = datetime(2024, 1, 1)
NTZ = "timestamp_ntz"


def put(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


# --- runs of days -----------------------------------------------------------------------------------------------------

def plain_run(days):
    last = max(days)
    n = 1
    while last - n in days:
        n += 1
    return n


@pytest.mark.parametrize("late", [0, 1, 5, 31, 61])
def test_day_runs_equal_those_of_all_days(late):
    rng = random.Random(late)
    for _ in range(200):
        run, seen, newest = state.DayRun(late), set(), 0
        for _ in range(rng.randint(1, 120)):
            day = newest + rng.choice([1, 1, 1, 1, 0, -rng.randint(0, late), 2, rng.randint(0, 100)])
            newest = max(newest, day)
            run.add(day)
            seen.add(day)
            assert (run.newest, run.length) == (max(seen), plain_run(seen))


def test_a_day_that_is_too_old_changes_nothing():
    run = state.DayRun(3)
    for day in (1, 10, 2):
        run.add(day)
    assert (run.newest, run.length) == (10, 1)


def test_streak_over_batches_and_a_restart(spark, tmp_path):
    schema, path, out = f"k string, t {NTZ}", scratch(spark, "test"), {}
    day = lambda k, d: (k, T0 + timedelta(days=d, hours=d % 7))

    def each(batch, batch_id):
        out.update({r["k"]: (r["last_day"], r["days"]) for r in batch.collect()})
    stream = put(spark, tmp_path, [day("a", d) for d in range(1000)] + [day("b", 0), day("b", 2), ("a", None), day(None, 5)], schema)
    streams.start(state.streak(stream, "t", "k"), path, each, mode="update", timed=True).awaitTermination()
    assert out["a"] == ((T0 + timedelta(days=999)).date(), 1000) and out["b"] == (date(2024, 1, 3), 1) and out[None][1] == 1
    for rows in ([day("b", 1), day("b", 1), day("a", 1001)], [day("a", 1000), day("a", 1002)]):  # late and repeated days, new query
        stream = put(spark, tmp_path, rows, schema)
        streams.start(state.streak(stream, "t", "k"), path, each, mode="update", timed=True).awaitTermination()
    assert out["b"] == (date(2024, 1, 3), 3) and out["a"] == ((T0 + timedelta(days=1002)).date(), 1003)
    with state.rocksdb(spark):
        held = spark.read.format("statestore").option("stateVarName", "run").load(f"{path}/_checkpoint")
        assert held.count() == 3  # one row of three numbers for each key, however many days it has seen


# --- absence ----------------------------------------------------------------------------------------------------------

def test_days_without_all_rows_become_one_issue_each(spark, tmp_path):
    schema, path = f"k string, ts {NTZ}, at {NTZ}", scratch(spark, "test")
    hour = lambda k, h, at=None: (k, T0 + timedelta(hours=h), T0 + timedelta(hours=h if at is None else at))
    roster = spark.createDataFrame([(k, T0) for k in ("whole", "short", "silent")], f"k string, first_day {NTZ}")

    def run(rows):
        stream = put(spark, tmp_path, rows, schema)
        streams.start(state.incomplete_grids(stream, roster, 24, arrived="at", key="k"), path, timed=True).awaitTermination()
        return sorted((r["k"], r["day"].day, r["points"]) for r in spark.read.parquet(f"{path}/data").collect())
    # Before 00:45 nothing is judged.
    assert run([hour("whole", h) for h in range(24)] * 2 + [hour("short", h) for h in range(0, 22)] + [("short", None, T0), hour("whole", 24.7)]) == []
    found = run([hour("short", 5, 24.72), hour("short", 22, 24.74), hour("whole", 24.75)])  # a restart; a row hours late; 00:45 is reached
    assert found == [("short", 1, 23), ("silent", 1, 0)]
    late = run([hour("short", 23, 48), *[hour("whole", h, 48) for h in range(25, 48)], *[hour("new", h, 48) for h in range(30, 40)], hour("whole", 49)])
    assert late == sorted([*found, ("new", 2, 10), ("short", 2, 0), ("silent", 2, 0)])  # the row of a closed day changes nothing
    assert run([hour("whole", 49.5)]) == late
    assert {r["code"] for r in spark.read.parquet(f"{path}/data").collect()} == {"DERIVATIVE_CUTOFF_INCOMPLETE"}


def test_the_clock_may_be_the_rows_own_time(spark, tmp_path):
    rows = [("a", T0 + timedelta(hours=h)) for h in range(24)] + [("b", T0), ("a", T0 + timedelta(days=3, minutes=45))]
    stream = put(spark, tmp_path, rows, f"k string, ts {NTZ}")
    roster, path = spark.createDataFrame([("c", T0 + timedelta(days=1))], f"k string, first_day {NTZ}"), scratch(spark, "test")
    streams.start(state.incomplete_grids(stream, roster, 24, key="k"), path, timed=True).awaitTermination()
    found = sorted((r["k"], r["day"].day, r["points"]) for r in spark.read.parquet(f"{path}/data").collect())
    assert found == [("a", 2, 0), ("a", 3, 0), ("b", 1, 1), ("b", 2, 0), ("b", 3, 0), ("c", 2, 0), ("c", 3, 0)]


# --- observed writes --------------------------------------------------------------------------------------------------

def test_counts_are_observed_by_the_write(spark, tmp_path, monkeypatch):
    spark.range(1000).withColumn("v", F.col("id") % 10).write.parquet(f"{tmp_path}/in")
    df, out = spark.read.parquet(f"{tmp_path}/in"), f"{tmp_path}/out"
    plans = []

    def write(rows):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        rows.write.parquet(f"{out}/rows")
    assert sinks.observed(df, F.col("v") > 6, write) == (1000, 300)
    assert len(plans) == 1 and plans[0].count("FileScan") == 1 and "CollectMetrics" in plans[0]
    assert spark.read.parquet(f"{out}/rows").count() == 300
    row = sinks.audited_write(df, out, F.col("v") > 6, "7", "feed", "ticks", F.current_timestamp()).first()
    assert (row["run_id"], row["status"], row["records_read"], row["records_written"]) == ("7", "succeeded", 1000, 300)
    empty = sinks.audited_write(df.limit(0), out, F.col("v") > 6, "8", "feed", "ticks", F.current_timestamp()).first()
    assert (empty["status"], empty["records_read"]) == ("deferred", 0)
    bad = F.when(F.col("v") == 3, F.raise_error(F.lit("broken")).cast("boolean")).otherwise(True)
    with pytest.raises(Exception):
        sinks.audited_write(df, out, bad, "9", "feed", "ticks", F.current_timestamp())
    failed = spark.read.parquet(f"{out}/runs").where("run_id = 9").first()
    assert failed["status"] == "failed" and "broken" in failed["error"]


# --- snapshot tables --------------------------------------------------------------------------------------------------

BAR = f"asset_id string, open_time {NTZ}, close double, is_final boolean, seq long"


def bars(spark, rows):
    return spark.createDataFrame([(k, T0 + timedelta(days=d), c, f, s) for k, d, c, f, s in rows], BAR)


def table_of(spark, path, buckets=16):
    return SnapshotTable(spark, str(path), ["asset_id", "open_time"], ["asset_id", "date_trunc('month', open_time)"], buckets)


def contents(df):
    return sorted((r["asset_id"] or "", r["open_time"], r["close"], r["is_final"]) for r in df.collect())


def test_an_upsert_touches_only_its_buckets(spark, tmp_path):
    table = table_of(spark, tmp_path / "t")
    with pytest.raises(ValueError):
        table.read()
    first = table.upsert(bars(spark, [(f"K{k}", d, 1.0, False, 0) for k in range(12) for d in range(60)]), "seq", ["is_final"])
    before = table.read()
    held = contents(before)
    second = table.upsert(bars(spark, [("K3", 5, 2.0, True, 1), ("K3", 5, 3.0, False, 2), ("K3", 7, 4.0, False, 1)]), "seq", ["is_final"])
    changed = {b for b in second.folders if second.folders[b] != first.folders.get(b)}
    assert len(changed) == 1 and len(second.folders) > 5 and second.version == 2
    own = {f.split("bucket=")[1].split("/")[0] for f in spark.read.parquet(f"{tmp_path}/t/{second.folders[min(changed)]}").inputFiles()}
    assert own == changed
    assert contents(before) == held == contents(table.read(1))  # the frame read before keeps its state
    now = {(r["asset_id"], r["open_time"]): r for r in table.read().collect()}
    assert len(now) == 720 and now["K3", T0 + timedelta(days=5)]["close"] == 2.0 and now["K3", T0 + timedelta(days=7)]["close"] == 4.0
    table.upsert(bars(spark, [("K3", 5, 9.0, False, 9)]), "seq", ["is_final"])
    assert {(r["asset_id"], r["open_time"]): r for r in table.read().collect()}["K3", T0 + timedelta(days=5)]["close"] == 2.0  # final stays


def test_repeats_conflicts_nulls_and_vacuum(spark, tmp_path, monkeypatch):
    table = table_of(spark, tmp_path / "t")
    table.upsert(bars(spark, [(None, 0, 1.0, False, 0), (None, 0, 2.0, False, 1), ("A", 0, 1.0, False, 0)]), "seq", batch=("r", 0))
    assert contents(table.read()) == [("", T0, 2.0, False), ("A", T0, 1.0, False)]
    same = table.upsert(bars(spark, [("A", 0, 7.0, False, 0)]), "seq", batch=("r", 0))  # a replay
    assert same.version == 1 and contents(table.read())[1][2] == 1.0
    table.upsert(bars(spark, [("A", 0, 7.0, False, 0)]), "seq", batch=("r", 1))
    assert table.upsert(bars(spark, []), "seq").version == 3 and contents(table.read())[1][2] == 7.0
    other, stale = table_of(spark, tmp_path / "t"), table.manifest(2)
    monkeypatch.setattr(SnapshotTable, "manifest", lambda self, version=None: stale)
    with pytest.raises(Conflict):
        other.upsert(bars(spark, [("A", 0, 8.0, False, 0)]), "seq")
    monkeypatch.undo()
    assert contents(table.read())[1][2] == 7.0
    table.vacuum(1)
    assert table._versions() == [3] and contents(table.read()) == [("", T0, 2.0, False), ("A", T0, 7.0, False)]
    assert {f.name for f in (tmp_path / "t" / "data").iterdir()} == {f.split("/")[1] for f in table.manifest().folders.values()}
    table.vacuum(1)
    with pytest.raises(ValueError):
        table.vacuum(0)


def test_a_stream_fills_a_snapshot_table(spark, tmp_path):
    path, table = scratch(spark, "test"), table_of(spark, tmp_path / "t")
    for k in range(3):
        folder = tmp_path / "s"
        spark_rows = [("A", T0, float(k), k == 1, k), (f"B{k}", T0, 1.0, False, k)]
        stream = put(spark, folder, spark_rows, BAR)
        streams.snapshot_sink(stream, path, table, "seq").awaitTermination()
    assert contents(table.read()) == [("A", T0, 1.0, True), ("B0", T0, 1.0, False), ("B1", T0, 1.0, False), ("B2", T0, 1.0, False)]
    assert table.manifest().version == 3 and list(table.manifest().applied.values()) == [2]
