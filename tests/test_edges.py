"""Cases beyond the well-behaved: long frames, missing keys, infinities, close values, lost checkpoints."""

import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import bars as B
from tidemark.operators import gates as G
from tidemark.operators import quality as Q
from tidemark.operators import technical as ta
from tidemark.operators.asof import join_asof
from tidemark.operators.blocks import index_rows
from tidemark.operators.quantiles import higher, linear, order_statistics
from tidemark.streaming import streams


def series(spark, n):
    rows = spark.range(n).select(
        F.lit("A").alias("asset_id"), (F.timestamp_seconds(F.col("id") * 86400)).alias("open_time"),
        (100 + F.sin(F.col("id") / 9) * 20 + F.col("id") % 7).alias("close"))
    return rows.withColumns({"open": F.col("close"), "high": F.col("close") + 1, "low": F.col("close") - 1, "volume": F.lit(1.0)})


def test_more_rows_than_any_endpoint_shows(spark):
    assert B.tail_rows(series(spark, 2600), 2500).count() == 2500
    with pytest.raises(ValueError):
        B.last_n(series(spark, 3), 0)


def test_frames_longer_than_a_block(spark):
    rows = {r["t"]: r for r in ta.add_features(series(spark, 2600), lambda s: {"long": s.ma_ratio(1000), "m": s.macd("full", 8, 21)})
            .select(F.unix_seconds("open_time").alias("t"), "close", "long", "m").collect()}
    close = [rows[k * 86400]["close"] for k in range(2600)]
    for k in (0, 998, 999, 1023, 1024, 1500, 2047, 2048, 2599):
        r = rows[k * 86400]
        assert (r["long"] is None) == (k < 999)
        if k >= 999:
            assert r["long"] == pytest.approx(close[k] / statistics.fmean(close[k - 999:k + 1]) - 1, abs=1e-9)
        ema = []
        for p in (8, 21):
            a, value = 2 / (p + 1), close[0]
            for x in close[1:k + 1]:
                value = a * x + (1 - a) * value
            ema.append(value)
        assert r["m"] == pytest.approx((ema[0] - ema[1]) / close[k], abs=1e-9)


def test_an_overflowing_average_is_refused(spark):
    with pytest.raises(ValueError):
        ta.add_features(series(spark, 10), lambda s: {"m": s.macd("full", 2, 5)})


def test_missing_keys_keep_their_rows(spark):
    left = spark.createDataFrame([(None, 5, 1), ("a", 5, 2), (None, None, 3), ("b", 5, 4)], "k string, s long, i int").withColumn("t", F.timestamp_seconds("s"))
    right = spark.createDataFrame([(None, 3, 30.0), ("a", 4, 40.0), ("a", 9, 90.0)], "k string, s long, v double").withColumn("u", F.timestamp_seconds("s")).drop("s")
    rows = {r["i"]: r["v"] for r in join_asof(left, right, "t", "u", ["k"], ["v"]).collect()}
    assert rows == {1: 30.0, 2: 40.0, 3: None, 4: None}
    index = {r["i"]: r["_idx"] for r in index_rows(left, ["k"], ["t", "i"]).collect()}
    assert index == {3: 0, 1: 1, 2: 0, 4: 0}


@pytest.mark.parametrize("by", [[], ["k"]])
def test_asof_equals_the_plain_form(spark, by):
    import random
    rng = random.Random(len(by))
    left = [(rng.choice("ab"), rng.randint(0, 20_000_000), i) for i in range(300)]
    right = [(rng.choice("ab"), rng.randint(5_000_000, 20_000_000), float(i)) for i in range(60)]
    ldf = spark.createDataFrame(left, "k string, s long, i int").withColumn("t", F.timestamp_seconds("s"))
    rdf = spark.createDataFrame(right, "k string, s long, v double").withColumn("u", F.timestamp_seconds("s")).select(*by, "u", "v")
    found = {r["i"]: r["v"] for r in join_asof(ldf, rdf, "t", "u", by, ["v"], rows_per_task=20).collect()}
    for k, s, i in left:
        fits = [(rs, v) for rk, rs, v in right if rs <= s and (not by or rk == k)]
        assert found[i] == (max(fits)[1] if fits else None)


def test_order_statistics_of_infinities_and_close_values(spark):
    values = [float("-inf"), 1.0, 2.0, float("inf"), None, float("nan")]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    row = order_statistics(df, [], "v", {"low": linear(0.0), "mid": linear(0.5), "top": higher(1.0)}).first()
    assert (row["low"], row["mid"], row["top"]) == (float("-inf"), 1.5, float("inf"))
    close = spark.range(20_000).select((100 + F.col("id") * 1.5e-5).alias("v"))
    assert order_statistics(close, [], "v", {"q": linear(0.3)}).first()["q"] == pytest.approx(100 + 0.3 * 19_999 * 1.5e-5, abs=1e-9)
    micros = spark.range(20_000).select((1.7e15 + F.col("id") * 1000).alias("v"), F.lit(None).cast("string").alias("g"))
    assert order_statistics(micros, ["g"], "v", {"q": higher(0.5)}).first()["q"] == 1.7e15 + 10_000 * 1000


def test_only_a_small_share_of_a_group_is_ordered(spark):
    """A million values within 1e-9 beside one outlier, and a group of few: exact, few rows in the window, six exchanges at most."""
    close = spark.range(1_000_000).select((1.0 + F.pmod(F.col("id") * 7919, F.lit(1_000_000)) * 1e-15).alias("v"), F.lit("hot").alias("g"))
    rows = close.unionByName(spark.createDataFrame([(1e6, "hot"), (3.0, "few"), (1.0, "few"), (2.0, None)], "v double, g string"))
    specs = {"a": linear(0.1), "m": linear(0.5), "z": higher(1.0)}
    out = order_statistics(rows, ["g"], "v", specs, count_name="n")
    found = {r["g"]: r for r in out.collect()}
    exact = np.sort(np.append(1.0 + np.arange(1_000_000) * 1e-15, 1e6))
    assert found["hot"]["n"] == 1_000_001 and found["hot"]["z"] == 1e6
    assert found["hot"]["m"] == exact[500_000] and found["hot"]["a"] == pytest.approx(np.quantile(exact, 0.1), abs=1e-16)
    assert (found["few"]["a"], found["few"]["m"], found[None]["m"]) == (1.2, 2.0, 2.0)
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning") <= 6


def test_an_asset_without_snapshots_is_not_ready(spark):
    snaps = spark.createDataFrame([("a", "2024-01-02", True)], "asset_id string, d string, is_complete boolean")
    snaps = snaps.withColumn("snapshot_time", F.to_timestamp_ntz("d")).withColumns({"available_at": F.col("snapshot_time"), "source_max_event_time": F.col("snapshot_time") - F.expr("INTERVAL 1 MINUTE")})
    assets = spark.createDataFrame([("a",), ("b",)], "asset_id string")
    cut, now = F.lit("2024-01-02").cast("timestamp_ntz"), F.lit("2024-01-03").cast("timestamp_ntz")
    rows = {r["asset_id"]: (r["days"], r["ready"], r["reason"]) for r in G.readiness_history(snaps, cut, now, 1, assets).collect()}
    assert rows == {"a": (1, True, ""), "b": (0, False, "0/1")}
    daily = snaps.select("asset_id", F.col("snapshot_time").alias("open_time"))
    spot = {r["asset_id"]: r["ready"] for r in G.readiness_spot(daily, cut, "a", 1, assets=assets).collect()}
    assert spot == {"a": True, "b": False}


def test_batch_check_counts_time_regressions(spark):
    rows = [("f", i, t, 1.0, 2.0, 0.5, 1.0, 1.0, 1.0, 1) for i, t in enumerate((1, 3, 2, 2, 4))]
    df = spark.createDataFrame(rows, "file string, seq int, open_time int, open double, high double, low double, close double, volume double, quote_volume double, trade_count int")
    row = Q.quality_batch(df, ["file"], ["open_time"], "seq").first()
    assert (row["rows"], row["duplicates"], row["regressions"]) == (5, 1, 1)


def test_normal_distribution_function(spark):
    from tidemark.functions.maths import normal_cdf
    xs = [k / 50 for k in range(-500, 501)]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", normal_cdf(F.col("x")).alias("p")).collect()
    assert max(abs(r["p"] - 0.5 * (1 + math.erf(r["x"] / math.sqrt(2)))) for r in rows) < 1e-15


# --- streams ------------------------------------------------------------------------------------------------------


def feed(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_a_lost_checkpoint_neither_adds_nor_replaces(spark, tmp_path):
    import shutil
    source, path, schema = f"{tmp_path}/in", f"{tmp_path}/out", "k string, day date, v int"
    import datetime
    day = datetime.date(2024, 1, 1)
    feed(spark, source, [("a", day, 1)], schema)
    stream = feed(spark, source, [("b", day, 1)], schema)
    streams.append_once(stream, path, ["k", "day"], day="day").awaitTermination()
    shutil.rmtree(f"{path}/_checkpoint")
    stream = feed(spark, source, [("c", day, 2)], schema)
    streams.append_once(stream, path, ["k", "day"], day="day").awaitTermination()
    assert sorted(r["k"] for r in streams.stored(spark, path, "rows").collect()) == ["a", "b", "c"]


def test_compaction_keeps_the_winners(spark, tmp_path):
    source, path, schema = f"{tmp_path}/in", f"{tmp_path}/out", "k string, v int"
    for v in range(3):
        stream = feed(spark, source, [("a", v), (f"k{v}", v)], schema)
        streams.start(stream, path, streams.keyed(path, lambda df, i, run: streams.put_batch(df, path, "latest", i, run))).awaitTermination()
    before = sorted(map(tuple, streams.latest_of(spark, path, ["k"]).collect()))
    streams.compact(spark, path, "latest", ["k"])
    assert sorted(map(tuple, streams.latest_of(spark, path, ["k"]).collect())) == before
    assert streams.stored(spark, path, "latest").count() == len(before)
    stream = feed(spark, source, [("a", 9)], schema)
    streams.start(stream, path, streams.keyed(path, lambda df, i, run: streams.put_batch(df, path, "latest", i, run))).awaitTermination()
    assert dict(map(tuple, streams.latest_of(spark, path, ["k"]).collect()))["a"] == 9


def test_a_failed_batch_is_audited(spark, tmp_path):
    source, path = f"{tmp_path}/in", f"{tmp_path}/out"
    stream = feed(spark, source, [(1,), (0,)], "v int")
    bad = F.when(F.col("v") == 0, F.raise_error(F.lit("broken")).cast("boolean")).otherwise(F.lit(True))
    with pytest.raises(Exception):
        streams.audited(stream, path, "feed", "ticks", bad).awaitTermination()
    assert [r["status"] for r in streams.stored(spark, path, "runs").collect()] == ["failed"]
    streams.audited(stream, path, "feed", "ticks", F.col("v") > 0).awaitTermination()
    rows = streams.stored(spark, path, "runs").collect()
    assert [(r["status"], r["records_read"], r["records_written"]) for r in rows] == [("succeeded", 2, 1)]
