"""Quality, readiness, reports, archives, payloads and streams."""

import hashlib
import io
import json
import zipfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.functions.times import norm_epoch
from tidemark.operators import bars, gates, quality, relations
from tidemark.plans import reports
from tidemark.session import scratch
from tidemark.sources import archives, payloads, sinks
from tidemark.streaming import streams
from tidemark.workbench.q_market import grid_series  # noqa: F401  (import check)

T0 = datetime(2025, 1, 1)
NTZ = "timestamp_ntz"


def test_epoch_units(spark):
    r = spark.range(1).select(norm_epoch(F.lit(1735689600000)).alias("a"), norm_epoch(F.lit(1735689600000000)).alias("b")).first()
    assert r["a"] == r["b"] == T0


def test_bar_violations(spark):
    rows = [("A", 1.0, 2.0, 0.5, 1.5, 1.0, T0, T0 + timedelta(hours=1)), ("Z", -1.0, 0.5, 2.0, 1.0, -1.0, T0, T0)]
    df = spark.createDataFrame(rows, f"asset_id string, open double, high double, low double, close double, volume double, open_time {NTZ}, close_time {NTZ}").withColumns(
        {"quote_volume": F.lit(1.0), "trade_count": F.lit(1)})
    out = {r["asset_id"]: r["violations"] for r in quality.quality_bar(df, spark.createDataFrame([("A",)], "asset_id string")).collect()}
    assert out["A"] == []
    assert out["Z"] == ["unknown_symbol", "non_positive_price", "invalid_ohlc", "negative_activity", "invalid_time_range"]


def test_time_regressions(spark):
    df = spark.createDataFrame([("f", 0, 1), ("f", 1, 3), ("f", 2, 2)], "file string, seq int, open_time int")
    assert quality.time_regressions(df, "file", "seq").first()["regressions"] == 1


def history(spark, days, drop=()):
    cutoff = datetime(2026, 7, 14)
    rows = [("A", cutoff - timedelta(days=i), True, cutoff - timedelta(days=i), cutoff - timedelta(days=i, minutes=1)) for i in range(days) if i not in drop]
    df = spark.createDataFrame(rows, f"asset_id string, snapshot_time {NTZ}, is_complete boolean, available_at {NTZ}, source_max_event_time {NTZ}")
    return df, F.lit(cutoff).cast(NTZ)


@pytest.mark.parametrize("days,drop,ready,reason", [(90, (), True, ""), (90, (45,), False, "89/90"), (95, (45,), False, "gap")])
def test_readiness(spark, days, drop, ready, reason):
    df, cutoff = history(spark, days, drop)
    out = gates.readiness_history(df, cutoff, cutoff + F.expr("INTERVAL 1 DAY")).first()
    assert (out["ready"], out["reason"]) == (ready, reason)


def test_streak_ignores_duplicates_and_old_runs(spark):
    days = [0, 1, 2, 2, 5, 6, 6, 7]
    df = spark.createDataFrame([("A", T0 + timedelta(days=d)) for d in days], f"k string, t {NTZ}")
    out = bars.trailing_streak(df, "k", "t").first()
    assert out["days"] == 3 and str(out["last_day"]) == "2025-01-08"


def progress(spark, points, cls, now, total=2):
    model = spark.createDataFrame([(1, "v", cls, 30, True, False)], "model_id int, version string, asset_class string, horizon_days int, is_shadow_candidate boolean, is_production boolean")
    pred = spark.createDataFrame([(1, a, t, True) for a, t in points], f"model_id int, symbol string, analysis_time {NTZ}, is_shadow boolean")
    totals = spark.createDataFrame([(cls, total)], "asset_class string, total_assets int")
    return reports.shadow_progress(model, pred, totals, F.lit(now).cast(NTZ)).first()


def test_prediction_progress(spark):
    r = progress(spark, [], "crypto", T0)
    assert r["state"] == "waiting" and r["remaining_days"] == 30
    r = progress(spark, [(a, T0 + timedelta(days=d)) for a in "AB" for d in (0, 1)], "crypto", T0 + timedelta(days=10))
    assert (r["state"], r["elapsed_days"], r["coverage"]) == ("collecting", 10, 1.0)
    r = progress(spark, [("A", T0)], "crypto", T0 + timedelta(days=30))
    assert r["state"] == "evaluable" and r["matured"] == 1
    r = progress(spark, [("A", T0 + timedelta(days=d)) for d in range(31)], "us_equity", T0 + timedelta(days=31))
    assert r["elapsed_days"] == 30 and r["matured"] == 1


def test_many_to_one_assertion(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(Exception, match="duplicate key"):
        relations.assert_unique(df, ["k"]).collect()
    assert relations.assert_unique(df.limit(1), ["k"]).count() == 1


# --- archives ------------------------------------------------------------------------------------


def zipped(text):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("x.csv", text)
    return bytearray(buf.getvalue())


KLINE = "1735689600000,100,110,90,105,12,1735693199999,1260,42,6,630,0"


def test_kline_archive_with_lineage(spark, tmp_path):
    (tmp_path / "BTCUSDT-1h-2025-01.zip").write_bytes(zipped(KLINE + "\n"))
    files = archives.zip_files(spark, str(tmp_path))
    row = archives.read_kline_archives(files).first()
    assert (row["asset_id"], row["interval"], row["open_time"], row["close"], row["trade_count"]) == ("BTCUSDT", "1h", T0, 105.0, 42)
    digest = hashlib.sha256((tmp_path / "BTCUSDT-1h-2025-01.zip").read_bytes()).hexdigest()
    assert row["source_checksum"] == digest
    good = spark.createDataFrame([("BTCUSDT-1h-2025-01.zip", f"{digest.upper()}  name")], "file string, sha256 string")
    archives.verify_checksums(files, good)
    with pytest.raises(ValueError, match="checksum mismatch"):
        archives.verify_checksums(files, good.withColumn("sha256", F.lit("00 name")))


def opened(df):
    """How many files the last run of this frame opened."""
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return leaves.apply(0).metrics().apply("numFiles").value()


def test_a_filter_opens_only_its_archives(spark, tmp_path):
    for asset in ("BTCUSDT", "ETHUSDT"):
        for month in range(1, 7):
            (tmp_path / asset).mkdir(exist_ok=True)
            (tmp_path / asset / f"{asset}-1h-2025-{month:02d}.zip").write_bytes(zipped(KLINE.replace(",42,", f",{month},") + "\n"))
    (tmp_path / "BTCUSDT" / "notes.zip").write_bytes(b"no archive")
    files = archives.named_archives(spark, str(tmp_path))
    for where, n in (("month = '2025-03'", 2), ("month >= '2025-05' AND asset_id = 'ETHUSDT'", 2), ("interval = '1d'", 0), ("interval = '1h'", 12)):
        some = files.where(where)
        assert len(some.collect()) == n and opened(some) == n
    bars = archives.read_kline_archives(files.where("month = '2025-03'")).collect()
    assert sorted((r["asset_id"], r["trade_count"]) for r in bars) == [("BTCUSDT", 3), ("ETHUSDT", 3)]
    path, seen = scratch(spark, "test"), []

    def each(batch, batch_id):
        seen.extend(r["asset_id"] + r["month"] for r in batch.collect())
    for month in ("07", "08"):  # a restart delivers only what is new
        (tmp_path / "ETHUSDT" / f"ETHUSDT-1h-2025-{month}.zip").write_bytes(zipped(KLINE + "\n"))
        streams.start(archives.named_archives(spark, str(tmp_path), stream=True).where("interval = '1h'"), path, each).awaitTermination()
    assert len(seen) == len(set(seen)) == 14


def test_futures_files_with_and_without_header(spark):
    rows = [("/r/BTCUSDT-1h-2025-01.zip", zipped("open_time,open\n" + KLINE)), ("/r/ETHUSDT-1h-2025-01.zip", zipped(KLINE))]
    out = archives.read_futures_klines(archives.zip_lines(spark.createDataFrame(rows, "path string, content binary")), "klines").collect()
    assert sorted(r["asset_id"] for r in out) == ["BTCUSDT", "ETHUSDT"]


def test_funding_and_metrics_columns(spark):
    f = spark.createDataFrame([("/r/BTCUSDT-fundingRate-2025-01.zip", zipped("calc_time,funding_interval_hours,last_funding_rate\n1735689600000,8,0.0001\n"))], "path string, content binary")
    r = archives.read_funding(archives.zip_lines(f)).first()
    assert (r["asset_id"], r["calc_time"], r["last_funding_rate"]) == ("BTCUSDT", T0, 0.0001)
    bad = spark.createDataFrame([("/r/B-fundingRate-1.zip", zipped("calc_time,x\n1,2\n"))], "path string, content binary")
    with pytest.raises(Exception, match="missing columns: last_funding_rate"):
        archives.read_funding(archives.zip_lines(bad)).collect()


def test_macro_reader_nulls_text_values(spark, tmp_path):
    (tmp_path / "a.csv").write_text("observation_date,VIXCLS\n2025-01-01,.\n2025-01-02,17.5\n")
    out = archives.read_macro(archives.text_lines(spark, str(tmp_path)), "VIXCLS").orderBy("observation_date").collect()
    assert [r["value"] for r in out] == [None, 17.5]
    with pytest.raises(Exception, match="unexpected columns"):
        archives.read_macro(archives.text_lines(spark, str(tmp_path)), "NFCI").collect()


def test_eod_and_news_payloads(spark):
    eod = spark.createDataFrame([("spy", json.dumps({"datetime": "2025-01-01", "open": "1", "high": "3", "low": "1", "close": "2.5", "volume": None}))], "symbol string, value string")
    r = payloads.parse_eod_json(eod).first()
    assert (r["asset_id"], r["volume"], r["quote_volume"]) == ("SPY", 0.0, 0.0) and r["close_time"] == T0 + timedelta(days=1, microseconds=-1)
    arts = {"articles": [{"title": " Hi ", "url": "https://a.b/c", "seendate": "20250101T000000Z"}, {"title": "", "url": "https://a.b"}, {"title": "x", "url": "nope"}]}
    out = payloads.parse_news(spark.createDataFrame([("A", json.dumps(arts))], "asset_id string, value string"), F.current_timestamp()).collect()
    assert len(out) == 1 and out[0]["published_at"] == T0 and out[0]["source_name"] == "a.b" and out[0]["language"] == "unknown"
    assert out[0]["content_hash"] == hashlib.sha256(b"HI|https://a.b/c").hexdigest()


def test_report_document(spark):
    doc = sinks.report_json(spark.createDataFrame([("a", 1.5)], "variant string, brier double")).first()["document"]
    assert json.loads(doc) == {"variant": "a", "brier": 1.5}


# --- streams over several micro-batches ----------------------------------------------------------


def feed(spark, tmp_path, batches, schema):
    """Each batch becomes one file; one file per trigger."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


BAR = f"asset_id string, open_time {NTZ}, interval string, source string, close double, is_final boolean, ingest_seq long"


def test_stream_upsert_keeps_final_bars(spark, tmp_path):
    b = lambda close, final, seq: ("A", T0, "1h", "s", close, final, seq)
    s = feed(spark, tmp_path, [[b(1.0, False, 1)], [b(2.0, True, 2)], [b(3.0, False, 3)]], BAR)
    path = scratch(spark, "test")
    streams.upsert_sink(s, path).awaitTermination()
    out = streams.upserted(spark, path).collect()
    assert len(out) == 1 and out[0]["close"] == 2.0 and out[0]["is_final"]


def test_append_once_over_batches(spark, tmp_path):
    s = feed(spark, tmp_path, [[("A", 1), ("A", 1)], [("A", 1), ("B", 2)]], "k string, v int")
    path = scratch(spark, "test")
    streams.append_once(s, path, ["k"]).awaitTermination()
    assert sorted(r["k"] for r in spark.read.parquet(f"{path}/rows").collect()) == ["A", "B"]


def test_late_rows_become_issues(spark, tmp_path):
    rows = [("A", T0, T0 + timedelta(days=1, minutes=45)), ("B", T0, T0 + timedelta(days=1, minutes=46))]
    s = feed(spark, tmp_path, [rows], f"k string, ts {NTZ}, arrived_at {NTZ}")
    path = scratch(spark, "test")
    streams.cutoff_collect(s, path).awaitTermination()
    assert [r["k"] for r in spark.read.parquet(f"{path}/issues").collect()] == ["B"]
    assert [r["k"] for r in spark.read.parquet(f"{path}/kept").collect()] == ["A"]
