"""Blocks, as-of joins, order statistics and features against pandas / numpy brute force."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.operators import asof, blocks, derivatives, features, macro, technical
from tidemark.operators.quantiles import higher, linear, nearest_rank, order_statistics

# Features of 400 linear daily bars at the last day, asset and benchmark alike.
GOLDEN = {
    "return_1d": 0.0020020026706729687, "return_3d": 0.006018072325562945, "return_7d": 0.014098924379501675,
    "return_14d": 0.028399474521697957, "return_30d": 0.06187540371808745, "return_60d": 0.127833371509885,
    "return_90d": 0.19845093872383823, "volatility_7d": 0.00016742747697511446, "volatility_30d": 0.0007155140170254878,
    "volatility_90d": 0.002428307245618815, "rsi_14": 1.0, "macd_normalized": 0.013997366648167371, "atr_14_normalized": 0.006,
    "bollinger_width_20": 0.04824529894474713, "ma_ratio_7d": 0.006036217303822866, "ma_ratio_30d": 0.029866117404737436,
    "ma_ratio_90d": 0.09769484083424818, "ma_ratio_200d": 0.24843945068664164, "ma_slope_30d": 0.03866248693834895,
    "volume_zscore_30d": 1.647089319316488, "trade_count_zscore_30d": 1.647089319316488, "taker_buy_ratio_7d": 0.5,
    "btc_correlation_30d": 1.0, "btc_correlation_90d": 1.0, "btc_beta_30d": 1.0, "relative_strength_30d": 0.0, "market_regime": 1.0,
}


def linear_bars(asset, n=400):
    i = np.arange(n)
    return pd.DataFrame({
        "asset_id": asset, "open_time": pd.date_range("2025-01-01", periods=n, freq="D"), "open": 100.0 + i, "high": 102.0 + i, "low": 99.0 + i,
        "close": 101.0 + i, "volume": 1000.0 + i, "quote_volume": 1.0, "trade_count": 100000.0 + i, "taker_buy_base_volume": 500 + i / 2})


def random_bars(n=1500, seed=3, asset="A"):
    g = np.random.default_rng(seed)
    close = 100 * np.exp(np.cumsum(g.normal(0, 0.02, n)))
    return pd.DataFrame({
        "asset_id": asset, "open_time": pd.date_range("2015-01-01", periods=n, freq="D"), "open": close * 0.99, "high": close * 1.02,
        "low": close * 0.97, "close": close, "volume": g.uniform(1, 9, n), "quote_volume": 1.0, "trade_count": g.integers(1, 99, n).astype(float),
        "taker_buy_base_volume": 0.5})


def test_golden_crypto_features(spark):
    bars = spark.createDataFrame(pd.concat([linear_bars("BTCUSDT"), linear_bars("ETHUSDT")]))
    out = features.crypto_snapshots(bars, None).where("asset_id = 'ETHUSDT'").orderBy(F.desc("snapshot_time")).first()
    for name, want in GOLDEN.items():
        assert out[name] == pytest.approx(want, abs=1e-10), name
    assert all(out[c] == 0.0 for c in schemas.DERIVATIVE_FEATURES)
    assert out["asset_ethusdt"] == 1.0 and out["asset_btcusdt"] == 0.0


def test_first_crypto_snapshot_needs_365_rows(spark):
    bars = spark.createDataFrame(pd.concat([linear_bars("BTCUSDT"), linear_bars("ETHUSDT", 364)]))
    out = features.crypto_snapshots(bars, None).groupBy("asset_id").count().collect()
    assert {r["asset_id"]: r["count"] for r in out} == {"BTCUSDT": 36}


def test_blocked_windows_equal_whole_windows(spark):
    pdf = pd.concat([random_bars(300, 1, "A"), random_bars(41, 2, "B")])
    df = spark.createDataFrame(pdf)
    w = Window.partitionBy("asset_id").orderBy("open_time")
    want = df.select("asset_id", "open_time", F.avg("close").over(w.rowsBetween(-6, 0)).alias("m"), F.lead("close", 4).over(w).alias("f"))
    b = blocks.blocked(df, ["asset_id"], ["open_time"], lookback=6, lookahead=4, block=16)
    bw = blocks.block_window(("asset_id",))
    got = blocks.owned(b.withColumns({"m": F.avg("close").over(bw.rowsBetween(-6, 0)), "f": F.lead("close", 4).over(bw)})).select("asset_id", "open_time", "m", "f")
    a, c = (x.orderBy("asset_id", "open_time").toPandas() for x in (want, got))
    pd.testing.assert_frame_equal(a, c)


def test_full_history_ema_equals_recursion_across_blocks(spark):
    pdf = random_bars(2600)
    out = technical.add_features(spark.createDataFrame(pdf), lambda s: {"full": s.macd("full"), "tail": s.macd("trailing")}).orderBy("open_time").toPandas()
    close = pdf["close"]
    want = (close.ewm(span=12, adjust=False).mean() - close.ewm(span=26, adjust=False).mean()) / close
    assert np.allclose(out["full"], want, atol=1e-12)

    def ema(values, p):
        a, r = 2 / (p + 1), values[0]
        for v in values[1:]:
            r = a * v + (1 - a) * r
        return r
    for i in (0, 50, 118, 119, 500, 1500, 2599):
        tail = close.to_numpy()[max(0, i - 119):i + 1]
        assert out["tail"][i] == pytest.approx((ema(tail, 12) - ema(tail, 26)) / close[i], abs=1e-12)


def test_equity_features_match_pandas(spark):
    a, b = random_bars(420, 5, "AAA"), random_bars(420, 6, "SPY")
    out = features.equity_snapshots(spark.createDataFrame(pd.concat([a, b])), "SPY").where("asset_id = 'AAA'").orderBy("snapshot_time").toPandas()
    c, m = a["close"], b["close"]
    r, s = np.log(c / c.shift(1)), np.log(m / m.shift(1))
    last = out.iloc[-1]
    assert list(out.columns) == ["asset_id", "snapshot_time", "feature_set_version", *schemas.EQUITY_FEATURES]
    assert len(out) == 420 - 199
    want = {
        "volatility_60s": r.rolling(60).std() * math.sqrt(252), "benchmark_correlation_60s": r.rolling(60).corr(s),
        "benchmark_beta_20s": r.rolling(20).cov(s) / s.rolling(20).var(), "downside_volatility_20s": r.where(r < 0).rolling(20, min_periods=2).std() * math.sqrt(252),
        "volume_zscore_20s": (a["volume"] - a["volume"].rolling(20).mean()) / a["volume"].rolling(20).std(), "ma_slope_20s": c.rolling(5).mean() / c.rolling(20).mean().shift(5) - 1,
        "rsi_14": (100 - 100 / (1 + r.clip(lower=0).rolling(14).mean() / (-r.clip(upper=0)).rolling(14).mean())) / 100}
    for name, series in want.items():
        assert last[name] == pytest.approx(series.iloc[-1], abs=1e-9), name


def test_asof_join_equals_merge_asof(spark):
    g = np.random.default_rng(0)
    t0 = pd.Timestamp("2020-01-01")
    left = pd.DataFrame({"k": g.choice(["a", "b", "hot"], 400, p=[0.1, 0.1, 0.8]), "t": t0 + pd.to_timedelta(g.integers(0, 800, 400), "D"), "i": range(400)})
    right = pd.DataFrame({"k": g.choice(["a", "hot"], 60), "u": t0 + pd.to_timedelta(g.choice(800, 60, replace=False), "D"), "v": g.normal(size=60)})
    sides = spark.createDataFrame(left), spark.createDataFrame(right)
    got = asof.join_asof(*sides, "t", "u", ["k"], ["u", "v"]).toPandas().sort_values("i").reset_index(drop=True)
    split = asof.join_asof(*sides, "t", "u", ["k"], ["u", "v"], "year", rows_per_task=7).toPandas().sort_values("i").reset_index(drop=True)
    assert got["v"].equals(split["v"])
    want = pd.merge_asof(left.sort_values("t"), right.sort_values("u"), left_on="t", right_on="u", by="k").sort_values("i").reset_index(drop=True)
    assert np.allclose(got["v"], want["v"], equal_nan=True)
    assert asof.future_rows(spark.createDataFrame(want[["t", "u"]].dropna()), "t", "u").count() == 0


def test_macro_value_is_not_used_before_it_is_available(spark):
    s = spark.createDataFrame([("2025-01-02",), ("2025-01-03",)], "d string").select(F.to_timestamp("d").alias("snapshot_time"))
    m = spark.createDataFrame([("2025-01-01", "2025-01-03", 0.2)], "o string, a string, vix_level double").select(
        F.to_timestamp("o").alias("observation_date"), F.to_timestamp("a").alias("available_at"), "vix_level")
    out = macro.attach_macro(s, m).orderBy("snapshot_time").collect()
    assert [r["vix_level"] for r in out] == [None, 0.2]


def test_forward_fill_stops_after_ten_rows(spark):
    rows = [("V", i, 1.0) for i in [0]] + [("W", i, 2.0) for i in range(14)]
    long = spark.createDataFrame(rows, "series string, i int, value double").withColumn("observation_date", F.to_timestamp(F.lit("2020-01-01")) + F.make_dt_interval(F.col("i")))
    out = macro.wide_macro(long, {"V": "v", "W": "w"}).orderBy("observation_date").toPandas()
    assert out["v"].notna().tolist() == [True] * 11 + [False] * 3


@pytest.mark.parametrize("values", [
    np.r_[np.random.default_rng(1).normal(size=501), [0.0, -0.0, 0.0]], np.r_[np.repeat(7.0, 300), np.arange(50.0)],
    np.array([2.0 ** k for k in range(-40, 40)] + [-(2.0 ** k) for k in range(-40, 40)]), np.array([3.5])])
def test_order_statistics_equal_numpy(spark, values):
    df = spark.createDataFrame(pd.DataFrame({"g": "x", "v": values}))
    got = order_statistics(df, ["g"], "v", {"a": linear(0.1), "b": linear(0.5), "c": higher(0.8), "d": nearest_rank(0.95)}).first()
    assert got["a"] == pytest.approx(np.quantile(values, 0.1), abs=1e-12)
    assert got["b"] == pytest.approx(np.quantile(values, 0.5), abs=1e-12)
    assert got["c"] == np.quantile(values, 0.8, method="higher")
    assert got["d"] == np.sort(values)[min(max(math.ceil(len(values) * 0.95) - 1, 0), len(values) - 1)]


def test_order_statistics_spread_a_hot_group(spark):
    g = np.random.default_rng(9)
    df = pd.DataFrame({"g": np.where(g.random(6000) < 0.7, "hot", "cold"), "v": g.lognormal(size=6000)})
    out = order_statistics(spark.createDataFrame(df), ["g"], "v", {"m": linear(0.5)}).toPandas().set_index("g")["m"]
    assert out["hot"] == pytest.approx(df[df.g == "hot"].v.median()) and out["cold"] == pytest.approx(df[df.g == "cold"].v.median())


def test_derivative_features_use_the_non_missing_tail(spark):
    n = 120
    g = np.random.default_rng(4)
    pdf = pd.DataFrame({"asset_id": "A", "snapshot_time": pd.date_range("2024-01-01", periods=n, freq="D")})
    for c in schemas.DERIVATIVE_VALUES:
        v = g.uniform(0.5, 2, n)
        v[g.random(n) < 0.3] = np.nan
        pdf[c] = v
    pdf.loc[n - 1, ["funding_rate", "premium", "futures_quote_volume", "open_interest_value"]] = 1.0
    src = spark.createDataFrame(pdf).replace(float("nan"), None)
    out = derivatives.derivative_features(src).orderBy("snapshot_time").toPandas().iloc[-1]
    fund = pdf["funding_rate"].dropna()
    assert out["funding_rate_mean_7d"] == pytest.approx(fund.tail(7).mean())
    tail = pdf["premium"].dropna().tail(90)
    assert out["premium_zscore_90d"] == pytest.approx((tail.iloc[-1] - tail.mean()) / tail.std())
    oi = pdf["open_interest_value"].dropna()
    assert out["open_interest_change_30d"] == pytest.approx(math.log(oi.iloc[-1] / oi.iloc[-31]))
    assert out["derivatives_available"] == 1.0
