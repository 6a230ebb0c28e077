"""Complete feature rows: every (asset, time) of the universe in one plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions import maths
from tidemark.operators import crosssection as xs
from tidemark.operators import technical as ta
from tidemark.operators.asof import join_asof, peer_panel
from tidemark.operators.derivatives import attach_derivatives
from tidemark.session import stage


def one_hot_asset(df: DataFrame, symbols: Sequence[str], key: str = "asset_id") -> DataFrame:
    return df.withColumns({f"asset_{s.lower()}": (F.col(key) == F.lit(s)).cast("double") for s in symbols})


def finite_or_zero(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: maths.finite_or(F.col(c)) for c in columns})


def finite_or_drop(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.when(~maths.is_bad(F.col(c)), F.col(c)) for c in columns}).dropna(subset=list(columns))


def complete_samples(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(columns)).where(
        " and ".join(f"not isnan(cast({c} as double))" for c in columns) or "true")


def crypto_base(daily: DataFrame, trend_limit: float = 0.05, vol_limit: float = 0.65) -> DataFrame:
    """Own-series spot features plus the trailing 90 returns, with the global row position."""
    tail = {"_tail": F.collect_list("_r").over(ta.frame(90))}
    df = ta.compute(daily, lambda s: ta.crypto_spot_columns(s, trend_limit, vol_limit), tail, halo=90)
    return ta.finish(df)


def positional_benchmark(base: DataFrame, benchmark: str) -> DataFrame:
    """Benchmark statistics aligned by tail position: the newest n returns of either series are paired."""
    bench = base.where(F.col("asset_id") == benchmark).select(
        F.col("open_time").alias("_bt"), F.col("_tail").alias("_btail"), F.col("_idx").alias("_bidx"),
        F.col("return_30d").alias("_b30"))
    # The match depends on the time alone: one as-of row per distinct time, then an equi-join.
    times = join_asof(base.select("open_time").distinct(), bench, "open_time", "_bt", [], ["_btail", "_bidx", "_b30"], "year")
    df = base.join(times, "open_time")
    df = df.withColumns({f"_m{n}": ta.tail_moments(F.col("_tail"), F.col("_btail"), n) for n in (30, 90)})

    def guarded(value, den, n):
        ready = (F.col("_bidx") >= 90) & (F.size("_tail") >= n) & (F.size("_btail") >= n) & (den != 0)
        return F.when(ready, value / den).otherwise(F.lit(0.0))

    cols = {}
    for n in (30, 90):
        cov, sx, sy = (F.col(f"_m{n}.{c}") for c in ("cov", "sx", "sy"))
        cols[f"btc_correlation_{n}d"] = guarded(cov, sx * sy, n)
        if n == 30:
            cols["btc_beta_30d"] = guarded(cov, sy * sy, n)
    cols["relative_strength_30d"] = F.col("return_30d") - F.coalesce(F.col("_b30"), F.lit(0.0))
    return df.withColumns(cols).drop("_tail", "_btail", "_bidx", "_b30", "_m30", "_m90")


def peer_statistics(base: DataFrame) -> DataFrame:
    """(asset_id, open_time, breadth, three ranks) among each peer's latest row at or before the time."""
    panel = peer_panel(base, ["return_30d", "return_90d", "volatility_30d"])
    ranked = panel.withColumns({
        "market_breadth_30d": xs.breadth("return_30d", "open_time"),
        "momentum_rank_30d": xs.rank_cdf("return_30d", "open_time"),
        "momentum_rank_90d": xs.rank_cdf("return_90d", "open_time"),
        "volatility_rank_30d": xs.rank_cdf("volatility_30d", "open_time"),
    })
    own = ranked.where(F.col("peer_time") == F.col("open_time"))
    return own.select(F.col("peer").alias("asset_id"), "open_time", "market_breadth_30d",
                      *schemas.CROSS_SECTION_FEATURES)


def crypto_snapshots(daily: DataFrame, deriv: DataFrame | None, benchmark: str = schemas.CRYPTO_BENCHMARK,
                     symbols: Sequence[str] = schemas.CRYPTO_SYMBOLS, min_rows: int = 365,
                     trend_limit: float = 0.05, vol_limit: float = 0.65) -> DataFrame:
    """Spot, derivative, cross-section and indicator features for every asset-day with enough history."""
    # Four branches read the own-series features, so they are written once.
    base = stage(crypto_base(daily, trend_limit, vol_limit))
    keys = ["asset_id", "open_time"]
    feats = positional_benchmark(base, benchmark).join(peer_statistics(base), keys)
    feats = feats.where(F.col("_idx") >= min_rows - 1)
    if deriv is None:
        feats = feats.withColumns({c: F.lit(0.0) for c in schemas.DERIVATIVE_FEATURES})
    else:
        # Only the keys travel through the as-of join.
        feats = feats.join(attach_derivatives(base.select(*keys), deriv, "open_time"), keys)
    feats = feats.withColumnRenamed("open_time", "snapshot_time")
    feats = one_hot_asset(feats, symbols)
    names = [*schemas.SPOT_FEATURES, *schemas.DERIVATIVE_FEATURES, *schemas.CROSS_SECTION_FEATURES,
             *[f"asset_{s.lower()}" for s in symbols]]
    feats = finite_or_zero(feats, names)
    return feats.select("asset_id", "snapshot_time", F.lit("crypto-daily-v2").alias("feature_set_version"), *names)


def benchmark_macro(daily: DataFrame, benchmark: str, trend_limit: float = 0.03, vol_limit: float = 0.35) -> DataFrame:
    """The benchmark's own return, volatility, trend strength and regime per session."""
    df = ta.add_features(daily.where(F.col("asset_id") == benchmark), lambda s: {
        "benchmark_return_20s": s.log_return(20), "benchmark_return_60s": s.log_return(60),
        "benchmark_volatility_20s": s.volatility(20, 252), "benchmark_volatility_60s": s.volatility(60, 252),
        "benchmark_market_regime": maths.regime_code(s.ma_ratio(60), s.volatility(20, 252), trend_limit, vol_limit),
    })
    return _macro_columns(df.withColumnRenamed("open_time", "snapshot_time"), ["snapshot_time"])


def _macro_columns(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys and the benchmark columns, the trend strength made from the others."""
    strength = trend_strength(F.col("benchmark_return_60s"), F.col("benchmark_volatility_60s"), 60 / 252)
    return df.withColumn("benchmark_trend_strength_60s", strength).select(*keys, *schemas.EQUITY_MACRO_FEATURES)


def trend_strength(ret, vol, years: float):
    return F.abs(ret) / (F.greatest(vol, F.lit(1e-6)) * years ** 0.5)


def equity_features(daily: DataFrame, benchmark: str = schemas.EQUITY_BENCHMARK, mode: str = "batch",
                    trend_limit: float = 0.03, vol_limit: float = 0.35) -> DataFrame:
    """All session features before the completeness filter."""
    bars = daily.withColumn("_dollar", F.col("volume") * F.col("close"))
    own = ta.add_features(bars, lambda s: ta.equity_columns(s, mode, trend_limit, vol_limit))
    zero = None if mode == "batch" else 0.0
    pairs = {"benchmark_correlation_20s": ("corr", 20), "benchmark_correlation_60s": ("corr", 60),
             "benchmark_beta_20s": ("beta", 20)}
    against = ta.bench_by_date(daily, benchmark, pairs, zero, ("relative_strength_20s", 20))
    against = against.select("asset_id", "open_time", *pairs, "relative_strength_20s")
    df = own.join(against, ["asset_id", "open_time"])
    rank = xs.rank_avg if mode == "batch" else xs.rank_cdf
    return df.withColumns({
        "market_breadth_20s": xs.breadth("return_20s", "open_time", mode == "batch"),
        "momentum_rank_20s": rank("return_20s", "open_time"),
        "momentum_rank_60s": rank("return_60s", "open_time"),
        "volatility_rank_20s": rank("volatility_20s", "open_time"),
    })


def equity_snapshots(daily: DataFrame, benchmark: str = schemas.EQUITY_BENCHMARK, shift: str | None = None,
                     trend_limit: float = 0.03, vol_limit: float = 0.35) -> DataFrame:
    """Complete equity feature rows; incomplete sessions vanish (first complete one is the 200th)."""
    df = equity_features(daily, benchmark, "batch", trend_limit, vol_limit)
    df = finite_or_drop(df, schemas.EQUITY_FEATURES)
    time = F.col("open_time") + F.expr(f"INTERVAL {shift}") if shift else F.col("open_time")
    return df.select("asset_id", time.alias("snapshot_time"),
                     F.lit("us-equity-daily-v1").alias("feature_set_version"), *schemas.EQUITY_FEATURES)


def add_benchmark_macro(samples: DataFrame, benchmark: str = schemas.EQUITY_BENCHMARK) -> DataFrame:
    """Samples with the benchmark's columns of the same time and horizon; a time without benchmark gets nulls."""
    keys, prefix = ("snapshot_time", "horizon_days"), "benchmark_"
    own = {c.removeprefix(prefix): c for c in schemas.EQUITY_MACRO_FEATURES if "strength" not in c}
    schemas.require(samples, ["asset_id", *keys, *own])
    side = _macro_columns(unique_benchmark(samples, benchmark, keys, own), keys)
    plain = samples.drop(*schemas.EQUITY_MACRO_FEATURES)
    return plain.join(side, list(keys), "left").withColumn("feature_set_version", F.lit(schemas.EQUITY_MACRO_SET))


def unique_benchmark(df: DataFrame, benchmark: str, keys: Sequence[str], renames: dict[str, str]) -> DataFrame:
    """Benchmark rows, one per key, under new names: the unique right side of a many-to-one join."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c) for c in renames])
    side = df.where(F.col("asset_id") == benchmark).withColumn("_rn", F.row_number().over(w)).where("_rn = 1")
    return side.select(*keys, *[F.col(a).alias(b) for a, b in renames.items()])
