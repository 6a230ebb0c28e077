"""Explicit schemas, ordered feature sets and the fixed catalogue values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

# --- fixed values: columns of files and tables ----------------------------------------------------

# One kline archive line: twelve positional columns, all read as text and cast afterwards.
KLINE_COLUMNS = (
    "open_time", "open", "high", "low", "close", "volume", "close_time", "quote_volume",
    "trade_count", "taker_buy_base_volume", "taker_buy_quote_volume", "ignore",
)
FUNDING_REQUIRED = ("calc_time", "last_funding_rate")
METRICS_REQUIRED = (
    "create_time", "sum_open_interest", "sum_open_interest_value", "count_long_short_ratio",
    "sum_taker_long_short_vol_ratio",
)
DERIVATIVE_VALUES = (
    "funding_rate", "premium", "futures_quote_volume", "futures_taker_buy_ratio",
    "open_interest_value", "long_short_ratio", "taker_long_short_ratio",
)
# --- fixed values: catalogue, feature names, horizons, seeds ------------------------------------

CRYPTO_SYMBOLS = ("BTCUSDT", "ETHUSDT", "SOLUSDT", "BNBUSDT", "XRPUSDT", "ADAUSDT", "LINKUSDT", "DOGEUSDT")
CRYPTO_BENCHMARK = "BTCUSDT"
EQUITY_BENCHMARK = "SPY"
HORIZONS = (30, 90)
SEEDS = (17, 29, 43, 71, 101)

SPOT_FEATURES = (
    "return_1d", "return_3d", "return_7d", "return_14d", "return_30d", "return_60d", "return_90d",
    "volatility_7d", "volatility_30d", "volatility_90d", "rsi_14", "macd_normalized",
    "atr_14_normalized", "bollinger_width_20", "ma_ratio_7d", "ma_ratio_30d", "ma_ratio_90d",
    "ma_ratio_200d", "ma_slope_30d", "volume_zscore_30d", "trade_count_zscore_30d",
    "taker_buy_ratio_7d", "btc_correlation_30d", "btc_correlation_90d", "btc_beta_30d",
    "relative_strength_30d", "market_breadth_30d", "market_regime",
)
DERIVATIVE_FEATURES = (
    "funding_rate_mean_7d", "funding_rate_mean_30d", "funding_rate_zscore_90d", "premium_mean_7d",
    "premium_mean_30d", "premium_zscore_90d", "futures_volume_zscore_30d",
    "futures_taker_buy_ratio_7d", "open_interest_change_7d", "open_interest_change_30d",
    "open_interest_zscore_90d", "futures_long_short_ratio_7d", "futures_taker_long_short_ratio_7d",
    "derivatives_available",
)
CROSS_SECTION_FEATURES = ("momentum_rank_30d", "momentum_rank_90d", "volatility_rank_30d")
EQUITY_FEATURES = (
    "return_1s", "return_3s", "return_5s", "return_10s", "return_20s", "return_60s", "return_120s",
    "volatility_5s", "volatility_20s", "volatility_60s", "downside_volatility_20s", "rsi_14",
    "macd_normalized", "atr_14_normalized", "bollinger_width_20", "ma_ratio_5s", "ma_ratio_20s",
    "ma_ratio_60s", "ma_ratio_200s", "ma_slope_20s", "volume_zscore_20s", "dollar_volume_zscore_20s",
    "overnight_gap_1s", "intraday_return_1s", "benchmark_correlation_20s",
    "benchmark_correlation_60s", "benchmark_beta_20s", "relative_strength_20s", "market_breadth_20s",
    "market_regime", "momentum_rank_20s", "momentum_rank_60s", "volatility_rank_20s",
)
EQUITY_MACRO_FEATURES = (
    "benchmark_return_20s", "benchmark_return_60s", "benchmark_volatility_20s",
    "benchmark_volatility_60s", "benchmark_trend_strength_60s", "benchmark_market_regime",
)
MACRO_FEATURES = (
    "benchmark_return_20s", "benchmark_return_60s", "benchmark_volatility_20s",
    "benchmark_volatility_60s", "benchmark_trend_strength_60s", "benchmark_market_regime",
)
MACRO_SERIES = {
    "VIXCLS": "vix", "DGS2": "treasury_2y", "DGS10": "treasury_10y", "NFCI": "financial_conditions",
}
MACRO_FEATURES = (
    "vix_level", "vix_change_5s", "vix_zscore_60s", "treasury_10y_level", "yield_curve_10y_2y",
    "yield_curve_change_20s", "financial_conditions_level", "financial_conditions_change_20s",
)
EQUITY_MACRO_SET = "us-equity-daily-v1+spy-macro-exp1"


def require(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The frame itself; a lacking column fails at once."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df
