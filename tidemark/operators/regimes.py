"""Macro regimes of the benchmark: fitted terciles and bucketed segments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.features import trend_strength
from tidemark.operators.quantiles import linear, order_statistics

# Fixed column roles: (volatility, volume z, trend return, trend volatility, trend years, sign return)
CRYPTO = ("volatility_30d", "volume_zscore_30d", "return_30d", "volatility_30d", 30 / 365, "return_90d")
EQUITY = ("volatility_20s", "volume_zscore_20s", "return_60s", "volatility_60s", 60 / 252, "return_60s")
MEASURES = ("macro_volatility", "macro_volume", "macro_trend_score")


def macro_frame(feats: DataFrame, benchmark: str, roles=CRYPTO, by: Sequence[str] = (), time: str = "snapshot_time") -> DataFrame:
    """One row per (by, time): the benchmark's volatility, volume z, trend score and trend sign."""
    vol, volume, ret, trend_vol, years, sign = roles
    w = Window.partitionBy(*by, time).orderBy(F.desc(vol), F.desc(volume))
    rows = feats.where(F.col("asset_id") == benchmark).withColumn("_rn", F.row_number().over(w)).where("_rn = 1")
    return rows.select(
        *by, time, F.col(vol).alias("macro_volatility"), F.col(volume).alias("macro_volume"),
        trend_strength(F.col(ret), F.col(trend_vol), years).alias("macro_trend_score"),
        F.signum(F.col(sign)).alias("macro_trend_direction"))


def thresholds(macro: DataFrame, by: Sequence[str]) -> DataFrame:
    """Exact terciles of the three measures, fitted on the rows given (training rows of each fold)."""
    out = None
    for m in MEASURES:
        t = order_statistics(macro, by, m, {f"{m}_lo": linear(1 / 3), f"{m}_hi": linear(2 / 3)})
        out = t if out is None else out.join(t, list(by))
    return out


def bucket(value: Column, low: Column, high: Column, names: tuple[str, str, str]) -> Column:
    """The lower test comes first; a missing value falls in the middle."""
    return F.when(value <= low, names[0]).when(value >= high, names[2]).otherwise(names[1])


def attach(rows: DataFrame, macro: DataFrame, limits: DataFrame, by: Sequence[str], time: str = "snapshot_time",
           regime: str = "macro_market_regime") -> DataFrame:
    """Bucket every row by its day's macro values against the key's fitted limits."""
    df = rows.join(macro, [*by, time], "left").join(limits, list(by))

    def cut(measure: str, names):
        return bucket(F.col(measure), F.col(f"{measure}_lo"), F.col(f"{measure}_hi"), names)

    size = ("low", "normal", "high")
    df = df.withColumns({
        "volatility_regime": cut("macro_volatility", size), "volume_regime": cut("macro_volume", size),
        "trend_strength": cut("macro_trend_score", ("mean_reverting", "transition", "trend"))})
    strength, sign = F.col("trend_strength"), F.col("macro_trend_direction")
    state = (F.when(strength == "mean_reverting", "mean_reverting")
             .when((strength == "trend") & (sign > 0), "bull_trend")
             .when((strength == "trend") & (sign < 0), "bear_trend").otherwise("transition"))
    return df.withColumn(regime, state).drop(*[f"{m}_{s}" for m in MEASURES for s in ("lo", "hi")])
