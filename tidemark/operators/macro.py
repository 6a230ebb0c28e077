"""Macro series: wide calendar with bounded forward fill, lagged features, as-of attachment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.asof import join_asof
from tidemark.operators.blocks import block_window, blocked, owned
from tidemark.schemas import MACRO_FEATURES


def wide_macro(long: DataFrame, series: dict[str, str], ffill: int = 10) -> DataFrame:
    """(series, observation_date, value) to one row per date; gaps take the value of at most ``ffill`` rows back."""
    wide = long.groupBy("observation_date").agg(
        *[F.max(F.when(F.col("series") == code, F.col("value"))).alias(name) for code, name in series.items()])
    b = blocked(wide, [], ["observation_date"], lookback=ffill, period="year")
    w = block_window(()).rowsBetween(-ffill, 0)
    filled = {n: F.last(n, ignorenulls=True).over(w) for n in series.values()}
    return owned(b.withColumns(filled))


def macro_features(wide: DataFrame, lag_days: int = 7, z_rows: int = 60, z_min: int = 40) -> DataFrame:
    """Features of a filled calendar; incomplete rows go before any join, availability is lagged."""
    b = blocked(wide, [], ["observation_date"], lookback=z_rows, period="year", indexed="_idx" in wide.columns)
    w = block_window(())
    rows = w.rowsBetween(1 - z_rows, 0)

    def diff(c: Column, n: int) -> Column:
        return c - F.lag(c, n).over(w)

    vix, y10, fci = F.col("vix"), F.col("treasury_10y"), F.col("financial_conditions")
    curve = (y10 - F.col("treasury_2y")) / 100
    std = F.stddev_samp("vix").over(rows)
    z = F.when((F.count("vix").over(rows) >= z_min) & (std != 0), (vix - F.avg("vix").over(rows)) / std)
    out = b.withColumns({
        "vix_level": vix / 100,
        "vix_change_5s": F.ln(vix / F.lag("vix", 5).over(w)),
        "vix_zscore_60s": z,
        "treasury_10y_level": y10 / 100,
        "yield_curve_10y_2y": curve,
        "yield_curve_change_20s": diff(curve, 20),
        "financial_conditions_level": fci,
        "financial_conditions_change_20s": diff(fci, 20),
        "available_at": F.col("observation_date") + F.expr(f"INTERVAL {lag_days} DAY"),
    })
    return owned(out).select("observation_date", "available_at", *MACRO_FEATURES).dropna()


def attach_macro(samples: DataFrame, macro: DataFrame, time: str = "snapshot_time",
                 available: str = "available_at") -> DataFrame:
    """Newest macro row already available at each snapshot (equality allowed)."""
    return join_asof(samples, macro, time, available)
