"""Fitting and applying probability and interval calibration, grouped by fold (or any key)."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import maths
from tidemark.operators.metrics import P, probs
from tidemark.operators.quantiles import higher, order_statistics
from tidemark.operators.vectors import vector_sums

# Fixed values of the temperature search: 321 candidates from 0.25 to 10, log-spaced.
GRID_STEPS, GRID_LOW, GRID_HIGH = 320, 0.25, 10.0
GRID = GRID_LOW * (GRID_HIGH / GRID_LOW) ** (np.arange(GRID_STEPS + 1) / GRID_STEPS)
NLL_CAP = -math.log(1e-12)


def grid_temperature(step: Column) -> Column:
    return GRID_LOW * F.pow(F.lit(GRID_HIGH / GRID_LOW), step / GRID_STEPS)


def temperature_losses(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """(key, step, temperature, nll).

    Only the two log-odds against the true class leave the row; the losses under all candidates are one vector of it,
    summed in each task, so at most 321 rows per key and task are shuffled, once.
    """
    logs = [maths.clip_log(p) for p in probs()]
    own = F.when(F.col("y") == 0, logs[0]).when(F.col("y") == 1, logs[1]).otherwise(logs[2])
    first = F.when(F.col("y") == 0, logs[1]).otherwise(logs[0]) - own
    second = F.when(F.col("y") == 2, logs[1]).otherwise(logs[2]) - own

    def nll(a, b):
        return np.minimum(np.log1p(np.exp(a[:, None] / GRID) + np.exp(b[:, None] / GRID)), NLL_CAP)
    return _mean_losses(df.select(*by, first.alias("_a"), second.alias("_b")).dropna(subset=["_a", "_b"]), by, ["_a", "_b"], nll)


def _mean_losses(cases: DataFrame, by: Sequence[str], inputs: Sequence[str], losses) -> DataFrame:
    sums = vector_sums(cases, by, inputs, losses, GRID_STEPS + 1)
    return sums.select(*by, "step", (F.col("total") / F.col("rows")).alias("nll"), grid_temperature(F.col("step")).alias("temperature"))


def temperature_fit(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Lowest mean log loss; ties go to the smaller temperature."""
    return temperature_losses(df, by).groupBy(*by).agg(
        F.min_by("temperature", F.struct("nll", "step")).alias("temperature"))


def binary_temperature_fit(df: DataFrame, by: Sequence[str], label: Column, p: Column) -> DataFrame:
    c = maths.clamp(p, maths.TINY, 1 - maths.TINY)
    cases = df.select(*by, label.cast("double").alias("_l"), F.ln(c / (1 - c)).alias("_z")).dropna(subset=["_l", "_z"])

    def nll(label, z):
        q = np.clip(1 / (1 + np.exp(-np.clip(z[:, None] / GRID, -50.0, 50.0))), maths.TINY, 1 - maths.TINY)
        return -(label[:, None] * np.log(q) + (1 - label[:, None]) * np.log(1 - q))
    best = F.min_by("temperature", F.struct("nll", "step"))
    return _mean_losses(cases, by, ["_l", "_z"], nll).groupBy(*by).agg(best.alias("temperature"))


def temperature_apply(df: DataFrame, temperature: Column | float) -> DataFrame:
    return df.withColumns(dict(zip(P, maths.temperature_scale(probs(), temperature))))


def blend_fit(df: DataFrame, by: Sequence[str], prior: str = "q") -> DataFrame:
    """Closed-form convex weight of the model against the prior, 0 where they coincide."""
    num, den = F.lit(0.0), F.lit(0.0)
    for k in range(3):
        p, q = F.col(f"p{k}"), F.col(f"{prior}{k}")
        num = num + (maths.hit(F.col("y"), k) - q) * (p - q)
        den = den + (p - q) * (p - q)
    sums = df.groupBy(*by).agg(F.sum(num).alias("_n"), F.sum(den).alias("_d"))
    w = F.when(F.col("_d") <= 1e-15, F.lit(0.0)).otherwise(maths.clamp(F.col("_n") / F.col("_d"), 0.0, 1.0))
    return sums.withColumn("weight", w).drop("_n", "_d")


def blend_apply(df: DataFrame, weight: Column, prior: str = "q") -> DataFrame:
    return df.withColumns(dict(zip(P, maths.blend(probs(), probs(prior), weight))))


def temperature_blend(fit: DataFrame, target: DataFrame, by: Sequence[str], prior: str = "q") -> DataFrame:
    """Fit temperature then blend weight on ``fit``, apply both to ``target`` (prior columns on each).

    Fitted parameters are one row per key and join back on the key; sent to the rows, for dealt by the few keys all rows of
    a key would meet in one task.
    """
    by = list(by)
    temps = F.broadcast(temperature_fit(fit, by))
    scaled = temperature_apply(fit.join(temps, by), F.col("temperature"))
    weights = F.broadcast(blend_fit(scaled, by, prior))
    out = temperature_apply(target.join(temps, by), F.col("temperature")).join(weights, by)
    return blend_apply(out, F.col("weight"), prior)


# --- intervals -----------------------------------------------------------------------------------


def conformal_level(coverage: float):
    """Level of the "higher" quantile for n scores."""
    def level(n: Column) -> Column:
        return F.least(F.lit(1.0), F.ceil((n + 1) * F.lit(coverage)) / n)
    return level


def _conformal(df: DataFrame, by: Sequence[str], score: Column, coverage: float, name: str) -> DataFrame:
    stats = order_statistics(df.withColumn("_score", score), by, "_score", {name: higher(conformal_level(coverage))})
    return stats.withColumn(name, F.greatest(F.col(name), F.lit(0.0)))


def conformal_abs(df: DataFrame, by: Sequence[str], coverage: float = 0.8) -> DataFrame:
    """Widening that reaches the coverage on the calibration rows; never negative."""
    score = maths.conformal_score(F.col("target"), F.col("lower"), F.col("upper"))
    return _conformal(df, by, score, coverage, "adjustment")


def conformal_scaled(df: DataFrame, by: Sequence[str], scale: str = "scale", coverage: float = 0.8) -> DataFrame:
    """The same in units of a point-in-time scale."""
    score = maths.conformal_score(F.col("target"), F.col("lower"), F.col("upper")) / maths.safe_scale(F.col(scale))
    return _conformal(df, by, score, coverage, "multiplier")


def conformal_apply(df: DataFrame, multiplier: Column, scale: Column) -> DataFrame:
    widen = F.greatest(multiplier, F.lit(0.0)) * maths.safe_scale(scale)
    return df.withColumns({"lower": F.col("lower") - widen, "upper": F.col("upper") + widen})


def horizon_scale(vol: Column, horizon: int, ppy: int) -> Column:
    return vol * math.sqrt(horizon / ppy)


# --- direction from other forecasts --------------------------------------------------------------

Z90 = 1.2815515655446004  # fixed value: 90% point of the normal distribution


def quantile_direction(df: DataFrame, band: str = "band") -> DataFrame:
    """Direction probabilities of a normal fitted to p10 / p50 / p90 (columns lower, mid, upper)."""
    low, mid, high = maths.sort_quantiles(F.col("lower"), F.col("mid"), F.col("upper"))
    scale = F.greatest((high - low) / (2 * Z90), F.lit(1e-4))
    down = maths.normal_cdf((-F.col(band) - mid) / scale)
    up = 1 - maths.normal_cdf((F.col(band) - mid) / scale)
    df = df.withColumns({"_dn": down, "_up": up}).withColumn("_ne", F.greatest(F.lit(0.0), 1 - F.col("_dn") - F.col("_up")))
    total = F.col("_dn") + F.col("_ne") + F.col("_up")
    return df.withColumns({"p0": F.col("_dn") / total, "p1": F.col("_ne") / total, "p2": F.col("_up") / total}).drop("_dn", "_up", "_ne")
