"""Column expressions for bands, probabilities, intervals and levels.  No UDF except the normal CDF."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

Probs = tuple[Column, Column, Column]


def is_bad(c: Column) -> Column:
    """Missing, NaN or infinite."""
    d = c.cast("double")
    return c.isNull() | F.isnan(d) | (F.abs(d) == F.lit(float("inf")))


def finite_or(c: Column, default: float = 0.0) -> Column:
    return F.when(is_bad(c), F.lit(default)).otherwise(c)


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


# --- labels --------------------------------------------------------------------------------------


@dataclass(frozen=True)
class NeutralBand:
    """Fixed values of the label rule."""

    multiplier: float = 0.5
    long_weight: float = 0.35
    floor: float = 0.20
    cap: float = 1.50
    min_30: float = 0.025
    max_30: float = 0.18


def neutral_band(vol_short: Column, vol_long: Column | None, horizon: int, ppy: int = 365,
                 band: NeutralBand = NeutralBand()) -> Column:
    """Blend two annualised volatilities, bound them, scale to the horizon and bound the result."""
    vol_long = vol_short if vol_long is None else vol_long
    blended = F.sqrt((1 - band.long_weight) * vol_short * vol_short + band.long_weight * vol_long * vol_long)
    annual = clamp(blended, band.floor, band.cap)
    stretch = math.sqrt(horizon / 30)
    return clamp(band.multiplier * annual * math.sqrt(horizon / ppy), band.min_30 * stretch, band.max_30 * stretch)


def direction(forward: Column, band: Column) -> Column:
    return F.when(forward > band, F.lit(2)).when(forward < -band, F.lit(0)).otherwise(F.lit(1))


def simple_band(vol: Column, horizon: int) -> Column:
    """The older serving rule: half the horizon volatility, unbounded."""
    return 0.5 * vol * math.sqrt(horizon / 365)


def atr_band(band: Column, atr: Column, horizon: int, multiplier: float) -> Column:
    floor = multiplier * F.greatest(atr, F.lit(0.0)) * math.sqrt(horizon)
    return F.least(F.lit(0.18 * math.sqrt(horizon / 30)), F.greatest(band, floor))


def target_risk(volatility: Column) -> Column:
    return 1 - F.exp(-volatility)


# --- probabilities -------------------------------------------------------------------------------

TINY = 1e-12


def clip_log(p: Column) -> Column:
    return F.ln(clamp(p, TINY, 1.0))


def softmax(scores: list[Column]) -> list[Column]:
    top = F.greatest(*scores)
    parts = [F.exp(s - top) for s in scores]
    total = sum(parts[1:], parts[0])
    return [p / total for p in parts]


def temperature_scale(probs: Probs, temperature: Column | float) -> list[Column]:
    t = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    t = F.greatest(t, F.lit(0.01))
    return softmax([clip_log(p) / t for p in probs])


def binary_temperature_scale(p: Column, temperature: Column | float) -> Column:
    t = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    c = clamp(p, TINY, 1 - TINY)
    return 1 / (1 + F.exp(-clamp(F.ln(c / (1 - c)) / F.greatest(t, F.lit(0.01)), -50.0, 50.0)))


def blend(probs: Probs, prior: Probs, weight: Column) -> list[Column]:
    w = clamp(weight, 0.0, 1.0)
    return [w * p + (1 - w) * q for p, q in zip(probs, prior)]


def ordinal(not_down: Column, up: Column) -> list[Column]:
    """Cumulative P(not down), P(up) to three classes; crossed thresholds meet in the middle."""
    nd, u = clamp(not_down, 0.0, 1.0), clamp(up, 0.0, 1.0)
    mid = (nd + u) / 2
    nd2, u2 = F.when(u > nd, mid).otherwise(nd), F.when(u > nd, mid).otherwise(u)
    return [1 - nd2, nd2 - u2, u2]


def erf(x: Column) -> Column:
    """Error function to double rounding, by a series of positive terms up to 3 and a continued fraction beyond."""
    x = x.cast("double")
    a = F.abs(x)
    # all literals are doubles: each cast would cost the analyser a pass over the nested terms
    near, square = F.lit(1.0), x * x * 2.0
    for n in range(111, 1, -2):  # 1 + 2x^2/3 (1 + 2x^2/5 (1 + ...))
        near = square * near / float(n) + 1.0
    far = a
    for k in range(30, 0, -1):  # a + 1/2 / (a + 2/2 / (a + 3/2 / ...))
        far = F.lit(k / 2) / far + a
    bell = F.exp(-x * x)
    inside = x * (2 / math.sqrt(math.pi)) * bell * near
    return F.when(F.isnan(x), x).when(a < 3.0, inside).otherwise(F.signum(x) * (F.lit(1.0) - bell / (far * math.sqrt(math.pi))))


def normal_cdf(z: Column) -> Column:
    return 0.5 * (1 + erf(z / math.sqrt(2)))


def argmax(probs: Probs) -> Column:
    """Lowest class wins ties."""
    p0, p1, p2 = probs
    return F.when((p0 >= p1) & (p0 >= p2), F.lit(0)).when(p1 >= p2, F.lit(1)).otherwise(F.lit(2))


def prob_of(label: Column, probs: Probs) -> Column:
    return F.when(label == 0, probs[0]).when(label == 1, probs[1]).otherwise(probs[2])


def hit(label: Column, k: int) -> Column:
    return F.when(label == k, F.lit(1.0)).otherwise(F.lit(0.0))


def row_brier(label: Column, probs: Probs) -> Column:
    parts = [(p - hit(label, k)) * (p - hit(label, k)) for k, p in enumerate(probs)]
    return parts[0] + parts[1] + parts[2]


def row_nll(label: Column, probs: Probs) -> Column:
    return -clip_log(prob_of(label, probs))


# --- intervals -----------------------------------------------------------------------------------


def sort_quantiles(p10: Column, p50: Column, p90: Column) -> list[Column]:
    low, high = F.least(p10, p50, p90), F.greatest(p10, p50, p90)
    middle = F.greatest(F.least(p10, p50), F.least(F.greatest(p10, p50), p90))
    return [low, middle, high]


def pinball(target: Column, forecast: Column, q: float) -> Column:
    e = target - forecast
    return F.greatest(q * e, (q - 1) * e)


def interval_score(target: Column, low: Column, high: Column, alpha: float = 0.2) -> Column:
    below = F.when(target < low, (2 / alpha) * (low - target)).otherwise(0.0)
    above = F.when(target > high, (2 / alpha) * (target - high)).otherwise(0.0)
    return (high - low) + below + above


def conformal_score(target: Column, low: Column, high: Column) -> Column:
    return F.greatest(low - target, target - high)


def safe_scale(scale: Column) -> Column:
    return F.greatest(scale, F.lit(1e-4))


# --- levels --------------------------------------------------------------------------------------


def risk_level(score: Column) -> Column:
    return (F.when(score < 0.25, "Low").when(score < 0.50, "Medium").when(score < 0.75, "High")
            .otherwise("VeryHigh"))


def confidence_level(score: Column) -> Column:
    return F.when(score >= 0.70, "High").when(score >= 0.50, "Medium").otherwise("Low")


def regime_code(trend: Column, vol: Column, trend_limit: float, vol_limit: float) -> Column:
    """0 flat, +-1 calm trend, +-2 turbulent trend."""
    calm = vol < vol_limit
    return (F.when(F.abs(trend) < trend_limit, F.lit(0.0))
            .when((trend > 0) & calm, F.lit(1.0)).when(trend > 0, F.lit(2.0))
            .when(calm, F.lit(-1.0)).otherwise(F.lit(-2.0)))


def freshness(ts: Column, now: Column, allowed: str) -> Column:
    limit = F.expr(f"INTERVAL {allowed}")
    return F.when(ts.isNull(), "missing").when(ts + limit >= now, "fresh").otherwise("stale")
