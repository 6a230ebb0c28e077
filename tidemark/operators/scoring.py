"""Batch scoring around fitted models: median reference, conformal output, perturbation explanations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import maths
from tidemark.operators import calibration as C
from tidemark.operators.quantiles import linear, order_statistics


def median_reference(train: DataFrame, features: Sequence[str]) -> DataFrame:
    """One row with the exact median of every feature.

    Features go long first, so one order-statistics plan serves all of them.
    """
    long = train.unpivot([], list(features), "feature", "value") if features else train
    med = order_statistics(long, ["feature"], "value", {"median": linear(0.5)})
    return med.groupBy().agg(*[F.max(F.when(F.col("feature") == f, F.col("median"))).alias(f) for f in features])


# Reference of a feature without a stored median; None keeps the current value.
DEFAULT_REFERENCE = {
    "rsi_14": 0.5, "market_breadth_20s": 0.5, "market_breadth_30d": 0.5, "momentum_rank_20s": 0.5,
    "momentum_rank_30d": 0.5, "momentum_rank_60s": 0.5, "momentum_rank_90d": 0.5,
    "volatility_rank_20s": 0.5, "volatility_rank_30d": 0.5, "benchmark_beta_20s": 1.0, "btc_beta_30d": 1.0,
    "derivatives_available": None,
}


def reference_of(feature: str, stored: dict[str, Column]) -> Column:
    default = DEFAULT_REFERENCE.get(feature, 0.0)
    fallback = F.col(feature) if default is None else F.lit(default)
    if feature not in stored:
        return fallback
    return F.when(~maths.is_bad(stored[feature]), stored[feature]).otherwise(fallback)


def finish_score(raw: DataFrame, temperature: Column, weight: Column, multiplier: Column, scale: Column) -> DataFrame:
    """Temperature, blend with the prior q0..q2, sorted quantiles, conformal widening, clipped risk."""
    df = C.blend_apply(C.temperature_apply(raw, temperature), weight)
    low, mid, high = maths.sort_quantiles(F.col("lower"), F.col("mid"), F.col("upper"))
    df = df.withColumns({"_lo": low, "_mi": mid, "_hi": high}).withColumns(
        {"lower": F.col("_lo"), "mid": F.col("_mi"), "upper": F.col("_hi")}).drop("_lo", "_mi", "_hi")
    df = C.conformal_apply(df, multiplier, scale)
    return df.withColumn("risk_score", maths.clamp(F.col("risk"), 0.0, 1.0))


def perturbed_rows(rows: DataFrame, ids: Sequence[str], features: Sequence[str], stored: dict[str, Column]) -> DataFrame:
    """One row per (input row, feature that differs from its reference), that feature replaced."""
    cases = F.filter(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("current"), reference_of(f, stored).cast("double").alias("reference"))
        for f in features]), lambda s: F.abs(s["current"] - s["reference"]) >= 1e-12)
    out = rows.withColumn("_case", F.explode(cases))
    swap = {f: F.when(F.col("_case.feature") == f, F.col("_case.reference")).otherwise(F.col(f)) for f in features}
    return out.withColumns(swap).select(*ids, *features, "_case.feature", "_case.current", "_case.reference")


def impacts(baseline: DataFrame, perturbed: DataFrame, ids: Sequence[str]) -> DataFrame:
    """(ids, feature, delta): how much P(up) - P(down) owes to each feature."""
    base = baseline.select(*ids, (F.col("p2") - F.col("p0")).alias("_base"))
    return perturbed.join(base, list(ids)).withColumn("delta", F.col("_base") - (F.col("p2") - F.col("p0"))).select(
        *ids, "feature", "current", "reference", "delta")


def top_factors(deltas: DataFrame, ids: Sequence[str], k: int = 3) -> DataFrame:
    """Arrays of the k largest positive and the k most negative features per row."""
    rows = deltas.where(F.col("delta") != 0).withColumn("_up", F.col("delta") > 0)
    w = Window.partitionBy(*ids, "_up").orderBy(F.desc(F.abs("delta")), "feature")
    rows = rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k)
    pick = lambda up: F.transform(F.array_sort(F.collect_list(F.when(F.col("_up") == up, F.struct("_rn", "feature")))), lambda s: s["feature"])
    return rows.groupBy(*ids).agg(pick(True).alias("positive"), pick(False).alias("negative"))
