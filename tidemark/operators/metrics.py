"""Forecast-quality metrics over one long prediction table, grouped by any key columns.

Columns by convention: ``y`` (0 down, 1 neutral, 2 up), ``p0 p1 p2``, ``target``, ``lower``, ``mid``,
``upper``.  Every metric is a partial aggregate; binned metrics aggregate to (key, class, bin) first, so
the second level never sees more than classes x bins rows per key.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import maths

P = ("p0", "p1", "p2")


def probs(prefix: str = "p") -> tuple[Column, Column, Column]:
    return F.col(f"{prefix}0"), F.col(f"{prefix}1"), F.col(f"{prefix}2")


def mean_of(name: str, value: Column) -> Column:
    return F.avg(value).alias(name)


def brier_expr(prefix: str = "p", name: str = "brier") -> Column:
    return mean_of(name, maths.row_brier(F.col("y"), probs(prefix)))


def bss(model: Column, baseline: Column) -> Column:
    return F.when(baseline > 0, 1 - model / baseline)


def brier(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(brier_expr())


def accuracy_expr() -> Column:
    return mean_of("accuracy", (maths.argmax(probs()) == F.col("y")).cast("double"))


def logloss_expr() -> Column:
    return mean_of("log_loss", maths.row_nll(F.col("y"), probs()))


def coverage_expr(lo: str = "lower", hi: str = "upper", name: str = "coverage") -> Column:
    return mean_of(name, F.col("target").between(F.col(lo), F.col(hi)).cast("double"))


def pinball_expr(forecast: Column, q: float, name: str) -> Column:
    return mean_of(name, maths.pinball(F.col("target"), forecast, q))


def interval_score_expr(lo: str = "lower", hi: str = "upper", alpha: float = 0.2, name: str = "interval_score") -> Column:
    return mean_of(name, maths.interval_score(F.col("target"), F.col(lo), F.col(hi), alpha))


def reject_crossed(df: DataFrame, lo: str = "lower", hi: str = "upper") -> DataFrame:
    """Fail the job on the first interval whose bounds are crossed."""
    check = F.when(F.col(lo) > F.col(hi), F.raise_error(F.lit("interval bounds are crossed")).cast("double"))
    return df.withColumn(lo, F.coalesce(check, F.col(lo)))


def risk_mae_expr(risk: Column, target_risk: Column, name: str = "risk_mae") -> Column:
    return mean_of(name, F.abs(target_risk - risk))


def bic_like(log_loss: Column, features: Column, effective: Column) -> Column:
    n = F.greatest(effective, F.lit(2))
    return log_loss + features * F.log(n) / (2 * n)


def effective_n(df: DataFrame, horizon: int, by: Sequence[str], time: str = "snapshot_time",
                asset: str = "asset_id") -> DataFrame:
    """Independent-looking sample count: horizon-spaced days times assets, at least two."""
    n = F.ceil(F.count_distinct(time) / F.lit(float(horizon))) * F.count_distinct(asset)
    return df.groupBy(*by).agg(F.greatest(n, F.lit(2)).cast("long").alias("effective_n"))


# --- binned --------------------------------------------------------------------------------------


def class_bins(df: DataFrame, by: Sequence[str], bins: int = 10) -> DataFrame:
    """(key, class, bin): count, summed forecast and summed outcome of the one-vs-rest problem."""
    rows = df.select(*by, "y", F.posexplode(F.array(*[F.col(c) for c in P])).alias("k", "f"))
    slot = F.least(F.floor(maths.clamp(F.col("f"), 0.0, 1.0) * bins), F.lit(bins - 1)).cast("int")
    return rows.groupBy(*by, "k", slot.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("f").alias("sf"),
        F.sum((F.col("y") == F.col("k")).cast("double")).alias("so"))


def murphy(df: DataFrame, by: Sequence[str], bins: int = 10) -> DataFrame:
    """Reliability, resolution, uncertainty, their sum and its gap to the unbinned Brier score."""
    by = list(by)
    cell = class_bins(df, by, bins)
    per_class = Window.partitionBy(*by, "k")
    cell = cell.withColumns({"_N": F.sum("n").over(per_class), "_base": F.sum("so").over(per_class) / F.sum("n").over(per_class)})
    share, rate = F.col("n") / F.col("_N"), F.col("so") / F.col("n")
    gap, lift = F.col("sf") / F.col("n") - rate, rate - F.col("_base")
    parts = cell.groupBy(*by).agg(
        F.sum(share * gap * gap).alias("reliability"), F.sum(share * lift * lift).alias("resolution"),
        F.sum(share * F.col("_base") * (1 - F.col("_base"))).alias("uncertainty"))
    out = join_metrics([parts, brier(df, by)], by)
    whole = F.col("reliability") - F.col("resolution") + F.col("uncertainty")
    return out.withColumn("decomposed_brier", whole).withColumn("binning_gap", F.col("brier") - whole)


def ece(df: DataFrame, by: Sequence[str], bins: int = 10) -> DataFrame:
    """Top-label calibration error over bins open on the left, closed on the right."""
    conf = F.greatest(*probs())
    step = 1.0 / bins
    edges = [i * step for i in range(1, bins)]
    slot = functools.reduce(lambda a, b: a + b, [(conf > e).cast("int") for e in edges])
    inside = (conf > 0) & (conf <= 1)
    rows = df.select(*by, conf.alias("c"), (maths.argmax(probs()) == F.col("y")).cast("double").alias("ok"),
                     slot.alias("bin"), inside.alias("_in"))
    cell = rows.groupBy(*by, "bin", "_in").agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("sc"), F.sum("ok").alias("so"))
    err = F.when(F.col("_in"), F.abs(F.col("so") - F.col("sc"))).otherwise(0.0)
    return cell.groupBy(*by).agg((F.sum(err) / F.sum("n")).alias("ece"))


def ece_classwise(df: DataFrame, by: Sequence[str], bins: int = 10) -> DataFrame:
    """Mean over classes of the one-vs-rest error; every class sees the same number of rows."""
    cell = class_bins(df, by, bins)
    return cell.groupBy(*by).agg((F.sum(F.abs(F.col("so") - F.col("sf"))) / F.sum("n")).alias("classwise_ece"))


def join_metrics(frames: Sequence[DataFrame], by: Sequence[str]) -> DataFrame:
    """Side-by-side metric tables; without keys every table is a single row, joined on a constant."""
    by = list(by)
    if by:
        return functools.reduce(lambda a, b: a.join(b, by), frames)
    tagged = [f.withColumn("_one", F.lit(1)) for f in frames]
    return functools.reduce(lambda a, b: a.join(b, "_one"), tagged).drop("_one")


def summary(df: DataFrame, by: Sequence[str], baseline: str | None = None, bins: int = 10) -> DataFrame:
    """One metric row per key: Brier with skill against a baseline forecast, calibration, decomposition.

    One pass: every row goes to three class cells and one top-label cell (kind 3), which carries the row's own sums.
    """
    by = list(by)
    y, conf = F.col("y"), F.greatest(*probs())
    zero = F.lit(0.0)

    def cell(kind: int, f: Column, ok: Column, slot: Column, *sums: Column) -> Column:
        named = [c.cast("double").alias(n) for c, n in zip((f, ok, *sums), ("f", "ok", "nll", "base"))]
        return F.struct(F.lit(kind).alias("kind"), slot.cast("int").alias("bin"), *named)

    edges = functools.reduce(lambda a, b: a + b, [(conf > i / bins).cast("int") for i in range(1, bins)])
    base_loss = maths.row_brier(y, probs(baseline)) if baseline else zero
    cells = [cell(k, F.col(p), y == k, F.least(F.floor(maths.clamp(F.col(p), 0.0, 1.0) * bins), F.lit(bins - 1)), zero, zero) for k, p in enumerate(P)]
    cells.append(cell(3, conf, maths.argmax(probs()) == y, F.when((conf > 0) & (conf <= 1), edges).otherwise(-1), maths.row_nll(y, probs()), base_loss))
    rows = df.select(*by, F.explode(F.array(*cells)).alias("c")).select(*by, "c.*")
    binned = rows.groupBy(*by, "kind", "bin").agg(
        F.count(F.lit(1)).alias("n"), F.sum("f").alias("sf"), F.sum("ok").alias("so"),
        F.sum((F.col("f") - F.col("ok")) * (F.col("f") - F.col("ok"))).alias("s2"), F.sum("nll").alias("nll"), F.sum("base").alias("base"))
    per_kind = Window.partitionBy(*by, "kind")
    binned = binned.withColumns({"_N": F.sum("n").over(per_kind), "_rate": F.sum("so").over(per_kind) / F.sum("n").over(per_kind)})
    share, rate = F.col("n") / F.col("_N"), F.col("so") / F.col("n")
    gap, lift = F.col("sf") / F.col("n") - rate, rate - F.col("_rate")

    def classes(value: Column) -> Column:
        return F.sum(F.when(F.col("kind") < 3, value))

    def top(value: Column) -> Column:
        return F.sum(F.when(F.col("kind") == 3, value))

    total, miss = top(F.col("n")), F.abs(F.col("so") - F.col("sf"))
    aggs = [total.alias("sample_count"), (top(F.col("so")) / total).alias("accuracy"), (top(F.col("nll")) / total).alias("log_loss")]
    if baseline:
        aggs.append((top(F.col("base")) / total).alias("baseline_brier"))
    out = binned.groupBy(*by).agg(
        *aggs, classes(share * gap * gap).alias("reliability"), classes(share * lift * lift).alias("resolution"),
        classes(share * F.col("_rate") * (1 - F.col("_rate"))).alias("uncertainty"), (classes(F.col("s2")) / total).alias("brier"),
        (top(F.when(F.col("bin") >= 0, miss).otherwise(0.0)) / total).alias("ece"), (classes(miss) / classes(F.col("n"))).alias("classwise_ece"))
    whole = F.col("reliability") - F.col("resolution") + F.col("uncertainty")
    out = out.withColumn("decomposed_brier", whole).withColumn("binning_gap", F.col("brier") - whole)
    if baseline:
        out = out.withColumns({"brier_skill_score": bss(F.col("brier"), F.col("baseline_brier")),
                               "brier_delta": F.col("brier") - F.col("baseline_brier")})
    return out


def class_shares(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(*[F.avg(maths.hit(F.col("y"), k)).alias(f"share_{k}") for k in range(3)])


# --- over folds and segments ---------------------------------------------------------------------


def fold_mean(df: DataFrame, by: Sequence[str], pairs: Sequence[tuple[str, str]], others: Sequence[str] = ()) -> DataFrame:
    """Mean over folds of each metric and its baseline, and in how many folds the metric is lower."""
    aggs = []
    for metric, base in pairs:
        aggs += [F.avg(metric).alias(metric), F.avg(base).alias(base),
                 F.count_if(F.col(metric) < F.col(base)).alias(f"{metric}_wins")]
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("folds"), *aggs, *[F.avg(c).alias(c) for c in others])


def segments(df: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Rows repeated once per dimension as (dimension, value): single-column grouping sets."""
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dims])
    return df.withColumn("_seg", F.explode(pairs)).select(*df.columns, "_seg.dimension", "_seg.value")


def segment_summary(df: DataFrame, dims: Sequence[str], baseline: str = "b") -> DataFrame:
    """Metrics per segment.  Only the scoring columns travel through the expansion."""
    keep = ["y", *P, *[f"{baseline}{k}" for k in range(3)]]
    seg = segments(df.select(*keep, *dims), dims)
    by = ["dimension", "value"]
    base = seg.groupBy(*by).agg(
        F.count(F.lit(1)).alias("sample_count"), brier_expr(), brier_expr(baseline, "baseline_brier"),
        accuracy_expr(), mean_of("mean_confidence", F.greatest(*probs())))
    out = base.join(ece(seg, by), by)
    return out.withColumn("brier_delta", F.col("brier") - F.col("baseline_brier"))


def worst_k(seg: DataFrame, k: int = 10) -> DataFrame:
    return seg.orderBy(F.desc("brier_delta"), "dimension", "value").limit(k)


def daily_loss(df: DataFrame, by: Sequence[str] = ("fold",), time: str = "snapshot_time") -> DataFrame:
    return df.groupBy(*by, time).agg(brier_expr(name="loss"))
