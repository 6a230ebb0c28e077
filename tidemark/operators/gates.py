"""Promotion gates, confidence decision, readiness and issue bookkeeping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import maths
from tidemark.functions.times import micros

# Fixed values of the gates.
DIRECTION = {"brier_ratio": 0.95, "wins": 2, "ece": 0.05}
SCENARIO = {"pinball_ratio": 0.98, "interval_ratio": 0.98, "wins": 2, "coverage": (0.75, 0.85), "risk_ratio": 0.95}
REQUIRED_DAYS = 90


def gate_direction(metrics: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean over folds of brier, baseline_brier, ece and the fold wins decide."""
    g = DIRECTION
    agg = metrics.groupBy(*by).agg(
        F.avg("brier").alias("brier"), F.avg("baseline_brier").alias("baseline_brier"), F.avg("ece").alias("ece"),
        F.count_if(F.col("brier") < F.col("baseline_brier")).alias("wins"))
    ok = ((F.col("brier") <= F.col("baseline_brier") * g["brier_ratio"]) & (F.col("wins") >= g["wins"]) & (F.col("ece") <= g["ece"]))
    return agg.withColumn("direction_passed", ok)


def gate_scenario(metrics: DataFrame, by: Sequence[str]) -> DataFrame:
    g = SCENARIO
    pairs = (("quantile_pinball", "baseline_quantile_pinball"), ("interval_score", "baseline_interval_score"),
             ("risk_mae", "baseline_risk_mae"))
    aggs = [F.avg("coverage").alias("coverage")]
    for m, b in pairs:
        aggs += [F.avg(m).alias(m), F.avg(b).alias(b), F.count_if(F.col(m) < F.col(b)).alias(f"{m}_wins")]
    out = metrics.groupBy(*by).agg(*aggs)
    limits = (g["pinball_ratio"], g["interval_ratio"], g["risk_ratio"])
    ok = F.col("coverage").between(*g["coverage"])
    for (m, b), r in zip(pairs, limits):
        ok = ok & (F.col(m) <= F.col(b) * r) & (F.col(f"{m}_wins") >= g["wins"])
    return out.withColumn("scenario_passed", ok)


def gate_confidence(df: DataFrame, min_probability: float | Column = 0.55, min_margin: float | Column = 0.15) -> DataFrame:
    """status, score and level from p0..p2, mid, lower, upper and the flags is_fresh, is_complete."""
    down, neutral, up = F.col("p0"), F.col("p1"), F.col("p2")
    ranked = F.array_sort(F.array(down, neutral, up))
    top, second = F.element_at(ranked, 3), F.element_at(ranked, 2)
    says_up, says_down = (up > down) & (up > neutral), (down > up) & (down > neutral)
    clash = (says_up & (F.col("mid") < 0)) | (says_down & (F.col("mid") > 0))
    width = maths.clamp((F.col("upper") - F.col("lower")) / 2, 0.0, 0.25)
    raw = maths.clamp(top * 0.65 + (top - second) * 0.35 - F.when(clash, 0.25).otherwise(0.0) - width, 0.0, 1.0)
    stale = ~F.col("is_fresh") | ~F.col("is_complete")
    signal = (top >= min_probability) & (top - second >= min_margin) & ~clash
    return df.withColumns({
        "confidence": F.when(stale, F.lit(0.0)).otherwise(raw),
        "status": F.when(stale, "stale_data").when(signal, "signal").otherwise("insufficient_confidence"),
        "level": F.when(stale, "Unavailable").otherwise(maths.confidence_level(raw)),
    })


def suppress_direction(df: DataFrame, eligible: Column) -> DataFrame:
    """Models that failed the direction gate stay research only."""
    return df.withColumns({
        "status": F.when(eligible, F.col("status")).otherwise("insufficient_confidence"),
        "confidence": F.when(eligible, F.col("confidence")).otherwise(F.least(F.col("confidence"), F.lit(0.49))),
        "level": F.when(eligible, F.col("level")).otherwise("ResearchOnly"),
    })


def limitations(direction_ok: Column, scenario_ok: Column, is_equity: Column) -> Column:
    """Ordered codes of what a reader must know about a prediction."""
    return F.array_compact(F.array(
        F.when(~direction_ok, "direction_suppressed"), F.when(~scenario_ok, "scenario_unverified"),
        F.when(is_equity, "eod_shadow_only"), F.when(is_equity, "horizon_in_sessions"),
        F.when(~is_equity, "news_not_used"), F.lit("factors_not_causal"), F.lit("not_advice")))


# --- readiness -----------------------------------------------------------------------------------


def _all_assets(found: DataFrame, assets: DataFrame | None, count: str) -> DataFrame:
    """One row for each asset of the dimension, a count of 0 where nothing was found."""
    if assets is None:
        return found
    return assets.select("asset_id").distinct().join(found, "asset_id", "left").withColumn(count, F.coalesce(count, F.lit(0)))


def readiness_history(snaps: DataFrame, cutoff: Column, now: Column, n: int = REQUIRED_DAYS, assets: DataFrame | None = None) -> DataFrame:
    """(asset, days, ready, reason): the last n complete days up to the cutoff, gap-free and as-of safe.

    A missing day shows up as a short count or as a gap, a row known too late as a boundary violation.  With
    ``assets``, an asset without any complete day is there as well and counts 0.
    """
    rows = snaps.where(F.col("is_complete") & (F.col("snapshot_time") <= cutoff))
    w = Window.partitionBy("asset_id").orderBy(F.desc("snapshot_time"))
    rows = rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
    expected = cutoff - F.make_dt_interval(F.col("_rn") - 1)
    late = (F.col("available_at") > now) | (F.col("source_max_event_time") >= F.col("snapshot_time"))
    # The earliest day decides which of the two faults is reported; a gap outranks lateness on one day.
    agg = rows.groupBy("asset_id").agg(
        F.count(F.lit(1)).alias("days"),
        F.max(F.when(F.col("snapshot_time") != expected, F.col("_rn"))).alias("_gap"),
        F.max(F.when(late, F.col("_rn"))).alias("_late"))
    agg = _all_assets(agg, assets, "days")
    gap, late_at = F.coalesce(F.col("_gap"), F.lit(0)), F.coalesce(F.col("_late"), F.lit(0))
    reason = (F.when(F.col("days") < n, F.concat(F.col("days").cast("string"), F.lit(f"/{n}")))
              .when((gap > 0) & (gap >= late_at), "gap").when(late_at > 0, "as_of_violation").otherwise(""))
    return agg.withColumn("reason", reason).withColumn("ready", F.col("reason") == "").drop("_gap", "_late")


def readiness_spot(daily: DataFrame, cutoff: Column, benchmark: str, n: int = 365,
                   max_age_days: int | None = None, now: Column | None = None, assets: DataFrame | None = None) -> DataFrame:
    """(asset, rows, last_time, ready): enough rows ending on the cutoff, and a benchmark that passes too.

    With ``assets``, an asset without rows is there as well, not ready.
    """
    agg = daily.groupBy("asset_id").agg(F.count(F.lit(1)).alias("rows"), F.max("open_time").alias("last_time"))
    agg = _all_assets(agg, assets, "rows")
    own = (F.col("rows") >= n) & F.coalesce(F.col("last_time") == cutoff, F.lit(False))
    if max_age_days is not None:
        own = own & F.coalesce(micros(now) - micros(F.col("last_time")) <= max_age_days * 86_400_000_000, F.lit(False))
    flagged = agg.withColumn("_own", own)
    bench = flagged.where(F.col("asset_id") == benchmark).agg(F.coalesce(F.max("_own"), F.lit(False))).scalar()
    return flagged.withColumn("ready", F.col("_own") & bench).drop("_own")


# --- model registry ------------------------------------------------------------------------------


def champion_shadow(models: DataFrame) -> DataFrame:
    """Newest non-production model of each (class, horizon); equal times go to the larger version."""
    w = Window.partitionBy("asset_class", "horizon_days", "is_production").orderBy(F.desc("trained_at"), F.desc("version"))
    first = F.row_number().over(w) == 1
    return models.withColumn("is_shadow_candidate", ~F.col("is_production") & first)


def promote_production(models: DataFrame) -> DataFrame:
    """The newest eligible model becomes the only production model of its group; without one nothing changes."""
    group = Window.partitionBy("asset_class", "horizon_days")
    order = Window.partitionBy("asset_class", "horizon_days", "production_eligible").orderBy(F.desc("trained_at"), F.desc("version"))
    pick = F.col("production_eligible") & (F.row_number().over(order) == 1)
    any_eligible = F.max(F.col("production_eligible")).over(group)
    return models.withColumn("is_production", F.when(any_eligible, pick).otherwise(F.col("is_production")))


def registry_metrics(folds: DataFrame, by: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Fold mean of each metric, only where every fold has it; total sample count."""
    return folds.groupBy(*by).agg(
        *[F.when(F.count(c) == F.count(F.lit(1)), F.avg(c)).alias(c) for c in names],
        F.sum("sample_count").alias("sample_count"))


# --- issues and backfill -------------------------------------------------------------------------


def issue_log(open_issues: DataFrame, new: DataFrame, keys: Sequence[str] = ("asset_id", "code", "data_time")) -> DataFrame:
    """Open issues plus the new ones that are not already open under the same key."""
    pending = open_issues.where(~F.col("is_resolved")).select(*keys)
    fresh = new.dropDuplicates(list(keys)).join(pending, list(keys), "left_anti")
    return open_issues.unionByName(fresh, allowMissingColumns=True)


def backfill_missing(assets: DataFrame, available: DataFrame, target: Column, days: int, reach: int = 30) -> DataFrame:
    """(asset, snapshot_time, fetchable): days of the history window without an archive row.

    The calendar is generated per asset row; days beyond the live window cannot be fetched any more.
    """
    calendar = F.sequence(target - F.expr(f"INTERVAL {days - 1} DAY"), target, F.expr("INTERVAL 1 DAY"))
    grid = assets.select("asset_id", F.explode(calendar).alias("snapshot_time"))
    missing = grid.join(available.select("asset_id", "snapshot_time"), ["asset_id", "snapshot_time"], "left_anti")
    return missing.withColumn("fetchable", F.col("snapshot_time") >= target - F.expr(f"INTERVAL {reach - 1} DAY"))
