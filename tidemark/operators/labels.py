"""Forward targets, purged walk-forward folds and inner splits."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import maths
from tidemark.functions.times import floor_to
from tidemark.operators.blocks import BLOCK, block_window, blocked, owned

KEY = "asset_id"


def with_drawdown(b: DataFrame, horizon: int, close: str = "close") -> DataFrame:
    """``_drawdown``: min(close / running max - 1) over the next ``horizon`` rows of a blocked frame.

    A window of that length lies in two stretches of it: the end of one and the start of the next.  Each row keeps the
    highest close and the drawdown of its stretch from it to the end, and the lowest close and the drawdown from the
    start to it; two of these make a window, so the work a row does not grow with the horizon.
    """
    out = b.withColumn("_hb", F.floor(F.col("_idx") / horizon))
    stretch = Window.partitionBy(KEY, "_blk", "_hb")
    ahead, back, v = stretch.orderBy("_idx"), stretch.orderBy(F.desc("_idx")), F.col(close)
    out = out.withColumns({"_head": F.max(v).over(ahead), "_low": F.min(v).over(ahead)}).withColumn("_fall", F.min(v / F.col("_head")).over(ahead))
    out = out.withColumns({"_top": F.max(v).over(back), "_floor": F.min(v).over(back)}).withColumn("_drop", F.min(F.col("_floor") / v).over(back))
    w = block_window((KEY,))
    first, last = F.lead(F.struct("_hb", "_top", "_drop"), 1).over(w), F.lead(F.struct("_hb", "_low", "_fall"), horizon).over(w)
    two = F.least(first["_drop"], last["_fall"], last["_low"] / first["_top"])
    worst = F.when(first["_hb"] == last["_hb"], last["_fall"]).otherwise(two)
    return out.withColumn("_drawdown", F.least(worst - 1, F.lit(0.0))).drop("_hb", "_head", "_low", "_fall", "_top", "_floor", "_drop")


def forward_targets(bars: DataFrame, horizon: int, ppy: int = 365, with_path: bool = True) -> DataFrame:
    """(asset, open_time) with return, volatility and drawdown over the next ``horizon`` rows.

    Volatility uses the returns inside t+1..t+h (the step into t+1 is left out); the drawdown's running
    maximum starts at t+1.  Rows without a full horizon are dropped.
    """
    b = blocked(bars.select(KEY, "open_time", "close"), [KEY], ["open_time"], lookback=1, lookahead=horizon, block=max(BLOCK, horizon))
    w = block_window((KEY,))
    if with_path:
        b = with_drawdown(b, horizon)
    b = b.withColumn("_r", F.ln(F.col("close") / F.lag("close", 1).over(w)))
    cols = {
        "target_return": F.ln(F.lead("close", horizon).over(w) / F.col("close")),
        "label_end_time": F.lead("open_time", horizon).over(w),
    }
    if with_path:
        std = F.stddev_samp("_r").over(w.rowsBetween(2, horizon)) if horizon > 1 else F.lit(0.0)
        cols["target_volatility"] = F.coalesce(std, F.lit(0.0)) * math.sqrt(ppy)
        cols["target_max_drawdown"] = F.col("_drawdown")
    out = owned(b.withColumns(cols)).where(F.col("label_end_time").isNotNull())
    return out.select(KEY, "open_time", *cols)


def attach_targets(features: DataFrame, bars: DataFrame, horizon: int, ppy: int = 365,
                   vol_short: str = "volatility_30d", vol_long: str = "volatility_90d",
                   band: maths.NeutralBand = maths.NeutralBand()) -> DataFrame:
    targets = forward_targets(bars, horizon, ppy).withColumnRenamed("open_time", "snapshot_time")
    df = features.join(targets, [KEY, "snapshot_time"])
    width = maths.neutral_band(F.col(vol_short), F.col(vol_long), horizon, ppy, band)
    return df.withColumn("neutral_band_threshold", width).withColumns({
        "target_direction": maths.direction(F.col("target_return"), F.col("neutral_band_threshold")),
        "label_volatility_30d": F.col(vol_short), "label_volatility_90d": F.col(vol_long),
        "horizon_days": F.lit(horizon),
    })


# --- folds ---------------------------------------------------------------------------------------


def label_end(df: DataFrame, time: str = "snapshot_time") -> Column:
    if "label_end_time" in df.columns:
        return F.col("label_end_time")
    if "horizon_days" in df.columns:
        return F.col(time) + F.make_dt_interval(F.col("horizon_days"))
    return F.col(time) + F.expr("INTERVAL 90 DAY")


def walk_forward(df: DataFrame, years: Sequence[int] = (2023, 2024, 2025), embargo_days: int = 7,
                 time: str = "snapshot_time", keep_incomplete: bool = False) -> DataFrame:
    """Rows with (fold, role): train / validation / test per test year, purged by label end.

    Each row computes its own role in every fold and is expanded over the folds it belongs to, so there
    is no join with a fold table.  Folds lacking a role are dropped.
    """
    kind = df.schema[time].dataType

    def at(text: str) -> Column:
        return F.lit(text).cast(kind)

    end, ts = label_end(df, time), F.col(time)
    gap = F.expr(f"INTERVAL {embargo_days} DAY")
    slots = []
    for y in years:
        v0, t0, t1 = at(f"{y - 1}-01-01"), at(f"{y}-01-01"), at(f"{y}-12-31 23:59:59")
        role = (F.when(end < v0 - gap, "train")
                .when((ts >= v0) & (end < t0 - gap), "validation")
                .when((ts >= t0) & (ts <= t1), "test"))
        slots.append(F.struct(F.lit(f"wf-{y}").alias("fold"), role.alias("role")))
    slot = F.filter(F.array(*slots), lambda s: s["role"].isNotNull())
    out = df.withColumn("_slot", F.explode(slot)).select(*df.columns, "_slot.fold", "_slot.role")
    if keep_incomplete:
        return out
    whole = out.groupBy("fold").agg(F.count_distinct("role").alias("_k")).where("_k = 3").select("fold")
    return out.join(whole, "fold", "left_semi")


def inner_calibration(df: DataFrame, time: str = "snapshot_time", share: float = 0.67, by: Sequence[str] = ("fold",),
                      embargo_days: int = 7) -> DataFrame:
    """Chronological fit / selection halves of the validation rows, purged before the selection start.

    The boundary is the date at position floor(n_dates * share); dates per fold follow the calendar.
    """
    by = list(by)
    day = floor_to(df, time).alias("_d")
    dates = df.select(*by, day).distinct()
    order = Window.partitionBy(*by).orderBy("_d")
    marked = dates.withColumns({"_k": F.row_number().over(order) - 1, "_n": F.count("_d").over(Window.partitionBy(*by))})
    starts = marked.where((F.col("_k") == F.floor(F.col("_n") * share)) & (F.col("_n") >= 4)).select(
        *by, F.col("_d").alias("selection_start"))
    part = (F.when(F.col(time) >= F.col("selection_start"), "selection")
            .when(label_end(df, time) < F.col("selection_start") - F.expr(f"INTERVAL {embargo_days} DAY"), "fit"))
    # A row for each key: dealt by the few keys instead, a fold's rows would all meet in one task.
    return df.join(F.broadcast(starts), by).withColumn("part", part).where(F.col("part").isNotNull())


def inner_year(train: DataFrame, by: Sequence[str] = ("fold",), time: str = "snapshot_time", min_fit: int = 500,
               min_selection: int = 100, embargo_days: int = 7) -> DataFrame:
    """Final training year as the selection set; folds with too few rows are dropped."""
    by = list(by)
    last = train.groupBy(*by).agg(F.max(F.year(time)).alias("_y"))
    start = F.make_date(F.col("_y"), F.lit(1), F.lit(1)).cast(train.schema[time].dataType)
    part = (F.when(F.col(time) >= start, "selection")
            .when(label_end(train, time) < start - F.expr(f"INTERVAL {embargo_days} DAY"), "fit"))
    out = train.join(last, by).withColumn("part", part).where(F.col("part").isNotNull()).drop("_y")
    good = (out.groupBy(*by).agg(F.count_if(F.col("part") == "fit").alias("_f"),
                                 F.count_if(F.col("part") == "selection").alias("_s"))
            .where((F.col("_f") >= min_fit) & (F.col("_s") >= min_selection)).select(*by))
    return out.join(good, by, "left_semi")
