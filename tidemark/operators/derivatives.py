"""Derivative market data: daily roll-ups, snapshot assembly and trailing features."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.maths import finite_or, is_bad
from tidemark.functions.times import floor_to, micros
from tidemark.operators.asof import join_asof
from tidemark.operators.blocks import block_window, blocked, carry_forward, index_rows, owned
from tidemark.session import stage
from tidemark.schemas import DERIVATIVE_FEATURES, DERIVATIVE_VALUES

DAY = "INTERVAL 1 DAY"


def _day(df: DataFrame, time: str) -> Column:
    return (floor_to(df, time) + F.expr(DAY)).alias("snapshot_time")


def kline_daily(klines: DataFrame, prefix: str) -> DataFrame:
    return klines.groupBy("asset_id", _day(klines, "open_time")).agg(
        F.max_by("close", "open_time").alias(f"{prefix}_close"),
        F.sum("quote_volume").alias(f"{prefix}_quote_volume"),
        F.sum("volume").alias(f"{prefix}_volume"),
        F.sum("taker_buy_base_volume").alias(f"{prefix}_taker_buy_volume"))


def funding_daily(funding: DataFrame) -> DataFrame:
    return funding.groupBy("asset_id", _day(funding, "calc_time")).agg(F.avg("last_funding_rate").alias("funding_rate"))


def metrics_daily(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("asset_id", _day(metrics, "create_time")).agg(
        F.max_by("sum_open_interest_value", "create_time").alias("open_interest_value"),
        F.avg("count_long_short_ratio").alias("long_short_ratio"),
        F.avg("sum_taker_long_short_vol_ratio").alias("taker_long_short_ratio"))


def taker_ratio(taker: Column, volume: Column) -> Column:
    return F.when(volume > 0, taker / volume).otherwise(F.lit(0.5))


def consolidate(*frames: DataFrame, keys: Sequence[str] = ("asset_id", "snapshot_time"),
                columns: Sequence[str] = DERIVATIVE_VALUES) -> DataFrame:
    """Full outer join of daily tables with every expected column present.

    Each input is unique per key, so one union and one grouped max equal the chain of outer joins
    and cost a single shuffle.
    """
    keys = list(keys)
    stacked = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    have = set(stacked.columns)
    out = stacked.groupBy(*keys).agg(*[F.max(c).alias(c) for c in columns if c in have])
    return out.select(*keys, *[F.col(c) if c in have else F.lit(None).cast("double").alias(c) for c in columns])


# --- one-day assembly ----------------------------------------------------------------------------


def _on_grid(step: str, n: int, time: str, day: str) -> tuple[list[Column], Column]:
    """Aggregates of a series and whether they make ``n`` points on the fixed grid that starts at ``day``."""
    unit = {"hour": 3_600_000_000, "5min": 300_000_000}[step]
    offset = micros(F.col(time)) - micros(F.col(day))
    on_grid = (offset % unit == 0) & (offset >= 0) & (offset < unit * n)
    aggs = [F.count(F.lit(1)).alias("points"), F.count_distinct(time).alias("distinct_points"), F.count_if(~on_grid).alias("off_grid")]
    return aggs, (F.col("points") == n) & (F.col("distinct_points") == n) & (F.col("off_grid") == 0)


def grid_check(series: DataFrame, step: str, n: int, keys: Sequence[str] = ("asset_id", "day"),
               time: str = "time", day: str = "day") -> DataFrame:
    """Does each key hold exactly ``n`` points on the fixed grid that starts at ``day``?"""
    aggs, ok = _on_grid(step, n, time, day)
    return series.groupBy(*keys).agg(*aggs).withColumns({
        "ok": ok, "reason": F.when(F.col("points") != n, "count").when(~ok, "gap").otherwise("")})


def window_check(series: DataFrame, start: str, cutoff: str, keys: Sequence[str], time: str = "time") -> DataFrame:
    outside = (F.col(time) < F.col(start)) | (F.col(time) >= F.col(cutoff))
    return (series.groupBy(*keys).agg(F.count(time).alias("points"), F.count_if(outside).alias("outside"))
            .withColumn("ok", (F.col("points") > 0) & (F.col("outside") == 0)))


def _finite_bad(c: str, minimum: float | None, strict: bool) -> Column:
    bad = is_bad(F.col(c))
    if minimum is None:
        return bad
    return bad | ((F.col(c) <= minimum) if strict else (F.col(c) < minimum))


def _identity(cols: Sequence[str]) -> Column:
    """Ordered text of one series; only ever evaluated on days that passed the grid check."""
    return F.concat_ws("|", F.transform(F.array_sort(F.collect_list(F.struct(*cols))),
                                        lambda s: F.concat_ws(":", *[s[c].cast("string") for c in cols])))


def snapshot_assemble(futures: DataFrame, premium: DataFrame, funding: DataFrame, open_interest: DataFrame,
                      long_short: DataFrame, taker_long_short: DataFrame) -> DataFrame:
    """One complete derivative snapshot per (asset, UTC day); days with a broken grid are rejected.

    ``futures``/``premium`` carry open_time, close_time and values; the others (time, value).  Values and grids are
    checked by bounded aggregates first, in one grouping of each series; only days that pass are hashed, so each
    collected list holds exactly 24 or 288 points.  Funding has no grid: its list is as long as the asset's day.
    """
    keys = ["asset_id", "day"]

    def shape(df: DataFrame, time: str, cols: Sequence[str]) -> DataFrame:
        return df.select("asset_id", floor_to(df, time).alias("day"), F.col(time).alias("time"), *cols)

    def part(df: DataFrame, tag: str, n: int | None, step: str | None, value_checks, aggs, id_cols, cutoff_col=None):
        bad = functools.reduce(lambda a, b: a | b, value_checks)
        if cutoff_col:
            bad = bad | (F.col(cutoff_col) >= F.col("day") + F.expr(DAY))
        grid, whole = _on_grid(step, n, "time", "day") if n else ([], F.lit(True))
        good = df.groupBy(*keys).agg(F.count_if(bad).alias("_bad"), *grid).where((F.col("_bad") == 0) & whole).select(*keys)
        kept = df.join(good, keys, "left_semi")
        return kept.groupBy(*keys).agg(
            F.count(F.lit(1)).alias(f"{tag}_count"), *aggs,
            F.max(cutoff_col or "time").alias(f"_max_{tag}"), _identity(id_cols).alias(f"_id_{tag}"))

    fut = shape(futures, "open_time", ["close_time", "volume", "quote_volume", "taker_buy_base_volume"])
    pre = shape(premium, "open_time", ["close_time", "value"])
    series = [shape(s, "time", ["value"]) for s in (funding, open_interest, long_short, taker_long_short)]
    parts = [
        part(fut, "futures_kline", 24, "hour",
             [_finite_bad(c, 0.0, False) for c in ("volume", "quote_volume", "taker_buy_base_volume")],
             [F.sum("quote_volume").alias("futures_quote_volume"), F.sum("volume").alias("_vol"),
              F.sum("taker_buy_base_volume").alias("_taker")],
             ["time", "volume", "quote_volume", "taker_buy_base_volume"], "close_time"),
        part(pre, "premium_kline", 24, "hour", [_finite_bad("value", None, False)],
             [F.max_by("value", "time").alias("premium")], ["time", "value"], "close_time"),
        part(series[0], "funding_point", None, None, [_finite_bad("value", None, False)],
             [F.avg("value").alias("funding_rate")], ["time", "value"]),
        part(series[1], "open_interest_point", 288, "5min", [_finite_bad("value", 0.0, True)],
             [F.max_by("value", "time").alias("open_interest_value")], ["time", "value"]),
        part(series[2], "long_short_point", 288, "5min", [_finite_bad("value", 0.0, True)],
             [F.avg("value").alias("long_short_ratio")], ["time", "value"]),
        part(series[3], "taker_long_short_point", 288, "5min", [_finite_bad("value", 0.0, True)],
             [F.avg("value").alias("taker_long_short_ratio")], ["time", "value"]),
    ]
    tags = ("futures_kline", "premium_kline", "funding_point", "open_interest_point", "long_short_point",
            "taker_long_short_point")
    joined = functools.reduce(lambda a, b: a.join(b, keys), parts)
    ratio = F.when(F.col("_vol") == 0, F.lit(0.5)).otherwise(F.col("_taker") / F.col("_vol"))
    return (joined.withColumn("futures_taker_buy_ratio", ratio)
            .where(F.col("futures_taker_buy_ratio").between(0, 1))
            .select(
                "asset_id", (F.col("day") + F.expr(DAY)).alias("snapshot_time"), *DERIVATIVE_VALUES,
                *[f"{t}_count" for t in tags],
                F.greatest(*[f"_max_{t}" for t in tags]).alias("source_max_event_time"),
                F.lit(True).alias("is_complete"),
                F.sha2(F.concat_ws("|", F.col("day").cast("string"), *[F.col(f"_id_{t}") for t in tags]), 256)
                .alias("source_checksum")))


# --- trailing features ---------------------------------------------------------------------------

# output, measure, kind, window, value where the measure has no history yet
FEATURE_RULES = (
    ("funding_rate_mean_7d", "funding_rate", "mean", 7, 0.0),
    ("funding_rate_mean_30d", "funding_rate", "mean", 30, 0.0),
    ("funding_rate_zscore_90d", "funding_rate", "z", 90, 0.0),
    ("premium_mean_7d", "premium", "mean", 7, 0.0),
    ("premium_mean_30d", "premium", "mean", 30, 0.0),
    ("premium_zscore_90d", "premium", "z", 90, 0.0),
    ("futures_volume_zscore_30d", "futures_quote_volume", "z", 30, 0.0),
    ("futures_taker_buy_ratio_7d", "futures_taker_buy_ratio", "mean", 7, 0.5),
    ("open_interest_change_7d", "open_interest_value", "log", 7, 0.0),
    ("open_interest_change_30d", "open_interest_value", "log", 30, 0.0),
    ("open_interest_zscore_90d", "open_interest_value", "z", 90, 0.0),
    ("futures_long_short_ratio_7d", "long_short_ratio", "mean", 7, 1.0),
    ("futures_taker_long_short_ratio_7d", "taker_long_short_ratio", "mean", 7, 1.0),
)


def trailing_stat(kind: str, n: int) -> Column:
    """Over the block window of one measure's non-missing values (column ``value``)."""
    w = block_window(("asset_id", "measure"))
    rows = w.rowsBetween(1 - n, 0)
    if kind == "mean":
        return F.avg("value").over(rows)
    if kind == "z":
        std = F.stddev_samp("value").over(rows)
        z = (F.col("value") - F.avg("value").over(rows)) / std
        return F.when((F.count("value").over(rows) < 10) | (std == 0), F.lit(0.0)).otherwise(z)
    old = F.lag("value", n).over(w)
    return F.when(old.isNull() | (old <= 0) | (F.col("value") <= 0), F.lit(0.0)).otherwise(F.ln(F.col("value") / old))


def measure_stats(deriv: DataFrame, rules=FEATURE_RULES) -> DataFrame:
    """(asset, snapshot_time, one column per rule) on the rows where the rule's measure is present."""
    measures = list(dict.fromkeys(r[1] for r in rules))
    long = (deriv.unpivot(["asset_id", "snapshot_time"], measures, "measure", "value")
            .where(F.col("value").isNotNull() & ~F.isnan("value")))
    b = blocked(long, ["asset_id", "measure"], ["snapshot_time"], lookback=max(r[3] for r in rules))
    kinds = {f"_{k}{n}": trailing_stat(k, n) for _, _, k, n, _ in rules}
    stats = owned(b.withColumns(kinds))
    return stats.groupBy("asset_id", "snapshot_time").agg(
        *[F.max(F.when(F.col("measure") == m, F.col(f"_{k}{n}"))).alias(name) for name, m, k, n, _ in rules])


def availability(deriv: DataFrame) -> DataFrame:
    """derivatives_available per row: 30 rows within reach, oldest at least 29 days old, newest complete."""
    required = ["funding_rate", "premium", "futures_quote_volume", "open_interest_value"]
    b = blocked(deriv, ["asset_id"], ["snapshot_time"], lookback=30)
    old = F.lag("snapshot_time", 29).over(block_window(("asset_id",)))
    complete = functools.reduce(lambda a, c: a & c, [F.col(c).isNotNull() & ~F.isnan(c) for c in required])
    aged = micros(F.col("snapshot_time")) - micros(old) >= 29 * 86_400_000_000
    flag = F.when(old.isNotNull() & aged & complete, F.lit(1.0)).otherwise(F.lit(0.0))
    return owned(b.withColumn("derivatives_available", flag)).drop("_idx")


def derivative_features(deriv: DataFrame, rules=FEATURE_RULES) -> DataFrame:
    """Feature row at every derivative snapshot, each rule over its measure's own non-missing tail."""
    names = [r[0] for r in rules]
    rows = availability(deriv).select("asset_id", "snapshot_time", "derivatives_available")
    wide = rows.join(measure_stats(deriv, rules), ["asset_id", "snapshot_time"], "left")
    filled = carry_forward(wide, ["asset_id"], ["snapshot_time"], names, "year")
    return filled.select("asset_id", "snapshot_time",
                         *[F.coalesce(F.col(r[0]), F.lit(r[4])).alias(r[0]) for r in rules],
                         "derivatives_available")


def attach_derivatives(snapshots: DataFrame, deriv: DataFrame, time: str = "snapshot_time") -> DataFrame:
    """As-of the derivative features of the last day not after each snapshot; 0 without history."""
    feats = stage(derivative_features(stage(deriv))).withColumnRenamed("snapshot_time", "_deriv_time")
    out = join_asof(snapshots, feats, time, "_deriv_time", ["asset_id"], list(DERIVATIVE_FEATURES), "year")
    return out.withColumns({c: finite_or(F.col(c)) for c in DERIVATIVE_FEATURES})
