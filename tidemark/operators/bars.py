"""Bars: roll-ups, keyed upsert, latest rows, streaks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.times import floor_to, micros


def ohlc_aggregates(order: Column) -> list[Column]:
    return [
        F.min_by("open", order).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", order).alias("close"),
        *[F.sum(c).alias(c) for c in ("volume", "quote_volume", "trade_count", "taker_buy_base_volume")]]


def ohlc_daily(bars: DataFrame, shift: str = "1 DAY", order: Sequence[str] = ("open_time",),
               keys: Sequence[str] = ("asset_id",)) -> DataFrame:
    """UTC-day bars stamped when they become known (the next midnight); days without rows do not exist.

    First and last are order-sensitive aggregates, so the roll-up is one map-side combined shuffle.
    """
    rank = F.struct(*order) if len(order) > 1 else F.col(order[0])
    stamp = (floor_to(bars, "open_time") + F.expr(f"INTERVAL {shift}")).alias("_day")
    out = bars.groupBy(*keys, stamp).agg(*ohlc_aggregates(rank))
    return out.withColumnRenamed("_day", "open_time").dropna(subset=["open", "high", "low", "close"])


def ohlc_daily_complete(bars: DataFrame, n: int = 24, keys: Sequence[str] = ("asset_id",), hours: bool = True) -> DataFrame:
    """Only days with exactly ``n`` hourly bars on the hours 0..n-1, all closed before midnight."""
    day = floor_to(bars, "open_time")
    src = bars.withColumn("_day", day)
    offset = micros(F.col("open_time")) - micros(F.col("_day"))
    out = src.groupBy(*keys, "_day").agg(
        *ohlc_aggregates(F.col("open_time")), F.count(F.lit(1)).alias("_n"),
        F.count_distinct("open_time").alias("_h"), F.count_if(offset % 3_600_000_000 != 0).alias("_off"),
        F.max("close_time").alias("_close"))
    whole = (F.col("_n") == n) & (F.col("_h") == n) & (F.col("_off") == 0)
    in_time = F.col("_close") < F.col("_day") + F.expr("INTERVAL 1 DAY")
    return (out.where(whole & in_time).withColumn("open_time", F.col("_day") + F.expr("INTERVAL 1 DAY"))
            .drop("_day", "_n", "_h", "_off", "_close"))


# --- keyed upsert --------------------------------------------------------------------------------

BAR_KEY = ("asset_id", "open_time", "interval", "source")


def latest_wins(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the first under ``order``.  ``row_number <= 1`` is cut before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def upsert_bars(existing: DataFrame, incoming: DataFrame, keys: Sequence[str] = BAR_KEY, seq: str = "ingest_seq") -> DataFrame:
    """Merge by key: a final bar beats a non-final one, otherwise the later arrival wins.

    ``seq`` numbers the arrivals of ``incoming``; stored rows count as arrival -1.
    """
    stored = existing.withColumn("_seq", F.lit(-1).cast("long"))
    fresh = incoming.withColumn("_seq", F.col(seq).cast("long"))
    both = stored.unionByName(fresh, allowMissingColumns=True)
    out = latest_wins(both, keys, [F.desc("is_final"), F.desc("_seq")]).drop("_seq")
    return out.select(*existing.columns)


def upsert_last(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], seq: str = "ingest_seq") -> DataFrame:
    """Merge by key, the last write wins."""
    both = existing.withColumn("_seq", F.lit(-1).cast("long")).unionByName(
        incoming.withColumn("_seq", F.col(seq).cast("long")), allowMissingColumns=True)
    return latest_wins(both, keys, [F.desc("_seq")]).drop("_seq").select(*existing.columns)


# --- latest rows ---------------------------------------------------------------------------------


def latest_bar(bars: DataFrame, key: str = "asset_id", columns: Sequence[str] = ("close", "close_time"),
               tie: Sequence[str] = ()) -> DataFrame:
    """Newest final bar per asset by a combinable maximum (no sort of the asset's history)."""
    rank = F.struct("close_time", *tie)
    final = bars.where("is_final")
    return final.groupBy(key).agg(F.max_by(F.struct(*columns), rank).alias("_b")).select(key, "_b.*")


def last_n(df: DataFrame, n: int, key: str = "asset_id", order: Sequence[Column] | None = None) -> DataFrame:
    """Newest n rows per key; each task keeps at most n rows per key before shuffling."""
    if n < 1:
        raise ValueError("n must be at least 1")
    order = order or [F.desc("open_time")]
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)


def tail_rows(df: DataFrame, n: int, key: str = "asset_id", time: str = "open_time") -> DataFrame:
    return last_n(df, n, key, [F.desc(time)]).drop("rn")


def tail_days(df: DataFrame, cutoff: Column, days: int, time: str = "open_time") -> DataFrame:
    return df.where((F.col(time) >= cutoff - F.expr(f"INTERVAL {days} DAY")) & (F.col(time) < cutoff))


def price_change_24(bars: DataFrame, key: str = "asset_id", order: Sequence[Column] | None = None) -> DataFrame:
    """Newest of the last 25 bars against the oldest of them, in percent; needs 24 bars."""
    last = last_n(bars, 25, key, order or [F.desc("close_time")])
    out = last.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.min_by("close", "rn").alias("latest_close"),
        F.max_by("close", "rn").alias("_old"), F.min_by("close_time", "rn").alias("latest_time"))
    change = F.when((F.col("n") >= 24) & (F.col("_old") != 0), (F.col("latest_close") / F.col("_old") - 1) * 100)
    return out.withColumn("change_24", change).drop("_old")


def trailing_streak(df: DataFrame, key: str, time: str) -> DataFrame:
    """(key, last_day, days): length of the run of consecutive days that ends at the newest day.

    Days are made distinct first, so the window holds one row per calendar day.
    """
    days = df.select(key, F.to_date(time).alias("_d")).distinct()
    w = Window.partitionBy(key).orderBy("_d")
    island = days.withColumn("_isl", F.date_sub("_d", F.row_number().over(w)))
    runs = island.groupBy(key, "_isl").agg(F.count(F.lit(1)).alias("days"), F.max("_d").alias("last_day"))
    return runs.groupBy(key).agg(F.max("last_day").alias("last_day"), F.max_by("days", "last_day").alias("days"))


def filter_range(bars: DataFrame, symbol: str, interval: str | None = None, start=None, end=None) -> DataFrame:
    """Case-insensitive symbol, optional interval and inclusive bounds, all plain pushdown predicates."""
    out = bars.where(F.col("asset_id") == F.lit(symbol.upper()))
    if interval is not None:
        out = out.where(F.col("interval") == interval)
    if start is not None:
        out = out.where(F.col("open_time") >= start)
    if end is not None:
        out = out.where(F.col("open_time") <= end)
    return out


def recent_years(df: DataFrame, time: str, years: int, by: Sequence[str]) -> DataFrame:
    """Rows not older than k years before the newest row of the key."""
    newest = df.groupBy(*by).agg(F.max(time).alias("_newest"))
    start = F.add_months(F.to_date("_newest"), -12 * years).cast(df.schema[time].dataType)
    clock = micros(F.col("_newest")) - micros(F.date_trunc("day", F.col("_newest")))
    kept = df.join(newest, list(by)).where(micros(F.col(time)) >= micros(start) + clock)
    return kept.drop("_newest")
