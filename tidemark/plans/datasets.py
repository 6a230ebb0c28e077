"""Dataset jobs: bars to labelled samples, and the derivative history seed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions.maths import NeutralBand
from tidemark.operators import bars as B
from tidemark.operators import derivatives as D
from tidemark.operators import features as FE
from tidemark.operators import gates as G
from tidemark.operators import labels as L
from tidemark.operators.relations import union_all
from tidemark.session import stage
from tidemark.sources.sinks import stamp_version


def build_crypto(hourly: DataFrame, deriv: DataFrame | None, benchmark: str = schemas.CRYPTO_BENCHMARK, symbols: Sequence[str] = schemas.CRYPTO_SYMBOLS,
                 horizons: Sequence[int] = schemas.HORIZONS, version: str = "crypto-daily-v2", order: Sequence[str] = ("open_time",),
                 band: NeutralBand = NeutralBand(), **limits) -> DataFrame:
    """Hourly bars and derivative days to samples for every horizon."""
    daily = stage(B.ohlc_daily(hourly, order=order))
    feats = stage(FE.crypto_snapshots(daily, deriv, benchmark, symbols, **limits))
    return stamp_version(union_all([L.attach_targets(feats, daily, h, 365, band=band) for h in horizons]), version)


def build_equity(bars: DataFrame, expected: DataFrame, benchmark: str = schemas.EQUITY_BENCHMARK, horizons: Sequence[int] = schemas.HORIZONS,
                 version: str = "us-equity-daily-v1", band: NeutralBand = NeutralBand(), **limits) -> DataFrame:
    """Session bars to samples; the job fails and names expected assets that have no bars."""
    daily = stage(bars)
    require_bars(daily, expected)
    feats = stage(FE.equity_snapshots(daily, benchmark, **limits))
    return label_equity(feats, daily, horizons, version, band)


def require_bars(daily: DataFrame, expected: DataFrame) -> None:
    """Fails and names expected assets that have no bars."""
    absent = expected.select("asset_id").join(daily.select("asset_id"), "asset_id", "left_anti")
    names = [r["asset_id"] for r in absent.orderBy("asset_id").collect()]
    if names:
        raise ValueError(f"no bars for: {', '.join(names)}")


def label_equity(feats: DataFrame, daily: DataFrame, horizons: Sequence[int] = schemas.HORIZONS, version: str = "us-equity-daily-v1",
                 band: NeutralBand = NeutralBand()) -> DataFrame:
    """Feature rows that have a label, for every horizon."""
    parts = [L.attach_targets(feats, daily, h, 252, "volatility_20s", "volatility_60s", band) for h in horizons]
    return stamp_version(union_all(parts), version)


def build_equity_macro(samples: DataFrame, benchmark: str = schemas.EQUITY_BENCHMARK) -> DataFrame:
    return FE.add_benchmark_macro(samples, benchmark)


def seed_history(assets: DataFrame, archive: DataFrame, live: DataFrame, stored: DataFrame, target: Column, days: int, reach: int = 30) -> DataFrame:
    """Stored snapshots after merging archive days and freshly assembled days of the history window.

    A day missing from the archive and older than the live window fails the job.
    """
    first = target - F.expr(f"INTERVAL {days - 1} DAY")
    window = F.col("snapshot_time").between(first, target)
    complete = archive.where(window).dropna(subset=list(schemas.DERIVATIVE_VALUES))
    missing = G.backfill_missing(assets, complete, target, days, reach)
    check = F.when(~F.col("fetchable"), F.raise_error(F.concat(F.col("asset_id"), F.lit(" misses a day outside the live window"))).cast("int"))
    wanted = missing.withColumn("_ok", F.coalesce(check, F.lit(1))).where("_ok = 1").select("asset_id", "snapshot_time")
    fresh = live.join(wanted, ["asset_id", "snapshot_time"], "left_semi")
    cols = ["asset_id", "snapshot_time", *schemas.DERIVATIVE_VALUES, "source"]
    stamped = complete.withColumn("source", F.lit("archive")).select(*cols).unionByName(fresh.withColumn("source", F.lit("live")).select(*cols))
    return B.upsert_last(stored.select(*cols), stamped.withColumn("ingest_seq", F.lit(0)), ["asset_id", "snapshot_time", "source"])


def collect_derivatives(series: Sequence[DataFrame], stored: DataFrame, assets: DataFrame, open_issues: DataFrame, cutoff: Column, now: Column) -> tuple[DataFrame, DataFrame]:
    """(new snapshots, issues): assemble the cutoff day of every asset not stored yet, log the ones that stay incomplete."""
    made = D.snapshot_assemble(*series).where(F.col("snapshot_time") == cutoff)
    fresh = made.join(stored.select("asset_id", "snapshot_time"), ["asset_id", "snapshot_time"], "left_anti").withColumn("available_at", now)
    have = stored.where(F.col("snapshot_time") == cutoff).select("asset_id").unionByName(fresh.select("asset_id"))
    late = assets.select("asset_id").join(have, "asset_id", "left_anti").select(
        "asset_id", F.lit("DERIVATIVE_CUTOFF_INCOMPLETE").alias("code"), cutoff.alias("data_time"), F.lit(False).alias("is_resolved"))
    return fresh, G.issue_log(open_issues, late)
