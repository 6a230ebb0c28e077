"""Stored tables: filtered bar scans and unions of many files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scan_bars(bars: DataFrame, assets: DataFrame, asset_class: str, source: str, interval: str) -> DataFrame:
    """Final bars of one class, source and interval.

    All bar predicates reach the scan; the asset side is a filtered dimension that Spark broadcasts when
    its size allows.  Rows are ordered by the consumer's window, so no global sort is added.
    """
    wanted = assets.where((F.col("asset_class") == asset_class) & F.col("is_shadow_enabled")).select("asset_id", "symbol")
    kept = bars.where((F.col("source") == source) & (F.col("interval") == interval) & F.col("is_final"))
    return kept.join(wanted, "asset_id")


def load_bars(spark: SparkSession, path: str, asset: str | None = None) -> DataFrame:
    """All files of a dataset as one frame with one row per (asset, open_time)."""
    df = spark.read.option("recursiveFileLookup", True).parquet(path)
    if asset is not None:
        df = df.where(F.col("asset_id") == asset)
    return df.dropDuplicates(["asset_id", "open_time"])
