"""Windows across assets at one moment; a partition holds one row per asset of the universe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def breadth(column: str, time: str, missing_counts: bool = False) -> Column:
    """Share of values above zero, 0.5 where none is defined.

    Research on sessions counts an undefined value as "not above zero" (``missing_counts``).
    """
    w = Window.partitionBy(time)
    up = (F.col(column) > 0).cast("double")
    up = F.coalesce(up, F.lit(0.0)) if missing_counts else up
    return F.least(F.greatest(F.coalesce(F.avg(up).over(w), F.lit(0.5)), F.lit(0.0)), F.lit(1.0))


def rank_cdf(column: str, time: str) -> Column:
    """Share of defined peers not above the value, itself included; 0.5 without peers."""
    c = F.col(column)
    upto = Window.partitionBy(time).orderBy(column).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    share = F.count(c).over(upto) / F.count(c).over(Window.partitionBy(time))
    return F.when(c.isNull(), F.lit(0.5)).otherwise(share)


def rank_avg(column: str, time: str) -> Column:
    """Average rank of ties divided by the number of defined values."""
    c = F.col(column)
    same = F.count(c).over(Window.partitionBy(time, column))
    upto = Window.partitionBy(time).orderBy(column).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.count(c).over(upto)
    return F.when(c.isNotNull(), (last - (same - 1) / 2) / F.count(c).over(Window.partitionBy(time)))


def eligible(df: DataFrame, cutoff: Column, min_rows: int = 61, key: str = "asset_id",
             time: str = "open_time") -> DataFrame:
    """Rows of assets that hold enough history and whose newest row sits on the cutoff."""
    good = (df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.max(time).alias("_last"))
            .where((F.col("_n") >= min_rows) & (F.col("_last") == cutoff)).select(key))
    return df.join(good, key, "left_semi")
