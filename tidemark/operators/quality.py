"""Bar and series quality checks; violations are data, not exceptions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import maths


def violation_codes(known: Column | None = None) -> Column:
    """Array of violated rule codes of one bar (UTC is carried by the type, so it needs no rule)."""
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    rules = [
        ("non_positive_price", (o <= 0) | (h <= 0) | (l <= 0) | (c <= 0)),
        ("invalid_ohlc", (h < F.greatest(o, c)) | (l > F.least(o, c)) | (h < l)),
        ("negative_activity", (F.col("volume") < 0) | (F.col("quote_volume") < 0) | (F.col("trade_count") < 0)),
        ("invalid_time_range", F.col("close_time") <= F.col("open_time")),
    ]
    if known is not None:
        rules.insert(0, ("unknown_symbol", ~known))
    return F.array_compact(F.array(*[F.when(test, F.lit(code)) for code, test in rules]))


def quality_bar(bars: DataFrame, assets: DataFrame, key: str = "asset_id") -> DataFrame:
    """Bars with their ``violations`` array; an asset missing from the dimension is an unknown symbol."""
    known = assets.select(key).distinct().withColumn("_known", F.lit(True))
    joined = bars.join(known, key, "left")
    return joined.withColumn("violations", violation_codes(F.coalesce(F.col("_known"), F.lit(False)))).drop("_known")


def accepted(checked: DataFrame) -> DataFrame:
    return checked.where(F.size("violations") == 0).drop("violations")


def rejected(checked: DataFrame) -> DataFrame:
    return checked.where(F.size("violations") > 0)


def quality_batch(bars: DataFrame, by: Sequence[str] = (), key: Sequence[str] = ("asset_id", "open_time"),
                  seq: str | None = None) -> DataFrame:
    """Counts of each file-level fault per ``by``; an empty input gives rows = 0.

    Duplicates are found by one count per key.  With ``seq``, the arrival order inside ``by`` (one file each), the
    rows whose time is before that of the previous arrival are counted as ``regressions``.
    """
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    per_key = bars.groupBy(*by, *key).agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if((o <= 0) | (h <= 0) | (l <= 0) | (c <= 0)).alias("_np"),
        F.count_if(h < F.greatest(o, c)).alias("_hi"), F.count_if(l > F.least(o, c)).alias("_lo"),
        F.count_if((F.col("volume") < 0) | (F.col("quote_volume") < 0) | (F.col("trade_count") < 0)).alias("_na"))
    counts = per_key.groupBy(*by).agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicates"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in
          (("_np", "non_positive"), ("_hi", "bad_high"), ("_lo", "bad_low"), ("_na", "negative_activity"))])
    if seq is None:
        return counts
    if len(by) != 1:
        raise ValueError("the time order is checked inside files: name one file column in by")
    return counts.join(time_regressions(bars, by[0], seq, key[-1]), by[0])


def time_regressions(bars: DataFrame, file: str, seq: str, time: str = "open_time") -> DataFrame:
    """(file, regressions): rows whose time is not after the previous row of the same file.

    A file is one archive member (a month of bars), which bounds the window.
    """
    prev = F.lag(time).over(Window.partitionBy(file).orderBy(seq))
    return (bars.withColumn("_p", prev).groupBy(file)
            .agg(F.count_if(F.col("_p").isNotNull() & (F.col(time) < F.col("_p"))).alias("regressions")))


def quality_finite(df: DataFrame, columns: Sequence[str], minimum: float | None = None, strict: bool = False,
                   by: Sequence[str] = ()) -> DataFrame:
    """Per column, how many values are missing, non-finite or outside the domain."""
    def bad(c: str) -> Column:
        test = maths.is_bad(F.col(c))
        if minimum is None:
            return test
        return test | ((F.col(c) <= minimum) if strict else (F.col(c) < minimum))
    return df.groupBy(*by).agg(*[F.count_if(bad(c)).alias(f"bad_{c}") for c in columns])
