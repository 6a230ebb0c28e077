"""Paired circular block bootstrap as table arithmetic.

A resample is a list of block starts.  The sum over a block is read from a prefix-free lookup: for every
(fold, start) the circular sum of the next ``block`` differences (and of the shorter last block) is
computed once with a bounded row frame.  A resample then joins one row per block instead of one per day.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import stage


def paired_difference(baseline: DataFrame, candidate: DataFrame, time: str = "snapshot_time", by: Sequence[str] = ()) -> DataFrame:
    """(by, fold, position, n, diff): candidate minus baseline daily loss, ordered by day inside each fold.

    ``by`` names further keys of the candidate, each compared with the same baseline.  The result, one row per day,
    is written out once, for it is read several times.
    """
    both = candidate.select(*by, "fold", time, F.col("loss").alias("_c")).join(
        baseline.select("fold", time, F.col("loss").alias("_b")), ["fold", time])
    keys = [*by, "fold"]
    days = Window.partitionBy(*keys)  # a fold's days follow the calendar
    rows = both.withColumns({"position": F.row_number().over(days.orderBy(time)) - 1, "n": F.count(F.lit(1)).over(days)})
    return stage(rows.select(*keys, "position", "n", (F.col("_c") - F.col("_b")).alias("diff")))


def block_sums(diff: DataFrame, block: int, by: Sequence[str] = ()) -> DataFrame:
    """(by, fold, start, n, full_sum, tail_sum) over the circular series.

    The series is a fold's daily losses, so its length follows the calendar.  It is extended past the end by at most one block (repeatedly when
    the fold is shorter than a block).
    """
    laps = F.floor((F.lit(block) + F.col("n") - 1) / F.col("n"))
    wrapped = diff.withColumn("_lap", F.explode(F.sequence(F.lit(0).cast("long"), laps.cast("long"))))
    wrapped = wrapped.withColumn("_pos", F.col("position") + F.col("_lap") * F.col("n"))
    wrapped = wrapped.where(F.col("_pos") < F.col("n") + block)
    order = Window.partitionBy(*by, "fold").orderBy("_pos")
    whole = F.sum("diff").over(order.rowsBetween(0, block - 1))
    rest = F.col("n") % block
    ahead = F.collect_list("diff").over(order.rowsBetween(0, block - 1))
    tail = F.when(rest == 0, F.lit(0.0)).otherwise(
        F.aggregate(F.slice(ahead, F.lit(1), rest.cast("int")), F.lit(0.0), lambda a, v: a + v))
    out = wrapped.withColumns({"full_sum": whole, "tail_sum": tail}).where(F.col("_lap") == 0)
    return out.select(*by, "fold", F.col("position").alias("start"), "n", "full_sum", "tail_sum")


def draw(seed: int, iteration: Column, fold: Column, block_no: Column, n: Column) -> Column:
    """Deterministic block start in [0, n): the leading 32 bits of a digest."""
    text = F.concat_ws(":", F.lit(str(seed)), iteration.cast("string"), fold, block_no.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % n


def resample_index(diff: DataFrame, block: int, iterations: int = 2000, seed: int = 17, by: Sequence[str] = ()) -> DataFrame:
    """(by, iteration, fold, block_no, n, start, short): which blocks each resample takes from each fold.

    The draws depend on the fold alone, so that all series of a fold are resampled alike.
    """
    folds = diff.select(*by, "fold", "n").distinct()
    rows = folds.select(*by, "fold", "n", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))).alias("iteration"))
    blocks = F.ceil(F.col("n") / block).cast("int")
    rows = rows.withColumn("blocks", blocks).withColumn("block_no", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.select(
        *by, "iteration", "fold", "block_no", "n",
        draw(seed, F.col("iteration"), F.col("fold"), F.col("block_no"), F.col("n")).alias("start"),
        ((F.col("block_no") == F.col("blocks") - 1) & (F.col("n") % block != 0)).alias("short"))


def iteration_means(diff: DataFrame, block: int, iterations: int = 2000, seed: int = 17, by: Sequence[str] = ()) -> DataFrame:
    """Mean difference of every resample; folds are resampled independently and pooled."""
    index = resample_index(diff, block, iterations, seed, by)
    hit = index.join(block_sums(diff, block, by).drop("n"), [*by, "fold", "start"])
    part = F.when(F.col("short"), F.col("tail_sum")).otherwise(F.col("full_sum"))
    size = F.when(F.col("short"), F.col("n") % block).otherwise(F.lit(block))
    return hit.groupBy(*by, "iteration").agg((F.sum(part) / F.sum(size)).alias("mean_difference"))


def block_bootstrap(diff: DataFrame, block: int, iterations: int = 2000, seed: int = 17,
                    level: float = 0.95, by: Sequence[str] = ()) -> DataFrame:
    """One row per series with the confidence interval; the quantile input has exactly ``iterations`` rows."""
    side = (1 - level) / 2
    means = iteration_means(diff, block, iterations, seed, by)
    return means.groupBy(*by).agg(F.percentile("mean_difference", F.lit(side)).alias("ci_lower"),
                                  F.percentile("mean_difference", F.lit(1 - side)).alias("ci_upper"),
                                  F.count(F.lit(1)).alias("iterations"))
