"""Exact order statistics without holding a group in one task.

A mergeable sketch gives each group's values at evenly spaced ranks, within a known error; two of them bracket every
wanted rank.  A second pass counts what lies below a bracket and orders only what lies inside, equal values once with
their count, which is a fixed small share of the group: neither a group with a third of all rows nor one whose values
lie close together needs a single-task sort.  A rank outside its bracket, which the error forbids, fails the job.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Rank = Callable[[Column], tuple[Column, Column, Column]]


def linear(q: float) -> Rank:
    """Linear interpolation between closest ranks."""
    def ranks(n: Column):
        h = (n - 1) * F.lit(float(q))
        return F.floor(h).cast("long"), F.ceil(h).cast("long"), h - F.floor(h)
    return ranks


def higher(level: float | Callable[[Column], Column]) -> Rank:
    def ranks(n: Column):
        q = level(n) if callable(level) else F.lit(float(level))
        r = F.ceil(q * (n - 1)).cast("long")
        return r, r, F.lit(0.0)
    return ranks


def nearest_rank(q: float) -> Rank:
    def ranks(n: Column):
        r = F.least(F.greatest(F.ceil(n * F.lit(float(q))) - 1, F.lit(0)), n - 1).cast("long")
        return r, r, F.lit(0.0)
    return ranks


STEPS = 512  # ranks that the sketch is asked for
ACCURACY = 10_000  # a rank is right within n / ACCURACY
ROOM = 8  # so many times that error is left on either side


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join in which missing keys are equal."""
    named = right.select(*[F.col(c).alias(f"_r_{c}" if c in keys else c) for c in right.columns])
    return left.join(named, [left[c].eqNullSafe(named[f"_r_{c}"]) for c in keys]).drop(*[f"_r_{c}" for c in keys])


def _bracket(low: Column, high: Column) -> Column:
    """Struct of the values that enclose the ranks from ``low`` to ``high``; no value where an end is open."""
    def place(rank: Column, shift: float) -> Column:
        return (rank / F.col("_n") + F.lit(shift)) * STEPS

    first = F.floor(place(low, -ROOM / ACCURACY)).cast("int")
    last = (F.ceil(place(high + 1, ROOM / ACCURACY))).cast("int")
    return F.struct(F.when(first > 0, F.get("_marks", first)).alias("a"), F.when(last < STEPS, F.get("_marks", last)).alias("b"))


def order_statistics(df: DataFrame, by: Sequence[str], value: str, specs: dict[str, Rank], count_name: str | None = None) -> DataFrame:
    """One row per group with one column per spec; NULL and NaN values are left out.  ``df`` is read twice."""
    by, names = list(by), list(specs)
    groups = by or ["_all"]
    src = df if by else df.withColumn("_all", F.lit(0))
    # + 0.0 folds the two zeros into one value.
    src = src.select(*groups, (F.col(value).cast("double") + F.lit(0.0)).alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    marks = src.groupBy(*groups).agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx("_v", [i / STEPS for i in range(STEPS + 1)], ACCURACY).alias("_marks"))
    ranks = {}
    for i, name in enumerate(names):
        low, high, share = specs[name](F.col("_n"))
        ranks |= {f"_lo{i}": low, f"_hi{i}": high, f"_fr{i}": share}
    marks = marks.withColumns(ranks).withColumns({f"_br{i}": _bracket(F.col(f"_lo{i}"), F.col(f"_hi{i}")) for i in range(len(names))}).drop("_marks")
    # For each wanted rank a value is below its bracket (and only counted), inside it, or of no use.
    uses = []
    for i in range(len(names)):
        a, b = F.col(f"_br{i}.a"), F.col(f"_br{i}.b")
        below = a.isNotNull() & (F.col("_v") < a)
        inside = (a.isNull() | (F.col("_v") >= a)) & (b.isNull() | (F.col("_v") <= b))
        uses.append(F.when(below | inside, F.struct(F.lit(i).alias("_k"), F.when(inside, F.col("_v")).alias("_w"))))
    kept = _same(src, marks, groups).select(*groups, "_n", *ranks, F.explode(F.array_compact(F.array(*uses))).alias("_u"))
    counts = kept.groupBy(*groups, "_n", *ranks, "_u._k", "_u._w").agg(F.count(F.lit(1)).alias("_c"))
    run = Window.partitionBy(*groups, "_k").orderBy("_w").rowsBetween(Window.unboundedPreceding, -1)
    spots = counts.withColumn("_s", F.coalesce(F.sum("_c").over(run), F.lit(0))).where(F.col("_w").isNotNull())
    aggs = [F.max(c).alias(c) for c in ("_n", *[r for r in ranks if r.startswith("_fr")])]
    for i in range(len(names)):
        for edge in ("lo", "hi"):
            r = F.col(f"_{edge}{i}")
            aggs.append(F.max(F.when((F.col("_k") == i) & (r >= F.col("_s")) & (r < F.col("_s") + F.col("_c")), F.col("_w"))).alias(f"_at_{edge}{i}"))
    out = spots.groupBy(*groups).agg(*aggs)
    lost = F.raise_error(F.lit("a rank lies outside its bracket")).cast("double")
    cols = []
    for i, n in enumerate(names):
        low, high = F.coalesce(F.col(f"_at_lo{i}"), lost), F.coalesce(F.col(f"_at_hi{i}"), lost)
        cols.append(F.when((low == high) | (F.col(f"_fr{i}") == 0), low).otherwise(low + (high - low) * F.col(f"_fr{i}")).alias(n))
    extra = [F.col("_n").alias(count_name)] if count_name else []
    return out.select(*by, *extra, *cols)
