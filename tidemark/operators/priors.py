"""Class priors: global, conditional, time-decayed, shrunk, and their grid selection."""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import maths
from tidemark.functions.times import days_between

# Fixed values of the candidate grid.
GROUP_SETS = (
    (), ("market_regime",), ("spy_regime",), ("spy_regime", "market_regime"),
    ("asset_id", "spy_regime"), ("asset_id", "spy_regime", "market_regime"),
)
HALF_LIVES = (None, 730, 1460)
SHRINKAGES = (100.0, 500.0, 2000.0)
MIN_GAIN = 0.001


def class_prior(df: DataFrame, by: Sequence[str], prefix: str = "q") -> DataFrame:
    """Class frequencies per key."""
    return df.groupBy(*by).agg(*[F.avg(maths.hit(F.col("y"), k)).alias(f"{prefix}{k}") for k in range(3)])


def decay(age_days: Column, half_life: Column | float | None) -> Column:
    """exp(-ln 2 * age / half-life); 1 without a half-life."""
    if half_life is None:
        return F.lit(1.0)
    h = half_life if isinstance(half_life, Column) else F.lit(float(half_life))
    return F.when(h.isNull(), F.lit(1.0)).otherwise(F.exp(-math.log(2) * age_days / h))


def with_age(fit: DataFrame, by: Sequence[str], time: str = "snapshot_time") -> DataFrame:
    """Fractional days before the newest fit row of the key."""
    newest = fit.groupBy(*by).agg(F.max(time).alias("_newest"))
    return fit.join(newest, list(by)).withColumn("age_days", days_between(F.col("_newest"), F.col(time))).drop("_newest")


def weighted_counts(fit: DataFrame, by: Sequence[str], half_life: float | None, time: str = "snapshot_time",
                    within: Sequence[str] = ()) -> DataFrame:
    """Pivoted, decayed class weights w0..w2 per (within + by)."""
    if half_life is None:
        src, w = fit, F.lit(1.0)
    else:
        src = with_age(fit, within, time) if within else _aged_all(fit, time)
        w = decay(F.col("age_days"), half_life)
    return src.groupBy(*within, *by).agg(
        *[F.sum(F.when(F.col("y") == k, w).otherwise(0.0)).alias(f"w{k}") for k in range(3)])


def _aged_all(fit: DataFrame, time: str) -> DataFrame:
    newest = fit.agg(F.max(time)).scalar()
    return fit.withColumn("age_days", days_between(newest, F.col(time)))


def shrink(counts: DataFrame, prior: Sequence[Column], lam: Column | float) -> DataFrame:
    """(counts + lambda * prior) / (total + lambda) as columns q0..q2."""
    lam = lam if isinstance(lam, Column) else F.lit(float(lam))
    total = F.col("w0") + F.col("w1") + F.col("w2")
    return counts.withColumns({f"q{k}": (F.col(f"w{k}") + lam * prior[k]) / (total + lam) for k in range(3)})


def lookup(target: DataFrame, priors: DataFrame, groups: Sequence[str], fallback: DataFrame, by: Sequence[str]) -> DataFrame:
    """Group priors where the group was seen in the fit period, else the key's global prior.

    ``priors`` is unique per (by + groups); ``fallback`` is unique per ``by``.
    """
    keys = [*by, *groups]
    side = priors.select(*keys, *[F.col(f"q{k}").alias(f"_g{k}") for k in range(3)])
    whole = fallback.select(*by, *[F.col(f"q{k}").alias(f"_f{k}") for k in range(3)])
    out = target.join(side, keys, "left").join(whole, list(by), "left")
    missing = F.col("_g0").isNull() | F.col("_g1").isNull() | F.col("_g2").isNull()
    return out.withColumns({f"q{k}": F.when(missing, F.col(f"_f{k}")).otherwise(F.col(f"_g{k}")) for k in range(3)}).drop(
        *[f"_{s}{k}" for s in "gf" for k in range(3)])


def conditional_prior(fit: DataFrame, target: DataFrame, groups: Sequence[str], shrinkage: float,
                      half_life: float | None, by: Sequence[str], time: str = "snapshot_time") -> DataFrame:
    """Group-conditional prior of each target row, fitted per key of ``by`` (for example the fold)."""
    by, groups = list(by), list(groups)
    overall = weighted_counts(fit, [], half_life, time, by)
    total = F.col("w0") + F.col("w1") + F.col("w2")
    whole = overall.select(*by, *[(F.col(f"w{k}") / total).alias(f"q{k}") for k in range(3)])
    if not groups:
        return target.join(whole, by, "left")
    counts = weighted_counts(fit, groups, half_life, time, by)
    base = whole.select(*by, *[F.col(f"q{k}").alias(f"_b{k}") for k in range(3)])
    shrunk = shrink(counts.join(base, by), [F.col(f"_b{k}") for k in range(3)], shrinkage)
    return lookup(target, shrunk, groups, whole, by)


# --- grid selection ------------------------------------------------------------------------------


def candidates() -> list[tuple[int, int, int | None, float]]:
    """(index, group set, half-life, shrinkage) in search order: 3 global and 45 grouped."""
    out = []
    for g, groups in enumerate(GROUP_SETS):
        for half, lam in itertools.product(HALF_LIVES, (0.0,) if not groups else SHRINKAGES):
            out.append((len(out), g, half, lam))
    return out


def _group_keys() -> Column:
    """Array of (group set number, key text) of one row."""
    return F.array(*[
        F.struct(F.lit(i).alias("g"), F.concat_ws("|", F.lit(""), *[F.coalesce(F.col(c).cast("string"), F.lit("<null>")) for c in cols]).alias("key"))
        for i, cols in enumerate(GROUP_SETS)])


def _halves() -> Column:
    return F.array(*[F.struct(F.lit(i).alias("h"), F.lit(float(v) if v else None).cast("double").alias("half"))
                     for i, v in enumerate(HALF_LIVES)])


def candidate_counts(fit: DataFrame, time: str = "snapshot_time") -> DataFrame:
    """(fold, g, key, h, w0..w2): every count table of the grid in one map-side combined aggregate."""
    src = with_age(fit, ["fold"], time).select("fold", "y", "age_days", F.explode(_group_keys()).alias("_k"))
    src = src.select("fold", "y", "age_days", "_k.g", "_k.key", F.explode(_halves()).alias("_h"))
    w = decay(F.col("age_days"), F.col("_h.half"))
    return src.groupBy("fold", "g", "key", F.col("_h.h").alias("h")).agg(
        *[F.sum(F.when(F.col("y") == k, w).otherwise(0.0)).alias(f"w{k}") for k in range(3)])


def candidate_tables(fit: DataFrame, time: str = "snapshot_time") -> tuple[DataFrame, DataFrame]:
    """(fold, g, key, h, lam, idx, q0..q2) of all candidates, and (fold, h, f0..f2) global priors."""
    counts = candidate_counts(fit, time)
    total = F.col("w0") + F.col("w1") + F.col("w2")
    whole = counts.where("g = 0").select("fold", "h", *[(F.col(f"w{k}") / total).alias(f"f{k}") for k in range(3)])
    table = []
    for idx, g, half, lam in candidates():
        table.append(F.struct(F.lit(idx).alias("idx"), F.lit(g).alias("g"), F.lit(HALF_LIVES.index(half)).alias("h"), F.lit(lam).alias("lam")))
    rows = counts.join(whole, ["fold", "h"]).withColumn("_c", F.explode(F.filter(
        F.array(*table), lambda c: (c["g"] == F.col("g")) & (c["h"] == F.col("h")))))
    rows = rows.withColumns({"idx": F.col("_c.idx"), "lam": F.col("_c.lam")})
    shrunk = shrink(rows, [F.col(f"f{k}") for k in range(3)], F.col("lam"))
    return shrunk.select("fold", "g", "key", "h", "lam", "idx", "q0", "q1", "q2"), whole


def candidate_scores(fit: DataFrame, validation: DataFrame, time: str = "snapshot_time") -> DataFrame:
    """(fold, idx, g, h, lam, validation_brier).

    A candidate's probabilities depend on the group key only, so validation rows are first counted per
    (group set, key, label); the 48 candidates are then scored on those counts.
    """
    table, whole = candidate_tables(fit, time)
    seen = validation.select("fold", "y", F.explode(_group_keys()).alias("_k")).groupBy(
        "fold", "y", F.col("_k.g").alias("g"), F.col("_k.key").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    grid = F.array(*[F.struct(F.lit(i).alias("idx"), F.lit(g).alias("g"), F.lit(HALF_LIVES.index(hl)).alias("h"), F.lit(lam).alias("lam"))
                     for i, g, hl, lam in candidates()])
    rows = seen.withColumn("_c", F.explode(F.filter(grid, lambda c: c["g"] == F.col("g"))))
    rows = rows.select("fold", "g", "key", "y", "n", "_c.idx", "_c.h", "_c.lam")
    side = table.select("fold", "idx", "key", *[F.col(f"q{k}").alias(f"_q{k}") for k in range(3)])
    rows = rows.join(side, ["fold", "idx", "key"], "left").join(whole, ["fold", "h"])
    p = tuple(F.coalesce(F.col(f"_q{k}"), F.col(f"f{k}")) for k in range(3))
    loss = F.sum(F.col("n") * maths.row_brier(F.col("y"), p)) / F.sum("n")
    return rows.groupBy("fold", "idx", "g", "h", "lam").agg(loss.alias("validation_brier"))


def prior_select(fit: DataFrame, validation: DataFrame, time: str = "snapshot_time") -> DataFrame:
    """Chosen candidate per fold: the best one if it gains at least 0.001 over the best global prior."""
    scores = candidate_scores(fit, validation, time)
    me = F.struct("validation_brier", "idx", "g", "h", "lam")
    best = scores.groupBy("fold").agg(F.min(me).alias("_any"), F.min(F.when(F.col("g") == 0, me)).alias("_glob"))
    gain = F.col("_glob.validation_brier") - F.col("_any.validation_brier")
    pick = F.when(gain < MIN_GAIN, F.col("_glob")).otherwise(F.col("_any"))
    return best.withColumn("_p", pick).select(
        "fold", "_p.idx", "_p.g", "_p.h", F.col("_p.lam").alias("shrinkage"), "_p.validation_brier",
        F.col("_glob.validation_brier").alias("global_brier"))


def apply_selected(refit: DataFrame, target: DataFrame, chosen: DataFrame, time: str = "snapshot_time") -> DataFrame:
    """Prior of each target row under its fold's chosen candidate, refitted on ``refit``."""
    table, whole = candidate_tables(refit, time)
    keyed = target.join(chosen.select("fold", "idx", "g", "h"), "fold").withColumn(
        "key", F.element_at(F.transform(F.filter(_group_keys(), lambda s: s["g"] == F.col("g")), lambda s: s["key"]), 1))
    side = table.select("fold", "idx", "key", *[F.col(f"q{k}").alias(f"_q{k}") for k in range(3)])
    out = keyed.join(side, ["fold", "idx", "key"], "left").join(whole, ["fold", "h"])
    return out.withColumns({f"p{k}": F.coalesce(F.col(f"_q{k}"), F.col(f"f{k}")) for k in range(3)}).drop(
        "key", "h", "g", *[f"{s}{k}" for s in ("_q", "f") for k in range(3)])
