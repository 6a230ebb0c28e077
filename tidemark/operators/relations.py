"""Join and set idioms of the research and reporting queries."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def prediction_rows(pred: DataFrame, assets: DataFrame, models: DataFrame, feats: DataFrame,
                    preview: bool = False) -> DataFrame:
    """Predictions with their asset, model and feature row, on the production channel or, in preview,
    also the shadow-candidate channel.  Dimension sides stay small and are broadcast by measured size."""
    channel = F.col("is_production") & ~F.col("is_shadow")
    if preview:
        channel = channel | (F.col("is_shadow_candidate") & F.col("is_shadow"))
    joined = pred.join(assets, "asset_id").join(models, "model_id")
    return joined.where(channel).join(feats, ["asset_id", "snapshot_time"])


def latest_analysis(joined: DataFrame, keys: Sequence[str] = ("asset_id", "horizon_days")) -> DataFrame:
    """Production first, then the newest analysis."""
    w = Window.partitionBy(*keys).orderBy(F.desc("is_production"), F.desc("analysis_time"), F.desc("model_id"))
    return joined.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fail inside the job when a many-to-one right side repeats a key; one row per key passes through."""
    others = [c for c in df.columns if c not in keys]
    grouped = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(*others)).alias("_r"))
    check = F.when(F.col("_n") > 1, F.raise_error(F.lit("duplicate key on the unique side of a join")).cast("int"))
    return grouped.withColumn("_n", F.coalesce(check, F.lit(1))).where("_n = 1").select(*keys, "_r.*")


def full_outer(frames: Sequence[DataFrame], on: Sequence[str]) -> DataFrame:
    return functools.reduce(lambda a, b: a.join(b, list(on), "full_outer"), frames)


def positional_pairs(asset: DataFrame, bench: DataFrame, n: int, key: str = "asset_id", time: str = "open_time",
                     value: str = "value") -> DataFrame:
    """(asset, pos, value, bench_value) for the newest n values of either side, paired from the tail."""
    def tail(df, keys, name):
        w = Window.partitionBy(*keys).orderBy(F.desc(time))
        return (df.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= n)
                .select(*[k for k in keys if k != "_one"], "pos", F.col(value).alias(name)))
    left = tail(asset, [key], value)
    right = tail(bench.withColumn("_one", F.lit(1)), ["_one"], "bench_value")
    return left.join(right, "pos")


def lookup_or_default(target: DataFrame, table: DataFrame, on: Sequence[str], defaults: dict[str, Column]) -> DataFrame:
    out = target.join(table, list(on), "left")
    return out.withColumns({c: F.coalesce(F.col(c), d) for c, d in defaults.items()})


def not_yet(new: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """New rows whose key is not stored yet."""
    return new.join(existing.select(*keys), list(keys), "left_anti")


def only_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key), key, "left_semi")


def missing_from_session(expected: DataFrame, received: DataFrame, reference: str, key: str = "symbol",
                         time: str = "open_time") -> DataFrame:
    """Expected symbols without a bar in the newest session (the reference symbol's newest, if it has one)."""
    up = F.upper(F.col(key))
    seen = received.select(up.alias("_s"), time)
    session = received.agg(F.coalesce(F.max(F.when(up == reference, F.col(time))), F.max(time))).scalar()
    current = seen.where(F.col(time) == session).select("_s").distinct()
    want = expected.select(F.upper(F.col(key)).alias("_s")).distinct()
    return want.join(current, "_s", "left_anti").select(F.col("_s").alias(key), session.alias("session"))


def missing_message(missing: DataFrame, key: str = "symbol") -> DataFrame:
    """One issue text; the list holds dimension members only."""
    names = F.array_join(F.array_sort(F.collect_list(key)), ", ")
    return missing.groupBy("session").agg(F.count(F.lit(1)).alias("missing"),
                                          F.concat(F.lit("Missing bar for: "), names).alias("description"))


def distinct_symbols(df: DataFrame, key: str = "symbol") -> DataFrame:
    return df.select(F.upper(F.col(key)).alias(key)).distinct()


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def pivot_counts(df: DataFrame, groups: Sequence[str], column: str, classes: Sequence, weight: Column | None = None) -> DataFrame:
    """Group x class table from a fixed class list, so no extra job finds the classes."""
    w = weight if weight is not None else F.lit(1.0)
    return df.groupBy(*groups).agg(
        *[F.coalesce(F.sum(F.when(F.col(column) == c, w)), F.lit(0.0)).alias(f"c_{c}") for c in classes])


def unpivot_features(df: DataFrame, ids: Sequence[str], names: Sequence[str]) -> DataFrame:
    return df.unpivot(list(ids), list(names), "feature", "value")


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
