"""Long ordered series in bounded pieces.

A window partitioned by asset alone gives one task per asset, and one asset may hold a third of all
rows.  Two primitives keep every window partition bounded while the result stays exact:

* ``blocked``  - rows get their true position inside the key, are cut into blocks of fixed length, and
  each block also receives the neighbouring rows that its row frames reach (the halo).
* ``carry_forward`` - "last known value" inside (key, period), joined with the value carried in from
  earlier periods, which is computed on the per-period summary only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1024


def index_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], period: str = "month",
               name: str = "_idx") -> DataFrame:
    """0-based position of every row inside its key, ordered by ``order`` (its first entry is the time).

    The input is read twice, once for the size of each (key, period): stage it when it is costly.  Rows of one (key,
    period) are sorted in one task; choose the period by the rate of rows.  A missing key is a key of its own, and
    rows without a time come first in theirs.
    """
    keys = list(keys)
    df = df.withColumn("_per", F.date_trunc(period, F.col(order[0]).cast("timestamp")))
    sizes = df.groupBy(*keys, "_per").agg(F.count(F.lit(1)).alias("_sz"))
    before = Window.partitionBy(*keys).orderBy("_per").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*keys, "_per", F.coalesce(F.sum("_sz").over(before), F.lit(0)).alias("_off"))
    inner = Window.partitionBy(*keys, "_per").orderBy(*order)
    ranked = df.withColumn("_rn", F.row_number().over(inner))
    named = sizes.select(*[F.col(c).alias(f"_k_{c}") for c in [*keys, "_per"]], "_off")
    same = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in [*keys, "_per"]]
    return (ranked.join(named, same)
            .withColumn(name, F.col("_rn") + F.col("_off") - 1)
            .drop("_rn", "_off", "_per", *[f"_k_{c}" for c in [*keys, "_per"]]))


def blocked(df: DataFrame, keys: Sequence[str], order: Sequence[str], lookback: int, lookahead: int = 0,
            block: int = BLOCK, period: str = "month", indexed: bool = False) -> DataFrame:
    """Rows with ``_idx``, ``_blk`` and ``_own``; halo copies have ``_own`` false and are dropped by ``owned``."""
    df = df if indexed else index_rows(df, keys, order, period)
    first = F.greatest(F.floor((F.col("_idx") - lookahead) / block), F.lit(0)).cast("long")
    last = F.floor((F.col("_idx") + lookback) / block).cast("long")
    out = (df.withColumn("_blk", F.explode(F.sequence(first, last)))
           .withColumn("_own", F.col("_blk") == F.floor(F.col("_idx") / block)))
    # Frame windows are CPU-bound: keep the configured parallelism where small bytes would be merged.
    return out.repartition(parallelism(df), *keys, "_blk")


def block_window(keys: Sequence[str]):
    return Window.partitionBy(*keys, "_blk").orderBy("_idx")


def owned(df: DataFrame) -> DataFrame:
    return df.where("_own").drop("_own", "_blk")


def parallelism(df: DataFrame) -> int:
    """Partitions for CPU-bound stages: the session's shuffle setting, or its larger AQE start value."""
    conf = df.sparkSession.conf
    start = conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None)
    return max(int(conf.get("spark.sql.shuffle.partitions")), int(start or 0))


def carry_forward(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str],
                  period: str = "month") -> DataFrame:
    """Replace every NULL in ``columns`` by the last earlier non-NULL value inside the key."""
    keys, order = list(keys), list(order)
    df = df.withColumn("_per", F.date_trunc(period, F.col(order[0]).cast("timestamp")))
    rank = F.struct(*order)
    ends = df.groupBy(*keys, "_per").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), rank)).alias(c) for c in columns])
    earlier = Window.partitionBy(*keys).orderBy("_per").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(
        *keys, "_per", *[F.last(c, ignorenulls=True).over(earlier).alias(f"_in_{c}") for c in columns])
    so_far = Window.partitionBy(*keys, "_per").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = df.withColumns({c: F.last(c, ignorenulls=True).over(so_far) for c in columns})
    return (local.join(carried, [*keys, "_per"], "left")
            .withColumns({c: F.coalesce(F.col(c), F.col(f"_in_{c}")) for c in columns})
            .drop("_per", *[f"_in_{c}" for c in columns]))
