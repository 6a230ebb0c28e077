"""Backward as-of joins: one shuffle by (key, period), no pair explosion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.blocks import block_window, blocked, index_rows, owned


ROWS_PER_TASK = 500_000


def join_asof(left: DataFrame, right: DataFrame, left_time: str, right_time: str, by: Sequence[str] = (),
              values: Sequence[str] | None = None, period: str = "month", pick: str = "_match",
              rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Every left row with the newest right row whose time is not after it (equal times match).

    Both sides are merged inside (by, period) and the newest right payload is carried down the rows.
    Earlier periods arrive through their last right row only.  A (by, period) with many left rows is
    split by a row hash into as many parts as its count asks for, and only there the right rows are
    repeated, so neither a hot key nor a missing key puts more than ``rows_per_task`` in one window.
    """
    by = list(by)
    values = list(values or [c for c in right.columns if c not in by])
    if not by:
        return _asof_by_time(left, right, left_time, right_time, values, period, pick, rows_per_task)
    keys = by
    keep = [c for c in left.columns if c not in keys]
    t, per = F.col("_t"), F.date_trunc(period, F.col("_t")).alias("_per")
    slot = [*keys, "_per"]
    r = right.select(*keys, F.col(right_time).cast("timestamp").alias("_t"), F.struct(*values).alias(pick)).where(t.isNotNull())
    r = r.groupBy(*keys, "_t").agg(F.max(pick).alias(pick)).withColumn("_per", per)
    l = left.select(*keys, F.col(left_time).cast("timestamp").alias("_t"), F.struct(*keep).alias("_row")).where(t.isNotNull())
    l = l.withColumn("_per", per)
    # Per (by, period): how many parts, and the value carried in from the newest earlier period.
    ends = r.groupBy(*slot).agg(F.max_by(pick, "_t").alias("_end"))
    spans = _join_slots(l.groupBy(*slot).agg(F.count(F.lit(1)).alias("_n")), ends, slot, "full_outer")
    earlier = Window.partitionBy(*keys).orderBy("_per").rowsBetween(Window.unboundedPreceding, -1)
    parts = F.greatest(F.ceil(F.coalesce("_n", F.lit(0)) / rows_per_task), F.lit(1)).cast("int")
    spans = spans.select(*slot, F.last("_end", ignorenulls=True).over(earlier).alias("_in"), parts.alias("_parts"))
    lrows = _join_slots(l, spans, slot).withColumns({"_part": F.pmod(F.xxhash64("_t", "_row"), F.col("_parts")).cast("int"), "_side": F.lit(1)})
    rrows = _join_slots(r, spans.select(*slot, "_parts"), slot).withColumns(
        {"_part": F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)), "_side": F.lit(0)})
    both = lrows.drop("_parts").unionByName(rrows.drop("_parts"), allowMissingColumns=True)
    so_far = Window.partitionBy(*slot, "_part").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn(pick, F.coalesce(F.last(pick, ignorenulls=True).over(so_far), "_in")).where("_side = 1")
    out = out.select(*by, "_row.*", *[F.col(f"{pick}.{v}").alias(v) for v in values])
    lost = left.where(F.col(left_time).isNull())
    if left.schema[left_time].nullable:
        nulls = [F.lit(None).cast(right.schema[v].dataType).alias(v) for v in values]
        out = out.unionByName(lost.select(*by, *keep, *nulls))
    return out


def _join_slots(left: DataFrame, right: DataFrame, slot: Sequence[str], how: str = "inner") -> DataFrame:
    """Join in which missing keys are equal, the slot columns kept once."""
    named = right.select(*[F.col(c).alias(f"_r_{c}" if c in slot else c) for c in right.columns])
    same = [left[c].eqNullSafe(named[f"_r_{c}"]) for c in slot]
    both = left.join(named, same, how)
    if how == "full_outer":
        both = both.withColumns({c: F.coalesce(c, f"_r_{c}") for c in slot})
    return both.drop(*[f"_r_{c}" for c in slot])


def _asof_by_time(left: DataFrame, right: DataFrame, left_time: str, right_time: str, values: Sequence[str], period: str, pick: str,
                  rows_per_task: int) -> DataFrame:
    """Without a key the match depends on the time alone: distinct times are matched, then joined to the rows."""
    times = left.select(F.col(left_time).cast("timestamp").alias("_at")).where(F.col("_at").isNotNull()).distinct()
    # Months stand in for the key, so that the times are spread over tasks; earlier months come in through their end.
    t, per = F.col("_t"), F.date_trunc(period, F.col("_t")).alias("_per")
    r = right.select(F.col(right_time).cast("timestamp").alias("_t"), F.struct(*values).alias(pick)).where(t.isNotNull())
    r = r.groupBy("_t").agg(F.max(pick).alias(pick)).withColumn("_per", per)
    both = r.withColumn("_side", F.lit(0)).unionByName(times.select(F.col("_at").alias("_t")).withColumns({"_per": per, "_side": F.lit(1)}), allowMissingColumns=True)
    order = Window.partitionBy("_per").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    near = both.withColumn(pick, F.last(pick, ignorenulls=True).over(order))
    earlier = Window.orderBy("_per").rowsBetween(Window.unboundedPreceding, -1)  # one row per period
    ends = near.groupBy("_per").agg(F.max_by(pick, "_t").alias("_end")).select("_per", F.last("_end", ignorenulls=True).over(earlier).alias("_in"))
    found = near.where("_side = 1").join(ends, "_per").select(F.col("_t").alias("_at"), F.coalesce(pick, "_in").alias(pick))
    out = left.join(found, F.col(left_time).cast("timestamp") == F.col("_at"), "left")
    return out.select(*left.columns, *[F.col(f"{pick}.{v}").alias(v) for v in values])


def future_rows(joined: DataFrame, left_time: str, right_time: str) -> DataFrame:
    """Rows that would break point-in-time safety; callers assert this is empty."""
    return joined.where(F.col(right_time) > F.col(left_time))


def peer_panel(df: DataFrame, values: Sequence[str], key: str = "asset_id", time: str = "open_time") -> DataFrame:
    """(time, peer, peer_time, values): each peer's latest row at or before every observed time.

    A row stays valid until the peer's next row, so it is expanded over exactly the time positions it
    covers.  Nothing is paired asset by asset: each time holds one row per peer.
    """
    df = df.drop("_idx")
    times = index_rows(df.select(F.col(time).alias("_time")).distinct(), [], ["_time"], name="_ti")
    rows = df.join(times, df[time] == times["_time"]).drop("_time")
    rows = blocked(rows, [key], [time], lookback=0, lookahead=1)
    rows = owned(rows.withColumn("_next", F.lead("_ti").over(block_window((key,)))))
    top = times.agg(F.max("_ti")).scalar()
    spans = rows.withColumn("_last", F.coalesce(F.col("_next") - 1, top))
    spans = spans.withColumn("_ti", F.explode(F.sequence("_ti", "_last")))
    spans = spans.select("_ti", F.col(key).alias("peer"), F.col(time).alias("peer_time"), *values)
    return spans.join(times, "_ti").select(F.col("_time").alias(time), "peer", "peer_time", *values)
