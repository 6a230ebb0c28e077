"""Exact positions of rows inside a key, without a window over the key; the checksum of a text in DuckDB."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import stage

CRC32_CTES = """crc_step AS (SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) t(i)),
    crc AS (SELECT list(v ORDER BY i) AS crc_table FROM crc_step)"""


def crc32_sql(text: str) -> str:
    """Unsigned crc32 of a text that is not null; the statement must name ``CRC32_CTES`` and read ``crc``."""
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda c, y: xor(crc_table[(xor(c, y) & 255) + 1], c >> 8)), 4294967295)"


def positions(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The rows of ``df`` with ``pos`` (from 0, by ``order`` inside ``key``) and ``total`` (rows of the key).

    Rows are dealt out by ranges of (key, order), so one key may fill many tasks; equal rows, which may take each
    other's place, are spread by a salt.  Positions come from the place in the sorted part and the counts of earlier
    parts.  ``key`` must hold no nulls; nulls in ``order`` come first.
    """
    dealt = df.withColumn("_salt", F.rand(7)).repartitionByRange(key, *order, "_salt").sortWithinPartitions(key, *order)
    placed = stage(dealt.drop("_salt").withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_at", 33))
    parts = placed.groupBy(key, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    of_key = Window.partitionBy(key)
    earlier = of_key.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = parts.select(
        key, "_part", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_n").over(of_key).alias("total"))
    return placed.join(shifts, [key, "_part"]).withColumn("pos", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")
