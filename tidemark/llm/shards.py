"""Reproducible shuffle into shards by a Feistel permutation of global row numbers.

Rows are numbered in the order of id, size and checksum.  A Feistel network over two digits l and r with
l * right + r covers left * right >= n numbers, fewer than sqrt(n) + 1 of them beyond the last row; those walk on
along their cycle until they fall below n.  Shard and slot of a row are remainder and quotient of its new number, so
they can be computed for any row number without the data, and shard sizes differ by one at most.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import stage

PRIME = 2147483647
SPREAD = 2654435761
COPIES_AT_ONCE = 4096


def round_keys(seed: int, rounds: int = 3) -> list[tuple[int, int]]:
    """Pairs of keys, one for each half of a round, from the seed alone."""
    keys, x = [], seed % PRIME
    for _ in range(2 * rounds):
        x = (x * 48271 + 11) % PRIME
        keys.append(x)
    return list(zip(keys[::2], keys[1::2]))


def digits(n: int) -> tuple[int, int]:
    """Sizes of the two digits that number at least n rows."""
    left = max(1, math.isqrt(max(n, 1) - 1) + 1)
    return left, max(1, -(-n // left))


def mixed(value: int, key: int) -> int:
    t = (value * SPREAD + key) % PRIME
    return (t * t + key) % PRIME * 48271 % PRIME


def permuted(row: int, n: int, seed: int) -> int:
    """New number of one row; the plain form of the column expression, for single rows and tests."""
    left, right = digits(n)
    while True:
        l, r = divmod(row, right)
        for a, b in round_keys(seed):
            l = (l + mixed(r, a)) % left
            r = (r + mixed(l, b)) % right
        row = l * right + r
        if row < n:
            return row


def _mixed(value: Column, key: Column) -> Column:
    t = (value * F.lit(SPREAD) + key) % F.lit(PRIME)
    return (t * t + key) % F.lit(PRIME) * F.lit(48271) % F.lit(PRIME)


def permutation(row: Column, n: int, seed: int) -> Column:
    """Column of new numbers 0..n-1 for row numbers 0..n-1."""
    left, right = digits(n)
    keys = F.array(*[F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for a, b in round_keys(seed)])

    def once(x: Column) -> Column:
        def step(s: Column, k: Column) -> Column:
            l = (s["l"] + _mixed(s["r"], k["a"])) % F.lit(left)
            return F.struct(l.alias("l"), ((s["r"] + _mixed(l, k["b"])) % F.lit(right)).alias("r"))
        start = F.struct(F.call_function("div", x, F.lit(right)).alias("l"), (x % F.lit(right)).alias("r"))
        return F.aggregate(keys, start, step, lambda s: s["l"] * F.lit(right) + s["r"])

    first = once(row)
    beyond = left * right - n
    if not beyond:
        return first
    # a cycle holds at most `beyond` numbers that are no rows, so that many steps always end inside
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(beyond)), first, lambda x, _: F.when(x < n, x).otherwise(once(x)))
    return F.when(first < n, first).otherwise(walk)


def number_rows(docs: DataFrame) -> tuple[DataFrame, int]:
    """doc_id, size, text_crc32, row and the number of rows.

    Rows alike in the three columns are counted before anything is sorted and told apart after it, so many repeats or
    missing ids meet in no single task.  The numbering does not depend on partitions.
    """
    slim = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
    )
    order = ("doc_id", "size", "text_crc32")
    groups = stage(
        slim.groupBy(*order).agg(F.count(F.lit(1)).alias("copies"))
        .repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("at", F.monotonically_increasing_id())
    )
    part = F.shiftright("at", 33)
    here = Window.partitionBy("part")
    parts = groups.groupBy(part.alias("part")).agg(F.sum("copies").alias("rows"))
    offsets = parts.withColumn("before", F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    n = groups.agg(F.sum("copies").alias("n")).first()["n"] or 0  # one row for each partition of the sort
    numbered = (
        groups.withColumn("part", part)
        .withColumn("in_part", F.sum("copies").over(here.orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("copies"))
        .join(offsets.select("part", F.coalesce("before", F.lit(0)).alias("before")), "part")
        .withColumn("start", F.col("before") + F.col("in_part"))
        .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(COPIES_AT_ONCE).cast("long"))))
        .withColumn("copy", F.explode(F.sequence("block", F.least(F.col("block") + COPIES_AT_ONCE, F.col("copies")) - 1)))
    )
    return numbered.select(*order, (F.col("start") + F.col("copy")).alias("row")), int(n)


def shard(docs: DataFrame, shards: int = 16, seed: int = 42) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row.

    The law is ``rows``: shard counts differ by one at most, whatever the sizes.  A null text has size 1 and the
    checksum of the empty text; null ids come first; repeated rows each get a slot; an empty table gives no rows.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    rows, n = number_rows(docs)
    placed = rows.withColumn("place", permutation(F.col("row"), n, seed)) if n else rows.withColumn("place", F.col("row"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), (F.col("place") % shards).cast("int").alias("shard"),
        F.call_function("div", F.col("place"), F.lit(shards)).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def shard_sql(shards: int = 16, seed: int = 42) -> str:
    """The same rows in DuckDB: digits of n from a square root, rounds as nested selects, the walk as recursion."""
    def half(target: str, other: str, key: int, size: str) -> str:
        t = f"(({other} * {SPREAD} + {key}) % {PRIME})"
        return f"({target} + ({t} * {t} + {key}) % {PRIME} * 48271 % {PRIME}) % {size}"

    def rounds(source: str, keep: str) -> str:
        sql = f"SELECT {keep}, a, b, x // b AS l, x % b AS r FROM {source}"
        for one, two in round_keys(seed):
            sql = f"SELECT {keep}, a, b, {half('l', 'r', one, 'a')} AS l, r FROM ({sql})"
            sql = f"SELECT {keep}, a, b, l, {half('r', 'l', two, 'b')} AS r FROM ({sql})"
        return f"SELECT {keep}, a, b, l * b + r AS x FROM ({sql})"

    crc = """coalesce(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT)),
      lambda c, y: xor(crc_table[(xor(c, y) & 255) + 1], c >> 8)), 4294967295)"""
    return f"""
    WITH RECURSIVE crc_step AS (SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) t(i)),
    crc AS (SELECT list(v ORDER BY i) AS crc_table FROM crc_step),
    slim AS (SELECT doc_id, coalesce(strlen(text), 0) + 1 AS size, xor({crc}, 4294967295) AS text_crc32 FROM documents, crc),
    sizes AS (SELECT n, a, (n + a - 1) // a AS b FROM (SELECT n, greatest(1, ceil(sqrt(n))::BIGINT) AS a FROM (SELECT count(*) AS n FROM documents))),
    numbered AS (SELECT doc_id, size, text_crc32, n, a, b, row_number() OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS x FROM slim, sizes),
    walk AS ({rounds('numbered', 'doc_id, size, text_crc32, n')}
      UNION ALL {rounds('(SELECT * FROM walk WHERE x >= n)', 'doc_id, size, text_crc32, n')})
    SELECT doc_id, size, text_crc32, 'rows' AS law, (x % {shards})::INT AS shard, x // {shards} AS slot, NULL::INT AS grown_shard FROM walk WHERE x < n"""
