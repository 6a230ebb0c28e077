"""Near copies by SimHash fingerprints and covering locality-sensitive hashing.

Every bit position has a non-zero vector of radius + 1 bits; mask v keeps the positions whose product with v is odd.
At most radius differing positions leave at least one non-zero v with only even products there, under which
both fingerprints look the same: no pair within the radius is missed, whatever the data.

A bucket of few fingerprints is compared directly.  In a larger one each fingerprint is put under all values within
half the radius in the bucket's open bits: two fingerprints share such a value exactly if they lie within the radius,
so links come from grouping by value and not from pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_texts
from tidemark.llm.components import components
from tidemark.session import stage

BITS = 64
RADIUS = 4
BUCKET = 1024


def fingerprint_of(text: str | None, width: int = 4, seed: int = 42) -> int:
    """Majority bits of the hashes of all word shingles; zero for no words."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    if len(words) <= width:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    plain = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    digest = xxhash.xxh64_intdigest
    counts, n = np.zeros(BITS, np.int64), len(words) - width + 1
    for lo in range(0, n, 65536):  # bounded memory for very long texts
        hi = min(n, lo + 65536)
        hashes = np.array([digest(plain[a:b], seed) for a, b in zip(starts[lo:hi].tolist(), ends[lo + width - 1:hi + width - 1].tolist())], np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, width: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) of every whole text; null and empty texts have zero."""
    def make():
        return lambda texts: ((signed(fingerprint_of(t, width, seed)),) for t in texts)

    return map_texts(docs, "fp long", make)


def masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """2 ** (radius + 1) - 1 masks; position p has vector 1 + p mod (2 ** (radius + 1) - 1)."""
    count = (1 << (radius + 1)) - 1
    return [sum(1 << p for p in range(bits) if ((1 + p % count) & v).bit_count() & 1) for v in range(1, count + 1)]


def near_values(fp: int, open_bits: list[int], radius: int) -> list[int]:
    """All values that differ from fp in at most radius of the open bits."""
    return [fp ^ sum(1 << b for b in some) for k in range(radius + 1) for some in combinations(open_bits, k)]


def bucket_links(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning set of the links among a bucket's fingerprints: (member, member) with few repeats."""
    n = len(values)
    if n == 2:
        return [(int(values[0]), int(values[1]))] if (int(values[0]) ^ int(values[1])).bit_count() <= radius else []
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= radius
    left, out = np.ones(n, bool), []
    for root in range(n):
        if not left[root]:
            continue
        left[root] = False
        frontier = np.array([root])
        while len(frontier):
            reached = near[frontier].any(axis=0) & left
            left &= ~reached
            frontier = np.flatnonzero(reached)
            out.extend((int(values[k]), int(values[root])) for k in frontier)
    return out


def links(distinct: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """(u, v) links among distinct fingerprints ``fp`` whose components are those of all pairs within the radius."""
    every = masks(radius)
    keyed = distinct.select("fp", F.explode(F.array(*[
        F.struct(F.lit(k).cast("int").alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m)).cast("long")).alias("key")) for k, m in enumerate(every)
    ])).alias("b")).select("b.t", "b.key", "fp")
    sorted_rows = keyed.repartition("t", "key").sortWithinPartitions("t", "key")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of equal (t, key); a run over the limit goes out as rows of its own kind, without being held."""
        held = np.zeros((0, 3), np.int64)
        over: tuple | None = None

        def emit(found: list, wide: np.ndarray) -> pa.RecordBatch:
            u, v = [f[0] for f in found], [f[1] for f in found]
            t = [-1] * len(found)
            return pa.RecordBatch.from_arrays([pa.array(t + wide[:, 0].tolist(), pa.int32()), pa.array(u + wide[:, 2].tolist(), pa.int64()), pa.array(v + wide[:, 1].tolist(), pa.int64())], ["t", "u", "v"])

        def settle(rows: np.ndarray, last: bool):
            nonlocal over
            found, wide, rest = [], [], rows[:0]
            cut = np.flatnonzero((np.diff(rows[:, 0]) != 0) | (np.diff(rows[:, 1]) != 0)) + 1
            bounds = [0, *cut.tolist(), len(rows)]
            sizes = np.diff(bounds)
            for k in np.flatnonzero((sizes > 1) | (np.arange(len(sizes)) >= len(sizes) - 1) | (np.arange(len(sizes)) == 0)).tolist():
                run = rows[bounds[k]:bounds[k + 1]]
                if not len(run):
                    continue
                name = (int(run[0, 0]), int(run[0, 1]))
                if len(run) > bucket or over == name:
                    over = name
                    wide.append(run)
                elif k == len(sizes) - 1 and not last:
                    rest = run
                elif len(run) > 1:
                    found.extend(bucket_links(run[:, 2].view(np.uint64), radius))
            found = [(signed(a), signed(b)) for a, b in found]
            return emit(found, np.concatenate(wide) if wide else rows[:0]), rest

        for batch in batches:
            rows = np.column_stack([batch.column(0).to_numpy().astype(np.int64), batch.column(1).to_numpy(), batch.column(2).to_numpy()])
            out, held = settle(np.concatenate([held, rows]) if len(held) else rows, False)
            yield out
        if len(held):
            yield settle(held, True)[0]

    found = stage(sorted_rows.mapInArrow(compare, "t int, u long, v long"))
    near = found.where("t < 0").select("u", "v")
    if found.where("t >= 0").isEmpty():
        return near

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flips = []
        for m in every:
            open_bits = [b for b in range(BITS) if not m >> b & 1]
            flips.append(np.array(near_values(0, open_bits, radius // 2), np.uint64))
        for batch in batches:
            for t, fp in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                values = (flips[t] ^ np.uint64(fp & 0xFFFFFFFFFFFFFFFF)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), t, np.int32)), pa.array(np.full(len(values), fp, np.int64)), pa.array(values)], ["t", "fp", "value"])

    values = found.where("t >= 0").select("t", F.col("u").alias("fp")).mapInArrow(spread, "t int, fp long, value long")
    least = values.groupBy("value").agg(F.min("fp").alias("m"), F.max("fp").alias("most")).where("m <> most").select("value", "m")
    shared = values.join(least, "value").where("fp <> m").select(F.col("fp").alias("u"), F.col("m").alias("v")).distinct()
    return near.unionByName(shared)


def _grouped(docs: DataFrame, radius: int, width: int, seed: int, bucket: int) -> DataFrame:
    """(doc_id, row_key, fp, component, component_id) of every row."""
    if radius < 0 or radius % 2:
        raise ValueError("the radius must be even")
    keyed = docs.select(F.struct("doc_id", F.xxhash64("doc_id", "text").alias("row_key")).alias("doc_id"), "text")
    prints = stage(fingerprints(keyed, width, seed).select("doc_id.*", "fp"))
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = components(links(distinct.select("fp"), radius, bucket))
    member = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    named = member.join(member.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("fp", "component", "component_id")
    return prints.join(named, "fp")


def near_copies(docs: DataFrame, radius: int = RADIUS, width: int = 4, seed: int = 42, bucket: int = BUCKET) -> DataFrame:
    """doc_id, fingerprint (hex), component_id (least id of the documents reachable over links) of every row.

    Texts without words have fingerprint zero and link like any other.  Null ids take part and are the least only
    where no id is known (then component_id is null).  Repeated rows each get their row; an empty table gives none.
    """
    found = _grouped(docs, radius, width, seed, bucket)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, radius: int = RADIUS, width: int = 4, seed: int = 42, bucket: int = BUCKET) -> DataFrame:
    """One row of ``docs`` from each group of near copies: that of the least known id; repeats of it go."""
    found = stage(_grouped(docs, radius, width, seed, bucket))
    order = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "row_key")
    kept = found.groupBy("component").agg(F.min(order).alias("r")).select("r.row_key")
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64("doc_id", "text").alias("row_key")).join(kept, "row_key", "left_semi")
    if not found.groupBy("row_key").count().where("count > 1").isEmpty():
        rows = rows.dropDuplicates(["row_key"])
    return rows.select("row.*")
