"""Exact k nearest by inner product as a Voronoi join.

Vectors get one more coordinate that gives all of them the same length; among such vectors the greatest inner product
with a query is the least distance to it.  Pivots cut the space into cells.  From each cell's count, radius and least
pivot distances follows, for each group of queries, a distance within which its k-th neighbour must lie; a vector is
sent to a group only if the triangle inequality does not put it beyond that.  Groups that ask for the same cells are
joined, so that a vector goes there once.  Groups are solved locally and exactly on integers, in slices of bounded size,
and the slices' best are merged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import stage

PIVOTS = 32
MOST_PIVOTS = 512
QUERIES_AT_ONCE = 4096
SCORED_AT_ONCE = 256
ROWS_AT_ONCE = 8192
SCALE = 1024


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): floor(scale * x) of every component as longs; rows with null, empty or non-finite parts go."""
    x = F.col("embedding")
    good = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.where(good).select("vec_id", F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("v"))


def _matrix(column) -> np.ndarray:
    return np.array([np.asarray(x, np.int64) for x in column], np.int64)


def _lifted(v: np.ndarray, most: float) -> np.ndarray:
    """One more coordinate, so that every vector has the squared length ``most``."""
    x = v.astype(np.float64)
    return np.column_stack([x, np.sqrt(np.maximum(0.0, most - (x * x).sum(axis=1)))])


def _flat(q: np.ndarray) -> np.ndarray:
    return np.column_stack([q.astype(np.float64), np.zeros(len(q))])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T))


def _best(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int):
    """(query_id, vec_id, score) of the k best rows a query, its own id left out, ties to the smaller id."""
    exact = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * rows.shape[1]
    if exact >= 2 ** 63:
        raise OverflowError("scores do not fit a long")
    order = np.argsort(row_ids, kind="stable")
    rows, row_ids, out = rows[order], row_ids[order], []
    plain = rows.astype(np.float64).T if exact < 2 ** 53 else rows.T
    for i, q in enumerate(query_ids):
        if i % SCORED_AT_ONCE == 0:
            some = queries[i:i + SCORED_AT_ONCE]
            scores = (some.astype(np.float64) @ plain).astype(np.int64) if exact < 2 ** 53 else some @ plain
        s = scores[i % SCORED_AT_ONCE]
        own = row_ids != q
        if own.sum() > k:
            least = np.partition(s[own], own.sum() - k)[own.sum() - k]
            pick = np.flatnonzero(own & (s >= least))
        else:
            pick = np.flatnonzero(own)
        pick = pick[np.argsort(-s[pick], kind="stable")][:k]
        out.append((np.full(len(pick), q), row_ids[pick], s[pick]))
    return [np.concatenate(x) if out else np.zeros(0, np.int64) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 3


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, pivots: int | None = None, scale: int = SCALE, rows_at_once: int = ROWS_AT_ONCE, queries_at_once: int = QUERIES_AT_ONCE) -> DataFrame:
    """query_id, rank, vec_id, score: for each query row the k rows of other ids with the greatest integer inner
    product, ties to the smaller id, all if there are fewer.

    Vectors that are null, empty or hold null or non-finite components take no part, nor do those of another length
    than the most frequent one.  A row whose id is null takes no part.  An id in several rows counts as one vector for
    each row as a candidate and, as a query, by its least vector.  Scores must fit a long.
    """
    spark = vectors.sparkSession
    every = quantised(vectors.where(F.col("vec_id").isNotNull()).select("vec_id", "embedding", is_query.alias("asks")).select("vec_id", "embedding"), scale)
    lengths = every.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if lengths is None:
        return empty
    square = F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    data = stage(every.where(F.size("v") == lengths["d"]).withColumn("square", square))
    whole = data.agg(F.max("square").alias("most"), F.count(F.lit(1)).alias("n")).first()
    most = float(whole["most"]) * (1 + 1e-9) + 1.0
    pivots = pivots or max(PIVOTS, min(MOST_PIVOTS, math.isqrt(whole["n"]) // 16))
    # a bounded sample as pivots, by hash and without repeats; any pivots give exact results
    drawn = dict.fromkeys(tuple(r["v"]) for r in data.select("v").orderBy(F.xxhash64("v"), "v").limit(4 * pivots).collect())
    p_lift = _lifted(_matrix(list(drawn)[:pivots]), most)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            d = _distances(_lifted(_matrix(batch.column(1).to_pylist()), most), p_lift)
            cell = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])], ["vec_id", "v", "cell", "d"])

    placed = stage(data.select("vec_id", "v").mapInArrow(cells, "vec_id long, v array<long>, cell int, d double"))
    asks = data.join(vectors.where(is_query & F.col("vec_id").isNotNull()).select("vec_id").distinct(), "vec_id", "left_semi").groupBy("vec_id").agg(F.min("v").alias("v"))

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            d = _distances(_flat(_matrix(batch.column(1).to_pylist())), p_lift)
            cell = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])], ["query_id", "v", "cell", "d"])

    asked = stage(asks.mapInArrow(groups, "query_id long, v array<long>, cell int, d double"))
    # summaries: pivots * (k + 1) numbers
    nearest = Window.partitionBy("cell").orderBy("d")
    summary = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("low"), F.max("d").alias("high")).collect()
    inner = placed.select("cell", "d").withColumn("at", F.row_number().over(nearest)).where(F.col("at") <= k + 1).select("cell", "d").collect()
    widths = {r["cell"]: (r["n"], r["far"]) for r in asked.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("far")).collect()}
    if not widths:
        return empty
    # a query lies off the sphere: its distance to a pivot is computed flat, the triangle inequality holds all the same
    p_dist = _distances(p_lift, p_lift)
    slack = 1e-6 * most ** 0.5 + 1e-3
    reach = {}
    for g, (_, far) in widths.items():
        bounds = sorted(far + p_dist[g, r["cell"]] + r["d"] for r in inner)
        # k + 1, for one of them may be the query itself
        reach[g] = (bounds[k] if len(bounds) > k else float("inf")) + slack
    targets: dict[int, list[tuple[int, float, float]]] = {}
    sent = {g: 0 for g in widths}
    for r in summary:
        for g, (_, far) in widths.items():
            gap = p_dist[g, r["cell"]] - far - slack
            if gap - r["high"] <= reach[g]:
                targets.setdefault(r["cell"], []).append((g, float(p_dist[g, r["cell"]]), far))
                sent[g] += r["n"]
    # groups that ask for the same cells are one; its rows are not held to the bounds of either
    asks_for: dict[int, list[int]] = {}
    for c in sorted(targets):
        for g, _, _ in targets[c]:
            asks_for.setdefault(g, []).append(c)
    joined: dict[tuple[int, ...], list[int]] = {}
    for g in sorted(widths):
        joined.setdefault(tuple(asks_for.get(g, ())), []).append(g)
    head = {g: same[0] for same in joined.values() for g in same}
    alone = {same[0]: len(same) == 1 for same in joined.values()}
    chunks = {same[0]: -(-sum(widths[g][0] for g in same) // queries_at_once) for same in joined.values()}
    slices = {same[0]: max(1, -(-sent[same[0]] // rows_at_once)) for same in joined.values()}
    far_away = 1e300
    plan = [(c, g, float(dist - far) if alone[g] else -far_away, float(dist + far) if alone[g] else far_away, float(reach[g]) if alone[g] else 0.0, chunks[g], slices[g])
            for c, ts in targets.items() for g, dist, far in ts if g in alone]
    table = F.broadcast(spark.createDataFrame(plan, "cell int, g int, near double, wide double, reach double, chunks int, slices int"))  # at most pivots squared rows
    keep = (F.col("near") - F.col("d") <= F.col("reach")) & (F.col("d") - F.col("wide") <= F.col("reach"))
    rows = (
        placed.join(table, "cell").where(keep)
        .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("g", "chunk", F.pmod(F.xxhash64("vec_id"), F.col("slices")).cast("int").alias("slice"), "vec_id", "v")
    )
    sizes = F.broadcast(spark.createDataFrame([(g, h, chunks[h], slices[h]) for g, h in head.items()], "cell int, g int, chunks int, slices int"))
    queries = (
        asked.join(sizes, "cell").withColumn("chunk", F.pmod(F.xxhash64("query_id"), F.col("chunks")).cast("int"))
        .withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).select("g", "chunk", "slice", "query_id", "v")
    )

    def solve(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(r):
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0, np.int64)})
        a, b, c = _best(_matrix(q["v"]), q["query_id"].to_numpy(), _matrix(r["v"]), r["vec_id"].to_numpy(), k)
        return pd.DataFrame({"query_id": a, "vec_id": b, "score": c})

    by = ("g", "chunk", "slice")
    local = queries.groupBy(*by).cogroup(rows.groupBy(*by)).applyInPandas(solve, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return local.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k_sql(every: int = 100, k: int = 10, scale: int = SCALE) -> str:
    return f"""
    WITH good AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * {scale})::BIGINT) AS v FROM embeddings
      WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    pairs AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score FROM good q JOIN good c ON q.vec_id <> c.vec_id WHERE q.vec_id % {every} = 0)
    SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs) WHERE rank <= {k}"""
