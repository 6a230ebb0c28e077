"""Near copies of a training corpus: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Candidates are fingerprints that collide under the covering masks of ``simhash`` and, since a SimHash radius that masks
can cover holds only the closest pairs, nodes that share a MinHash band.  Both are confirmed alike: by odd sketches and
the exact similarity of the full sets, each bucket by pivots and never as its pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import oddsketch, simhash
from tidemark.session import stage

WIDTH = 5
SIMILARITY = 0.8


def covered(nodes: DataFrame, radius: int = simhash.RADIUS) -> DataFrame:
    """(u, v) nodes that join all whose fingerprints lie within the radius."""
    least = stage(nodes.groupBy("print").agg(F.min("node").alias("u")))
    alike = nodes.join(least, "print").where("node <> u").select("u", F.col("node").alias("v"))
    near = simhash.links(least.select(F.col("print").alias("fp")), radius)
    one, other = (least.select(F.col("print").alias(fp), F.col("u").alias(of)) for fp, of in (("u", "of_u"), ("v", "of_v")))
    return alike.unionByName(near.join(one, "u").join(other, "v").select(F.col("of_u").alias("u"), F.col("of_v").alias("v")))


def grouped(docs: DataFrame, similarity: float = SIMILARITY, width: int = WIDTH) -> DataFrame:
    """(doc_id, k1, k2, component) of every row; texts without words are one group."""
    found = oddsketch.grouped(docs, similarity, width, more=covered)
    return found.select("doc_id", "k1", "k2", F.coalesce("component", F.lit(-1)).alias("component"))


def representatives(docs: DataFrame, similarity: float = SIMILARITY, width: int = WIDTH) -> DataFrame:
    """One row of ``docs`` from each group of near copies: that of the least known id; repeats of it go.

    Null texts and texts without words are copies of each other; a row without an id stands for its group only where no
    row of it has one; an empty table gives none; all columns are kept as they are.
    """
    found = stage(grouped(docs, similarity, width))
    order = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "k1", "k2")
    kept = found.groupBy("component").agg(F.min(order).alias("r")).select("r.k1", "r.k2")
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64(F.lit(1), "doc_id", "text").alias("k2"))
    rows = rows.join(kept, ["k1", "k2"], "left_semi")
    if not found.groupBy("k1", "k2").count().where("count > 1").isEmpty():
        rows = rows.dropDuplicates(["k1", "k2"])
    return rows.select("row.*")
