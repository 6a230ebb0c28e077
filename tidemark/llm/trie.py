"""Prefix trie of conversations by whole-sequence collapse.

Conversations are rebuilt from the first turns of the conversation that leads their group and their own later turns.
A prefix is known by its length and two numbers, each the exclusive or of hashes of (place, role, text) over its turns:
they run along a conversation in blocks, so a conversation of any length fills many tasks, and the number of a parent is
the child's without the last turn.  Identical conversations collapse into one weighted sequence with the list of its
ends; an anti-join against the proper prefixes leaves the leaves; only one conversation of each sequence is written out
as prefixes, and all figures of a node are sums over the sequences that start with it.

Sums over a subtree need no pairs of ancestors.  With W the words of a sequence and B the words before a node, the words
of its members from the node on are sum(weight * W) - members * B.  The words of its distinct nodes come from giving each
node to the leaf of the least conversation below it: what a leaf owns is the end of its path, so the sum is that of the
owned words of the leaves below, with the node's own owner counted from the node on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.ordering import CRC32_CTES, crc32_sql, positions
from tidemark.session import stage

GROUP = 20
HEADS = 4
BLOCK = 1024
ENDS = 4096
WORD = r"[^ \t-\r]+"
NODE = ["depth", "x", "y"]


def turns(conversations: DataFrame, group: int = GROUP, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """Rebuilt turns (conv_id, length, depth, a, b, words) and every conversation with its length."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), F.xxhash64(F.lit(1), role, text).alias("a"),
        F.xxhash64(F.lit(2), role, text).alias("b"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    placed = stage(positions(rows, "conv_id", ["turn", "role", "a", "b"]).drop("turn", "role"))
    convs = placed.where("pos = 0").select(
        "conv_id", F.col("total").alias("n"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).alias("h"),
        (F.col("conv_id") - F.col("conv_id") % group).alias("leader"))
    sizes = convs.select(F.col("conv_id").alias("leader"), F.col("n").alias("of_leader"))
    convs = convs.join(sizes, "leader", "left").withColumn("given", F.least("h", F.coalesce("of_leader", F.lit(0))))
    convs = stage(convs.withColumn("length", F.col("given") + F.greatest(F.col("n") - F.col("h"), F.lit(0))))
    values = ["conv_id", "length", "depth", "a", "b", "words"]
    own = placed.join(convs.select("conv_id", "h", "given", "length"), "conv_id").where("pos >= h").withColumn("depth", F.col("pos") - F.col("h") + F.col("given") + 1)
    first = placed.where(F.col("pos") < heads - 1).select(F.col("conv_id").alias("leader"), (F.col("pos") + 1).alias("depth"), "a", "b", "words")
    lent = convs.where("given > 0").select("conv_id", "leader", "given", "length").join(first, "leader").where("depth <= given")
    return own.select(*values).unionByName(lent.select(*values)), convs.select("conv_id", "length")


def prefixes(rebuilt: DataFrame, block: int = BLOCK) -> DataFrame:
    """Each rebuilt turn as the prefix it ends: x and y, the pair of its parent, and the words up to it."""
    rows = rebuilt.select("conv_id", "length", "depth", "words", F.xxhash64("depth", "a").alias("hx"), F.xxhash64("depth", "b").alias("hy"),
                          F.expr(f"(depth - 1) div {block}").alias("block"))
    here = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    ran = stage(rows.select("*", F.bit_xor("hx").over(here).alias("x"), F.bit_xor("hy").over(here).alias("y"), F.sum("words").over(here).alias("upto")))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = ran.groupBy("conv_id", "block").agg(F.bit_xor("hx").alias("sx"), F.bit_xor("hy").alias("sy"), F.sum("words").alias("sw"))
    shifts = sums.select("conv_id", "block", *[F.expr(f).over(earlier).alias(c) for f, c in (("bit_xor(sx)", "sx"), ("bit_xor(sy)", "sy"), ("sum(sw)", "sw"))])
    whole = ran.join(shifts.where("block > 0"), ["conv_id", "block"], "left")

    def with_shift(value: Column, shift: str) -> Column:
        return value.bitwiseXOR(F.coalesce(shift, F.lit(0)))

    x, y = with_shift(F.col("x"), "sx"), with_shift(F.col("y"), "sy")
    return whole.select("conv_id", "length", "depth", "words", x.alias("x"), y.alias("y"), x.bitwiseXOR(F.col("hx")).alias("px"),
                        y.bitwiseXOR(F.col("hy")).alias("py"), (F.col("upto") + F.coalesce("sw", F.lit(0))).alias("upto"))


def sequences(ends: DataFrame) -> DataFrame:
    """Identical whole conversations as one: (length, x, y), weight, least conversation, words, digest of the ends.

    Ids are joined in chunks by their range; a sequence of several chunks is digested chunk by chunk.
    """
    of = ["length", "x", "y"]
    ids = F.concat_ws(",", F.transform(F.sort_array(F.collect_list("conv_id")), lambda i: i.cast("string")))
    chunks = stage(ends.groupBy(*of, F.floor(F.col("conv_id") / ENDS).alias("chunk")).agg(
        F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id"), F.max("upto").alias("all_words"), ids.alias("ids")))
    found = chunks.groupBy(*of).agg(F.sum("n").alias("weight"), F.min("conv_id").alias("conv_id"), F.max("all_words").alias("all_words"),
                                    F.count(F.lit(1)).alias("chunks"), F.max(F.when(F.col("n") <= ENDS, F.col("ids"))).alias("ids"))
    found = stage(found.withColumn("ends_sha256", F.when(F.col("chunks") == 1, F.sha2(F.col("ids").cast("binary"), 256))).drop("ids"))
    several = chunks.join(found.where("chunks > 1").select(*of), of, "left_semi").select(*of, "chunk", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*[c.to_pylist() for c in batch.columns]))
        for key, group in groupby(rows, key=lambda r: r[:3]):
            digest = hashlib.sha256()
            for k, row in enumerate(group):
                digest.update((("," if k else "") + row[4]).encode())
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*key, digest.hexdigest())], [*of, "long_sha256"])

    digests = several.repartition(*of).sortWithinPartitions(*of, "chunk").mapInArrow(run, "length long, x long, y long, long_sha256 string")
    return found.join(digests, of, "left").select(*of, "weight", "conv_id", "all_words", F.coalesce("ends_sha256", "long_sha256").alias("ends_sha256"))


def prefix_trie(conversations: DataFrame, group: int = GROUP, heads: int = HEADS, block: int = BLOCK) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node.

    Turns go by ``turn``, null first, those of one turn by role and then by a hash of the text; null role and text are
    empty; rows without ``conv_id`` belong to no conversation; a repeated row is a turn of its own; a conversation left
    without turns ends at the root; an empty table has no nodes; other columns play no part.
    """
    rebuilt, convs = turns(conversations, group, heads)
    every = stage(prefixes(rebuilt, block))
    zero = F.lit(0).cast("long")
    turnless = convs.where("length = 0").select("conv_id", *[zero.alias(c) for c in ("length", "x", "y", "upto")])
    seqs = stage(sequences(every.where("depth = length").select("conv_id", "length", "x", "y", "upto").unionByName(turnless)))
    lead = seqs.select("conv_id", "weight", "all_words")
    paths = stage(every.join(lead, "conv_id").unionByName(
        seqs.select("conv_id", "weight", "all_words", "length", *[zero.alias(c) for c in ("depth", "words", "x", "y", "px", "py", "upto")])))
    proper = paths.where("depth < length").select(*NODE).distinct()
    leaves = seqs.withColumnRenamed("length", "depth").join(proper, NODE, "left_anti").select("conv_id", F.lit(True).alias("leaf"))
    paths = stage(paths.join(leaves, "conv_id", "left"))

    owner = F.min(F.when(F.col("leaf"), F.col("conv_id"))).alias("owner")
    nodes = stage(paths.groupBy(*NODE).agg(
        F.sum("weight").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("words").alias("words"), F.max("px").alias("px"), F.max("py").alias("py"),
        F.max(F.col("upto") - F.col("words")).alias("before"), F.sum(F.col("weight") * F.col("all_words")).alias("weighed"), F.count("leaf").alias("n_leaves"), owner))
    owned = nodes.groupBy(F.col("owner").alias("conv_id")).agg(F.sum("words").alias("owned"))
    below = paths.where("leaf").join(owned, "conv_id").groupBy(*NODE).agg(
        F.sum("owned").alias("owned"), F.min(F.struct("conv_id", "owned", "all_words")).alias("first"))
    distinct_words = F.col("owned") - F.col("first.owned") + F.col("first.all_words") - F.col("before")
    saved = F.col("weighed") - F.col("n_convs") * F.col("before") - distinct_words
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("px").alias("x"), F.col("py").alias("y")).agg(F.count(F.lit(1)).alias("n_children"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("conv_id").alias("parent_conv_id"))
    ends = seqs.select(F.col("length").alias("depth"), "x", "y", "ends_sha256")
    return (
        nodes.join(below, NODE).withColumn("saved_tokens", saved.cast("long")).join(children, NODE, "left").join(ends, NODE, "left")
        .join(parents, ["depth", "px", "py"], "left")
        .select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"), "n_leaves", "saved_tokens",
                F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))
    )


def trie_sql(group: int = GROUP, heads: int = HEADS) -> str:
    """The same nodes in DuckDB, prefixes as lists of turns and subtrees as pairs of nodes."""
    return f"""
    WITH RECURSIVE {CRC32_CTES},
    t AS (SELECT conv_id::BIGINT AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
      row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k FROM conversations WHERE conv_id IS NOT NULL),
    sizes AS (SELECT c, count(*) AS n FROM t GROUP BY c),
    heads AS (SELECT c, n, c - c % {group} AS leader, {crc32_sql('c::VARCHAR')} % {heads} AS h FROM sizes, crc),
    convs AS (SELECT heads.c, heads.n, leader, h, least(h, coalesce(sizes.n, 0)) AS g FROM heads LEFT JOIN sizes ON sizes.c = leader),
    rebuilt AS (SELECT convs.c, t.k AS d, role, text FROM convs JOIN t ON t.c = leader AND t.k <= h
      UNION ALL SELECT convs.c, t.k - h + g, role, text FROM convs JOIN t ON t.c = convs.c AND t.k > h),
    paths AS (SELECT c, d, list({{'role': role, 'text': text}}) OVER (PARTITION BY c ORDER BY d ROWS UNBOUNDED PRECEDING) AS p, text FROM rebuilt
      UNION ALL SELECT c, 0, [], '' FROM convs),
    lengths AS (SELECT c, max(d) AS length FROM paths GROUP BY c),
    nodes AS (SELECT d, p, min(paths.c) AS conv_id, count(*) AS n, len(regexp_extract_all(min(text), '[^ \\t-\\r]+')) AS words,
        coalesce(string_agg(paths.c::VARCHAR, ',' ORDER BY paths.c) FILTER (WHERE length = d), '') AS ends FROM paths JOIN lengths USING (c) GROUP BY d, p),
    above AS (SELECT a.d, a.p, b.d AS bd, b.n, b.words, (SELECT count(*) FROM nodes k WHERE k.d = b.d + 1 AND list_slice(k.p, 1, b.d) = b.p) AS kids
      FROM nodes a JOIN nodes b ON b.d >= a.d AND list_slice(b.p, 1, a.d) = a.p),
    sums AS (SELECT d, p, sum((n - 1) * words)::BIGINT AS saved_tokens, count(*) FILTER (WHERE kids = 0) AS n_leaves, sum(CASE WHEN bd = d THEN kids ELSE 0 END)::BIGINT AS n_children FROM above GROUP BY d, p)
    SELECT a.conv_id, a.d AS depth, parent.conv_id AS parent_conv_id, a.n AS n_convs, n_children, n_leaves, saved_tokens, sha256(a.ends) AS ends_sha256
    FROM nodes a JOIN sums ON sums.d = a.d AND sums.p = a.p LEFT JOIN nodes parent ON a.d > 0 AND parent.d = a.d - 1 AND parent.p = list_slice(a.p, 1, a.d - 1)"""
