"""Merkle manifest of a dataset, with one version of the tree for each tampered document.

Every row is a leaf.  Leaves of a source ascend by id; every ``fan`` consecutive nodes become their digest until one is
left, the subroot; subroots in the order of their sources likewise give the root.

Nodes are cut into aligned blocks of ``fan ** lift`` of one height, which a task builds alone; the tops of the blocks are
the nodes of the next round, so a round shrinks the tree by the size of a block.  On the way down each block is given
what lies above it once: the digests left and right of its top at every upper level.  Inside a block the tree is
persistent: a tampered leaf makes a version that copies its ancestors in the block and shares every other node, and the
version goes on above the block by copying the ancestors there, next to the shared upper digests.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.ordering import CRC32_CTES, crc32_sql, positions
from tidemark.session import stage

FAN = 16
LIFT = 3
TAMPERED_EVERY = 5
_ROWS = "key string, block long, kind int, pos long, total long, digest binary, changed binary, doc_id long, above array<string>"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


class Block:
    """The nodes of an aligned block by height; heights end at one node or, within a larger tree, after ``lift`` steps."""

    def __init__(self, leaves: list[str], several: bool, fan: int, lift: int):
        self.fan, self.levels = fan, [leaves]
        while len(self.levels) <= lift if several else len(self.levels[-1]) > 1:
            last = self.levels[-1]
            self.levels.append([digest("".join(last[k:k + fan])) for k in range(0, len(last), fan)])

    @property
    def top(self) -> str:
        return self.levels[-1][0]

    def sides(self, at: int) -> list[str]:
        """Left and right siblings of the node ``at`` and of its ancestors, from below."""
        out = []
        for level in self.levels[:-1]:
            lo = at - at % self.fan
            out += ["".join(level[lo:at]), "".join(level[at + 1:lo + self.fan])]
            at //= self.fan
        return out

    def version(self, at: int, leaf: str) -> list[str]:
        """The nodes that a changed leaf copies, from the leaf to the top; every other node is shared."""
        copied = [leaf]
        for level in self.levels[:-1]:
            lo = at - at % self.fan
            copied.append(digest("".join(level[lo:at]) + copied[-1] + "".join(level[at + 1:lo + self.fan])))
            at //= self.fan
        return copied


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaves(docs: DataFrame, tampered: Column) -> DataFrame:
    """key (of the source, in its order), doc_id, leaf and, for tampered rows, the leaf of the text in small letters."""
    def leaf(text: Column) -> Column:
        return F.unhex(F.sha2(F.concat(*[_field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")], _field(text)).cast("binary"), 256))

    small = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    key = F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("source")))
    return docs.select(key.alias("key"), F.col("doc_id").cast("long").alias("doc_id"), leaf(F.col("text")).alias("leaf"), F.when(tampered, leaf(small)).alias("changed"))


def _blocks(rows: DataFrame, above: DataFrame | None, schema: str, many: Callable[..., Iterator[tuple]], fan: int, lift: int) -> DataFrame:
    """One pass over aligned blocks: ``many(key, number, block, above, rows)`` gives tuples of ``schema``."""
    names = [part.split()[0] for part in _ROWS.split(", ")]
    span = fan ** lift
    have = rows.withColumns({"block": F.expr(f"pos div {span}"), "kind": F.lit(1)})
    empty = {c: F.lit(None).cast(t) for c, t in (p.split(" ") for p in _ROWS.split(", "))}
    union = have.select(*[F.col(c) if c in have.columns else empty[c].alias(c) for c in names])
    if above is not None:
        heads = above.withColumns({"block": F.col("pos"), "kind": F.lit(0)}).drop("pos")
        union = union.unionByName(heads.select(*[F.col(c) if c in heads.columns else empty[c].alias(c) for c in names]))
    fields = [part.split(" ") for part in schema.split(", ")]
    types = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*[c.to_pylist() for c in batch.columns]))
        for (key, number), group in groupby(rows, key=itemgetter(0, 1)):
            held = list(group)  # at most a block of leaves and its head
            head = held.pop(0)[8] if held[0][2] == 0 else []
            block = Block([r[5].hex() for r in held], held[0][4] > span, fan, lift)
            values = list(zip(*many(key, number, block, head, held)))
            yield pa.RecordBatch.from_arrays([pa.array(v, types[t]) for v, (_, t) in zip(values, fields)], [n for n, _ in fields])

    return union.repartition("key", "block").sortWithinPartitions("key", "block", "kind", "pos").mapInArrow(run, schema)


def _climb(rows: DataFrame, fan: int, lift: int) -> list[DataFrame]:
    """Nodes (key, pos, total, digest) of every round; in the last each key has one, at position 0."""
    span = fan ** lift
    rounds, most = [rows], rows.agg(F.max("total")).first()[0] or 0
    while most > 1 or len(rounds) == 1:
        def tops(key, number, block, head, held):
            yield key, number, -(-held[0][4] // span), bytes.fromhex(block.top)
        rounds.append(stage(_blocks(rounds[-1].select("key", "pos", "total", "digest"), None, "key string, pos long, total long, digest binary", tops, fan, lift)))
        most = -(-most // span)
    return rounds


def _descend(rounds: list[DataFrame], above: DataFrame, fan: int, lift: int) -> DataFrame:
    """(key, pos, above) of the nodes of the first of ``rounds``; ``above`` is that of the nodes after the last."""
    def sides(key, number, block, head, held):
        for at, row in enumerate(held):
            yield key, row[3], head[:2] + block.sides(at) + head[2:]

    for rows in reversed(rounds):
        above = _blocks(rows, above, "key string, pos long, above array<string>", sides, fan, lift)
    return above


def prove(docs: DataFrame, tampered: Column | None = None, fan: int = FAN, lift: int = LIFT, copies: bool = False) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row.

    ``folded_root`` is the root of the row's own version where it is ``tampered`` (its letters A-Z made small), else the
    root.  With ``copies`` the nodes that a version copied follow, leaf to root (null for rows that are not tampered).
    Null values are leaves' values of their own; rows without an id come first in their source and are not tampered;
    rows of one id go by their digest, and equal rows take consecutive places; empty and very long texts are no special
    case; an empty table gives no rows; other columns play no part.
    """
    if fan < 2 or lift < 1:
        raise ValueError("fan must be 2 or more, lift 1 or more")
    if tampered is None:
        tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED_EVERY == 0
    numbered = stage(positions(leaves(docs, tampered), "key", ["doc_id", "leaf"]))
    rounds = _climb(numbered.withColumnRenamed("leaf", "digest"), fan, lift)
    subroots = stage(positions(rounds[-1].select(F.lit("").alias("all"), "key", "digest"), "all", ["key"]))
    upper = _climb(subroots.select(F.col("all").alias("key"), "pos", "total", "digest"), fan, lift)
    top = upper[-1].select("key", "pos", F.array(F.lit(""), F.lower(F.hex("digest"))).alias("above"))
    of_source = _descend(upper[:-1], top, fan, lift).select("pos", "above")
    heads = subroots.join(of_source, "pos").select(
        "key", F.lit(0).cast("long").alias("pos"), F.concat(F.array(F.lower(F.hex("digest"))), F.expr("slice(above, 2, size(above) - 1)")).alias("above"))
    heads = _descend(rounds[1:-1], heads, fan, lift)

    def rows(key, number, block, head, held):
        subroot, root, sides = head[0], head[1], head[2:]
        beyond = "".join(sides)
        for at, row in enumerate(held):
            copied = None
            if row[6] is not None:
                copied = block.version(at, row[6].hex())
                for left, right in zip(sides[::2], sides[1::2]):
                    copied.append(digest(left + copied[-1] + right))
            folded = copied[-1] if copied else root
            yield row[7], row[5].hex(), subroot, root, digest("".join(block.sides(at)) + beyond), folded, folded == root, copied

    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, copied array<string>"
    found = _blocks(numbered.withColumnRenamed("leaf", "digest"), heads, schema, rows, fan, lift)
    return found if copies else found.drop("copied")


def prove_sql(fan: int = FAN, every: int = TAMPERED_EVERY) -> str:
    """The same rows in DuckDB: levels by recursion, siblings by parent, folds by recursion over the levels."""
    fields = [f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END" for c in ("doc_id", "source", "lang", "n_chars")]

    def leaf(text: str) -> str:
        return f"sha256({' || '.join(fields)} || CASE WHEN text IS NULL THEN '-' ELSE strlen({text}) || ':' || {text} END)"

    small = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    return f"""
    WITH RECURSIVE {CRC32_CTES},
    leaves AS (SELECT doc_id, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS s, {leaf('text')} AS leaf,
      CASE WHEN doc_id IS NOT NULL AND {crc32_sql('doc_id::VARCHAR')} % {every} = 0 THEN {leaf(small)} END AS changed FROM documents, crc),
    placed AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p FROM leaves),
    low AS (SELECT 0 AS l, s, p, leaf AS h FROM placed
      UNION ALL SELECT l + 1, s, p // {fan}, sha256(string_agg(h, '' ORDER BY p)) FROM (SELECT *, count(*) OVER (PARTITION BY s) AS c FROM low) WHERE c > 1 GROUP BY l, s, p // {fan}),
    heights AS (SELECT s, max(l) AS top FROM low GROUP BY s),
    subroots AS (SELECT s, top, h AS subroot, row_number() OVER (ORDER BY s) - 1 AS p FROM low JOIN heights USING (s) WHERE l = top),
    high AS (SELECT 0 AS l, p, subroot AS h FROM subroots
      UNION ALL SELECT l + 1, p // {fan}, sha256(string_agg(h, '' ORDER BY p)) FROM (SELECT *, count(*) OVER () AS c FROM high) WHERE c > 1 GROUP BY l, p // {fan}),
    peak AS (SELECT l AS top, h AS root FROM high ORDER BY l DESC LIMIT 1),
    nodes AS (SELECT l, s, p, h FROM low JOIN heights USING (s) WHERE l < top
      UNION ALL SELECT subroots.top + high.l, s, high.p, high.h FROM high, subroots, peak WHERE high.l < peak.top),
    ways AS (SELECT placed.s, placed.p AS leaf_at, levels.l, (CASE WHEN levels.l < subroots.top THEN placed.p // ({fan} ** levels.l)::BIGINT ELSE subroots.p // ({fan} ** (levels.l - subroots.top))::BIGINT END) AS at
      FROM placed JOIN subroots USING (s) JOIN (SELECT DISTINCT s, l FROM nodes) levels USING (s)),
    sides AS (SELECT w.s, w.leaf_at, w.l, coalesce(string_agg(n.h, '' ORDER BY n.p) FILTER (WHERE n.p < w.at), '') AS a, coalesce(string_agg(n.h, '' ORDER BY n.p) FILTER (WHERE n.p > w.at), '') AS b
      FROM ways w JOIN nodes n ON n.s = w.s AND n.l = w.l AND n.p // {fan} = w.at // {fan} GROUP BY w.s, w.leaf_at, w.l),
    proofs AS (SELECT s, leaf_at, sha256(string_agg(a || b, '' ORDER BY l)) AS proof FROM sides GROUP BY s, leaf_at),
    folds AS (SELECT s, p AS leaf_at, 0 AS l, coalesce(changed, leaf) AS h FROM placed
      UNION ALL SELECT s, leaf_at, folds.l + 1, sha256(a || h || b) FROM folds JOIN sides USING (s, leaf_at, l))
    SELECT doc_id, leaf, subroot, root, coalesce(proof, sha256('')) AS proof_sha256, f.h AS folded_root, f.h = root AS verified
    FROM placed JOIN subroots USING (s) CROSS JOIN peak JOIN folds f ON f.s = placed.s AND f.leaf_at = placed.p AND f.l = subroots.top + peak.top
    LEFT JOIN proofs ON proofs.s = placed.s AND proofs.leaf_at = placed.p"""
