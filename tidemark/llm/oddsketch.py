"""Near copies by banded MinHash, odd sketches and exact Jaccard similarity.

A text is its set of word shingles; texts of one set are one node.  Each node has ``bands * rows`` MinHash samples.  A
band of equal samples makes two nodes candidates: a pair at the similarity s shares none with the chance
(1 - s ** rows) ** bands, 1.2e-7 at 0.8 with 40 bands of 5.  The samples are also folded into an odd sketch, a bitmap in
which each sample flips one bit: two nodes that differ in few samples differ in few bits, so the population count of the
exclusive or estimates a high similarity closely.  Only candidates whose count lies within ``SAFETY`` standard
deviations of what the threshold makes expect are confirmed, on their full sets.

Pairs are never rows.  Nodes that share buckets, directly or over others, are a cluster.  A cluster is cut into blocks by
a hash, and a task takes two of its blocks: sketches and sets lie there as arrays, a node is compared with those it is
not yet joined with, and only the links that join something new leave the task.  Every two nodes of a cluster meet in
some task, so no candidate pair is left out; a group of copies is joined after one comparison each.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_texts
from tidemark.llm.components import components
from tidemark.session import stage

WIDTH = 2
SIMILARITY = 0.8
BANDS = 40
ROWS = 5
BITS = 512
SAFETY = 5.3
BLOCK_NODES = 2048
BLOCK_SHINGLES = 1 << 19
MATRIX_WORDS = 1 << 22
Candidates = Callable[[DataFrame], DataFrame]  # of nodes (node, print, ...) to pairs (u, v)


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z in small letters."""
    return (text or "").encode("utf-8", "replace").lower().split()


def shingles(words: list[bytes], width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of all word shingles; fewer words are one shingle, no words none."""
    if not words:
        return np.zeros(0, np.uint64)
    plain, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(plain)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    n = len(words) - width + 1
    return np.unique(np.fromiter((digest(plain[a:b]) for a, b in zip(starts[:n].tolist(), ends[width - 1:].tolist())), np.uint64, n))


def majority(hashes: np.ndarray) -> int:
    """A bit for each that is set in over half of the hashes, as a signed long."""
    counts = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 65536):  # bounded memory for very long texts
        counts += np.unpackbits(hashes[lo:lo + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64)[0])


class Sampler:
    """MinHash samples of a set, their band keys and their odd sketch."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS, bits: int = BITS):
        draws = np.random.default_rng(42).integers(0, 1 << 64, (4, bands * rows), np.uint64)
        self.flip, self.odd = draws[0][:, None], draws[1][:, None] | np.uint64(1)
        self.fold, self.turn = draws[2], draws[3] | np.uint64(1)
        self.rows, self.bits = rows, bits

    def samples(self, hashes: np.ndarray) -> np.ndarray:
        least = np.full(len(self.fold), np.uint64(0xFFFFFFFFFFFFFFFF))
        for lo in range(0, len(hashes), 4096):  # bounded memory for very long texts
            np.minimum(least, ((hashes[lo:lo + 4096] ^ self.flip) * self.odd).min(axis=1), out=least)
        return least

    def keys(self, samples: np.ndarray) -> list[int]:
        found = [xxhash.xxh64_intdigest(samples[k:k + self.rows].tobytes(), k) for k in range(0, len(samples), self.rows)]
        return np.array(found, np.uint64).view(np.int64).tolist()

    def sketch(self, samples: np.ndarray) -> bytes:
        """The parity bitmap: sample number and value together choose the bit that flips."""
        place = ((samples ^ self.fold) * self.turn) >> np.uint64(64 - int(math.log2(self.bits)))
        odd = np.bincount(place.astype(np.int64), minlength=self.bits) & 1
        return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def most_bits(similarity: float = SIMILARITY, samples: int = BANDS * ROWS, bits: int = BITS, safety: float = SAFETY) -> int:
    """The greatest population count that a pair at the similarity reaches within ``safety`` standard deviations."""
    def mean(differing: float) -> float:  # each differing sample flips one bit in either sketch
        return bits / 2 * (1 - (1 - 2 / bits) ** (2 * differing))

    differing = samples * (1 - similarity)
    share = mean(differing) / bits
    slope = mean(differing + 1) - mean(differing)
    spread = math.sqrt(bits * share * (1 - share) + slope ** 2 * samples * similarity * (1 - similarity))
    return min(bits, math.ceil(mean(differing) + safety * spread))


def estimate(count: int, samples: int = BANDS * ROWS, bits: int = BITS) -> float:
    """The similarity that a population count of the exclusive or stands for."""
    left = 1 - 2 * count / bits
    return 1 + math.log(left) / math.log(1 - 2 / bits) / -2 / samples if left > 0 else 0.0


def signatures(docs: DataFrame, width: int, bands: int, rows: int, bits: int) -> DataFrame:
    """doc_id, n (set size), h1, h2 (digest of the set), keys, sketch, print (majority bits of the set) of every text; no
    keys without words."""
    def make():
        sampler = Sampler(bands, rows, bits)

        def one(text):
            found = shingles(words_of(text), width)
            if not len(found):
                return 0, None, None, [], b"", None
            whole, samples = xxhash.xxh128_intdigest(found.tobytes()), sampler.samples(found)
            h1, h2 = np.array([whole >> 64, whole & 0xFFFFFFFFFFFFFFFF], np.uint64).view(np.int64).tolist()
            return len(found), h1, h2, sampler.keys(samples), sampler.sketch(samples), majority(found)
        return lambda texts: map(one, texts)

    return map_texts(docs, "n long, h1 long, h2 long, keys array<long>, sketch binary, print long", make)


class Sets:
    """Nodes of one or two blocks in a task: labels, sketches and sets, and the links that join different labels.

    Only shingles that several of the nodes have can be common to two of them.  They lie in a matrix of bits, if that
    takes at most ``MATRIX_WORDS``, else in the lists of the nodes.
    """

    def __init__(self, nodes: list[int], sizes: list[int], sketches: list[bytes], items: list[bytes], similarity: float, most: int):
        self.nodes, self.n = nodes, np.array(sizes)
        self.sketch = np.frombuffer(b"".join(sketches), np.uint64).reshape(len(nodes), -1)
        _, item, counts = np.unique(np.frombuffer(b"".join(items), np.uint64), return_inverse=True, return_counts=True)
        shared = counts[item] > 1
        place = (np.cumsum(counts > 1) - 1)[item[shared]]
        owner = np.repeat(np.arange(len(nodes)), self.n)[shared]
        self.shared = np.bincount(owner, minlength=len(nodes))
        self.label, self.similarity, self.most = np.arange(len(nodes)), similarity, most
        width = -(-int(place.max(initial=-1) + 1) // 64)
        self.bits = self.lists = None
        if width * len(nodes) <= MATRIX_WORDS:
            self.bits = np.zeros((len(nodes), width), np.uint64)
            np.bitwise_or.at(self.bits, (owner, place // 64), np.uint64(1) << (place % 64).astype(np.uint64))
        else:
            self.lists, self.start, self.mark = place, np.append(0, np.cumsum(self.shared)), np.zeros(width * 64, bool)

    def common(self, i: int, others: np.ndarray) -> np.ndarray:
        """How many shingles node i shares with each of ``others``."""
        if self.bits is not None:
            return np.bitwise_count(self.bits[others] & self.bits[i]).sum(axis=1, dtype=np.int64)
        own = self.lists[self.start[i]:self.start[i + 1]]
        self.mark[own] = True
        sizes = self.shared[others]
        ends = np.cumsum(sizes)
        at = np.arange(int(ends[-1])) + np.repeat(self.start[others] - ends + sizes, sizes)
        hits = np.append(0, np.cumsum(self.mark[self.lists[at]]))
        self.mark[own] = False
        return hits[ends] - hits[ends - sizes]

    def links_of(self, i: int, others: np.ndarray) -> list[tuple[int, int]]:
        """Links of node i to nodes of ``others`` that are not joined with it, one for each label that it joins."""
        far = others[self.label[others] != self.label[i]]
        share = self.similarity / (1 + self.similarity)  # of both sizes together, what two similar sets have in common
        least, greatest = np.minimum(self.n[far], self.n[i]), np.maximum(self.n[far], self.n[i])
        able = np.minimum(self.shared[far], self.shared[i]) >= share * (self.n[far] + self.n[i]) - 1e-9
        far = far[able & (least >= self.similarity * greatest - 1e-9)]
        far = far[np.bitwise_count(self.sketch[far] ^ self.sketch[i]).sum(axis=1) <= self.most]
        if not len(far):
            return []
        common, out = self.common(i, far), []
        for j in far[common >= self.similarity * (self.n[far] + self.n[i] - common) - 1e-9].tolist():
            if self.label[j] != self.label[i]:
                self.label[self.label == self.label[j]] = self.label[i]
                out.append((self.nodes[i], self.nodes[j]))
        return out


def _clusters(nodes: DataFrame, more: Candidates | None) -> DataFrame:
    """(node, cluster) of the nodes that share a bucket with another one."""
    buckets = nodes.select("node", F.explode("keys").alias("key"))
    ends = buckets.groupBy("key").agg(F.min("node").alias("u"), F.max("node").alias("most")).where("u <> most").select("key", "u")
    pairs = buckets.join(ends, "key").where("node <> u").select("u", F.col("node").alias("v"))
    pairs = stage(pairs.unionByName(more(nodes)) if more is not None else pairs)  # read twice
    return components(pairs).withColumnRenamed("component", "cluster")


def _links(docs: DataFrame, nodes: DataFrame, similarity: float, width: int, most: int, more: Candidates | None) -> DataFrame:
    """(u, v) links of nodes whose components are those of all candidate pairs of the similarity."""
    member = stage(nodes.select("node", "n", "k1", "k2", "sketch").join(_clusters(nodes, more), "node"))
    # members are a share of the corpus: the join is planned for its size at any size
    texts = docs.join(member.select("k1", "k2", "node").hint("merge"), ["k1", "k2"]).dropDuplicates(["node"]).select(F.col("node").alias("doc_id"), "text")

    def make():
        return lambda texts: ((shingles(words_of(t), width).tobytes(),) for t in texts)
    sets = map_texts(texts, "items binary", make).withColumnRenamed("doc_id", "node")
    sizes = member.groupBy("cluster").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_NODES), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("long").alias("blocks"))
    placed = member.join(sizes, "cluster").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    met = placed.join(sets, "node").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = met.select("cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "n", "sketch", "items")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = (row for batch in batches for row in zip(*[c.to_pylist() for c in batch.columns]))
        for (_, i, j), group in groupby(stream, key=itemgetter(0, 1, 2)):
            held = list(group)  # two blocks at most
            sets = Sets([r[4] for r in held], [r[5] for r in held], [r[6] for r in held], [r[7] for r in held], similarity, most)
            block = np.array([r[3] for r in held])
            second = np.flatnonzero(block == j)
            found = [pair for k in np.flatnonzero(block == i).tolist() for pair in sets.links_of(k, second[second > k] if i == j else second)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(side, pa.int64()) for side in zip(*found)], ["u", "v"])

    return stage(rows.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "node").mapInArrow(run, "u long, v long"))


def grouped(docs: DataFrame, similarity: float = SIMILARITY, width: int = WIDTH, bands: int = BANDS, rows: int = ROWS, bits: int = BITS,
            more: Candidates | None = None) -> DataFrame:
    """doc_id, k1, k2 (of the row), n and component (null without words) of every row; ``more`` adds candidate pairs."""
    if bits & (bits - 1) or bits < 64:
        raise ValueError("bits must be a power of two, 64 or more")
    keyed = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64(F.lit(1), "doc_id", "text").alias("k2"))
    prints = stage(signatures(keyed.select(F.struct("doc_id", "k1", "k2").alias("doc_id"), "text"), width, bands, rows, bits).select("doc_id.*", "n", "h1", "h2", "keys", "sketch", "print"))
    nodes = prints.where("h1 is not null").groupBy("h1", "h2").agg(F.min(F.struct("k1", "k2", "n", "keys", "sketch", "print")).alias("r"))
    nodes = stage(nodes.select("h1", "h2", "r.*").withColumn("node", F.monotonically_increasing_id()))
    found = components(_links(keyed.select("k1", "k2", "text"), nodes, similarity, width, most_bits(similarity, bands * rows, bits), more))
    member = nodes.select("h1", "h2", "node").join(found, "node", "left").select("h1", "h2", F.coalesce("component", "node").alias("component"))
    return prints.select("doc_id", "k1", "k2", "n", "h1", "h2").join(member, ["h1", "h2"], "left").drop("h1", "h2")


def near_copies(docs: DataFrame, similarity: float = SIMILARITY, width: int = WIDTH, bands: int = BANDS, rows: int = ROWS, bits: int = BITS) -> DataFrame:
    """doc_id, n_shingles, component_id (least id reachable over links), kept (whether it is the row's own) of every row.

    Texts without words and null texts have no shingle and are linked with nothing.  A null id takes part; a component
    without a known id has a null ``component_id``.  Repeated rows each get their row and are kept or not alike; very
    long texts are read whole; an empty table gives no rows; other columns play no part.
    """
    found = stage(grouped(docs, similarity, width, bands, rows, bits))
    least = found.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("least"))
    named = found.join(least, "component", "left").withColumn("component_id", F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("least")))
    return named.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def near_copies_sql(similarity: int = 80, width: int = WIDTH) -> str:
    """The same rows in DuckDB: all pairs that share a shingle, and the least id by recursion over the links."""
    import string
    small = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    return f"""
    WITH RECURSIVE worded AS (SELECT doc_id, regexp_extract_all({small}, '[^ \\t-\\r]+') AS w FROM documents),
    sets AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {width} THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - {width - 2}), lambda i: array_to_string(list_slice(w, i, i + {width - 1}), ' ')) END) AS s FROM worded),
    items AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
    pairs AS (SELECT a.doc_id AS u, b.doc_id AS v, a.n AS n_u, b.n AS n_v, count(*) AS c FROM items a JOIN items b ON a.g = b.g AND a.doc_id <> b.doc_id
      AND 100 * least(a.n, b.n) >= {similarity} * greatest(a.n, b.n) GROUP BY ALL),
    links AS (SELECT u, v FROM pairs WHERE 100 * c >= {similarity} * (n_u + n_v - c)),
    reached(doc_id, other) AS (SELECT doc_id, doc_id FROM sets UNION SELECT r.doc_id, v FROM reached r JOIN links ON u = r.other)
    SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
    FROM sets JOIN (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id) USING (doc_id)"""
