"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Terms are words and their first letters (so that inflected and compound forms meet), chosen for a class contrast far
beyond chance.  Examples are a bounded sample of labelled rows, near copies counted once.  They lie in an inverted
index whose postings are cut into blocks with the greatest weight of each term: a block is opened only if these bound
its examples above the k-th best found so far, so the neighbours are exact.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import held_out, map_texts
from tidemark.session import stage

_LETTERS = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5, 6, 7, 8)
KNOWN_WORDS = 500_000


@dataclass(frozen=True)
class Settings:
    """Bounds of the learned model: examples per class, terms; and of the vote.

    A term needs ``least_examples`` examples, a contrast of ``least_z`` standard errors between the classes and odds
    that differ by ``least_odds``; the latter leaves out mere habits of a language or source.
    """

    examples_per_class: int = 4096
    terms: int = 4096
    least_examples: int = 4
    least_z: float = 5.0
    least_odds: float = 10.0
    neighbours: int = 25
    prior_votes: float = 0.5
    threshold: float = 0.7
    block: int = 64


def word_terms(word: str) -> list[str]:
    return ["=" + word, *("^" + word[:n] for n in PREFIXES if len(word) > n)]


def _term_array(words: Column) -> Column:
    """``word_terms`` of all words, each once, as a column; only feeds the choice of terms."""
    words = F.array_distinct(words)
    parts = [F.transform(words, lambda w: F.concat(F.lit("="), w))]
    for n in PREFIXES:
        longer = F.filter(words, lambda w: F.length(w) > n)  # noqa: B023 - called at once
        parts.append(F.transform(longer, lambda w: F.concat(F.lit("^"), F.substring(w, 1, n))))  # noqa: B023
    return F.array_distinct(F.concat(*parts))


def examples(docs: DataFrame, labels: DataFrame, settings: Settings) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, text, words, toxic) of at most ``examples_per_class`` rows a class, and how many labelled rows each class has.

    The rows have the least hash of their id; a document with several labels is toxic if any says so.  Of near copies
    (equal least shingle hash under any of three seeds) one stays.
    """
    marked = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), 3, 1))
        .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    )
    totals = {int(r["toxic"]): int(r["count"]) for r in marked.groupBy("toxic").count().collect()}
    # Hashes are uniform: twice the wanted share of them holds the least ones, and only those are sorted.
    h = F.xxhash64("doc_id")
    shares = {c: min(1.0, (2 * settings.examples_per_class + 256) / n) for c, n in totals.items()}
    low = reduce(or_, [(F.col("toxic") == c) & (h <= int((s - 0.5) * 2 ** 64) if s < 1 else F.col("toxic") == c) for c, s in shares.items()], F.lit(False))
    first = Window.partitionBy("toxic").orderBy(h, "doc_id")
    ids = marked.where(low).withColumn("at", F.row_number().over(first)).where(F.col("at") <= settings.examples_per_class).select(F.col("doc_id").alias("example_id"), "toxic")
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("example_id")).drop("example_id")
    # the words are written out: an expression inside a lambda would split the text again for every word
    rows = stage(rows.withColumn("words", F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}]+")))
    for seed in range(3):
        shingle = F.transform("words", lambda w, k: F.xxhash64(F.concat_ws(" ", w, F.get("words", k + 1), F.get("words", k + 2)), F.lit(seed)))  # noqa: B023 - called at once
        rows = rows.groupBy("toxic", F.array_min(shingle).alias("least")).agg(F.min_by(F.struct("doc_id", "text", "words"), "doc_id").alias("r")).select("toxic", "r.*")
    rows = stage(rows)
    return rows, totals


class Model:
    """Vocabulary, weighted examples and their block-max index."""

    def __init__(self, terms: list[str], idf: list[float], rows: list[tuple[int, int, dict[int, int]]], totals: dict[int, int], settings: Settings):
        self.settings = settings
        self.number = {t: k for k, t in enumerate(terms)}
        self.terms, self.idf = terms, idf
        vectors = [(i, toxic, self.unit(counts)) for i, toxic, counts in rows]
        empty = [toxic for _, toxic, v in vectors if not v]
        filled = sorted(((i, t, v) for i, t, v in vectors if v), key=lambda x: (max(x[2], key=lambda k: (x[2][k], -k)), x[0]))
        sampled = Counter(t for _, t, _ in vectors)
        self.class_weight = {c: totals.get(c, 0) / n for c, n in sampled.items()}
        total = sum(totals.values())
        self.prior = totals.get(1, 0) / total if total else 0.0
        weight = sum(self.class_weight[t] for t in empty)
        self.empty_score = (sum(self.class_weight[t] for t in empty if t) + self.settings.prior_votes * self.prior) / (weight + self.settings.prior_votes)
        self.ids = [i for i, _, _ in filled]
        self.toxic = np.array([t for _, t, _ in filled], bool)
        self.weights = np.array([self.class_weight[t] for _, t, _ in filled])
        size = settings.block
        self.blocks = -(-len(filled) // size)
        lists: dict[int, list[tuple[int, float]]] = {}
        for at, (_, _, v) in enumerate(filled):
            for t, w in v.items():
                lists.setdefault(t, []).append((at, w))
        self.postings, self.tops = {}, {}
        for t, pairs in lists.items():
            where, w = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])
            top = np.zeros(self.blocks)
            np.maximum.at(top, where // size, w)
            self.postings[t] = where, w, np.searchsorted(where, np.arange(self.blocks + 1) * size)
            self.tops[t] = top

    def unit(self, counts: dict[int, int]) -> dict[int, float]:
        """Unit vector of (1 + ln tf) * idf."""
        v = {t: (1.0 + float(np.log(c))) * self.idf[t] for t, c in counts.items()}
        norm = sum(x * x for x in v.values()) ** 0.5
        return {t: x / norm for t, x in v.items()} if norm else {}

    def nearest(self, query: dict[int, float]) -> list[tuple[float, int]]:
        """(cosine, position) of the k most similar examples, ties by position; exact."""
        k, size = self.settings.neighbours, self.settings.block
        shared = [t for t in query if t in self.postings]
        if not shared:
            return []
        bound = sum(query[t] * self.tops[t] for t in shared)
        best: list[tuple[float, int]] = []
        for b in np.argsort(-bound, kind="stable").tolist():
            if bound[b] <= 0 or len(best) == k and bound[b] < best[-1][0] - 1e-9:
                break
            score = np.zeros(size)
            for t in shared:
                where, w, cut = self.postings[t]
                lo, hi = cut[b], cut[b + 1]
                if hi > lo:
                    score[where[lo:hi] - b * size] += query[t] * w[lo:hi]
            found = np.flatnonzero(score > 0)
            best = sorted([*best, *zip(np.round(score[found], 12).tolist(), (found + b * size).tolist())], key=lambda x: (-x[0], x[1]))[:k]
        return best

    def score(self, counts: dict[int, int]) -> tuple[float, list[tuple[float, int]]]:
        """Votes of the neighbours by closeness and class weight, drawn towards the prior by a few votes."""
        best = self.nearest(self.unit(counts))
        if not best:
            return self.empty_score, []
        at = np.array([p for _, p in best])
        votes = 1.0 / (0.05 + 1.0 - np.array([c for c, _ in best])) * self.weights[at]
        m = self.settings.prior_votes * votes.mean()
        return float((votes[self.toxic[at]].sum() + m * self.prior) / (votes.sum() + m)), best


class Counts:
    """Counts of the chosen terms in a text; words are remembered up to a bound, others looked up again."""

    def __init__(self, number: dict[str, int]):
        self.number, self.plain, self.marked = number, set(), {}

    def __call__(self, text: str | None) -> dict[int, int]:
        words = _LETTERS.findall((text or "").lower())
        distinct, late = set(words), {}
        for w in distinct - self.plain:
            if w not in self.marked:
                hit = tuple(self.number[t] for t in word_terms(w) if t in self.number)
                if hit:
                    (self.marked if len(self.marked) < KNOWN_WORDS else late)[w] = hit
                elif not hit and len(w) <= 64:
                    if len(self.plain) >= KNOWN_WORDS:
                        self.plain.clear()
                    self.plain.add(w)
        out: Counter = Counter()
        hits = (distinct & self.marked.keys()) | late.keys()
        if hits:
            for w, n in Counter(w for w in words if w in hits).items():
                for t in late[w] if w in late else self.marked[w]:
                    out[t] += n
        return dict(out)


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """The model from labelled rows that are not held out; without any labelled row every score is 0."""
    rows, totals = examples(docs, labels, settings)
    sizes = {int(r["toxic"]): int(r["count"]) for r in rows.groupBy("toxic").count().collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    counted = rows.select("toxic", F.explode(_term_array(F.col("words"))).alias("term")).where(F.length("term") > 1).groupBy("term").agg(F.sum("toxic").alias("d1"), F.count(F.lit(1)).alias("d"))
    share = F.col("d") / F.lit(max(1, n1 + n0))
    gap = F.col("d1") / F.lit(max(1, n1)) - (F.col("d") - F.col("d1")) / F.lit(max(1, n0))
    z = F.abs(gap) / F.sqrt(share * (1 - share) * F.lit(1 / max(1, n1) + 1 / max(1, n0)) + F.lit(1e-12))
    d1, d0 = F.col("d1"), F.col("d") - F.col("d1")
    odds = F.abs(F.log((d1 + 0.5) * (n0 - d0 + 0.5) / ((d0 + 0.5) * (n1 - d1 + 0.5))))
    terms = (
        counted.withColumn("z", z).where((F.col("d") >= settings.least_examples) & (F.col("z") >= settings.least_z) & (odds >= float(np.log(settings.least_odds))))
        .orderBy(F.desc("z"), "term").limit(settings.terms).collect() if n1 and n0 else []
    )
    names = [r["term"] for r in terms]
    idf = [float(np.log(1.0 + (n1 + n0) / r["d"])) for r in terms]
    number = {t: k for k, t in enumerate(names)}

    def make():
        count = Counts(number)
        return lambda texts: ((list((c := count(t)).keys()), list(c.values())) for t in texts)

    counted = map_texts(rows.drop("words"), "term array<long>, tf array<long>", make, whole=True)
    vectors = [(r["doc_id"], r["toxic"], dict(zip(r["term"], r["tf"]))) for r in counted.select("row.doc_id", "row.toxic", "term", "tf").collect()]
    return Model(names, idf, sorted(vectors, key=lambda v: (v[0], v[1])), totals, settings)


def score(docs: DataFrame, model: Model, whole: bool = False) -> DataFrame:
    """doc_id (or row), score, predicted, evidence (ids of the three nearest examples), terms (chosen terms present).

    Null and empty texts and texts without a chosen term get the share of toxic examples without one.  Repeated rows
    each get their row.
    """
    def make():
        count = Counts(model.number)

        def one(text):
            counts = count(text)
            value, best = model.score(counts)
            return value, int(value >= model.settings.threshold), [int(model.ids[p]) for _, p in best[:3]], sorted(model.terms[t] for t in counts)
        return lambda texts: map(one, texts)

    return map_texts(docs, "score double, predicted int, evidence array<long>, terms array<string>", make, whole)


def score_all(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``score`` with held_out, learned from the labelled rows of ``docs`` that are not held out."""
    found = score(docs, train(docs, labels, settings))
    return found.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", "predicted", "evidence", "terms")
