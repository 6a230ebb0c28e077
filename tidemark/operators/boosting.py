"""Gradient boosting of trees on histograms: one Spark job a level, for all groups, seeds and outputs at once.

Features are cut into bins at approximate quantiles of each group's training rows and written once with the row's label,
in units: some thousand rows of a group with their scores for one seed.  Few units of a model mean few tables to add up.
A model is one (group, seed); groups may be folds, variants of an experiment or both, and may have settings of their own.
A model of few rows is one unit, and a task grows its trees of a round; all such models take one job a round.
Of models with more rows a level of a round is one job: tasks add up, per open node, the gradient, Hessian and count of
every (feature, bin); these tables are summed by (model, node) after a shuffle of one row for each, and only the best split
of each node comes back.  Runs on other rows, labels or losses can share these jobs (``fit_together``), which is what a run
of many rounds waits for.

A task's rows are bounded by ``WHOLE`` units; its tables and what is shuffled depend on models, open nodes, features and
bins, never on the number of rows.
Scores of rows are written anew every ``REFRESH`` rounds; between them tasks add the younger trees themselves.
"""

from __future__ import annotations

import functools
import math
import pickle
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field, replace
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.blocks import parallelism
from tidemark.operators.quantiles import linear, order_statistics
from tidemark.session import at_once, stage

REFRESH = 10
ACCURACY = 2000  # of the quantile sketch that the bins are cut from
UNIT = 16_384  # rows of a group that are packed together
WHOLE = 4  # units of a model up to which one task grows its trees: a job a level costs more than a level of so few rows
UNITS_A_TASK = 16  # models of one unit that a task grows at most where there are more tasks than cores
KEYS_A_TASK = 16  # tables of nodes, or counts of leaves, that one task adds up at least
STEP = 16  # bits of a value's code that one pass over the rows tells apart
FEW = 4096  # values of a leaf that tasks count as they are


@dataclass(frozen=True)
class Settings:
    """``rows`` and ``columns`` are the shares drawn for each round; ``features`` the positions a group may split on.

    A round costs a job a level, so the default takes few rounds with large steps; ``rounds * rate`` is what counts.
    """

    rounds: int = 50
    rate: float = 0.2
    depth: int = 6
    leaves: int = 15
    min_leaf: int = 40
    rows: float = 0.8
    columns: float = 0.8
    l1: float = 0.2
    l2: float = 1.0
    features: tuple[int, ...] | None = None


# --- losses: outputs, a start for each group, gradients and Hessians -----------------------------


class Softmax:
    """Classes 0..k-1; the outputs are log probabilities up to a constant."""

    refit: tuple[float, ...] | None = None

    def __init__(self, classes: int = 3):
        self.outputs = classes

    def start(self, rows: DataFrame, by: str) -> DataFrame:
        share = [F.log(F.greatest(F.avg((F.col("y") == k).cast("double")), F.lit(1e-6))) for k in range(self.outputs)]
        return rows.groupBy(by).agg(F.array(*share).alias("start"))

    def slopes(self, score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = softmax(score)
        return p - (y[:, None] == np.arange(self.outputs)), p * (1 - p) * self.outputs / (self.outputs - 1)


class Thresholds:
    """One yes-or-no output for each k: is the label at least k?"""

    refit: tuple[float, ...] | None = None

    def __init__(self, *at: int):
        self.at, self.outputs = np.array(at), len(at)

    def start(self, rows: DataFrame, by: str) -> DataFrame:
        share = [F.least(F.greatest(F.avg((F.col("y") >= int(k)).cast("double")), F.lit(1e-6)), F.lit(1 - 1e-6)) for k in self.at]
        return rows.groupBy(by).agg(F.array(*[F.log(s / (1 - s)) for s in share]).alias("start"))

    def slopes(self, score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = sigmoid(score)
        return p - (y[:, None] >= self.at), p * (1 - p)


class Squared:
    """The mean."""

    refit: tuple[float, ...] | None = None
    outputs = 1

    def start(self, rows: DataFrame, by: str) -> DataFrame:
        return rows.groupBy(by).agg(F.array(F.avg("y")).alias("start"))

    def slopes(self, score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return score - y[:, None], np.ones_like(score)


class Pinball:
    """Quantiles; the value of a leaf is the exact quantile of what is left over in it."""

    def __init__(self, *qs: float):
        self.refit, self.outputs = qs, len(qs)

    def start(self, rows: DataFrame, by: str) -> DataFrame:
        found = order_statistics(rows, [by], "y", {f"s{k}": linear(q) for k, q in enumerate(self.refit)})
        return found.select(by, F.array(*[f"s{k}" for k in range(self.outputs)]).alias("start"))

    def slopes(self, score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.where(score > y[:, None], 1.0, 0.0) - np.array(self.refit), np.ones_like(score)


def softmax(score: np.ndarray) -> np.ndarray:
    e = np.exp(score - score.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def sigmoid(score: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(score, -40, 40)))


# --- trees ----------------------------------------------------------------------------------------


class Tree:
    """Nodes in heap order; a node without a feature is a leaf.  Bins up to the cut go left."""

    def __init__(self, depth: int):
        n = (1 << (depth + 1)) - 1
        self.feature, self.cut, self.value = np.full(n, -1, np.int16), np.zeros(n, np.uint8), np.zeros(n)
        self.depth = 0

    def split(self, node: int, feature: int, cut: int, left: float, right: float) -> None:
        self.feature[node], self.cut[node] = feature, cut
        self.value[2 * node + 1], self.value[2 * node + 2] = left, right
        self.depth = max(self.depth, (node + 1).bit_length())

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row of bins."""
        at, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        for _ in range(self.depth):
            at = self.below(at, bins, rows)
        return at

    def below(self, at: np.ndarray, bins: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The nodes one level further down of rows that are at ``at``; a leaf stays."""
        feature = self.feature[at]
        return np.where(feature >= 0, 2 * at + 1 + (bins[rows, feature] > self.cut[at]), at)


def binned(values: np.ndarray, cuts: Sequence[np.ndarray]) -> np.ndarray:
    """Bin 0 for a missing value, else 1 + the number of cuts below it."""
    out = np.zeros(values.shape, np.uint8)
    for k, c in enumerate(cuts):
        x = values[:, k]
        out[:, k] = np.where(np.isnan(x), 0, 1 + np.searchsorted(c, x, "left"))
    return out


def _drawn(mix: np.ndarray, seed: int, turn: int, share: float) -> np.ndarray:
    """The rows of one round, by a hash of the row, so that they do not depend on partitions."""
    key = np.random.default_rng((seed, turn)).integers(0, 1 << 64, 2, np.uint64)
    x = (mix.view(np.uint64) ^ key[0]) * (key[1] | np.uint64(1))
    return ((x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(11)).astype(np.float64) < share * (1 << 53)


@dataclass
class Model:
    """What a group's scores need: cuts by feature, the start by output and, by seed, the trees of each round and output."""

    cuts: list[np.ndarray]
    start: np.ndarray
    settings: Settings
    trees: dict[int, list[list[Tree]]] = field(default_factory=dict)

    def scores(self, bins: np.ndarray, seed: int) -> np.ndarray:
        """Sums of the trees' values by output, without the start."""
        out = np.zeros((len(bins), len(self.start)))
        for turn in self.trees[seed]:
            for k, tree in enumerate(turn):
                out[:, k] += tree.value[tree.nodes(bins)]
        return out


def _shape(values: pa.Array, width: int) -> np.ndarray:
    """An array column of fixed width as a matrix; a missing array is a row of missing values."""
    if values.null_count:
        return np.array([[np.nan] * width if v is None else [np.nan if x is None else x for x in v] for v in values.to_pylist()], float).reshape(-1, width)
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


# --- one level ------------------------------------------------------------------------------------


@dataclass
class _Turn:
    """The state of a round as tasks see it; ``models`` hold only the trees that the rows' scores lack.

    Models are known by (run, group, seed number), their trees by the output as well.
    """

    losses: list
    models: list[list[Model]]
    seeds: list[list[int]]
    number: int
    bins: int
    growing: dict[tuple[int, int, int, int], Tree]
    open: dict[tuple[int, int, int, int], list[int]]
    allowed: dict[tuple[int, int, int], np.ndarray]

    def of(self, models: frozenset[tuple[int, int]]) -> _Turn:
        """The part of some models, known by (run, group)."""
        own = [{k: v for k, v in found.items() if k[:2] in models} for found in (self.growing, self.open, self.allowed)]
        young = [[m if (r, g) in models else Model([], m.start, m.settings) for g, m in enumerate(of_run)] for r, of_run in enumerate(self.models)]
        return replace(self, models=young, growing=own[0], open=own[1], allowed=own[2])

    def parts(self, units: Iterator[bytes]):
        """(run, group, seed number, drawn bins, label, score by output) of each unit whose model still grows."""
        for unit in units:
            r, g, s, mix, y, bins, held = pickle.loads(unit)
            if (r, g, s) in self.allowed:
                model = self.models[r][g]
                rows = _drawn(mix, self.seeds[r][s], self.number, model.settings.rows)
                own = bins[rows]
                yield r, g, s, own, y[rows], held[rows] + model.scores(own, self.seeds[r][s])

    def tables(self, part: int, units: Iterator[bytes]):
        """((model, open node, part), sums) with this task's (feature, bin) sums of each open node."""
        sums: dict[tuple[int, int, int, int], np.ndarray] = {}
        for r, g, s, bins, y, score in self.parts(units):
            loss, allowed = self.losses[r], self.allowed[r, g, s]
            if not any(self.open.get((r, g, s, k)) for k in range(loss.outputs)):
                continue
            slopes = loss.slopes(score, y)
            placed = _placed(bins, allowed, self.bins)
            for k in range(loss.outputs):
                model = r, g, s, k
                nodes = self.open.get(model)
                if not nodes:
                    continue
                table = _sums(self.growing[model].nodes(bins), nodes, placed, [w[:, k] for w in slopes], len(allowed) * self.bins)
                sums[model] = sums[model] + table if model in sums else table
        for model, table in sums.items():
            for i, node in enumerate(self.open[model]):
                yield (*model, node, part), table[i].tobytes()

    def grown(self, units: Iterator[bytes]):
        """(model, tree) of each output of the models whose rows are one unit, with the leaves refitted where the loss does so."""
        for r, g, s, bins, y, score in self.parts(units):
            loss, allowed, own = self.losses[r], self.allowed[r, g, s], self.models[r][g].settings
            slopes = loss.slopes(score, y)
            placed, rows, width = _placed(bins, allowed, self.bins), np.arange(len(y)), len(allowed) * self.bins
            for k in range(loss.outputs):
                tree, at, nodes, leaves = Tree(own.depth), np.zeros(len(y), np.int64), [0], 1
                while nodes:
                    found = []
                    for node, table in zip(nodes, _sums(at, nodes, placed, [w[:, k] for w in slopes], width)):
                        best = best_split(table.reshape(len(allowed), self.bins, 3), own)
                        if best is not None:
                            found.append((best[0], node, int(allowed[best[1]]), *best[2:]))
                    nodes, leaves = _split(tree, found, leaves, own)
                    at = tree.below(at, bins, rows)
                if loss.refit is not None:
                    rest = y - score[:, k]
                    keep = ~np.isnan(rest)
                    node, rest = at[keep], rest[keep] + 0.0
                    for leaf in np.unique(node).tolist():
                        tree.value[leaf] = own.rate * _quantile(rest[node == leaf], loss.refit[k])
                yield (r, g, s, k), tree

    def leftovers(self, units: Iterator[bytes]):
        """((model, leaf), codes) of what the drawn rows' scores leave over, for the losses that refit their leaves."""
        for r, g, s, bins, y, score in self.parts(units):
            for k in range(self.losses[r].outputs if self.losses[r].refit is not None else 0):
                rest = y - score[:, k]
                keep = ~np.isnan(rest)
                node, code = self.growing[r, g, s, k].nodes(bins[keep]), coded(rest[keep])
                for leaf in np.unique(node).tolist():
                    yield (r, g, s, k, leaf), code[node == leaf]

    def refreshed(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The units with the scores of all trees so far."""
        for batch in batches:
            out = []
            for unit in batch.column(0).to_pylist():
                r, g, s, mix, y, bins, held = pickle.loads(unit)
                out.append(pickle.dumps((r, g, s, mix, y, bins, held + self.models[r][g].scores(bins, self.seeds[r][s])), 5))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), batch.column(1)], ["unit", "place"])


def _placed(bins: np.ndarray, allowed: np.ndarray, width: int) -> np.ndarray:
    """Each row's cells in a table of the allowed features by ``width`` bins."""
    return bins[:, allowed] + np.arange(len(allowed)) * width


def _sums(at: np.ndarray, nodes: Sequence[int], placed: np.ndarray, slopes: Sequence[np.ndarray], width: int) -> np.ndarray:
    """Gradient, Hessian and count by cell, a row of the result for each of the nodes."""
    dense = np.full(max(int(at.max(initial=0)), *nodes) + 1, -1, np.int64)
    dense[nodes] = np.arange(len(nodes))
    at = dense[at]
    rows = np.flatnonzero(at >= 0)
    cell = (at[rows, None] * width + placed[rows]).ravel()
    size = len(nodes) * width
    found = [np.bincount(cell, np.repeat(w[rows], placed.shape[1]), size) for w in slopes] + [np.bincount(cell, minlength=size)]
    return np.stack(found, axis=1).reshape(len(nodes), -1)


def _split(tree: Tree, found: Sequence[tuple], leaves: int, own: Settings) -> tuple[list[int], int]:
    """Split by gain, (gain, node, feature, cut, sums) each, until the leaves are used up: the nodes to open next and the leaves there are."""
    opened: list[int] = []
    for _, node, feature, cut, (gl, hl, gr, hr) in sorted(found, key=lambda x: (-x[0], x[1])):
        if leaves >= own.leaves:
            break
        leaves += 1
        tree.split(node, feature, cut, leaf_value(gl, hl, own), leaf_value(gr, hr, own))
        if (2 * node + 2).bit_length() <= own.depth:
            opened += [2 * node + 1, 2 * node + 2]
    return opened if leaves < own.leaves else [], leaves


def _quantile(values: np.ndarray, q: float) -> float:
    """The exact quantile, interpolated as in ``_refit``."""
    h = (len(values) - 1) * q
    low, high = math.floor(h), math.ceil(h)
    ordered = np.partition(values, (low, high))
    low, high, share = float(ordered[low]), float(ordered[high]), h - low
    return low if low == high or share == 0 else low + (high - low) * share


def _best(rows, settings: list[list[Settings]], allowed: Mapping[tuple[int, int, int], np.ndarray], bins: int):
    """(gain, model, node, feature, cut, sums) of each node's best split, from the tables of all tasks in their order."""
    for (r, g, s, k, node), group in groupby(rows, key=lambda row: row[0][:-1]):
        usable = allowed[r, g, s]
        table = np.zeros(len(usable) * bins * 3)
        for _, sums in group:
            table += np.frombuffer(sums)
        found = best_split(table.reshape(len(usable), bins, 3), settings[r][g])
        if found is not None:
            yield found[0], (r, g, s, k), node, int(usable[found[1]]), found[2], found[3]


def _dealt(pairs, keys: int):
    """Pairs with equal keys but for the last entry in one task, in the order of that entry; ``keys`` tells how many there are."""
    tasks = max(1, min(pairs.context.defaultParallelism, -(-keys // KEYS_A_TASK)))
    return pairs.repartitionAndSortWithinPartitions(tasks, lambda key: hash(key[:-1]))


def _pull(g: np.ndarray, h: np.ndarray, settings: Settings) -> np.ndarray:
    return np.maximum(np.abs(g) - settings.l1, 0) ** 2 / (h + settings.l2)


def leaf_value(g: float, h: float, settings: Settings) -> float:
    return -settings.rate * math.copysign(max(abs(g) - settings.l1, 0.0), g) / (h + settings.l2)


def best_split(table: np.ndarray, settings: Settings):
    """(gain, feature, cut, (gl, hl, gr, hr)) of the split that gains most, the first of equals; none without a gain."""
    left = table.cumsum(axis=1)[:, :-1]
    whole = table[0].sum(axis=0)
    right = whole - left
    gain = _pull(left[..., 0], left[..., 1], settings) + _pull(right[..., 0], right[..., 1], settings) - _pull(whole[0], whole[1], settings)
    fits = (np.minimum(left[..., 2], right[..., 2]) >= settings.min_leaf) & (np.minimum(left[..., 1], right[..., 1]) > 1e-3)
    gain = np.where(fits, gain, -np.inf)
    at = int(gain.argmax())
    feature, cut = divmod(at, gain.shape[1])
    if not gain[feature, cut] > 1e-12:
        return None
    return float(gain[feature, cut]), feature, cut, (*map(float, left[feature, cut, :2]), *map(float, right[feature, cut, :2]))


# --- fit and score --------------------------------------------------------------------------------


class Boosted:
    """Fitted models by group; ``raw`` is a column of scores, the mean over seeds after ``link``."""

    def __init__(self, models: Mapping[str, Model], loss):
        self.models, self.loss = dict(models), loss

    def part(self, names: Mapping[str, str]) -> Boosted:
        """The models of some groups under other names."""
        return Boosted({new: self.models[old] for old, new in names.items() if old in self.models}, self.loss)

    def raw(self, features: Column, group: Column, link: Callable[[np.ndarray], np.ndarray] = lambda x: x) -> Column:
        models = self.models

        @F.arrow_udf("array<double>")
        def predict(x: pa.Array, by: pa.Array) -> pa.Array:
            names = np.array(by.to_pylist(), object)
            out: list = [None] * len(names)
            for name in set(names.tolist()) & models.keys():
                model, rows = models[name], np.flatnonzero(names == name)
                bins = binned(_shape(x.take(pa.array(rows)), len(model.cuts)), model.cuts)
                mean = np.mean([link(model.start + model.scores(bins, seed)) for seed in model.trees], axis=0)
                for i, values in zip(rows.tolist(), mean):
                    out[i] = values
            return pa.array(out, pa.list_(pa.float64()))

        return predict(features, group)


@dataclass
class Run:
    """What to fit: one model for each value of ``by`` and each seed; ``each`` gives groups settings of their own."""

    train: DataFrame
    loss: object
    label: str
    by: str | None = None
    seeds: Sequence[int] = (0,)
    settings: Settings = Settings()
    each: Mapping[str, Settings] | None = None
    features: str = "features"


def fit(train: DataFrame, loss, label: str, by: str | None = None, seeds: Sequence[int] = (0,), settings: Settings = Settings(),
        each: Mapping[str, Settings] | None = None, features: str = "features", bins: int = 64) -> Boosted:
    """Boosted trees on the vector column ``features``, one model for each value of ``by`` and each seed.

    ``each`` gives groups settings of their own.  Rows without a label take no part; missing features have a bin of
    their own, below all others.  A group with too few rows for a split keeps its start; a null group is not fitted; an
    empty table fits nothing.  ``bins`` is at most 255.
    """
    return fit_together([Run(train, loss, label, by, seeds, settings, each, features)], bins)[0]


def fit_together(runs: Sequence[Run], bins: int = 64) -> list[Boosted]:
    """As ``fit`` for each run, with the same trees; the levels of all runs share their jobs."""
    if not 2 <= bins <= 255:
        raise ValueError("bins must be 2 to 255")
    models, units = _begun(runs, bins)
    if units:
        _rounds(runs, [list(found.values()) for found in models], units, bins)
    return [Boosted(found, run.loss) for found, run in zip(models, runs)]


def _begun(runs: Sequence[Run], bins: int) -> tuple[list[dict[str, Model]], list[_Units]]:
    """Each run's models by group, without trees, and the training rows in units: some rows of a group with their scores for one seed.

    Runs on the same frame, groups and features differ in labels only: their rows are written once, ``y0``, ``y1`` .. being the labels.
    """
    tables: list[list[int]] = []  # runs by what they share
    for r, run in enumerate(runs):
        same = (of for of in tables if runs[of[0]].train is run.train and (runs[of[0]].by, runs[of[0]].features) == (run.by, run.features))
        if (found := next(same, None)) is None:
            tables.append(found := [])
        found.append(r)
    home = {r: (t, i) for t, of in enumerate(tables) for i, r in enumerate(of)}
    most = max(map(len, tables))

    def labelled(t: int) -> DataFrame:
        run, labels = runs[tables[t][0]], [F.col(runs[r].label).cast("double") for r in tables[t]]
        group = F.lit("all") if run.by is None else F.col(run.by).cast("string")
        labels += [F.lit(None).cast("double")] * (most - len(labels))
        return run.train.where(F.coalesce(*labels).isNotNull() & group.isNotNull()).select(
            F.lit(t).alias("of"), group.alias("by"), vector_to_array(run.features).alias("x"), *[y.alias(f"y{i}") for i, y in enumerate(labels)])

    rows = stage(functools.reduce(DataFrame.unionByName, map(labelled, range(len(tables)))))
    sizes = {(n["of"], n["by"]): n for n in rows.groupBy("of", "by").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("width"), *[F.count(f"y{i}").alias(f"n{i}") for i in range(most)]).collect()}  # a row for each group
    if not sizes:
        return [{} for _ in runs], []
    widths = [max([0, *(n["width"] or 0 for (of, _), n in sizes.items() if of == t)]) for t in range(len(tables))]
    # Bins follow the rows that have the run's label; where none lacks it, those of the table.
    partly = {r for r, (t, i) in home.items() if any(n["n"] != n[f"n{i}"] for (of, _), n in sizes.items() if of == t)}

    def own(r: int) -> DataFrame:
        t, i = home[r]
        return rows.where((F.col("of") == t) & F.col(f"y{i}").isNotNull()).select("by", "x", F.col(f"y{i}").alias("y"))

    shares = [i / (bins - 1) for i in range(1, bins - 1)]
    value = lambda f: F.when(~F.isnan(F.get("x", F.lit(f))), F.get("x", F.lit(f)))
    cells = [rows.select(F.lit(-1).alias("run"), "of", "by", "x"), *[own(r).select(F.lit(r).alias("run"), F.lit(home[r][0]).alias("of"), "by", "x") for r in sorted(partly)]]
    edges = functools.reduce(DataFrame.unionByName, cells).groupBy("run", "of", "by").agg(
        F.array(*[F.percentile_approx(value(f), shares, ACCURACY) for f in range(max(widths))]).alias("cuts"))
    starts = functools.reduce(DataFrame.unionByName, [
        run.loss.start(own(r).drop("x"), "by").select(F.lit(r).alias("run"), "by", "start") for r, run in enumerate(runs)])
    cut, start = at_once(edges.collect, starts.collect)  # a row for each group
    cut, start = {(n["run"], n["of"], n["by"]): n["cuts"] for n in cut}, {(n["run"], n["by"]): n["start"] for n in start}
    models: list[dict[str, Model]] = []
    for r, run in enumerate(runs):
        t, kind = home[r][0], r if r in partly else -1
        models.append({by: Model([np.unique(np.array(c if c is not None else [], float)) for c in cut[kind, t, by][:widths[t]]], np.array(start[r, by], float),
                                 (run.each or {}).get(by, run.settings), {seed: [] for seed in run.seeds}) for of, by in sorted(start) if of == r})
    known = {(r, by): g for r, found in enumerate(models) for g, by in enumerate(found)}
    cuts, began, seeds = [[m.cuts for m in found.values()] for found in models], [[m.start for m in found.values()] for found in models], [len(run.seeds) for run in runs]

    def packed(r: int, g: int, held: list) -> list[bytes]:
        mix, y, placed = (np.concatenate(x) for x in zip(*held))
        return [pickle.dumps((r, g, s, mix, y, placed, np.tile(began[r][g], (len(y), 1))), 5) for s in range(seeds[r])]

    def parts(t: int, by: str, group: pa.RecordBatch | pa.Table):
        """((run, group), (hashes, labels, bins)) of some rows of a group, for each run that has labels there."""
        x, shared = _shape(group.column(2).combine_chunks() if isinstance(group, pa.Table) else group.column(2), widths[t]), None
        for i, r in enumerate(tables[t]):
            if (r, by) not in known:
                continue
            at = r, known[r, by]
            y, mix = group.column(3 + i), group.column(3 + most + i).to_numpy()
            has = y.is_valid().to_numpy(zero_copy_only=False) if isinstance(y, pa.Array) else y.is_valid().to_numpy()
            y = y.to_numpy(zero_copy_only=False) if isinstance(y, pa.Array) else y.to_numpy()
            if r in partly:
                yield at, (mix[has], y[has].astype(float), binned(x[has], cuts[r][at[1]]))
            else:
                shared = binned(x, cuts[r][at[1]]) if shared is None else shared
                yield at, (mix, y, shared)

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Units of at least ``UNIT`` rows of a group, the last ones of a task but fewer."""
        held: dict[tuple[int, int], list] = {}
        out = lambda at: pa.RecordBatch.from_arrays([pa.array(packed(*at, held.pop(at)), pa.binary())], ["unit"])
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            place = {key: i for i, key in enumerate(dict.fromkeys(keys))}
            group = np.array([place[key] for key in keys], np.int64)
            for key, i in place.items():
                for at, part in parts(*key, batch.take(pa.array(np.flatnonzero(group == i)))):
                    held.setdefault(at, []).append(part)
                    if sum(len(x[1]) for x in held[at]) >= UNIT:
                        yield out(at)
        for at in list(held):
            yield out(at)

    whole = {key for key, n in sizes.items() if n["n"] <= WHOLE * UNIT}
    names = [(r, known[r, by], s) for t, by in whole for r in tables[t] if (r, by) in known for s in range(seeds[r])]
    # The models with most rows and outputs are dealt first, each to the task that has least to do.
    cost = {(r, known[r, by]): sizes[t, by]["n"] * runs[r].loss.outputs for t, by in whole for r in tables[t] if (r, by) in known}
    load = np.zeros(min(len(names), max(rows.sparkSession.sparkContext.defaultParallelism, -(-len(names) // UNITS_A_TASK))))
    task: dict[tuple[int, int, int], int] = {}
    for name in sorted(names, key=lambda m: (-cost[m[:2]], m)):
        task[name] = int(load.argmin())
        load[task[name]] += cost[name[:2]]

    def all_of(group: pa.Table) -> pa.Table:
        """The units of a group, each all rows of a model."""
        units = [(unit, task[*at, s]) for at, part in parts(group.column(0)[0].as_py(), group.column(1)[0].as_py(), group) for s, unit in enumerate(packed(*at, [part]))]
        return pa.table({"unit": pa.array([u for u, _ in units], pa.binary()), "place": pa.array([p for _, p in units], pa.int32())})

    def of(keys: set[tuple[int, str]]) -> DataFrame:
        has = [(F.col("of") == t) & F.col("by").isin([by for q, by in keys if q == t]) for t in sorted({t for t, _ in keys})]
        ys = [f"y{i}" for i in range(most)]
        return rows.where(functools.reduce(Column.__or__, has)).select("of", "by", "x", *ys, *[F.xxhash64(y, "x").alias(f"mix{i}") for i, y in enumerate(ys)])

    units = []
    if names:
        units.append(_Units(of(whole).groupBy("of", "by").applyInArrow(all_of, "unit binary, place int"), frozenset(name[:2] for name in names), len(load)))
    if large := sizes.keys() - whole:
        split = of(large).coalesce(max(1, -(-sum(sizes[key]["n"] for key in large) // (4 * UNIT))))
        split = split.mapInArrow(some, "unit binary").repartition(parallelism(rows)).withColumn("place", F.lit(0))
        units.append(_Units(split, frozenset((r, known[r, by]) for t, by in large for r in tables[t] if (r, by) in known), None))
    return models, units


class _Units:
    """Units of some models as a written table, and as an RDD that the next jobs hold in memory or on disk.

    With ``tasks`` each unit is all of a model's rows and lies in the task that its ``place`` names.
    """

    def __init__(self, units: DataFrame, models: frozenset[tuple[int, int]], tasks: int | None):
        self.models, self.tasks, self.rdd = models, tasks, None
        self.hold(units)

    def hold(self, units: DataFrame) -> None:
        if self.rdd is not None:
            self.rdd.unpersist()
        self.state = stage(units)
        if self.tasks is None:
            rdd = self.state.rdd.map(itemgetter(0))
        else:
            rdd = self.state.rdd.map(lambda row: (row[1], row[0])).partitionBy(self.tasks, int).values()
        self.rdd = rdd.persist(StorageLevel.MEMORY_AND_DISK)


def _rounds(runs: Sequence[Run], models: list[list[Model]], units: Sequence[_Units], bins: int) -> None:
    """Grow the trees of all runs round by round."""
    losses, seeds = [run.loss for run in runs], [list(run.seeds) for run in runs]
    young = [[Model([], m.start, m.settings, {seed: [] for seed in seeds[r]}) for m in of_run] for r, of_run in enumerate(models)]
    last = max(m.settings.rounds for of_run in models for m in of_run)
    for number in range(last):
        turn = _Turn(losses, young, seeds, number, bins + 1, {}, {}, {})
        for r, of_run in enumerate(models):
            for g, m in enumerate(of_run):
                if number >= m.settings.rounds:
                    continue
                usable = np.array(range(len(m.cuts)) if m.settings.features is None else m.settings.features)
                for s, seed in enumerate(seeds[r]):
                    some = np.random.default_rng((seed, number, 1)).permutation(len(usable))[:max(1, math.ceil(m.settings.columns * len(usable)))]
                    turn.allowed[r, g, s] = np.sort(usable[some])
                    for out in range(losses[r].outputs):
                        turn.growing[r, g, s, out], turn.open[r, g, s, out] = Tree(m.settings.depth), [0]
        _grow(units, turn)
        for r, g, s in turn.allowed:
            trees = [turn.growing[r, g, s, out] for out in range(losses[r].outputs)]
            for of_run in (models, young):
                of_run[r][g].trees[seeds[r][s]].append(trees)
        if (number + 1) % REFRESH == 0 and number + 1 < last:
            for some in units:
                some.hold(some.state.mapInArrow(turn.refreshed, "unit binary, place int"))
            for of_run in young:
                for m in of_run:
                    m.trees = {seed: [] for seed in m.trees}
    for some in units:
        some.rdd.unpersist()


def _grow(units: Sequence[_Units], turn: _Turn) -> None:
    """The trees of a round, grown in the tasks that hold all rows of a model or level by level."""
    for some in units:
        own = turn.of(some.models)
        if not own.growing:
            continue
        if some.tasks is None:
            _levels(some.rdd, own)
            _refit(some.rdd, own)
        else:
            own.growing.update(some.rdd.mapPartitions(own.grown).collect())  # a row for each model's output
        turn.growing.update(own.growing)


def _levels(rows, turn: _Turn) -> None:
    """Split the open nodes level by level; a model's splits are taken by gain until its leaves are used up."""
    leaves = dict.fromkeys(turn.growing, 1)
    settings, allowed, bins = [[m.settings for m in of_run] for of_run in turn.models], turn.allowed, turn.bins
    while any(turn.open.values()):
        dealt = _dealt(rows.mapPartitionsWithIndex(turn.tables), sum(map(len, turn.open.values())))
        found: dict[tuple, list] = {}
        for gain, name, *split in dealt.mapPartitions(lambda pairs: _best(pairs, settings, allowed, bins)).collect():  # a row for each open node at most
            found.setdefault(name, []).append((gain, *split))
        for m in turn.open:
            turn.open[m], leaves[m] = _split(turn.growing[m], found.get(m, []), leaves[m], settings[m[0]][m[1]])


# --- exact quantiles of leaves ----------------------------------------------------------------------


def coded(values: np.ndarray) -> np.ndarray:
    """Numbers without a sign in the order of the values; the two zeros are one."""
    bits = np.ascontiguousarray(values + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63) == 1, ~bits, bits | np.uint64(1 << 63))


def decoded(code: int) -> float:
    bits = code & ~(1 << 63) if code >> 63 else ~code & ((1 << 64) - 1)
    return float(np.array([bits], np.uint64).view(np.float64)[0])


@dataclass(frozen=True)
class _Spot:
    """Where a wanted rank lies: among the ``n`` values whose code without the last ``shift`` bits is ``head``, at ``rank``."""

    head: int
    shift: int
    rank: int
    n: int

    def finer(self) -> int:
        """Bits left out next: none once few values are left, so that tasks count whole values."""
        return 0 if self.n <= FEW else max(self.shift - STEP, 0)


def _counts(found: Iterator, spots: Mapping[tuple, Sequence[_Spot]] | None, part: int):
    """((leaf, end, part), (codes, counts)) of this task's values; at first by the leading bits of all values."""
    sums: dict[tuple, list] = {}
    for leaf, code in found:
        for end, spot in enumerate([None] if spots is None else spots.get(leaf, ())):
            if spot is None:
                some = code >> np.uint64(64 - STEP)
            elif spot.shift == 0:
                continue
            else:
                some = code[code >> np.uint64(spot.shift) == spot.head] >> np.uint64(spot.finer())
            if len(some):
                sums.setdefault((*leaf, end), []).append(np.unique(some, return_counts=True))
    for key, counts in sums.items():
        yield (*key, part), _added(counts)


def _added(counts: Sequence[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if len(counts) == 1:
        return counts[0]
    codes, at = np.unique(np.concatenate([c for c, _ in counts]), return_inverse=True)
    return codes, np.bincount(at, np.concatenate([n for _, n in counts]), len(codes)).astype(np.int64)


def _located(pairs: Iterator, spots: Mapping[tuple, Sequence[_Spot]] | None, quantiles: Sequence[Sequence[float] | None]):
    """(leaf, end, spot, share) of each wanted rank, one step finer; ``share`` is how far the quantile lies beyond the lower end."""
    for key, group in groupby(pairs, key=lambda pair: pair[0][:-1]):
        leaf, end, total = key[:-1], key[-1], None
        for _, counts in group:
            total = counts if total is None else _added([total, counts])
        codes, counts = total
        before = np.concatenate([[0], np.cumsum(counts)])
        if spots is None:
            h = (int(before[-1]) - 1) * quantiles[leaf[0]][leaf[3]]
            ranks, shift, share = [math.floor(h), math.ceil(h)], 64 - STEP, h - math.floor(h)
        else:
            spot = spots[leaf][end]
            ranks, shift, share = [spot.rank], spot.finer(), None
        for i, rank in enumerate(ranks):
            at = int(np.searchsorted(before, rank, "right")) - 1
            yield leaf, end + i, _Spot(int(codes[at]), shift, rank - int(before[at]), int(counts[at])), share


def _refit(rows, turn: _Turn) -> None:
    """Leaves take the exact quantile of what their rows' scores leave over.

    Values are counted by their leading bits; the cell of a wanted rank is counted by the next bits, or by whole values
    where it holds few.  So a task's counts are bounded and a leaf's values are never in one place.
    """
    quantiles = [loss.refit for loss in turn.losses]
    models = [m for m in turn.growing if quantiles[m[0]] is not None]
    if not models:
        return
    spots: dict[tuple, list] | None = None
    shares: dict[tuple, float] = {}
    leaves = 8 * len(models)
    while spots is None or any(spot.shift for both in spots.values() for spot in both):
        before = spots
        pairs = rows.mapPartitionsWithIndex(lambda part, units: _counts(turn.leftovers(units), before, part))
        found = _dealt(pairs, leaves).mapPartitions(lambda group: _located(group, before, quantiles)).collect()  # two rows for each leaf
        spots = {leaf: list(both) for leaf, both in (before or {}).items()}
        for leaf, end, spot, share in sorted(found, key=lambda x: (x[0], x[1])):
            if before is None:
                spots.setdefault(leaf, []).append(spot)
                shares[leaf] = share
            else:
                spots[leaf][end] = spot
        leaves = 2 * len(spots)
    for leaf, (low, high) in spots.items():
        low, high, share = decoded(low.head), decoded(high.head), shares[leaf]
        value = low if low == high or share == 0 else low + (high - low) * share
        turn.growing[leaf[:4]].value[leaf[4]] = turn.models[leaf[0]][leaf[1]].settings.rate * value
