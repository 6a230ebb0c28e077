"""Forecast models: boosted trees on histograms and spark.ml; every fit is distributed, every score a column."""

from __future__ import annotations

import functools
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import maths
from tidemark.operators import boosting as BO
from tidemark.operators.metrics import P
from tidemark.schemas import SEEDS
from tidemark.session import at_once

Scorer = Callable[[DataFrame], DataFrame]
ROWS_A_TASK = 16_384  # of a logistic fit at least: it is a job an iteration, and a task costs more than so few rows


def vectors(df: DataFrame, features: Sequence[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="error").transform(df)


def _class(array: Column, k: int) -> Column:
    return F.coalesce(F.get(array, F.lit(k)), F.lit(0.0))


def _mean(columns: Sequence[Column]) -> Column:
    return functools.reduce(lambda a, b: a + b, columns) / len(columns)


def _silent(model, i: int):
    return model.setProbabilityCol(f"_v{i}").setPredictionCol(f"_q{i}").setRawPredictionCol(f"_w{i}")


def _bag(df: DataFrame, models: Sequence, names: Sequence[str], classes: Sequence[int]) -> DataFrame:
    """Mean class probabilities of several fitted classifiers."""
    out, helpers = df, []
    for i, m in enumerate(models):
        out = _silent(m, i).transform(out)
        helpers += [f"_v{i}", f"_q{i}", f"_w{i}"]
    arrays = [vector_to_array(f"_v{i}") for i in range(len(models))]
    return out.withColumns({n: _mean([_class(a, k) for a in arrays]) for n, k in zip(names, classes)}).drop(*helpers)


def fit_forest(train: DataFrame, seeds: Sequence[int] = SEEDS, features: str = "features", label: str = "y",
               trees: int = 40, depth: int = 6, min_leaf: int = 40, subset: float = 0.8) -> Scorer:
    """Seed-bagged multiclass forest; the mean probability goes to p0..p2."""
    data = train.withColumn("_label", F.col(label).cast("double"))
    models = [RandomForestClassifier(featuresCol=features, labelCol="_label", numTrees=trees, maxDepth=depth, minInstancesPerNode=min_leaf,
                                     featureSubsetStrategy=str(subset), subsamplingRate=0.8, seed=s).fit(data) for s in seeds]
    return lambda df: _bag(df, models, P, (0, 1, 2))


@dataclass
class Plan:
    """A boosting run and what makes a scorer of its models; ``fit_together`` fits several in the same jobs."""

    run: BO.Run
    finish: Callable[[BO.Boosted], Scorer]


def fitted(plans: Sequence[Plan]) -> list[BO.Boosted]:
    if len(plans) == 1:
        r = plans[0].run
        return [BO.fit(r.train, r.loss, r.label, r.by, r.seeds, r.settings, r.each, r.features)]
    return BO.fit_together([p.run for p in plans])


def fit_together(plans: Sequence[Plan]) -> list[Scorer]:
    return [p.finish(model) for p, model in zip(plans, fitted(plans))]


def chained(scorers: Sequence[Scorer]) -> Scorer:
    return lambda df: functools.reduce(lambda out, score: score(out), scorers, df)


def _boosted(run: BO.Run, names: Sequence[str], link, after: Callable[[DataFrame], DataFrame] = lambda df: df) -> Plan:
    """The outputs of all values of ``by`` go to ``names``, null for a value without training rows."""
    def finish(model: BO.Boosted) -> Scorer:
        def score(df: DataFrame) -> DataFrame:
            group = F.lit("all") if run.by is None else F.col(run.by).cast("string")
            out = df.withColumn("_raw", model.raw(vector_to_array(run.features), group, link))
            return after(out.withColumns({n: F.col("_raw")[k] for k, n in enumerate(names)}).drop("_raw"))
        return score
    return Plan(run, finish)


def direction(train: DataFrame, seeds: Sequence[int] = SEEDS, features: str = "features", label: str = "y", by: str | None = None,
              settings: BO.Settings = BO.Settings(), each: Mapping[str, BO.Settings] | None = None) -> Plan:
    """Seed-bagged multiclass boosting; the mean probability goes to p0..p2."""
    return _boosted(BO.Run(train, BO.Softmax(3), label, by, seeds, settings, each, features), P, BO.softmax)


def ordinal(train: DataFrame, seeds: Sequence[int] = SEEDS, features: str = "features", label: str = "y", by: str | None = None,
            settings: BO.Settings = BO.Settings()) -> Plan:
    """Two boosted threshold models, P(y >= 1) and P(y >= 2)."""
    return _boosted(BO.Run(train, BO.Thresholds(1, 2), label, by, seeds, settings, None, features), ("not_down", "up"), BO.sigmoid)


def _same(score):
    return score


def quantiles(train: DataFrame, target: str = "target_return", qs: dict[str, float] | None = None, features: str = "features", by: str | None = None,
              settings: BO.Settings = BO.Settings(), seeds: Sequence[int] = SEEDS[:1]) -> Plan:
    """Boosted quantiles of the target, sorted where they cross; leaves hold exact quantiles."""
    qs = qs or {"lower": 0.1, "mid": 0.5, "upper": 0.9}

    def ordered(df: DataFrame) -> DataFrame:
        out = df.withColumn("_sorted", F.array_sort(F.array(*qs)))
        return out.withColumns({n: F.col("_sorted")[k] for k, n in enumerate(sorted(qs, key=qs.get))}).drop("_sorted")
    return _boosted(BO.Run(train, BO.Pinball(*qs.values()), target, by, seeds, settings, None, features), list(qs), _same, ordered)


def risk(train: DataFrame, features: str = "features", target: str = "target_risk", by: str | None = None, settings: BO.Settings = BO.Settings(),
         seeds: Sequence[int] = SEEDS[:1], each: Mapping[str, BO.Settings] | None = None) -> Plan:
    """Boosted regression of risk, clipped to [0, 1]."""
    return _boosted(BO.Run(train, BO.Squared(), target, by, seeds, settings, each, features), ["_risk"], _same,
                    lambda df: df.withColumn("risk", maths.clamp(F.col("_risk"), 0.0, 1.0)).drop("_risk"))


def _alone(plan: Callable[..., Plan]) -> Callable[..., Scorer]:
    """The plan's scorer, fitted in a run of its own."""
    @functools.wraps(plan)
    def fit(*args, **kw) -> Scorer:
        return fit_together([plan(*args, **kw)])[0]
    return fit


fit_direction, fit_ordinal, fit_quantiles, fit_risk = map(_alone, (direction, ordinal, quantiles, risk))


def fit_logistic(train: DataFrame, c: float, features: str = "features", label: str = "y", standardize: bool = True, weight: str | None = None) -> Scorer:
    """L2 multinomial regression with inverse strength ``c`` (per-sample penalty 1 / (c n))."""
    n = train.count()
    train = train.coalesce(max(1, -(-n // ROWS_A_TASK)))
    scaler = StandardScaler(inputCol=features, outputCol="_x", withMean=True, withStd=True).fit(train) if standardize else None
    data = scaler.transform(train) if scaler else train.withColumn("_x", F.col(features))
    lr = LogisticRegression(featuresCol="_x", labelCol="_label", family="multinomial", regParam=1.0 / (c * n), elasticNetParam=0.0, standardization=False, maxIter=200)
    if weight:
        lr = lr.setWeightCol(weight)
    model = lr.fit(data.withColumn("_label", F.col(label).cast("double")))
    def score(df: DataFrame) -> DataFrame:
        ready = scaler.transform(df) if scaler else df.withColumn("_x", F.col(features))
        return _bag(ready, [model], P, (0, 1, 2)).drop("_x")
    return score


def fit_balanced_logistic(train: DataFrame, features: str = "features", label: str = "y") -> Scorer:
    """Baseline: class-balanced weights n / (3 n_k)."""
    counts = train.groupBy(label).agg(F.count(F.lit(1)).alias("_nk"))
    total = train.agg(F.count(F.lit(1))).scalar()
    weighted = train.join(counts, label).withColumn("_w", total / (3 * F.col("_nk")))
    return fit_logistic(weighted, 1.0, features, label, standardize=True, weight="_w")


def fit_matrix_calibrator(val: DataFrame, c: float) -> Scorer:
    """softmax(W ln p + b) fitted on validation rows; 12 parameters for three classes."""
    def logs(df: DataFrame) -> DataFrame:
        return df.withColumn("_lp", array_to_vector(F.array(*[maths.clip_log(F.col(p)) for p in P])))
    score = fit_logistic(logs(val), c, "_lp", standardize=False)
    return lambda df: score(logs(df)).drop("_lp")


# Fixed values: (name, rounds, step, leaves, depth, min rows per leaf, l1, l2, feature share, training years)
CAPACITY_VARIANTS = (
    ("current", 400, 0.025, 15, 6, 40, 0.2, 1.0, 0.8, None), ("current_recent_6y", 400, 0.025, 15, 6, 40, 0.2, 1.0, 0.8, 6),
    ("shallow", 300, 0.020, 7, 3, 200, 1.0, 10.0, 0.75, None), ("shallow_recent_6y", 300, 0.020, 7, 3, 200, 1.0, 10.0, 0.75, 6),
    ("very_shallow", 180, 0.020, 5, 3, 400, 2.0, 20.0, 0.70, None),
)
PACE = 8  # a job a level makes rounds dear: so many times fewer of them, with steps as many times larger


def capacity_settings(variant: tuple) -> BO.Settings:
    _, rounds, rate, leaves, depth, least, l1, l2, columns, _ = variant
    return BO.Settings(rounds=-(-rounds // PACE), rate=rate * PACE, depth=depth, leaves=leaves, min_leaf=least, l1=l1, l2=l2, columns=columns)


LINEAR_C = (0.001, 0.01, 0.1, 1.0)


def over_folds(samples: DataFrame, folds: Sequence[str], fit: Callable[[DataFrame], Scorer], roles: Sequence[str] = ("validation", "test")) -> DataFrame:
    """Fit on each fold's training rows, all folds at once; score the fold's other roles, and stack the result."""
    rows = [samples.where(F.col("fold") == fold) for fold in folds]
    scores = at_once(*[functools.partial(fit, own.where(F.col("role") == "train")) for own in rows])
    parts = [score(own.where(F.col("role").isin(*roles))) for score, own in zip(scores, rows)]
    return functools.reduce(lambda a, b: a.unionByName(b), parts)


def together(samples: DataFrame, folds: Sequence[str], fit: Callable[[DataFrame], Scorer], roles: Sequence[str] = ("validation", "test")) -> DataFrame:
    """As ``over_folds``, for a ``fit`` that trains all folds at once."""
    rows = samples.where(F.col("fold").isin(*folds))
    return fit(rows.where("role = 'train'"))(rows.where(F.col("role").isin(*roles)))
