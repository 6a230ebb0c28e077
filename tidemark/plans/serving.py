"""Training with promotion gates, and the daily scoring job."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import maths
from tidemark.operators import boosting as BO
from tidemark.operators import calibration as C
from tidemark.operators import gates as G
from tidemark.operators import metrics as ME
from tidemark.operators import models as M
from tidemark.operators import relations as R
from tidemark.operators import scoring as S
from tidemark.plans import experiments as X
from tidemark.schemas import SEEDS
from tidemark.session import at_once, stage


def train_folds(samples: DataFrame, folds: Sequence[str], features: Sequence[str], seeds: Sequence[int] = SEEDS, settings: BO.Settings = BO.Settings()) -> DataFrame:
    """Every validation and test row with raw direction, quantiles, risk and the balanced-logistic baseline l0..l2."""
    ready = stage(with_targets(samples, features))
    train = ready.where(F.col("fold").isin(*folds) & (F.col("role") == "train"))
    rows, scorers = at_once(lambda: baseline(ready, folds), lambda: M.fit_together(three_models(train, seeds, settings, "fold")))
    return stage(M.chained(scorers)(rows).drop("features"))


def with_targets(samples: DataFrame, features: Sequence[str]) -> DataFrame:
    return M.vectors(samples.withColumn("target_risk", maths.target_risk(F.col("target_volatility"))), features)


def baseline(ready: DataFrame, folds: Sequence[str]) -> DataFrame:
    """The validation and test rows with l0..l2 of the balanced logistic model of their fold."""
    rows = M.over_folds(ready, folds, M.fit_balanced_logistic)
    return rows.withColumns({f"l{k}": F.col(f"p{k}") for k in range(3)}).drop(*ME.P)


def three_models(train: DataFrame, seeds: Sequence[int], settings: BO.Settings, by: str | None = None) -> list[M.Plan]:
    """Direction, quantiles and risk, to be grown in the same jobs."""
    return [M.direction(train, seeds, by=by, settings=settings), M.quantiles(train, by=by, settings=settings), M.risk(train, by=by, settings=settings)]


def fold_metrics(samples: DataFrame, scored: DataFrame, horizon: int, ppy: int, scale_feature: str, risk_feature: str) -> DataFrame:
    """All fold metrics and fitted parameters in grouped plans over the scored table."""
    scored = scored.withColumns({"target": F.col("target_return"), "scale": C.horizon_scale(F.col(scale_feature), horizon, ppy)})
    val, test = X.split_roles(scored)
    blended = C.temperature_blend(val, test, ["fold"])
    widths = C.conformal_scaled(val, ["fold"])
    raw = test.groupBy("fold").agg(ME.coverage_expr(name="raw_coverage"))
    rows = C.conformal_apply(blended.join(widths, "fold"), F.col("multiplier"), F.col("scale")).join(X.baseline_quantiles(samples), "fold")
    rows = stage(rows)
    pins = [("lower", "base_lower", 0.1), ("mid", "base_mid", 0.5), ("upper", "base_upper", 0.9)]
    # Pinball scores the raw quantiles; the widened bounds only serve the interval score.
    widen = F.greatest(F.col("multiplier"), F.lit(0.0)) * maths.safe_scale(F.col("scale"))
    raw_q = {"lower": F.col("lower") + widen, "mid": F.col("mid"), "upper": F.col("upper") - widen}
    own = sum((maths.pinball(F.col("target"), raw_q[c], q) for c, _, q in pins[1:]), maths.pinball(F.col("target"), raw_q["lower"], 0.1)) / 3
    base = sum((maths.pinball(F.col("target"), F.col(b), q) for _, b, q in pins[1:]), maths.pinball(F.col("target"), F.col("base_lower"), 0.1)) / 3
    baseline_risk = maths.clamp(maths.target_risk(F.col(risk_feature)), 0.0, 1.0)
    more = rows.groupBy("fold").agg(
        ME.coverage_expr(), ME.interval_score_expr(), ME.interval_score_expr("base_lower", "base_upper", name="baseline_interval_score"),
        F.avg(F.col("upper") - F.col("lower")).alias("interval_width"), F.avg(own).alias("quantile_pinball"), F.avg(base).alias("baseline_quantile_pinball"),
        ME.risk_mae_expr(F.col("risk"), F.col("target_risk")), ME.risk_mae_expr(baseline_risk, F.col("target_risk"), "baseline_risk_mae"),
        ME.brier_expr("l", "logistic_brier"), ME.brier_expr("q", "climatology_brier"),
        F.max("temperature").alias("temperature"), F.max("weight").alias("probability_blend_weight"), F.max("multiplier").alias("conformal_multiplier"))
    out = ME.summary(rows, ["fold"]).join(more, "fold").join(raw, "fold")
    best = F.least("logistic_brier", "climatology_brier")
    return out.withColumn("baseline_brier", best).withColumn("brier_skill_score", ME.bss(F.col("brier"), F.col("baseline_brier")))


def train(samples: DataFrame, folds: Sequence[str], features: Sequence[str], horizon: int, ppy: int = 252, scale_feature: str = "volatility_60s",
          risk_feature: str = "volatility_20s", seeds: Sequence[int] = SEEDS, version: str = "tidemark-1",
          settings: BO.Settings = BO.Settings(), scored: DataFrame | None = None) -> tuple[DataFrame, DataFrame, Bundle]:
    """(fold metrics, one manifest row, the bundle fitted on all rows); ``scored`` is what ``train_folds`` gave, if it ran.

    The manifest holds both gate decisions and everything a scorer needs beside the models: temperature, blend weight
    and interval multiplier of the newest fold (never fitted on an outer test period), class shares and feature
    medians of all rows.
    """
    known = {} if scored is None else {horizon: scored}
    return train_horizons({horizon: samples}, folds, features, ppy, scale_feature, risk_feature, seeds, version, settings, known)[horizon][:3]


def train_horizons(samples: Mapping[int, DataFrame], folds: Sequence[str], features: Sequence[str], ppy: int = 252, scale_feature: str = "volatility_60s",
                   risk_feature: str = "volatility_20s", seeds: Sequence[int] = SEEDS, version: str = "tidemark-1",
                   settings: BO.Settings = BO.Settings(), scored: Mapping[int, DataFrame] = {}) -> dict[int, tuple[DataFrame, DataFrame, Bundle, DataFrame]]:
    """What ``train`` gives for each horizon and its scored folds.

    The models of all folds and the final ones, refitted on every sample once whatever folds it is in, are groups of one
    training run for all horizons; the baselines are fitted beside it.
    """
    ids, needs = ["asset_id", "snapshot_time"], ["y", "target_return", "target_risk", "features"]
    ready = dict(zip(samples, at_once(*[lambda df=df: stage(with_targets(df, features)) for df in samples.values()])))
    once = dict(zip(samples, at_once(*[lambda df=df: stage(df.dropDuplicates(ids)) for df in ready.values()])))
    new = [h for h in samples if h not in scored]
    parts = [once[h].select(F.lit(f"{h}|").alias("_group"), *needs) for h in samples]
    for h in new:
        own = ready[h].where(F.col("fold").isin(*folds) & (F.col("role") == "train"))
        parts.append(own.select(F.concat_ws("|", F.lit(str(h)), "fold").alias("_group"), *needs))
    train = X.union(parts)
    boosted, *rows = at_once(lambda: M.fitted(three_models(train, seeds, settings, "_group")), *[lambda h=h: baseline(ready[h], folds) for h in new])
    unscored = dict(zip(new, rows))

    def scorers(names: Mapping[str, str], by: str | None) -> list[M.Scorer]:
        return [plan.finish(models.part(names)) for plan, models in zip(three_models(train, seeds, settings, by), boosted)]

    def finished(h: int) -> tuple[DataFrame, DataFrame, Bundle, DataFrame]:
        tested = scored[h] if h in scored else stage(M.chained(scorers({f"{h}|{f}": f for f in folds}, "fold"))(unscored[h]).drop("features"))
        metrics = stage(fold_metrics(samples[h], tested, h, ppy, scale_feature, risk_feature).withColumn("horizon_days", F.lit(h)))
        gates = G.gate_direction(metrics, ["horizon_days"]).select("horizon_days", "brier", "baseline_brier", "ece", "direction_passed").join(
            G.gate_scenario(metrics, ["horizon_days"]).select("horizon_days", "coverage", "scenario_passed"), "horizon_days")
        bundle = final_bundle(once[h], metrics, scorers({f"{h}|": "all"}, None), features, version)
        stored = bundle.parameters.select(
            F.lit(version).alias("version"), F.col("temperature"), F.col("weight").alias("probability_blend_weight"), F.col("multiplier").alias("conformal_multiplier"),
            *[F.col(f"q{k}").alias(f"prior_{k}") for k in range(3)], "sample_count",
            F.create_map(*[x for f in features for x in (F.lit(f), F.col(f"r_{f}"))]).alias("feature_reference"))
        decided = gates.withColumns({"direction_eligible": F.col("direction_passed"), "scenario_eligible": F.col("scenario_passed"), "production_eligible": F.col("scenario_passed")})
        return metrics, stage(decided.join(stored, how="cross")), bundle, tested

    return dict(zip(samples, at_once(*[lambda h=h: finished(h) for h in samples])))


@dataclass
class Bundle:
    """Fitted scorers with their one-row parameters (temperature, weight, multiplier, q0..q2, medians r_<feature>)."""

    direction: M.Scorer
    quantiles: M.Scorer
    risk: M.Scorer
    parameters: DataFrame
    features: Sequence[str]
    version: str

    def fitted(self) -> dict:
        """The single parameter row as plain values."""
        return self.parameters.first().asDict()


def fit_bundle(train_rows: DataFrame, validation: DataFrame, features: Sequence[str], version: str, horizon: int, ppy: int, scale_feature: str,
               seeds: Sequence[int] = SEEDS, settings: BO.Settings = BO.Settings()) -> Bundle:
    """Fit on the training rows, calibrate on validation; the medians become the explanation reference."""
    ready = M.vectors(train_rows.withColumn("target_risk", maths.target_risk(F.col("target_volatility"))), features)
    d, q, r = M.fit_together(three_models(ready, seeds, settings))
    val = q(d(M.vectors(validation, features))).withColumns({"k": F.lit(1), "target": F.col("target_return"), "scale": C.horizon_scale(F.col(scale_feature), horizon, ppy)})
    val = stage(val.drop("features"))
    temp = C.temperature_fit(val, ["k"])
    weight = C.blend_fit(C.temperature_apply(val.join(temp, "k"), F.col("temperature")), ["k"])
    prior = val.groupBy("k").agg(*[F.max(f"q{i}").alias(f"q{i}") for i in range(3)])
    medians = S.median_reference(train_rows, features)
    medians = medians.select(F.lit(1).alias("k"), *[F.col(f).alias(f"r_{f}") for f in features])
    params = stage(temp.join(weight, "k").join(C.conformal_scaled(val, ["k"]), "k").join(prior, "k").join(medians, "k"))
    return Bundle(d, q, r, params, features, version)


def final_bundle(rows: DataFrame, metrics: DataFrame, scorers: Sequence[M.Scorer], features: Sequence[str], version: str) -> Bundle:
    """Models fitted on ``rows``, every sample once, with the calibration of the newest fold."""
    newest = metrics.orderBy(F.desc("fold")).limit(1).select(
        F.lit(1).alias("k"), "temperature", F.col("probability_blend_weight").alias("weight"), F.col("conformal_multiplier").alias("multiplier"))
    shares = rows.agg(F.count(F.lit(1)).alias("sample_count"), *[F.avg((F.col("y") == k).cast("double")).alias(f"q{k}") for k in range(3)]).withColumn("k", F.lit(1))
    medians = S.median_reference(rows.select(*features), features).select(F.lit(1).alias("k"), *[F.col(f).alias(f"r_{f}") for f in features])
    return Bundle(*scorers, stage(newest.join(shares, "k").join(medians, "k")), features, version)


def score(bundle: Bundle, rows: DataFrame, scale: Column) -> DataFrame:
    """Calibrated probabilities, widened sorted quantiles and risk for any feature rows."""
    ready = M.vectors(rows.drop("q0", "q1", "q2"), bundle.features)
    raw = bundle.risk(bundle.quantiles(bundle.direction(ready))).drop("features")
    fitted = bundle.fitted()
    raw = raw.withColumns({f"q{k}": F.lit(fitted[f"q{k}"]) for k in range(3)})
    out = S.finish_score(raw, F.lit(fitted["temperature"]), F.lit(fitted["weight"]), F.lit(fitted["multiplier"]), scale)
    return out.drop("risk", "q0", "q1", "q2")


def explain(bundle: Bundle, rows: DataFrame, ids: Sequence[str], scale_of) -> DataFrame:
    """Top factors per row: each feature in turn moved to its training median."""
    fitted = bundle.fitted()
    stored = {f: F.lit(fitted[f"r_{f}"]) for f in bundle.features}
    cases = S.perturbed_rows(rows, ids, bundle.features, stored)
    return S.top_factors(S.impacts(score(bundle, rows, scale_of), score(bundle, cases, scale_of), ids), ids)


def daily_score(bundle: Bundle, feats: DataFrame, ready: DataFrame, cutoff: Column, now: Column, model: dict, stored: DataFrame, scale_of: Column,
                is_equity: bool, complete: Column, max_age: str = "26 HOUR") -> DataFrame:
    """Predictions of the cutoff for every ready asset: score, gate, explain, and append only new keys."""
    ids = ["asset_id", "snapshot_time"]
    rows = stage(feats.where(F.col("snapshot_time") == cutoff).join(ready.where("ready").select("asset_id"), "asset_id", "left_semi"))
    fresh = F.col("snapshot_time") + F.expr(f"INTERVAL {max_age}") >= now
    out = score(bundle, rows, scale_of).withColumns({"is_fresh": fresh, "is_complete": complete})
    out = G.suppress_direction(G.gate_confidence(out), F.lit(model["direction_eligible"]))
    if model["direction_eligible"]:
        out = out.join(explain(bundle, rows, ids, scale_of), ids, "left")
    else:
        none = F.array().cast("array<string>")
        out = out.withColumns({"positive": none, "negative": none})
    limits = G.limitations(F.lit(model["direction_eligible"]), F.lit(model["scenario_eligible"]), F.lit(is_equity))
    out = out.withColumns({"version": F.lit(bundle.version), "limitations": limits, "risk_level": maths.risk_level(F.col("risk_score"))})
    cols = [*ids, "version", *ME.P, "lower", "mid", "upper", "risk_score", "risk_level", "status", "confidence", "level", "positive", "negative", "limitations"]
    return R.not_yet(out.select(*cols), stored, [*ids, "version"])
