"""Comparison jobs: every prediction goes to one long table, every comparison is one grouped plan.

``samples`` carries asset_id, snapshot_time, label_end_time, fold, role, y, target_return,
target_volatility, neutral_band_threshold, q0..q2 (training class prior of the fold) and the features.
Boosted variants are groups of one training run: all variants, folds and seeds grow in the same jobs.
"""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import maths
from tidemark.operators import bars as B
from tidemark.operators import boosting as BO
from tidemark.operators import bootstrap as BS
from tidemark.operators import calibration as C
from tidemark.operators import labels as L
from tidemark.operators import macro as MA
from tidemark.operators import metrics as ME
from tidemark.operators import models as M
from tidemark.operators import priors as PR
from tidemark.operators import regimes as RG
from tidemark.schemas import SEEDS
from tidemark.session import stage

VF = ["variant", "fold"]
Q = ["q0", "q1", "q2"]
IDS = ["asset_id", "snapshot_time", "label_end_time", "fold", "role", "y", *Q]


def union(frames: Sequence[DataFrame]) -> DataFrame:
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def with_prior(samples: DataFrame) -> DataFrame:
    """Class frequencies of each fold's training rows, on every row of the fold."""
    prior = PR.class_prior(samples.where("role = 'train'"), ["fold"])
    return samples.drop(*Q).join(prior, "fold")


def split_roles(scored: DataFrame) -> tuple[DataFrame, DataFrame]:
    return scored.where("role = 'validation'"), scored.where("role = 'test'")


def by_variant(rows: DataFrame, folds: Sequence[str], each: Mapping[str, BO.Settings], seeds: Sequence[int], risk: bool = False) -> DataFrame:
    """Raw probabilities of the validation and test rows of every ``variant``, from one training run, written once.

    ``rows`` have a variant, a fold and the vector ``features``; ``each`` holds the settings of each variant.
    """
    grouped = rows.where(F.col("fold").isin(*folds)).withColumn("_group", F.concat_ws("|", "variant", "fold"))
    settings = {f"{name}|{fold}": own for name, own in each.items() for fold in folds}
    train, scored = grouped.where("role = 'train'"), grouped.where("role <> 'train'")
    plans = [M.direction(train, seeds, by="_group", each=settings)]
    if risk:
        plans.append(M.risk(train, by="_group", each=settings))
    return stage(M.chained(M.fit_together(plans))(scored).drop("features", "_group"))


def in_variants(samples: DataFrame, names: Sequence[str]) -> DataFrame:
    """Every row once for each variant."""
    return samples.withColumn("variant", F.explode(F.array(*[F.lit(n) for n in names])))


def variant_scores(samples: DataFrame, folds: Sequence[str], variants: Mapping[str, Sequence[str]], seeds: Sequence[int],
                   settings: BO.Settings = BO.Settings(), risk: bool = False) -> DataFrame:
    """Long table of raw probabilities of models on different feature lists."""
    every = list(dict.fromkeys(f for features in variants.values() for f in features))
    ready = stage(M.vectors(samples, every))
    each = {n: replace(settings, features=tuple(every.index(f) for f in features)) for n, features in variants.items()}
    return by_variant(in_variants(ready, list(variants)), folds, each, seeds, risk)


def worst(segments: DataFrame, k: int) -> DataFrame:
    """Each segment with its place among the ``k`` that lose most against the prior; no place beyond."""
    top = ME.worst_k(segments, k).select("dimension", "value", F.row_number().over(Window.orderBy(F.desc("brier_delta"), "dimension", "value")).alias("worst_rank"))
    return segments.join(top, ["dimension", "value"], "left")


def interval_skill(fold_metrics: DataFrame, reference: str, variant: str = "variant") -> DataFrame:
    """Interval skill per variant and its fold wins against the reference variant and the prior."""
    ref = fold_metrics.where(F.col(variant) == reference).select("fold", F.col("interval_score").alias("_ref"))
    return fold_metrics.join(ref, "fold").groupBy(variant).agg(
        F.avg("interval_score").alias("interval_score"), F.avg("baseline_interval_score").alias("baseline_interval_score"),
        F.avg("coverage").alias("coverage"),
        F.count_if(F.col("interval_score") < F.col("_ref")).alias("fold_wins_vs_absolute"),
        F.count_if(F.col("interval_score") < F.col("baseline_interval_score")).alias("fold_wins_vs_baseline"),
    ).withColumn("interval_skill_score", 1 - F.col("interval_score") / F.col("baseline_interval_score"))


def fold_report(test: DataFrame, by: Sequence[str] = VF) -> DataFrame:
    return ME.summary(test, by, "q")


def mean_report(folds: DataFrame, by: Sequence[str] = ("variant",)) -> DataFrame:
    """Means over folds and the number of folds that beat the prior."""
    names = ["accuracy", "log_loss", "ece", "classwise_ece", "reliability", "resolution", "uncertainty", "binning_gap"]
    out = ME.fold_mean(folds, by, [("brier", "baseline_brier")], [n for n in names if n in folds.columns])
    return out.withColumn("brier_skill_score", ME.bss(F.col("brier"), F.col("baseline_brier")))


def intervals_against(test: DataFrame, reference: str, block: int, iterations: int) -> DataFrame:
    """Bootstrap interval of each variant's daily loss difference to the reference variant.

    The variant joins the fold in the series key, so one plan resamples every variant.
    """
    daily = stage(ME.daily_loss(test, ["variant", "fold"]))
    base = daily.where(F.col("variant") == reference).drop("variant")
    diff = BS.paired_difference(base, daily.where(F.col("variant") != reference), by=["variant"])
    return BS.block_bootstrap(diff, block, iterations, by=["variant"])


# --- experiments ---------------------------------------------------------------------------------


def exp_feature_groups(samples: DataFrame, folds: Sequence[str], groups: Mapping[str, Sequence[str]], horizon: int, reference: str = "spot",
                       iterations: int = 2000, settings: BO.Settings = BO.Settings()) -> DataFrame:
    """Feature groups on identical folds: Brier, calibration, risk error, BIC-like score, loss interval against the reference."""
    rows = samples.withColumn("target_risk", maths.target_risk(F.col("target_volatility")))
    val, test = split_roles(variant_scores(rows, folds, groups, SEEDS[:1], settings, risk=True))
    temps = C.temperature_fit(val, VF)
    test = stage(C.temperature_apply(test.join(temps, VF), F.col("temperature")))
    rep = fold_report(test).join(ME.effective_n(test, horizon, VF), VF)
    rep = rep.join(test.groupBy(*VF).agg(ME.risk_mae_expr(F.col("risk"), F.col("target_risk"))), VF)
    size = F.create_map(*[x for n, f in groups.items() for x in (F.lit(n), F.lit(len(f)))])
    rep = rep.withColumn("bic_like", ME.bic_like(F.col("log_loss"), size[F.col("variant")], F.col("effective_n")))
    mean = mean_report(rep).join(rep.groupBy("variant").agg(F.avg("bic_like").alias("bic_like"), F.avg("risk_mae").alias("risk_mae")), "variant")
    return mean.join(intervals_against(test, reference, horizon, iterations), "variant", "left")


def select_calibrator(val: DataFrame, folds: Sequence[str], cs: Sequence[float] = (0.01, 0.1, 1.0)) -> DataFrame:
    """(fold, method, c): prior, temperature blend or matrix calibrator with the lowest inner Brier
    plus parameters over selection rows; the inner split is chronological and purged."""
    inner = stage(L.inner_calibration(val.drop("part")))
    fit, sel = inner.where("part = 'fit'"), inner.where("part = 'selection'")
    parts = [sel.withColumns({f"p{k}": F.col(f"q{k}") for k in range(3)}).withColumns({"method": F.lit("prior"), "c": F.lit(0.0), "params": F.lit(0), "rank": F.lit(0)}),
             C.temperature_blend(fit, sel, ["fold"]).withColumns({"method": F.lit("temperature_blend"), "c": F.lit(0.0), "params": F.lit(2), "rank": F.lit(1)})]
    for i, c in enumerate(cs):
        for fold in folds:
            score = M.fit_matrix_calibrator(fit.where(F.col("fold") == fold), c)
            parts.append(score(sel.where(F.col("fold") == fold)).withColumns(
                {"method": F.lit("log_probability_matrix"), "c": F.lit(c), "params": F.lit(12), "rank": F.lit(2 + i)}))
    scores = union([p.select("fold", "method", "c", "params", "rank", "y", *ME.P) for p in parts]).groupBy("fold", "method", "c", "params", "rank").agg(
        ME.brier_expr(name="selection_brier"), F.count(F.lit(1)).alias("n"))
    scores = scores.withColumn("score", F.col("selection_brier") + F.col("params") / F.col("n"))
    return scores.groupBy("fold").agg(F.min_by(F.struct("method", "c", "selection_brier", "score"), F.struct("score", "rank")).alias("_w")).select("fold", "_w.*")


def calibrated_variants(scored: DataFrame, folds: Sequence[str]) -> DataFrame:
    """Test rows under raw, temperature-blend and nested-selected calibration."""
    val, test = split_roles(scored)
    chosen = stage(select_calibrator(val, folds))
    blended = C.temperature_blend(val, test, ["fold"]).drop("temperature", "weight")
    matrix = []
    # One row per fold decides which matrix calibrators have to be refitted.
    for row in chosen.where("method = 'log_probability_matrix'").collect():
        score = M.fit_matrix_calibrator(val.where(F.col("fold") == row["fold"]), row["c"])
        matrix.append(score(test.where(F.col("fold") == row["fold"])))
    pick = chosen.select("fold", "method")
    prior = test.join(pick.where("method = 'prior'"), "fold", "left_semi").withColumns({f"p{k}": F.col(f"q{k}") for k in range(3)})
    temp = blended.join(pick.where("method = 'temperature_blend'"), "fold", "left_semi")
    selected = union([prior, temp, *matrix])
    cols = test.columns
    return union([df.select(*cols).withColumn("variant", F.lit(name)) for name, df in
                  (("raw", test), ("temperature_blend", blended), ("selected", selected))])


REGIMES = ("volatility_regime", "volume_regime", "trend_strength", "macro_market_regime")


def direction_scores(samples: DataFrame, folds: Sequence[str], features: Sequence[str], seeds: Sequence[int] = SEEDS, settings: BO.Settings = BO.Settings()) -> DataFrame:
    """Raw probabilities of one model on all folds; several experiments start from them."""
    return variant_scores(samples, folds, {"model": features}, seeds, settings).drop("variant")


def exp_calibration(scored: DataFrame, folds: Sequence[str]) -> DataFrame:
    """Mean metrics of raw, blended and nested-selected calibration."""
    return mean_report(fold_report(stage(calibrated_variants(scored, folds))))


def exp_calibration_segments(samples: DataFrame, scored: DataFrame, benchmark: str, k: int = 10) -> DataFrame:
    """Blended predictions by fold and macro regime, the ``k`` worst segments ranked."""
    val, test = split_roles(scored)
    rows = stage(regime_rows(samples, C.temperature_blend(val, test, ["fold"]), benchmark))
    return worst(ME.segment_summary(rows, ["fold", *REGIMES], "q"), k)


def exp_prior(samples: DataFrame) -> DataFrame:
    """Prior grid chosen on validation, refitted on train and validation, tested; no model involved."""
    train, val, test = (samples.where(F.col("role") == r) for r in ("train", "validation", "test"))
    chosen = PR.prior_select(train, val)
    out = PR.apply_selected(train.unionByName(val), test, chosen)
    folds = ME.summary(out, ["fold"], "q")
    return folds.join(chosen.select("fold", "idx", "shrinkage", "validation_brier"), "fold")


def ordinal_blend(fit: DataFrame, target: DataFrame, by: Sequence[str] = ("fold",)) -> DataFrame:
    """Calibrate both thresholds, project to three classes, blend with the prior."""
    by = list(by)
    nd = C.binary_temperature_fit(fit, by, F.col("y") >= 1, F.col("not_down")).withColumnRenamed("temperature", "_tn")
    nd = F.broadcast(nd)
    up = C.binary_temperature_fit(fit, by, F.col("y") >= 2, F.col("up")).withColumnRenamed("temperature", "_tu")
    up = F.broadcast(up)

    def project(df: DataFrame) -> DataFrame:
        d = df.join(nd, by).join(up, by)
        p = maths.ordinal(maths.binary_temperature_scale(F.col("not_down"), F.col("_tn")), maths.binary_temperature_scale(F.col("up"), F.col("_tu")))
        return d.withColumns(dict(zip(ME.P, p))).drop("_tn", "_tu")

    w = F.broadcast(C.blend_fit(project(fit), by, "q"))
    return C.blend_apply(project(target).join(w, by), F.col("weight"), "q").drop("weight")


def exp_direction(samples: DataFrame, folds: Sequence[str], features: Sequence[str], horizon: int, seeds: Sequence[int] = SEEDS,
                  iterations: int = 2000, settings: BO.Settings = BO.Settings()) -> DataFrame:
    """Multiclass, ordinal, nested choice and quantile-derived direction on identical folds."""
    ready = stage(M.vectors(samples, features))

    def fit(train: DataFrame):
        plans = M.direction(train, seeds, by="fold", settings=settings), M.ordinal(train, seeds, by="fold", settings=settings)
        return M.chained(M.fit_together([*plans, M.quantiles(train, by="fold", settings=settings)]))

    val, test = split_roles(stage(M.together(ready, folds, fit).drop("features")))
    f, s = (stage(L.inner_calibration(val)).where(F.col("part") == part).drop("part", "selection_start") for part in ("fit", "selection"))
    # Each calibration is one plan for its variants, and what it reads is written before: all in one they are a plan that the driver cannot hold.
    quant_val, quant_test = (C.quantile_direction(d, "neutral_band_threshold") for d in (val, test))
    named = lambda **frames: union([d.select(*IDS, *[c for c in d.columns if c in (*ME.P, "not_down", "up")]).withColumn("variant", F.lit(n)) for n, d in frames.items()])
    cols = [*IDS, *ME.P, "variant"]
    both = [stage(named(multiclass=a, quantile=b, inner=c)) for a, b, c in ((val, quant_val, f), (test, quant_test, s))]
    blended = stage(C.temperature_blend(*both, VF).select(*cols))
    both = [stage(named(ordinal=a, inner=b).drop(*ME.P)) for a, b in ((val, f), (test, s))]
    ordinal = stage(ordinal_blend(*both, VF).select(*cols))
    prior = named(prior=test).withColumns({f"p{k}": F.col(f"q{k}") for k in range(3)}).select(*cols)
    trial = union([df.select("fold", "y", *ME.P, F.lit(n).alias("method")) for n, df in (
        ("prior", s.withColumns({f"p{k}": F.col(f"q{k}") for k in range(3)})), ("multiclass", blended.where("variant = 'inner'")), ("ordinal", ordinal.where("variant = 'inner'")))])
    scores = trial.groupBy("fold", "method").agg(ME.brier_expr())
    best = scores.groupBy("fold").agg(F.min(F.struct("brier", "method")).alias("_b"), F.max(F.when(F.col("method") == "prior", F.col("brier"))).alias("_p"))
    pick = stage(best.select("fold", F.when(F.col("_p") - F.col("_b.brier") < 0.001, "prior").otherwise(F.col("_b.method")).alias("variant")))
    outs = union([blended, ordinal, prior]).where("variant <> 'inner'")
    nested = outs.join(F.broadcast(pick), ["fold", "variant"], "left_semi").withColumn("variant", F.lit("nested"))
    long = stage(union([outs.where("variant <> 'prior'"), nested]))
    report = stage(mean_report(stage(fold_report(long))))
    return report.join(stage(intervals_against(long, "multiclass", horizon, iterations)), "variant", "left")


def exp_macro(samples: DataFrame, macro: DataFrame, folds: Sequence[str], features: Sequence[str], macro_features: Sequence[str],
              seeds: Sequence[int] = SEEDS[:3], settings: BO.Settings = BO.Settings()) -> DataFrame:
    """With and without lagged macro features, on the rows that have both."""
    joined = stage(with_prior(MA.attach_macro(samples, macro).dropna(subset=list(macro_features))))
    val, test = split_roles(variant_scores(joined, folds, {"without": features, "with": [*features, *macro_features]}, seeds, settings))
    return mean_report(fold_report(stage(C.temperature_blend(val, test, VF))))


def exp_intervals(samples: DataFrame, folds: Sequence[str], features: Sequence[str], horizon: int, vol: str = "volatility_60s", ppy: int = 252) -> DataFrame:
    """Absolute, predicted-width-scaled and volatility-scaled conformal intervals."""
    ready = M.vectors(samples, features)
    scored = stage(M.together(ready, folds, lambda tr: M.fit_quantiles(tr, by="fold")).drop("features").withColumn("target", F.col("target_return")))
    scored = scored.withColumns({"one": F.lit(1.0), "width": F.col("upper") - F.col("lower"), "vol_scale": C.horizon_scale(F.col(vol), horizon, ppy)})
    val, test = split_roles(scored)
    parts = []
    for name, scale in (("absolute", "one"), ("predicted_width_scaled", "width"), ("volatility_scaled", "vol_scale")):
        fitted = C.conformal_scaled(val, ["fold"], scale)
        parts.append(C.conformal_apply(test.join(fitted, "fold"), F.col("multiplier"), F.col(scale)).withColumn("variant", F.lit(name)))
    base = baseline_quantiles(samples)
    rows = union(parts).join(base, "fold")
    fold = rows.groupBy(*VF).agg(ME.coverage_expr(), ME.interval_score_expr(), ME.interval_score_expr("base_lower", "base_upper", name="baseline_interval_score"),
                                 F.avg(F.col("upper") - F.col("lower")).alias("interval_width"), F.max("multiplier").alias("parameter"))
    return interval_skill(fold, "absolute").join(fold.groupBy("variant").agg(F.avg("interval_width").alias("interval_width")), "variant")


def baseline_quantiles(samples: DataFrame) -> DataFrame:
    from tidemark.operators.quantiles import linear, order_statistics
    return order_statistics(samples.where("role = 'train'"), ["fold"], "target_return", {"base_lower": linear(0.1), "base_mid": linear(0.5), "base_upper": linear(0.9)})


ATR_MULTIPLIERS = (0.35, 0.50, 0.65)  # fixed values


def exp_labels(samples: DataFrame, folds: Sequence[str], features: Sequence[str], horizon: int, seeds: Sequence[int] = SEEDS[:3],
               settings: BO.Settings = BO.Settings()) -> DataFrame:
    """The current neutral band against three ATR-confirmed ones; the stored label must be reproducible."""
    rows = samples.withColumn("_again", maths.direction(F.col("target_return"), F.col("neutral_band_threshold")))
    check = F.when(F.col("_again") != F.col("y"), F.raise_error(F.lit("stored label differs from its reconstruction")).cast("int"))
    rows = rows.withColumn("y", F.coalesce(check, F.col("y"))).drop("_again")
    bands = {"current": F.col("neutral_band_threshold")} | {
        f"atr_{m:.2f}": maths.atr_band(F.col("neutral_band_threshold"), F.col("atr_14_normalized"), horizon, m) for m in ATR_MULTIPLIERS}
    parts = []
    for name, band in bands.items():
        relabelled = with_prior(rows.withColumn("neutral_band_threshold", band).withColumn("y", maths.direction(F.col("target_return"), F.col("neutral_band_threshold"))))
        parts.append(M.vectors(relabelled, features).withColumn("variant", F.lit(name)))
    val, test = split_roles(by_variant(stage(union(parts)), folds, dict.fromkeys(bands, settings), seeds))
    test = stage(C.temperature_blend(val, test, VF))
    shares = ME.class_shares(test, ["variant"])
    return mean_report(fold_report(test)).join(shares, "variant")


def fit_linear_selected(train: DataFrame, sets: dict[str, Sequence[str]], cs: Sequence[float] = M.LINEAR_C) -> M.Scorer:
    """Feature set and strength chosen on the final training year, then refitted on all training rows."""
    inner = stage(L.inner_year(train))
    fit, sel = inner.where("part = 'fit'"), inner.where("part = 'selection'")
    if fit.isEmpty():
        raise ValueError("inner model selection requires a complete final training year")
    best = None
    for name, features in sets.items():
        a, b = M.vectors(fit, features), M.vectors(sel, features)
        for c in cs:
            loss = M.fit_logistic(a, c)(b).agg(ME.brier_expr()).first()[0]
            if loss is not None:
                score = loss + 1e-5 * (len(features) * 3 + 3)
                best = min(best, (score, name, c)) if best else (score, name, c)
    if best is None:
        raise ValueError("inner model selection requires a complete final training year")
    features = sets[best[1]]
    final = M.fit_logistic(M.vectors(train, features), best[2])
    return lambda df: final(M.vectors(df, features)).drop("features")


def exp_linear(samples: DataFrame, folds: Sequence[str], sets: dict[str, Sequence[str]], cs: Sequence[float] = M.LINEAR_C) -> DataFrame:
    scored = stage(M.over_folds(samples, folds, lambda tr: fit_linear_selected(tr, sets, cs)))
    val, test = split_roles(scored)
    out = C.temperature_blend(val, test, ["fold"]).withColumn("variant", F.lit("linear"))
    return mean_report(fold_report(stage(out)))


def regime_rows(samples: DataFrame, test: DataFrame, benchmark: str, roles=RG.EQUITY) -> DataFrame:
    """Test rows with macro regimes; terciles come from each fold's training rows."""
    train_macro = RG.macro_frame(samples.where("role = 'train'"), benchmark, roles, ["fold"])
    test_macro = RG.macro_frame(samples.where("role = 'test'"), benchmark, roles, ["fold"])
    return RG.attach(test, test_macro, RG.thresholds(train_macro, ["fold"]), ["fold"])


def better_baseline(samples: DataFrame, folds: Sequence[str], features: Sequence[str]) -> DataFrame:
    """(ids, b0..b2) of the test rows: of each fold the better of the balanced logistic model and the prior."""
    ready = stage(M.vectors(samples, features))
    rows = stage(M.over_folds(ready, folds, M.fit_balanced_logistic, ("test",)).drop("features"))
    pick = rows.groupBy("fold").agg(ME.brier_expr(name="own"), ME.brier_expr("q", "prior")).select("fold", (F.col("own") < F.col("prior")).alias("_own"))
    return rows.join(pick, "fold").select("fold", "asset_id", "snapshot_time", *[F.when(F.col("_own"), F.col(f"p{k}")).otherwise(F.col(f"q{k}")).alias(f"b{k}") for k in range(3)])


def exp_regimes(samples: DataFrame, scored: DataFrame, folds: Sequence[str], features: Sequence[str], benchmark: str, k: int = 8) -> DataFrame:
    """Outer-fold predictions by fold, asset and macro regime, with the gap to the better baseline and the ``k`` worst ranked."""
    val, test = split_roles(scored)
    blended = C.temperature_blend(val, test, ["fold"]).join(better_baseline(samples, folds, features), ["fold", "asset_id", "snapshot_time"])
    rows = stage(regime_rows(samples, blended, benchmark))
    return worst(ME.segment_summary(rows, ["fold", "asset_id", *REGIMES], "b"), k)


def exp_capacity(samples: DataFrame, folds: Sequence[str], features: Sequence[str], seeds: Sequence[int] = SEEDS[:3]) -> DataFrame:
    """Tree capacity and recency variants."""
    ready = stage(M.vectors(samples, features))
    parts, each = [], {}
    for variant in M.CAPACITY_VARIANTS:
        name, years = variant[0], variant[-1]
        train, rest = ready.where("role = 'train'"), ready.where("role <> 'train'")
        train = B.recent_years(train, "snapshot_time", years, ["fold"]) if years else train
        parts.append(train.unionByName(rest).withColumn("variant", F.lit(name)))
        each[name] = M.capacity_settings(variant)
    val, test = split_roles(by_variant(union(parts), folds, each, seeds))
    return mean_report(fold_report(stage(C.temperature_blend(val, test, VF))))
