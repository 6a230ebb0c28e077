"""Model fits, scoring and composed jobs.  Models have no SQL form; dataset jobs are checked by oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions import maths
from tidemark.operators import calibration as C
from tidemark.operators import features as FE
from tidemark.operators import gates as G
from tidemark.operators import labels as L
from tidemark.operators import macro as MA
from tidemark.operators import metrics as ME
from tidemark.operators import models as M
from tidemark.operators import scoring as SC
from tidemark.plans import datasets as DS
from tidemark.plans import experiments as X
from tidemark.plans import serving as SV
from tidemark.session import at_once, kept, known, stage
from tidemark.workbench import q_features as QF
from tidemark.workbench import q_market as QM
from tidemark.workbench import tables as t
from tidemark.workbench.registry import big, query, r, rexp

YEARS = QF.YEARS
FOLDS = [f"wf-{y}" for y in YEARS]
FEATS = list(schemas.EQUITY_FEATURES)
# Feature groups of the ablation: price and volume alone, with the benchmark, with the cross-section, all.
CROSS = ["market_breadth_20s", "momentum_rank_20s", "momentum_rank_60s", "volatility_rank_20s"]
BENCH = ["benchmark_correlation_20s", "benchmark_correlation_60s", "benchmark_beta_20s", "relative_strength_20s"]
SPOT = [f for f in FEATS if f not in (*CROSS, *BENCH)]
HORIZON = 30
SCALE = ("volatility_60s", HORIZON, 252)


def equity_bars(spark, d):
    """Session bars; every expected asset has some."""
    def make():
        daily = stage(t.daily_bars(spark, d))
        DS.require_bars(daily, t.part_assets(spark, d))
        return daily
    return kept(spark, "equity-bars", d, make)


def equity_features(spark, d):
    """Every complete feature row, whether or not its label is known yet."""
    return kept(spark, "equity-features", d, lambda: FE.equity_snapshots(equity_bars(spark, d), t.BENCH, trend_limit=0.2, vol_limit=15.0))


def labelled(spark, d, horizon=HORIZON):
    """Labelled equity samples with their own features and those of the benchmark and its regime."""
    def make():
        feats = equity_features(spark, d)
        rows = DS.label_equity(feats, equity_bars(spark, d), (horizon,), band=QF.WIDE)
        rows = DS.build_equity_macro(rows, t.BENCH).withColumn("y", F.col("target_direction"))
        regime = rows.where(F.col("asset_id") == t.BENCH).select("snapshot_time", F.col("market_regime").alias("spy_regime"))
        return rows.join(regime, "snapshot_time", "left")
    return kept(spark, f"labelled-{horizon}", d, make)


def samples(spark, d, horizon=HORIZON):
    """The samples with folds, roles and the fold prior."""
    return kept(spark, f"samples-{horizon}", d, lambda: X.with_prior(kept(spark, f"folds-{horizon}", d, lambda: L.walk_forward(labelled(spark, d, horizon), YEARS))))


def prepared(spark, d):
    """Feature vectors of all folds with the risk target."""
    return kept(spark, "vectors", d, lambda: M.vectors(samples(spark, d).withColumn("target_risk", maths.target_risk(F.col("target_volatility"))), FEATS))


def scored(spark, d):
    """Raw probabilities of the validation and test rows by the five-seed model; several queries start from them."""
    return kept(spark, "scored", d, lambda: X.direction_scores(samples(spark, d), FOLDS, FEATS))


OUT = ["fold", "asset_id", "snapshot_time", "y"]


@query("model_direction")
def model_direction(spark, d):
    return scored(spark, d).where("role = 'test'").select(*OUT, *ME.P)


@query("model_ordinal")
def model_ordinal(spark, d):
    rows = M.together(prepared(spark, d), FOLDS, lambda tr: M.fit_ordinal(tr, by="fold"))
    return X.ordinal_blend(*X.split_roles(stage(rows.drop("features")))).select(*OUT, *ME.P)


@query("model_quantile")
def model_quantile(spark, d):
    return M.together(prepared(spark, d), FOLDS, lambda tr: M.fit_quantiles(tr, by="fold"), ("test",)).select(*OUT, "lower", "mid", "upper")


@query("model_risk")
def model_risk(spark, d):
    return M.together(prepared(spark, d), FOLDS, lambda tr: M.fit_risk(tr, by="fold"), ("test",)).select(*OUT, "risk", "target_risk")


def selectable(rows):
    """The folds whose final training year holds enough rows to select a model on."""
    return sorted(r["fold"] for r in L.inner_year(rows.where("role = 'train'")).select("fold").distinct().collect())


def unfitted(spark, fitted):
    """A row for each fold without a model."""
    return spark.createDataFrame([(f, "final training year too short") for f in FOLDS if f not in fitted], "fold string, reason string")


LINEAR = {"stable": SPOT[:8], "full": FEATS}


@query("model_linear")
def model_linear(spark, d):
    rows = prepared(spark, d).drop("features")
    folds = selectable(rows)
    out = M.over_folds(rows, folds, lambda tr: X.fit_linear_selected(tr, LINEAR), ("test",)).select(*OUT, *ME.P)
    return out.unionByName(unfitted(spark, folds), allowMissingColumns=True)


@query("model_baseline")
def model_baseline(spark, d):
    rows = M.over_folds(prepared(spark, d), FOLDS, M.fit_balanced_logistic, ("test",))
    return rows.groupBy("fold").agg(ME.brier_expr(name="logistic_brier"), ME.brier_expr("q", "climatology_brier")).withColumn(
        "baseline_brier", F.least("logistic_brier", "climatology_brier"))


def capacity(spark, d):
    return kept(spark, "capacity", d, lambda: X.exp_capacity(samples(spark, d), FOLDS, FEATS))


@query("model_capacity_variants")
def model_capacity_variants(spark, d):
    return capacity(spark, d).select("variant", "brier", "brier_skill_score", "log_loss", "accuracy", "ece")


@query("cal_matrix")
def cal_matrix(spark, d):
    p = t.predictions(spark, d)
    return M.fit_matrix_calibrator(p, 0.1)(p).select("event_id", *ME.P)


@query("cal_select")
def cal_select(spark, d):
    p = t.predictions(spark, d).withColumns({f"q{k}": F.col(f"b{k}") for k in range(3)})
    p = stage(p.withColumn("label_end_time", F.col("snapshot_time") + F.expr("INTERVAL 1 DAY")))
    return X.select_calibrator(p, ["wf-2021", "wf-2022", "wf-2023"])


@query("score_batch")
def score_batch(spark, d):
    """Every fold's test rows by the models of that fold, calibrated on its validation rows."""
    rows = fold_scores(spark, d)
    val, test = X.split_roles(rows.withColumns({"target": F.col("target_return"), "scale": C.horizon_scale(F.col(SCALE[0]), *SCALE[1:])}))
    fitted = F.broadcast(C.temperature_fit(val, ["fold"]))
    weight = C.blend_fit(C.temperature_apply(val.join(fitted, "fold"), F.col("temperature")), ["fold"])
    ready = test.join(fitted, "fold").join(weight, "fold").join(C.conformal_scaled(val, ["fold"]), "fold")
    return SC.finish_score(ready, F.col("temperature"), F.col("weight"), F.col("multiplier"), F.col("scale")).select(*OUT, *ME.P, "lower", "mid", "upper", "risk_score")


def fold_scores(spark, d):
    return kept(spark, "fold-scores", d, lambda: SV.train_folds(samples(spark, d), FOLDS, FEATS))


@query("explain_perturb")
def explain_perturb(spark, d):
    """Top factors of every complete feature row, by the final models."""
    [(_, _, final)] = trained(spark, d, HORIZON)
    out = SV.explain(final, equity_features(spark, d), ["asset_id", "snapshot_time"], C.horizon_scale(F.col(SCALE[0]), *SCALE[1:]))
    return out.select("asset_id", "snapshot_time", F.array_join("positive", ",").alias("positive"), F.array_join("negative", ",").alias("negative"))


# --- dataset jobs --------------------------------------------------------------------------------

_names = ("return_30d", "volatility_30d", "rsi_14", "market_breadth_30d", "momentum_rank_30d")
_deriv = ("funding_rate_mean_7d", "premium_zscore_90d", "futures_volume_zscore_30d", "open_interest_change_30d", "derivatives_available")


@query("job_dataset_crypto", f"""WITH {QF.SQL_CRYPTO}, {QF.SQL_DERIV}, h AS (SELECT 30 AS h UNION ALL SELECT 90), sp AS (SELECT al.asset_id, al.open_time, al.close, al.return_30d, al.volatility_30d, al.volatility_90d, al.rsi_14, br.breadth AS market_breadth_30d, k30.q AS momentum_rank_30d, al.i
 FROM al JOIN br USING (open_time) JOIN k30 ON k30.open_time = al.open_time AND k30.asset_id = al.asset_id),
sf AS (SELECT sp.*, {', '.join(f'coalesce(f.{c}, 0.0) AS {c}' for c in _deriv)} FROM sp ASOF LEFT JOIN dfeat f ON sp.asset_id = f.asset_id AND sp.open_time >= f.snapshot_time),
fw AS (SELECT *, 30 AS horizon_days, ln(lead(close, 30) OVER w / close) AS target_return, lead(open_time, 30) OVER w AS label_end_time, {QF.q_band('volatility_30d', 'volatility_90d', 30, 365)} AS band FROM sf WINDOW w AS (PARTITION BY asset_id ORDER BY open_time)
 UNION ALL SELECT *, 90, ln(lead(close, 90) OVER w / close), lead(open_time, 90) OVER w, {QF.q_band('volatility_30d', 'volatility_90d', 90, 365)} FROM sf WINDOW w AS (PARTITION BY asset_id ORDER BY open_time))
SELECT asset_id, open_time AS snapshot_time, {big('horizon_days')}, {r(*_names, *_deriv)}, {r('target_return')}, label_end_time, {big('CASE WHEN target_return > band THEN 2 WHEN target_return < -band THEN 0 ELSE 1 END', 'target_direction')}, 'crypto-daily-v2' AS dataset_version
FROM fw WHERE i >= 364 AND target_return IS NOT NULL""")
def job_dataset_crypto(spark, d):
    out = crypto_samples(spark, d)
    return out.select("asset_id", "snapshot_time", "horizon_days", *_names, *_deriv, "target_return", "label_end_time", "target_direction", "dataset_version")


def crypto_samples(spark, d):
    """Labelled crypto samples of both horizons with spot, derivative and cross-section features."""
    return kept(spark, "crypto", d, lambda: DS.build_crypto(
        t.item_ticks(spark, d), QF.asset_derivatives(spark, d), t.BENCH, QF._hot, order=t.TICK_ORDER, band=QF.WIDE, trend_limit=QF.TREND, vol_limit=QF.VOL))


SQL_EQJOB = f"""{QF.SQL_EQUITY}, fw AS (SELECT asset_id, open_time AS snapshot_time, ln(lead(close, 30) OVER w / close) AS target_return, lead(open_time, 30) OVER w AS label_end_time FROM bars WINDOW w AS (PARTITION BY asset_id ORDER BY open_time)),
ej AS (SELECT eq.*, target_return, label_end_time, {QF.q_band('volatility_20s', 'volatility_60s', 30, 252)} AS band FROM eq JOIN fw USING (asset_id, snapshot_time) WHERE target_return IS NOT NULL)"""
_eq = ("return_20s", "volatility_60s", "momentum_rank_20s", "target_return")


@query("job_dataset_equity", f"WITH {SQL_EQJOB} SELECT asset_id, snapshot_time, {r(*_eq)}, label_end_time, {big('CASE WHEN target_return > band THEN 2 WHEN target_return < -band THEN 0 ELSE 1 END', 'target_direction')} FROM ej")
def job_dataset_equity(spark, d):
    out = DS.build_equity(t.daily_bars(spark, d), t.part_assets(spark, d), t.BENCH, (30,), band=QF.WIDE, trend_limit=0.2, vol_limit=15.0)
    return out.select("asset_id", "snapshot_time", *_eq, "label_end_time", "target_direction")


@query("job_dataset_equity_macro", f"""WITH {SQL_EQJOB}, b AS (SELECT snapshot_time, return_20s AS b20, return_60s AS b60, volatility_20s AS v20, volatility_60s AS v60, market_regime AS mr FROM ej WHERE asset_id = '{t.BENCH}')
SELECT asset_id, snapshot_time, {rexp('b20', 'benchmark_return_20s')}, {rexp('b60', 'benchmark_return_60s')}, {rexp('v20', 'benchmark_volatility_20s')}, {rexp('v60', 'benchmark_volatility_60s')}, {rexp('abs(b60) / (greatest(v60, 1e-6) * sqrt(60.0 / 252))', 'benchmark_trend_strength_60s')}, {rexp('mr', 'benchmark_market_regime')}
FROM ej LEFT JOIN b USING (snapshot_time)""")
def job_dataset_equity_macro(spark, d):
    out = DS.build_equity(t.daily_bars(spark, d), t.part_assets(spark, d), t.BENCH, (30,), band=QF.WIDE, trend_limit=0.2, vol_limit=15.0)
    return DS.build_equity_macro(out, t.BENCH).select("asset_id", "snapshot_time", *schemas.EQUITY_MACRO_FEATURES)


SEED_END = "2001-07-30"


@query("job_history_seed", f"""WITH {t.SQL_SNAPS}, full_days AS (SELECT * FROM snaps WHERE snapshot_time BETWEEN TIMESTAMP '{SEED_END}' - INTERVAL 119 DAY AND TIMESTAMP '{SEED_END}' AND funding_rate IS NOT NULL AND premium IS NOT NULL AND futures_taker_buy_ratio IS NOT NULL AND open_interest_value IS NOT NULL AND long_short_ratio IS NOT NULL AND taker_long_short_ratio IS NOT NULL),
ar AS (SELECT asset_id, snapshot_time, funding_rate, futures_quote_volume, 'archive' AS source FROM full_days),
lv AS (SELECT asset_id, snapshot_time, coalesce(funding_rate, 0) AS funding_rate, futures_quote_volume, 'live' AS source FROM snaps WHERE snapshot_time BETWEEN TIMESTAMP '{SEED_END}' - INTERVAL 119 DAY AND TIMESTAMP '{SEED_END}' AND (asset_id, snapshot_time) NOT IN (SELECT (asset_id, snapshot_time) FROM ar))
SELECT asset_id, snapshot_time, {r('funding_rate', 'futures_quote_volume')}, source FROM ar UNION ALL SELECT asset_id, snapshot_time, {r('funding_rate', 'futures_quote_volume')}, source FROM lv""")
def job_history_seed(spark, d):
    s = stage(t.order_snapshots(spark, d))
    live = s.fillna(0.0, list(schemas.DERIVATIVE_VALUES))
    stored = s.limit(0).withColumn("source", F.lit(""))
    ids = s.select("asset_id").distinct()
    return DS.seed_history(ids, s, live, stored, t.ts(SEED_END), 120, reach=120).select("asset_id", "snapshot_time", "funding_rate", "futures_quote_volume", "source")


@query("job_collect_derivatives", f"""WITH {t.SQL_BARS}, m AS (SELECT max(open_time) AS day FROM bars), ok AS (SELECT asset_id FROM bars, m WHERE open_time = day AND trade_count % 5 <> 0)
SELECT DISTINCT p_type AS asset_id, CASE WHEN p_type IN (SELECT asset_id FROM ok) THEN 'snapshot' ELSE 'issue' END AS outcome FROM part""")
def job_collect_derivatives(spark, d):
    series = QM.grid_series(spark, d)
    last = t.daily_bars(spark, d).agg(F.max("open_time").alias("m"))
    cutoff = last.select(F.col("m") + F.expr("INTERVAL 1 DAY")).scalar()
    stored = spark.createDataFrame([], "asset_id string, snapshot_time timestamp_ntz")
    issues = spark.createDataFrame([], "asset_id string, code string, data_time timestamp_ntz, is_resolved boolean")
    fresh, log = DS.collect_derivatives(series, stored, t.part_assets(spark, d), issues, cutoff, F.current_timestamp())
    return fresh.select("asset_id", F.lit("snapshot").alias("outcome")).unionByName(log.select("asset_id", F.lit("issue").alias("outcome")))


# --- training, scoring, experiments --------------------------------------------------------------

_trained: dict[tuple, tuple] = {}


def trained(spark, d, *horizons):
    """Metrics, manifest and final bundle of each horizon, fitted once per session and table folder; new ones in one run."""
    new = [h for h in horizons if not known(spark, f"trained-{h}", d)]
    if new:
        equity_features(spark, d)  # both horizons label these
        rows = dict(zip(new, at_once(*[lambda h=h: samples(spark, d, h) for h in new])))
        scored = {HORIZON: fold_scores(spark, d)} if HORIZON in new and known(spark, "fold-scores", d) else {}
        for h, (metrics, manifest, final, tested) in SV.train_horizons(rows, FOLDS, FEATS, scored=scored).items():
            _trained[spark.sparkContext.applicationId, d, h] = manifest, final
            kept(spark, f"trained-{h}", d, lambda: metrics)
            if h == HORIZON:
                kept(spark, "fold-scores", d, lambda: tested)
    return [(kept(spark, f"trained-{h}", d, None), *_trained[spark.sparkContext.applicationId, d, h]) for h in horizons]


@query("job_train")
def job_train(spark, d):
    """The manifests of both horizons."""
    both = [manifest for _, manifest, _ in trained(spark, d, *schemas.HORIZONS)]
    reference = F.array_sort(F.transform(F.map_entries("feature_reference"), lambda e: F.concat_ws("=", e["key"], F.round(e["value"], 6).cast("string"))))
    return both[0].unionByName(both[1]).withColumn("feature_reference", F.array_join(reference, ","))


def _daily_equity(spark, d):
    """Every ready asset's prediction for the newest session with enough features, by the final bundle."""
    [(_, manifest, final)] = trained(spark, d, HORIZON)
    feats = newest_features(spark, d)
    cutoff = feats.agg(F.max("snapshot_time")).scalar()
    ready = G.readiness_spot(t.daily_bars(spark, d).where(F.col("open_time") <= cutoff), cutoff, t.BENCH, 252, assets=t.part_assets(spark, d).select("asset_id"))
    stored = spark.createDataFrame([], "asset_id string, snapshot_time timestamp_ntz, version string")
    model = manifest.select("direction_eligible", "scenario_eligible").first().asDict()
    now = feats.agg(F.max("snapshot_time") + F.expr("INTERVAL 1 HOUR")).scalar()
    out = SV.daily_score(final, feats, ready, cutoff, now, model, stored, C.horizon_scale(F.col(SCALE[0]), *SCALE[1:]), True, F.lit(True))
    lists = {c: F.array_join(c, ",") for c in ("positive", "negative", "limitations")}
    return out.withColumns(lists)


def newest_features(spark, d):
    """Feature rows of the newest session on which the benchmark is complete; these have no labels yet."""
    rows = FE.complete_samples(FE.equity_snapshots(t.daily_bars(spark, d), t.BENCH, trend_limit=0.2, vol_limit=15.0), FEATS)
    rows = stage(rows.select("asset_id", "snapshot_time", *FEATS))
    last = rows.where(F.col("asset_id") == t.BENCH).agg(F.max("snapshot_time")).scalar()
    return rows.where(F.col("snapshot_time") == last)


CRYPTO_FEATS = [*schemas.SPOT_FEATURES, *schemas.DERIVATIVE_FEATURES, *schemas.CROSS_SECTION_FEATURES, *[f"asset_{s.lower()}" for s in QF._hot]]
CRYPTO_SCALE = ("volatility_30d", HORIZON, 365)


def crypto_bundle(spark, d):
    """The manifest and models of the crypto samples, on their own features; fitted once per session and table folder."""
    key = (spark.sparkContext.applicationId, d, "crypto")

    def fit():
        rows = crypto_samples(spark, d).where(F.col("horizon_days") == HORIZON).withColumn("y", F.col("target_direction"))
        folds = X.with_prior(stage(L.walk_forward(rows, YEARS)))
        found = sorted(r["fold"] for r in folds.where("role = 'test'").select("fold").distinct().collect())  # a row for each year
        metrics, *rest = SV.train(stage(folds), found, CRYPTO_FEATS, HORIZON, 365, CRYPTO_SCALE[0], "volatility_30d", seeds=schemas.SEEDS[:2], version="tidemark-crypto-1")
        _trained[key] = tuple(rest)
        return metrics
    kept(spark, "trained-crypto", d, fit)
    return _trained[key]


@query("job_daily_score_crypto")
def job_daily_score_crypto(spark, d):
    """Predictions of the newest day on which the benchmark is complete, for assets whose spot and derivative history is ready."""
    manifest, final = crypto_bundle(spark, d)
    daily, deriv = t.series(spark, d), QF.asset_derivatives(spark, d).where(F.col("asset_id").isNotNull())
    cutoff = daily.where(F.col("asset_id") == t.BENCH).agg(F.max("open_time")).scalar()
    now = daily.agg(F.max("open_time") + F.expr("INTERVAL 1 HOUR")).scalar()
    feats = stage(FE.crypto_snapshots(daily.where(F.col("open_time") <= cutoff), deriv, t.BENCH, QF._hot, trend_limit=QF.TREND, vol_limit=QF.VOL))
    ids = daily.select("asset_id").distinct()
    spot = G.readiness_spot(daily.where(F.col("open_time") <= cutoff), cutoff, t.BENCH, 365, assets=ids).select("asset_id", F.col("ready").alias("_spot"))
    ready = G.readiness_history(deriv, cutoff, now, assets=ids).join(spot, "asset_id").select("asset_id", (F.col("ready") & F.col("_spot")).alias("ready"))
    stored = spark.createDataFrame([], "asset_id string, snapshot_time timestamp_ntz, version string")
    model = manifest.select("direction_eligible", "scenario_eligible").first().asDict()
    out = SV.daily_score(final, feats, ready, cutoff, now, model, stored, C.horizon_scale(F.col(CRYPTO_SCALE[0]), *CRYPTO_SCALE[1:]), False, F.lit(True))
    return out.withColumns({c: F.array_join(c, ",") for c in ("positive", "negative", "limitations")})


@query("job_daily_score_equity")
def job_daily_score_equity(spark, d):
    return _daily_equity(spark, d)


@query("exp_feature_groups")
def exp_feature_groups(spark, d):
    groups = {"spot": SPOT, "spot_cross": [*SPOT, *CROSS], "spot_benchmark": [*SPOT, *BENCH], "full": FEATS}
    return X.exp_feature_groups(samples(spark, d), FOLDS, groups, HORIZON)


@query("exp_calibration")
def exp_calibration(spark, d):
    return X.exp_calibration(scored(spark, d), FOLDS)


@query("exp_calibration_segments")
def exp_calibration_segments(spark, d):
    return X.exp_calibration_segments(samples(spark, d), scored(spark, d), t.BENCH)


@query("exp_conditional_prior")
def exp_conditional_prior(spark, d):
    """The fourth year is the locked one: no other query tests on it."""
    rows = kept(spark, "four-years", d, lambda: L.walk_forward(labelled(spark, d), (*YEARS, YEARS[-1] + 1)))
    return X.exp_prior(X.with_prior(rows))


@query("exp_direction_models")
def exp_direction_models(spark, d):
    return X.exp_direction(samples(spark, d), FOLDS, FEATS, HORIZON)


@query("exp_macro")
def exp_macro(spark, d):
    macro = stage(MA.macro_features(MA.wide_macro(t.macro_long(spark, d), t.SERIES)))
    return X.exp_macro(samples(spark, d), macro, FOLDS, FEATS, schemas.MACRO_FEATURES)


@query("exp_intervals")
def exp_intervals(spark, d):
    return X.exp_intervals(samples(spark, d), FOLDS, FEATS, HORIZON)


@query("exp_labels")
def exp_labels(spark, d):
    return X.exp_labels(samples(spark, d), FOLDS, FEATS, HORIZON)


@query("exp_linear")
def exp_linear(spark, d):
    folds = selectable(samples(spark, d))
    out = X.exp_linear(samples(spark, d), folds, LINEAR)
    return out.unionByName(unfitted(spark, folds).withColumnRenamed("fold", "variant"), allowMissingColumns=True)


@query("exp_regimes")
def exp_regimes(spark, d):
    return X.exp_regimes(samples(spark, d), scored(spark, d), FOLDS, FEATS, t.BENCH)


@query("exp_capacity")
def exp_capacity(spark, d):
    return capacity(spark, d)
