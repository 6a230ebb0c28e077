"""Fits and composed jobs on a small table with a planted signal."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import boosting as BO
from tidemark.operators import gates as G
from tidemark.operators import metrics as ME
from tidemark.operators import models as M
from tidemark.plans import serving as SV
from tidemark.session import stage

FEATS = ["a", "b"]
SMALL = BO.Settings(rounds=5, rate=0.5, depth=3, min_leaf=5)


@pytest.fixture(scope="module")
def rows(spark):
    """900 rows over three folds; the class follows feature a, the return and its spread follow both."""
    i = F.col("id")
    a, b = F.pmod(i * 37, F.lit(101)) / 50.0 - 1, F.pmod(i * 53, F.lit(89)) / 44.0 - 1
    base = spark.range(900).select(
        "id", F.concat(F.lit("A"), F.pmod(i, F.lit(6))).alias("asset_id"), F.timestamp_seconds(i * 86400).cast("timestamp_ntz").alias("snapshot_time"),
        a.alias("a"), b.alias("b"), F.when(a > 0.3, 2).when(a < -0.3, 0).otherwise(1).alias("y"),
        (0.1 * a + 0.02 * b).alias("target_return"), (0.2 + 0.1 * F.abs(b)).alias("target_volatility"),
        (0.1 + 0.05 * F.abs(b)).alias("volatility_60s"), F.lit(0.2).alias("volatility_20s"), F.lit(30).alias("horizon_days"))
    parts = []
    for k in range(3):
        role = F.when(i < 450 + 100 * k, "train").when(i < 500 + 100 * k, "validation").when(i < 600 + 100 * k, "test")
        parts.append(base.withColumns({"fold": F.lit(f"wf-{k}"), "role": role}).where("role is not null"))
    df = parts[0].unionByName(parts[1]).unionByName(parts[2])
    train = df.where("role = 'train'").groupBy("fold").agg(*[F.avg((F.col("y") == k).cast("double")).alias(f"q{k}") for k in range(3)])
    return stage(df.join(train, "fold"))


def split(rows):
    ready = M.vectors(rows.withColumn("target_risk", 1 - F.exp(-F.col("target_volatility"))).where("fold = 'wf-0'"), FEATS)
    return ready.where("role = 'train'"), ready.where("role = 'test'")


@pytest.mark.parametrize("kind", ["forest", "logistic", "balanced"])
def test_direction_models_beat_the_prior(rows, kind):
    train, test = split(rows)
    fit = {"forest": lambda: M.fit_forest(train, (1, 2), trees=8, depth=4, min_leaf=5), "logistic": lambda: M.fit_logistic(train, 1.0), "balanced": lambda: M.fit_balanced_logistic(train)}[kind]()
    out = fit(test)
    bad = out.where((F.abs(F.col("p0") + F.col("p1") + F.col("p2") - 1) > 1e-9) | (F.least(*ME.P) < 0))
    assert bad.count() == 0
    row = out.agg(ME.brier_expr(name="own"), ME.brier_expr("q", "prior")).first()
    assert row["own"] < 0.7 * row["prior"]


def test_matrix_calibrator_is_at_its_optimum(rows):
    """At the optimum the mean residual of each class is zero (the intercepts are not penalised)."""
    train, test = split(rows)
    scored = stage(M.fit_direction(train, (1,), settings=SMALL)(test).drop("features"))
    out = M.fit_matrix_calibrator(scored, 1.0)(scored)
    row = out.agg(*[F.avg(F.col(f"p{k}") - (F.col("y") == k).cast("double")).alias(f"g{k}") for k in range(3)]).first()
    assert max(abs(row[f"g{k}"]) for k in range(3)) < 1e-3


def test_training_ends_in_a_bundle_and_its_manifest(spark, rows):
    metrics, manifest, bundle = SV.train(rows, ["wf-0", "wf-1", "wf-2"], FEATS, 30, seeds=(1,), settings=SMALL)
    row = manifest.first()
    last = metrics.orderBy(F.desc("fold")).first()
    assert metrics.count() == 3 and row["temperature"] == last["temperature"] and row["conformal_multiplier"] == last["conformal_multiplier"]
    once = rows.dropDuplicates(["asset_id", "snapshot_time"])
    assert row["sample_count"] == once.count() and sum(row[f"prior_{k}"] for k in range(3)) == pytest.approx(1.0)
    assert row["prior_2"] == pytest.approx(once.where("y = 2").count() / once.count())
    assert row["feature_reference"]["a"] == pytest.approx(once.agg(F.median("a")).first()[0])
    assert row["production_eligible"] == row["scenario_passed"]
    feats = once.where("id >= 790").groupBy("asset_id").agg(F.max_by(F.struct("a", "b", "volatility_60s"), "id").alias("f")).select("asset_id", F.lit("2030-01-01").cast("timestamp_ntz").alias("snapshot_time"), "f.*")
    ready = feats.select("asset_id", (F.col("asset_id") != "A3").alias("ready"))
    cut = F.lit("2030-01-01").cast("timestamp_ntz")
    stored = spark.createDataFrame([], "asset_id string, snapshot_time timestamp_ntz, version string")
    model = {"direction_eligible": True, "scenario_eligible": False}

    def day(now, old=stored):
        return SV.daily_score(bundle, feats, ready, cut, F.lit(now).cast("timestamp_ntz"), model, old, F.lit(0.1), True, F.lit(True))
    fresh = stage(day("2030-01-01 05:00:00"))
    assert {r["asset_id"] for r in fresh.collect()} == {"A0", "A1", "A2", "A4", "A5"}
    assert all(abs(r["p0"] + r["p1"] + r["p2"] - 1) < 1e-9 and r["lower"] <= r["mid"] <= r["upper"] and 0 <= r["risk_score"] <= 1 for r in fresh.collect())
    assert all("scenario_unverified" in r["limitations"] for r in fresh.collect())
    late = {r["status"] for r in day("2030-01-04").collect()}
    assert late and late.isdisjoint({r["status"] for r in fresh.collect()})
    assert day("2030-01-01 05:00:00", fresh.select("asset_id", "snapshot_time", "version")).count() == 0


def test_experiments_share_one_training_run(spark, rows, monkeypatch):
    """Variants, folds and seeds are groups of one run; their figures are those of runs of their own."""
    from tidemark.plans import experiments as X
    runs, plain = [], BO.fit
    monkeypatch.setattr(BO, "fit", lambda *a, **k: (runs.append(a[1]), plain(*a, **k))[1])
    folds = ["wf-0", "wf-1"]
    samples = rows.withColumns({"label_end_time": F.col("snapshot_time") + F.expr("INTERVAL 1 DAY"), "neutral_band_threshold": F.lit(0.03), "atr_14_normalized": F.lit(0.01)})
    both = X.variant_scores(samples, folds, {"one": ["a"], "two": FEATS}, (1,), SMALL)
    assert len(runs) == 1 and both.where("role = 'train'").count() == 0
    alone = X.variant_scores(samples, folds, {"one": ["a"], "other": ["b"]}, (1,), SMALL).where("variant = 'one'").drop("variant")
    key = ["fold", "asset_id", "snapshot_time"]
    other = alone.select(*key, *[F.col(p).alias(f"o{p}") for p in ME.P])
    apart = both.where("variant = 'one'").join(other, key).agg(F.count(F.lit(1)).alias("n"), F.max(F.abs(F.col("p0") - F.col("op0"))).alias("d")).first()
    assert apart["n"] == alone.count() and apart["d"] < 1e-9
    report = {r["variant"]: r for r in X.exp_feature_groups(samples, folds, {"spot": ["b"], "full": FEATS}, 30, iterations=50, settings=SMALL).collect()}
    assert report["full"]["brier"] < report["spot"]["brier"] and report["full"]["risk_mae"] >= 0 and report["full"]["folds"] == 2
    calibrated = X.exp_calibration(alone, folds).collect()
    assert {r["variant"] for r in calibrated} == {"raw", "temperature_blend", "selected"}
    segments = X.worst(spark.createDataFrame([("d", str(k), float(k)) for k in range(6)], "dimension string, value string, brier_delta double"), 3)
    assert sorted((r["value"], r["worst_rank"]) for r in segments.collect() if r["worst_rank"]) == [("3", 3), ("4", 2), ("5", 1)]


def test_capacity_settings_follow_the_fixed_values():
    settings = {v[0]: M.capacity_settings(v) for v in M.CAPACITY_VARIANTS}
    assert settings["current"].rounds == 50 and settings["current"].rate == pytest.approx(0.2) and settings["very_shallow"].leaves == 5
    assert settings["shallow"].min_leaf == 200 and settings["shallow"].l2 == 10.0
