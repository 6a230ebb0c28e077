"""Findings of the fourth review: models of few rows, calibration in steps, joint training, explanations of all rows."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tidemark.operators import boosting as BO
from tidemark.operators import calibration as C
from tidemark.operators import metrics as ME
from tidemark.plans import experiments as X
from tidemark.session import stage

FEATS = ["a", "b"]
SMALL = BO.Settings(rounds=3, rate=0.5, depth=3, min_leaf=5)


@pytest.fixture(scope="module")
def samples(spark):
    """Two folds with all roles; the class follows a and b."""
    rng, data = np.random.default_rng(8), []
    for i in range(1400):
        a, b = rng.uniform(-1, 1, 2)
        target = float(0.1 * a + 0.05 * b + rng.normal(0, 0.05))
        day = datetime(2018, 1, 1) + timedelta(days=i % 700)
        role = "train" if i % 700 < 350 else "validation" if i % 700 < 540 else "test"
        data.append((f"A{i % 7}", day, day + timedelta(days=1), f"wf-{i // 700}", role, float(a), float(b), 2 if target > 0.03 else 0 if target < -0.03 else 1, target, 0.03))
    schema = "asset_id string, snapshot_time timestamp_ntz, label_end_time timestamp_ntz, fold string, role string, a double, b double, y int, target_return double, neutral_band_threshold double"
    return stage(X.with_prior(spark.createDataFrame(data, schema)))


def jobs_of(spark, name, call):
    """What ``call`` gives and how many jobs it started."""
    spark.sparkContext.setJobGroup(name, name)
    try:
        out = call()
        return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_models_of_few_rows_take_one_job_a_round(spark, samples, monkeypatch):
    """Folds, seeds, outputs and refitted leaves share it, and the trees are those that levels give."""
    train = stage(samples.where("role = 'train'").withColumn("features", array_to_vector(F.array(*FEATS))))
    short, long = (BO.Settings(rounds=n, min_leaf=5) for n in (1, 9))

    def runs(settings):
        return [BO.Run(train, BO.Softmax(3), "y", "fold", (1, 2), settings), BO.Run(train, BO.Squared(), "target_return", "fold", (1,), settings)]
    _, few = jobs_of(spark, "few", lambda: BO.fit_together([*runs(short), BO.Run(train, BO.Pinball(0.1, 0.9), "target_return", "fold", (1,), short)]))
    _, more = jobs_of(spark, "more", lambda: BO.fit_together([*runs(long), BO.Run(train, BO.Pinball(0.1, 0.9), "target_return", "fold", (1,), long)]))
    assert more - few == 8
    whole = BO.fit_together(runs(long))
    monkeypatch.setattr(BO, "WHOLE", 0)
    for a, b in zip(whole, BO.fit_together(runs(long))):
        for name, model in a.models.items():
            for seed, turns in model.trees.items():
                for one, other in zip((t for turn in turns for t in turn), (t for turn in b.models[name].trees[seed] for t in turn)):
                    assert (one.feature == other.feature).all() and (one.cut == other.cut).all() and np.allclose(one.value, other.value, rtol=1e-9, atol=1e-12)


def test_bins_follow_the_rows_that_have_the_label(spark, samples):
    """A run whose label is missing in places is not changed by a run on the same rows."""
    train = stage(samples.where("role = 'train'").withColumn("features", array_to_vector(F.array(*FEATS))).withColumn("part", F.when(F.col("a") > 0, F.col("target_return"))))
    run = BO.Run(train, BO.Squared(), "part", "fold", (1,), SMALL)
    both = BO.fit_together([BO.Run(train, BO.Softmax(3), "y", "fold", (1,), SMALL), run])[1]
    alone = BO.fit_together([BO.Run(train.where("part is not null"), *[getattr(run, c) for c in ("loss", "label", "by", "seeds", "settings")])])[0]
    for name in ("wf-0", "wf-1"):
        a, b = both.models[name], alone.models[name]
        assert all((x == y).all() for x, y in zip(a.cuts, b.cuts)) and min(a.cuts[0]) > 0 and np.allclose(a.start, b.start)
        assert all(np.allclose(x[0].value, y[0].value) for x, y in zip(a.trees[1], b.trees[1]))


def test_direction_experiment_calibrates_in_written_steps(spark, samples, monkeypatch):
    """No plan holds two calibrations, and each variant has the figures of its own calibration."""
    plans, plain = [], X.stage
    count = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow")
    monkeypatch.setattr(X, "stage", lambda df: (plans.append(count(df)), plain(df))[1])
    out = X.exp_direction(samples, ["wf-0", "wf-1"], FEATS, 30, seeds=(1,), iterations=20, settings=SMALL)
    plans.append(count(out))
    rows = {r["variant"]: r for r in out.collect()}
    assert rows.keys() == {"multiclass", "ordinal", "quantile", "nested"} and all(r["folds"] == 2 for r in rows.values())
    # Temperatures are read for the weight and for the target, of both thresholds where there are two.
    assert max(plans) <= 4
    scored = X.direction_scores(samples, ["wf-0", "wf-1"], FEATS, (1,), SMALL)
    alone = X.mean_report(X.fold_report(C.temperature_blend(*X.split_roles(scored), ["fold"]).withColumn("variant", F.lit("multiclass")))).first()
    assert rows["multiclass"]["brier"] == pytest.approx(alone["brier"], abs=1e-9)
    assert min(rows[v]["brier"] for v in ("multiclass", "ordinal")) <= rows["nested"]["brier"] + 1e-9 or rows["nested"]["brier"] <= rows["nested"]["baseline_brier"] + 1e-9


def test_training_of_all_horizons_is_one_run(spark, samples, monkeypatch):
    """Folds, final fit and horizons share it; each horizon has the manifest of a training of its own."""
    from tidemark.plans import serving as SV
    runs, plain = [], BO.fit_together
    monkeypatch.setattr(BO, "fit_together", lambda *a, **k: (runs.append(len(a[0])), plain(*a, **k))[1])
    rows = stage(samples.withColumns({"target_volatility": F.abs("target_return"), "volatility_60s": F.lit(0.1) + F.abs("a") / 10, "volatility_20s": F.lit(0.2)}))
    other = stage(rows.withColumn("target_return", -F.col("target_return")).withColumn("y", 2 - F.col("y")).withColumns({"q0": F.col("q2"), "q2": F.col("q0")}))
    both = SV.train_horizons({30: rows, 90: other}, ["wf-0", "wf-1"], FEATS, seeds=(1,), settings=SMALL)
    assert runs == [3]
    alone = SV.train(other, ["wf-0", "wf-1"], FEATS, 90, seeds=(1,), settings=SMALL)
    assert runs == [3, 3]
    found, wanted = both[90][1].first().asDict(), alone[1].first().asDict()
    assert found.keys() == wanted.keys()
    for name, value in wanted.items():
        assert found[name] == (pytest.approx(value, abs=1e-9) if isinstance(value, float) else value), name
    assert both[30][1].first()["prior_0"] == pytest.approx(wanted["prior_2"]) and both[30][0].count() == 2


def test_explanations_cover_every_feature_row(spark, tmp_path, monkeypatch):
    """Sessions before the test years and those whose label is not known yet are explained as well."""
    from tidemark.plans import serving as SV
    from tidemark.workbench import q_jobs as J
    from tidemark.workbench import tables as t
    d, rng = str(tmp_path), np.random.default_rng(3)
    types = [t.BENCH, "SMALL"]
    spark.createDataFrame(list(enumerate(types)), "p_partkey long, p_type string").write.parquet(f"{d}/part.parquet")
    lines = [(i * 2 + k, n, k, 1, "RN"[n % 2], float(rng.integers(1, 50)), float(100 + 10 * np.sin(i / 9) + rng.uniform(-3, 3)), datetime(1995, 1, 1) + timedelta(days=i))
             for i in range(240) for k in range(2) for n in range(4)]
    schema = "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long, l_returnflag string, l_quantity double, l_extendedprice double, l_shipdate timestamp_ntz"
    spark.createDataFrame(lines, schema).write.parquet(f"{d}/lineitem.parquet")
    value = F.get(J.M.vector_to_array("features"), F.lit(J.FEATS.index("rsi_14")))
    medians = spark.createDataFrame([(1.0, 1.0, 0.0, 0.3, 0.4, 0.3)], "temperature double, weight double, multiplier double, q0 double, q1 double, q2 double")
    bundle = SV.Bundle(lambda df: df.withColumns({"p0": 0.1 + 0.001 * value, "p1": 0.5 - 0.002 * value, "p2": 0.4 + 0.001 * value * value}),
                       lambda df: df.withColumns({"lower": F.lit(-0.1), "mid": F.lit(0.0), "upper": F.lit(0.1)}), lambda df: df.withColumn("risk", F.lit(0.5)),
                       medians.withColumns({f"r_{f}": F.lit(-7.0) for f in J.FEATS}), J.FEATS, "v")
    monkeypatch.setattr(J, "trained", lambda *a: [(None, None, bundle)])
    rows = J.equity_features(spark, d)
    found = {(r["asset_id"], r["snapshot_time"]): (r["positive"], r["negative"]) for r in J.explain_perturb(spark, d).collect()}
    wanted = {(r["asset_id"], r["snapshot_time"]) for r in rows.collect()}
    last = max(time for _, time in wanted)
    assert found.keys() == wanted and len(wanted) > 60 and last >= datetime(1995, 8, 28)
    assert all("rsi_14" in p + n and "," not in p + n for p, n in found.values())
