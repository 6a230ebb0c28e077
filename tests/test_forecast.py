"""Labels, folds, calibration, priors, metrics and gates with known values."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import maths
from tidemark.operators import bootstrap, calibration, gates, labels, metrics, priors, regimes, scoring


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def preds(spark, y, p, **more):
    pdf = pd.DataFrame({"fold": "f", "y": y, "p0": [r[0] for r in p], "p1": [r[1] for r in p], "p2": [r[2] for r in p], **more})
    return spark.createDataFrame(pdf)


def test_neutral_band_and_direction(spark):
    v = F.lit
    r = one(spark, a=maths.neutral_band(v(0.05), None, 30), b=maths.neutral_band(v(4.0), v(3.0), 30), low=maths.neutral_band(v(0.05), v(0.08), 30),
            up=maths.direction(F.ln(v(1.3)), maths.neutral_band(v(0.5), None, 30)), down=maths.direction(F.ln(v(0.7)), maths.neutral_band(v(0.5), None, 30)),
            mid=maths.direction(F.ln(v(1.01)), maths.neutral_band(v(0.5), None, 30)))
    assert r["low"] == pytest.approx(0.5 * 0.20 * math.sqrt(30 / 365)) and r["b"] == pytest.approx(0.18)
    assert (r["up"], r["down"], r["mid"]) == (2, 0, 1)


def test_atr_band_is_capped(spark):
    r = one(spark, a=maths.atr_band(F.lit(0.06), F.lit(0.02), 90, 0.5), b=maths.atr_band(F.lit(0.10), F.lit(1.0), 90, 0.5))
    assert r["a"] >= 0.06 and r["b"] == pytest.approx(0.18 * math.sqrt(3))


def test_forward_targets_match_brute_force(spark):
    g = np.random.default_rng(2)
    close = 50 * np.exp(np.cumsum(g.normal(0, 0.03, 1300)))
    pdf = pd.DataFrame({"asset_id": "A", "open_time": pd.date_range("2020-01-01", periods=1300), "close": close})
    out = labels.forward_targets(spark.createDataFrame(pdf), 30).orderBy("open_time").toPandas()
    assert len(out) == 1270
    for i in (0, 500, 1020, 1269):
        path = close[i + 1:i + 31]
        assert out["target_return"][i] == pytest.approx(math.log(close[i + 30] / close[i]))
        assert out["target_volatility"][i] == pytest.approx(np.std(np.diff(np.log(path)), ddof=1) * math.sqrt(365))
        assert out["target_max_drawdown"][i] == pytest.approx((path / np.maximum.accumulate(path) - 1).min())
        assert out["label_end_time"][i] == pdf["open_time"][i + 30]


def test_walk_forward_is_purged(spark):
    t = pd.date_range("2018-01-01", "2025-12-31")
    df = spark.createDataFrame(pd.DataFrame({"snapshot_time": t, "label_end_time": t + pd.Timedelta(days=90)}))
    out = labels.walk_forward(df)
    agg = out.groupBy("fold", "role").agg(F.min("snapshot_time").alias("lo"), F.max("label_end_time").alias("hi")).toPandas().set_index(["fold", "role"])
    assert sorted({f for f, _ in agg.index}) == ["wf-2023", "wf-2024", "wf-2025"]
    for fold in ("wf-2023", "wf-2024", "wf-2025"):
        gap = pd.Timedelta(days=7)
        assert agg.loc[(fold, "train"), "hi"] + gap < agg.loc[(fold, "validation"), "lo"]
        assert agg.loc[(fold, "validation"), "hi"] + gap < agg.loc[(fold, "test"), "lo"]
    assert labels.walk_forward(df, (2017,)).count() == 0


def test_perfect_forecast(spark):
    df = preds(spark, [0, 1, 2], np.eye(3))
    m = metrics.summary(df, ["fold"]).first()
    assert m["brier"] == 0 and m["ece"] == 0 and m["classwise_ece"] == 0 and m["reliability"] == 0 and m["accuracy"] == 1
    assert m["resolution"] == pytest.approx(m["uncertainty"])


def test_climatology_has_no_resolution(spark):
    m = metrics.murphy(preds(spark, [0, 1, 2] * 5, [(1 / 3,) * 3] * 15), ["fold"]).first()
    assert m["reliability"] == pytest.approx(0) and m["resolution"] == pytest.approx(0) and m["uncertainty"] == pytest.approx(2 / 3)


def test_interval_metrics(spark):
    df = spark.createDataFrame([("f", -1.0, -2.0, 0.0), ("f", 0.0, -1.0, 1.0), ("f", 1.0, 0.0, 2.0), ("f", 2.0, 3.0, 4.0)], "fold string, target double, lower double, upper double")
    assert df.groupBy("fold").agg(metrics.coverage_expr()).first()["coverage"] == 0.75
    df2 = spark.createDataFrame([("f", 0.0, -1.0, 1.0), ("f", 3.0, -1.0, 1.0)], "fold string, target double, lower double, upper double")
    assert df2.groupBy("fold").agg(metrics.interval_score_expr()).first()["interval_score"] == pytest.approx(12.0)
    with pytest.raises(Exception, match="crossed"):
        metrics.reject_crossed(df2.withColumn("upper", F.lit(-5.0))).agg(metrics.interval_score_expr()).collect()


def test_temperature_flattens_overconfidence(spark):
    df = preds(spark, [0, 1, 2] * 20, [(0.98, 0.01, 0.01)] * 60)
    t = calibration.temperature_fit(df, ["fold"]).first()["temperature"]
    grid = np.geomspace(0.25, 10, 321)
    p = np.array([0.98, 0.01, 0.01])
    def loss(c):
        q = p ** (1 / c) / (p ** (1 / c)).sum()
        return -np.log(q).mean()
    assert t > 3 and t == pytest.approx(grid[np.argmin([loss(c) for c in grid])])
    assert calibration.temperature_apply(df, t).agg(F.avg("p0")).first()[0] < 0.6


def test_blend_falls_back_to_prior(spark):
    df = preds(spark, [1, 2, 0] * 4, [(0.9, 0.05, 0.05), (0.05, 0.9, 0.05), (0.05, 0.05, 0.9)] * 4, q0=1 / 3, q1=1 / 3, q2=1 / 3)
    assert calibration.blend_fit(df, ["fold"]).first()["weight"] == 0
    same = df.withColumns({f"q{k}": F.col(f"p{k}") for k in range(3)})
    assert calibration.blend_fit(same, ["fold"]).first()["weight"] == 0


def test_conformal_only_widens(spark):
    rows = [("f", 0.0, -0.1, 0.1, 1.0)] * 8 + [("f", 2.0, -0.1, 0.1, 1.0)] * 2
    df = spark.createDataFrame(rows, "fold string, target double, lower double, upper double, scale double")
    assert calibration.conformal_abs(df, ["fold"]).first()["adjustment"] > 1
    wide = df.withColumns({"lower": F.lit(-9.0), "upper": F.lit(9.0)})
    assert calibration.conformal_abs(wide, ["fold"]).first()["adjustment"] == 0
    assert calibration.conformal_scaled(wide, ["fold"]).first()["multiplier"] == 0


def test_ordinal_projection(spark):
    df = spark.createDataFrame([(0.8, 0.2), (0.3, 0.7)], "nd double, up double")
    a, b = df.select(*[c.alias(n) for c, n in zip(maths.ordinal(F.col("nd"), F.col("up")), "dnu")]).collect()
    assert (a["d"], a["n"], a["u"]) == pytest.approx((0.2, 0.6, 0.2)) and b["n"] == 0 and b["d"] + b["u"] == pytest.approx(1)


def test_quantile_direction_sums_to_one(spark):
    df = spark.createDataFrame([(-0.2, 0.05, 0.3, 0.1), (0.3, 0.0, -0.3, 0.05)], "lower double, mid double, upper double, band double")
    for r in calibration.quantile_direction(df).collect():
        assert r["p0"] + r["p1"] + r["p2"] == pytest.approx(1)
    r = calibration.quantile_direction(df).first()
    s = 0.5 / (2 * 1.2815515655446004)
    cdf = lambda z: 0.5 * (1 + math.erf(z / math.sqrt(2)))
    assert r["p0"] == pytest.approx(cdf((-0.1 - 0.05) / s))


def test_conditional_prior_shrinks_and_falls_back(spark):
    t = pd.date_range("2024-01-01", periods=6)
    fit = spark.createDataFrame(pd.DataFrame({"fold": "f", "snapshot_time": t, "y": [0, 0, 1, 1, 2, 2], "regime": ["common"] * 5 + ["rare"]}))
    target = spark.createDataFrame([("f", "rare"), ("f", "unseen")], "fold string, regime string")
    out = {r["regime"]: r for r in priors.conditional_prior(fit, target, ["regime"], 100, None, ["fold"]).collect()}
    assert out["rare"]["q2"] > out["rare"]["q0"]
    assert [out["unseen"][f"q{k}"] for k in range(3)] == pytest.approx([1 / 3] * 3)


def test_bootstrap_sign_and_size(spark):
    rows = [(f, i, 1.0) for f in ("a", "b") for i in range(120)]
    base = spark.createDataFrame(rows, "fold string, i int, loss double").withColumn("snapshot_time", F.to_timestamp(F.lit("2020-01-01")) + F.make_dt_interval(F.col("i")))
    cand = base.withColumn("loss", F.lit(0.8))
    diff = bootstrap.paired_difference(base, cand)
    ci = bootstrap.block_bootstrap(diff, 30, 100).first()
    assert ci["ci_lower"] < 0 and ci["ci_upper"] < 0 and ci["iterations"] == 100
    assert ci["ci_lower"] == pytest.approx(-0.2)


@pytest.mark.parametrize("n,block", [(10, 3), (7, 30), (12, 4)])
def test_block_sums_are_circular(spark, n, block):
    g = np.random.default_rng(n)
    d = g.normal(size=n)
    df = spark.createDataFrame(pd.DataFrame({"fold": "f", "position": range(n), "n": n, "diff": d}))
    out = bootstrap.block_sums(df, block).orderBy("start").toPandas()
    for i in range(n):
        idx = (i + np.arange(block)) % n
        assert out["full_sum"][i] == pytest.approx(d[idx].sum())
        assert out["tail_sum"][i] == pytest.approx(d[idx[:n % block]].sum() if n % block else 0)


def test_confidence_gate(spark):
    rows = [(0.1, 0.1, 0.8, 0.1, False), (0.10, 0.15, 0.75, -0.05, True), (0.10, 0.15, 0.75, 0.12, True)]
    df = spark.createDataFrame(rows, "p0 double, p1 double, p2 double, mid double, is_fresh boolean").withColumns(
        {"lower": F.lit(-0.1), "upper": F.lit(0.1), "is_complete": F.lit(True)})
    out = gates.gate_confidence(df).collect()
    assert [r["status"] for r in out] == ["stale_data", "insufficient_confidence", "signal"]
    assert out[0]["confidence"] == 0 and out[0]["level"] == "Unavailable"
    sup = gates.suppress_direction(gates.gate_confidence(df), F.lit(False)).collect()
    assert all(r["confidence"] <= 0.49 and r["level"] == "ResearchOnly" for r in sup)


def test_regime_bucket_order_and_missing(spark):
    df = spark.createDataFrame([(1.0,), (5.0,), (3.0,), (None,)], "v double")
    names = ("low", "normal", "high")
    out = [r[0] for r in df.select(regimes.bucket(F.col("v"), F.lit(1.0), F.lit(5.0), names)).collect()]
    assert out == ["low", "high", "normal", "normal"]
    assert df.select(regimes.bucket(F.lit(2.0), F.lit(2.0), F.lit(2.0), names)).first()[0] == "low"


def test_explanation_skips_unchanged_features(spark):
    df = spark.createDataFrame([("A", 0.5, 2.0, 7.0)], "asset_id string, rsi_14 double, x double, derivatives_available double")
    out = scoring.perturbed_rows(df, ["asset_id"], ["rsi_14", "x", "derivatives_available"], {"x": F.lit(1.5)}).collect()
    assert [(r["feature"], r["x"], r["reference"]) for r in out] == [("x", 1.5, 1.5)]
