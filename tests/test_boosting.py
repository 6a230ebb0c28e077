"""Histogram boosting, vector sums and drawdowns against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tidemark.operators import boosting as BO
from tidemark.operators import labels as L
from tidemark.operators import metrics as ME
from tidemark.operators import models as M
from tidemark.operators.vectors import vector_sums
from tidemark.session import stage

FEATS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    """Two folds of 600 rows; the class follows an interaction of a and b, c is noise with missing values."""
    rng = np.random.default_rng(4)
    data = []
    for i in range(1200):
        a, b, c = rng.uniform(-1, 1, 3)
        y = 2 if a > 0 and b > 0 else 0 if a < 0 and b < 0 else 1
        if rng.random() < 0.05:
            y = int(rng.integers(3))
        data.append((i, f"wf-{i % 2}", "test" if i % 6 < 2 else "train", float(a), float(b), float("nan") if i % 9 == 0 else float(c), y, float(a + 0.3 * b + rng.normal(0, 0.1 + 0.2 * abs(b)))))
    df = spark.createDataFrame(data, "id long, fold string, role string, a double, b double, c double, y int, target_return double")
    return stage(df.withColumn("features", F.array("a", "b", "c")).withColumn("features", M.array_to_vector("features")))


SMALL = BO.Settings(rounds=15, rate=0.3, min_leaf=10)


def split(rows):
    return rows.where("role = 'train'"), rows.where("role = 'test'")


def test_boosting_beats_the_forest_and_the_prior(rows):
    train, test = split(rows)
    prior = train.groupBy("fold").agg(*[F.avg((F.col("y") == k).cast("double")).alias(f"q{k}") for k in range(3)])
    own = M.fit_direction(train, (1, 2), by="fold", settings=SMALL)(test).join(prior, "fold")
    assert own.where((F.abs(F.col("p0") + F.col("p1") + F.col("p2") - 1) > 1e-9) | (F.least(*ME.P) < 0)).count() == 0
    one = own.agg(ME.brier_expr(name="own"), ME.brier_expr("q", "prior")).first()
    whole = [M.vectors(df.drop("features"), ["a", "b"]) for df in (train, test)]  # forests take no missing values
    forest = M.fit_forest(whole[0], (1, 2), trees=15, depth=6, min_leaf=10)(whole[1]).agg(ME.brier_expr()).first()[0]
    assert one["own"] < forest < one["prior"] and one["own"] < 0.4 * one["prior"]


def test_trees_do_not_depend_on_partitions_or_other_groups(rows):
    train, test = split(rows)
    both = BO.fit(train, BO.Softmax(3), "y", "fold", (1, 2), SMALL)
    other = BO.fit(train.repartition(7), BO.Softmax(3), "y", "fold", (1, 2), SMALL)
    alone = BO.fit(train.where("fold = 'wf-1'"), BO.Softmax(3), "y", "fold", (1, 2), SMALL)
    for model, names in ((other, ("wf-0", "wf-1")), (alone, ("wf-1",))):
        for name in names:
            for seed in (1, 2):
                for x, y in zip(both.models[name].trees[seed], model.models[name].trees[seed]):
                    for a, b in zip(x, y):
                        assert (a.feature == b.feature).all() and (a.cut == b.cut).all() and np.allclose(a.value, b.value, rtol=1e-9, atol=1e-12)
    values = test.limit(50).select("fold", "features").collect()
    for r, found in zip(values, test.limit(50).select(both.raw(vector_to_array("features"), F.col("fold")).alias("v")).collect()):
        model = both.models[r["fold"]]
        bins = BO.binned(np.array([list(r["features"])]), model.cuts)
        assert np.allclose(found["v"], model.start + np.mean([model.scores(bins, s) for s in (1, 2)], axis=0)[0])


def plain_leaf(tree, bins):
    at = 0
    while tree.feature[at] >= 0:
        at = 2 * at + 1 + int(bins[tree.feature[at]] > tree.cut[at])
    return at


def test_first_tree_equals_a_plain_one(rows):
    """Without drawing rows or features the first tree is the greedy one, node by node, from all rows."""
    settings = BO.Settings(rounds=1, rate=1.0, depth=3, leaves=8, min_leaf=10, rows=1.0, columns=1.0)
    train = split(rows)[0].where("fold = 'wf-0'")
    model = BO.fit(train, BO.Squared(), "target_return", None, (3,), settings).models["all"]
    tree = model.trees[3][0][0]
    data = train.select(vector_to_array("features").alias("x"), "target_return").collect()
    bins = BO.binned(np.array([r["x"] for r in data]), model.cuts)
    gradient = model.start[0] - np.array([r["target_return"] for r in data])
    assert model.start[0] == pytest.approx(np.mean([r["target_return"] for r in data]))

    def pull(g, n):
        return max(abs(g) - settings.l1, 0) ** 2 / (n + settings.l2)

    def check(node, at, depth):
        best = (1e-12, None)
        for f in range(3):
            for cut in range(65):
                left = at & (bins[:, f] <= cut)
                right = at & ~left
                if min(left.sum(), right.sum()) >= 10:
                    gain = pull(gradient[left].sum(), left.sum()) + pull(gradient[right].sum(), right.sum()) - pull(gradient[at].sum(), at.sum())
                    if gain > best[0] + 1e-9:
                        best = (gain, (f, cut))
        if best[1] is None or depth == 3:
            assert tree.feature[node] < 0
            return
        f, cut = best[1]
        assert (tree.feature[node], tree.cut[node]) == (f, cut)
        for child, side in ((2 * node + 1, bins[:, f] <= cut), (2 * node + 2, bins[:, f] > cut)):
            g, n = gradient[at & side].sum(), (at & side).sum()
            if tree.feature[child] < 0:
                assert tree.value[child] == pytest.approx(-math.copysign(max(abs(g) - 0.2, 0), g) / (n + 1.0))
            check(child, at & side, depth + 1)
    check(0, np.ones(len(data), bool), 0)
    assert [plain_leaf(tree, b) for b in bins] == tree.nodes(bins).tolist()


def test_quantiles_hold_their_share_and_leaves_are_exact(rows):
    train, test = split(rows)
    out = M.fit_quantiles(train, by="fold", settings=SMALL)(test)
    assert out.where("lower > mid or mid > upper").count() == 0
    row = out.agg(*[F.avg((F.col("target_return") < F.col(c)).cast("double")).alias(c) for c in ("lower", "mid", "upper")], F.avg(F.abs(F.col("target_return") - F.col("mid"))).alias("miss"), F.stddev("target_return").alias("spread")).first()
    assert row["lower"] < 0.25 and 0.35 < row["mid"] < 0.65 and row["upper"] > 0.75 and row["miss"] < 0.5 * row["spread"]
    settings = BO.Settings(rounds=1, rate=1.0, depth=2, min_leaf=10, rows=1.0, columns=1.0)
    model = BO.fit(train, BO.Pinball(0.1, 0.9), "target_return", None, (1,), settings).models["all"]
    data = train.select(vector_to_array("features").alias("x"), "target_return").collect()
    bins, y = BO.binned(np.array([r["x"] for r in data]), model.cuts), np.array([r["target_return"] for r in data])
    for k, q in enumerate((0.1, 0.9)):
        tree = model.trees[1][0][k]
        leaf = tree.nodes(bins)
        assert len(set(leaf)) > 1 and model.start[k] == pytest.approx(np.quantile(y, q))
        for node in set(leaf.tolist()):
            assert tree.value[node] == pytest.approx(np.quantile(y[leaf == node] - model.start[k], q))


def test_ordinal_risk_and_settings_of_groups(rows):
    train, test = split(rows)
    out = M.fit_ordinal(train, (1,), by="fold", settings=SMALL)(test)
    assert out.where("not_down < 0 or not_down > 1 or up < 0 or up > 1").count() == 0
    assert out.where("(y >= 1) = (not_down > 0.5) and (y >= 2) = (up > 0.5)").count() > 0.85 * out.count()
    risk = M.fit_risk(train.withColumn("target_risk", F.abs("a")), by="fold", settings=SMALL)(test)
    assert risk.where("risk < 0 or risk > 1").count() == 0 and risk.agg(F.avg(F.abs(F.col("risk") - F.abs("a")))).first()[0] < 0.1
    each = {"wf-0": BO.Settings(rounds=4, min_leaf=10, features=(2,)), "wf-1": BO.Settings(rounds=12, min_leaf=10, depth=1)}
    models = BO.fit(train, BO.Softmax(3), "y", "fold", (1,), each=each).models
    assert len(models["wf-0"].trees[1]) == 4 and len(models["wf-1"].trees[1]) == 12
    assert {f for turn in models["wf-0"].trees[1] for t in turn for f in t.feature.tolist()} <= {-1, 2}
    assert max(t.depth for turn in models["wf-1"].trees[1] for t in turn) == 1


def test_boosting_without_enough_rows(spark, rows):
    train, test = split(rows)
    few = M.fit_direction(train.limit(8), (1,), settings=BO.Settings(rounds=2))(test.limit(5)).collect()
    assert len({(r["p0"], r["p1"], r["p2"]) for r in few}) == 1  # no split: the class shares
    none = M.fit_direction(train.limit(0), (1,), by="fold", settings=SMALL)(test.limit(5)).collect()
    assert len(none) == 5 and all(r["p0"] is None for r in none)
    unknown = M.fit_direction(train.where("fold = 'wf-0'"), (1,), by="fold", settings=BO.Settings(rounds=1))(test)
    assert unknown.where("fold = 'wf-1' and p0 is not null").count() == 0 < unknown.where("fold = 'wf-0' and p0 is not null").count()
    with pytest.raises(ValueError):
        BO.fit(train, BO.Squared(), "y", bins=256)


# --- sums of vectors ------------------------------------------------------------------------------------------------------

def test_vector_sums(spark, monkeypatch):
    from tidemark.operators import vectors as V
    monkeypatch.setattr(V, "KEYS_AT_ONCE", 3)
    monkeypatch.setattr(V, "CELLS_AT_ONCE", 64)
    rng = random.Random(2)
    data = [(rng.choice(["a", "b", "c", "d", "e", None]), rng.randrange(2), rng.random(), rng.random()) for _ in range(500)]
    df = spark.createDataFrame(data, "k string, l int, x double, y double")
    steps = np.arange(7)

    def values(x, y):
        return x[:, None] * steps + y[:, None]
    found = {(r["k"], r["l"], r["step"]): (r["total"], r["rows"]) for r in vector_sums(df, ["k", "l"], ["x", "y"], values, 7).collect()}
    for k in ["a", "b", "c", "d", "e", None]:
        for l in (0, 1):
            own = [(x, y) for kk, ll, x, y in data if (kk, ll) == (k, l)]
            for s in range(7):
                assert found[k, l, s] == (pytest.approx(sum(x * s + y for x, y in own)), len(own))
    whole = {r["step"]: r["total"] for r in vector_sums(df, [], ["x"], lambda x: x[:, None] * steps, 7).collect()}
    assert whole[3] == pytest.approx(3 * sum(d[2] for d in data)) and vector_sums(df.limit(0), ["k"], ["x"], lambda x: x[:, None] * steps, 7).count() == 0
    plan = vector_sums(df, ["k"], ["x"], lambda x: x[:, None] * steps, 7)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Generate" not in plan


@pytest.mark.parametrize("horizon", [1, 2, 7, 64])
def test_drawdowns_by_stretches(spark, horizon):
    from datetime import datetime, timedelta
    rng, rows, closes = random.Random(horizon), [], {}
    for asset in ("A", "B"):
        price = 100.0
        for d in range(230):
            price *= math.exp(rng.gauss(0, 0.05))
            rows.append((asset, datetime(2020, 1, 1) + timedelta(days=d), price))
            closes.setdefault(asset, []).append(price)
    bars = spark.createDataFrame(rows, "asset_id string, open_time timestamp_ntz, close double")
    for r in L.forward_targets(bars, horizon).collect():
        i = (r["open_time"] - datetime(2020, 1, 1)).days
        window, top, worst = closes[r["asset_id"]][i + 1:i + 1 + horizon], -1.0, 0.0
        for v in window:
            top = max(top, v)
            worst = min(worst, v / top - 1)
        assert r["target_max_drawdown"] == pytest.approx(worst, abs=1e-12)
