"""Findings of the third review: streams over tables of one file or many, and boosting that shares its jobs."""

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tidemark.operators import boosting as BO
from tidemark.operators import calibration as C
from tidemark.operators import labels as L



def test_streams_read_tables_of_one_file_and_of_many(spark, tmp_path):
    from tidemark.workbench.q_streams import appended, st_news_dedupe, stream_of
    rows = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("Title "), (F.col("id") % 90).cast("string")).alias("text"))
    rows.repartition(4).write.parquet(str(tmp_path / "many" / "documents.parquet"))
    rows.coalesce(1).write.parquet(str(tmp_path / "part"))
    (tmp_path / "one").mkdir()
    next((tmp_path / "part").glob("*.parquet")).rename(tmp_path / "one" / "documents.parquet")
    found = []
    for d in ("one", "many"):
        assert appended(stream_of(spark, str(tmp_path / d), "documents"), spark).count() == 300
        found.append(sorted(map(tuple, st_news_dedupe(spark, str(tmp_path / d)).collect())))
    assert found[0] == found[1] and len(found[0]) == len({(i % 25, i % 50, i % 90) for i in range(300)})


def test_runs_that_share_jobs_grow_the_same_trees(spark, monkeypatch):
    """Separate and shared runs, small and large units, and many passes over a leaf's values give the same trees."""
    rng = np.random.default_rng(5)
    data = [(f"f{i % 2}", [float(v) for v in x], int(x[0] + rng.normal(0, 0.2) > 0) + int(x[1] + rng.normal(0, 0.2) > 0), float(x[0] + rng.normal(0, 0.3))) for i, x in enumerate(rng.uniform(-1, 1, (900, 3)))]
    train = spark.createDataFrame(data, "fold string, x array<double>, y int, r double").withColumn("features", array_to_vector("x"))
    settings = BO.Settings(rounds=12, min_leaf=10)

    def runs():
        # Gradients of quantiles are two values only, so that deeper trees have ties that rounding decides.
        return [BO.Run(train, BO.Softmax(3), "y", "fold", (1, 2), settings), BO.Run(train, BO.Pinball(0.1, 0.6), "r", None, (3,), BO.Settings(rounds=1, depth=1, min_leaf=10)),
                BO.Run(train.limit(0), BO.Squared(), "r"), BO.Run(train, BO.Squared(), "r", "fold", (1,), BO.Settings(rounds=3, min_leaf=10))]
    jobs = []
    grow = BO._grow
    monkeypatch.setattr(BO, "_grow", lambda *a: jobs.append(1) or grow(*a))
    shared = BO.fit_together(runs())
    assert len(jobs) == 12
    monkeypatch.setattr(BO, "UNIT", 50)
    monkeypatch.setattr(BO, "FEW", 2)
    alone = [BO.fit_together([run])[0] for run in runs()]
    assert shared[2].models == {} and [sorted(b.models) for b in shared] == [sorted(b.models) for b in alone]
    for a, b in zip(shared, alone):
        for name, model in a.models.items():
            for seed, turns in model.trees.items():
                assert len(turns) == model.settings.rounds == len(b.models[name].trees[seed])
                for one, other in zip((t for turn in turns for t in turn), (t for turn in b.models[name].trees[seed] for t in turn)):
                    assert (one.feature == other.feature).all() and (one.cut == other.cut).all() and np.allclose(one.value, other.value, rtol=1e-9, atol=1e-12)


def test_codes_keep_the_order_of_values():
    values = np.array([-np.inf, -3.5, -1e-300, -0.0, 0.0, 5e-324, 1.0, 1.0 + 2**-52, np.inf])
    codes = BO.coded(values)
    assert (np.diff(codes.astype(object)) >= 0).all() and codes[3] == codes[4] and len(set(codes.tolist())) == len(values) - 1
    assert [BO.decoded(int(c)) for c in codes] == values.tolist()


def test_fold_parameters_do_not_deal_rows_by_fold(spark):
    """Rows of a fold stay where they are, however small the session's broadcast threshold is and however few folds there are."""
    rows = spark.range(20000).select(F.concat(F.lit("f"), F.col("id") % 2).alias("fold"), (F.timestamp_seconds(F.col("id") * 3600)).alias("snapshot_time"),
                                     F.timestamp_seconds(F.col("id") * 3600 + 86400).alias("label_end_time"), (F.col("id") % 3).cast("int").alias("y"),
                                     *[F.lit(v).alias(n) for n, v in (("p0", 0.2), ("p1", 0.5), ("p2", 0.3), ("q0", 0.3), ("q1", 0.4), ("q2", 0.3))])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        parts = L.inner_calibration(rows)
        fit, sel = parts.where("part = 'fit'"), parts.where("part = 'selection'")
        for out in (parts, C.temperature_blend(fit, sel, ["fold"])):
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin" in plan
            assert "SortMergeJoin" not in plan
        assert parts.groupBy("part").count().count() == 2 and C.temperature_blend(fit, sel, ["fold"]).count() == sel.count() > 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
