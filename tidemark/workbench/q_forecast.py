"""Metrics, calibration, priors, intervals, regimes and the bootstrap over the prediction table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import maths
from tidemark.functions.times import floor_to
from tidemark.operators import bootstrap as BS
from tidemark.operators import calibration as C
from tidemark.operators import metrics as ME
from tidemark.operators import priors as PR
from tidemark.operators import regimes as RG
from tidemark.operators import relations as R
from tidemark.operators.quantiles import higher, linear, nearest_rank, order_statistics
from tidemark.workbench import tables as t
from tidemark.workbench.registry import big, query, r, rexp

BY = ["fold", "variant"]
P, RB, RBB, AM = t.SQL_PRED, t.SQL_ROWBRIER, t.SQL_ROWBASE, t.SQL_ARGMAX
PY = "CASE y WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END"
ISC = "(upper - lower) + CASE WHEN target < lower THEN 10.0 * (lower - target) ELSE 0 END + CASE WHEN target > upper THEN 10.0 * (target - upper) ELSE 0 END"


def pin(f, q):
    return f"greatest({q} * (target - {f}), ({q} - 1) * (target - {f}))"


def grouped(name, exprs, sql, by=tuple(BY)):
    """Register plain grouped means."""
    cols = ", ".join(rexp(f"avg({e})", n) for n, e in sql.items())

    @query(name, f"WITH {P} SELECT {', '.join(by)}, {cols} FROM pred GROUP BY {', '.join(by)}")
    def run(spark, d):
        return t.predictions(spark, d).groupBy(*by).agg(*exprs())


grouped("met_brier", lambda: [ME.brier_expr(), ME.brier_expr("b", "baseline_brier")], {"brier": RB, "baseline_brier": RBB})
grouped("met_accuracy", lambda: [ME.accuracy_expr()], {"accuracy": f"(({AM}) = y)::INT"})
grouped("met_logloss", lambda: [ME.logloss_expr()], {"log_loss": f"-ln(least(greatest({PY}, 1e-12), 1.0))"})
grouped("met_coverage", lambda: [ME.coverage_expr()], {"coverage": "(target BETWEEN lower AND upper)::INT"})
grouped("met_pinball", lambda: [ME.pinball_expr(F.col(c), q, f"pinball_{c}") for c, q in (("lower", 0.1), ("mid", 0.5), ("upper", 0.9))],
        {"pinball_lower": pin("lower", 0.1), "pinball_mid": pin("mid", 0.5), "pinball_upper": pin("upper", 0.9)})
grouped("met_risk_mae", lambda: [ME.risk_mae_expr(maths.clamp(F.col("band"), 0, 1), maths.target_risk(F.col("scale"))),
                                 ME.risk_mae_expr(maths.target_risk(F.col("band")), maths.target_risk(F.col("scale")), "baseline_risk_mae")],
        {"risk_mae": "abs((1 - exp(-scale)) - least(greatest(band, 0), 1))", "baseline_risk_mae": "abs((1 - exp(-scale)) - (1 - exp(-band)))"})


@query("met_interval_score", f"WITH {P} SELECT fold, variant, {rexp(f'avg({ISC})', 'interval_score')} FROM pred GROUP BY 1, 2")
def met_interval_score(spark, d):
    return ME.reject_crossed(t.predictions(spark, d)).groupBy(*BY).agg(ME.interval_score_expr())


@query("met_bss", f"WITH {P} SELECT fold, variant, {rexp(f'1 - avg({RB}) / avg({RBB})', 'skill')} FROM pred GROUP BY 1, 2")
def met_bss(spark, d):
    df = t.predictions(spark, d).groupBy(*BY).agg(ME.brier_expr(), ME.brier_expr("b", "base"))
    return df.select(*BY, ME.bss(F.col("brier"), F.col("base")).alias("skill"))


@query("met_bic_like", f"""WITH {P}, a AS (SELECT fold, avg(-ln(least(greatest({PY}, 1e-12), 1.0))) AS ll,
 greatest(ceil(count(DISTINCT date_trunc('day', snapshot_time)) / 7.0) * count(DISTINCT asset_id), 2) AS n FROM pred GROUP BY 1)
SELECT fold, {rexp('ll + 42 * ln(n) / (2 * n)', 'score')} FROM a""")
def met_bic_like(spark, d):
    p = t.predictions(spark, d)
    p = p.withColumn("snapshot_time", floor_to(p, "snapshot_time"))
    out = p.groupBy("fold").agg(ME.logloss_expr()).join(ME.effective_n(p, 7, ["fold"]), "fold")
    return out.select("fold", ME.bic_like(F.col("log_loss"), F.lit(42), F.col("effective_n")).alias("score"))


@query("agg_effective_n", f"WITH {P} SELECT fold, {big('greatest(ceil(count(DISTINCT snapshot_time) / 30.0) * count(DISTINCT asset_id), 2)', 'effective_n')} FROM pred GROUP BY 1")
def agg_effective_n(spark, d):
    return ME.effective_n(t.predictions(spark, d), 30, ["fold"])


SQL_BINS = f"""{P}, ex AS (SELECT fold, variant, 0 AS k, p0 AS f, (y = 0)::INT AS o FROM pred UNION ALL SELECT fold, variant, 1, p1, (y = 1)::INT FROM pred
 UNION ALL SELECT fold, variant, 2, p2, (y = 2)::INT FROM pred),
cell AS (SELECT fold, variant, k, least(floor(least(greatest(f, 0), 1) * 10), 9) AS bin, count(*)::DOUBLE AS n, sum(f) AS sf, sum(o)::DOUBLE AS so FROM ex GROUP BY 1, 2, 3, 4),
cls AS (SELECT *, sum(n) OVER w AS nn, sum(so) OVER w / sum(n) OVER w AS base FROM cell WINDOW w AS (PARTITION BY fold, variant, k)),
mur AS (SELECT fold, variant, sum(n / nn * (sf / n - so / n) ** 2) AS reliability, sum(n / nn * (so / n - base) ** 2) AS resolution, sum(n / nn * base * (1 - base)) AS uncertainty FROM cls GROUP BY 1, 2),
bri AS (SELECT fold, variant, avg({RB}) AS brier FROM pred GROUP BY 1, 2),
mu AS (SELECT mur.*, brier, reliability - resolution + uncertainty AS decomposed_brier, brier - (reliability - resolution + uncertainty) AS binning_gap FROM mur JOIN bri USING (fold, variant)),
cw AS (SELECT fold, variant, avg(e) AS classwise_ece FROM (SELECT fold, variant, k, sum(n / nn * abs(so / n - sf / n)) AS e FROM cls GROUP BY 1, 2, 3) GROUP BY 1, 2),
tl AS (SELECT fold, variant, greatest(p0, p1, p2) AS c, (({AM}) = y)::INT AS ok FROM pred),
ec AS (SELECT fold, variant, sum(abs(so - sc)) / sum(n) AS ece FROM (SELECT fold, variant, count(*)::DOUBLE AS n, sum(c) AS sc, sum(ok)::DOUBLE AS so,
   {' + '.join(f'(c > {i} * 1e-1)::INT' for i in range(1, 10))} AS bin FROM tl GROUP BY fold, variant, bin) GROUP BY 1, 2)"""
MUR = ("brier", "reliability", "resolution", "uncertainty", "decomposed_brier", "binning_gap")


@query("met_murphy", f"WITH {SQL_BINS} SELECT fold, variant, {r(*MUR)} FROM mu")
def met_murphy(spark, d):
    return ME.murphy(t.predictions(spark, d), BY)


@query("met_ece", f"WITH {SQL_BINS} SELECT fold, variant, {r('ece')} FROM ec")
def met_ece(spark, d):
    return ME.ece(t.predictions(spark, d), BY)


@query("met_ece_classwise", f"WITH {SQL_BINS} SELECT fold, variant, {r('classwise_ece')} FROM cw")
def met_ece_classwise(spark, d):
    return ME.ece_classwise(t.predictions(spark, d), BY)


@query("met_summary", f"""WITH {SQL_BINS}, o AS (SELECT fold, variant, count(*) AS sample_count, avg((({AM}) = y)::INT) AS accuracy, avg(-ln(least(greatest({PY}, 1e-12), 1.0))) AS log_loss,
 avg({RBB}) AS baseline_brier FROM pred GROUP BY 1, 2)
SELECT fold, variant, {big('sample_count')}, {r('accuracy', 'log_loss', 'baseline_brier', *MUR, 'ece', 'classwise_ece')}, {rexp('1 - brier / baseline_brier', 'brier_skill_score')}, {rexp('brier - baseline_brier', 'brier_delta')}
FROM o JOIN mu USING (fold, variant) JOIN ec USING (fold, variant) JOIN cw USING (fold, variant)""")
def met_summary(spark, d):
    return ME.summary(t.predictions(spark, d), BY, "b")


@query("met_class_shares", f"WITH {P} SELECT fold, variant, {', '.join(rexp(f'avg((y = {k})::INT)', f'share_{k}') for k in range(3))}, {rexp('quantile_cont(band, 0.5)', 'median_band')} FROM pred GROUP BY 1, 2")
def met_class_shares(spark, d):
    p = t.predictions(spark, d)
    return ME.class_shares(p, BY).join(order_statistics(p, BY, "band", {"median_band": linear(0.5)}), BY)


SQL_FM = f"""{P}, fm AS (SELECT variant, fold, avg({RB}) AS brier, avg({RBB}) AS baseline_brier, avg({ISC}) AS interval_score,
 avg(greatest(mid - target, target - mid) * 4) AS baseline_interval_score, avg((target BETWEEN lower AND upper)::INT) AS coverage,
 avg({pin('mid', 0.5)}) AS quantile_pinball, avg({pin('lower', 0.5)}) AS baseline_quantile_pinball,
 avg(abs((1 - exp(-scale)) - band)) AS risk_mae, avg(abs((1 - exp(-scale)) - (1 - exp(-band)))) AS baseline_risk_mae, avg(greatest(p0, p1, p2) / 10) AS ece, count(*) AS sample_count FROM pred GROUP BY 1, 2)"""


def fold_metrics(spark, d):
    risk = maths.target_risk(F.col("scale"))
    err = F.greatest(F.col("mid") - F.col("target"), F.col("target") - F.col("mid"))
    return t.predictions(spark, d).groupBy("variant", "fold").agg(
        ME.brier_expr(), ME.brier_expr("b", "baseline_brier"), ME.interval_score_expr(), F.avg(err * 4).alias("baseline_interval_score"),
        ME.coverage_expr(), ME.pinball_expr(F.col("mid"), 0.5, "quantile_pinball"), ME.pinball_expr(F.col("lower"), 0.5, "baseline_quantile_pinball"),
        ME.risk_mae_expr(F.col("band"), risk), ME.risk_mae_expr(maths.target_risk(F.col("band")), risk, "baseline_risk_mae"),
        F.avg(F.greatest(*ME.probs()) / 10).alias("ece"), F.count(F.lit(1)).alias("sample_count"))


@query("agg_fold_mean", f"""WITH {SQL_FM} SELECT variant, {big('count(*)', 'folds')}, {rexp('avg(brier)', 'brier')}, {rexp('avg(baseline_brier)', 'baseline_brier')},
 {big('count(*) FILTER (WHERE brier < baseline_brier)', 'brier_wins')}, {rexp('avg(interval_score)', 'interval_score')}, {rexp('avg(baseline_interval_score)', 'baseline_interval_score')},
 {big('count(*) FILTER (WHERE interval_score < baseline_interval_score)', 'interval_score_wins')}, {rexp('avg(coverage)', 'coverage')} FROM fm GROUP BY 1""")
def agg_fold_mean(spark, d):
    return ME.fold_mean(fold_metrics(spark, d), ["variant"], [("brier", "baseline_brier"), ("interval_score", "baseline_interval_score")], ["coverage"])


@query("met_skill_interval", f"""WITH {SQL_FM}, ref AS (SELECT fold, interval_score AS rs FROM fm WHERE variant = 'v0')
SELECT variant, {rexp('1 - avg(interval_score) / avg(baseline_interval_score)', 'interval_skill_score')}, {big('count(*) FILTER (WHERE interval_score < rs)', 'fold_wins_vs_absolute')},
 {big('count(*) FILTER (WHERE interval_score < baseline_interval_score)', 'fold_wins_vs_baseline')} FROM fm JOIN ref USING (fold) GROUP BY 1""")
def met_skill_interval(spark, d):
    from tidemark.plans.experiments import interval_skill
    return interval_skill(fold_metrics(spark, d), "v0").select("variant", "interval_skill_score", "fold_wins_vs_absolute", "fold_wins_vs_baseline")


@query("agg_daily_loss", f"WITH {P} SELECT fold, date_trunc('day', snapshot_time) AS snapshot_time, {rexp(f'avg({RB})', 'loss')} FROM pred GROUP BY 1, 2")
def agg_daily_loss(spark, d):
    p = t.predictions(spark, d)
    return ME.daily_loss(p.withColumn("snapshot_time", floor_to(p, "snapshot_time")))


# --- segments ------------------------------------------------------------------------------------

DIMS = ("asset_id", "variant", "fold", "seg_regime", "seg_band")
SQL_SEG = f"""{P}, sp AS (SELECT *, CASE WHEN market_regime < 0 THEN 'bear' WHEN market_regime > 0 THEN 'bull' ELSE 'flat' END AS seg_regime, CASE WHEN band < 0.25 THEN 'narrow' ELSE 'wide' END AS seg_band FROM pred),
sx AS ({' UNION ALL '.join(f"SELECT '{x}' AS dimension, {x} AS value, y, p0, p1, p2, b0, b1, b2 FROM sp" for x in DIMS)}),
se AS (SELECT dimension, value, sum(abs(so - sc)) / sum(n) AS ece FROM (SELECT dimension, value, count(*)::DOUBLE AS n, sum(greatest(p0, p1, p2)) AS sc, sum((({AM}) = y)::INT)::DOUBLE AS so,
   {' + '.join(f'(greatest(p0, p1, p2) > {i} * 1e-1)::INT' for i in range(1, 10))} AS bin FROM sx GROUP BY dimension, value, bin) GROUP BY 1, 2),
sg AS (SELECT dimension, value, count(*) AS sample_count, avg({RB}) AS brier, avg({RBB}) AS baseline_brier, avg((({AM}) = y)::INT) AS accuracy, avg(greatest(p0, p1, p2)) AS mean_confidence FROM sx GROUP BY 1, 2),
seg AS (SELECT *, brier - baseline_brier AS brier_delta FROM sg JOIN se USING (dimension, value))"""
SEG_OUT = f"dimension, value, {big('sample_count')}, {r('brier', 'baseline_brier', 'accuracy', 'mean_confidence', 'ece', 'brier_delta')}"


def _segments(spark, d):
    p, m = t.predictions(spark, d), F.col("market_regime")
    p = p.withColumns({"seg_regime": F.when(m < 0, "bear").when(m > 0, "bull").otherwise("flat"), "seg_band": F.when(F.col("band") < 0.25, "narrow").otherwise("wide")})
    return ME.segment_summary(p, DIMS)


@query("agg_segment", f"WITH {SQL_SEG} SELECT {SEG_OUT} FROM seg")
def agg_segment(spark, d):
    return _segments(spark, d)


@query("agg_worst_k", f"WITH {SQL_SEG} SELECT {SEG_OUT} FROM seg ORDER BY seg.brier_delta DESC, dimension, value LIMIT 5")
def agg_worst_k(spark, d):
    return ME.worst_k(_segments(spark, d), 5)


# --- quantile aggregates -------------------------------------------------------------------------

@query("agg_quantiles", f"WITH {P} SELECT fold, {', '.join(rexp(f'quantile_cont(target, {q})', n) for n, q in (('q10', 0.1), ('q33', '1.0::DOUBLE / 3'), ('q50', 0.5), ('q67', '2.0::DOUBLE / 3'), ('q90', 0.9)))} FROM pred GROUP BY 1")
def agg_quantiles(spark, d):
    return order_statistics(t.predictions(spark, d), ["fold"], "target", {"q10": linear(0.1), "q33": linear(1 / 3), "q50": linear(0.5), "q67": linear(2 / 3), "q90": linear(0.9)})


@query("agg_quantile_higher", f"""WITH {P}, k AS (SELECT fold, target, row_number() OVER (PARTITION BY fold ORDER BY target) - 1 AS i, count(*) OVER (PARTITION BY fold) AS n FROM pred)
SELECT fold, {rexp('max(target) FILTER (WHERE i = ceil(0.8::DOUBLE * (n - 1)))', 'q80_higher')} FROM k GROUP BY 1""")
def agg_quantile_higher(spark, d):
    return order_statistics(t.predictions(spark, d), ["fold"], "target", {"q80_higher": higher(0.8)})


@query("agg_p95_nearest_rank", f"""WITH {t.SQL_RUNS}, l AS (SELECT status, epoch_us(completed_at - started_at) / 1e6 AS sec FROM runs WHERE completed_at IS NOT NULL)
SELECT status, {rexp('quantile_disc(sec, 0.95)', 'p95_seconds')} FROM l GROUP BY 1""")
def agg_p95(spark, d):
    rows = t.runs(spark, d).where(F.col("completed_at").isNotNull())
    sec = (F.unix_micros(F.col("completed_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))) / 1e6
    return order_statistics(rows.withColumn("sec", sec), ["status"], "sec", {"p95_seconds": nearest_rank(0.95)})


@query("agg_median_reference", f"WITH {P} SELECT {', '.join(rexp(f'quantile_cont({c}, 0.5)', c) for c in ('target', 'mid', 'scale'))} FROM pred")
def agg_median_reference(spark, d):
    from tidemark.operators.scoring import median_reference
    return median_reference(t.predictions(spark, d), ["target", "mid", "scale"])


# --- calibration ---------------------------------------------------------------------------------

def sm(exprs):
    """Softmax in SQL, shifted by the largest score."""
    top = f"greatest({', '.join(exprs)})"
    tot = " + ".join(f"exp({e} - {top})" for e in exprs)
    return [f"exp({e} - {top}) / ({tot})" for e in exprs]


def cl(p):
    return f"ln(least(greatest({p}, 1e-12), 1.0))"


T17 = sm([f"{cl(f'p{k}')} / 1.7" for k in range(3)])


@query("cal_temperature_scale", f"WITH {P} SELECT event_id, {', '.join(rexp(e, f'p{k}') for k, e in enumerate(T17))}, {rexp('1 / (1 + exp(-least(greatest(ln(p2 / (1 - p2)) / 1.7, -50), 50)))', 'binary')} FROM pred")
def cal_temperature_scale(spark, d):
    p = t.predictions(spark, d).withColumn("binary", maths.binary_temperature_scale(F.col("p2"), 1.7))
    return C.temperature_apply(p, 1.7).select("event_id", "p0", "p1", "p2", "binary")


SQL_GRID = f"""{P}, lg AS (SELECT fold, {cl(PY)} AS own, {cl('p0')} AS l0, {cl('p1')} AS l1, {cl('p2')} AS l2 FROM pred),
gr AS (SELECT i AS step, 0.25::DOUBLE * pow(40.0::DOUBLE, i / 320.0::DOUBLE) AS tt FROM range(0, 321) g(i)),
nl AS (SELECT fold, step, tt, avg(least(-ln(exp(own / tt) / (exp(l0 / tt) + exp(l1 / tt) + exp(l2 / tt))), -ln(1e-12))) AS nll FROM lg CROSS JOIN gr GROUP BY 1, 2, 3),
tf AS (SELECT fold, arg_min(tt, row(nll, step)) AS temperature FROM nl GROUP BY 1)"""


@query("join_temperature_grid", f"WITH {SQL_GRID} SELECT fold, {big('step')}, {rexp('tt', 'temperature')}, {r('nll')} FROM nl")
def join_temperature_grid(spark, d):
    return C.temperature_losses(t.predictions(spark, d), ["fold"]).select("fold", "step", "temperature", "nll")


@query("cal_temperature_fit", f"WITH {SQL_GRID} SELECT fold, {r('temperature')} FROM tf")
def cal_temperature_fit(spark, d):
    return C.temperature_fit(t.predictions(spark, d), ["fold"])


SQL_BLEND = f"""{P}, bl0 AS (SELECT fold, sum(((y = 0)::INT - b0) * (p0 - b0) + ((y = 1)::INT - b1) * (p1 - b1) + ((y = 2)::INT - b2) * (p2 - b2)) AS n,
 sum((p0 - b0) ** 2 + (p1 - b1) ** 2 + (p2 - b2) ** 2) AS d FROM pred GROUP BY 1),
bl AS (SELECT fold, CASE WHEN d <= 1e-15 THEN 0 ELSE least(greatest(n / d, 0), 1) END AS weight FROM bl0)"""


@query("cal_blend_fit", f"WITH {SQL_BLEND} SELECT fold, {r('weight')} FROM bl")
def cal_blend_fit(spark, d):
    return C.blend_fit(t.predictions(spark, d), ["fold"], "b")


@query("cal_blend_apply", f"WITH {SQL_BLEND} SELECT event_id, {', '.join(rexp(f'weight * p{k} + (1 - weight) * b{k}', f'p{k}') for k in range(3))} FROM pred JOIN bl USING (fold)")
def cal_blend_apply(spark, d):
    p = t.predictions(spark, d)
    return C.blend_apply(p.join(C.blend_fit(p, ["fold"], "b"), "fold"), F.col("weight"), "b").select("event_id", "p0", "p1", "p2")


SQL_CONF = f"""{P}, cs AS (SELECT *, greatest(lower - target, target - upper) AS sc, greatest(lower - target, target - upper) / greatest(scale, 1e-4) AS ss FROM pred),
ca AS (SELECT fold, sc, row_number() OVER (PARTITION BY fold ORDER BY sc) - 1 AS i, count(*) OVER (PARTITION BY fold) AS n FROM cs),
cb AS (SELECT fold, ss, row_number() OVER (PARTITION BY fold ORDER BY ss) - 1 AS i, count(*) OVER (PARTITION BY fold) AS n FROM cs),
lv AS (SELECT fold, greatest(max(sc) FILTER (WHERE i = ceil(least(1.0::DOUBLE, ceil((n + 1) * 0.8::DOUBLE) / n) * (n - 1))), 0) AS adjustment FROM ca GROUP BY 1),
ls AS (SELECT fold, greatest(max(ss) FILTER (WHERE i = ceil(least(1.0::DOUBLE, ceil((n + 1) * 0.8::DOUBLE) / n) * (n - 1))), 0) AS multiplier FROM cb GROUP BY 1)"""


@query("cal_conformal_abs", f"WITH {SQL_CONF} SELECT fold, {r('adjustment')} FROM lv")
def cal_conformal_abs(spark, d):
    return C.conformal_abs(t.predictions(spark, d), ["fold"])


@query("cal_conformal_scaled", f"WITH {SQL_CONF} SELECT fold, {r('multiplier')} FROM ls")
def cal_conformal_scaled(spark, d):
    return C.conformal_scaled(t.predictions(spark, d), ["fold"])


@query("cal_conformal_apply", f"WITH {SQL_CONF} SELECT event_id, {rexp('lower - multiplier * greatest(scale, 1e-4)', 'lower')}, {rexp('upper + multiplier * greatest(scale, 1e-4)', 'upper')} FROM cs JOIN ls USING (fold)")
def cal_conformal_apply(spark, d):
    p = t.predictions(spark, d)
    return C.conformal_apply(p.join(C.conformal_scaled(p, ["fold"]), "fold"), F.col("multiplier"), F.col("scale")).select("event_id", "lower", "upper")


@query("cal_sort_quantiles", f"WITH {P}, x AS (SELECT event_id, list_sort([upper - 1, mid, lower + 1]) AS q FROM pred) SELECT event_id, {rexp('q[1]', 'p10')}, {rexp('q[2]', 'p50')}, {rexp('q[3]', 'p90')} FROM x")
def cal_sort_quantiles(spark, d):
    q = maths.sort_quantiles(F.col("upper") - 1, F.col("mid"), F.col("lower") + 1)
    return t.predictions(spark, d).select("event_id", *[c.alias(n) for c, n in zip(q, ("p10", "p50", "p90"))])


@query("prob_ordinal", f"""WITH {P}, x AS (SELECT event_id, least(greatest(p1 + p2, 0), 1) AS nd, least(greatest(p0 + p2, 0), 1) AS u FROM pred), z AS (SELECT event_id, CASE WHEN u > nd THEN (u + nd) / 2 ELSE nd END AS nd, CASE WHEN u > nd THEN (u + nd) / 2 ELSE u END AS u FROM x)
SELECT event_id, {rexp('1 - nd', 'd')}, {rexp('nd - u', 'n')}, {rexp('u', 'u')} FROM z""")
def prob_ordinal(spark, d):
    out = maths.ordinal(F.col("p1") + F.col("p2"), F.col("p0") + F.col("p2"))
    return t.predictions(spark, d).select("event_id", *[c.alias(n) for c, n in zip(out, ("d", "n", "u"))])


def phi(z):
    """Normal CDF in SQL: erf as its all-positive series, odd symmetry, 1 beyond six sigma."""
    x = f"(abs({z}) / sqrt(2))"
    erf = f"CASE WHEN {x} = 0 THEN 0.0 WHEN {x} > 6 THEN 1.0 ELSE list_sum(list_transform(range(0, 120), lambda n: exp((2 * n + 1) * ln({x}) - {x} * {x} - lgamma(n + 1.5)))) END"
    return f"0.5 * (1 + sign({z}) * ({erf}))"


@query("prob_from_quantiles", f"""WITH {P}, q AS (SELECT event_id, band, list_sort([lower, mid, upper]) AS q FROM pred), s AS (SELECT *, greatest((q[3] - q[1]) / (2 * 1.2815515655446004), 1e-4) AS sc FROM q),
u AS (SELECT event_id, (-band - q[2]) / sc AS a, (band - q[2]) / sc AS b FROM s), v AS (SELECT event_id, {phi('a')} AS d, 1 - ({phi('b')}) AS u FROM u), w AS (SELECT *, greatest(0, 1 - d - u) AS n FROM v)
SELECT event_id, {rexp('d / (d + n + u)', 'p0')}, {rexp('n / (d + n + u)', 'p1')}, {rexp('u / (d + n + u)', 'p2')} FROM w""")
def prob_from_quantiles(spark, d):
    return C.quantile_direction(t.predictions(spark, d)).select("event_id", "p0", "p1", "p2")


# --- priors --------------------------------------------------------------------------------------

@query("agg_class_prior", f"WITH {P} SELECT fold, {', '.join(rexp(f'avg((y = {k})::INT)', f'q{k}') for k in range(3))} FROM pred GROUP BY 1")
def agg_class_prior(spark, d):
    return PR.class_prior(t.predictions(spark, d), ["fold"])


AGE = "epoch_us(max(snapshot_time) OVER (PARTITION BY fold) - snapshot_time) / 86400e6"
SQL_W = f"{P}, ag AS (SELECT *, {AGE} AS age FROM pred WHERE snapshot_time < TIMESTAMP '2024-01-16'), wt AS (SELECT *, exp(-ln(2) * age / 10) AS w FROM ag)"
WS = ", ".join(f"sum(CASE WHEN y = {k} THEN w ELSE 0 END) AS w{k}" for k in range(3))


def _fit(spark, d):
    return t.predictions(spark, d).where(F.col("snapshot_time") < t.ts("2024-01-16"))


def _rest(spark, d):
    return t.predictions(spark, d).where(F.col("snapshot_time") >= t.ts("2024-01-16"))


@query("agg_weighted_prior", f"WITH {SQL_W}, o AS (SELECT fold, market_regime, {WS} FROM wt GROUP BY 1, 2) SELECT fold, market_regime, {r('w0', 'w1', 'w2')} FROM o")
def agg_weighted_prior(spark, d):
    return PR.weighted_counts(_fit(spark, d), ["market_regime"], 10, within=["fold"])


SQL_SHRINK = f"""{SQL_W}, gp AS (SELECT fold, {WS} FROM wt GROUP BY 1), gl AS (SELECT fold, w0 / (w0 + w1 + w2) AS g0, w1 / (w0 + w1 + w2) AS g1, w2 / (w0 + w1 + w2) AS g2 FROM gp),
gc AS (SELECT fold, market_regime, asset_id, {WS} FROM wt GROUP BY 1, 2, 3),
sh AS (SELECT fold, market_regime, asset_id, {', '.join(f'(w{k} + 100.0 * g{k}) / (w0 + w1 + w2 + 100.0) AS q{k}' for k in range(3))} FROM gc JOIN gl USING (fold))"""


@query("agg_shrunk_prior", f"WITH {SQL_SHRINK} SELECT fold, market_regime, asset_id, {r('q0', 'q1', 'q2')} FROM sh")
def agg_shrunk_prior(spark, d):
    fit, by, groups = _fit(spark, d), ["fold"], ["market_regime", "asset_id"]
    whole = PR.weighted_counts(fit, [], 10, within=by)
    total = F.col("w0") + F.col("w1") + F.col("w2")
    whole = whole.select("fold", *[(F.col(f"w{k}") / total).alias(f"g{k}") for k in range(3)])
    counts = PR.weighted_counts(fit, groups, 10, within=by).join(whole, "fold")
    return PR.shrink(counts, [F.col(f"g{k}") for k in range(3)], 100.0).select("fold", *groups, "q0", "q1", "q2")


@query("prior_conditional", f"""WITH {SQL_SHRINK} SELECT event_id, fold, {', '.join(rexp(f'coalesce(sh.q{k}, gl.g{k})', f'q{k}') for k in range(3))}
FROM (SELECT * FROM pred WHERE snapshot_time >= TIMESTAMP '2024-01-16') p LEFT JOIN sh USING (fold, market_regime, asset_id) LEFT JOIN gl USING (fold)""")
def prior_conditional(spark, d):
    out = PR.conditional_prior(_fit(spark, d), _rest(spark, d), ["market_regime", "asset_id"], 100.0, 10, ["fold"])
    return out.select("event_id", "fold", "q0", "q1", "q2")


@query("join_prior_lookup", f"""WITH {P}, pr AS (SELECT asset_id, spy_regime, {', '.join(f'avg((y = {k})::INT) AS g{k}' for k in range(3))} FROM pred WHERE snapshot_time < TIMESTAMP '2024-01-16' GROUP BY 1, 2 HAVING avg((y = 0)::INT) > avg((y = 2)::INT))
SELECT event_id, {', '.join(rexp(f'coalesce(g{k}, {1 / 3!r})', f'q{k}') for k in range(3))} FROM pred LEFT JOIN pr USING (asset_id, spy_regime)""")
def join_prior_lookup(spark, d):
    p = t.predictions(spark, d)
    table = p.where(F.col("snapshot_time") < t.ts("2024-01-16")).groupBy("asset_id", "spy_regime").agg(
        *[F.avg(maths.hit(F.col("y"), k)).alias(f"q{k}") for k in range(3)]).where("q0 > q2")
    return R.lookup_or_default(p, table, ["asset_id", "spy_regime"], {f"q{k}": F.lit(1 / 3) for k in range(3)}).select("event_id", "q0", "q1", "q2")


def sql_candidates():
    """The 48-candidate grid, one UNION branch per group set and half-life."""
    parts = []
    for idx, g, half, lam in PR.candidates():
        cols = PR.GROUP_SETS[g]
        w = "1.0::DOUBLE" if half is None else f"exp(-ln(2) * age / {half})"
        key = ", ".join(cols)
        ws = ", ".join(f"sum(CASE WHEN y = {k} THEN {w} ELSE 0 END) AS w{k}" for k in range(3))
        glob = f"(SELECT fold, {', '.join(f'w{k} / (w0 + w1 + w2) AS g{k}' for k in range(3))} FROM (SELECT fold, {ws} FROM ag GROUP BY fold))"
        p = [f"coalesce(c.q{k}, gl.g{k})" for k in range(3)]
        loss = " + ".join(f"({p[k]} - (v.y = {k})::INT) ** 2" for k in range(3))
        if cols:
            cell = f"""LEFT JOIN (SELECT fold, {key}, {', '.join(f'(w{k} + {lam} * g{k}) / (w0 + w1 + w2 + {lam}) AS q{k}' for k in range(3))}
 FROM (SELECT fold, {key}, {ws} FROM ag GROUP BY fold, {key}) JOIN {glob} USING (fold)) c USING (fold, {key})"""
        else:
            cell, loss = "", " + ".join(f"(gl.g{k} - (v.y = {k})::INT) ** 2" for k in range(3))
        parts.append(f"SELECT v.fold, {idx} AS idx, {g} AS g, avg({loss}) AS b FROM va v JOIN {glob} gl USING (fold) {cell} GROUP BY v.fold")
    return " UNION ALL ".join(parts)


SQL_CAND = f"""{P}, ag AS (SELECT *, {AGE} AS age FROM pred WHERE snapshot_time < TIMESTAMP '2024-01-16'), va AS (SELECT * FROM pred WHERE snapshot_time >= TIMESTAMP '2024-01-16'), ca AS ({sql_candidates()})"""


@query("prior_select", f"""WITH {SQL_CAND}, be AS (SELECT fold, min(row(b, idx)) AS anyb, min(row(b, idx)) FILTER (WHERE g = 0) AS gbest FROM ca GROUP BY 1)
SELECT fold, {big('CASE WHEN gbest[1] - anyb[1] < 0.001 THEN gbest[2] ELSE anyb[2] END', 'idx')}, {rexp('CASE WHEN gbest[1] - anyb[1] < 0.001 THEN gbest[1] ELSE anyb[1] END', 'validation_brier')}, {rexp('gbest[1]', 'global_brier')} FROM be""")
def prior_select(spark, d):
    return PR.prior_select(_fit(spark, d), _rest(spark, d)).select("fold", "idx", "validation_brier", "global_brier")


# --- regimes -------------------------------------------------------------------------------------

SQL_MAC = f"""{P}, fe AS (SELECT *, lower AS volatility_30d, mid AS volume_zscore_30d, target AS return_30d, target - 0.3 AS return_90d, 1.5 + lower AS trend_vol FROM pred),
ma AS (SELECT fold, snapshot_time, lower + 1.5 AS macro_volatility, mid AS macro_volume, abs(target) / (greatest(lower + 1.5, 1e-6) * sqrt(30.0 / 365)) AS macro_trend_score, sign(target - 0.3) AS macro_trend_direction FROM pred WHERE asset_id = 'view'),
th AS (SELECT fold, {', '.join(f'quantile_cont(macro_{m}, 1.0::DOUBLE / 3) AS {m}_lo, quantile_cont(macro_{m}, 2.0::DOUBLE / 3) AS {m}_hi' for m in ('volatility', 'volume', 'trend_score'))} FROM ma WHERE snapshot_time < TIMESTAMP '2024-01-20' GROUP BY 1),
mb AS (SELECT p.event_id, p.fold, ma.macro_volatility, ma.macro_volume, ma.macro_trend_score, ma.macro_trend_direction, th.* EXCLUDE (fold) FROM pred p LEFT JOIN ma ON ma.fold = p.fold AND ma.snapshot_time = p.snapshot_time JOIN th ON th.fold = p.fold),
bu AS (SELECT event_id, CASE WHEN macro_volatility <= volatility_lo THEN 'low' WHEN macro_volatility >= volatility_hi THEN 'high' ELSE 'normal' END AS volatility_regime,
 CASE WHEN macro_volume <= volume_lo THEN 'low' WHEN macro_volume >= volume_hi THEN 'high' ELSE 'normal' END AS volume_regime,
 CASE WHEN macro_trend_score <= trend_score_lo THEN 'mean_reverting' WHEN macro_trend_score >= trend_score_hi THEN 'trend' ELSE 'transition' END AS trend_strength, macro_trend_direction FROM mb)"""


def _macro(spark, d):
    p = t.predictions(spark, d)
    feats = p.select("asset_id", "fold", "snapshot_time", (F.col("lower") + 1.5).alias("volatility_30d"), F.col("mid").alias("volume_zscore_30d"),
                     F.col("target").alias("return_30d"), (F.col("target") - 0.3).alias("return_90d"))
    return RG.macro_frame(feats, "view", RG.CRYPTO, ["fold"])


@query("regime_macro_frame", f"WITH {SQL_MAC} SELECT fold, snapshot_time, {r('macro_volatility', 'macro_volume', 'macro_trend_score', 'macro_trend_direction')} FROM ma")
def regime_macro_frame(spark, d):
    return _macro(spark, d)


@query("regime_thresholds", f"WITH {SQL_MAC} SELECT fold, {', '.join(rexp(f'{m}_{e}', f'macro_{m}_{e}') for m in ('volatility', 'volume', 'trend_score') for e in ('lo', 'hi'))} FROM th")
def regime_thresholds(spark, d):
    return RG.thresholds(_macro(spark, d).where(F.col("snapshot_time") < t.ts("2024-01-20")), ["fold"])


@query("regime_bucket", f"""WITH {SQL_MAC} SELECT event_id, volatility_regime, volume_regime, trend_strength, CASE WHEN trend_strength = 'mean_reverting' THEN 'mean_reverting'
 WHEN trend_strength = 'trend' AND macro_trend_direction > 0 THEN 'bull_trend' WHEN trend_strength = 'trend' AND macro_trend_direction < 0 THEN 'bear_trend' ELSE 'transition' END AS macro_market_regime FROM bu""")
def regime_bucket(spark, d):
    m = _macro(spark, d)
    limits = RG.thresholds(m.where(F.col("snapshot_time") < t.ts("2024-01-20")), ["fold"])
    out = RG.attach(t.predictions(spark, d), m, limits, ["fold"])
    return out.select("event_id", "volatility_regime", "volume_regime", "trend_strength", "macro_market_regime")


# --- bootstrap -----------------------------------------------------------------------------------

ITER, BLOCK = 2000, 5
SQL_BOOT = f"""{P}, dl AS (SELECT fold, date_trunc('day', snapshot_time) AS day, avg({RB}) - avg({RBB}) AS diff FROM pred GROUP BY 1, 2),
po AS (SELECT fold, diff, row_number() OVER (PARTITION BY fold ORDER BY day) - 1 AS position, count(*) OVER (PARTITION BY fold) AS n FROM dl),
it AS (SELECT fold, n, i AS iteration, b AS block_no FROM (SELECT DISTINCT fold, n FROM po) f, range(0, {ITER}) a(i), range(0, CAST(ceil(n / {BLOCK}.0) AS BIGINT)) c(b)),
st AS (SELECT *, ('0x' || substr(md5('17:' || iteration || ':' || fold || ':' || block_no), 1, 8))::BIGINT % n AS start FROM it),
ix AS (SELECT iteration, fold, block_no, start, n, block_no * {BLOCK} + o AS pos, (start + o) % n AS position FROM st, range(0, {BLOCK}) c(o) WHERE block_no * {BLOCK} + o < n),
mn AS (SELECT iteration, avg(diff) AS mean_difference FROM ix JOIN po USING (fold, position) GROUP BY 1)"""


def _diff(spark, d):
    p = t.predictions(spark, d)
    p = p.withColumn("snapshot_time", floor_to(p, "snapshot_time"))
    base = p.groupBy("fold", "snapshot_time").agg(ME.brier_expr("b", "loss"))
    return BS.paired_difference(base, ME.daily_loss(p))


@query("join_bootstrap_index", f"WITH {SQL_BOOT} SELECT {big('iteration')}, {r('mean_difference')} FROM mn")
def join_bootstrap_index(spark, d):
    return BS.iteration_means(_diff(spark, d), BLOCK, ITER)


@query("met_block_bootstrap", f"WITH {SQL_BOOT} SELECT {rexp('quantile_cont(mean_difference, 0.025)', 'ci_lower')}, {rexp('quantile_cont(mean_difference, 0.975)', 'ci_upper')}, {big('count(*)', 'iterations')} FROM mn")
def met_block_bootstrap(spark, d):
    return BS.block_bootstrap(_diff(spark, d), BLOCK)
