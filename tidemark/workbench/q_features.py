"""Technical, benchmark, cross-section, derivative and macro features; labels, targets and folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions import maths
from tidemark.operators import bars as B
from tidemark.operators import crosssection as xs
from tidemark.operators import derivatives as D
from tidemark.operators import features as FE
from tidemark.operators import labels as L
from tidemark.operators import macro as M
from tidemark.operators import relations as R
from tidemark.operators import technical as ta
from tidemark.operators.asof import join_asof, peer_panel
from tidemark.session import stage
from tidemark.workbench import tables as t
from tidemark.workbench.registry import big, query, r, rexp, select_round

K = ["asset_id", "open_time"]


def feature(name, build, sql):
    """Register features over the daily bars; ``sql`` maps each output to an expression over view s."""
    body = ", ".join(rexp(e, n) for n, e in sql.items())
    text = f"WITH {t.SQL_SERIES} SELECT asset_id, open_time, {body} FROM s"

    @query(name, text)
    def run(spark, d):
        return ta.add_features(t.series(spark, d), build).select(*K, *sql)


def over(n, end=0, order="PARTITION BY asset_id ORDER BY open_time"):
    return f"OVER ({order} ROWS BETWEEN {n - 1 - end} PRECEDING AND {-end} PRECEDING)" if end else (
        f"OVER ({order} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)")


def lag(c, n):
    return f"lag({c}, {n}) OVER (PARTITION BY asset_id ORDER BY open_time)"


def when(cond, e):
    return f"CASE WHEN {cond} THEN {e} END"


def q_vol(n, ppy):
    return when(f"i >= {n}", f"stddev_samp(r) {over(n)} * sqrt({ppy})")


def q_rsi(n, on):
    g = f"coalesce(sum({on}) FILTER (WHERE {on} > 0) {over(n)}, 0) / {n}"
    l = f"-coalesce(sum({on}) FILTER (WHERE {on} < 0) {over(n)}, 0) / {n}"
    return when(f"i >= {n}", f"(CASE WHEN {l} = 0 THEN 100.0 ELSE 100 - 100 / (1 + ({g}) / ({l})) END) / 100")


def q_ema(period, trailing):
    a = 2.0 / (period + 1)
    width = f"ROWS BETWEEN {trailing - 1} PRECEDING AND CURRENT ROW" if trailing else "ROWS UNBOUNDED PRECEDING"
    lst = f"(list(close) OVER (PARTITION BY asset_id ORDER BY open_time {width}))"
    return f"list_reduce({lst}, lambda acc, x: {1 - a!r} * acc + {a!r} * x)"


def q_ma(n):
    return when(f"i >= {n - 1}", f"close / avg(close) {over(n)} - 1")


def q_slope(a, b):
    return when(f"i >= {a + b - 1}", f"avg(close) {over(a)} / (avg(close) OVER (PARTITION BY asset_id ORDER BY open_time ROWS BETWEEN {a + b - 1} PRECEDING AND {a} PRECEDING)) - 1")


def q_z(c, n, zero):
    return when(f"i >= {n - 1}", f"CASE WHEN stddev_samp({c}) {over(n)} = 0 THEN {zero} ELSE ({c} - avg({c}) {over(n)}) / stddev_samp({c}) {over(n)} END")


def q_regime(trend, vol, tl, vl):
    return (f"CASE WHEN abs({trend}) < {tl} THEN 0.0 WHEN {trend} > 0 AND {vol} < {vl} THEN 1.0 WHEN {trend} > 0 THEN 2.0 "
            f"WHEN {vol} < {vl} THEN -1.0 ELSE -2.0 END")


Q_TR = "greatest(high - low, abs(high - pc), abs(low - pc))"
Q_ATR = when("i >= 14", f"avg({Q_TR}) {over(14)} / close")
Q_BOLL = when("i >= 19", f"4 * stddev_samp(close) {over(20)} / avg(close) {over(20)}")
Q_DOWN = f"coalesce(stddev_samp(CASE WHEN r < 0 THEN r END) {over(20)}, 0) * sqrt(252)"
Q_TAKER = when("i >= 6", f"CASE WHEN sum(volume) {over(7)} = 0 THEN 0.5 ELSE sum(taker_buy_base_volume) {over(7)} / sum(volume) {over(7)} END")
ALL_RETURNS = sorted(set(ta.CRYPTO_RETURNS + ta.EQUITY_RETURNS))

feature("feat_log_return", lambda s: {f"return_{n}": s.log_return(n) for n in ALL_RETURNS},
        {f"return_{n}": f"ln(close / {lag('close', n)})" for n in ALL_RETURNS})
feature("feat_volatility", lambda s: {f"volatility_{n}": s.volatility(n, 365) for n in (7, 30, 90)},
        {f"volatility_{n}": q_vol(n, 365) for n in (7, 30, 90)})
feature("feat_downside_vol", lambda s: {"downside_volatility_20s": s.downside_volatility(20, 252)}, {"downside_volatility_20s": Q_DOWN})
feature("feat_rsi", lambda s: {"rsi_diff": s.rsi(14, "_d"), "rsi_log": s.rsi(14, "_r")},
        {"rsi_diff": q_rsi(14, "d"), "rsi_log": q_rsi(14, "r")})
feature("feat_macd", lambda s: {"macd_trailing": s.macd("trailing"), "macd_full": s.macd("full")},
        {"macd_trailing": f"({q_ema(12, 120)} - {q_ema(26, 120)}) / close", "macd_full": f"({q_ema(12, 0)} - {q_ema(26, 0)}) / close"})
feature("feat_atr", lambda s: {"atr_14_normalized": s.atr(14)}, {"atr_14_normalized": Q_ATR})
feature("feat_bollinger", lambda s: {"bollinger_width_20": s.bollinger(20)}, {"bollinger_width_20": Q_BOLL})
feature("feat_ma_ratio", lambda s: {f"ma_ratio_{n}": s.ma_ratio(n) for n in (5, 7, 20, 30, 60, 90, 200)},
        {f"ma_ratio_{n}": q_ma(n) for n in (5, 7, 20, 30, 60, 90, 200)})
feature("feat_ma_slope", lambda s: {"ma_slope_30d": s.ma_slope(7, 30), "ma_slope_20s": s.ma_slope(5, 20)},
        {"ma_slope_30d": q_slope(7, 30), "ma_slope_20s": q_slope(5, 20)})
feature("feat_zscore", lambda s: {"volume_z30": s.zscore("volume", 30), "trades_z30": s.zscore("trade_count", 30), "volume_z20": s.zscore("volume", 20)},
        {"volume_z30": q_z("volume", 30, "0.0"), "trades_z30": q_z("trade_count", 30, "0.0"), "volume_z20": q_z("volume", 20, "0.0")})
feature("feat_taker_ratio", lambda s: {"taker_buy_ratio_7d": s.taker_ratio(7)}, {"taker_buy_ratio_7d": Q_TAKER})
feature("feat_gap_intraday", lambda s: {"overnight_gap_1s": s.overnight_gap(), "intraday_return_1s": s.intraday_return()},
        {"overnight_gap_1s": "CASE WHEN pc = 0 THEN 0.0 ELSE ln(open / pc) END", "intraday_return_1s": "CASE WHEN open = 0 THEN 0.0 ELSE ln(close / open) END"})
# Prices of the provided table are noise, so the limits are scaled for every branch to occur.
feature("feat_regime", lambda s: {
    "crypto_regime": maths.regime_code(s.ma_ratio(90), s.volatility(30, 365), 0.3, 20.0),
    "equity_regime": maths.regime_code(s.ma_ratio(60), s.volatility(20, 252), 0.2, 15.0)},
    {"crypto_regime": q_regime(q_ma(90), q_vol(30, 365), 0.3, 20.0), "equity_regime": q_regime(q_ma(60), q_vol(20, 252), 0.2, 15.0)})

# --- benchmark -----------------------------------------------------------------------------------

SQL_BENCH = t.SQL_SERIES + f""",
bench AS (SELECT open_time, r AS b, close AS bc, {lag('close', 20)} AS bc20, {lag('close', 30)} AS bc30 FROM s WHERE asset_id = '{t.BENCH}'),
sb AS (SELECT s.*, b, bc20, bc30, bc, CASE WHEN r IS NOT NULL AND b IS NOT NULL THEN r END AS rr, CASE WHEN r IS NOT NULL THEN b END AS bb
       FROM s LEFT JOIN bench USING (open_time))"""


def q_pair(kind, n, zero):
    w = over(n)
    both, sx, sy = f"count(CASE WHEN rr IS NOT NULL THEN 1 END) {w}", f"stddev_samp(rr) {w}", f"stddev_samp(bb) {w}"
    if kind == "corr":
        return f"CASE WHEN {both} < {n} OR {sx} * {sy} = 0 THEN {zero} ELSE covar_samp(rr, bb) {w} / ({sx} * {sy}) END"
    return f"CASE WHEN {both} < {n} OR {sy} = 0 THEN {zero} ELSE covar_samp(rr, bb) {w} / ({sy} * {sy}) END"


def bench_query(name, pairs, strength=None):
    cols = [rexp(q_pair(k, n, "0.0"), out) for out, (k, n) in pairs.items() if out in name[1]]
    if strength:
        cols.append(rexp(f"ln(close / {lag('close', strength[1])}) - ln(bc / bc{strength[1]})", strength[0]))
    wanted = [*[p for p in pairs if p in name[1]], *([strength[0]] if strength else [])]

    @query(name[0], f"WITH {SQL_BENCH} SELECT asset_id, open_time, {', '.join(cols)} FROM sb")
    def run(spark, d):
        return ta.bench_by_date(t.series(spark, d), t.BENCH, pairs, 0.0, strength).select(*K, *wanted)


CORR = {"corr_20": ("corr", 20), "corr_30": ("corr", 30), "corr_60": ("corr", 60), "corr_90": ("corr", 90)}
bench_query(("feat_bench_corr", tuple(CORR)), CORR)
bench_query(("feat_bench_beta", ("beta_20", "beta_30")), {"beta_20": ("beta", 20), "beta_30": ("beta", 30)})
bench_query(("feat_rel_strength", ()), {"c": ("corr", 20)}, ("relative_strength_20", 20))

Q_BM = {
    "benchmark_return_20s": f"ln(close / {lag('close', 20)})", "benchmark_return_60s": f"ln(close / {lag('close', 60)})",
    "benchmark_volatility_20s": q_vol(20, 252), "benchmark_volatility_60s": q_vol(60, 252),
    "benchmark_trend_strength_60s": f"abs(ln(close / {lag('close', 60)})) / (greatest({q_vol(60, 252)}, 1e-6) * sqrt(60.0 / 252))",
    "benchmark_market_regime": q_regime(q_ma(60), q_vol(20, 252), 0.2, 15.0)}
# greatest() skips NULL in both engines, so the strength is NULL exactly where the return is.


@query("feat_bench_macro", f"WITH {t.SQL_SERIES} SELECT open_time AS snapshot_time, {', '.join(rexp(e, n) for n, e in Q_BM.items())} FROM s WHERE asset_id = '{t.BENCH}'")
def feat_bench_macro(spark, d):
    return FE.benchmark_macro(t.series(spark, d), t.BENCH, 0.2, 15.0)


@query("join_left_benchmark", f"""WITH {t.SQL_SERIES}, v AS (SELECT *, {Q_BM['benchmark_return_20s']} AS r20, {q_vol(20, 252)} AS v20 FROM s)
SELECT v.asset_id, v.open_time, {rexp('v.r20', 'return_20s')}, {rexp('b.r20', 'benchmark_return_20s')}, {rexp('b.v20', 'benchmark_volatility_20s')}
FROM v LEFT JOIN (SELECT * FROM v WHERE asset_id = '{t.BENCH}') b USING (open_time)""")
def join_left_benchmark(spark, d):
    bars = t.series(spark, d)
    own = ta.add_features(bars, lambda s: {"return_20s": s.log_return(20)}).select(*K, "return_20s")
    bench = FE.benchmark_macro(bars, t.BENCH).select(F.col("snapshot_time").alias("open_time"), "benchmark_return_20s", "benchmark_volatility_20s")
    return own.join(bench, "open_time", "left")


@query("join_positional_bench", f"""WITH {t.SQL_SERIES}, e AS (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY open_time DESC) AS pos FROM s)
SELECT a.asset_id, {big('a.pos', 'pos')}, {rexp('a.r', 'value')}, {rexp('b.r', 'bench_value')}
FROM e a JOIN e b ON b.asset_id = '{t.BENCH}' AND a.pos = b.pos WHERE a.pos <= 90""")
def join_positional_bench(spark, d):
    rows = ta.finish_returns(t.series(spark, d)).withColumn("value", F.col("_ret"))
    return R.positional_pairs(rows, rows.where(F.col("asset_id") == t.BENCH), 90)


# --- cross-section -------------------------------------------------------------------------------

SQL_XS = t.SQL_SERIES + f", x AS (SELECT asset_id, open_time, i, {q_vol(20, 252)} AS v20, ln(close / {lag('close', 20)}) AS r20, round(ln(close / {lag('close', 20)}), 1) AS c20 FROM s)"


def _xs(spark, d):
    return ta.add_features(t.series(spark, d), lambda s: {"r20": s.log_return(20), "v20": s.volatility(20, 252)}).withColumn("c20", F.round("r20", 1))


@query("xs_breadth", f"WITH {SQL_XS} SELECT asset_id, open_time, {rexp('coalesce(avg(CASE WHEN r20 IS NULL THEN NULL WHEN r20 > 0 THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY open_time), 0.5)', 'breadth')}, {rexp('avg(CASE WHEN r20 > 0 THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY open_time)', 'breadth_all')} FROM x")
def xs_breadth(spark, d):
    return _xs(spark, d).select(*K, xs.breadth("r20", "open_time").alias("breadth"), xs.breadth("r20", "open_time", True).alias("breadth_all"))


@query("xs_rank_cdf", f"""WITH {SQL_XS}, y AS (SELECT *, cume_dist() OVER (PARTITION BY open_time ORDER BY v20) AS q FROM x WHERE v20 IS NOT NULL)
SELECT x.asset_id, x.open_time, {rexp('coalesce(y.q, 0.5)', 'rank')} FROM x LEFT JOIN y USING (asset_id, open_time)""")
def xs_rank_cdf(spark, d):
    return _xs(spark, d).select(*K, xs.rank_cdf("v20", "open_time").alias("rank"))


@query("xs_rank_avg", f"""WITH {SQL_XS}, y AS (SELECT *, (rank() OVER (PARTITION BY open_time ORDER BY c20) + (count(*) OVER (PARTITION BY open_time, c20) - 1) / 2.0)
 / count(*) OVER (PARTITION BY open_time) AS q FROM x WHERE c20 IS NOT NULL)
SELECT x.asset_id, x.open_time, {rexp('y.q', 'rank')} FROM x LEFT JOIN y USING (asset_id, open_time)""")
def xs_rank_avg(spark, d):
    return _xs(spark, d).select(*K, xs.rank_avg("c20", "open_time").alias("rank"))


@query("xs_eligible", f"""WITH {t.SQL_BARS}, e AS (SELECT asset_id FROM bars WHERE open_time <= TIMESTAMP '2001-07-01' GROUP BY 1 HAVING count(*) >= 61 AND max(open_time) = TIMESTAMP '2001-07-01')
SELECT asset_id, open_time, {r('close')} FROM bars WHERE open_time <= TIMESTAMP '2001-07-01' AND asset_id IN (SELECT asset_id FROM e)""")
def xs_eligible(spark, d):
    cut = t.ts("2001-07-01")
    return xs.eligible(t.series(spark, d).where(F.col("open_time") <= cut), cut).select(*K, "close")


# --- as-of ---------------------------------------------------------------------------------------

@query("join_asof_macro", f"""WITH {t.SQL_MACRO} SELECT o.o_orderkey, o.o_orderdate, m.available_at, {', '.join(rexp('m.' + c, c) for c in schemas.MACRO_FEATURES)}
FROM orders o ASOF LEFT JOIN macro m ON o.o_orderdate >= m.available_at""")
def join_asof_macro(spark, d):
    macro = stage(M.macro_features(M.wide_macro(t.macro_long(spark, d), t.SERIES)))
    left = t.load(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return join_asof(left, macro, "o_orderdate", "available_at", [], ["available_at", *schemas.MACRO_FEATURES])


SQL_PEER = t.SQL_SERIES + f""", p AS (SELECT asset_id, open_time, ln(close / {lag('close', 30)}) AS return_30d FROM s),
tm AS (SELECT DISTINCT open_time FROM bars), pa AS (SELECT DISTINCT asset_id FROM bars),
g AS (SELECT tm.open_time, pa.asset_id AS peer FROM tm CROSS JOIN pa)"""


@query("join_asof_peer", f"""WITH {SQL_PEER} SELECT g.open_time, g.peer, p.open_time AS peer_time, {rexp('p.return_30d', 'return_30d')}
FROM g ASOF JOIN p ON g.peer = p.asset_id AND g.open_time >= p.open_time""")
def join_asof_peer(spark, d):
    rows = ta.add_features(t.series(spark, d), lambda s: {"return_30d": s.log_return(30)})
    return peer_panel(rows, ["return_30d"]).select("open_time", "peer", "peer_time", "return_30d")


# --- derivatives ---------------------------------------------------------------------------------

def q_measure(measure, exprs):
    order = "PARTITION BY asset_id ORDER BY snapshot_time"
    cols = ", ".join(f"{e} AS {n}" for n, e in exprs.items())
    return f"SELECT asset_id, snapshot_time, {cols} FROM (SELECT * FROM snaps WHERE {measure} IS NOT NULL)".replace("@", order)


def q_deriv(measure, kind, n):
    w = f"OVER (@ ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    if kind == "mean":
        return f"avg({measure}) {w}"
    if kind == "z":
        return (f"CASE WHEN count({measure}) {w} < 10 OR stddev_samp({measure}) {w} = 0 THEN 0.0 ELSE "
                f"({measure} - avg({measure}) {w}) / stddev_samp({measure}) {w} END")
    old = f"lag({measure}, {n}) OVER (@)"
    return f"CASE WHEN {old} IS NULL OR {old} <= 0 OR {measure} <= 0 THEN 0.0 ELSE ln({measure} / {old}) END"


def sql_deriv(rules):
    """Per measure a statistics table, then one as-of join per measure back to every snapshot."""
    by = {}
    for name, m, k, n, default in rules:
        by.setdefault(m, {})[name] = (q_deriv(m, k, n), default)
    ctes = ", ".join(f"st_{m} AS ({q_measure(m, {n: e for n, (e, _) in cols.items()})})" for m, cols in by.items())
    joins = " ".join(f"ASOF LEFT JOIN st_{m} ON b.asset_id = st_{m}.asset_id AND b.snapshot_time >= st_{m}.snapshot_time" for m in by)
    outs = ", ".join(f"coalesce(st_{m}.{n}, {dv}) AS {n}" for m, cols in by.items() for n, (_, dv) in cols.items())
    return ctes, outs, joins


def deriv_query(name, kind):
    rules = tuple(x for x in D.FEATURE_RULES if x[2] == kind)
    ctes, outs, joins = sql_deriv(rules)
    names = [x[0] for x in rules]

    @query(name, f"WITH {t.SQL_SNAPS}, {ctes}, o AS (SELECT b.asset_id, b.snapshot_time, {outs} FROM snaps b {joins}) "
                 f"SELECT asset_id, snapshot_time, {r(*names)} FROM o")
    def run(spark, d):
        return D.derivative_features(t.order_snapshots(spark, d), rules).select("asset_id", "snapshot_time", *names)


deriv_query("feat_deriv_mean", "mean")
deriv_query("feat_deriv_zscore", "z")
deriv_query("feat_deriv_logchange", "log")

Q_AVAIL = """CASE WHEN lag(snapshot_time, 29) OVER o IS NOT NULL AND snapshot_time - lag(snapshot_time, 29) OVER o >= INTERVAL 29 DAY
 AND funding_rate IS NOT NULL AND premium IS NOT NULL AND futures_quote_volume IS NOT NULL AND open_interest_value IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"""


@query("feat_deriv_available", f"WITH {t.SQL_SNAPS} SELECT asset_id, snapshot_time, {Q_AVAIL} AS derivatives_available FROM snaps WINDOW o AS (PARTITION BY asset_id ORDER BY snapshot_time)")
def feat_deriv_available(spark, d):
    return D.availability(t.order_snapshots(spark, d)).select("asset_id", "snapshot_time", "derivatives_available")


# Orders of every status double as derivative history of the assets through a fixed mapping.
STATUS_OF = {"STANDARD": "F", "ECONOMY": "O", "PROMO": "P"}


def asset_derivatives(spark, d):
    pairs = F.create_map(*[F.lit(x) for kv in STATUS_OF.items() for x in (kv[1], kv[0])])
    snaps = t.order_snapshots(spark, d)
    return snaps.withColumn("asset_id", pairs[F.col("asset_id")])


_ctes, _outs, _joins = sql_deriv(D.FEATURE_RULES)
_map = "CASE asset_id " + " ".join(f"WHEN '{v}' THEN '{k}'" for k, v in STATUS_OF.items()) + " END"
SQL_DERIV = f"""{t.SQL_SNAPS}, {_ctes},
dfeat AS (SELECT * REPLACE ({_map} AS asset_id) FROM (SELECT b.asset_id, b.snapshot_time, {_outs}, a.derivatives_available FROM snaps b {_joins}
  JOIN (SELECT asset_id, snapshot_time, {Q_AVAIL} AS derivatives_available FROM snaps WINDOW o AS (PARTITION BY asset_id ORDER BY snapshot_time)) a
  ON a.asset_id = b.asset_id AND a.snapshot_time = b.snapshot_time))"""


@query("join_asof_history", f"""WITH {t.SQL_BARS}, {SQL_DERIV} SELECT b.asset_id, b.open_time AS snapshot_time,
 {', '.join(rexp(f'coalesce(f.{c}, 0.0)', c) for c in schemas.DERIVATIVE_FEATURES)}
 FROM bars b ASOF LEFT JOIN dfeat f ON b.asset_id = f.asset_id AND b.open_time >= f.snapshot_time""")
def join_asof_history(spark, d):
    snaps = t.series(spark, d).select("asset_id", F.col("open_time").alias("snapshot_time"))
    return D.attach_derivatives(snaps, asset_derivatives(spark, d))


# --- macro ---------------------------------------------------------------------------------------

@query("wide_macro", f"WITH {t.SQL_MACRO} SELECT observation_date, {r('vix', 'treasury_2y', 'treasury_10y', 'financial_conditions')} FROM mwide")
def wide_macro(spark, d):
    return M.wide_macro(t.macro_long(spark, d), t.SERIES).drop("_idx")


@query("feat_macro", f"WITH {t.SQL_MACRO} SELECT observation_date, available_at, {r(*schemas.MACRO_FEATURES)} FROM macro")
def feat_macro(spark, d):
    return M.macro_features(M.wide_macro(t.macro_long(spark, d), t.SERIES))


# --- complete snapshots --------------------------------------------------------------------------

TREND, VOL = 0.3, 20.0
Q_CRYPTO = {f"return_{n}d": f"ln(close / {lag('close', n)})" for n in ta.CRYPTO_RETURNS}
Q_CRYPTO |= {f"volatility_{n}d": q_vol(n, 365) for n in (7, 30, 90)}
Q_CRYPTO |= {
    "rsi_14": q_rsi(14, "d"), "macd_normalized": f"({q_ema(12, 120)} - {q_ema(26, 120)}) / close", "atr_14_normalized": Q_ATR,
    "bollinger_width_20": Q_BOLL, "ma_slope_30d": q_slope(7, 30), "volume_zscore_30d": q_z("volume", 30, "0.0"),
    "trade_count_zscore_30d": q_z("trade_count", 30, "0.0"), "taker_buy_ratio_7d": Q_TAKER,
    "market_regime": q_regime(q_ma(90), q_vol(30, 365), TREND, VOL)}
Q_CRYPTO |= {f"ma_ratio_{n}d": q_ma(n) for n in (7, 30, 90, 200)}
Q_BASE = ", ".join(f"{e} AS {n}" for n, e in Q_CRYPTO.items())


def q_list(n):
    """Correlation and beta of the newest n returns of either series, paired by position."""
    x, y = f"list_slice(tail, -{n}, -1)", f"list_slice(btail, -{n}, -1)"
    cov = f"(list_sum(list_transform(list_zip({x}, {y}), lambda z: (z[1] - list_avg({x})) * (z[2] - list_avg({y})))) / {n - 1})"
    sd = lambda a: f"sqrt(list_sum(list_transform({a}, lambda v: (v - list_avg({a})) ** 2)) / {n - 1})"
    ok = f"bi >= 90 AND len(tail) >= {n} AND len(btail) >= {n}"
    corr = f"CASE WHEN {ok} AND {sd(x)} * {sd(y)} <> 0 THEN {cov} / ({sd(x)} * {sd(y)}) ELSE 0.0 END"
    beta = f"CASE WHEN {ok} AND {sd(y)} <> 0 THEN {cov} / ({sd(y)} ** 2) ELSE 0.0 END"
    return corr, beta


_c30, _b30 = q_list(30)
_c90, _ = q_list(90)
SQL_CRYPTO = t.SQL_SERIES + f""",
base AS (SELECT asset_id, open_time, i, close, list_filter(list(r) {over(90)}, lambda v: v IS NOT NULL) AS tail, {Q_BASE} FROM s),
bt AS (SELECT open_time AS bt, tail AS btail, i AS bi, return_30d AS b30 FROM base WHERE asset_id = '{t.BENCH}'),
al AS (SELECT base.*, bt.* FROM base ASOF LEFT JOIN bt ON base.open_time >= bt.bt),
tm AS (SELECT DISTINCT open_time FROM bars), pa AS (SELECT DISTINCT asset_id FROM bars),
pan AS (SELECT g.open_time, g.asset_id, p.open_time AS peer_time, return_30d AS r30, return_90d AS r90, volatility_30d AS v30
        FROM (SELECT tm.open_time, pa.asset_id FROM tm CROSS JOIN pa) g ASOF JOIN base p ON g.asset_id = p.asset_id AND g.open_time >= p.open_time),
br AS (SELECT open_time, coalesce(avg((r30 > 0)::INT), 0.5) AS breadth FROM pan GROUP BY 1),
k30 AS (SELECT open_time, asset_id, peer_time, cume_dist() OVER (PARTITION BY open_time ORDER BY r30) AS q FROM pan WHERE r30 IS NOT NULL),
k90 AS (SELECT open_time, asset_id, peer_time, cume_dist() OVER (PARTITION BY open_time ORDER BY r90) AS q FROM pan WHERE r90 IS NOT NULL),
kv AS (SELECT open_time, asset_id, peer_time, cume_dist() OVER (PARTITION BY open_time ORDER BY v30) AS q FROM pan WHERE v30 IS NOT NULL)"""
_plain = [c for c in schemas.SPOT_FEATURES if c in Q_CRYPTO]
_hot = ["STANDARD", "ECONOMY", "PROMO", "SMALL"]


@query("feat_snapshot_crypto", f"""WITH {SQL_CRYPTO}, {SQL_DERIV}
SELECT al.asset_id, al.open_time AS snapshot_time, 'crypto-daily-v2' AS feature_set_version, {', '.join(rexp('al.' + c, c) for c in _plain)},
 {rexp(_c30, 'btc_correlation_30d')}, {rexp(_c90, 'btc_correlation_90d')}, {rexp(_b30, 'btc_beta_30d')},
 {rexp('al.return_30d - coalesce(al.b30, 0.0)', 'relative_strength_30d')}, {rexp('br.breadth', 'market_breadth_30d')},
 {', '.join(rexp(f'coalesce(f.{c}, 0.0)', c) for c in schemas.DERIVATIVE_FEATURES)},
 {rexp('k30.q', 'momentum_rank_30d')}, {rexp('k90.q', 'momentum_rank_90d')}, {rexp('kv.q', 'volatility_rank_30d')},
 {', '.join(f"(al.asset_id = '{s}')::INT::DOUBLE AS asset_{s.lower()}" for s in _hot)}
FROM al JOIN br ON br.open_time = al.open_time JOIN k30 ON k30.open_time = al.open_time AND k30.asset_id = al.asset_id
 JOIN k90 ON k90.open_time = al.open_time AND k90.asset_id = al.asset_id JOIN kv ON kv.open_time = al.open_time AND kv.asset_id = al.asset_id
 ASOF LEFT JOIN dfeat f ON al.asset_id = f.asset_id AND al.open_time >= f.snapshot_time WHERE al.i >= 364""")
def feat_snapshot_crypto(spark, d):
    return FE.crypto_snapshots(t.series(spark, d), asset_derivatives(spark, d), t.BENCH, _hot, trend_limit=TREND, vol_limit=VOL)


Q_EQ = {f"return_{n}s": f"ln(close / {lag('close', n)})" for n in ta.EQUITY_RETURNS}
Q_EQ |= {f"volatility_{n}s": q_vol(n, 252) for n in (5, 20, 60)}
Q_EQ |= {
    "downside_volatility_20s": Q_DOWN, "rsi_14": q_rsi(14, "r"), "macd_normalized": f"({q_ema(12, 0)} - {q_ema(26, 0)}) / close",
    "atr_14_normalized": Q_ATR, "bollinger_width_20": Q_BOLL, "ma_slope_20s": q_slope(5, 20),
    "volume_zscore_20s": q_z("volume", 20, "NULL"), "dollar_volume_zscore_20s": q_z("(volume * close)", 20, "NULL"),
    "overnight_gap_1s": "ln(open / pc)", "intraday_return_1s": "ln(close / open)",
    "market_regime": q_regime(q_ma(60), q_vol(20, 252), 0.2, 15.0),
    "benchmark_correlation_20s": q_pair("corr", 20, "NULL"), "benchmark_correlation_60s": q_pair("corr", 60, "NULL"),
    "benchmark_beta_20s": q_pair("beta", 20, "NULL"), "relative_strength_20s": f"ln(close / {lag('close', 20)}) - ln(bc / bc20)"}
Q_EQ |= {f"ma_ratio_{n}s": q_ma(n) for n in (5, 20, 60, 200)}


def q_avg_rank(c):
    return (f"CASE WHEN {c} IS NOT NULL THEN (rank() OVER (PARTITION BY open_time ORDER BY {c} NULLS LAST) + (count({c}) OVER (PARTITION BY open_time, {c}) - 1) / 2.0)"
            f" / count({c}) OVER (PARTITION BY open_time) END")


SQL_EQUITY = SQL_BENCH + f""",
eq0 AS (SELECT asset_id, open_time, {', '.join(f'{e} AS {n}' for n, e in Q_EQ.items())} FROM sb),
eq1 AS (SELECT *, avg(CASE WHEN return_20s > 0 THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY open_time) AS market_breadth_20s, {q_avg_rank('return_20s')} AS momentum_rank_20s,
  {q_avg_rank('return_60s')} AS momentum_rank_60s, {q_avg_rank('volatility_20s')} AS volatility_rank_20s FROM eq0),
eq AS (SELECT asset_id, open_time AS snapshot_time, {', '.join(schemas.EQUITY_FEATURES)} FROM eq1
  WHERE {' AND '.join(f'{c} IS NOT NULL' for c in schemas.EQUITY_FEATURES)})"""


@query("feat_snapshot_equity", f"WITH {SQL_EQUITY} SELECT asset_id, snapshot_time, 'us-equity-daily-v1' AS feature_set_version, {r(*schemas.EQUITY_FEATURES)} FROM eq")
def feat_snapshot_equity(spark, d):
    return FE.equity_snapshots(t.series(spark, d), t.BENCH, None, 0.2, 15.0)


@query("one_hot_asset", f"WITH {t.SQL_BARS} SELECT asset_id, open_time, {', '.join(f'''(asset_id = '{s}')::INT::DOUBLE AS asset_{s.lower()}''' for s in _hot)} FROM bars")
def one_hot_asset(spark, d):
    return FE.one_hot_asset(t.daily_bars(spark, d).select(*K), _hot)


# --- labels and targets --------------------------------------------------------------------------

WIDE = maths.NeutralBand(cap=60.0, max_30=9.0)


def q_band(vs, vl, h, ppy, b=WIDE):
    s = (h / 30) ** 0.5
    blended = f"sqrt({1 - b.long_weight!r} * {vs} * {vs} + {b.long_weight!r} * {vl} * {vl})"
    return f"least(greatest({b.multiplier!r} * least(greatest({blended}, {b.floor!r}), {b.cap!r}) * {(h / ppy) ** 0.5!r}, {b.min_30 * s!r}), {b.max_30 * s!r})"


def q_fwd(h):
    w = "OVER (PARTITION BY asset_id ORDER BY open_time"
    lst = f"list(close) {w} ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING)"
    return {
        "target_return": f"ln(lead(close, {h}) {w}) / close)", "label_end_time": f"lead(open_time, {h}) {w})",
        "target_volatility": f"coalesce(stddev_samp(r) {w} ROWS BETWEEN 2 FOLLOWING AND {h} FOLLOWING), 0) * sqrt(365)",
        "path": lst}


Q_DD = """list_min(list_transform(range(1, len(path) + 1), lambda j: path[j] / list_max(path[1:j]) - 1))"""


def sql_targets(h):
    f = q_fwd(h)
    return t.SQL_SERIES + f""", tg0 AS (SELECT asset_id, open_time, close, i, {q_vol(30, 365)} AS volatility_30d, {q_vol(90, 365)} AS volatility_90d, {Q_ATR} AS atr,
   {', '.join(f'{e} AS {n}' for n, e in f.items())} FROM s),
 tg AS (SELECT * FROM tg0 WHERE label_end_time IS NOT NULL)"""


@query("target_forward", f"WITH {sql_targets(30)} SELECT asset_id, open_time, {r('target_return')}, label_end_time FROM tg")
def target_forward(spark, d):
    return L.forward_targets(t.series(spark, d), 30, with_path=False)


@query("target_volatility", f"WITH {sql_targets(90)} SELECT asset_id, open_time, {r('target_volatility')} FROM tg")
def target_volatility(spark, d):
    return L.forward_targets(t.series(spark, d), 90).select(*K, "target_volatility")


@query("target_drawdown", f"WITH {sql_targets(30)} SELECT asset_id, open_time, {rexp(Q_DD, 'target_max_drawdown')} FROM tg")
def target_drawdown(spark, d):
    return L.forward_targets(t.series(spark, d), 30).select(*K, "target_max_drawdown")


@query("target_risk", f"WITH {sql_targets(30)} SELECT asset_id, open_time, {rexp('1 - exp(-target_volatility / 20)', 'target_risk')} FROM tg")
def target_risk(spark, d):
    out = L.forward_targets(t.series(spark, d), 30)
    return out.select(*K, maths.target_risk(F.col("target_volatility") / 20).alias("target_risk"))


def _labelled(spark, d, h=30):
    bars = t.series(spark, d)
    f = ta.add_features(bars, lambda s: {"volatility_30d": s.volatility(30, 365), "volatility_90d": s.volatility(90, 365), "atr": s.atr(14)})
    feats = f.where(F.col("_idx") >= 90).select("asset_id", F.col("open_time").alias("snapshot_time"), "volatility_30d", "volatility_90d", "atr")
    return L.attach_targets(feats, bars, h, 365, band=WIDE)


Q_B30 = q_band("volatility_30d", "volatility_90d", 30, 365)
SQL_LAB = sql_targets(30) + f""", lab0 AS (SELECT *, open_time AS snapshot_time, {Q_B30} AS band FROM tg WHERE i >= 90),
lab AS (SELECT *, CASE WHEN target_return > band THEN 2 WHEN target_return < -band THEN 0 ELSE 1 END AS y FROM lab0)"""


@query("label_neutral_band", f"""WITH {SQL_LAB} SELECT asset_id, snapshot_time, {rexp('band', 'wide_band')},
 {rexp(q_band('volatility_30d', 'volatility_90d', 30, 365, maths.NeutralBand()), 'band_30')}, {rexp(q_band('volatility_30d', 'volatility_90d', 90, 252, maths.NeutralBand()), 'band_90')} FROM lab""")
def label_neutral_band(spark, d):
    df, v = _labelled(spark, d), (F.col("volatility_30d"), F.col("volatility_90d"))
    return df.select("asset_id", "snapshot_time", F.col("neutral_band_threshold").alias("wide_band"),
                     maths.neutral_band(*v, 30).alias("band_30"), maths.neutral_band(*v, 90, 252).alias("band_90"))


@query("label_direction", f"WITH {SQL_LAB} SELECT asset_id, snapshot_time, {r('target_return')}, {big('y', 'target_direction')}, label_end_time FROM lab")
def label_direction(spark, d):
    return _labelled(spark, d).select("asset_id", "snapshot_time", "target_return", "target_direction", "label_end_time")


@query("label_simple_band", f"WITH {SQL_LAB} SELECT asset_id, snapshot_time, {big('CASE WHEN target_return > 0.5 * volatility_30d * sqrt(30.0 / 365) THEN 2 WHEN target_return < -0.5 * volatility_30d * sqrt(30.0 / 365) THEN 0 ELSE 1 END', 'label')} FROM lab")
def label_simple_band(spark, d):
    band = maths.simple_band(F.col("volatility_30d"), 30)
    return _labelled(spark, d).select("asset_id", "snapshot_time", maths.direction(F.col("target_return"), band).alias("label"))


@query("label_atr_band", f"WITH {SQL_LAB} SELECT asset_id, snapshot_time, {rexp('least(0.18, greatest(band / 50, 0.05 * greatest(atr / 5, 0) * sqrt(30)))', 'atr_band')} FROM lab")
def label_atr_band(spark, d):
    band = maths.atr_band(F.col("neutral_band_threshold") / 50, F.col("atr") / 5, 30, 0.05)
    return _labelled(spark, d).select("asset_id", "snapshot_time", band.alias("atr_band"))


# --- folds ---------------------------------------------------------------------------------------

YEARS = (1998, 1999, 2000)


def sql_folds(rel, years=YEARS, cols="asset_id, snapshot_time, label_end_time"):
    parts = []
    for y in years:
        parts.append(f"""SELECT {cols}, 'wf-{y}' AS fold, CASE WHEN label_end_time < TIMESTAMP '{y - 1}-01-01' - INTERVAL 7 DAY THEN 'train'
 WHEN snapshot_time >= TIMESTAMP '{y - 1}-01-01' AND label_end_time < TIMESTAMP '{y}-01-01' - INTERVAL 7 DAY THEN 'validation'
 WHEN snapshot_time >= TIMESTAMP '{y}-01-01' AND snapshot_time <= TIMESTAMP '{y}-12-31 23:59:59' THEN 'test' END AS role FROM {rel}""")
    return f"""fold0 AS ({' UNION ALL '.join(parts)}), folds AS (SELECT * FROM fold0 WHERE role IS NOT NULL AND fold IN
 (SELECT fold FROM fold0 WHERE role IS NOT NULL GROUP BY fold HAVING count(DISTINCT role) = 3))"""


@query("split_walk_forward", f"WITH {SQL_LAB}, {sql_folds('lab')} SELECT asset_id, snapshot_time, label_end_time, fold, role FROM folds")
def split_walk_forward(spark, d):
    df = _labelled(spark, d).select("asset_id", "snapshot_time", "label_end_time")
    return L.walk_forward(df, YEARS).select("asset_id", "snapshot_time", "label_end_time", "fold", "role")


@query("join_fold", f"WITH {SQL_LAB}, {sql_folds('lab', YEARS + (2001,))} SELECT fold, role, {big('count(*)', 'n')}, min(snapshot_time) AS first_time, max(label_end_time) AS last_label FROM folds GROUP BY 1, 2")
def join_fold(spark, d):
    df = L.walk_forward(_labelled(spark, d).select("snapshot_time", "label_end_time"), YEARS + (2001,))
    return df.groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n"), F.min("snapshot_time").alias("first_time"), F.max("label_end_time").alias("last_label"))


@query("split_inner_calib", f"""WITH {SQL_LAB}, {sql_folds('lab')}, v AS (SELECT * FROM folds WHERE role = 'validation'),
dd AS (SELECT DISTINCT fold, date_trunc('day', snapshot_time) AS d FROM v),
dk AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY d) - 1 AS k, count(*) OVER (PARTITION BY fold) AS n FROM dd),
st AS (SELECT fold, d AS selection_start FROM dk WHERE k = floor(n * 0.67::DOUBLE) AND n >= 4),
o AS (SELECT asset_id, snapshot_time, fold, selection_start, CASE WHEN snapshot_time >= selection_start THEN 'selection'
  WHEN label_end_time < selection_start - INTERVAL 7 DAY THEN 'fit' END AS part FROM v JOIN st USING (fold))
SELECT * FROM o WHERE part IS NOT NULL""")
def split_inner_calib(spark, d):
    df = L.walk_forward(_labelled(spark, d).select("asset_id", "snapshot_time", "label_end_time"), YEARS)
    return L.inner_calibration(df.where("role = 'validation'")).select("asset_id", "snapshot_time", "fold", "selection_start", "part")


@query("split_inner_year", f"""WITH {SQL_LAB}, {sql_folds('lab')}, v AS (SELECT *, max(year(snapshot_time)) OVER (PARTITION BY fold) AS yy FROM folds WHERE role = 'train'),
o AS (SELECT asset_id, snapshot_time, fold, CASE WHEN snapshot_time >= make_date(yy, 1, 1) THEN 'selection' WHEN label_end_time < make_date(yy, 1, 1) - INTERVAL 7 DAY THEN 'fit' END AS part FROM v),
g AS (SELECT fold FROM o GROUP BY fold HAVING count(*) FILTER (WHERE part = 'fit') >= 500 AND count(*) FILTER (WHERE part = 'selection') >= 100)
SELECT * FROM o WHERE part IS NOT NULL AND fold IN (SELECT fold FROM g)""")
def split_inner_year(spark, d):
    df = L.walk_forward(_labelled(spark, d).select("asset_id", "snapshot_time", "label_end_time"), YEARS)
    return L.inner_year(df.where("role = 'train'")).select("asset_id", "snapshot_time", "fold", "part")


@query("union_horizons", f"""WITH {t.SQL_SERIES} SELECT asset_id, open_time, {rexp("ln(lead(close, 30) OVER w / close)", 'target_return')}, {big('30', 'horizon_days')} FROM s WINDOW w AS (PARTITION BY asset_id ORDER BY open_time)
 QUALIFY lead(close, 30) OVER w IS NOT NULL UNION ALL SELECT asset_id, open_time, {rexp("ln(lead(close, 90) OVER w / close)", 'target_return')}, {big('90', 'horizon_days')} FROM s WINDOW w AS (PARTITION BY asset_id ORDER BY open_time)
 QUALIFY lead(close, 90) OVER w IS NOT NULL""")
def union_horizons(spark, d):
    bars = t.series(spark, d)
    return R.union_all([L.forward_targets(bars, h, with_path=False).withColumn("horizon_days", F.lit(h)).drop("label_end_time") for h in schemas.HORIZONS])
