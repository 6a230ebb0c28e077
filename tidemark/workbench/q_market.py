"""Bars, quality, joins, aggregates, ranking, sets, gates, readiness and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import maths
from tidemark.functions.times import norm_epoch
from tidemark.operators import bars as B
from tidemark.operators import derivatives as D
from tidemark.operators import features as FE
from tidemark.operators import gates as G
from tidemark.operators import quality as Q
from tidemark.operators import relations as R
from tidemark.operators.scoring import top_factors as top_factors_of
from tidemark.operators.blocks import parallelism
from tidemark.plans import reports as RP
from tidemark.session import stage
from tidemark.workbench import tables as t
from tidemark.workbench.q_forecast import SQL_FM, fold_metrics
from tidemark.workbench.registry import big, query, r, rexp

OHLC = ("open", "high", "low", "close", "volume", "quote_volume", "trade_count", "taker_buy_base_volume")

# --- projections, predicates, quality ------------------------------------------------------------


@query("norm_epoch", """SELECT event_id, date_trunc('milliseconds', ts) AS from_ms, date_trunc('milliseconds', ts) AS from_us FROM events""")
def q_norm_epoch(spark, d):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return t.events(spark, d).select("event_id", norm_epoch(F.floor(us / 1000)).alias("from_ms"), norm_epoch(us).alias("from_us"))


def faulty_bars(spark, d):
    """Line items as candidate bars in which every rule is broken somewhere."""
    li, p = t.load(spark, d, "lineitem"), F.col("l_extendedprice")
    k = F.col("l_orderkey")
    return li.select(
        F.concat(F.lit("P"), (F.col("l_partkey") % 40).cast("string")).alias("asset_id"), F.col("l_shipdate").alias("open_time"),
        F.when(k % 11 == 0, -p).otherwise(p).alias("open"), (p * F.when(k % 13 == 0, 0.9).otherwise(1.1)).alias("high"),
        (p * F.when(k % 17 == 0, 1.05).otherwise(0.8)).alias("low"), (p * 1.02).alias("close"),
        F.when(k % 19 == 0, -F.col("l_quantity")).otherwise(F.col("l_quantity")).alias("volume"), (p * F.col("l_quantity")).alias("quote_volume"),
        F.col("l_linenumber").alias("trade_count"), F.when(k % 23 == 0, F.col("l_shipdate")).otherwise(F.col("l_shipdate") + F.expr("INTERVAL 1 DAY")).alias("close_time"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


SQL_FAULTY = """
fb AS (SELECT 'P' || (l_partkey % 40) AS asset_id, l_shipdate AS open_time, CASE WHEN l_orderkey % 11 = 0 THEN -l_extendedprice ELSE l_extendedprice END AS open,
  l_extendedprice * CASE WHEN l_orderkey % 13 = 0 THEN 0.9::DOUBLE ELSE 1.1::DOUBLE END AS high, l_extendedprice * CASE WHEN l_orderkey % 17 = 0 THEN 1.05::DOUBLE ELSE 0.8::DOUBLE END AS low,
  l_extendedprice * 1.02::DOUBLE AS close, CASE WHEN l_orderkey % 19 = 0 THEN -l_quantity ELSE l_quantity END AS volume, l_extendedprice * l_quantity AS quote_volume,
  l_linenumber AS trade_count, CASE WHEN l_orderkey % 23 = 0 THEN l_shipdate ELSE l_shipdate + INTERVAL 1 DAY END AS close_time, l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem)"""
SQL_RULES = [("unknown_symbol", "asset_id NOT IN (SELECT 'P' || n_nationkey FROM nation)"),
             ("non_positive_price", "open <= 0 OR high <= 0 OR low <= 0 OR close <= 0"),
             ("invalid_ohlc", "high < greatest(open, close) OR low > least(open, close) OR high < low"),
             ("negative_activity", "volume < 0 OR quote_volume < 0 OR trade_count < 0"), ("invalid_time_range", "close_time <= open_time")]


@query("quality_bar", f"""WITH {SQL_FAULTY}, v AS (SELECT asset_id, open_time, array_to_string(list_filter([{', '.join(f"CASE WHEN {c} THEN '{n}' END" for n, c in SQL_RULES)}], lambda x: x IS NOT NULL), ',') AS violations FROM fb)
SELECT asset_id, violations, {big('count(*)', 'n')} FROM v GROUP BY 1, 2""")
def quality_bar(spark, d):
    dim = t.load(spark, d, "nation").select(F.concat(F.lit("P"), F.col("n_nationkey").cast("string")).alias("asset_id"))
    out = Q.quality_bar(faulty_bars(spark, d), dim)
    return out.groupBy("asset_id", F.array_join("violations", ",").alias("violations")).agg(F.count(F.lit(1)).alias("n"))


@query("quality_batch", f"""WITH {SQL_FAULTY}, o AS (SELECT *, lag(open_time) OVER (PARTITION BY asset_id ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, open_time) AS p FROM fb)
 SELECT asset_id, {big('count(*)', 'rows')}, {big('count(*) FILTER (WHERE open_time < p)', 'regressions')}, {big('count(*) - count(DISTINCT open_time)', 'duplicates')}, {big('count(*) FILTER (WHERE open <= 0 OR high <= 0 OR low <= 0 OR close <= 0)', 'non_positive')},
 {big('count(*) FILTER (WHERE high < greatest(open, close))', 'bad_high')}, {big('count(*) FILTER (WHERE low > least(open, close))', 'bad_low')}, {big('count(*) FILTER (WHERE volume < 0 OR quote_volume < 0 OR trade_count < 0)', 'negative_activity')} FROM o GROUP BY 1""")
def quality_batch(spark, d):
    rows = faulty_bars(spark, d).withColumn("seq", F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "open_time"))
    return Q.quality_batch(rows, ["asset_id"], ["open_time"], "seq")


@query("quality_finite", """SELECT l_returnflag, CAST(count(*) FILTER (WHERE l_discount <= 0) AS BIGINT) AS bad_l_discount, CAST(count(*) FILTER (WHERE l_tax <= 0) AS BIGINT) AS bad_l_tax,
 CAST(count(*) FILTER (WHERE ln(l_quantity) <= 0) AS BIGINT) AS bad_logq FROM lineitem GROUP BY 1""")
def quality_finite(spark, d):
    li = t.load(spark, d, "lineitem").withColumn("logq", F.ln("l_quantity"))
    return Q.quality_finite(li, ["l_discount", "l_tax", "logq"], 0.0, True, ["l_returnflag"])


SQL_HOLES = """h AS (SELECT event_id, CASE WHEN user_id % 5 = 0 THEN NULL WHEN event_id % 7 = 0 THEN 'nan'::DOUBLE WHEN event_id % 9 = 0 THEN 'inf'::DOUBLE ELSE value END AS a, CASE WHEN event_id % 11 = 0 THEN NULL ELSE value / 2 END AS b FROM events)"""


def _holes(spark, d):
    e, u = F.col("event_id"), F.col("user_id")
    a = F.when(u % 5 == 0, F.lit(None)).when(e % 7 == 0, float("nan")).when(e % 9 == 0, float("inf")).otherwise(F.col("value"))
    return t.events(spark, d).select("event_id", a.cast("double").alias("a"), F.when(e % 11 != 0, F.col("value") / 2).alias("b"))


@query("complete_samples", f"WITH {SQL_HOLES} SELECT event_id, round(b, 6) + 0.0 AS b FROM h WHERE a IS NOT NULL AND NOT isnan(a) AND b IS NOT NULL")
def complete_samples(spark, d):
    return FE.complete_samples(_holes(spark, d), ["a", "b"]).select("event_id", "b")


@query("finite_or_zero", f"WITH {SQL_HOLES} SELECT event_id, round(CASE WHEN a IS NULL OR isnan(a) OR isinf(a) THEN 0 ELSE a END, 6) + 0.0 AS a, round(coalesce(b, 0), 6) + 0.0 AS b FROM h")
def finite_or_zero(spark, d):
    return FE.finite_or_zero(_holes(spark, d), ["a", "b"])


@query("finite_or_drop", f"WITH {SQL_HOLES} SELECT event_id, {r('a', 'b')} FROM h WHERE a IS NOT NULL AND NOT isnan(a) AND NOT isinf(a) AND b IS NOT NULL")
def finite_or_drop(spark, d):
    return FE.finite_or_drop(_holes(spark, d), ["a", "b"])


@query("select_assets", f"WITH {t.SQL_ASSETS} SELECT symbol, asset_class, is_active, is_shadow_enabled FROM assets WHERE is_active OR is_shadow_enabled")
def select_assets(spark, d):
    return RP.select_assets(t.assets(spark, d)).select("symbol", "asset_class", "is_active", "is_shadow_enabled")


@query("search_assets", f"WITH {t.SQL_ASSETS} SELECT symbol, asset_class FROM assets WHERE is_active AND contains(upper(symbol), 'N_1')")
def search_assets(spark, d):
    return RP.search_assets(t.assets(spark, d), None, "active", " n_1 ").select("symbol", "asset_class")


@query("filter_bars_range", f"WITH {t.SQL_BARS} SELECT asset_id, open_time, {r('close')} FROM bars WHERE asset_id = 'STANDARD' AND open_time >= TIMESTAMP '1997-01-01' AND open_time <= TIMESTAMP '1998-06-30'")
def filter_bars_range(spark, d):
    return B.filter_range(t.daily_bars(spark, d), "standard", None, t.ts("1997-01-01"), t.ts("1998-06-30")).select("asset_id", "open_time", "close")


@query("dataset_version", "SELECT event_type, 'tidemark-v1' AS dataset_version, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1")
def dataset_version(spark, d):
    from tidemark.sources.sinks import stamp_version
    return stamp_version(t.events(spark, d), "tidemark-v1").groupBy("event_type", "dataset_version").agg(F.count(F.lit(1)).alias("n"))


# --- roll-ups ------------------------------------------------------------------------------------

@query("ohlc_daily", f"WITH {t.SQL_BARS} SELECT asset_id, open_time, {r(*OHLC)} FROM bars")
def ohlc_daily(spark, d):
    return t.daily_bars(spark, d).select("asset_id", "open_time", *OHLC)


@query("ohlc_daily_complete", f"""WITH {t.SQL_HOURLY}, x AS (SELECT asset_id, date_trunc('day', open_time) AS day, arg_min(open, open_time) AS open, max(high) AS high, min(low) AS low, arg_max(close, open_time) AS close,
 sum(volume) AS volume, sum(quote_volume) AS quote_volume, sum(trade_count) AS trade_count, sum(taker_buy_base_volume) AS taker_buy_base_volume, count(*) AS n, count(DISTINCT hour(open_time)) AS h, max(close_time) AS ct FROM hours GROUP BY 1, 2)
SELECT asset_id, day + INTERVAL 1 DAY AS open_time, {r(*OHLC)} FROM x WHERE n = 24 AND h = 24 AND ct < day + INTERVAL 1 DAY""")
def ohlc_daily_complete(spark, d):
    return B.ohlc_daily_complete(t.hourly_bars(spark, d)).select("asset_id", "open_time", *OHLC)


@query("deriv_kline_daily", f"""WITH {t.SQL_HOURLY} SELECT asset_id, date_trunc('day', open_time) + INTERVAL 1 DAY AS snapshot_time, {rexp('arg_max(close, open_time)', 'futures_close')}, {rexp('sum(quote_volume)', 'futures_quote_volume')},
 {rexp('sum(volume)', 'futures_volume')}, {rexp('sum(taker_buy_base_volume)', 'futures_taker_buy_volume')} FROM hours GROUP BY 1, 2""")
def deriv_kline_daily(spark, d):
    return D.kline_daily(t.hourly_bars(spark, d), "futures")


@query("deriv_funding_daily", f"SELECT event_type AS asset_id, date_trunc('day', ts) + INTERVAL 1 DAY AS snapshot_time, {rexp('avg(value / 777)', 'funding_rate')} FROM events GROUP BY 1, 2")
def deriv_funding_daily(spark, d):
    return D.funding_daily(_funding(spark, d))


def _funding(spark, d):
    e = t.events(spark, d)
    return e.select(F.col("event_type").alias("asset_id"), F.col("ts").alias("calc_time"), (F.col("value") / 777).alias("last_funding_rate"))


def _metrics(spark, d):
    e = t.events(spark, d)
    return e.select(F.col("event_type").alias("asset_id"), (F.col("ts") + F.expr("INTERVAL 12 HOUR")).alias("create_time"), (F.col("value") * 10).alias("sum_open_interest_value"),
                    (1 + F.col("user_id") % 3 / 10).alias("count_long_short_ratio"), (1 - F.col("user_id") % 4 / 10).alias("sum_taker_long_short_vol_ratio"))


SQL_MET = f"""md AS (SELECT event_type AS asset_id, date_trunc('day', ts + INTERVAL 12 HOUR) + INTERVAL 1 DAY AS snapshot_time, arg_max(value * 10, ts) AS open_interest_value, avg(1 + (user_id % 3)::DOUBLE / 10) AS long_short_ratio,
 avg(1 - (user_id % 4)::DOUBLE / 10) AS taker_long_short_ratio FROM events GROUP BY 1, 2)"""


@query("deriv_metrics_daily", f"WITH {SQL_MET} SELECT asset_id, snapshot_time, {r('open_interest_value', 'long_short_ratio', 'taker_long_short_ratio')} FROM md")
def deriv_metrics_daily(spark, d):
    return D.metrics_daily(_metrics(spark, d))


@query("deriv_taker_ratio", f"WITH {t.SQL_BARS} SELECT asset_id, open_time, {rexp('CASE WHEN volume - 20 > 0 THEN taker_buy_base_volume / (volume - 20) ELSE 0.5 END', 'ratio')} FROM bars")
def deriv_taker_ratio(spark, d):
    return t.daily_bars(spark, d).select("asset_id", "open_time", D.taker_ratio(F.col("taker_buy_base_volume"), F.col("volume") - 20).alias("ratio"))


SQL_CONS = f"""{t.SQL_HOURLY}, fk AS (SELECT asset_id, date_trunc('day', open_time) + INTERVAL 1 DAY AS snapshot_time, sum(quote_volume) AS futures_quote_volume,
 CASE WHEN sum(volume) > 0 THEN sum(taker_buy_base_volume) / sum(volume) ELSE 0.5 END AS futures_taker_buy_ratio FROM hours GROUP BY 1, 2),
fu AS (SELECT event_type AS asset_id, date_trunc('day', ts) + INTERVAL 1 DAY AS snapshot_time, avg(value / 777) AS funding_rate FROM events GROUP BY 1, 2), {SQL_MET},
co AS (SELECT asset_id, snapshot_time, funding_rate, NULL::DOUBLE AS premium, futures_quote_volume, futures_taker_buy_ratio, open_interest_value, long_short_ratio, taker_long_short_ratio
 FROM fk FULL JOIN fu USING (asset_id, snapshot_time) FULL JOIN md USING (asset_id, snapshot_time))"""


def _parts(spark, d):
    k = D.kline_daily(t.hourly_bars(spark, d), "futures")
    k = k.select("asset_id", "snapshot_time", "futures_quote_volume", D.taker_ratio(F.col("futures_taker_buy_volume"), F.col("futures_volume")).alias("futures_taker_buy_ratio"))
    return D.funding_daily(_funding(spark, d)), k, D.metrics_daily(_metrics(spark, d))


@query("deriv_consolidate", f"WITH {SQL_CONS} SELECT asset_id, snapshot_time, {r(*D.DERIVATIVE_VALUES)} FROM co")
def deriv_consolidate(spark, d):
    return D.consolidate(*_parts(spark, d))


@query("join_full_outer", f"WITH {SQL_CONS} SELECT asset_id, snapshot_time, {r('funding_rate', 'futures_quote_volume', 'open_interest_value')} FROM co")
def join_full_outer(spark, d):
    return R.full_outer(_parts(spark, d), ["asset_id", "snapshot_time"]).select("asset_id", "snapshot_time", "funding_rate", "futures_quote_volume", "open_interest_value")


@query("grid_check", f"""WITH {t.SQL_HOURLY}, g AS (SELECT asset_id, date_trunc('day', open_time) AS day, count(*) AS points, count(DISTINCT open_time) AS distinct_points, 0 AS off_grid FROM hours GROUP BY 1, 2)
SELECT asset_id, day, {big('points')}, {big('distinct_points')}, {big('off_grid')}, points = 24 AND distinct_points = 24 AS ok, CASE WHEN points <> 24 THEN 'count' WHEN distinct_points <> 24 THEN 'gap' ELSE '' END AS reason FROM g""")
def grid_check(spark, d):
    h = t.hourly_bars(spark, d)
    return D.grid_check(h.select("asset_id", F.date_trunc("day", "open_time").cast("timestamp_ntz").alias("day"), F.col("open_time").alias("time")), "hour", 24)


@query("window_check", """SELECT event_type AS asset_id, date_trunc('week', ts) AS start, CAST(count(*) AS BIGINT) AS points, CAST(count(*) FILTER (WHERE ts >= date_trunc('week', ts) + INTERVAL 6 DAY) AS BIGINT) AS outside,
 count(*) FILTER (WHERE ts >= date_trunc('week', ts) + INTERVAL 6 DAY) = 0 AS ok FROM events GROUP BY 1, 2""")
def window_check(spark, d):
    week = F.date_trunc("week", "ts").cast("timestamp_ntz")
    s = t.events(spark, d).select(F.col("event_type").alias("asset_id"), week.alias("start"), (week + F.expr("INTERVAL 6 DAY")).alias("cutoff"), F.col("ts").alias("time"))
    return D.window_check(s, "start", "cutoff", ["asset_id", "start"])


def grid_series(spark, d):
    """Six raw series per day on exact hourly and 5-minute grids, derived from the daily bars.

    Days whose trade count is a multiple of 5 lose one 5-minute bucket and must be rejected.
    """
    bars = t.daily_bars(spark, d).select("asset_id", F.col("open_time").alias("day"), "close", "volume", "trade_count")
    base = stage(bars.repartition(parallelism(bars)))
    hour = base.withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(23))))
    at = F.col("day") + F.make_dt_interval(F.lit(0), F.col("h"))
    end = at + F.expr("INTERVAL '0 00:59:59.999' DAY TO SECOND")
    fut = hour.select("asset_id", at.alias("open_time"), end.alias("close_time"), (F.col("volume") + F.col("h")).alias("volume"),
                      (F.col("close") + F.col("h")).alias("quote_volume"), (F.col("volume") / 2).alias("taker_buy_base_volume"))
    pre = hour.select("asset_id", at.alias("open_time"), end.alias("close_time"), (F.col("h") / 1000).alias("value"))
    fund = base.withColumn("h", F.explode(F.array(F.lit(0), F.lit(8), F.lit(16)))).select("asset_id", at.alias("time"), ((F.col("h") / 8 + 1) / 10000).alias("value"))
    five = base.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(287)))).where((F.col("trade_count") % 5 != 0) | (F.col("b") != 100))
    at5 = F.col("day") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("b") * 5)
    oi = five.select("asset_id", at5.alias("time"), (F.col("close") + F.col("b")).alias("value"))
    ls = five.select("asset_id", at5.alias("time"), (1 + F.col("b") % 5 / 10).alias("value"))
    tk = five.select("asset_id", at5.alias("time"), (0.9 + F.col("b") % 3 / 10).alias("value"))
    return fut, pre, fund, oi, ls, tk


@query("snapshot_assemble", f"""WITH {t.SQL_BARS} SELECT asset_id, open_time + INTERVAL 1 DAY AS snapshot_time, {rexp('0.0002', 'funding_rate')}, {rexp('0.023', 'premium')}, {rexp('24 * close + 276', 'futures_quote_volume')},
 {rexp('12 * volume / (24 * volume + 276)', 'futures_taker_buy_ratio')}, {rexp('close + 287', 'open_interest_value')}, {rexp('(288 + 0.1 * (57 * 10 + 3)) / 288', 'long_short_ratio')}, {rexp('0.9 + 0.1', 'taker_long_short_ratio')},
 {big('24', 'futures_kline_count')}, {big('288', 'open_interest_point_count')}, open_time + INTERVAL '86399.999 seconds' AS source_max_event_time FROM bars WHERE trade_count % 5 <> 0""")
def snapshot_assemble(spark, d):
    out = D.snapshot_assemble(*grid_series(spark, d))
    return out.select("asset_id", "snapshot_time", *D.DERIVATIVE_VALUES, "futures_kline_count", "open_interest_point_count", "source_max_event_time")


# --- upserts -------------------------------------------------------------------------------------

def _versions(spark, d):
    """Events as repeated deliveries of hour bars, in arrival order of event_id."""
    e = t.events(spark, d)
    return e.select(F.col("event_type").alias("asset_id"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("open_time"), F.lit("1h").alias("interval"), F.lit("feed").alias("source"),
                    F.col("value").alias("close"), (F.col("user_id") % 3 == 0).alias("is_final"), F.col("event_id").alias("ingest_seq"))


def q_upsert(order):
    return f"""WITH v AS (SELECT event_type AS asset_id, date_trunc('hour', ts) AS open_time, value AS close, user_id % 3 = 0 AS is_final, CASE WHEN event_id % 4 = 0 THEN -1 ELSE event_id END AS seq, event_id % 4 = 0 AS old, event_id FROM events),
k AS (SELECT * FROM v QUALIFY NOT old OR row_number() OVER (PARTITION BY asset_id, open_time, old ORDER BY event_id DESC) = 1),
x AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY asset_id, open_time ORDER BY {order}) = 1) SELECT asset_id, open_time, {r('close')}, is_final FROM x"""


def _stored(spark, d):
    v = _versions(spark, d).where(F.col("ingest_seq") % 4 == 0)
    return B.latest_wins(v, B.BAR_KEY, [F.desc("ingest_seq")]).drop("ingest_seq")


@query("sink_upsert_bars", q_upsert("is_final DESC, seq DESC"))
def sink_upsert_bars(spark, d):
    out = B.upsert_bars(_stored(spark, d), _versions(spark, d).where(F.col("ingest_seq") % 4 != 0))
    return out.select("asset_id", "open_time", "close", "is_final")


@query("sink_upsert_snapshots", q_upsert("seq DESC"))
def sink_upsert_snapshots(spark, d):
    out = B.upsert_last(_stored(spark, d), _versions(spark, d).where(F.col("ingest_seq") % 4 != 0), ["asset_id", "open_time"])
    return out.select("asset_id", "open_time", "close", "is_final")


# --- latest rows, top-k, streaks -----------------------------------------------------------------

@query("latest_bar", f"WITH {t.SQL_HOURLY} SELECT asset_id, {rexp('arg_max(close, close_time)', 'close')}, max(close_time) AS close_time FROM hours WHERE is_final GROUP BY 1")
def latest_bar(spark, d):
    return B.latest_bar(t.hourly_bars(spark, d))


@query("last_n_bars", f"WITH {t.SQL_HOURLY}, x AS (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY open_time DESC) AS rn FROM hours) SELECT asset_id, open_time, {r('close')}, {big('rn')} FROM x WHERE rn <= 100")
def last_n_bars(spark, d):
    return B.last_n(t.hourly_bars(spark, d), 100).select("asset_id", "open_time", "close", "rn").orderBy("asset_id", "open_time")


@query("tail_rows", f"WITH {t.SQL_BARS}, x AS (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY open_time DESC) AS rn FROM bars) SELECT asset_id, open_time, {r('close')} FROM x WHERE rn <= 420 AND open_time >= TIMESTAMP '2001-11-01' - INTERVAL 410 DAY AND open_time < TIMESTAMP '2001-11-01'")
def tail_rows(spark, d):
    rows = B.tail_rows(t.daily_bars(spark, d), 420)
    return B.tail_days(rows, t.ts("2001-11-01"), 410).select("asset_id", "open_time", "close")


@query("price_change_24", f"""WITH {t.SQL_HOURLY}, x AS (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY close_time DESC) AS rn FROM hours WHERE is_final),
y AS (SELECT asset_id, count(*) AS n, arg_min(close, rn) AS latest_close, arg_max(close, rn) AS old, arg_min(close_time, rn) AS latest_time FROM x WHERE rn <= 25 GROUP BY 1)
SELECT asset_id, {big('n')}, {r('latest_close')}, latest_time, {rexp('CASE WHEN n >= 24 AND old <> 0 THEN (latest_close / old - 1) * 100 END', 'change_24')} FROM y""")
def price_change_24(spark, d):
    return B.price_change_24(t.hourly_bars(spark, d).where("is_final")).select("asset_id", "n", "latest_close", "latest_time", "change_24")


SQL_STREAK = """dd AS (SELECT DISTINCT o_custkey % 50 AS cust, CAST(o_orderdate AS DATE) AS d FROM orders),
isl AS (SELECT cust, d, d - CAST(row_number() OVER (PARTITION BY cust ORDER BY d) AS INT) AS g FROM dd),
st AS (SELECT cust, max(d) AS last_day, count(*) AS days FROM isl GROUP BY cust, g QUALIFY row_number() OVER (PARTITION BY cust ORDER BY max(d) DESC) = 1)"""


@query("trailing_streak", f"WITH {SQL_STREAK} SELECT cust, last_day, {big('days')} FROM st")
def trailing_streak(spark, d):
    o = t.load(spark, d, "orders").withColumn("cust", F.col("o_custkey") % 50)
    return B.trailing_streak(o, "cust", "o_orderdate")


@query("keep_last_dedupe", "SELECT o_custkey, o_orderdate, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def keep_last_dedupe(spark, d):
    o = t.load(spark, d, "orders")
    return R.keep_last(o, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderdate", "o_orderkey")


@query("recent_window_rows", "SELECT o_orderkey, o_orderdate FROM (SELECT *, max(o_orderdate) OVER (PARTITION BY o_orderstatus) AS m FROM orders) WHERE o_orderdate >= m - INTERVAL 2 YEAR")
def recent_window_rows(spark, d):
    return B.recent_years(t.load(spark, d, "orders"), "o_orderdate", 2, ["o_orderstatus"]).select("o_orderkey", "o_orderdate")


@query("recent_runs", f"WITH {t.SQL_RUNS} SELECT run_id, started_at, status, {rexp('epoch_us(completed_at - started_at) / 1e6', 'duration_seconds')} FROM runs ORDER BY started_at DESC, run_id DESC LIMIT 10")
def recent_runs(spark, d):
    return RP.recent_runs(t.runs(spark, d)).select("run_id", "started_at", "status", "duration_seconds")


@query("news_latest", f"WITH {t.SQL_NEWS} SELECT symbol, doc_id, published_at, CAST(rn AS BIGINT) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY published_at DESC, doc_id DESC) AS rn FROM news) WHERE rn <= 8")
def news_latest(spark, d):
    return RP.news_latest(t.news(spark, d), 8).select("symbol", "doc_id", "published_at", "rn")


@query("top_factors", f"""WITH {t.SQL_PRED}, l AS (SELECT event_id, unnest(['market_regime', 'spy_regime', 'mid', 'target', 'band', 'scale', 'lower', 'upper']) AS feature, unnest([market_regime, spy_regime, mid, target, band - 0.3, scale - 0.25, lower + 0.7, upper - 0.8]) AS delta FROM pred),
k AS (SELECT event_id, feature, delta > 0 AS up, row_number() OVER (PARTITION BY event_id, delta > 0 ORDER BY round(abs(delta), 9) DESC, feature) AS rn FROM l WHERE round(delta, 9) <> 0)
SELECT event_id, coalesce(string_agg(feature, ',' ORDER BY rn) FILTER (WHERE up), '') AS positive, coalesce(string_agg(feature, ',' ORDER BY rn) FILTER (WHERE NOT up), '') AS negative FROM k WHERE rn <= 3 GROUP BY 1""")
def top_factors(spark, d):
    p = t.predictions(spark, d).withColumns({"band": F.col("band") - 0.3, "scale": F.col("scale") - 0.25, "lower": F.col("lower") + 0.7, "upper": F.col("upper") - 0.8})
    names = ["market_regime", "spy_regime", "mid", "target", "band", "scale", "lower", "upper"]
    deltas = R.unpivot_features(p, ["event_id"], names).withColumn("delta", F.round("value", 9))
    out = top_factors_of(deltas, ["event_id"])
    return out.select("event_id", F.array_join("positive", ",").alias("positive"), F.array_join("negative", ",").alias("negative"))


# --- relations -----------------------------------------------------------------------------------

@query("join_macro_benchmark", f"""WITH {t.SQL_PRED}, s AS (SELECT asset_id, date_trunc('hour', snapshot_time) AS snapshot_time, user_id % 2 AS horizon_days, event_id, target AS return_20s, mid AS return_60s, scale AS volatility_20s, band AS volatility_60s, market_regime FROM pred),
b AS (SELECT * FROM s WHERE asset_id = 'view' QUALIFY row_number() OVER (PARTITION BY snapshot_time, horizon_days ORDER BY return_20s, return_60s, volatility_20s, volatility_60s, market_regime) = 1)
SELECT s.event_id, {rexp('b.return_20s', 'benchmark_return_20s')}, {rexp('b.return_60s', 'benchmark_return_60s')}, {rexp('b.volatility_20s', 'benchmark_volatility_20s')}, {rexp('b.volatility_60s', 'benchmark_volatility_60s')},
 {rexp('abs(b.return_60s) / (greatest(b.volatility_60s, 1e-6) * sqrt(60.0 / 252))', 'benchmark_trend_strength_60s')}, {rexp('b.market_regime', 'benchmark_market_regime')} FROM s LEFT JOIN b USING (snapshot_time, horizon_days)""")
def join_macro_benchmark(spark, d):
    p = t.predictions(spark, d)
    s = p.select("asset_id", F.date_trunc("hour", "snapshot_time").cast("timestamp_ntz").alias("snapshot_time"), (F.col("user_id") % 2).alias("horizon_days"), "event_id",
                 F.col("target").alias("return_20s"), F.col("mid").alias("return_60s"), F.col("scale").alias("volatility_20s"), F.col("band").alias("volatility_60s"), "market_regime")
    return FE.add_benchmark_macro(s, "view").select("event_id", *FE.schemas.EQUITY_MACRO_FEATURES)


def analysis_inputs(spark, d):
    pred = t.model_predictions(spark, d).withColumn("asset_id", F.col("symbol")).withColumn("snapshot_time", F.col("analysis_time"))
    m = G.champion_shadow(t.models(spark, d))
    feats = t.load(spark, d, "orders").select(F.concat(F.lit("NATION_"), (F.col("o_custkey") % 25).cast("string")).alias("asset_id"), F.col("o_orderdate").alias("snapshot_time")).distinct()
    return pred, t.assets(spark, d).withColumn("asset_id", F.col("symbol")).drop("symbol"), m, feats


SQL_JP = f"""{t.SQL_ASSETS}, {t.SQL_MODELS}, {t.SQL_MPRED}, sc AS (SELECT *, NOT is_production AND row_number() OVER (PARTITION BY asset_class, horizon_days, is_production ORDER BY trained_at DESC, version DESC) = 1 AS is_shadow_candidate FROM models),
jp AS (SELECT p.*, sc.version, sc.horizon_days, sc.is_production, sc.is_shadow_candidate FROM mpred p JOIN assets a ON a.symbol = p.symbol JOIN sc ON sc.model_id = p.model_id
 WHERE ((sc.is_production AND NOT p.is_shadow) OR (sc.is_shadow_candidate AND p.is_shadow)))"""


@query("join_inner_prediction", f"WITH {SQL_JP} SELECT prediction_id, symbol, version, {big('horizon_days')}, is_production FROM jp")
def join_inner_prediction(spark, d):
    pred, assets, models, feats = analysis_inputs(spark, d)
    return R.prediction_rows(pred, assets, models.drop("asset_class"), feats, True).select("prediction_id", "symbol", "version", "horizon_days", "is_production")


SQL_LA = f"{SQL_JP}, la AS (SELECT * FROM jp QUALIFY row_number() OVER (PARTITION BY symbol, horizon_days ORDER BY is_production DESC, analysis_time DESC, prediction_id DESC) = 1)"


def _latest(spark, d):
    pred, assets, models, feats = analysis_inputs(spark, d)
    joined = R.prediction_rows(pred, assets, models.drop("asset_class", "model_no"), feats, True)
    # Equal analysis times inside a channel are told apart by the prediction id.
    return joined.withColumn("model_id", F.col("prediction_id"))


@query("latest_analysis", f"WITH {SQL_LA} SELECT symbol, {big('horizon_days')}, prediction_id, is_production, analysis_time FROM la")
def latest_analysis(spark, d):
    return R.latest_analysis(_latest(spark, d), ("symbol", "horizon_days")).select("symbol", "horizon_days", "prediction_id", "is_production", "analysis_time")


@query("join_semi_exists", "SELECT o_orderkey FROM orders WHERE (o_custkey, o_orderdate) NOT IN (SELECT (o_custkey, o_orderdate) FROM orders WHERE o_orderstatus = 'F')")
def join_semi_exists(spark, d):
    o = t.load(spark, d, "orders")
    return R.not_yet(o, o.where("o_orderstatus = 'F'"), ["o_custkey", "o_orderdate"]).select("o_orderkey")


SQL_SESSION = """rc AS (SELECT 'NATION_' || (o_custkey % 40) AS symbol, o_orderdate AS open_time FROM orders), se AS (SELECT coalesce(max(open_time) FILTER (WHERE symbol = 'NATION_3'), max(open_time)) AS session FROM rc),
ms AS (SELECT upper(n_name) AS symbol FROM nation WHERE upper(n_name) NOT IN (SELECT upper(symbol) FROM rc, se WHERE open_time = session))"""


def _missing(spark, d):
    got = t.load(spark, d, "orders").select(F.concat(F.lit("nation_"), (F.col("o_custkey") % 40).cast("string")).alias("symbol"), F.col("o_orderdate").alias("open_time"))
    return R.missing_from_session(t.load(spark, d, "nation").select(F.col("n_name").alias("symbol")), got, "NATION_3")


@query("join_anti_missing", f"WITH {SQL_SESSION} SELECT session, {big('count(*)', 'missing')}, 'Missing bar for: ' || string_agg(symbol, ', ' ORDER BY symbol) AS description FROM ms, se GROUP BY session")
def join_anti_missing(spark, d):
    return R.missing_message(_missing(spark, d))


@query("except_assets", f"WITH {SQL_SESSION} SELECT symbol FROM ms")
def except_assets(spark, d):
    return _missing(spark, d).select("symbol")


@query("join_symbol_in", "SELECT CAST(c_mktsegment AS VARCHAR) AS segment, CAST(count(*) AS BIGINT) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000) GROUP BY 1")
def join_symbol_in(spark, d):
    c = t.load(spark, d, "customer")
    rich = c.where("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    o = R.only_ids(t.load(spark, d, "orders"), rich, "o_custkey")
    return o.join(c, o.o_custkey == c.c_custkey).groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count(F.lit(1)).alias("n"))


@query("join_window_bars", f"""WITH {t.SQL_SERIES} SELECT asset_id, open_time, {rexp('lead(close, 5) OVER w', 'close_5')}, {rexp('max(close) OVER (PARTITION BY asset_id ORDER BY open_time ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)', 'max_5')} FROM s WINDOW w AS (PARTITION BY asset_id ORDER BY open_time) QUALIFY lead(close, 5) OVER w IS NOT NULL""")
def join_window_bars(spark, d):
    from tidemark.operators.blocks import block_window, blocked, owned
    b = blocked(t.series(spark, d), ["asset_id"], ["open_time"], lookback=0, lookahead=5)
    w = block_window(("asset_id",))
    out = owned(b.withColumns({"close_5": F.lead("close", 5).over(w), "max_5": F.max("close").over(w.rowsBetween(1, 5))}))
    return out.where(F.col("close_5").isNotNull()).select("asset_id", "open_time", "close_5", "max_5")


@query("distinct_symbols", "SELECT DISTINCT upper(CASE WHEN c_custkey % 2 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END) AS symbol FROM customer")
def distinct_symbols(spark, d):
    seg = F.when(F.col("c_custkey") % 2 == 0, F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment"))
    return R.distinct_symbols(t.load(spark, d, "customer").select(seg.alias("symbol")))


@query("union_all_frames", """SELECT s_name AS name, round(s_acctbal, 6) + 0.0 AS balance, NULL AS segment FROM supplier UNION ALL SELECT c_name, round(c_acctbal, 6) + 0.0, c_mktsegment FROM customer""")
def union_all_frames(spark, d):
    s = t.load(spark, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    c = t.load(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    return R.union_all([s, c])


@query("pivot_counts", f"WITH {t.SQL_PRED} SELECT asset_id, market_regime, {', '.join(rexp(f'coalesce(sum(scale) FILTER (WHERE y = {k}), 0)', f'c_{k}') for k in range(3))} FROM pred GROUP BY 1, 2")
def pivot_counts(spark, d):
    return R.pivot_counts(t.predictions(spark, d), ["asset_id", "market_regime"], "y", (0, 1, 2), F.col("scale"))


@query("unpivot_features", f"WITH {t.SQL_PRED} SELECT event_id, unnest(['target', 'mid', 'scale']) AS feature, round(unnest([target, mid, scale]), 6) + 0.0 AS value FROM pred")
def unpivot_features(spark, d):
    return R.unpivot_features(t.predictions(spark, d), ["event_id"], ["target", "mid", "scale"])


# --- report aggregates ---------------------------------------------------------------------------

SQL_LATEST = f"{t.SQL_HOURLY}, hb AS (SELECT *, asset_id AS symbol, open_time + INTERVAL 61 MINUTE AS ingested_at FROM hours)"


def _hour_reports(spark, d):
    h = t.hourly_bars(spark, d)
    return h.withColumns({"symbol": F.col("asset_id"), "ingested_at": F.col("open_time") + F.expr("INTERVAL 61 MINUTE")})


@query("agg_asset_summary", f"WITH {SQL_LATEST} SELECT asset_id, {big('count(*)', 'bar_count')}, min(open_time) AS first_bar, max(open_time) AS latest_bar, max(ingested_at) AS last_ingested_at FROM hb WHERE is_final GROUP BY 1")
def agg_asset_summary(spark, d):
    return RP.asset_summary(_hour_reports(spark, d).where("is_final"))


@query("agg_class_count", f"WITH {t.SQL_ASSETS} SELECT asset_class, {big('count(*)', 'n')} FROM assets WHERE (asset_class <> 'ASIA' AND is_active) OR (asset_class = 'ASIA' AND is_shadow_enabled) GROUP BY 1")
def agg_class_count(spark, d):
    asia = F.col("asset_class") == "ASIA"
    return t.assets(spark, d).where((~asia & F.col("is_active")) | (asia & F.col("is_shadow_enabled"))).groupBy("asset_class").agg(F.count(F.lit(1)).alias("n"))


@query("agg_latest_ts", f"WITH {SQL_LATEST} SELECT symbol, max(close_time) FILTER (WHERE is_final) AS latest_close, max(ingested_at) AS last_ingested FROM hb GROUP BY 1")
def agg_latest_ts(spark, d):
    return RP.latest_times(_hour_reports(spark, d))


@query("agg_distinct_days", f"WITH {t.SQL_MPRED} SELECT model_id, {big('count(DISTINCT analysis_time::DATE)', 'days')}, {big('count(DISTINCT symbol)', 'assets')} FROM mpred GROUP BY 1")
def agg_distinct_days(spark, d):
    return t.model_predictions(spark, d).groupBy("model_id").agg(F.count_distinct(F.to_date("analysis_time")).alias("days"), F.count_distinct("symbol").alias("assets"))


@query("agg_counts_state", f"""WITH {t.SQL_BARS}, s AS (SELECT asset_id, count(*) AS n, min(open_time) AS f, max(open_time) AS l FROM bars GROUP BY 1)
SELECT {big('count(*)', 'assets')}, {big('count(*) FILTER (WHERE l = (SELECT max(l) FROM s WHERE asset_id = ' + repr(t.BENCH) + ') AND n >= 90)', 'ready')}, {big('sum(n)', 'bars')}, min(f) AS first_bar FROM s""")
def agg_counts_state(spark, d):
    rows = RP.equity_assets(t.part_assets(spark, d), t.daily_bars(spark, d), t.BENCH)
    return rows.agg(F.count(F.lit(1)).alias("assets"), F.count_if(F.col("state") == "ready").alias("ready"), F.sum("bar_count").alias("bars"), F.min("first_bar").alias("first_bar"))


@query("agg_success_rate", f"WITH {t.SQL_RUNS} SELECT {big('count(*)', 'runs')}, {rexp('''avg((status = 'succeeded')::INT)''', 'success_rate')} FROM runs WHERE started_at >= TIMESTAMP '{t.NOW}' - INTERVAL 7 DAY")
def agg_success_rate(spark, d):
    return RP.success_rate(t.runs(spark, d), t.ts(t.NOW))


@query("agg_registry_metrics", f"""WITH {SQL_FM}, z AS (SELECT variant, CASE WHEN fold = 'wf-2022' AND variant = 'v1' THEN NULL ELSE brier END AS brier, coverage, sample_count FROM fm)
SELECT variant, {rexp('CASE WHEN count(brier) = count(*) THEN avg(brier) END', 'brier')}, {rexp('avg(coverage)', 'coverage')}, {big('sum(sample_count)', 'sample_count')} FROM z GROUP BY 1""")
def agg_registry_metrics(spark, d):
    hole = (F.col("fold") == "wf-2022") & (F.col("variant") == "v1")
    return G.registry_metrics(fold_metrics(spark, d).withColumn("brier", F.when(~hole, F.col("brier"))), ["variant"], ["brier", "coverage"])


# --- gates ---------------------------------------------------------------------------------------

@query("gate_direction", f"""WITH {SQL_FM}, a AS (SELECT variant, avg(brier) AS brier, avg(baseline_brier * 1.1) AS baseline_brier, avg(ece) AS ece, count(*) FILTER (WHERE brier < baseline_brier * 1.1) AS wins FROM fm GROUP BY 1)
SELECT variant, {r('brier', 'baseline_brier', 'ece')}, {big('wins')}, brier <= baseline_brier * 0.95 AND wins >= 2 AND ece <= 0.05 AS direction_passed FROM a""")
def gate_direction(spark, d):
    return G.gate_direction(fold_metrics(spark, d).withColumn("baseline_brier", F.col("baseline_brier") * 1.1), ["variant"])


@query("gate_scenario", f"""WITH {SQL_FM}, a AS (SELECT variant, avg(coverage) AS coverage, {', '.join(f'avg({m}) AS {m}, avg(baseline_{m}) AS baseline_{m}, count(*) FILTER (WHERE {m} < baseline_{m}) AS {m}_wins' for m in ('quantile_pinball', 'interval_score', 'risk_mae'))} FROM fm GROUP BY 1)
SELECT variant, {r('coverage', *[p + m for m in ('quantile_pinball', 'interval_score', 'risk_mae') for p in ('', 'baseline_')])}, {', '.join(big(f'{m}_wins') for m in ('quantile_pinball', 'interval_score', 'risk_mae'))},
 coverage BETWEEN 0.75 AND 0.85 AND quantile_pinball <= 0.98 * baseline_quantile_pinball AND quantile_pinball_wins >= 2 AND interval_score <= 0.98 * baseline_interval_score AND interval_score_wins >= 2 AND risk_mae <= 0.95 * baseline_risk_mae AND risk_mae_wins >= 2 AS scenario_passed FROM a""")
def gate_scenario(spark, d):
    return G.gate_scenario(fold_metrics(spark, d), ["variant"])


SQL_GATE = f"""{t.SQL_PRED}, g0 AS (SELECT *, list_sort([p0, p1, p2]) AS q, (p2 > p0 AND p2 > p1 AND mid < 0) OR (p0 > p2 AND p0 > p1 AND mid > 0) AS clash, event_id % 17 = 0 OR user_id % 13 = 0 AS stale FROM pred),
g1 AS (SELECT *, least(greatest(q[3] * 0.65 + (q[3] - q[2]) * 0.35 - CASE WHEN clash THEN 0.25 ELSE 0 END - least(greatest((upper - lower) / 8, 0), 0.25), 0), 1) AS raw FROM g0),
g2 AS (SELECT event_id, CASE WHEN stale THEN 0.0 ELSE raw END AS confidence, CASE WHEN stale THEN 'stale_data' WHEN q[3] >= 0.55 AND q[3] - q[2] >= 0.15 AND NOT clash THEN 'signal' ELSE 'insufficient_confidence' END AS status,
 CASE WHEN stale THEN 'Unavailable' WHEN raw >= 0.7 THEN 'High' WHEN raw >= 0.5 THEN 'Medium' ELSE 'Low' END AS level FROM g1)"""


def _gated(spark, d):
    p = t.predictions(spark, d).withColumns({"is_fresh": F.col("event_id") % 17 != 0, "is_complete": F.col("user_id") % 13 != 0, "lower": F.col("lower") / 4, "upper": F.col("upper") / 4})
    return G.gate_confidence(p)


@query("gate_confidence", f"WITH {SQL_GATE} SELECT event_id, {r('confidence')}, status, level FROM g2")
def gate_confidence(spark, d):
    return _gated(spark, d).select("event_id", "confidence", "status", "level")


@query("risk_level", f"WITH {t.SQL_PRED} SELECT event_id, CASE WHEN 1 - exp(-scale * 2) < 0.25 THEN 'Low' WHEN 1 - exp(-scale * 2) < 0.5 THEN 'Medium' WHEN 1 - exp(-scale * 2) < 0.75 THEN 'High' ELSE 'VeryHigh' END AS level FROM pred")
def risk_level(spark, d):
    return t.predictions(spark, d).select("event_id", maths.risk_level(maths.target_risk(F.col("scale") * 2)).alias("level"))


@query("confidence_level", f"WITH {t.SQL_PRED} SELECT event_id, CASE WHEN greatest(p0, p1, p2) >= 0.7 THEN 'High' WHEN greatest(p0, p1, p2) >= 0.5 THEN 'Medium' ELSE 'Low' END AS level FROM pred")
def confidence_level(spark, d):
    return t.predictions(spark, d).select("event_id", maths.confidence_level(F.greatest("p0", "p1", "p2")).alias("level"))


@query("limitations_list", f"""WITH {t.SQL_MODELS} SELECT model_id, concat_ws(',', CASE WHEN NOT direction_eligible THEN 'direction_suppressed' END, CASE WHEN NOT scenario_eligible THEN 'scenario_unverified' END, CASE WHEN asset_class = 'us_equity' THEN 'eod_shadow_only' END,
 CASE WHEN asset_class = 'us_equity' THEN 'horizon_in_sessions' END, CASE WHEN asset_class <> 'us_equity' THEN 'news_not_used' END, 'factors_not_causal', 'not_advice') AS limitations FROM models""")
def limitations_list(spark, d):
    codes = G.limitations(F.col("direction_eligible"), F.col("scenario_eligible"), F.col("asset_class") == "us_equity")
    return t.models(spark, d).select("model_id", F.array_join(codes, ",").alias("limitations"))


@query("champion_shadow", f"WITH {t.SQL_MODELS} SELECT version, NOT is_production AND row_number() OVER (PARTITION BY asset_class, horizon_days, is_production ORDER BY trained_at DESC, version DESC) = 1 AS is_shadow_candidate FROM models")
def champion_shadow(spark, d):
    return G.champion_shadow(t.models(spark, d)).select("version", "is_shadow_candidate")


@query("promote_production", f"""WITH {t.SQL_MODELS}, x AS (SELECT *, production_eligible AND row_number() OVER (PARTITION BY asset_class, horizon_days, production_eligible ORDER BY trained_at DESC, version DESC) = 1 AS pick, bool_or(production_eligible) OVER (PARTITION BY asset_class, horizon_days) AS anye FROM models)
SELECT version, CASE WHEN anye THEN pick ELSE is_production END AS is_production FROM x""")
def promote_production(spark, d):
    return G.promote_production(t.models(spark, d)).select("version", "is_production")


CUT = "2001-07-30"


def asset_ids(spark, d):
    """The traded assets and those of the dimension, which have no snapshots here."""
    traded = t.load(spark, d, "orders").select(F.col("o_orderstatus").alias("asset_id"))
    return traded.unionByName(t.load(spark, d, "nation").select(F.col("n_name").alias("asset_id"))).distinct()


@query("readiness_history", f"""WITH {t.SQL_SNAPS}, k AS (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY snapshot_time DESC) AS rn FROM snaps WHERE is_complete AND snapshot_time <= TIMESTAMP '{CUT}' QUALIFY rn <= 90),
f AS (SELECT asset_id, rn, CASE WHEN snapshot_time <> TIMESTAMP '{CUT}' - to_days((rn - 1)::INT) THEN 'gap' WHEN available_at > TIMESTAMP '{t.NOW}' OR source_max_event_time >= snapshot_time THEN 'as_of_violation' END AS fault FROM k),
g AS (SELECT asset_id, count(*) AS days, arg_max(fault, rn) FILTER (WHERE fault IS NOT NULL) AS fault FROM f GROUP BY 1)
SELECT asset_id, {big('coalesce(days, 0)', 'days')}, CASE WHEN coalesce(days, 0) < 90 THEN coalesce(days, 0) || '/90' ELSE coalesce(fault, '') END AS reason, coalesce(days, 0) >= 90 AND fault IS NULL AS ready
 FROM (SELECT DISTINCT o_orderstatus AS asset_id FROM orders UNION SELECT n_name FROM nation) LEFT JOIN g USING (asset_id)""")
def readiness_history(spark, d):
    return G.readiness_history(t.order_snapshots(spark, d), t.ts(CUT), t.ts(t.NOW), assets=asset_ids(spark, d))


@query("readiness_spot", f"""WITH {t.SQL_BARS}, a AS (SELECT asset_id, count(*) AS rows, max(open_time) AS last_time FROM bars WHERE open_time <= TIMESTAMP '2001-07-01' GROUP BY 1), b AS (SELECT *, rows >= 365 AND last_time = TIMESTAMP '2001-07-01' AS own FROM a)
SELECT asset_id, {big('rows')}, last_time, own AND (SELECT own FROM b WHERE asset_id = '{t.BENCH}') AS ready FROM b""")
def readiness_spot(spark, d):
    cut = t.ts("2001-07-01")
    return G.readiness_spot(t.daily_bars(spark, d).where(F.col("open_time") <= cut), cut, t.BENCH)


@query("freshness_state", f"WITH {SQL_LATEST}, m AS (SELECT symbol, max(close_time) AS ct FROM hb GROUP BY 1) SELECT symbol, CASE WHEN TIMESTAMP '{t.EVENT_NOW}' - ct <= INTERVAL 2 HOUR THEN 'fresh' ELSE 'stale' END AS state_2h, CASE WHEN TIMESTAMP '{t.EVENT_NOW}' - ct <= INTERVAL 26 HOUR THEN 'fresh' ELSE 'stale' END AS state_26h FROM m")
def freshness_state(spark, d):
    m = _hour_reports(spark, d).groupBy("symbol").agg(F.max("close_time").alias("ct"))
    return m.select("symbol", maths.freshness(F.col("ct"), t.ts(t.EVENT_NOW), "2 HOUR").alias("state_2h"), maths.freshness(F.col("ct"), t.ts(t.EVENT_NOW), "26 HOUR").alias("state_26h"))


# --- reports -------------------------------------------------------------------------------------

def order_bars(spark, d):
    """Orders as final and open bars of the nation assets."""
    k = F.col("o_orderkey")
    return t.load(spark, d, "orders").select(
        F.concat(F.lit("NATION_"), (k % 24).cast("string")).alias("symbol"), (F.col("o_orderdate") + F.make_dt_interval(F.lit(0), (k % 24).cast("int"))).alias("close_time"),
        F.col("o_totalprice").alias("close"), (k % 6 != 0).alias("is_final"), (F.col("o_orderdate") + F.expr("INTERVAL 25 HOUR")).alias("ingested_at"), k.alias("k"))


SQL_OB = """ob AS (SELECT 'NATION_' || (o_orderkey % 24) AS symbol, o_orderdate + to_hours((o_orderkey % 24)::INT) AS close_time, o_totalprice AS close, o_orderkey % 6 <> 0 AS is_final, o_orderdate + INTERVAL 25 HOUR AS ingested_at, o_orderkey AS k FROM orders),
lt AS (SELECT symbol, max(close_time) FILTER (WHERE is_final) AS latest_close, max(ingested_at) AS last_ingested FROM ob GROUP BY 1)"""
SQL_LN = "ln AS (SELECT symbol, max(published_at) AS latest_published, max(retrieved_at) AS last_retrieved FROM news GROUP BY 1)"


def q_fresh(c, limit):
    return f"CASE WHEN {c} IS NULL THEN 'missing' WHEN TIMESTAMP '{t.NOW}' - {c} <= INTERVAL {limit} HOUR THEN 'fresh' ELSE 'stale' END"


@query("freshness_report", f"""WITH {t.SQL_ASSETS}, {SQL_OB}, {t.SQL_NEWS}, {SQL_LN}
SELECT 'price_bars' AS dataset, symbol, latest_close AS data_time, last_ingested AS ingested_at, {q_fresh('latest_close', 2)} AS state FROM assets LEFT JOIN lt USING (symbol) WHERE is_active
UNION ALL SELECT 'news_shadow', symbol, latest_published, last_retrieved, {q_fresh('last_retrieved', 2)} FROM assets LEFT JOIN ln USING (symbol) WHERE is_active""")
def freshness_report(spark, d):
    return RP.freshness_report(t.assets(spark, d), order_bars(spark, d), t.news(spark, d), t.ts(t.NOW))


@query("asset_list", f"""WITH {t.SQL_ASSETS}, {SQL_OB}, f AS (SELECT symbol, max(row(close_time, close)) AS x FROM ob WHERE is_final GROUP BY 1)
SELECT symbol, asset_class, {rexp('x[2]', 'latest_price')}, x[1] AS price_time, {q_fresh('x[1]', 72)} AS freshness FROM assets LEFT JOIN f USING (symbol) WHERE is_active OR is_shadow_enabled""")
def asset_list(spark, d):
    bars = order_bars(spark, d)
    latest = bars.where("is_final").groupBy("symbol").agg(F.max(F.struct("close_time", "close")).alias("x"))
    unique = latest.select("symbol", "x.close_time", "x.close", F.lit(True).alias("is_final"))
    return RP.asset_list(t.assets(spark, d), unique, t.ts(t.NOW), "72 HOUR")


SQL_FACTORS = """fk AS (SELECT l_orderkey AS prediction_id, 'line_' || l_linenumber AS feature, round(sum(l_discount - 0.05), 9) AS delta FROM lineitem GROUP BY 1, 2),
fr AS (SELECT *, row_number() OVER (PARTITION BY prediction_id, delta > 0 ORDER BY abs(delta) DESC, feature) AS rn FROM fk WHERE delta <> 0),
fl AS (SELECT prediction_id, string_agg(feature, ',' ORDER BY rn) FILTER (WHERE delta > 0) AS positive, string_agg(feature, ',' ORDER BY rn) FILTER (WHERE delta < 0) AS negative FROM fr WHERE rn <= 3 GROUP BY 1)"""


def factors(spark, d):
    """What each line of an order takes off it against the usual, as factors of the prediction of that number."""
    lines = t.load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("prediction_id"), F.concat(F.lit("line_"), F.col("l_linenumber").cast("string")).alias("feature"))
    return top_factors_of(lines.agg(F.round(F.sum(F.col("l_discount") - 0.05), 9).alias("delta")), ["prediction_id"])


@query("analysis_report", f"""WITH {SQL_LA}, {SQL_OB}, {t.SQL_NEWS}, {SQL_LN}, {SQL_FACTORS} SELECT la.symbol, {big('la.horizon_days', 'horizon_days')}, la.prediction_id, {q_fresh('latest_close', 26)} AS freshness, latest_published,
 CASE WHEN risk_score < 0.25 THEN 'Low' WHEN risk_score < 0.5 THEN 'Medium' WHEN risk_score < 0.75 THEN 'High' ELSE 'VeryHigh' END AS risk_level, coalesce(positive, '') AS positive, coalesce(negative, '') AS negative,
 concat_ws(',', CASE WHEN NOT m.direction_eligible THEN 'direction_suppressed' END, CASE WHEN NOT m.scenario_eligible THEN 'scenario_unverified' END, CASE WHEN a.asset_class = 'us_equity' THEN 'eod_shadow_only' END,
 CASE WHEN a.asset_class = 'us_equity' THEN 'horizon_in_sessions' END, CASE WHEN a.asset_class <> 'us_equity' THEN 'news_not_used' END, 'factors_not_causal', 'not_advice') AS limitations
 FROM la JOIN models m ON m.model_id = la.model_id JOIN assets a ON a.symbol = la.symbol LEFT JOIN lt ON lt.symbol = la.symbol LEFT JOIN ln ON ln.symbol = la.symbol LEFT JOIN fl ON fl.prediction_id = la.prediction_id""")
def analysis_report(spark, d):
    out = RP.analysis_report(_latest(spark, d), order_bars(spark, d), t.news(spark, d), t.ts(t.NOW), factors(spark, d))
    lists = [F.array_join(c, ",").alias(c) for c in ("positive", "negative", "limitations")]
    return out.select("symbol", "horizon_days", "prediction_id", "freshness", "latest_published", "risk_level", *lists)


SQL_ISSUES = """iss AS (SELECT o_orderkey AS issue_id, 'A' || (o_custkey % 5) AS asset_id, CASE WHEN o_orderkey % 2 = 0 THEN 'DERIVATIVE_CUTOFF_INCOMPLETE' ELSE 'US_EQUITY_SESSION_INCOMPLETE' END AS code, o_orderdate AS data_time, o_orderkey % 400 > 1 AS is_resolved FROM orders)"""


def issues(spark, d):
    k = F.col("o_orderkey")
    return t.load(spark, d, "orders").select(k.alias("issue_id"), F.concat(F.lit("A"), (F.col("o_custkey") % 5).cast("string")).alias("asset_id"),
                                             F.when(k % 2 == 0, "DERIVATIVE_CUTOFF_INCOMPLETE").otherwise("US_EQUITY_SESSION_INCOMPLETE").alias("code"), F.col("o_orderdate").alias("data_time"), (k % 400 > 1).alias("is_resolved"))


@query("issue_log", f"""WITH {SQL_ISSUES}, old AS (SELECT * FROM iss WHERE data_time < TIMESTAMP '2000-01-01'), new AS (SELECT * FROM iss WHERE data_time >= TIMESTAMP '1999-06-01'),
fr AS (SELECT DISTINCT asset_id, code, data_time FROM new WHERE NOT EXISTS (SELECT 1 FROM old WHERE NOT old.is_resolved AND old.asset_id = new.asset_id AND old.code = new.code AND old.data_time = new.data_time))
SELECT asset_id, code, data_time FROM old UNION ALL SELECT * FROM fr""")
def issue_log(spark, d):
    i = issues(spark, d)
    return G.issue_log(i.where(F.col("data_time") < t.ts("2000-01-01")), i.where(F.col("data_time") >= t.ts("1999-06-01"))).select("asset_id", "code", "data_time")


SQL_DC = f"""{t.SQL_SNAPS}, dn AS (SELECT * FROM snaps WHERE is_complete AND snapshot_time >= TIMESTAMP '{CUT}' - INTERVAL 97 DAY), la AS (SELECT asset_id, max(snapshot_time) AS latest_snapshot, arg_max(available_at, snapshot_time) AS available_at FROM dn GROUP BY 1),
di AS (SELECT asset_id, snapshot_time::DATE AS d, snapshot_time::DATE - CAST(row_number() OVER (PARTITION BY asset_id ORDER BY snapshot_time) AS INT) AS g FROM (SELECT DISTINCT asset_id, snapshot_time FROM dn)),
ds AS (SELECT asset_id, count(*) AS streak_days FROM di GROUP BY asset_id, g QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY max(d) DESC) = 1),
dr AS (SELECT a.asset_id, latest_snapshot, coalesce(streak_days, 0) AS streak_days, CASE WHEN latest_snapshot IS NULL THEN 'missing' WHEN latest_snapshot <> TIMESTAMP '{CUT}' THEN 'stale' WHEN streak_days >= 90 THEN 'ready' ELSE 'warming' END AS state,
 least(1.0, coalesce(streak_days, 0) / 90.0) AS readiness, epoch_us(available_at - latest_snapshot) / 6e7 AS latency_minutes FROM (SELECT DISTINCT o_orderstatus AS asset_id FROM orders UNION ALL SELECT 'Z') a LEFT JOIN la USING (asset_id) LEFT JOIN ds USING (asset_id))"""


def _collector(spark, d):
    snaps = t.order_snapshots(spark, d)
    ids = snaps.select("asset_id").distinct().union(spark.createDataFrame([("Z",)], "asset_id string"))
    return RP.collector_assets(ids, snaps, t.ts(CUT))


@query("dash_collector", f"WITH {SQL_DC} SELECT asset_id, latest_snapshot, {big('streak_days')}, state, {r('readiness', 'latency_minutes')} FROM dr")
def dash_collector(spark, d):
    return _collector(spark, d).select("asset_id", "latest_snapshot", "streak_days", "state", "readiness", "latency_minutes")


@query("dash_collector_overall", f"""WITH {SQL_DC}, {SQL_ISSUES}, a AS (SELECT count(*) AS assets, count(*) FILTER (WHERE latest_snapshot = TIMESTAMP '{CUT}') AS complete, count(*) FILTER (WHERE state = 'ready') AS ready, (SELECT count(*) FROM iss WHERE code = 'DERIVATIVE_CUTOFF_INCOMPLETE' AND NOT is_resolved) AS open_issues FROM dr)
SELECT {big('assets')}, {big('complete')}, {big('ready')}, {big('open_issues')}, CASE WHEN open_issues > 0 THEN 'degraded' WHEN complete = assets AND ready = assets THEN 'healthy' WHEN complete = assets THEN 'warming' WHEN complete = 0 AND ready = 0 THEN 'no_data' ELSE 'degraded' END AS overall_state FROM a""")
def dash_collector_overall(spark, d):
    return RP.collector_overall(_collector(spark, d), issues(spark, d), t.ts(CUT))


@query("dash_collector_latency", f"""WITH {t.SQL_SNAPS}, l AS (SELECT epoch_us(available_at - snapshot_time) / 6e7 AS latency FROM snaps WHERE is_complete AND snapshot_time BETWEEN TIMESTAMP '{CUT}' - INTERVAL 6 DAY AND TIMESTAMP '{CUT}')
SELECT {big('count(*)', 'snapshots')}, {rexp('avg((latency <= 45)::INT)', 'on_time_share')}, {rexp('avg(latency)', 'mean_latency')}, {rexp('quantile_disc(latency, 0.95)', 'p95_latency')} FROM l WHERE latency >= 0""")
def dash_collector_latency(spark, d):
    return RP.latency_stats(t.order_snapshots(spark, d), t.ts(CUT))


SQL_DE = f"""{t.SQL_BARS}, bb AS (SELECT * FROM bars WHERE NOT (asset_id = 'PROMO' AND open_time > TIMESTAMP '2001-01-01')), sm AS (SELECT asset_id, count(*) AS bar_count, min(open_time) AS first_bar, max(open_time) AS latest_bar FROM bb GROUP BY 1),
de AS (SELECT asset_id, coalesce(bar_count, 0) AS bar_count, first_bar, latest_bar, (SELECT latest_bar FROM sm WHERE asset_id = '{t.BENCH}') AS latest_session FROM (SELECT DISTINCT p_type AS asset_id FROM part UNION ALL SELECT 'ABSENT') LEFT JOIN sm USING (asset_id)),
dx AS (SELECT *, CASE WHEN latest_bar IS NULL THEN 'missing' WHEN latest_bar <> latest_session THEN 'stale' WHEN bar_count >= 90 THEN 'ready' ELSE 'warming' END AS state, least(1.0, bar_count / 90.0) AS readiness FROM de)"""


def _equity(spark, d):
    ids = t.part_assets(spark, d).union(spark.createDataFrame([("ABSENT",)], "asset_id string"))
    gone = (F.col("asset_id") == "PROMO") & (F.col("open_time") > t.ts("2001-01-01"))
    return RP.equity_assets(ids, t.daily_bars(spark, d).where(~gone), t.BENCH)


@query("dash_equity", f"WITH {SQL_DE} SELECT asset_id, {big('bar_count')}, first_bar, latest_bar, state, {r('readiness')} FROM dx")
def dash_equity(spark, d):
    return _equity(spark, d).select("asset_id", "bar_count", "first_bar", "latest_bar", "state", "readiness")


@query("dash_equity_overall", f"""WITH {SQL_DE}, {SQL_ISSUES}, a AS (SELECT count(*) AS assets, count(*) FILTER (WHERE state = 'ready') AS ready, sum(bar_count) AS bars, min(first_bar) AS first_bar, max(latest_session) AS latest_session, (SELECT count(*) FROM iss WHERE code = 'NONE' AND NOT is_resolved) AS open_issues FROM dx)
SELECT {big('assets')}, {big('ready')}, {big('bars')}, first_bar, latest_session, {big('open_issues')}, CASE WHEN assets = 0 THEN 'no_data' WHEN open_issues > 0 THEN 'degraded' WHEN assets = ready THEN 'healthy' WHEN ready = 0 THEN 'no_data' ELSE 'warming' END AS overall_state FROM a""")
def dash_equity_overall(spark, d):
    return RP.equity_overall(_equity(spark, d), issues(spark, d), "NONE")


SQL_SHADOW = f"""{t.SQL_ASSETS}, {t.SQL_MODELS}, {t.SQL_MPRED}, sc AS (SELECT * FROM (SELECT *, NOT is_production AND row_number() OVER (PARTITION BY asset_class, horizon_days, is_production ORDER BY trained_at DESC, version DESC) = 1 AS cand FROM models) WHERE cand OR (model_id % 3 = 1 AND NOT is_production)),
pt AS (SELECT p.*, sc.horizon_days FROM mpred p JOIN sc ON sc.model_id = p.model_id WHERE p.is_shadow), dy AS (SELECT model_id, horizon_days, analysis_time::DATE AS d, count(*) AS n, count(*) FILTER (WHERE analysis_time + to_days(horizon_days::INT) <= TIMESTAMP '{t.NOW}') AS due, min(analysis_time) AS f, max(analysis_time) AS l FROM pt GROUP BY 1, 2, 3),
dz AS (SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY d DESC) AS back FROM dy), ag AS (SELECT model_id, min(f) AS started_at, max(l) AS last_at, count(*) AS prediction_days, sum(n) AS prediction_count, sum(due) AS cal, sum(CASE WHEN back > horizon_days THEN n ELSE 0 END) AS ses FROM dz GROUP BY 1),
sp AS (SELECT sc.model_id, sc.version, sc.asset_class, sc.horizon_days, started_at, last_at, coalesce(prediction_days, 0) AS prediction_days, coalesce(prediction_count, 0) AS prediction_count, CASE WHEN sc.asset_class = 'us_equity' THEN coalesce(ses, 0) ELSE coalesce(cal, 0) END AS matured,
 least(greatest(CASE WHEN sc.asset_class = 'us_equity' THEN coalesce(prediction_days, 0) - 1 ELSE coalesce(floor(epoch_us(TIMESTAMP '{t.NOW}' - started_at) / 86400e6), 0) END, 0), sc.horizon_days) AS elapsed_days,
 CASE WHEN sc.asset_class = 'us_equity' THEN 15 ELSE 10 END AS total_assets FROM sc LEFT JOIN ag USING (model_id)),
sq AS (SELECT *, CASE WHEN total_assets * prediction_days = 0 THEN 0.0 ELSE least(1.0, prediction_count / (total_assets * prediction_days)::DOUBLE) END AS coverage, CASE WHEN prediction_count = 0 THEN 'waiting' WHEN matured > 0 THEN 'evaluable' ELSE 'collecting' END AS state FROM sp)"""


def _shadow(spark, d):
    m = G.champion_shadow(t.models(spark, d))
    m = m.withColumn("is_shadow_candidate", F.col("is_shadow_candidate") | ((F.col("model_id") % 3 == 1) & ~F.col("is_production")))
    totals = m.select("asset_class").distinct().withColumn("total_assets", F.when(F.col("asset_class") == "us_equity", 15).otherwise(10))
    return RP.shadow_progress(m, t.model_predictions(spark, d), totals, t.ts(t.NOW))


@query("dash_shadow", f"WITH {SQL_SHADOW} SELECT model_id, version, asset_class, {big('horizon_days')}, started_at, last_at, {big('elapsed_days')}, {big('prediction_days')}, {big('prediction_count')}, {big('matured')}, {r('coverage')}, state FROM sq")
def dash_shadow(spark, d):
    return _shadow(spark, d).select("model_id", "version", "asset_class", "horizon_days", "started_at", "last_at", "elapsed_days", "prediction_days", "prediction_count", "matured", "coverage", "state")


@query("dash_shadow_overall", f"WITH {SQL_SHADOW} SELECT {big('count(*)', 'models')}, {big('sum(prediction_count)', 'predictions')}, {big('sum(matured)', 'matured')}, CASE WHEN count(*) = 0 THEN 'no_candidate' WHEN bool_and(state = 'waiting') THEN 'waiting' WHEN bool_or(state = 'evaluable') THEN 'evaluable' ELSE 'collecting' END AS state FROM sq")
def dash_shadow_overall(spark, d):
    return RP.shadow_overall(_shadow(spark, d))


@query("model_card", f"WITH {t.SQL_MODELS} SELECT version, {big('horizon_days')}, trained_at, direction_eligible, 'brier_score,sample_count' AS metric_names, {r('brier_score')} FROM models")
def model_card(spark, d):
    return RP.model_card(t.models(spark, d)).select("version", "horizon_days", "trained_at", "direction_eligible", F.array_join("metric_names", ",").alias("metric_names"), RP.metric("brier_score").alias("brier_score"))


@query("performance_report", f"WITH {t.SQL_MODELS} SELECT {big('horizon_days')}, version, trained_at, {r('brier_score')}, model_id AS sample_count FROM models WHERE asset_class = 'crypto' AND is_production QUALIFY row_number() OVER (PARTITION BY horizon_days ORDER BY trained_at DESC, version DESC) = 1")
def performance_report(spark, d):
    return RP.performance_report(t.models(spark, d)).drop("baseline_brier_score")


@query("backfill_missing", f"""WITH {t.SQL_SNAPS}, a AS (SELECT DISTINCT asset_id FROM snaps), g AS (SELECT asset_id, TIMESTAMP '{CUT}' - to_days(i::INT) AS snapshot_time, i FROM a, range(0, 120) x(i))
SELECT asset_id, snapshot_time, i < 30 AS fetchable FROM g WHERE (asset_id, snapshot_time) NOT IN (SELECT (asset_id, snapshot_time) FROM snaps WHERE is_complete)""")
def backfill_missing(spark, d):
    s = t.order_snapshots(spark, d)
    return G.backfill_missing(s.select("asset_id").distinct(), s.where("is_complete"), t.ts(CUT), 120)


@query("ui_means", f"WITH {SQL_SHADOW} SELECT {big('count(*) FILTER (WHERE is_active)', 'active_assets')}, {big('count(*) FILTER (WHERE is_shadow_enabled)', 'shadow_assets')}, {big('count(*)', 'assets')}, {rexp('(SELECT avg(coverage) FROM sq)', 'mean_coverage')} FROM assets")
def ui_means(spark, d):
    return RP.ui_means(_shadow(spark, d), t.assets(spark, d))
