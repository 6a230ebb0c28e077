"""The provided tables seen as market data, once as DataFrames and once as SQL common table expressions.

* daily bars   - lineitem with part: asset = p_type, day = l_shipdate, price = l_extendedprice
* ticks        - events: asset = event_type, price = value
* macro        - orders: series = o_orderpriority, date = o_orderdate
* predictions  - events with class probabilities and intervals from modular arithmetic
* derivatives  - events seen as hourly / 5-minute series; orders per status and day as snapshots
* news         - documents
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import bars as B
from tidemark.session import stage

BENCH = "STANDARD"
NOW = "2001-08-05 12:00:00"
EVENT_NOW = "2024-01-31 06:00:00"


def load(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def ts(text: str):
    return F.lit(text).cast("timestamp_ntz")


# --- ticks and daily bars from lineitem ----------------------------------------------------------

# One long orders the ticks of a day: first and last then stay in hash aggregation (no sort).
TICK_ORDER = ("tick_no",)


def item_ticks(spark: SparkSession, d: str) -> DataFrame:
    li, part = load(spark, d, "lineitem"), load(spark, d, "part").select("p_partkey", "p_type")
    price = F.col("l_extendedprice")
    return li.join(part, li.l_partkey == part.p_partkey).select(
        F.col("p_type").alias("asset_id"), F.col("l_shipdate").alias("open_time"),
        price.alias("open"), price.alias("high"), price.alias("low"), price.alias("close"),
        F.col("l_quantity").alias("volume"), (F.col("l_quantity") * price).alias("quote_volume"),
        F.lit(1.0).alias("trade_count"),
        F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0.0).alias("taker_buy_base_volume"),
        ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 1048576 + (F.col("l_partkey") * 31 + F.col("l_suppkey")) % 1048576).alias("tick_no"))


def daily_bars(spark: SparkSession, d: str) -> DataFrame:
    return B.ohlc_daily(item_ticks(spark, d), order=TICK_ORDER)


def series(spark: SparkSession, d: str) -> DataFrame:
    """Daily bars as a written table: windowed features read them more than once, the ticks only once."""
    return stage(daily_bars(spark, d))


SQL_TICKS = """
ticks AS (
  SELECT p_type AS asset_id, l_shipdate AS open_time, l_extendedprice AS price, l_quantity AS volume,
         l_quantity * l_extendedprice AS quote_volume,
         CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0.0 END AS taker,
         (l_orderkey * 8 + l_linenumber) * 1048576 + (l_partkey * 31 + l_suppkey) % 1048576 AS k
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""
SQL_BARS = SQL_TICKS + """,
bars AS (
  SELECT asset_id, date_trunc('day', open_time) + INTERVAL 1 DAY AS open_time,
         arg_min(price, k) AS open, max(price) AS high, min(price) AS low, arg_max(price, k) AS close,
         sum(volume) AS volume, sum(quote_volume) AS quote_volume, CAST(count(*) AS DOUBLE) AS trade_count,
         sum(taker) AS taker_buy_base_volume
  FROM ticks GROUP BY 1, 2)"""
# Bars with position, previous close and one-step return.
SQL_SERIES = SQL_BARS + """,
s0 AS (SELECT *, row_number() OVER w - 1 AS i, lag(close) OVER w AS pc FROM bars WINDOW w AS (PARTITION BY asset_id ORDER BY open_time)),
s AS (SELECT *, ln(close / pc) AS r, close - pc AS d FROM s0)"""

# --- ticks from events ---------------------------------------------------------------------------


def events(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events")


def event_ticks(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    return events(spark, d).where(v > 0).select(
        F.col("event_type").alias("asset_id"), F.col("ts").alias("open_time"),
        v.alias("open"), v.alias("high"), v.alias("low"), v.alias("close"),
        F.lit(1.0).alias("volume"), v.alias("quote_volume"), F.lit(1.0).alias("trade_count"),
        F.when(F.col("user_id") % 2 == 0, 1.0).otherwise(0.0).alias("taker_buy_base_volume"), "event_id")


def hourly_bars(spark: SparkSession, d: str) -> DataFrame:
    """Hour bars of the events with close time one microsecond before the next hour."""
    ticks = event_ticks(spark, d)
    hour = F.date_trunc("hour", "open_time").cast("timestamp_ntz").alias("_h")
    out = ticks.groupBy("asset_id", hour).agg(*B.ohlc_aggregates(F.col("event_id")))
    return out.withColumnRenamed("_h", "open_time").withColumns({
        "close_time": F.col("open_time") + F.expr("INTERVAL '0 00:59:59.999999' DAY TO SECOND"),
        "is_final": F.hour("open_time") != 13, "interval": F.lit("1h"), "source": F.lit("feed")})


SQL_HOURLY = """
ev AS (SELECT event_type AS asset_id, ts, value, user_id, event_id AS k FROM events WHERE value > 0),
hours AS (
  SELECT asset_id, date_trunc('hour', ts) AS open_time, arg_min(value, k) AS open, max(value) AS high,
         min(value) AS low, arg_max(value, k) AS close, CAST(count(*) AS DOUBLE) AS volume,
         sum(value) AS quote_volume, CAST(count(*) AS DOUBLE) AS trade_count,
         CAST(count(*) FILTER (WHERE user_id % 2 = 0) AS DOUBLE) AS taker_buy_base_volume,
         date_trunc('hour', ts) + INTERVAL '3599.999999 seconds' AS close_time,
         hour(date_trunc('hour', ts)) <> 13 AS is_final, '1h' AS interval, 'feed' AS source
  FROM ev GROUP BY asset_id, date_trunc('hour', ts))"""

# --- asset dimension -----------------------------------------------------------------------------


def assets(spark: SparkSession, d: str) -> DataFrame:
    """Nations as assets of a region class; two flags by key arithmetic."""
    n, rg = load(spark, d, "nation"), load(spark, d, "region")
    return n.join(rg, n.n_regionkey == rg.r_regionkey).select(
        F.col("n_name").alias("symbol"), F.col("r_name").alias("asset_class"), F.col("n_nationkey").alias("asset_no"),
        (F.col("n_nationkey") % 3 != 0).alias("is_active"), (F.col("n_nationkey") % 4 == 0).alias("is_shadow_enabled"))


SQL_ASSETS = """
assets AS (SELECT n_name AS symbol, r_name AS asset_class, n_nationkey AS asset_no, n_nationkey % 3 <> 0 AS is_active,
                  n_nationkey % 4 = 0 AS is_shadow_enabled FROM nation JOIN region ON n_regionkey = r_regionkey)"""


def part_assets(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "part").select(F.col("p_type").alias("asset_id")).distinct()


# --- macro ---------------------------------------------------------------------------------------

SERIES = {"1-URGENT": "vix", "2-HIGH": "treasury_2y", "3-MEDIUM": "treasury_10y", "5-LOW": "financial_conditions"}


def macro_long(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "orders").groupBy(
        F.col("o_orderpriority").alias("series"), F.col("o_orderdate").alias("observation_date")).agg(
        F.avg("o_totalprice").alias("value"))


SQL_MACRO = """
mlong AS (SELECT o_orderpriority AS series, o_orderdate AS observation_date, avg(o_totalprice) AS value
          FROM orders GROUP BY 1, 2),
mwide0 AS (SELECT observation_date,
   max(value) FILTER (WHERE series = '1-URGENT') AS vix, max(value) FILTER (WHERE series = '2-HIGH') AS treasury_2y,
   max(value) FILTER (WHERE series = '3-MEDIUM') AS treasury_10y,
   max(value) FILTER (WHERE series = '5-LOW') AS financial_conditions FROM mlong GROUP BY 1),
mwide AS (SELECT observation_date, last_value(vix IGNORE NULLS) OVER f AS vix,
   last_value(treasury_2y IGNORE NULLS) OVER f AS treasury_2y, last_value(treasury_10y IGNORE NULLS) OVER f AS treasury_10y,
   last_value(financial_conditions IGNORE NULLS) OVER f AS financial_conditions
   FROM mwide0 WINDOW f AS (ORDER BY observation_date ROWS BETWEEN 10 PRECEDING AND CURRENT ROW)),
mfeat AS (SELECT observation_date, observation_date + INTERVAL 7 DAY AS available_at, vix / 100 AS vix_level,
   ln(vix / lag(vix, 5) OVER o) AS vix_change_5s,
   CASE WHEN count(vix) OVER z >= 40 AND stddev_samp(vix) OVER z <> 0 THEN (vix - avg(vix) OVER z) / stddev_samp(vix) OVER z END AS vix_zscore_60s,
   treasury_10y / 100 AS treasury_10y_level, (treasury_10y - treasury_2y) / 100 AS yield_curve_10y_2y,
   (treasury_10y - treasury_2y) / 100 - lag((treasury_10y - treasury_2y) / 100, 20) OVER o AS yield_curve_change_20s,
   financial_conditions AS financial_conditions_level,
   financial_conditions - lag(financial_conditions, 20) OVER o AS financial_conditions_change_20s
   FROM mwide WINDOW o AS (ORDER BY observation_date), z AS (ORDER BY observation_date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)),
macro AS (SELECT * FROM mfeat WHERE vix_level IS NOT NULL AND vix_change_5s IS NOT NULL AND vix_zscore_60s IS NOT NULL
   AND treasury_10y_level IS NOT NULL AND yield_curve_10y_2y IS NOT NULL AND yield_curve_change_20s IS NOT NULL
   AND financial_conditions_level IS NOT NULL AND financial_conditions_change_20s IS NOT NULL)"""

# --- predictions ---------------------------------------------------------------------------------


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """One scored row per event: label, model and baseline probabilities, interval and scale."""
    e, u, v = F.col("event_id"), F.col("user_id"), F.col("value")
    a, b, c = 1 + e * 7 % 13, 1 + e * 11 % 17, 1 + u * 5 % 11
    x, y, z = 2 + e % 3, 3 + u % 2, F.lit(2)
    total, btotal = a + b + c, x + y + z
    return events(spark, d).select(
        "event_id", "user_id", F.col("event_type").alias("asset_id"), F.col("ts").alias("snapshot_time"), "value",
        F.concat(F.lit("wf-"), (2021 + e % 3).cast("string")).alias("fold"),
        F.concat(F.lit("v"), (e % 4).cast("string")).alias("variant"),
        F.when(v < 5, 0).when(v < 14, 1).otherwise(2).alias("y"),
        (a / total).alias("p0"), (b / total).alias("p1"), (c / total).alias("p2"),
        (x / btotal).alias("b0"), (y / btotal).alias("b1"), (z / btotal).alias("b2"),
        ((v - 10) / 10).alias("target"), (-0.5 - (e % 5) / 10).alias("lower"), (((u % 9) - 4) / 20).alias("mid"),
        (0.5 + (u % 7) / 10).alias("upper"), (0.05 + (e % 9) / 20).alias("scale"), (0.1 + (u % 5) / 10).alias("band"),
        (((e % 5) - 2).cast("double")).alias("market_regime"), (((u % 3) - 1).cast("double")).alias("spy_regime"))


SQL_PRED = """
pred AS (
  SELECT event_id, user_id, event_type AS asset_id, ts AS snapshot_time, value, 'wf-' || (2021 + event_id % 3) AS fold,
    'v' || (event_id % 4) AS variant, CASE WHEN value < 5 THEN 0 WHEN value < 14 THEN 1 ELSE 2 END AS y,
    (1 + event_id * 7 % 13)::DOUBLE / (3 + event_id * 7 % 13 + event_id * 11 % 17 + user_id * 5 % 11) AS p0,
    (1 + event_id * 11 % 17)::DOUBLE / (3 + event_id * 7 % 13 + event_id * 11 % 17 + user_id * 5 % 11) AS p1,
    (1 + user_id * 5 % 11)::DOUBLE / (3 + event_id * 7 % 13 + event_id * 11 % 17 + user_id * 5 % 11) AS p2,
    (2 + event_id % 3)::DOUBLE / (7 + event_id % 3 + user_id % 2) AS b0,
    (3 + user_id % 2)::DOUBLE / (7 + event_id % 3 + user_id % 2) AS b1, 2::DOUBLE / (7 + event_id % 3 + user_id % 2) AS b2,
    (value - 10) / 10 AS target, -0.5::DOUBLE - (event_id % 5)::DOUBLE / 10 AS lower, ((user_id % 9) - 4)::DOUBLE / 20 AS mid,
    0.5::DOUBLE + (user_id % 7)::DOUBLE / 10 AS upper, 0.05::DOUBLE + (event_id % 9)::DOUBLE / 20 AS scale,
    0.1::DOUBLE + (user_id % 5)::DOUBLE / 10 AS band, ((event_id % 5) - 2)::DOUBLE AS market_regime, ((user_id % 3) - 1)::DOUBLE AS spy_regime
  FROM events)"""
SQL_ROWBRIER = "((p0 - (y = 0)::INT) ** 2 + (p1 - (y = 1)::INT) ** 2 + (p2 - (y = 2)::INT) ** 2)"
SQL_ROWBASE = "((b0 - (y = 0)::INT) ** 2 + (b1 - (y = 1)::INT) ** 2 + (b2 - (y = 2)::INT) ** 2)"
SQL_ARGMAX = "CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END"

# --- daily snapshots from orders -----------------------------------------------------------------


def order_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """(asset, snapshot_time) per order status and day with derivative-like measures, some missing."""
    o = load(spark, d, "orders")
    day = o.groupBy(F.col("o_orderstatus").alias("asset_id"), F.col("o_orderdate").alias("snapshot_time")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("o_totalprice").alias("a"), F.max("o_totalprice").alias("m"),
        F.sum(F.col("o_custkey") % 7).alias("k"))
    n = F.col("n")
    return day.select(
        "asset_id", "snapshot_time", "n",
        F.when(n % 5 != 0, F.col("a") / 100000).alias("funding_rate"), F.when(n % 7 != 0, F.col("a") / 50000 - 3).alias("premium"),
        F.col("m").alias("futures_quote_volume"), F.when(n % 4 != 0, F.col("k") / (F.col("k") + n)).alias("futures_taker_buy_ratio"),
        F.when(n % 6 != 0, F.col("m") - F.col("a")).alias("open_interest_value"),
        F.when(F.col("k") % 2 == 0, (F.col("k") + 1.0) / n).alias("long_short_ratio"),
        F.when(F.col("k") % 3 == 0, (F.col("k") + 2.0) / n).alias("taker_long_short_ratio"),
        (F.col("k") % 11 != 0).alias("is_complete"),
        (F.col("snapshot_time") + F.make_dt_interval(F.lit(0), F.lit(0), (F.col("k") % 60).cast("int"))).alias("available_at"),
        (F.col("snapshot_time") - F.expr("INTERVAL 1 MINUTE")).alias("source_max_event_time"), "k")


SQL_SNAPS = """
od AS (SELECT o_orderstatus AS asset_id, o_orderdate AS snapshot_time, count(*) AS n, avg(o_totalprice) AS a,
              max(o_totalprice) AS m, CAST(sum(o_custkey % 7) AS BIGINT) AS k FROM orders GROUP BY 1, 2),
snaps AS (SELECT asset_id, snapshot_time, n, CASE WHEN n % 5 <> 0 THEN a / 100000 END AS funding_rate,
   CASE WHEN n % 7 <> 0 THEN a / 50000 - 3 END AS premium, m AS futures_quote_volume,
   CASE WHEN n % 4 <> 0 THEN k::DOUBLE / (k + n) END AS futures_taker_buy_ratio, CASE WHEN n % 6 <> 0 THEN m - a END AS open_interest_value,
   CASE WHEN k % 2 = 0 THEN (k + 1)::DOUBLE / n END AS long_short_ratio, CASE WHEN k % 3 = 0 THEN (k + 2)::DOUBLE / n END AS taker_long_short_ratio,
   k % 11 <> 0 AS is_complete, snapshot_time + to_minutes(k % 60) AS available_at,
   snapshot_time - INTERVAL 1 MINUTE AS source_max_event_time, k FROM od)"""

# --- registry and news ---------------------------------------------------------------------------


def models(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as model versions."""
    k = F.col("s_suppkey")
    return load(spark, d, "supplier").select(
        F.col("s_name").alias("version"), k.alias("model_id"), F.when(k % 2 == 0, "crypto").otherwise("us_equity").alias("asset_class"),
        F.when(k % 4 < 2, 30).otherwise(90).alias("horizon_days"),
        (ts("2001-01-01") + F.make_dt_interval((k % 37).cast("int"))).alias("trained_at"),
        (k % 5 == 0).alias("is_production"), (k % 10 == 3).alias("production_eligible"),
        (k % 3 != 0).alias("direction_eligible"), (k % 7 != 0).alias("scenario_eligible"),
        F.create_map(F.lit("brier_score"), F.abs(F.col("s_acctbal")) / 10000, F.lit("sample_count"), k.cast("double")).alias("metrics"))


SQL_MODELS = """
models AS (SELECT s_name AS version, s_suppkey AS model_id, CASE WHEN s_suppkey % 2 = 0 THEN 'crypto' ELSE 'us_equity' END AS asset_class,
   CASE WHEN s_suppkey % 4 < 2 THEN 30 ELSE 90 END AS horizon_days, TIMESTAMP '2001-01-01' + to_days((s_suppkey % 37)::INT) AS trained_at,
   s_suppkey % 5 = 0 AS is_production, s_suppkey % 10 = 3 AS production_eligible, s_suppkey % 3 <> 0 AS direction_eligible,
   s_suppkey % 7 <> 0 AS scenario_eligible, abs(s_acctbal) / 10000 AS brier_score FROM supplier)"""


def model_predictions(spark: SparkSession, d: str) -> DataFrame:
    """Orders as stored predictions of the models (a calendar of analysis days per model)."""
    o, k = load(spark, d, "orders"), F.col("o_orderkey")
    return o.select(k.alias("prediction_id"), F.col("o_custkey"), F.col("o_orderdate").alias("analysis_time"),
                 (k % 10).alias("model_id"), F.concat(F.lit("NATION_"), (F.col("o_custkey") % 25).cast("string")).alias("symbol"),
                 (k % 3 != 0).alias("is_shadow"), (F.col("o_totalprice") / 1000000).alias("risk_score"))


SQL_MPRED = """
mpred AS (SELECT o_orderkey AS prediction_id, o_custkey, o_orderdate AS analysis_time, o_orderkey % 10 AS model_id,
   'NATION_' || (o_custkey % 25) AS symbol, o_orderkey % 3 <> 0 AS is_shadow, o_totalprice / 1000000 AS risk_score
   FROM orders)"""


def news(spark: SparkSession, d: str) -> DataFrame:
    """Documents as articles: title, source, time by id, asset by id."""
    i = F.col("doc_id")
    return load(spark, d, "documents").select(
        "doc_id", F.col("text").alias("title"), F.concat(F.lit("https://news.example/"), (i % 50).cast("string")).alias("url"),
        F.concat(F.lit("NATION_"), (i % 25).cast("string")).alias("symbol"), "source", "lang",
        (ts("2001-01-01") + F.make_dt_interval((i % 200).cast("int"), (i % 24).cast("int"))).alias("published_at"),
        (ts("2001-08-01") + F.make_dt_interval(F.lit(0), (i % 100).cast("int"))).alias("retrieved_at"))


SQL_NEWS = """
news AS (SELECT doc_id, text AS title, 'https://news.example/' || (doc_id % 50) AS url,
   'NATION_' || (doc_id % 25) AS symbol, source, lang, TIMESTAMP '2001-01-01' + to_days((doc_id % 200)::INT) + to_hours((doc_id % 24)::INT) AS published_at,
   TIMESTAMP '2001-08-01' + to_hours((doc_id % 100)::INT) AS retrieved_at FROM documents)"""


def runs(spark: SparkSession, d: str) -> DataFrame:
    """Orders as ingestion runs."""
    k = F.col("o_orderkey")
    start = F.col("o_orderdate") + F.make_dt_interval(F.lit(0), (k % 24).cast("int"), (k % 60).cast("int"))
    return load(spark, d, "orders").select(
        k.alias("run_id"), start.alias("started_at"),
        F.when(k % 9 != 0, start + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (k % 600).cast("decimal(18,6)"))).alias("completed_at"),
        F.when(k % 8 == 0, "failed").when(k % 9 == 0, "running").otherwise("succeeded").alias("status"),
        (k % 120).alias("records_read"), (k % 100).alias("records_written"))


SQL_RUNS = """
runs AS (SELECT o_orderkey AS run_id, o_orderdate + to_hours((o_orderkey % 24)::INT) + to_minutes((o_orderkey % 60)::INT) AS started_at,
   CASE WHEN o_orderkey % 9 <> 0 THEN o_orderdate + to_hours((o_orderkey % 24)::INT) + to_minutes((o_orderkey % 60)::INT) + to_seconds((o_orderkey % 600)::DOUBLE) END AS completed_at,
   CASE WHEN o_orderkey % 8 = 0 THEN 'failed' WHEN o_orderkey % 9 = 0 THEN 'running' ELSE 'succeeded' END AS status,
   o_orderkey % 120 AS records_read, o_orderkey % 100 AS records_written FROM orders)"""
