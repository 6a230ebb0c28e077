"""Streams over the provided tables, and the file and payload readers over data Spark derives from them."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from tidemark.operators import bars as B
from tidemark.operators import relations as R
from tidemark.session import scratch, stage
from tidemark.sources import archives as A
from tidemark.sources import payloads as PL
from tidemark.sources import sinks as S
from tidemark.sources import snapshots as SN
from tidemark.sources import tables as TB
from tidemark.streaming import state as SS
from tidemark.streaming import streams as ST
from tidemark.workbench import tables as t
from tidemark.workbench.registry import big, query, r, rexp

# --- streams -------------------------------------------------------------------------------------


def stream_of(spark, d, name):
    """The table's file, or all files of its folder; a pattern matches both where a plain path has to be a folder."""
    schema = t.load(spark, d, name).schema
    return spark.readStream.schema(schema).parquet(f"{d}/{name}.[p]arquet")


def ticks(spark, d):
    return stream_of(spark, d, "events").withColumnRenamed("event_type", "asset_id")


def appended(stream, spark):
    path = scratch(spark, "stream")
    ST.start(stream, path).awaitTermination()
    return spark.read.parquet(f"{path}/data")


def message(df):
    """A kline stream message per event; every third candle is closed."""
    ms = (F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long")
    v = F.col("value").cast("string")
    k = F.struct(ms.alias("t"), (ms + 59_999).alias("T"), F.lit("1m").alias("i"), v.alias("o"), v.alias("h"), v.alias("l"), v.alias("c"),
                 (F.col("user_id") + 1).cast("string").alias("v"), F.lit("2.5").alias("q"), F.col("event_id").alias("n"), F.lit("0.5").alias("V"), F.lit("1.5").alias("Q"),
                 (F.col("user_id") % 3 == 0).alias("x"))
    return df.select(F.to_json(F.struct(F.struct(F.col("asset_id").alias("s"), k.alias("k")).alias("data"))).alias("value"))


SQL_MSG = f"""SELECT event_type AS asset_id, date_trunc('milliseconds', ts) AS open_time, date_trunc('milliseconds', ts) + INTERVAL '59.999 seconds' AS close_time, {rexp('value', 'close')}, {rexp('CAST(user_id + 1 AS DOUBLE)', 'volume')},
 {rexp('0.5::DOUBLE', 'taker_buy_base_volume')}, event_id AS trade_count FROM events WHERE user_id % 3 = 0"""
MSG_COLS = ("asset_id", "open_time", "close_time", "close", "volume", "taker_buy_base_volume", "trade_count")


@query("st_final_bars", SQL_MSG)
def st_final_bars(spark, d):
    with_keys = spark.conf.get("spark.sql.caseSensitive")
    spark.conf.set("spark.sql.caseSensitive", "true")  # message keys differ by case only
    try:
        return appended(ST.final_bars(message(ticks(spark, d))), spark).select(*MSG_COLS)
    finally:
        spark.conf.set("spark.sql.caseSensitive", with_keys)


@query("src_live_bars", SQL_MSG)
def src_live_bars(spark, d):
    v = F.col("value").cast("string")
    ms = (F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long").cast("string")
    pairs = {"t": ms, "T": ((F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long") + 59_999).cast("string"), "i": F.lit("1m"), "o": v, "h": v, "l": v, "c": v,
             "v": (F.col("user_id") + 1).cast("string"), "q": F.lit("2.5"), "n": F.col("event_id").cast("string"), "V": F.lit("0.5"), "Q": F.lit("1.5"), "x": (F.col("user_id") % 3 == 0).cast("string")}
    k = F.create_map(*[x for a, b in pairs.items() for x in (F.lit(a), b)])
    msgs = t.events(spark, d).select(F.to_json(F.struct(F.struct(F.col("event_type").alias("s"), k.alias("k")).alias("data"))).alias("value"))
    return PL.parse_stream_bars(msgs).select(*MSG_COLS)


def deliveries(df):
    return df.select("asset_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("open_time"), F.lit("1h").alias("interval"), F.lit("feed").alias("source"),
                     F.col("value").alias("close"), (F.col("user_id") % 3 == 0).alias("is_final"), F.col("event_id").alias("ingest_seq"))


@query("st_upsert", f"SELECT event_type AS asset_id, date_trunc('hour', ts) AS open_time, {rexp('value', 'close')}, user_id % 3 = 0 AS is_final FROM events QUALIFY row_number() OVER (PARTITION BY event_type, date_trunc('hour', ts) ORDER BY user_id % 3 = 0 DESC, event_id DESC) = 1")
def st_upsert(spark, d):
    path = scratch(spark, "stream")
    table = SN.SnapshotTable(spark, f"{path}/bars", B.BAR_KEY, ["asset_id", "date_trunc('month', open_time)"])
    ST.snapshot_sink(deliveries(ticks(spark, d)), path, table).awaitTermination()
    return table.read().select("asset_id", "open_time", "close", "is_final")


@query("st_dedupe", "SELECT DISTINCT event_type AS asset_id, user_id FROM events")
def st_dedupe(spark, d):
    return appended(ST.dedupe(ticks(spark, d), ["asset_id", "user_id"], "ts", "40 days"), spark).select("asset_id", "user_id")


@query("st_tumbling_ohlc", f"""SELECT event_type AS asset_id, date_trunc('day', ts) AS open_time, date_trunc('day', ts) + INTERVAL 1 DAY AS known_at, {rexp('arg_min(value, event_id)', 'open')}, {rexp('max(value)', 'high')}, {rexp('min(value)', 'low')}, {rexp('arg_max(value, event_id)', 'close')}, {big('count(*)', 'trades')}
 FROM events GROUP BY 1, 2, 3 HAVING date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 45 MINUTE""")
def st_tumbling_ohlc(spark, d):
    return appended(ST.tumbling_ohlc(ticks(spark, d), "1 day", "45 minutes"), spark)


@query("st_sliding_24h", f"""WITH w AS (SELECT event_type AS asset_id, date_trunc('hour', ts) + to_hours(i::INT + 1) AS window_end, ts, event_id, value FROM events, range(0, 24) g(i)),
a AS (SELECT asset_id, window_end, count(*) AS n, arg_max(value, event_id) AS latest, arg_min(value, event_id) AS f FROM w GROUP BY 1, 2)
SELECT asset_id, window_end, {big('n')}, {r('latest')}, {rexp('CASE WHEN n >= 24 AND f <> 0 THEN (latest / f - 1) * 100 END', 'change')} FROM a WHERE window_end <= (SELECT max(ts) FROM events) - INTERVAL 45 MINUTE""")
def st_sliding_24h(spark, d):
    return appended(ST.sliding_change(ticks(spark, d), "45 minutes"), spark)


LATE = "date_trunc('day', ts) + INTERVAL 1 DAY + INTERVAL 45 MINUTE"
SQL_ARR = "ar AS (SELECT event_id, event_type AS asset_id, ts, ts + to_minutes((user_id % 50)::INT * 10) AS arrived_at FROM events)"


@query("st_cutoff_watermark", f"WITH {SQL_ARR} SELECT event_id, asset_id, CASE WHEN arrived_at > {LATE} THEN 'issue' ELSE 'kept' END AS route FROM ar")
def st_cutoff_watermark(spark, d):
    path = scratch(spark, "stream")
    s = ticks(spark, d).withColumn("arrived_at", F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), (F.col("user_id") % 50 * 10).cast("int")))
    ST.cutoff_collect(s.select("event_id", "asset_id", "ts", "arrived_at"), path).awaitTermination()
    kept = spark.read.parquet(f"{path}/kept").select("event_id", "asset_id", F.lit("kept").alias("route"))
    return kept.unionByName(spark.read.parquet(f"{path}/issues").select("event_id", "asset_id", F.lit("issue").alias("route")))


GRID_POINTS = big("count(DISTINCT date_trunc('hour', ts))", "points")


@query("st_grid_complete", f"""SELECT event_type AS asset_id, date_trunc('day', ts) AS day, {GRID_POINTS} FROM events GROUP BY 1, 2
 HAVING count(DISTINCT date_trunc('hour', ts)) = 24 AND date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(date_trunc('hour', ts)) FROM events) - INTERVAL 45 MINUTE""")
def st_grid_complete(spark, d):
    return appended(ST.complete_grids(ticks(spark, d), 24, "45 minutes", "ts"), spark)


SQL_ABSENT = f"""WITH ro AS (SELECT DISTINCT event_type AS asset_id FROM events UNION SELECT DISTINCT p_type FROM part), lim AS (SELECT CAST(min(ts) AS DATE) AS a, max(ts) - INTERVAL 45 MINUTE AS b FROM events),
dy AS (SELECT CAST(unnest(range(a, CAST(b AS DATE), INTERVAL 1 DAY)) AS DATE) AS day FROM lim), seen AS (SELECT event_type AS asset_id, CAST(ts AS DATE) AS day, {big('count(DISTINCT date_trunc(' + "'hour'" + ', ts))', 'points')} FROM events GROUP BY 1, 2)
SELECT asset_id, day, {big('coalesce(points, 0)', 'points')}, 'DERIVATIVE_CUTOFF_INCOMPLETE' AS code FROM ro CROSS JOIN dy LEFT JOIN seen USING (asset_id, day) WHERE coalesce(points, 0) < 24"""


@query("st_cutoff_absent", SQL_ABSENT)
def st_cutoff_absent(spark, d):
    ids = t.events(spark, d).select(F.col("event_type").alias("asset_id")).unionByName(t.part_assets(spark, d).select("asset_id")).distinct()
    first = t.events(spark, d).agg(F.to_date(F.min("ts"))).scalar()
    path = scratch(spark, "stream")
    roster = stage(ids.withColumn("first_day", first))
    ST.start(SS.incomplete_grids(ticks(spark, d), roster, 24), path, timed=True).awaitTermination()
    return spark.read.parquet(f"{path}/data")


@query("st_latest_price", f"SELECT event_type AS asset_id, {rexp('arg_max(value, event_id)', 'price')}, max(ts) AS price_time FROM events GROUP BY 1")
def st_latest_price(spark, d):
    path = scratch(spark, "stream")
    table = SN.SnapshotTable(spark, f"{path}/latest", ["asset_id"], ["asset_id"], 16)
    ST.snapshot_sink(ST.latest_price(ticks(spark, d)), path, table, None, (), mode="update").awaitTermination()
    return table.read()


@query("st_streak_state", """WITH dd AS (SELECT DISTINCT o_custkey % 50 AS cust, CAST(o_orderdate AS DATE) AS d FROM orders), isl AS (SELECT cust, d, d - CAST(row_number() OVER (PARTITION BY cust ORDER BY d) AS INT) AS g FROM dd)
SELECT cust, max(d) AS last_day, CAST(count(*) AS BIGINT) AS days FROM isl GROUP BY cust, g QUALIFY row_number() OVER (PARTITION BY cust ORDER BY max(d) DESC) = 1""")
def st_streak_state(spark, d):
    path = scratch(spark, "stream")
    s = stream_of(spark, d, "orders").withColumn("cust", F.col("o_custkey") % 50)
    ST.latest_sink(SS.streak(s, "o_orderdate", "cust"), path, timed=True).awaitTermination()
    return ST.latest_of(spark, path, ["cust"])


@query("st_asof_guard", f"WITH {SQL_ARR} SELECT event_id FROM ar WHERE arrived_at <= TIMESTAMP '2024-01-20' AND ts - INTERVAL 1 HOUR < date_trunc('day', ts)")
def st_asof_guard(spark, d):
    s = ticks(spark, d).select("event_id", (F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), (F.col("user_id") % 50 * 10).cast("int"))).alias("available_at"),
                               (F.col("ts") - F.expr("INTERVAL 1 HOUR")).alias("source_max_event_time"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("snapshot_time"))
    return appended(ST.asof_guard(s, t.ts("2024-01-20")), spark).select("event_id")


@query("st_news_dedupe", "SELECT DISTINCT 'NATION_' || (doc_id % 25) AS symbol, sha256(replace(upper(replace(regexp_replace(text, '^[[:space:]]+|[[:space:]]+$', '', 'g'), 'ß', chr(57344))), chr(57344), 'ß') || '|' || 'https://news.example/' || (doc_id % 50)) AS content_hash FROM documents WHERE regexp_replace(text, '^[[:space:]]+|[[:space:]]+$', '', 'g') <> ''")
def st_news_dedupe(spark, d):
    i = F.col("doc_id")
    s = stream_of(spark, d, "documents").select(F.col("text").alias("title"), F.concat(F.lit("https://news.example/"), (i % 50).cast("string")).alias("url"), F.concat(F.lit("NATION_"), (i % 25).cast("string")).alias("symbol"),
                                                (t.ts("2001-01-01") + F.make_dt_interval((i % 200).cast("int"))).alias("published_at"))
    return appended(ST.news_dedupe(s, "400 days"), spark).select("symbol", "content_hash")


@query("st_prediction_once", "SELECT DISTINCT o_custkey, o_orderdate FROM orders")
def st_prediction_once(spark, d):
    path = scratch(spark, "stream")
    s = stream_of(spark, d, "orders").select("o_custkey", "o_orderdate")
    ST.append_once(s, path, ["o_custkey", "o_orderdate"]).awaitTermination()
    # The checkpoint is lost: a new run sees the same input again and must neither add nor replace anything.
    folder, fs = ST._folder(spark, f"{path}/_checkpoint")
    fs.delete(folder, True)
    ST.append_once(s, path, ["o_custkey", "o_orderdate"], day="o_orderdate").awaitTermination()
    return spark.read.parquet(f"{path}/rows").select("o_custkey", "o_orderdate")


SQL_AUDIT = f"SELECT 'feed' AS source, 'ticks' AS dataset, 'succeeded' AS status, {big('count(*)', 'records_read')}, {big('count(*) FILTER (WHERE value > 1)', 'records_written')} FROM events"


@query("st_audit", SQL_AUDIT)
def st_audit(spark, d):
    path = scratch(spark, "stream")
    ST.audited(ticks(spark, d), path, "feed", "ticks", F.col("value") > 1).awaitTermination()
    return spark.read.parquet(f"{path}/runs").where("records_read > 0").select("source", "dataset", "status", "records_read", "records_written")


@query("sink_audit_run", SQL_AUDIT)
def sink_audit_run(spark, d):
    run = S.audited_write(t.events(spark, d), scratch(spark, "audit"), F.col("value") > 1, "1", "feed", "ticks", F.current_timestamp())
    return run.select("source", "dataset", "status", "records_read", "records_written")


# --- readers over derived files ------------------------------------------------------------------

def kline_lines(df):
    """A kline CSV line per event."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    ms = F.floor(us / 1000)
    # Half of the rows use microsecond epochs.
    start = F.when(F.col("event_id") % 2 == 0, ms).otherwise(us)
    v = F.col("value").cast("string")
    cells = [start, v, v, v, v, (F.col("user_id") + 1), ms + 59_999, F.lit("2.5"), F.col("event_id"), F.lit("0.5"), F.lit("1.5"), F.lit(0)]
    return F.concat_ws(",", *[c.cast("string") for c in cells])


KLINE_HEADER = "open_time,open,high,low,close,volume,close_time,quote_volume,count,taker_buy_volume,taker_buy_quote_volume,ignore"
SQL_KLINE = SQL_MSG.replace(" WHERE user_id % 3 = 0", "")


def lines_at(spark, d, name, line, header=None):
    """Write one line per event below asset-named folders and read the files back as text."""
    path = scratch(spark, "files")
    e = t.events(spark, d).select(F.concat(F.col("event_type"), F.lit(f"-{name}-2024-01.csv")).alias("file"), line(t.events(spark, d)).alias("value") if callable(line) else line.alias("value"))
    if header:
        # The header travels as the first line of every partition file.
        heads = e.select("file").distinct().withColumn("value", F.lit(header))
        e = e.unionByName(heads)
    e.write.partitionBy("file").text(path)
    rows = A.text_lines(spark, path)
    return rows.withColumn("path", F.regexp_extract("path", r"file=([^/]+)/", 1))


@query("src_futures_kline", SQL_KLINE)
def src_futures_kline(spark, d):
    lines = lines_at(spark, d, "1h", kline_lines(None), KLINE_HEADER)
    return A.read_futures_klines(lines, "klines").select(*MSG_COLS)


def _zip_lines(key, pdf):
    """One archive per (asset, page) with its lines in order."""
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("bars.csv", "\n".join(pdf.sort_values("event_id")["line"]) + "\n")
    return pd.DataFrame({"path": [f"{key[0]}-1h-2024-01-{key[1]}.zip"], "content": [buf.getvalue()]})


def archives(spark, d):
    """Archives of at most 500 lines per asset, built in tasks."""
    rows = t.events(spark, d).select(F.col("event_type").alias("asset"), F.floor(F.col("event_id") / 500).alias("page"), "event_id", kline_lines(None).alias("line"))
    return rows.groupBy("asset", "page").applyInPandas(_zip_lines, "path string, content binary")


@query("src_kline_archive", SQL_KLINE)
def src_kline_archive(spark, d):
    from tidemark.session import stage
    return A.read_kline_archives(stage(archives(spark, d))).select(*MSG_COLS)


@query("src_funding", f"SELECT event_type AS asset_id, date_trunc('milliseconds', ts) AS calc_time, {rexp('value', 'last_funding_rate')} FROM events")
def src_funding(spark, d):
    ms = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("string")
    lines = lines_at(spark, d, "fundingRate", F.concat_ws(",", ms, F.lit("8"), F.col("value").cast("string")), "calc_time,funding_interval_hours,last_funding_rate")
    return A.read_funding(A.with_header(lines, "calc_time,funding_interval_hours,last_funding_rate")).select("asset_id", "calc_time", "last_funding_rate")


MET_HEADER = "create_time,symbol,sum_open_interest,sum_open_interest_value,count_toptrader_long_short_ratio,sum_toptrader_long_short_ratio,count_long_short_ratio,sum_taker_long_short_vol_ratio"


@query("src_metrics", f"SELECT event_type AS asset_id, date_trunc('second', ts) AS create_time, {rexp('value * 2', 'sum_open_interest_value')}, {rexp('1.5::DOUBLE', 'count_long_short_ratio')}, {rexp('user_id::DOUBLE', 'sum_taker_long_short_vol_ratio')} FROM events")
def src_metrics(spark, d):
    u = F.col("user_id").cast("string")
    line = F.concat_ws(",", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.col("event_type"), F.lit("1"), (F.col("value") * 2).cast("string"), F.lit("1"), F.lit("1"), F.lit("1.5"), u)
    rows = A.read_metrics(A.with_header(lines_at(spark, d, "metrics", line, MET_HEADER), MET_HEADER))
    return rows.select("asset_id", "create_time", "sum_open_interest_value", "count_long_short_ratio", "sum_taker_long_short_vol_ratio")


@query("src_macro_csv", f"WITH {t.SQL_MACRO} SELECT '1-URGENT' AS series, observation_date, CASE WHEN day(observation_date) = 13 THEN NULL ELSE round(value, 6) + 0.0 END AS value FROM mlong WHERE series = '1-URGENT'")
def src_macro_csv(spark, d):
    path = scratch(spark, "files")
    m = t.macro_long(spark, d).where("series = '1-URGENT'")
    text = F.when(F.dayofmonth("observation_date") == 13, ".").otherwise(F.col("value").cast("string"))
    line = m.select(F.concat_ws(",", F.date_format("observation_date", "yyyy-MM-dd"), text).alias("value"))
    line.unionByName(spark.range(1).select(F.lit("observation_date,1-URGENT").alias("value"))).write.text(path)
    return A.read_macro(A.text_lines(spark, path), "1-URGENT")


@query("src_rest_kline_json", f"SELECT event_type AS symbol, date_trunc('milliseconds', ts) AS open_time, {rexp('value', 'close')}, event_id AS trade_count, date_trunc('milliseconds', ts) + INTERVAL '59.999 seconds' <= TIMESTAMP '2024-01-15' AS is_final FROM events")
def src_rest_kline_json(spark, d):
    ms = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000)
    v = F.col("value").cast("string")
    cells = [ms, v, v, v, v, F.lit("1"), ms + 59_999, F.lit("2"), F.col("event_id"), F.lit("3"), F.lit("4"), F.lit("0")]
    item = F.concat(F.lit("["), F.concat_ws(",", *[F.concat(F.lit('"'), c.cast("string"), F.lit('"')) for c in cells]), F.lit("]"))
    payload = t.events(spark, d).groupBy(F.col("event_type").alias("symbol"), F.floor(F.col("event_id") / 100).alias("page")).agg(
        F.concat(F.lit("["), F.array_join(F.collect_list(item), ","), F.lit("]")).alias("value"))
    out = PL.parse_kline_json(payload, F.lit("2024-01-15").cast("timestamp"))
    return out.select("symbol", "open_time", "close", "trade_count", "is_final")


@query("src_eod_json", f"WITH {t.SQL_BARS} SELECT upper(asset_id) AS asset_id, open_time, open_time + INTERVAL '86399.999999 seconds' AS close_time, {r('close')}, {rexp('CASE WHEN volume % 2 = 0 THEN volume ELSE 0 END', 'volume')}, {rexp('CASE WHEN volume % 2 = 0 THEN volume * close ELSE 0 END', 'quote_volume')} FROM bars")
def src_eod_json(spark, d):
    b = t.daily_bars(spark, d)
    text = lambda c: F.col(c).cast("string").alias(c)
    body = F.to_json(F.struct(F.date_format("open_time", "yyyy-MM-dd").alias("datetime"), *[text(c) for c in ("open", "high", "low", "close")],
                              F.when(F.col("volume") % 2 == 0, F.col("volume").cast("string")).alias("volume")))
    out = PL.parse_eod_json(b.select(F.lower("asset_id").alias("symbol"), body.alias("value")))
    return out.select("asset_id", "open_time", "close_time", "close", "volume", "quote_volume")


@query("src_objects_json", f"SELECT event_type AS symbol, date_trunc('milliseconds', ts) AS time, {r('value')} FROM events")
def src_objects_json(spark, d):
    ms = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000)
    item = F.to_json(F.struct(ms.alias("timestamp"), F.col("value").cast("string").alias("ratio")))
    payload = t.events(spark, d).groupBy(F.col("event_type").alias("symbol"), F.floor(F.col("event_id") / 100).alias("page")).agg(
        F.concat(F.lit("["), F.array_join(F.collect_list(item), ","), F.lit("]")).alias("value"))
    return PL.parse_timed_values(payload, "timestamp", "ratio").select("symbol", "time", "value")


@query("src_news_json", "SELECT lang AS asset_id, regexp_replace(text, '^[[:space:]]+|[[:space:]]+$', '', 'g') AS title, CASE WHEN doc_id % 3 = 0 THEN TIMESTAMP '2001-08-05 12:00:00' ELSE TIMESTAMP '2001-01-01' + to_days((doc_id % 200)::INT) END AS published_at, source AS source_name FROM documents WHERE regexp_replace(text, '^[[:space:]]+|[[:space:]]+$', '', 'g') <> '' AND doc_id % 7 <> 0")
def src_news_json(spark, d):
    i = F.col("doc_id")
    day = t.ts("2001-01-01") + F.make_dt_interval((i % 200).cast("int"))
    art = F.struct(F.col("text").alias("title"), F.when(i % 7 == 0, "not an address").otherwise(F.concat(F.lit("https://news.example/"), i.cast("string"))).alias("url"),
                   F.when(i % 3 == 0, "soon").when(i % 3 == 1, F.date_format(day, "yyyyMMdd'T'HHmmss'Z'")).otherwise(F.date_format(day, "yyyyMMddHHmmss")).alias("seendate"),
                   F.col("lang").alias("language"), F.col("source").alias("domain"))
    docs = t.load(spark, d, "documents").select(F.col("lang").alias("asset_id"), F.to_json(F.struct(F.array(art).alias("articles"))).alias("value"))
    return PL.parse_news(docs, F.lit(t.NOW).cast("timestamp")).select("asset_id", "title", "published_at", "source_name")


@query("src_bars_jdbc", f"WITH {t.SQL_HOURLY} SELECT asset_id, open_time, {r('close')} FROM hours WHERE is_final AND asset_id IN ('view', 'click')")
def src_bars_jdbc(spark, d):
    h = t.hourly_bars(spark, d)
    cls = h.select("asset_id").distinct().withColumns({"symbol": F.upper("asset_id"), "asset_class": F.when(F.col("asset_id").isin("view", "click"), "web").otherwise("other"), "is_shadow_enabled": F.lit(True)})
    return TB.scan_bars(h, cls, "web", "feed", "1h").select("asset_id", "open_time", "close")


@query("src_parquet_union", f"WITH {t.SQL_HOURLY} SELECT asset_id, open_time, {r('close')} FROM hours")
def src_parquet_union(spark, d):
    path = scratch(spark, "files")
    h = t.hourly_bars(spark, d).select("asset_id", "open_time", "close")
    h.write.parquet(f"{path}/part=1")
    h.write.parquet(f"{path}/part=2")
    return TB.load_bars(spark, path).select("asset_id", "open_time", "close")


@query("src_checksum", "WITH d AS (SELECT doc_id, sha256(text) AS s FROM documents) SELECT 'd' || doc_id AS file, CASE WHEN doc_id % 10 = 0 THEN 'bad' ELSE s END AS expected, s AS actual FROM d WHERE doc_id % 10 = 0")
def src_checksum(spark, d):
    docs = t.load(spark, d, "documents").select(F.concat(F.lit("/raw/d"), F.col("doc_id").cast("string")).alias("path"), F.encode("text", "UTF-8").alias("content"), "doc_id")
    manifest = docs.select(A.file_name(F.col("path")).alias("file"), F.when(F.col("doc_id") % 10 == 0, "bad  x.zip").otherwise(F.upper(F.sha2("content", 256))).alias("sha256"))
    return A.checksum_faults(docs.select("path", "content"), manifest)


@query("src_cached_pair", "SELECT 'p' || (o_custkey % 90) AS file, CAST(count(DISTINCT o_orderpriority) AS BIGINT) AS checksums, CAST(count(*) AS BIGINT) AS rows FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) <> 1 OR min(o_orderpriority) <> '5-LOW'")
def src_cached_pair(spark, d):
    o = t.load(spark, d, "orders").select(F.concat(F.lit("p"), (F.col("o_custkey") % 90).cast("string")).alias("file"), F.col("o_orderpriority").alias("source_checksum"))
    raw = o.select("file").distinct().withColumn("sha256", F.lit("5-LOW"))
    return A.lineage_faults(raw, o).select("file", "checksums", "rows")


@query("sink_parquet_zstd", f"WITH {t.SQL_BARS} SELECT asset_id, open_time, {r('close')}, 'tidemark-v1' AS dataset_version FROM bars")
def sink_parquet_zstd(spark, d):
    path = scratch(spark, "dataset")
    S.write_dataset(t.daily_bars(spark, d).select("asset_id", "open_time", "close"), path, "tidemark-v1", ["asset_id"])
    return spark.read.parquet(path).select("asset_id", "open_time", "close", "dataset_version")


@query("sink_report_json", f"SELECT event_type AS asset_id, {big('count(*)', 'n')}, {rexp('max(value)', 'top')} FROM events GROUP BY 1")
def sink_report_json(spark, d):
    path = scratch(spark, "report")
    rep = t.events(spark, d).groupBy(F.col("event_type").alias("asset_id")).agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("top"))
    S.write_report(rep, path)
    return spark.read.schema("asset_id string, n long, top double").json(path)


@query("news_stored", "SELECT DISTINCT lang AS asset_id, sha256(replace(upper(replace(regexp_replace(text, '^[[:space:]]+|[[:space:]]+$', '', 'g'), 'ß', chr(57344))), chr(57344), 'ß') || '|https://news.example/' || source) AS content_hash FROM documents WHERE regexp_replace(text, '^[[:space:]]+|[[:space:]]+$', '', 'g') <> '' EXCEPT SELECT lang, sha256(replace(upper(replace(regexp_replace(text, '^[[:space:]]+|[[:space:]]+$', '', 'g'), 'ß', chr(57344))), chr(57344), 'ß') || '|https://news.example/' || source) FROM documents WHERE n_chars > 1000")
def news_stored(spark, d):
    docs = t.load(spark, d, "documents").where(PL.strip_space(F.col("text")) != "")
    rows = docs.select(F.col("lang").alias("asset_id"), PL.content_hash(F.col("text"), F.concat(F.lit("https://news.example/"), F.col("source"))).alias("content_hash"), "n_chars")
    return PL.fresh_news(rows.select("asset_id", "content_hash"), rows.where("n_chars > 1000"))
