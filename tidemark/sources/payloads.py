"""JSON payloads of the live feeds, parsed with declared schemas on the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.times import norm_epoch, parse_seen_date

def parse_stream_bars(df: DataFrame, column: str = "value", now: Column | None = None) -> DataFrame:
    """Closed candles of kline stream messages; open candles are dropped.  Works on batches and streams."""
    # Keys differ only by case (t/T, v/V), so the message is read as maps of the nested object.
    outer = F.from_json(F.col(column).cast("string"), "data struct<s: string, k: map<string, string>>")
    k = F.col("_m.data.k")
    msg = df.withColumn("_m", outer).where(k["x"] == "true")
    num = lambda name: k[name].cast("decimal(36,12)")
    return msg.select(
        F.col("_m.data.s").alias("asset_id"), norm_epoch(k["t"]).alias("open_time"), norm_epoch(k["T"]).alias("close_time"), k["i"].alias("interval"),
        *[num(a).cast("decimal(28,10)").alias(b) for a, b in (("o", "open"), ("h", "high"), ("l", "low"), ("c", "close"))],
        num("v").alias("volume"), num("q").alias("quote_volume"), k["n"].cast("long").alias("trade_count"),
        num("V").alias("taker_buy_base_volume"), num("Q").alias("taker_buy_quote_volume"), F.lit(True).alias("is_final"),
        (now if now is not None else F.current_timestamp()).alias("available_at"))


def parse_kline_json(df: DataFrame, available_at: Column, column: str = "value") -> DataFrame:
    """Array of positional kline arrays; a bar is final when it closed by the time it was received."""
    rows = df.withColumn("_c", F.explode(F.from_json(column, "array<array<string>>")))
    cell = lambda i: F.get("_c", F.lit(i))
    names = (("open", 1), ("high", 2), ("low", 3), ("close", 4), ("volume", 5), ("quote_volume", 7), ("taker_buy_base_volume", 9), ("taker_buy_quote_volume", 10))
    close = norm_epoch(cell(6))
    keep = [c for c in df.columns if c != column]
    return rows.select(*keep, norm_epoch(cell(0)).alias("open_time"), close.alias("close_time"),
                       *[cell(i).cast("double").alias(n) for n, i in names], cell(8).cast("long").alias("trade_count"),
                       (close <= available_at).alias("is_final"), available_at.alias("available_at"))


def parse_eod_json(df: DataFrame, column: str = "value", adjustment: str = "all") -> DataFrame:
    """One end-of-day bar per row: the session is the UTC date, its volume may be missing."""
    bar = F.from_json(column, "datetime string, open string, high string, low string, close string, volume string")
    rows = df.withColumn("_b", bar)
    # Spark keeps microseconds, so the session closes one microsecond before the next midnight.
    start = F.to_date(F.substring("_b.datetime", 1, 10)).cast("timestamp_ntz")
    volume, close = F.coalesce(F.col("_b.volume").cast("double"), F.lit(0.0)), F.col("_b.close").cast("double")
    return rows.select(
        F.upper("symbol").alias("asset_id"), start.alias("open_time"), (start + F.expr("INTERVAL '0 23:59:59.999999' DAY TO SECOND")).alias("close_time"),
        F.lit("1d").alias("interval"), *[F.col(f"_b.{c}").cast("double").alias(c) for c in ("open", "high", "low", "close")],
        volume.alias("volume"), (volume * close).alias("quote_volume"), F.lit(0).cast("long").alias("trade_count"), F.lit(True).alias("is_final"),
        F.sha2(F.concat_ws("|", "symbol", F.lit(adjustment), column), 256).alias("source_checksum"))


def parse_timed_values(df: DataFrame, time: str, value: str, column: str = "value") -> DataFrame:
    """[{time, value}] arrays; either field may be a number or text."""
    rows = df.withColumn("_o", F.explode(F.from_json(column, "array<map<string, string>>")))
    keep = [c for c in df.columns if c != column]
    return rows.select(*keep, norm_epoch(F.col("_o")[time]).alias("time"), F.col("_o")[value].cast("double").alias("value"))


def valid_url(url: Column) -> Column:
    return F.try_parse_url(url, F.lit("HOST")).isNotNull() & url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^\s/]+")


# Letters whose full upper case is longer than one letter stay as they are.
UNCHANGED = "ßŉǰﬀﬁﬂﬃﬄﬅﬆ"
PRIVATE = "".join(chr(0xE000 + i) for i in range(len(UNCHANGED)))


def strip_space(text: Column) -> Column:
    """Trim every kind of white space, line breaks included."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def upper_simple(text: Column) -> Column:
    """Letter-by-letter upper case."""
    return F.translate(F.upper(F.translate(text, UNCHANGED, PRIVATE)), PRIVATE, UNCHANGED)


def content_hash(title: Column, url: Column) -> Column:
    return F.sha2(F.concat(upper_simple(strip_space(title)), F.lit("|"), url), 256)


def parse_news(df: DataFrame, now: Column, column: str = "value") -> DataFrame:
    """Article lists to rows; blank titles and invalid addresses are skipped."""
    schema = "articles array<struct<title: string, url: string, seendate: string, language: string, domain: string>>"
    keep = [c for c in df.columns if c != column]
    rows = df.select(*keep, F.explode(F.from_json(column, schema)["articles"]).alias("_a")).select(*keep, "_a.*")
    rows = rows.where((strip_space(F.col("title")) != "") & valid_url(F.col("url")))
    return rows.select(
        *keep, strip_space(F.col("title")).alias("title"), F.coalesce("domain", F.try_parse_url("url", F.lit("HOST"))).alias("source_name"), F.col("url").alias("source_url"),
        parse_seen_date(F.col("seendate"), now).alias("published_at"), F.coalesce("language", F.lit("unknown")).alias("language"),
        content_hash(F.col("title"), F.col("url")).alias("content_hash"))


def fresh_news(articles: DataFrame, stored: DataFrame, key: str = "asset_id") -> DataFrame:
    """Articles of this delivery that are not stored yet, one per (asset, content hash)."""
    return articles.dropDuplicates([key, "content_hash"]).join(stored.select(key, "content_hash"), [key, "content_hash"], "left_anti")
