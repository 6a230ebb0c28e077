"""Reporting queries: each is a function of tables and ``now``; per-asset loops become one grouped plan.

The asset dimension drives every report through left joins, so assets without data stay visible.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import maths
from tidemark.functions.times import micros
from tidemark.operators import bars as B
from tidemark.operators import gates as G
from tidemark.operators import relations as R
from tidemark.operators.quantiles import nearest_rank, order_statistics


def minutes(later: Column, earlier: Column) -> Column:
    return (micros(later) - micros(earlier)) / 60e6


def select_assets(assets: DataFrame) -> DataFrame:
    return assets.where(F.col("is_active") | F.col("is_shadow_enabled")).orderBy("asset_class", "symbol")


def search_assets(assets: DataFrame, asset_class: str | None, state: str | None, term: str) -> DataFrame:
    """Class, activity state and substring search, all optional."""
    out = assets
    if asset_class:
        out = out.where(F.col("asset_class") == asset_class)
    if state:
        out = out.where(F.col("is_active") if state == "active" else ~F.col("is_active"))
    return out.where(F.contains(F.upper("symbol"), F.lit(term.strip().upper()))) if term.strip() else out


def latest_times(bars: DataFrame, key: str = "symbol") -> DataFrame:
    return bars.groupBy(key).agg(F.max(F.when(F.col("is_final"), F.col("close_time"))).alias("latest_close"),
                                 F.max("ingested_at").alias("last_ingested"))


def latest_news_times(news: DataFrame, key: str = "symbol") -> DataFrame:
    return news.groupBy(key).agg(F.max("published_at").alias("latest_published"), F.max("retrieved_at").alias("last_retrieved"))


def freshness_report(assets: DataFrame, bars: DataFrame, news: DataFrame, now: Column) -> DataFrame:
    """(dataset, symbol, data_time, ingested_at, state) for every active asset."""
    active = assets.where("is_active").select("symbol")
    prices = active.join(latest_times(bars), "symbol", "left").select(
        F.lit("price_bars").alias("dataset"), "symbol", F.col("latest_close").alias("data_time"), F.col("last_ingested").alias("ingested_at"),
        maths.freshness(F.col("latest_close"), now, "2 HOUR").alias("state"))
    articles = active.join(latest_news_times(news), "symbol", "left").select(
        F.lit("news_shadow").alias("dataset"), "symbol", F.col("latest_published").alias("data_time"), F.col("last_retrieved").alias("ingested_at"),
        maths.freshness(F.col("last_retrieved"), now, "2 HOUR").alias("state"))
    return prices.unionByName(articles)


def asset_list(assets: DataFrame, bars: DataFrame, now: Column, allowed: str = "2 HOUR") -> DataFrame:
    latest = B.latest_bar(bars, "symbol", ("close", "close_time"))
    return select_assets(assets).join(latest, "symbol", "left").select(
        "symbol", "asset_class", F.col("close").alias("latest_price"), F.col("close_time").alias("price_time"),
        maths.freshness(F.col("close_time"), now, allowed).alias("freshness"))


def recent_runs(runs: DataFrame, k: int = 10) -> DataFrame:
    seconds = (micros(F.col("completed_at")) - micros(F.col("started_at"))) / 1e6
    return runs.orderBy(F.desc("started_at"), F.desc("run_id")).limit(k).withColumn("duration_seconds", seconds)


def success_rate(runs: DataFrame, now: Column, days: int = 7) -> DataFrame:
    recent = runs.where(F.col("started_at") >= now - F.expr(f"INTERVAL {days} DAY"))
    return recent.agg(F.count(F.lit(1)).alias("runs"), F.avg((F.col("status") == "succeeded").cast("double")).alias("success_rate"))


def latency_stats(snaps: DataFrame, cutoff: Column, limit_minutes: float = 45) -> DataFrame:
    """On-time share, mean and nearest-rank p95 of availability delay over the last seven cutoffs."""
    rows = snaps.where(F.col("is_complete") & (F.col("snapshot_time") >= cutoff - F.expr("INTERVAL 6 DAY")) & (F.col("snapshot_time") <= cutoff))
    rows = rows.select(minutes(F.col("available_at"), F.col("snapshot_time")).alias("latency")).where("latency >= 0")
    base = rows.agg(F.count(F.lit(1)).alias("snapshots"), F.avg((F.col("latency") <= limit_minutes).cast("double")).alias("on_time_share"),
                    F.avg("latency").alias("mean_latency"))
    p95 = order_statistics(rows, [], "latency", {"p95_latency": nearest_rank(0.95)})
    return base.withColumn("p95_latency", p95.scalar())


def collector_assets(assets: DataFrame, snaps: DataFrame, cutoff: Column, required: int = 90) -> DataFrame:
    """Per asset: newest snapshot, streak of days, readiness and state missing / stale / ready / warming."""
    done = snaps.where(F.col("is_complete") & (F.col("snapshot_time") >= cutoff - F.expr(f"INTERVAL {required + 7} DAY")))
    last = done.groupBy("asset_id").agg(F.max("snapshot_time").alias("latest_snapshot"), F.max_by("available_at", "snapshot_time").alias("available_at"))
    streak = B.trailing_streak(done, "asset_id", "snapshot_time").select("asset_id", F.col("days").alias("streak_days"))
    df = assets.select("asset_id").join(last, "asset_id", "left").join(streak, "asset_id", "left").fillna({"streak_days": 0})
    latest, days = F.col("latest_snapshot"), F.col("streak_days")
    state = (F.when(latest.isNull(), "missing").when(latest != cutoff, "stale").when(days >= required, "ready").otherwise("warming"))
    return df.withColumns({"state": state, "readiness": F.least(F.lit(1.0), days / F.lit(float(required))),
                           "latency_minutes": minutes(F.col("available_at"), latest)})


def collector_overall(rows: DataFrame, issues: DataFrame, cutoff: Column, code: str = "DERIVATIVE_CUTOFF_INCOMPLETE") -> DataFrame:
    """One row: counts and the ordered overall state."""
    open_issues = issues.where((F.col("code") == code) & ~F.col("is_resolved")).agg(F.count(F.lit(1))).scalar()
    agg = rows.agg(F.count(F.lit(1)).alias("assets"), F.count_if(F.col("latest_snapshot") == cutoff).alias("complete"),
                   F.count_if(F.col("state") == "ready").alias("ready")).withColumn("open_issues", open_issues)
    whole = F.col("complete") == F.col("assets")
    state = (F.when(F.col("open_issues") > 0, "degraded").when(whole & (F.col("ready") == F.col("assets")), "healthy")
             .when(whole, "warming").when((F.col("complete") == 0) & (F.col("ready") == 0), "no_data").otherwise("degraded"))
    return agg.withColumn("overall_state", state)


def asset_summary(bars: DataFrame, key: str = "asset_id", extra: tuple[str, ...] = ("ingested_at",)) -> DataFrame:
    return bars.groupBy(key).agg(F.count(F.lit(1)).alias("bar_count"), F.min("open_time").alias("first_bar"), F.max("open_time").alias("latest_bar"),
                                 *[F.max(c).alias(f"last_{c}") for c in extra])


def equity_assets(assets: DataFrame, bars: DataFrame, reference: str, required: int = 90) -> DataFrame:
    """Per asset: bar count readiness against the reference asset's newest session."""
    summary = asset_summary(bars, extra=())
    newest = summary.agg(F.coalesce(F.max(F.when(F.col("asset_id") == reference, F.col("latest_bar"))), F.max("latest_bar"))).scalar()
    df = assets.select("asset_id").join(summary, "asset_id", "left").fillna({"bar_count": 0}).withColumn("latest_session", newest)
    state = (F.when(F.col("latest_bar").isNull(), "missing").when(F.col("latest_bar") != F.col("latest_session"), "stale")
             .when(F.col("bar_count") >= required, "ready").otherwise("warming"))
    return df.withColumns({"state": state, "readiness": F.least(F.lit(1.0), F.col("bar_count") / F.lit(float(required)))})


def equity_overall(rows: DataFrame, issues: DataFrame, code: str = "US_EQUITY_SESSION_INCOMPLETE") -> DataFrame:
    open_issues = issues.where((F.col("code") == code) & ~F.col("is_resolved")).agg(F.count(F.lit(1))).scalar()
    agg = rows.agg(F.count(F.lit(1)).alias("assets"), F.count_if(F.col("state") == "ready").alias("ready"),
                   F.coalesce(F.sum("bar_count"), F.lit(0)).alias("bars"), F.min("first_bar").alias("first_bar"),
                   F.max("latest_session").alias("latest_session")).withColumn("open_issues", open_issues)
    state = (F.when(F.col("assets") == 0, "no_data").when(F.col("open_issues") > 0, "degraded").when(F.col("assets") == F.col("ready"), "healthy")
             .when(F.col("ready") == 0, "no_data").otherwise("warming"))
    return agg.withColumn("overall_state", state)


def shadow_progress(models: DataFrame, pred: DataFrame, totals: DataFrame, now: Column) -> DataFrame:
    """Per candidate model: days, matured predictions, coverage, state.

    Crypto matures by the calendar, equities by their own prediction sessions: a prediction is mature
    once more than ``horizon`` later sessions exist.  Sessions per model follow the calendar.
    """
    live = models.where(F.col("is_shadow_candidate") & ~F.col("is_production") & F.col("horizon_days").isin(30, 90))
    points = pred.where("is_shadow").join(live.select("model_id", "horizon_days"), "model_id")
    due = F.col("analysis_time") + F.make_dt_interval(F.col("horizon_days")) <= now
    daily = points.groupBy("model_id", "horizon_days", F.to_date("analysis_time").alias("_d")).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(due).alias("_due"), F.min("analysis_time").alias("_first"), F.max("analysis_time").alias("_last"))
    back = F.row_number().over(Window.partitionBy("model_id").orderBy(F.desc("_d")))
    agg = daily.withColumn("_back", back).groupBy("model_id").agg(
        F.min("_first").alias("started_at"), F.max("_last").alias("last_at"), F.count("_d").alias("prediction_days"),
        F.sum("_n").alias("prediction_count"), F.sum("_due").alias("_calendar"),
        F.sum(F.when(F.col("_back") > F.col("horizon_days"), F.col("_n")).otherwise(0)).alias("_sessions"))
    assets_seen = points.groupBy("model_id").agg(F.count_distinct("symbol").alias("assets_covered"))
    df = live.join(agg, "model_id", "left").join(assets_seen, "model_id", "left").join(totals, "asset_class", "left")
    df = df.fillna(0, ["prediction_days", "prediction_count", "_calendar", "_sessions", "assets_covered", "total_assets"])
    equity = F.col("asset_class") == "us_equity"
    elapsed_calendar = F.coalesce(F.floor((micros(now) - micros(F.col("started_at"))) / 86_400_000_000), F.lit(0))
    raw = F.when(equity, F.col("prediction_days") - 1).otherwise(elapsed_calendar)
    elapsed = F.least(F.greatest(raw, F.lit(0)), F.col("horizon_days"))
    expected = F.col("total_assets") * F.col("prediction_days")
    matured = F.when(equity, F.col("_sessions")).otherwise(F.col("_calendar"))
    df = df.withColumns({
        "matured": matured, "elapsed_days": elapsed.cast("long"),
        "coverage": F.when(expected == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.col("prediction_count") / expected)),
        "unit": F.when(equity, "trading_sessions").otherwise("calendar_days"),
        "first_evaluation_at": F.when(~equity, F.col("started_at") + F.make_dt_interval(F.col("horizon_days")))})
    state = F.when(F.col("prediction_count") == 0, "waiting").when(F.col("matured") > 0, "evaluable").otherwise("collecting")
    return df.withColumns({"state": state, "remaining_days": F.greatest(F.lit(0), F.col("horizon_days") - F.col("elapsed_days"))}).select(
        "model_id", "version", "asset_class", "unit", "horizon_days", "started_at", "last_at", "first_evaluation_at", "elapsed_days",
        "remaining_days", "prediction_days", "prediction_count", "matured", "assets_covered", "total_assets", "coverage", "state")


def shadow_overall(progress: DataFrame) -> DataFrame:
    agg = progress.agg(F.count(F.lit(1)).alias("models"), F.coalesce(F.sum("prediction_count"), F.lit(0)).alias("predictions"),
                       F.coalesce(F.sum("matured"), F.lit(0)).alias("matured"), F.count_if(F.col("state") == "waiting").alias("_w"),
                       F.count_if(F.col("state") == "evaluable").alias("_e"))
    state = (F.when(F.col("models") == 0, "no_candidate").when(F.col("_w") == F.col("models"), "waiting")
             .when(F.col("_e") > 0, "evaluable").otherwise("collecting"))
    return agg.withColumn("state", state).drop("_w", "_e")


def analysis_report(joined: DataFrame, bars: DataFrame, news: DataFrame, now: Column, factors: DataFrame) -> DataFrame:
    """Newest analysis per (asset, horizon) with price freshness, the newest article time, its factors and limitations.

    ``factors`` has the lists positive and negative by prediction_id; an analysis without any has empty ones.
    """
    latest = R.latest_analysis(joined, ("symbol", "horizon_days"))
    df = latest.join(latest_times(bars).select("symbol", "latest_close"), "symbol", "left").join(
        latest_news_times(news).select("symbol", "latest_published"), "symbol", "left").join(factors.select("prediction_id", "positive", "negative"), "prediction_id", "left")
    none = F.array().cast("array<string>")
    limits = G.limitations(F.col("direction_eligible"), F.col("scenario_eligible"), F.col("asset_class") == "us_equity")
    return df.withColumns({
        "freshness": maths.freshness(F.col("latest_close"), now, "26 HOUR"), "risk_level": maths.risk_level(F.col("risk_score")),
        "positive": F.coalesce("positive", none), "negative": F.coalesce("negative", none), "limitations": limits})


def model_card(models: DataFrame, version: str | None = None) -> DataFrame:
    out = models if version is None else models.where(F.col("version") == version)
    return out.withColumn("metric_names", F.array_sort(F.map_keys("metrics")))


def metric(name: str) -> Column:
    """A stored metric, NaN where the map lacks it."""
    return F.coalesce(F.try_element_at("metrics", F.lit(name)), F.lit(float("nan")))


def performance_report(models: DataFrame, asset_class: str = "crypto") -> DataFrame:
    """Newest production model per horizon with its headline metrics."""
    w = Window.partitionBy("horizon_days").orderBy(F.desc("trained_at"), F.desc("version"))
    prod = models.where((F.col("asset_class") == asset_class) & F.col("is_production")).withColumn("_rn", F.row_number().over(w)).where("_rn = 1")
    return prod.select("horizon_days", "version", "trained_at", metric("brier_score").alias("brier_score"),
                       metric("baseline_brier_score").alias("baseline_brier_score"), metric("sample_count").cast("long").alias("sample_count"))


def news_latest(news: DataFrame, n: int, key: str = "symbol") -> DataFrame:
    """Newest n news rows per key."""
    if n < 1:
        raise ValueError("n must be at least 1")
    w = Window.partitionBy(key).orderBy(F.desc("published_at"), F.desc("doc_id"))
    return news.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)


def ui_means(progress: DataFrame, assets: DataFrame) -> DataFrame:
    """Mean coverage of the models and asset counts per class flag, one row."""
    cover = progress.agg(F.avg("coverage")).scalar()
    return assets.agg(F.count_if(F.col("is_active")).alias("active_assets"), F.count_if(F.col("is_shadow_enabled")).alias("shadow_assets"),
                      F.count(F.lit(1)).alias("assets")).withColumn("mean_coverage", cover)
