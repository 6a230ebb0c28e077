"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

HEADLINE = (
    "ohlc_daily", "latest_bar", "trailing_streak", "price_change_24", "join_asof_macro", "feat_volatility", "feat_macd",
    "feat_bench_corr", "xs_rank_avg", "feat_snapshot_equity", "label_direction", "split_walk_forward", "met_summary",
    "cal_temperature_fit", "cal_conformal_scaled", "agg_segment", "prior_select", "met_block_bootstrap", "dash_shadow",
    "sink_upsert_bars", "st_tumbling_ohlc",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from tidemark.session import clear_scratch, local_session
    from tidemark.workbench import QUERIES

    spark = local_session(cpus, "tidemark-bench", 8)
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["ohlc_daily"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm the JVM
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    clear_scratch(spark)
    spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir)}))


if __name__ == "__main__":
    main()
