"""Technical features over bars: one bounded row-frame window sort feeds every column.

Inputs are bars keyed by ``asset_id`` and ordered by ``open_time``; each (asset, open_time) is unique.
``prepare`` cuts the series into blocks with a halo that covers the longest registered frame and, to below double
rounding, the full-history EMA.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import maths
from tidemark.operators.blocks import BLOCK, block_window, blocked, owned

KEY = "asset_id"
TIME = "open_time"
LEAST_WEIGHT = 1e-17


def prepare(bars: DataFrame, keys: Sequence[str] = (KEY,), halo: int = 1) -> DataFrame:
    """Blocked bars with the one-step log return ``_r`` and price difference ``_d``."""
    df = blocked(bars, list(keys), [TIME], lookback=halo)
    w = block_window(keys)
    prev = F.lag("close", 1).over(w)
    return df.withColumns({"_prev": prev, "_r": F.ln(F.col("close") / prev), "_d": F.col("close") - prev})


def finish(df: DataFrame, drop: Sequence[str] = ()) -> DataFrame:
    return owned(df).drop("_prev", "_r", "_d", *drop)


def frame(n: int, end: int = 0, keys: Sequence[str] = (KEY,)):
    return block_window(keys).rowsBetween(end - n + 1, end)


def full(expr: Column, n: int) -> Column:
    """NULL until the series holds n values (positions are global, not per block)."""
    return F.when(F.col("_idx") >= n - 1, expr)


class Frames:
    """Feature expressions over shared frame statistics.

    Every (function, column, frame) is registered once under a name and evaluated once per row; the
    features refer to the names, so a mean used by three features costs one frame.
    """

    def __init__(self) -> None:
        self.stats: dict[str, Column] = {}
        self.halo = 1
        self.periods: set[int] = set()

    def stat(self, kind: str, col: str, n: int, end: int = 0) -> Column:
        self.halo = max(self.halo, n - end)  # the oldest row's own previous row included
        name = f"_s_{kind}_{col}_{n}_{-end}"
        if name not in self.stats:
            fn = {"avg": F.avg, "std": F.stddev_samp, "sum": F.sum}[kind]
            self.stats[name] = fn(col).over(frame(n, end))
        return F.col(name)

    def old(self, col: str, n: int) -> Column:
        self.halo = max(self.halo, n)
        name = f"_l_{col}_{n}"
        if name not in self.stats:
            self.stats[name] = F.lag(col, n).over(block_window((KEY,)))
        return F.col(name)

    def log_return(self, n: int) -> Column:
        return F.ln(F.col("close") / self.old("close", n))

    def volatility(self, n: int, ppy: int) -> Column:
        return full(self.stat("std", "_r", n), n + 1) * math.sqrt(ppy)

    def downside_volatility(self, n: int, ppy: int) -> Column:
        return F.coalesce(self.stat("std", "_neg", n), F.lit(0.0)) * math.sqrt(ppy)

    def rsi(self, n: int = 14, on: str = "_d") -> Column:
        """Simple-mean RSI in [0, 1]; no losses gives 1."""
        gain, loss = self.stat("sum", f"_up{on}", n) / n, self.stat("sum", f"_dn{on}", n) / n
        value = F.when(loss == 0, F.lit(100.0)).otherwise(100 - 100 / (1 + gain / loss))
        return full(value, n + 1) / 100

    def ema_weight(self, period: int) -> float:
        if period < 2:
            raise ValueError("an EMA needs a period of at least 2")
        self.periods.add(period)
        return 2.0 / (period + 1)

    def ema_full(self, period: int) -> Column:
        """EMA over the whole history (first value is the seed), exact to double rounding.

        The running sum starts at the block's halo, where a value's weight is below ``LEAST_WEIGHT``.
        """
        a = self.ema_weight(period)
        self.halo = max(self.halo, math.ceil(math.log(LEAST_WEIGHT) / math.log(1 - a)))
        name = f"_run_{period}"
        if name not in self.stats:
            run = block_window((KEY,)).rowsBetween(Window.unboundedPreceding, 0)
            self.stats[name] = F.sum(F.col(f"_xg{period}") * F.when(F.col("_pos") == 0, F.lit(1 / a)).otherwise(1.0)).over(run)
        return a * F.col(name) / F.col(f"_g{period}")

    def ema_trailing(self, period: int, seed: int = 120) -> Column:
        """EMA started from the first of the trailing ``seed`` rows, as one weighted frame sum.

        x_t-k has weight a(1-a)^k; the seed row keeps (1-a)^(seed-1).  Weights are anchored at the block
        start and all terms are positive.
        """
        a = self.ema_weight(period)
        keep = 1 - a
        scaled = self.stat("sum", f"_xg{period}", seed - 1)
        seeded = a * scaled / F.col(f"_g{period}") + keep ** (seed - 1) * self.old("close", seed - 1)
        return F.when(F.col("_idx") >= seed - 1, seeded).otherwise(self.ema_full(period))

    def macd(self, mode: str = "trailing", fast: int = 12, slow: int = 26, seed: int = 120) -> Column:
        ema = (lambda p: self.ema_trailing(p, seed)) if mode == "trailing" else self.ema_full
        return (ema(fast) - ema(slow)) / F.col("close")

    def atr(self, n: int = 14) -> Column:
        return full(self.stat("avg", "_tr", n) / F.col("close"), n + 1)

    def bollinger(self, n: int = 20) -> Column:
        return full(4 * self.stat("std", "close", n) / self.stat("avg", "close", n), n)

    def ma_ratio(self, n: int) -> Column:
        return full(F.col("close") / self.stat("avg", "close", n) - 1, n)

    def ma_slope(self, short: int, long: int) -> Column:
        return full(self.stat("avg", "close", short) / self.stat("avg", "close", long, -short) - 1, short + long)

    def zscore(self, col: str, n: int, zero_std: float | None = 0.0) -> Column:
        """Rolling z of the newest value; a flat window gives ``zero_std`` (or NULL)."""
        std = self.stat("std", col, n)
        z = (F.col(col) - self.stat("avg", col, n)) / std
        return full(F.when(std == 0, F.lit(zero_std)).otherwise(z), n)

    def taker_ratio(self, n: int = 7) -> Column:
        vol = self.stat("sum", "volume", n)
        share = self.stat("sum", "taker_buy_base_volume", n) / vol
        return full(F.when(vol == 0, F.lit(0.5)).otherwise(share), n)

    def overnight_gap(self) -> Column:
        return F.when(F.col("_prev") == 0, F.lit(0.0)).otherwise(F.ln(F.col("open") / F.col("_prev")))

    def intraday_return(self) -> Column:
        return F.when(F.col("open") == 0, F.lit(0.0)).otherwise(F.ln(F.col("close") / F.col("open")))


# --- whole-frame operators -----------------------------------------------------------------------


def with_growth(df: DataFrame, periods: Sequence[int], halo: int) -> DataFrame:
    """Per-row weights of the EMA sums and the weighted closes; they must stay inside a double over one block."""
    for p in periods:
        if (BLOCK + halo) * math.log((p + 1) / (p - 1)) > 600:
            raise ValueError(f"an EMA of period {p} overflows over a block with a halo of {halo} rows")
    df = df.withColumn("_pos", F.row_number().over(block_window((KEY,))) - 1)
    df = df.withColumns({f"_g{p}": F.pow(F.lit((p + 1) / (p - 1)), F.col("_pos")) for p in periods})
    return df.withColumns({f"_xg{p}": F.col("close") * F.col(f"_g{p}") for p in periods})


# Per-row inputs some statistics need; only those that are used get computed.
ROW_INPUTS = {
    "_neg": lambda: F.when(F.col("_r") < 0, F.col("_r")),
    "_up_d": lambda: F.greatest(F.col("_d"), F.lit(0.0)), "_dn_d": lambda: F.greatest(-F.col("_d"), F.lit(0.0)),
    "_up_r": lambda: F.greatest(F.col("_r"), F.lit(0.0)), "_dn_r": lambda: F.greatest(-F.col("_r"), F.lit(0.0)),
    "_tr": lambda: F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("_prev")),
                              F.abs(F.col("low") - F.col("_prev"))),
}


def compute(bars: DataFrame, build: Callable[[Frames], dict[str, Column]], extra: dict[str, Column] | None = None, halo: int = 1) -> DataFrame:
    """Blocked bars with the built features; ``halo`` is what ``extra`` needs beyond them.  Helper columns are dropped."""
    frames = Frames()
    columns = build(frames)
    halo = max(halo, frames.halo)
    df = prepare(bars, halo=halo)
    names = " ".join(frames.stats)
    inputs = {c: f() for c, f in ROW_INPUTS.items() if f"_{c}_" in names}
    periods = sorted(frames.periods)
    if periods:
        df = with_growth(df, periods, halo)
    out = df.withColumns(inputs).withColumns(frames.stats | (extra or {})).withColumns(columns)
    return out.drop(*inputs, *frames.stats, "_pos", *[f"_{k}{p}" for p in periods for k in ("g", "xg")])


def add_features(bars: DataFrame, build: Callable[[Frames], dict[str, Column]]) -> DataFrame:
    """Bars with the built features; halo rows are removed afterwards."""
    return finish(compute(bars, build))


CRYPTO_RETURNS = (1, 3, 7, 14, 30, 60, 90)
EQUITY_RETURNS = (1, 3, 5, 10, 20, 60, 120)


def crypto_spot_columns(s: Frames, trend_limit: float = 0.05, vol_limit: float = 0.65) -> dict[str, Column]:
    """Spot features that need no other asset."""
    ppy = 365
    cols = {f"return_{n}d": s.log_return(n) for n in CRYPTO_RETURNS}
    cols |= {f"volatility_{n}d": s.volatility(n, ppy) for n in (7, 30, 90)}
    cols |= {
        "rsi_14": s.rsi(14), "macd_normalized": s.macd("trailing"), "atr_14_normalized": s.atr(14),
        "bollinger_width_20": s.bollinger(20), "ma_slope_30d": s.ma_slope(7, 30),
        "volume_zscore_30d": s.zscore("volume", 30), "trade_count_zscore_30d": s.zscore("trade_count", 30),
        "taker_buy_ratio_7d": s.taker_ratio(7),
        "market_regime": maths.regime_code(s.ma_ratio(90), s.volatility(30, ppy), trend_limit, vol_limit),
    }
    return cols | {f"ma_ratio_{n}d": s.ma_ratio(n) for n in (7, 30, 90, 200)}


def equity_columns(s: Frames, mode: str = "batch", trend_limit: float = 0.03, vol_limit: float = 0.35) -> dict[str, Column]:
    """Session features.  ``batch`` follows research (log-return RSI, full-history EMA, flat windows
    undefined), ``row`` follows serving (price-difference RSI, trailing-120 EMA, flat windows 0)."""
    ppy, batch = 252, mode == "batch"
    zero = None if batch else 0.0
    cols = {f"return_{n}s": s.log_return(n) for n in EQUITY_RETURNS}
    cols |= {f"volatility_{n}s": s.volatility(n, ppy) for n in (5, 20, 60)}
    cols |= {
        "downside_volatility_20s": s.downside_volatility(20, ppy),
        "rsi_14": s.rsi(14, "_r" if batch else "_d"),
        "macd_normalized": s.macd("full" if batch else "trailing"),
        "atr_14_normalized": s.atr(14), "bollinger_width_20": s.bollinger(20), "ma_slope_20s": s.ma_slope(5, 20),
        "volume_zscore_20s": s.zscore("volume", 20, zero),
        "dollar_volume_zscore_20s": s.zscore("_dollar", 20, zero),
        "overnight_gap_1s": s.overnight_gap(), "intraday_return_1s": s.intraday_return(),
        "market_regime": maths.regime_code(s.ma_ratio(60), s.volatility(20, ppy), trend_limit, vol_limit),
    }
    return cols | {f"ma_ratio_{n}s": s.ma_ratio(n) for n in (5, 20, 60, 200)}


# --- against a benchmark -------------------------------------------------------------------------


def bench_by_date(bars: DataFrame, benchmark: str, pairs: dict[str, tuple[str, int]], zero: float | None = 0.0,
                  strength: tuple[str, int] | None = None) -> DataFrame:
    """Correlation / beta of log returns with the benchmark's returns on the same timestamps.

    ``pairs`` maps an output name to ("corr" | "beta", n); ``strength`` adds own minus benchmark n-step
    return.  The benchmark series is one row per time; its join is left to the optimizer, which
    broadcasts it when its measured size allows.
    """
    ahead = strength[1] if strength else 1
    own = owned(prepare(bars, halo=ahead).withColumns({"_ret": F.col("_r"), "_nret": F.ln(
        F.col("close") / F.lag("close", ahead).over(block_window((KEY,))))})).drop("_prev", "_r", "_d")
    bench = own.where(F.col(KEY) == benchmark).select(TIME, F.col("_ret").alias("_b"), F.col("_nret").alias("_bn"))
    joined = own.join(bench, TIME, "left")
    # Pairwise-complete values, so that one frame serves both sides.
    paired = F.col("_ret").isNotNull() & F.col("_b").isNotNull()
    joined = joined.withColumns({"_px": F.when(paired, F.col("_ret")), "_py": F.when(paired, F.col("_b"))})
    df = blocked(joined, [KEY], [TIME], lookback=max(n for _, n in pairs.values()), indexed=True)
    sizes = sorted({n for _, n in pairs.values()})
    stats = {}
    for n in sizes:
        w = frame(n)
        stats |= {f"_k{n}": F.count("_px").over(w), f"_sx{n}": F.stddev_samp("_px").over(w),
                  f"_sy{n}": F.stddev_samp("_py").over(w), f"_cv{n}": F.covar_samp("_px", "_py").over(w)}
    df = df.withColumns(stats)
    cols = {}
    for name, (kind, n) in pairs.items():
        sx, sy, cov = F.col(f"_sx{n}"), F.col(f"_sy{n}"), F.col(f"_cv{n}")
        den = sx * sy if kind == "corr" else sy * sy
        value = F.when(den == 0, F.lit(zero)).otherwise(cov / den)
        cols[name] = F.when(F.col(f"_k{n}") == n, value).otherwise(F.lit(zero))
    if strength:
        cols[strength[0]] = F.col("_nret") - F.col("_bn")
    return owned(df.withColumns(cols)).drop("_ret", "_nret", "_b", "_bn", "_px", "_py", "_idx", *stats)


def finish_returns(bars: DataFrame) -> DataFrame:
    """Bars with ``_ret`` (one-step log return) and the global position ``_idx``."""
    return owned(prepare(bars, halo=1).withColumn("_ret", F.col("_r"))).drop("_prev", "_r", "_d")


def tail_moments(x: Column, y: Column, n: int) -> Column:
    """struct(cov, sx, sy) of the last n entries of two arrays, in one pass.

    Values are shifted by the first entry, so a constant series has exactly zero variance.  The shift
    rides in the state: an expression inside the lambda would be evaluated for every element.
    """
    x, y = F.slice(x, -n, n), F.slice(y, -n, n)
    zero = F.lit(0.0)
    pairs = F.arrays_zip(x.alias("x"), y.alias("y"))
    first = [F.coalesce(F.get(a, F.lit(0)), zero).alias(c) for a, c in ((x, "x0"), (y, "y0"))]
    start = F.struct(*[zero.alias(c) for c in ("a", "b", "aa", "bb", "ab")], *first)

    def step(s, v):
        u, w = v["x"] - s["x0"], v["y"] - s["y0"]
        return F.struct((s["a"] + u).alias("a"), (s["b"] + w).alias("b"), (s["aa"] + u * u).alias("aa"),
                        (s["bb"] + w * w).alias("bb"), (s["ab"] + u * w).alias("ab"), s["x0"].alias("x0"), s["y0"].alias("y0"))

    def end(s):
        def moment(uv, u, v):
            return (s[uv] - s[u] * s[v] / n) / (n - 1)
        return F.struct(moment("ab", "a", "b").alias("cov"), F.sqrt(F.greatest(moment("aa", "a", "a"), zero)).alias("sx"),
                        F.sqrt(F.greatest(moment("bb", "b", "b"), zero)).alias("sy"))

    return F.aggregate(pairs, start, step, end)
