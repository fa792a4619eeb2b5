"""Technical indicators over bars (open, high, low, close, volume) that look back over a bounded frame, and running sums.

Recursive ones are in recursive.py; technical() gives all of them in the order of a chart's feature table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import div, typical_price, weighted_close
from ..series import CHUNK_ROWS, Series, bounded, largest, running_sum
from .recursive import HALO, RECURSIVE, recursive_indicators

FIB = (0.236, 0.382, 0.5, 0.618)


def compute_sma(df: DataFrame, s: Series, x: str, n: int = 20, name: str | None = None) -> DataFrame:
    return df.withColumn(name or f"sma_{n}", s.mean(x, n))


def wma(s: Series, x: str, n: int = 20) -> Column:
    """Weights 1..n from the oldest to the newest value."""
    total = F.aggregate(F.transform(s.values(x, n), lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v)
    return total / (n * (n + 1) / 2)


def compute_wma(df: DataFrame, s: Series, x: str, n: int = 20, name: str | None = None) -> DataFrame:
    return df.withColumn("_v", s.values(x, n)).withColumn(name or f"wma_{n}", F.expr(f"aggregate(transform(_v, (v, i) -> v * (i + 1)), 0D, (a, v) -> a + v) / {n * (n + 1) / 2}")).drop("_v")


def momentum(df: DataFrame, s: Series, x: str = "close", n: int = 10) -> DataFrame:
    return df.withColumn(f"mom_{n}", s.diff(x, n))


def compute_roc(df: DataFrame, s: Series, x: str = "close", n: int = 12) -> DataFrame:
    return df.withColumn(f"roc_{n}", 100 * (div(F.col(x), s.lag(x, n)) - 1))


def _range(s: Series, n: int) -> tuple[Column, Column]:
    return s.max("high", n), s.min("low", n)


def compute_stochastic(df: DataFrame, s: Series, n: int = 14, smooth: int = 3) -> DataFrame:
    high, low = _range(s, n)
    k = f"stoch_k_{n}"
    df = df.withColumn(k, 100 * div(F.col("close") - low, high - low))
    return df.withColumn(f"stoch_d_{n}", s.mean(k, smooth))


def compute_williams_r(df: DataFrame, s: Series, n: int = 14) -> DataFrame:
    high, low = _range(s, n)
    return df.withColumn(f"williams_r_{n}", -100 * div(high - F.col("close"), high - low))


def cci(df: DataFrame, s: Series, n: int = 20) -> DataFrame:
    """Distance of the typical price to its mean, over 0.015 times its mean absolute deviation from that mean."""
    df = df.withColumn("_tp", typical_price(F.col("high"), F.col("low"), F.col("close")))
    df = df.withColumns({"_m": s.mean("_tp", n), "_v": s.values("_tp", n)})
    mad = F.aggregate("_v", F.lit(0.0), lambda a, v: a + F.abs(v - F.col("_m"))) / n
    return df.withColumn(f"cci_{n}", div(F.col("_tp") - F.col("_m"), 0.015 * mad)).drop("_tp", "_m", "_v")


def compute_bollinger_bands(df: DataFrame, s: Series, x: str = "close", n: int = 20, k: float = 2.0) -> DataFrame:
    """bb_middle, bb_upper, bb_lower, bb_bandwidth and bb_percent_b, with the sample deviation."""
    df = df.withColumns({f"bb_middle_{n}": s.mean(x, n), "_sd": s.std(x, n)})
    mid = F.col(f"bb_middle_{n}")
    df = df.withColumns({f"bb_upper_{n}": mid + k * F.col("_sd"), f"bb_lower_{n}": mid - k * F.col("_sd")})
    up, low = F.col(f"bb_upper_{n}"), F.col(f"bb_lower_{n}")
    return df.withColumns({f"bb_bandwidth_{n}": div(up - low, mid), f"bb_percent_b_{n}": div(F.col(x) - low, up - low)}).drop("_sd")


def donchian(df: DataFrame, s: Series, n: int = 20) -> DataFrame:
    high, low = _range(s, n)
    return df.withColumns({f"donchian_high_{n}": high, f"donchian_low_{n}": low}).withColumn(f"donchian_mid_{n}", (F.col(f"donchian_high_{n}") + F.col(f"donchian_low_{n}")) / 2)


def support_resistance(df: DataFrame, s: Series, n: int = 20) -> DataFrame:
    high, low = _range(s, n)
    return df.withColumns({f"support_{n}": low, f"resistance_{n}": high})


def fibonacci_levels(df: DataFrame, s: Series, n: int = 100) -> DataFrame:
    high, low = _range(s, n)
    df = df.withColumns({"_hh": high, "_ll": low})
    return df.withColumns({f"fib_{round(q * 1000)}_{n}": F.col("_hh") - (F.col("_hh") - F.col("_ll")) * q for q in FIB}).drop("_hh", "_ll")


def true_range(s: Series) -> Column:
    before = s.lag("close")
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def compute_tr(df: DataFrame, s: Series) -> DataFrame:
    return df.withColumn("tr", true_range(s))


def vwap(df: DataFrame, s: Series, chunk_rows: int = CHUNK_ROWS, bucket: Column | None = None, name: str = "vwap", longest: int | None = None) -> DataFrame:
    """Volume-weighted typical price since the first row of the series."""
    v = F.col("volume").cast("double")
    df = running_sum(df, s, {"_pv": typical_price(F.col("high"), F.col("low"), F.col("close")) * v, "_cv": v}, chunk_rows, bucket, longest)
    return df.withColumn(name, div(F.col("_pv"), F.col("_cv"))).drop("_pv", "_cv")


def obv(df: DataFrame, s: Series, chunk_rows: int = CHUNK_ROWS, bucket: Column | None = None, name: str = "obv", halo: int = 1, longest: int | None = None) -> DataFrame:
    """Running sum of volume by the sign of the close's change; the first change and a missing volume count 0."""
    longest = largest(df, s) if longest is None else longest
    df = bounded(df, s, halo, lambda d, t: d.withColumn("_ch", F.coalesce(F.signum(t.diff("close")), F.lit(0.0))), chunk_rows, bucket, longest)
    return running_sum(df, s, {name: F.col("_ch") * F.coalesce(F.col("volume").cast("double"), F.lit(0.0))}, chunk_rows, bucket, longest).drop("_ch")


def ohlc_to_series(df: DataFrame, mode: str = "weighted") -> DataFrame:
    """One price a bar: weighted_close, typical_price or close."""
    h, low, c = F.col("high"), F.col("low"), F.col("close")
    made = {"weighted": ("weighted_close", weighted_close(h, low, c)), "typical": ("typical_price", typical_price(h, low, c)), "close": ("close", c)}
    return df.withColumn(*made[mode])


def frame_indicators(df: DataFrame, s: Series) -> DataFrame:
    """All indicators with a bounded frame."""
    df = compute_wma(compute_sma(df, s, "close"), s, "close")
    df = compute_williams_r(momentum(compute_roc(compute_stochastic(df, s), s), s), s)
    df = compute_bollinger_bands(cci(df, s), s)
    return fibonacci_levels(support_resistance(donchian(df, s), s), s)


TECHNICAL = (
    "sma_20", "ema_20", "ema_50", "wma_20", "macd", "macd_signal", "macd_hist", "adx_14", "plus_di_14", "minus_di_14", "rsi_14", "stoch_k_14", "stoch_d_14", "roc_12", "mom_10",
    "williams_r_14", "tsi", "cci_20", "atr_14", "bb_middle_20", "bb_upper_20", "bb_lower_20", "bb_bandwidth_20", "bb_percent_b_20", "donchian_high_20", "donchian_low_20", "donchian_mid_20",
    "keltner_middle_20", "keltner_upper_20", "keltner_lower_20", "vwap", "obv", "support_20", "resistance_20", "fib_236_100", "fib_382_100", "fib_500_100", "fib_618_100",
)


def technical(bars: DataFrame, s: Series, chunk_rows: int = CHUNK_ROWS, bucket: Column | None = None, longest: int | None = None) -> DataFrame:
    """bars with every column of TECHNICAL; without open, high, low and close as they are. A missing volume is 0.

    longest: no series has more rows; without it they are counted.
    """
    if not {"open", "high", "low", "close"} <= {*bars.columns}:
        return bars
    if "volume" not in bars.columns:
        bars = bars.withColumn("volume", F.lit(0.0))
    own = bars.columns
    longest = largest(bars, s) if longest is None else longest
    out = bounded(bars, s, HALO, lambda d, t: recursive_indicators(frame_indicators(d, t), t, RECURSIVE), chunk_rows, bucket, longest)
    return obv(vwap(out, s, chunk_rows, bucket, longest=longest), s, chunk_rows, bucket, longest=longest).select(*own, *TECHNICAL)
