"""Recursive smoothing: exponential averages and all that is built on them, adaptive averages and Kalman filters.

Catalyst has no recurrence, so one grouped pass computes every recursive column of a series at once, in Arrow batches.
Only final values need no Python: ema_last() folds them in the JVM.

Smoothing forgets: after 45 / alpha rows an old value weighs less than 1e-19 of the result. So long series are cut into
chunks with halo() rows before each (series.bounded; HALO for the indicators here, kama_halo() for adaptive averages),
and no task holds a whole hot series.

Exponential averages start at the first value (adjust=False); a gap of g rows leaves the old value the weight
(1 - alpha)^g, renormalised.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import first_true
from ..series import Series

#: Rows of halo: enough for two averages in a row of span 80, or one of span 180.
HALO = 4096


def halo(rate: float, passes: int = 1) -> int:
    """Rows after which averages of this rate, one after another, have forgotten a value: its weight is under 1e-19."""
    return math.ceil(45 / rate) * passes


def kama_halo(er_window: int = 10, slow: int = 30) -> int:
    """Rows of halo for kama(): its rate is never below the square of the slow one."""
    return halo((2 / (slow + 1)) ** 2) + er_window


def _wilder(x: pd.Series, n: int) -> pd.Series:
    return x.ewm(alpha=1 / n, adjust=False, min_periods=n).mean()


def _ema(x: pd.Series, span: int) -> pd.Series:
    return x.ewm(span=span, adjust=False).mean()


def _over(a: pd.Series, b: pd.Series) -> pd.Series:
    return a / b.where(b != 0)


def true_range(p: pd.DataFrame) -> pd.Series:
    before = p["close"].shift()
    return pd.concat([p["high"] - p["low"], (p["high"] - before).abs(), (p["low"] - before).abs()], axis=1).max(axis=1)


def rsi(x: pd.Series, n: int = 14) -> pd.Series:
    """Null where the average loss is 0."""
    d = x.diff()
    return 100 - 100 / (1 + _over(_wilder(d.clip(lower=0), n), _wilder(-d.clip(upper=0), n)))


def directional(p: pd.DataFrame, n: int = 14) -> dict[str, pd.Series]:
    up, down = p["high"].diff(), -p["low"].diff()
    plus, minus = up.where((up > down) & (up > 0), 0.0), down.where((down > up) & (down > 0), 0.0)
    tr = _wilder(true_range(p), n)
    a, b = 100 * _over(_wilder(plus, n), tr), 100 * _over(_wilder(minus, n), tr)
    dx = 100 * _over((a - b).abs(), a + b)
    return {f"plus_di_{n}": a, f"minus_di_{n}": b, f"dx_{n}": dx, f"adx_{n}": _wilder(dx, n)}


def macd(x: pd.Series, fast: int = 12, slow: int = 26, signal: int = 9) -> dict[str, pd.Series]:
    line = _ema(x, fast) - _ema(x, slow)
    smooth = _ema(line, signal)
    return {"macd": line, "macd_signal": smooth, "macd_hist": line - smooth}


def tsi(x: pd.Series, slow: int = 25, fast: int = 13) -> pd.Series:
    d = x.diff()
    return 100 * _over(_ema(_ema(d, slow), fast), _ema(_ema(d.abs(), slow), fast))


def keltner(p: pd.DataFrame, n: int = 20, k: float = 2.0) -> dict[str, pd.Series]:
    mid, atr = _ema(p["close"], n), _wilder(true_range(p), n)
    return {f"keltner_middle_{n}": mid, f"keltner_upper_{n}": mid + k * atr, f"keltner_lower_{n}": mid - k * atr}


def kama(x: pd.Series, er_window: int = 10, fast: int = 2, slow: int = 30) -> pd.Series:
    """Adaptive average: its rate goes from the slow to the fast one with the efficiency of the last er_window moves."""
    move = x.diff().abs().rolling(er_window).sum()
    er = _over((x - x.shift(er_window)).abs(), move).fillna(0.0)
    rate = (er * (2 / (fast + 1) - 2 / (slow + 1)) + 2 / (slow + 1)) ** 2
    v, r, out = x.to_numpy(float), rate.to_numpy(float), np.full(len(x), np.nan)
    state = np.nan
    for t in range(len(v)):
        if t >= er_window and not np.isnan(v[t]):
            state = v[t] if np.isnan(state) else state + r[t] * (v[t] - state)
            out[t] = state
    return pd.Series(out, x.index)


def kalman(x: pd.Series, process: float = 1e-3, noise: float = 1e-1) -> tuple[pd.Series, pd.Series]:
    """(estimate, velocity) of a constant-velocity model; a missing value is predicted only."""
    v = x.to_numpy(float)
    level, speed, out = np.nan, 0.0, np.full((len(v), 2), np.nan)
    a, b, c = 1.0, 0.0, 1.0  # covariance [[a, b], [b, c]]
    for t, z in enumerate(v):
        if np.isnan(level):
            if np.isnan(z):
                continue
            level = z
        else:
            level += speed
            a, b, c = a + 2 * b + c + process, b + c, c + process
            if not np.isnan(z):
                k0, k1, error = a / (a + noise), b / (a + noise), z - level
                level, speed = level + k0 * error, speed + k1 * error
                a, b, c = (1 - k0) * a, (1 - k0) * b, c - k1 * b
        out[t] = level, speed
    return pd.Series(out[:, 0], x.index), pd.Series(out[:, 1], x.index)


#: Recursive columns by name, from a frame of bars in order.
RECURSIVE = (
    "ema_20", "ema_50", "macd", "macd_signal", "macd_hist", "plus_di_14", "minus_di_14", "dx_14", "adx_14", "rsi_14", "tsi", "atr_14", "keltner_middle_20", "keltner_upper_20", "keltner_lower_20",
)


def bars_recursive(p: pd.DataFrame) -> dict[str, pd.Series]:
    c = p["close"]
    out = {"ema_20": _ema(c, 20), "ema_50": _ema(c, 50), "rsi_14": rsi(c), "tsi": tsi(c), "atr_14": _wilder(true_range(p), 14)}
    return out | macd(c) | directional(p) | keltner(p)


def grouped(df: DataFrame, s: Series, inputs: list[str], made: list[str], work: Callable[[pd.DataFrame], dict[str, pd.Series]]) -> DataFrame:
    """df with the double columns that work() makes of each series' rows in order; other columns pass through."""
    schema = df.select(*df.columns, *[F.lit(None).cast("double").alias(c) for c in made]).schema
    order = list(s.order)

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(order, kind="stable", ignore_index=True)
        x = p[inputs].astype("float64")
        found = work(x)
        return p.assign(**{c: found[c].replace([np.inf, -np.inf], np.nan) for c in made})

    return df.groupBy(*s.keys).applyInPandas(run, schema)


def recursive_indicators(bars: DataFrame, s: Series, names: tuple = RECURSIVE) -> DataFrame:
    """All recursive indicators of bars in one grouped pass."""
    return grouped(bars, s, ["high", "low", "close"], list(names), bars_recursive)


def smooth(df: DataFrame, s: Series, column: str, made: dict[str, Callable[[pd.Series], pd.Series]]) -> DataFrame:
    """df with a column for each function of the series of one column."""
    return grouped(df, s, [column], list(made), lambda p: {k: f(p[column]) for k, f in made.items()})


def compute_ema(df: DataFrame, s: Series, x: str, span: int = 20, name: str | None = None) -> DataFrame:
    return smooth(df, s, x, {name or f"ema_{span}": lambda v: _ema(v, span)})


def compute_rsi(df: DataFrame, s: Series, x: str = "close", n: int = 14) -> DataFrame:
    return smooth(df, s, x, {f"rsi_{n}": lambda v: rsi(v, n)})


def compute_tsi(df: DataFrame, s: Series, x: str = "close", slow: int = 25, fast: int = 13) -> DataFrame:
    return smooth(df, s, x, {"tsi": lambda v: tsi(v, slow, fast)})


def compute_macd(df: DataFrame, s: Series, x: str = "close", fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    return grouped(df, s, [x], ["macd", "macd_signal", "macd_hist"], lambda p: macd(p[x], fast, slow, signal))


def compute_atr(df: DataFrame, s: Series, n: int = 14) -> DataFrame:
    return grouped(df, s, ["high", "low", "close"], [f"atr_{n}"], lambda p: {f"atr_{n}": _wilder(true_range(p), n)})


def compute_keltner(df: DataFrame, s: Series, n: int = 20, k: float = 2.0) -> DataFrame:
    return grouped(df, s, ["high", "low", "close"], [f"keltner_{w}_{n}" for w in ("middle", "upper", "lower")], lambda p: keltner(p, n, k))


def compute_directional_indicators(df: DataFrame, s: Series, n: int = 14) -> DataFrame:
    """plus_di, minus_di, dx and adx."""
    names = [f"{k}_{n}" for k in ("plus_di", "minus_di", "dx", "adx")]
    out = grouped(df, s, ["high", "low", "close"], names, lambda p: directional(p, n))
    return out.withColumnsRenamed({c: c.removesuffix(f"_{n}") for c in names})


def compute_kama(df: DataFrame, s: Series, x: str, er_window: int = 10, fast: int = 2, slow: int = 30) -> DataFrame:
    return smooth(df, s, x, {f"kama_{er_window}_{fast}_{slow}": lambda v: kama(v, er_window, fast, slow)})


def kalman_filter_1d(df: DataFrame, s: Series, x: str, return_velocity: bool = False, process: float = 1e-3, noise: float = 1e-1) -> DataFrame:
    """kalman_1d, or estimate and velocity; an empty table is an error."""
    if df.isEmpty():
        raise ValueError("series must not be empty")
    if not return_velocity:
        return smooth(df, s, x, {"kalman_1d": lambda v: kalman(v, process, noise)[0]})
    return grouped(df, s, [x], ["estimate", "velocity"], lambda p: dict(zip(("estimate", "velocity"), kalman(p[x], process, noise))))


def kalman_filter_multivariate(df: DataFrame, s: Series, columns: list[str], process: float = 1e-3, noise: float = 1e-1) -> DataFrame:
    """The columns replaced by their estimates."""
    if df.isEmpty():
        raise ValueError("frame must not be empty")
    made = {f"_k_{c}": c for c in columns}
    out = grouped(df, s, columns, list(made), lambda p: {k: kalman(p[c], process, noise)[0] for k, c in made.items()})
    return out.withColumns({c: F.col(k) for k, c in made.items()}).drop(*made)


def kalman_filter_ohlc(df: DataFrame, s: Series) -> DataFrame:
    return kalman_filter_multivariate(df, s, ["open", "high", "low", "close"])


def compute_stochrsi(df: DataFrame, s: Series, x: str = "close", n: int = 14, k: int = 3, d: int = 3) -> DataFrame:
    """Place of the RSI between its least and greatest in the last n rows, and its averages stochrsi_k, stochrsi_d."""
    df = smooth(df, s, x, {"_rsi": lambda v: rsi(v, n)})
    df = df.withColumns({"_lo": s.min("_rsi", n), "_hi": s.max("_rsi", n)})
    df = df.withColumn("stochrsi", F.try_divide(F.col("_rsi") - F.col("_lo"), F.col("_hi") - F.col("_lo")))
    return df.withColumn("stochrsi_k", s.mean("stochrsi", k)).withColumn("stochrsi_d", s.mean("stochrsi_k", d)).drop("_rsi", "_lo", "_hi")


def compute_rsi_tsi_regime(df: DataFrame, s: Series, x: str = "close", rsi_low: float = 30, rsi_high: float = 70, tsi_low: float = -25, tsi_high: float = 25) -> DataFrame:
    """rsi, tsi and their positions: 1 above the high threshold, -1 below the low one, else 0."""
    if rsi_low >= rsi_high or tsi_low >= tsi_high:
        raise ValueError("thresholds must be in ascending order")
    df = smooth(df, s, x, {"rsi": rsi, "tsi": tsi})
    return df.withColumns({"rsi_position": position(F.col("rsi"), rsi_low, rsi_high), "tsi_position": position(F.col("tsi"), tsi_low, tsi_high)})


def position(x: Column, low: float, high: float) -> Column:
    return F.when(x >= high, 1).when(x <= low, -1).otherwise(0)


def compute_trend_helper_signal(df: DataFrame, s: Series, n: int = 14, adx_threshold: float = 25.0) -> DataFrame:
    """plus_di, minus_di, dx, adx and position: the sign of plus_di - minus_di where adx reaches the threshold."""
    if adx_threshold < 0:
        raise ValueError("adx_threshold must not be negative")
    df = compute_directional_indicators(df, s, n)
    sign = F.signum(F.col("plus_di") - F.col("minus_di")).cast("int")
    return df.withColumn("position", F.when(F.col("adx") >= adx_threshold, F.coalesce(sign, F.lit(0))).otherwise(0))


def ema_last(df: DataFrame, keys: list[str], order: tuple[str, ...], x: str, span: int, lookback: int | None = None) -> DataFrame:
    """The last exponential average of each series, folded in the JVM over its last `lookback` values.

    Values before those weigh less than 1e-19 by default; the bounded collection keeps a hot series out of memory.
    """
    a = 2 / (span + 1)
    lookback = lookback or int(45 / a) + 1
    w = Series(tuple(keys), order).window
    desc = w.orderBy(*[F.desc(c) for c in order])
    rows = df.where(F.col(x).isNotNull()).withColumn("_n", F.row_number().over(desc)).where(F.col("_n") <= lookback)
    listed = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct((-F.col("_n")).alias("n"), F.col(x).alias("x")))).alias("v"))
    fold = F.expr(f"aggregate(v, cast(null as double), (y, e) -> coalesce({a}D * e.x + {1 - a}D * y, e.x))")
    return listed.select(*keys, fold.alias(f"ema_{span}"))


def compute_adx_directional_signal(df: DataFrame, s: Series, n: int = 14, adx_threshold: float = 25.0) -> DataFrame:
    """adx, plus_di, minus_di and adx_signal in {-1, 0, 1}."""
    return compute_trend_helper_signal(df, s, n, adx_threshold).withColumnRenamed("position", "adx_signal")


def trend_label(score: Column, sensitivity: float = 0.0) -> Column:
    """alcista, bajista or lateral: up, down or within the sensitivity."""
    return first_true((score > sensitivity, "alcista"), (score < -sensitivity, "bajista"), otherwise="lateral")
