"""State machines' inputs: slope, trend, momentum, volatility, structure and activity states with a confidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import div, first_true
from ..series import Series
from .geometry import classify_ohlc_geometry, compute_ohlc_geometry, confidence

MOMENTUM = ("rsi", "tsi", "roc", "macd_hist")
ACTIVITY = ("volume", "rvol", "trades")


def compute_slope_state(df: DataFrame, s: Series, column: str, window: int = 5, threshold: float = 0.0) -> DataFrame:
    """slope (change a row over the window) and slope_state rising, falling or flat."""
    df = df.withColumn("slope", (F.col(column) - s.lag(column, window)) / window)
    return df.withColumn("slope_state", first_true((F.col("slope") > threshold, "rising"), (F.col("slope") < -threshold, "falling"), otherwise="flat"))


def compute_trend_state(df: DataFrame, s: Series, value_col: str = "close", fast_col: str | None = None, slow_col: str | None = None, window: int = 5, fast: int = 5, slow: int = 20) -> DataFrame:
    """rising or falling where slope and the order of fast and slow averages agree, else sideways."""
    a = F.col(fast_col) if fast_col in df.columns else s.mean(value_col, fast, 1)
    b = F.col(slow_col) if slow_col in df.columns else s.mean(value_col, slow, 1)
    df = df.withColumns({"_fast": a, "_slow": b, "_slope": (F.col(value_col) - s.lag(value_col, window)) / window})
    spread, slope = F.col("_fast") - F.col("_slow"), F.col("_slope")
    state = first_true(((spread > 0) & (slope > 0), "rising"), ((spread < 0) & (slope < 0), "falling"), otherwise="sideways")
    df = df.withColumn("trend_state", state)
    sure = F.when(F.col("trend_state") == "sideways", 0.0).otherwise(confidence(100 * F.abs(div(spread, F.col("_slow")))))
    return df.withColumn("trend_confidence", sure).drop("_fast", "_slow", "_slope")


def compute_momentum_state(df: DataFrame, s: Series, momentum_cols: tuple = MOMENTUM) -> DataFrame:
    """positive, negative or neutral by the mean sign of the columns (rsi-like ones against 50)."""
    have = [c for c in momentum_cols if c in df.columns]
    if not have:
        return df.withColumns({"momentum_state": F.lit("neutral"), "momentum_confidence": F.lit(0.0)})
    signs = [F.coalesce(F.signum(F.col(c) - (50 if c.startswith(("rsi", "stoch")) else 0)), F.lit(0.0)) for c in have]
    df = df.withColumn("_m", sum(signs[1:], signs[0]) / len(signs))
    df = df.withColumns({"momentum_state": first_true((F.col("_m") > 0, "positive"), (F.col("_m") < 0, "negative"), otherwise="neutral"), "momentum_confidence": confidence(F.abs("_m"))})
    return df.drop("_m")


def compute_volatility_state(df: DataFrame, s: Series, column: str = "atr", window: int = 20, low: float = 0.8, high: float = 1.2) -> DataFrame:
    """compression or expansion of the column against its mean over the window."""
    if column not in df.columns:
        return df.withColumns({"volatility_state": F.lit("normal"), "volatility_confidence": F.lit(0.0)})
    df = df.withColumn("_v", div(F.col(column), s.mean(column, window)))
    df = df.withColumns({"volatility_state": first_true((F.col("_v") <= low, "compression"), (F.col("_v") >= high, "expansion"), otherwise="normal"), "volatility_confidence": confidence(F.abs(F.col("_v") - 1))})
    return df.drop("_v")


def compute_structure_state(df: DataFrame, s: Series) -> DataFrame:
    """The candle's structure, from its geometry columns or from open, high, low and close."""
    own = df.columns
    rows = df if {"body_ratio", "upper_wick_ratio", "lower_wick_ratio", "body_direction"} <= {*own} else compute_ohlc_geometry(df, s)
    rows = classify_ohlc_geometry(rows)
    rows = rows.withColumns({
        "structure_state": first_true((F.col("is_doji"), "indecision"), (F.col("has_upper_rejection"), "upper_rejection"), (F.col("has_lower_rejection"), "lower_rejection"), (F.col("is_strong_body") & (F.col("body_direction") > 0), "strong_up"), (F.col("is_strong_body") & (F.col("body_direction") < 0), "strong_down"), otherwise="normal"),
        "structure_confidence": confidence(F.greatest("body_ratio", "upper_wick_ratio", "lower_wick_ratio")),
    })
    return rows.select(*own, "structure_state", "structure_confidence")


def compute_activity_state(df: DataFrame, s: Series, activity_cols: tuple = ACTIVITY, window: int = 20, low: float = 0.7, high: float = 1.5) -> DataFrame:
    """high, low or normal activity: the first column there is, against its mean over the window."""
    have = [c for c in activity_cols if c in df.columns]
    if not have:
        return df.withColumns({"activity_state": F.lit("normal"), "activity_confidence": F.lit(0.0)})
    df = df.withColumn("_a", div(F.col(have[0]), s.mean(have[0], window)))
    df = df.withColumns({"activity_state": first_true((F.col("_a") >= high, "high"), (F.col("_a") <= low, "low"), otherwise="normal"), "activity_confidence": confidence(F.abs(F.col("_a") - 1))})
    return df.drop("_a")


def build_signal_state_frame(df: DataFrame, s: Series) -> DataFrame:
    """Five states and their confidences."""
    df = compute_momentum_state(compute_trend_state(df, s), s)
    return compute_activity_state(compute_structure_state(compute_volatility_state(df, s), s), s)
