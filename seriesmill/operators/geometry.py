"""Geometry of candles and classes of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import EPS, div, first_true, log_return
from ..series import Series

GEOMETRY = (
    "range", "body_size", "body_direction", "upper_wick", "lower_wick", "body_ratio", "upper_wick_ratio", "lower_wick_ratio", "wick_imbalance", "wick_imbalance_ratio",
    "close_position", "gap", "return", "log_return",
)


def _need(df: DataFrame, columns: tuple) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"Missing required columns: {missing}")


def compute_ohlc_geometry(df: DataFrame, s: Series, eps: float = EPS) -> DataFrame:
    """df with the columns of GEOMETRY; a candle without range has ratios 0."""
    _need(df, ("open", "high", "low", "close"))
    o, h, low, c = (F.col(k) for k in ("open", "high", "low", "close"))
    size = h - low
    df = df.withColumns({"range": size, "body_size": F.abs(c - o), "body_direction": F.signum(c - o), "upper_wick": h - F.greatest(o, c), "lower_wick": F.least(o, c) - low, "_before": s.lag("close")})
    ratio = lambda x: F.when(F.col("range").isNotNull(), F.when(F.col("range") > eps, x / F.col("range")).otherwise(0.0))
    df = df.withColumns({"body_ratio": ratio(F.col("body_size")), "upper_wick_ratio": ratio(F.col("upper_wick")), "lower_wick_ratio": ratio(F.col("lower_wick")), "wick_imbalance": F.col("upper_wick") - F.col("lower_wick"), "close_position": ratio(c - low)})
    before = F.col("_before")
    df = df.withColumns({"wick_imbalance_ratio": ratio(F.col("wick_imbalance")), "gap": o - before, "return": div(c - before, before), "log_return": log_return(c, before)})
    return df.drop("_before")


def classify_ohlc_geometry(df: DataFrame, doji_body_ratio: float = 0.1, strong_body_ratio: float = 0.6, long_wick_ratio: float = 0.45) -> DataFrame:
    """body_state, direction_state, rejection_state and four flags from geometry columns."""
    _need(df, ("body_ratio", "upper_wick_ratio", "lower_wick_ratio", "body_direction"))
    b, up, low, d = (F.col(k) for k in ("body_ratio", "upper_wick_ratio", "lower_wick_ratio", "body_direction"))
    df = df.withColumns({"is_doji": b <= doji_body_ratio, "is_strong_body": b >= strong_body_ratio, "has_upper_rejection": up >= long_wick_ratio, "has_lower_rejection": low >= long_wick_ratio})
    u, v = F.col("has_upper_rejection"), F.col("has_lower_rejection")
    weak = (doji_body_ratio + strong_body_ratio) / 2
    return df.withColumns({
        "body_state": first_true((F.col("is_doji"), "doji"), (F.col("is_strong_body"), "strong_body"), (b < weak, "weak_body"), otherwise="normal_body"),
        "direction_state": first_true((d > 0, "up"), (d < 0, "down"), otherwise="neutral"),
        "rejection_state": first_true((u & v, "both_rejection"), (u, "upper_rejection"), (v, "lower_rejection"), otherwise="none"),
    })


def add_ohlc_geometry_features(df: DataFrame, s: Series, **thresholds: float) -> DataFrame:
    return classify_ohlc_geometry(compute_ohlc_geometry(df, s), **thresholds)


def confidence(x: Column) -> Column:
    """x held to [0, 1]; null counts 0."""
    return F.coalesce(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)), F.lit(0.0))
