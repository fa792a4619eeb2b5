"""Volume statistics, volume-weighted prices and order flow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import div, typical_price
from ..series import CHUNK_ROWS, Series, running_sum
from .indicators import obv, vwap
from .recursive import compute_ema


def compute_volume_stats(df: DataFrame, s: Series, window: int = 20, volume: str = "volume", chunk_rows: int = CHUNK_ROWS, bucket: Column | None = None) -> DataFrame:
    """vol_sma, vol_ema, rvol, vol_zscore of the window, and obv."""
    df = compute_ema(df, s, volume, window, f"vol_ema_{window}")
    df = df.withColumns({f"vol_sma_{window}": s.mean(volume, window), "_sd": s.std(volume, window)})
    sma = F.col(f"vol_sma_{window}")
    df = df.withColumns({f"rvol_{window}": div(F.col(volume), sma), f"vol_zscore_{window}": div(F.col(volume) - sma, F.col("_sd"))}).drop("_sd")
    return obv(df, s, chunk_rows, bucket)


def compute_vwap_metrics(df: DataFrame, s: Series, rolling_window: int = 20, mfi_window: int = 14, cmf_window: int = 20, chunk_rows: int = CHUNK_ROWS, bucket: Column | None = None) -> DataFrame:
    """typical_price, vwap, rolling_vwap, close_vwap_dist, money flow index and Chaikin money flow."""
    h, low, c, v = (F.col(k) for k in ("high", "low", "close", "volume"))
    df = vwap(df.withColumn("typical_price", typical_price(h, low, c)), s, chunk_rows, bucket)
    df = df.withColumns({"_pv": F.col("typical_price") * v, "_d": s.diff("typical_price"), "_mf": F.coalesce(div((c - low) - (h - c), h - low), F.lit(0.0)) * v})
    df = df.withColumns({"_up": F.when(F.col("_d").isNotNull(), F.when(F.col("_d") > 0, F.col("_pv")).otherwise(0.0)), "_down": F.when(F.col("_d").isNotNull(), F.when(F.col("_d") < 0, F.col("_pv")).otherwise(0.0))})
    df = df.withColumns({"_u": s.sum("_up", mfi_window), "_w": s.sum("_down", mfi_window), "_m": s.sum("_mf", cmf_window), "_vc": s.sum("volume", cmf_window), "_vr": s.sum("volume", rolling_window), "_p": s.sum("_pv", rolling_window)})
    df = df.withColumns({f"rolling_vwap_{rolling_window}": div(F.col("_p"), F.col("_vr")), "close_vwap_dist": div(c - F.col("vwap"), F.col("vwap")), f"mfi_{mfi_window}": 100 * div(F.col("_u"), F.col("_u") + F.col("_w")), f"cmf_{cmf_window}": div(F.col("_m"), F.col("_vc"))})
    return df.drop("_pv", "_d", "_mf", "_up", "_down", "_u", "_w", "_m", "_vc", "_vr", "_p")


def compute_order_flow_metrics(df: DataFrame, s: Series, buy: str = "buy_volume", sell: str = "sell_volume", chunk_rows: int = CHUNK_ROWS, bucket: Column | None = None) -> DataFrame:
    """volume_delta, volume_imbalance and their running sum cvd."""
    b, a = F.col(buy).cast("double"), F.col(sell).cast("double")
    df = df.withColumns({"volume_delta": b - a, "volume_imbalance": div(b - a, b + a)})
    return running_sum(df, s, {"cvd": F.col("volume_delta")}, chunk_rows, bucket)


def add_volume_features(df: DataFrame, s: Series, vol_window: int = 20, rolling_window: int = 20, mfi_window: int = 14, cmf_window: int = 20, flow_enabled: bool = True) -> DataFrame:
    """All of the above, and breakout_volume_score: relative volume in the direction of the bar."""
    df = compute_vwap_metrics(compute_volume_stats(df, s, vol_window), s, rolling_window, mfi_window, cmf_window)
    if flow_enabled and {"buy_volume", "sell_volume"} <= {*df.columns}:
        df = compute_order_flow_metrics(df, s)
    return df.withColumn("breakout_volume_score", F.col(f"rvol_{vol_window}") * F.signum(F.col("close") - F.col("open")))


class VolumeIndicators:
    """The same functions as methods."""

    compute_volume_stats = staticmethod(compute_volume_stats)
    compute_vwap_metrics = staticmethod(compute_vwap_metrics)
    compute_order_flow_metrics = staticmethod(compute_order_flow_metrics)
    add_volume_features = staticmethod(add_volume_features)
