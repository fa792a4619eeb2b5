"""Views of one series as another shape: bars, candles, time series, sliding OHLC windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..series import Series
from .rolling import numeric_columns

#: Reference columns by preference; the first numeric column comes last.
REFERENCES = ("close", "value", "open_interest_usd", "long_short_ratio", "exchange_netflow", "total_liquidations_usd")
OHLC = ("open", "high", "low", "close")


def reference_column(df: DataFrame, preferred: str | None = None, excluded: tuple = ()) -> str | None:
    wanted = [c for c in (preferred, *REFERENCES) if c in df.columns]
    return (wanted or numeric_columns(df, excluded) or [None])[0]


def time_series_to_bars(df: DataFrame, preferred: str | None = None, excluded: tuple = ()) -> DataFrame:
    """Bars as they are, else flat bars of the reference column; volume from volume, notional_volume or null.

    A frame with neither gives no bars.
    """
    keep = [c for c in df.columns if c not in {*OHLC, "volume", "notional_volume"}]
    volume = next((F.col(c).cast("double") for c in ("volume", "notional_volume") if c in df.columns), F.lit(None).cast("double"))
    if {*OHLC} <= {*df.columns}:
        return df.select(*keep, *OHLC, volume.alias("volume"))
    ref = reference_column(df, preferred, excluded)
    x = F.col(ref).cast("double") if ref else F.lit(None).cast("double")
    bars = df.select(*[c for c in keep if c != ref], *[x.alias(c) for c in OHLC], volume.alias("volume"))
    return bars if ref else bars.limit(0)


def orderbook_to_bars(df: DataFrame) -> DataFrame:
    return time_series_to_bars(df, "mid_price")


def time_series_to_candlestick(df: DataFrame, keys: list[str], preferred: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(candles, conversion record of each block: method, reference_column, source_rows, derived_rows)."""
    bars = time_series_to_bars(df, preferred)
    ref = reference_column(df, preferred)
    record = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("source_rows"))
    made = F.col("source_rows") if ref else F.lit(0).cast("long")
    return bars, record.select(*keys, F.lit("numeric_series_to_ohlc").alias("method"), F.lit(ref).cast("string").alias("reference_column"), "source_rows", made.alias("derived_rows"))


def candlestick_to_time_series(df: DataFrame, keys: tuple = ()) -> DataFrame:
    return df.select(*keys, *[c for c in ("timestamp", *OHLC, "volume", "notional_volume") if c in df.columns])


def bucket_bars(points: DataFrame, keys: list[str], ts: str, tie: str, value: str, bucket: Column, volume: Column) -> DataFrame:
    """Open, high, low, close and volume of each bucket of time."""
    at = F.struct(ts, tie)
    x = F.col(value)
    return points.groupBy(*keys, bucket.alias("bar")).agg(F.min_by(x, at).alias("open"), F.max(x).alias("high"), F.min(x).alias("low"), F.max_by(x, at).alias("close"), F.sum(volume).alias("volume"))


def series_to_ohlc_windows(df: DataFrame, s: Series, value: str, window: int, step: int | None = None, row: str | None = None) -> DataFrame:
    """Sliding buckets of `window` rows every `step` rows: window_id, open, high, low, close, start_idx, end_idx."""
    from .windows import window_rows

    rows = window_rows(df, s, window, step, row)
    x = F.col(value)
    return rows.groupBy(*s.keys, "window_id").agg(F.min_by(x, "_rn").alias("open"), F.max(x).alias("high"), F.min(x).alias("low"), F.max_by(x, "_rn").alias("close"), F.min("_rn").alias("start_idx"), F.max("_rn").alias("end_idx"))
