"""Contracts: schema checks on the driver, constraint queries over tables."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..operators.rolling import numeric_columns

REQUIRED_OHLC_COLUMNS = ["open", "high", "low", "close"]
OPTIONAL_VOLUME_COLUMNS = ["volume", "notional_volume"]
OPTIONAL_SIGNED_FLOW_COLUMNS = ["buy_volume", "sell_volume", "positive_flow", "negative_flow"]
OPTIONAL_TIME_COLUMNS = ["timestamp", "time", "datetime", "date", "ts"]
TIMED = ("candlestick", "candlestick_derived", "bars", "time_series")
WINDOWED = ("snapshot", "event_list", "heatmap")
MAX_SHAPES = 4


def validate_dataframe(df: Any, allow_empty: bool = False) -> None:
    if not hasattr(df, "schema") or not hasattr(df, "isEmpty"):
        raise ValueError("Input must be a DataFrame")
    if not allow_empty and df.isEmpty():
        raise ValueError("DataFrame is empty")


def validate_required_columns(df: DataFrame, required: list[str]) -> None:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"Missing required columns: {missing}")


def validate_numeric_columns(df: DataFrame, columns: list[str]) -> None:
    """Missing columns are ignored."""
    wrong = [c for c in columns if c in df.columns and c not in numeric_columns(df)]
    if wrong:
        raise ValueError(f"Non-numeric columns found: {wrong}")


def validate_ohlc_columns(df: DataFrame) -> None:
    validate_required_columns(df, REQUIRED_OHLC_COLUMNS)
    validate_numeric_columns(df, REQUIRED_OHLC_COLUMNS)


def infer_time_column(df: DataFrame) -> str | None:
    return next((c for c in OPTIONAL_TIME_COLUMNS if c in df.columns), None)


def build_feature_contract(required_columns: list[str] | None = None, optional_columns: list[str] | None = None, schema_version: str = "1.0") -> dict[str, Any]:
    """The contract, with a StructType in which required features can't be null."""
    required, optional = list(required_columns or REQUIRED_OHLC_COLUMNS), list(optional_columns or [])
    fields = [StructField(c, DoubleType(), False) for c in required] + [StructField(c, DoubleType(), True) for c in optional]
    return {"schema_version": schema_version, "required_columns": required, "optional_columns": optional, "schema": StructType(fields)}


def validate_feature_matrix(df: DataFrame, require_numeric: bool = True, allow_nan: bool = True) -> None:
    """One aggregate for all columns."""
    validate_dataframe(df)
    if require_numeric:
        wrong = [c for c in df.columns if c not in numeric_columns(df)]
        if wrong:
            raise ValueError(f"Non-numeric columns found: {wrong}")
    if not allow_nan:
        row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]).first()
        holes = [c for c in df.columns if row[c]]
        if holes:
            raise ValueError(f"Missing values found: {holes}")


def input_errors(blocks: DataFrame, records: DataFrame, keys: list[str]) -> DataFrame:
    """blocks (keys, data_type, timeframe, extraction_window, min_records_required), records (keys, pos, timestamp) -> (keys, error).

    Records are to be in order of pos without repeated timestamps; enough of them for timed types; windowed types have
    an extraction window and no timeframe.
    """
    w = W.partitionBy(*keys).orderBy("pos")
    known = records.where("timestamp is not null").withColumn("_before", F.lag("timestamp").over(w))
    g = records.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    t = known.groupBy(*keys).agg(F.coalesce(F.bool_or(F.col("_before") > F.col("timestamp")), F.lit(False)).alias("_unsorted"), (F.count("timestamp") > F.count_distinct("timestamp")).alias("_twice"))
    rows = blocks.join(g, keys, "left").join(t, keys, "left")
    timed, windowed = F.col("data_type").isin(*TIMED), F.col("data_type").isin(*WINDOWED)
    n, least = F.coalesce("_n", F.lit(0)), F.coalesce("min_records_required", F.lit(0))
    rules = {"timestamps are not sorted": F.col("_unsorted"), "duplicate timestamps found": F.col("_twice"), "records below minimum": timed & (least > 0) & (n < least), "non-timeframe data_type has a timeframe": windowed & F.col("timeframe").isNotNull(), "non-timeframe data_type lacks an extraction_window": windowed & F.col("extraction_window").isNull()}
    found = F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]), lambda x: x.isNotNull())
    return rows.select(*keys, F.explode(found).alias("error"))


# What blocks of each shape hold and may not hold.
COMPLETE = ("source_name", "detected", "normalized", "decision", "math", "patterns", "routes", "family_key", "output_shape")
SPECIAL = {"bars": "bars", "event_list": "events", "regimes": "regimes", "candlestick_derived": "candles", "cvd_candlestick_derived": "candles", "orderbook": "bids", "orderflow_features": "feature_snapshot", "volume_features": "feature_snapshot"}
FORBIDDEN = ("normalized", "patterns", "decision", "routes")
STATISTICS_IN = ("time_series", "candlestick", "candlestick_derived", "cvd_candlestick_derived")
REGIMES_IN = (*STATISTICS_IN, "regimes")
TECHNICAL_IN = ("candlestick", "candlestick_derived", "cvd_candlestick_derived", "time_series")


def shape_errors(family: str, shape: str, schema: StructType, blocks: int) -> list[str]:
    """What is wrong with the written table of one family and shape, by its schema."""
    from .ingest import OFFICIAL_FAMILIES

    names = {*schema.names}
    math = {*schema["math"].dataType.names} if "math" in names and schema["math"].dataType.typeName() == "struct" else set()
    at, errors = f"{family}/{shape}", []
    if family not in OFFICIAL_FAMILIES:
        errors.append(f"{at}: unexpected family")
    if not blocks:
        errors.append(f"{at}: blocks is empty")
    if shape in SPECIAL:
        errors += [f"{at}: forbidden {c}" for c in FORBIDDEN if c in names]
        errors += [f"{at}: missing {c}" for c in ("source_name", "regime_flags", SPECIAL[shape]) if c not in names]
    else:
        errors += [f"{at}: missing {c}" for c in COMPLETE if c not in names]
    for section, allowed in (("statistics", STATISTICS_IN), ("statistical_regimes", REGIMES_IN), ("technical_indicators", TECHNICAL_IN)):
        if section in math and shape not in allowed:
            errors.append(f"{at}: must not contain math.{section}")
    return errors
