"""Windows of rows as feature vectors: row windows, sections of features, one row a window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..series import Series, carry_forward, row_numbers
from .geometry import GEOMETRY, compute_ohlc_geometry
from .rolling import INVARIANTS, add_dynamics_features, add_invariant_features, numeric_columns

SECTIONS = (
    "window_meta", "variable_action", "volume_flow", "technical_indicators", "trend_signals", "fourier_features", "wavelet_features", "tda_features", "invariant_features",
    "dynamics_features", "label_or_future_state",
)
VOLUME_FLOW = ("volume", "notional_volume", "buy_volume", "sell_volume", "positive_flow", "negative_flow", "volume_delta", "cvd", "obv", "rvol")
TECHNICAL = ("rsi", "macd", "macd_signal", "macd_hist", "atr", "adx", "tsi", "ema", "sma", "vwap", "cci", "roc")
TREND = ("trend", "trend_score", "plus_di", "minus_di", "position", "FullTrend")
STATS = ("mean", "std", "min", "max", "first", "last", "delta", "median")
SCHEMA_VERSION = "1.0"


def validate_positive_window(window: int, step: int | None = None) -> None:
    if window <= 0 or (step is not None and step <= 0):
        raise ValueError("window and step must be positive")


def window_count(rows: int, window: int, step: int) -> int:
    return max(0, (rows - window) // step + 1)


def window_rows(df: DataFrame, s: Series, window: int, step: int | None = None, row: str | None = None, bucket: Column | None = None) -> DataFrame:
    """Every row with each window_id that holds it (step: the window by default); _rn is its number in the series.

    Only whole windows count. A row is copied at most ceil(window / step) times.
    """
    step = step or window
    validate_positive_window(window, step)
    rows = df.withColumn("_rn", F.col(row)) if row else row_numbers(df, s, bucket)
    size = rows.groupBy(*[F.col(k).alias(f"{k}__") for k in s.keys]).agg((F.max("_rn") + 1).alias("_n"))
    on = F.lit(True)
    for k in s.keys:
        on = on & F.col(k).eqNullSafe(F.col(f"{k}__"))
    rows = rows.join(size, on).drop(*(f"{k}__" for k in s.keys))
    low = F.greatest(F.lit(0), F.ceil((F.col("_rn") - window + 1) / step)).cast("long")
    high = F.least(F.floor(F.col("_rn") / step), F.floor((F.col("_n") - window) / step)).cast("long")
    rows = rows.withColumns({"_lo": low, "_hi": high}).where("_lo <= _hi and _n >= " + str(window))
    return rows.withColumn("window_id", F.explode(F.sequence("_lo", "_hi"))).drop("_lo", "_hi", "_n")


def window_meta(rows: DataFrame, s: Series, time_column: str | None = None, schema_version: str = SCHEMA_VERSION) -> DataFrame:
    """window_id, n_samples, schema_version, time_column, time_start, time_end of each window."""
    t = F.col(time_column) if time_column else F.lit(None).cast("timestamp")
    return rows.groupBy(*s.keys, "window_id").agg(F.count(F.lit(1)).alias("n_samples"), F.lit(schema_version).alias("schema_version"), F.lit(time_column).cast("string").alias("time_column"), F.min(t).alias("time_start"), F.max(t).alias("time_end"))


def extract_window(df: DataFrame, s: Series, start: int, end: int, bucket: Column | None = None) -> DataFrame:
    """Rows start..end-1 of each series."""
    if not {"open", "high", "low", "close"} <= {*df.columns}:
        raise ValueError("Missing required columns: open, high, low, close")
    return row_numbers(df, s, bucket).where((F.col("_rn") >= start) & (F.col("_rn") < end)).drop("_rn")


def section_columns(df: DataFrame, s: Series, value_columns: list[str] | None = None, window: int = 5) -> tuple[DataFrame, dict[str, list[str] | None]]:
    """(df with feature columns, section -> its columns or None). Features look back in the whole series."""
    have = [c for c in numeric_columns(df) if c not in {*s.keys, *s.order}]
    values = [c for c in (value_columns or ["close"]) if c in have]
    out = compute_ohlc_geometry(df, s)
    out = add_dynamics_features(add_invariant_features(out, s, values, window, ""), s, values, "")
    pick = lambda names: [c for c in names if c in have] or None
    sections: dict[str, list[str] | None] = dict.fromkeys(SECTIONS[1:])
    sections |= {"variable_action": list(GEOMETRY), "volume_flow": pick(VOLUME_FLOW), "technical_indicators": pick(TECHNICAL), "trend_signals": pick(TREND)}
    sections["invariant_features"] = [f"{c}_{k}" for c in values for k in INVARIANTS] or None
    sections["dynamics_features"] = [f"{c}_{k}" for c in values for k in ("velocity", "acceleration", "jerk", "curvature")] or None
    return out, sections


def _stats(column: str, at: str, stats: tuple) -> dict[str, Column]:
    key = F.when(F.col(column).isNotNull(), F.col(at))
    first, last = F.min_by(column, key), F.max_by(column, key)
    every = {"mean": F.avg(column), "std": F.stddev_samp(column), "min": F.min(column), "max": F.max(column), "first": first, "last": last, "delta": last - first, "median": F.median(column)}
    return {k: every[k] for k in stats}


def build_feature_matrix(df: DataFrame, s: Series, window_size: int, step: int | None = None, value_columns: list[str] | None = None, include_meta: bool = False, stats: tuple = STATS, row: str | None = None, bucket: Column | None = None) -> DataFrame:
    """One row a window, columns {section}__{column}_{stat}; sections without columns are left out."""
    out, sections = section_columns(df, s, value_columns)
    wanted = {name: cols for name, cols in sections.items() if cols}
    used = dict.fromkeys(c for cols in wanted.values() for c in cols)
    keep = [c for c in (*s.keys, *s.order, *([row] if row else []), *used)]
    rows = window_rows(out.select(*dict.fromkeys(keep)), s, window_size, step, row, bucket)
    aggs = [v.alias(f"{name}__{c}_{k}") for name, cols in wanted.items() for c in cols for k, v in _stats(c, "_rn", stats).items()]
    meta = [F.count(F.lit(1)).alias("window_meta__n_samples"), F.min(s.order[0]).alias("window_meta__time_start"), F.max(s.order[0]).alias("window_meta__time_end")] if include_meta else []
    return rows.groupBy(*s.keys, "window_id").agg(*meta, *aggs)


def drop_non_numeric_features(df: DataFrame) -> DataFrame:
    return df.select(*numeric_columns(df))


def fill_feature_matrix(df: DataFrame, s: Series | None = None, columns: list[str] | None = None, method: str | None = None) -> DataFrame:
    """Nulls as they are (None), 0 (zero), the last value, else the next, else 0 (ffill), or the column's median (median)."""
    columns = columns or numeric_columns(df, (*s.keys, *s.order) if s else ())
    if method is None:
        return df
    if method == "zero":
        return df.fillna(0, columns)
    if method == "ffill":
        order = df.columns
        df = carry_forward(df, s, {f"_f_{c}": F.col(c) for c in columns})
        nxt = df.groupBy(*[F.col(k).alias(f"{k}__") for k in s.keys]).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.struct(*s.order))).alias(f"_b_{c}") for c in columns])
        on = F.lit(True)
        for k in s.keys:
            on = on & F.col(k).eqNullSafe(F.col(f"{k}__"))
        df = df.join(nxt, on)  # before the first value only the first value follows
        zero = lambda c: F.lit(0).cast(dict(df.dtypes)[c])
        return df.withColumns({c: F.coalesce(f"_f_{c}", f"_b_{c}", zero(c)) for c in columns}).select(*order)
    if method == "median":
        found = df.agg(*[F.median(c).alias(c) for c in columns]).first()
        return df.fillna({c: found[c] for c in columns if found[c] is not None})
    raise ValueError("method must be None, zero, ffill or median")


def pipeline_report(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row: n_rows, n_features, missing_ratio, non_numeric_columns, constant_columns, from one aggregate."""
    columns = columns or df.columns
    numeric = [c for c in numeric_columns(df) if c in columns]
    aggs = [F.count(F.lit(1)).alias("n_rows"), *[F.count_if(F.col(c).isNull()).alias(f"_m_{c}") for c in columns], *[F.count_distinct(c).alias(f"_d_{c}") for c in numeric]]
    g = df.agg(*aggs)
    missing = sum((F.col(f"_m_{c}") for c in columns[1:]), F.col(f"_m_{columns[0]}"))
    constant = F.filter(F.array(*[F.when(F.col(f"_d_{c}") <= 1, F.lit(c)) for c in numeric] or [F.lit(None).cast("string")]), lambda x: x.isNotNull())
    other = F.array(*[F.lit(c) for c in columns if c not in numeric]).cast("array<string>")
    return g.select("n_rows", F.lit(len(columns)).cast("long").alias("n_features"), F.try_divide(missing, F.col("n_rows") * len(columns)).alias("missing_ratio"), other.alias("non_numeric_columns"), constant.alias("constant_columns"))


def flatten_window(df: DataFrame, sections: list[str], include_meta: bool = False) -> DataFrame:
    """Struct columns of sections -> columns {section}__{key}; absent (null-typed) sections are dropped."""
    out = []
    for name in sections:
        if name == "window_meta" and not include_meta or name not in df.columns:
            continue
        kind = df.schema[name].dataType
        if kind.typeName() == "struct":
            out += [F.col(f"{name}.{f}").alias(f"{name}__{f}") for f in kind.names]
    return df.select(*[c for c in df.columns if c not in sections], *out)


def build_window(df: DataFrame, s: Series, window_size: int, step: int | None = None, **options) -> DataFrame:
    """One row a window with a struct for each section of SECTIONS, null where a section has no columns."""
    flat = build_feature_matrix(df, s, window_size, step, include_meta=True, **options)
    out = [*s.keys, "window_id"]
    for name in SECTIONS:
        mine = [c for c in flat.columns if c.startswith(f"{name}__")]
        out.append((F.struct(*[F.col(c).alias(c.removeprefix(f"{name}__")) for c in mine]) if mine else F.lit(None).cast("map<string,double>")).alias(name))
    return flat.select(*out)
