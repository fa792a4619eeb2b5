"""Regime labels from z-score, volatility and drawdown, their last values, and flags for a block of series."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import first_true, log_return
from ..series import Series
from .rolling import INPUTS, METRICS, WINDOWS, Windows, arrow_pass, by_block, every_window, ratio, with_inputs

FLAGS = (
    "high_volatility_regime", "low_volatility_regime", "trend_expansion", "mean_reversion_zone", "outlier_positive", "outlier_negative",
    "distribution_skewed_positive", "distribution_skewed_negative", "fat_tail_risk",
)


def label(z: Column, vol: Column, drawdown: Column, low: Column, high: Column) -> Column:
    """The label, strongest rule first; rows without statistics yet are normal."""
    return first_true(
        (z <= -3, "extreme_negative_outlier"), (z >= 3, "extreme_positive_outlier"), (z <= -2, "negative_outlier"), (z >= 2, "positive_outlier"),
        (drawdown <= -0.10, "drawdown_pressure"), (vol < low, "low_volatility_compression"), (vol > high, "high_volatility"), otherwise="normal",
    )


NUMBERS, QUARTILES = ("zscore", "volatility", "drawdown"), ("q1", "q3")


def window_numbers(x: np.ndarray, lr: np.ndarray, n: int) -> dict[str, np.ndarray]:
    """NUMBERS of every window of n rows, and QUARTILES of the volatility over n rows."""

    def numbers(v: dict) -> dict:
        w = Windows(v["x"], n)
        now = w.w[:, -1]
        return {"zscore": ratio(now - w.mean, np.sqrt(w.var)), "volatility": np.sqrt(Windows(v["lr"], n).var), "drawdown": ratio(now, w.high) - 1}

    def quartiles(v: dict) -> dict:
        w = Windows(v["v"], n)
        return {"q1": w.quantile(0.25), "q3": w.quantile(0.75)}

    found = by_block({"x": x, "lr": lr}, n, NUMBERS, numbers)
    return found | by_block({"v": found["volatility"]}, n, QUARTILES, quartiles)


def classify_columns(df: DataFrame, s: Series, columns: list[str], windows: tuple = WINDOWS) -> DataFrame:
    """df with {column}__{zscore, volatility, drawdown, regime}_{n}; quartiles are those of the volatility in the window.

    One Arrow pass makes the numbers of all columns and windows.
    """
    rows = df.withColumns({f"_x_{c}": F.col(c) for c in columns} | {f"_lr_{c}": log_return(F.col(c), s.lag(c)) for c in columns})
    numbers, quartiles = NUMBERS, QUARTILES

    def work(p: dict) -> dict:
        out = {}
        for c in columns:
            for n in windows:
                found = window_numbers(p[f"_x_{c}"], p[f"_lr_{c}"], n)
                out |= {f"{c}__{k}_{n}": found[k] for k in numbers} | {f"_{k}_{c}_{n}": found[k] for k in quartiles}
        return out

    of = [(c, n) for c in columns for n in windows]
    hidden = [f"_{k}_{c}_{n}" for c, n in of for k in quartiles]
    names = [f"{c}__{k}_{n}" for c, n in of for k in numbers]
    rows = arrow_pass(rows, s, [f"_{k}_{c}" for c in columns for k in ("x", "lr")], [*names, *hidden], work)
    labels = {f"{c}__regime_{n}": label(*[F.col(f"{c}__{k}_{n}") for k in numbers], F.col(f"_q1_{c}_{n}"), F.col(f"_q3_{c}_{n}")) for c, n in of}
    return rows.withColumns(labels).drop(*hidden, *(f"_{k}_{c}" for c in columns for k in ("x", "lr")))


def classify_series(df: DataFrame, s: Series, column: str, windows: tuple = WINDOWS) -> DataFrame:
    """classify_columns() of one column."""
    return classify_columns(df, s, [column], windows)


def classify_statistical_regime(df: DataFrame, s: Series, column: str, window: int = 20) -> DataFrame:
    """The frame of one window, with the label as stat_regime."""
    return classify_series(df, s, column, (window,)).withColumnRenamed(f"{column}__regime_{window}", "stat_regime")


def last_statistics(df: DataFrame, s: Series, column: str, windows: tuple = WINDOWS, metrics: tuple = METRICS) -> DataFrame:
    """One row a series: the last values of rolling_metrics() and classify_series(), from one Arrow pass.

    Only these leave the pass. A label is that of the last row, since every row has one.
    """
    keys, order = [*s.keys], [(c, "ascending") for c in s.order]
    names = [f"{column}__{m}_{n}" for n in windows for m in metrics] + [f"{column}__{k}_{n}" for n in windows for k in NUMBERS]
    ends = [f"_{k}_{n}" for n in windows for k in (*NUMBERS, *QUARTILES)]
    rows = with_inputs(df, s, column).select(*keys, *s.order, *INPUTS.values())
    schema = rows.select(*keys, *[F.lit(None).cast("double").alias(c) for c in (*names, *ends)]).schema

    def run(t: pa.Table) -> pa.Table:
        t = t.take(pc.sort_indices(t, sort_keys=order, null_placement="at_start"))
        v = {c: t[c].cast(pa.float64()).to_numpy() for c in INPUTS.values()}
        with np.errstate(all="ignore"):
            found = every_window(v, column, windows, metrics)
            now = {n: window_numbers(v["_x"], v["_lr"], n) for n in windows}
        found |= {f"{column}__{k}_{n}": now[n][k] for n in windows for k in NUMBERS}
        some = {c: x[np.isfinite(x)] for c, x in found.items()}
        cells = {c: some[c][-1] if len(some[c]) else None for c in names}
        cells |= {f"_{k}_{n}": x[-1] if np.isfinite(x[-1]) else None for n in windows for k, x in now[n].items()}
        return pa.table([t[k].slice(0, 1) for k in keys] + [pa.array([cells[c]], pa.float64()) for c in (*names, *ends)], names=[*keys, *names, *ends])

    last = rows.groupBy(*keys).applyInArrow(run, schema)
    labels = {f"{column}__regime_{n}": label(*[F.col(f"_{k}_{n}") for k in (*NUMBERS, *QUARTILES)]) for n in windows}
    return last.withColumns(labels).drop(*ends)


def last_regimes(df: DataFrame, s: Series, columns: list[str], windows: tuple = WINDOWS) -> DataFrame:
    """One row a series with the last values and labels of every column and window."""
    df = classify_columns(df, s, columns, windows)
    made = [f"{c}__{k}_{n}" for c in columns for n in windows for k in ("zscore", "volatility", "drawdown", "regime")]
    at = F.struct(*s.order)
    return df.groupBy(*s.keys).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in made])


def regime_flags(stats: DataFrame, keys: list[str]) -> DataFrame:
    """Flags of a block from long rows (ordinal, zscore, regime, skewness, kurtosis), one for each column and window.

    The z-score of the least ordinal decides mean_reversion_zone (0 if there is none). An ordinal may be a struct; it
    should be unique in a block.
    """
    z = F.coalesce(F.max(F.abs(F.col("zscore"))), F.lit(0.0))
    first = F.coalesce(F.min_by("zscore", F.when(F.col("zscore").isNotNull(), F.col("ordinal"))), F.lit(0.0))
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    label = F.col("regime")
    g = stats.groupBy(*keys).agg(
        some(label.contains("high_volatility")).alias("high_volatility_regime"), some(label.contains("low_volatility") | label.contains("compression")).alias("low_volatility_regime"),
        z.alias("_z"), first.alias("_first"), some(F.col("zscore") >= 2).alias("outlier_positive"), some(F.col("zscore") <= -2).alias("outlier_negative"),
        some(F.col("skewness") >= 1).alias("distribution_skewed_positive"), some(F.col("skewness") <= -1).alias("distribution_skewed_negative"), some(F.col("kurtosis") >= 3).alias("fat_tail_risk"),
    )
    g = g.withColumn("trend_expansion", F.col("high_volatility_regime") & (F.col("_z") >= 1))
    g = g.withColumn("mean_reversion_zone", (F.abs(F.col("_first")) <= 0.5) & ~F.col("high_volatility_regime"))
    return g.select(*keys, *FLAGS)
