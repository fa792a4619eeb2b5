"""Spectra, wavelet energy and polynomial trends.

A spectrum is taken of windows of a fixed number of rows, so that no task holds a whole series. A polynomial is fitted
from sums of powers, which is an ordinary aggregate.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..series import Series, row_numbers
from .windows import window_rows

WINDOW = 1024


def compute_fft_magnitude(df: DataFrame, s: Series, column: str, sample_rate_hz: float = 1.0, window: int = WINDOW, step: int | None = None, row: str | None = None, bucket: Column | None = None) -> DataFrame:
    """(keys, window_id, bin, freq, magnitude) of the real Fourier transform of each window of `window` rows; nulls count 0."""
    rows = window_rows(df.select(*s.keys, *s.order, column, *([row] if row else [])), s, window, step, row, bucket)
    keys = [*s.keys, "window_id"]
    schema = rows.select(*keys, F.lit(0).alias("bin"), F.lit(0.0).alias("freq"), F.lit(0.0).alias("magnitude")).schema

    def work(p: pd.DataFrame) -> pd.DataFrame:
        x = p.sort_values("_rn")[column].to_numpy(float)
        m = np.abs(np.fft.rfft(np.nan_to_num(x)))
        head = {k: [p[k].iloc[0]] * len(m) for k in keys}
        return pd.DataFrame(head | {"bin": np.arange(len(m), dtype=np.int32), "freq": np.fft.rfftfreq(len(x), 1 / sample_rate_hz), "magnitude": m})

    return rows.groupBy(*keys).applyInPandas(work, schema)


def wavelet_energy(df: DataFrame, s: Series, column: str, level: int = 1, name: str = "wavelet_energy") -> DataFrame:
    """Squared Haar detail of the row: difference of the means of two neighbouring runs of 2^(level-1) rows."""
    n = 1 << (level - 1)
    w1, w2 = s.last(n), s.window.rowsBetween(1 - 2 * n, -n)
    d = (F.sum(column).over(w2) - F.sum(column).over(w1)) / F.lit(float(2 * n) ** 0.5)
    full = F.count(column).over(s.last(2 * n)) == 2 * n
    return df.withColumn(name, F.when(full, d * d))


def micro_doppler_features(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """length and energy (sum of squares) of each series."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("length"), F.coalesce(F.sum(F.col(column) * F.col(column)), F.lit(0.0)).alias("energy"))


def regressor(df: DataFrame, s: Series, column: str = "close", max_degree: int = 4, bucket: Column | None = None, row: str | None = None) -> DataFrame:
    """df with y_pred and degree: the polynomial of the row number (scaled to [-1, 1]) of least Bayesian criterion.

    Sums of powers up to 2 * max_degree are aggregated; the normal equations of one series are one small row.
    """
    if column not in df.columns:
        raise ValueError(f"Missing required columns: [{column}]")
    rows = df.withColumn("_rn", F.col(row)) if row else row_numbers(df, s, bucket)
    n = rows.groupBy(*[F.col(k).alias(f"{k}__") for k in s.keys]).agg((F.max("_rn") + 1).alias("_n"))
    on = F.lit(True)
    for k in s.keys:
        on = on & F.col(k).eqNullSafe(F.col(f"{k}__"))
    rows = rows.join(n, on).withColumn("_t", F.when(F.col("_n") > 1, 2 * F.col("_rn") / (F.col("_n") - 1) - 1).otherwise(0.0))
    y, t = F.col(column).cast("double"), F.when(F.col(column).isNotNull(), F.col("_t"))
    sums = [F.sum(F.pow(t, F.lit(float(k)))).alias(f"p{k}") for k in range(2 * max_degree + 1)] + [F.sum(F.pow(t, F.lit(float(k))) * y).alias(f"q{k}") for k in range(max_degree + 1)]
    moments = rows.groupBy(*[f"{k}__" for k in s.keys]).agg(*sums, F.sum(y * y).alias("yy"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in moments.schema if f.name.endswith("__"))

    def solve(batches):
        for p in batches:
            degree, coefficients = [], []
            for r in p.itertuples(index=False):
                r, best = r._asdict() if hasattr(r, "_asdict") else dict(zip(p.columns, r)), None
                r = dict(zip(p.columns, r.values()))
                count = r["p0"] if r["p0"] == r["p0"] and r["p0"] is not None else 0
                for d in range(1, max_degree + 1):
                    if count <= d + 1:
                        break
                    a = np.array([[r[f"p{i + j}"] for j in range(d + 1)] for i in range(d + 1)])
                    b = np.array([r[f"q{i}"] for i in range(d + 1)])
                    c = np.linalg.lstsq(a, b, rcond=None)[0]
                    rss = max(r["yy"] - 2 * c @ b + c @ a @ c, 1e-12 * max(r["yy"], 1e-300))
                    score = count * np.log(rss / count) + (d + 1) * np.log(count)
                    if best is None or score < best[0] - 1e-9:
                        best = score, d, c
                if best is None:
                    best = 0, 1, np.array([r["q0"] / count if count else np.nan, 0.0])
                degree.append(best[1])
                coefficients.append([float(x) for x in best[2]])
            yield p[[c for c in p.columns if c.endswith("__")]].assign(degree=np.array(degree, np.int32), _c=coefficients)

    fit = moments.mapInPandas(solve, f"{kinds}, degree int, _c array<double>")
    fit = fit.withColumnsRenamed({f"{k}__": f"{k}___" for k in s.keys})
    on = F.lit(True)
    for k in s.keys:
        on = on & F.col(k).eqNullSafe(F.col(f"{k}___"))
    value = F.expr("aggregate(reverse(_c), 0D, (a, c) -> a * _t + c)")
    return rows.join(fit, on).withColumn("y_pred", value).select(*df.columns, "y_pred", "degree")
