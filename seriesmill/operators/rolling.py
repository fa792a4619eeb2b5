"""Rolling statistics, scale-free invariants, dynamics and whole-series summaries.

A frame of n rows gives a value only where n of them hold one (or min_periods, where that is an option). Metrics are
named {column}__{metric}_{n}. All frames of a Series share one exchange and one sort.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import EPS, div, entropy, log_return, quantile, sample_kurtosis, sample_skewness, simple_return
from ..series import Series

WINDOWS = (20, 50, 100)
BINS = 10
#: Scale that makes the median absolute deviation a standard deviation for normal data.
MAD_SCALE = 1.4826
METRICS = (
    "rolling_mean", "rolling_std", "rolling_var", "rolling_skewness", "rolling_kurtosis", "rolling_zscore", "rolling_min", "rolling_max", "rolling_range",
    "rolling_quantile_25", "rolling_quantile_75", "rolling_iqr", "rolling_autocorr", "rolling_entropy", "rolling_drawdown", "rolling_volatility",
    "realized_volatility", "rolling_corr", "rolling_cov", "rolling_beta",
)


def pair_stats(s: Series, x: Column, y: Column, n: int, min_periods: int | None = None) -> tuple[Column, Column]:
    """(correlation, sample covariance) of x and y over the last n rows, over rows that have both."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    w = s.last(n)
    cov = F.covar_samp(a, b).over(w)
    enough = F.count(a).over(w) >= (n if min_periods is None else min_periods)
    return F.when(enough, div(cov, F.stddev_samp(a).over(w) * F.stddev_samp(b).over(w))), F.when(enough, cov)


#: Metrics that frames of built-in aggregates give at little cost; all others come from one Arrow pass over the series.
FRAMED = ("rolling_mean", "rolling_std", "rolling_var", "rolling_zscore", "rolling_min", "rolling_max", "rolling_range", "rolling_drawdown")
#: Values of all windows that the Arrow pass holds at a time; some metrics hold them ten times over.
_HELD = 500_000


def ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.full(np.broadcast(a, b).shape, np.nan), where=b != 0)


class Windows:
    """All windows of n values of one column, as rows: missing values make a window's results missing."""

    def __init__(self, v: np.ndarray, n: int):
        self.n, self.w = n, np.lib.stride_tricks.sliding_window_view(v, n)
        self.low, self.high = self.w.min(1), self.w.max(1)
        self.flat, self.mean = self.low == self.high, self.w.mean(1)

    @functools.cached_property
    def centred(self) -> np.ndarray:
        return np.where(self.flat[:, None], 0.0, self.w - self.mean[:, None])

    @functools.cached_property
    def var(self) -> np.ndarray:
        return (self.centred**2).sum(1) / max(self.n - 1, 1) if self.n > 1 else np.full(len(self.mean), np.nan)

    @functools.cached_property
    def ordered(self) -> np.ndarray:
        return np.sort(self.w, axis=1)

    def moment(self, k: int) -> np.ndarray:
        return ratio((self.centred**k).mean(1), ((self.centred**2).mean(1)) ** (k / 2))

    def skewness(self) -> np.ndarray:
        n = self.n
        return np.where(self.flat, 0.0, np.sqrt(n * (n - 1)) / (n - 2) * self.moment(3)) if n > 2 else np.full(len(self.mean), np.nan)

    def kurtosis(self) -> np.ndarray:
        n = self.n
        return np.where(self.flat, -3.0, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * (self.moment(4) - 3) + 6)) if n > 3 else np.full(len(self.mean), np.nan)

    def quantile(self, q: float) -> np.ndarray:
        at = q * (self.n - 1)
        low = int(at)
        a, b = self.ordered[:, low], self.ordered[:, min(low + 1, self.n - 1)]
        return np.where(np.isnan(self.mean), np.nan, a + (b - a) * (at - low))

    def entropy(self, bins: int) -> np.ndarray:
        """Of a histogram of `bins` equal bins between the least and the greatest value."""
        span = np.where(self.flat | np.isnan(self.mean), 1.0, self.high - self.low)
        at = np.minimum(np.floor(np.nan_to_num((self.w - self.low[:, None]) / span[:, None] * bins)), bins - 1).astype(np.int64)
        rows = len(at)
        p = np.bincount((at + np.arange(rows)[:, None] * bins).ravel(), minlength=rows * bins).reshape(rows, bins) / self.n
        return np.where(np.isnan(self.mean), np.nan, np.where(self.flat, 0.0, -(p * np.log(np.where(p > 0, p, 1.0))).sum(1)))

    def covariance(self, other: Windows) -> np.ndarray:
        return (self.centred * other.centred).sum(1) / (self.n - 1) if self.n > 1 else np.full(len(self.mean), np.nan)

    def correlation(self, other: Windows) -> np.ndarray:
        return ratio(self.covariance(other), np.sqrt(self.var) * np.sqrt(other.var))


def _window_metrics(v: dict[str, np.ndarray], n: int, bins: int, metrics: tuple) -> dict[str, np.ndarray]:
    """Metrics of every whole window of n rows, from the last row of the first on."""
    x = Windows(v["x"], n)
    both = {k: np.where(np.isnan(v["ret"]) | np.isnan(v["ref"]), np.nan, v[k]) for k in ("ret", "ref")} if {"rolling_corr", "rolling_cov", "rolling_beta"} & {*metrics} else {}
    a, b = (Windows(both[k], n) for k in ("ret", "ref")) if both else (None, None)
    now = x.w[:, -1]
    lagged = lambda: (Windows(np.where(np.isnan(v["x1"]), np.nan, v["x"]), n), Windows(np.where(np.isnan(v["x"]), np.nan, v["x1"]), n))
    volatility = functools.cache(lambda: np.sqrt(Windows(v["lr"], n).var))
    every = {
        "rolling_mean": lambda: x.mean, "rolling_std": lambda: np.sqrt(x.var), "rolling_var": lambda: x.var, "rolling_skewness": x.skewness, "rolling_kurtosis": x.kurtosis,
        "rolling_zscore": lambda: ratio(now - x.mean, np.sqrt(x.var)), "rolling_min": lambda: x.low, "rolling_max": lambda: x.high, "rolling_range": lambda: x.high - x.low,
        "rolling_quantile_25": lambda: x.quantile(0.25), "rolling_quantile_75": lambda: x.quantile(0.75), "rolling_iqr": lambda: x.quantile(0.75) - x.quantile(0.25),
        "rolling_autocorr": lambda: (lambda p: p[0].correlation(p[1]))(lagged()), "rolling_entropy": lambda: x.entropy(bins), "rolling_drawdown": lambda: ratio(now, x.high) - 1,
        "rolling_volatility": volatility, "realized_volatility": lambda: volatility() * np.sqrt(n),
        "rolling_corr": lambda: a.correlation(b), "rolling_cov": lambda: a.covariance(b), "rolling_beta": lambda: ratio(a.covariance(b), Windows(v["ref"], n).var),
    }
    return {m: every[m]() for m in metrics}


def by_block(v: dict[str, np.ndarray], n: int, names: tuple, work: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """What work() makes of all windows of n rows, a block of windows at a time; rows before the first have nothing."""
    size = len(next(iter(v.values())))
    out = {m: np.full(size, np.nan) for m in names}
    step = max(1, _HELD // n)
    for last in range(n - 1, size, step):
        stop = min(size, last + step)
        for m, found in work({k: c[last - n + 1 : stop] for k, c in v.items()}).items():
            out[m][last:stop] = found
    return out


def arrow_pass(df: DataFrame, s: Series, inputs: list[str], made: list[str], work: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]]) -> DataFrame:
    """df with the double columns that work() makes of each series' rows in order; other columns pass through as they are."""
    schema = df.select(*df.columns, *[F.lit(None).cast("double").alias(c) for c in made]).schema
    order = [(c, "ascending") for c in s.order]

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by(order)
        with np.errstate(all="ignore"):
            found = work({c: t[c].cast(pa.float64()).to_numpy() for c in inputs})
        for c in made:
            t = t.append_column(c, pa.array(found[c], pa.float64(), mask=~np.isfinite(found[c])))
        return t

    return df.groupBy(*s.keys).applyInArrow(run, schema)


#: What _window_metrics() takes, by the columns of with_inputs().
INPUTS = {"x": "_x", "x1": "_x1", "lr": "_lr", "ret": "_ret", "ref": "_ref"}


def with_inputs(df: DataFrame, s: Series, column: str, reference: str | None = None) -> DataFrame:
    """df with the columns of INPUTS."""
    x, reference = F.col(column), reference or column
    rows = df.withColumns({"_x": x, "_x1": s.lag(column), "_r1": s.lag(reference)})
    return rows.withColumns({"_lr": log_return(x, F.col("_x1")), "_ret": simple_return(x, F.col("_x1")), "_ref": simple_return(F.col(reference), F.col("_r1"))}).drop("_r1")


def every_window(p: dict[str, np.ndarray], column: str, windows: tuple, metrics: tuple, bins: int = BINS) -> dict[str, np.ndarray]:
    """{column}__{metric}_{n} of a series' rows from the columns of INPUTS."""
    v, out = {k: p[c] for k, c in INPUTS.items()}, {}
    for n in windows:
        found = by_block(v, n, metrics, lambda part, n=n: _window_metrics(part, n, bins, metrics))
        out |= {f"{column}__{m}_{n}": found[m] for m in metrics}
    return out


def rolling_metrics(df: DataFrame, s: Series, column: str, windows: tuple = WINDOWS, reference: str | None = None, bins: int = BINS, metrics: tuple = METRICS) -> DataFrame:
    """df with the metrics of one column for every window; reference (the column itself) is for corr, cov and beta.

    Frames of built-in aggregates where these are all that is asked for: Spark computes a frame's aggregate anew for every
    row. Moments, quantiles, entropies and pairs come from one Arrow pass, a block of windows at a time.
    """
    reference = reference or column
    x = F.col(column)
    if {*metrics} <= {*FRAMED}:
        made: dict[str, Column] = {}
        need = {"mean": F.avg(x), "std": F.stddev_samp(x), "var": F.var_samp(x), "min": F.min(x), "max": F.max(x)}
        of = {"zscore": ("mean", "std"), "range": ("min", "max"), "drawdown": ("max",)}
        used = {k for m in metrics for k in of.get(m.removeprefix("rolling_"), (m.removeprefix("rolling_"),))}
        for n in windows:
            w = s.last(n)
            made |= {f"_n_{n}": F.count(x).over(w)} | {f"_{k}_{n}": need[k].over(w) for k in used}
        rows = df.withColumns(made)
        out = {}
        for n in windows:
            c = lambda k: F.col(f"_{k}_{n}")  # noqa: B023, E731
            every = {"zscore": lambda: div(x - c("mean"), c("std")), "range": lambda: c("max") - c("min"), "drawdown": lambda: div(x, c("max")) - 1}
            out |= {f"{column}__{m}_{n}": F.when(c("n") >= n, every.get(k, lambda: c(k))()) for m in metrics for k in [m.removeprefix("rolling_")]}  # noqa: B023
        return rows.withColumns(out).drop(*made)
    names = [f"{column}__{m}_{n}" for n in windows for m in metrics]
    work = lambda p: every_window(p, column, windows, metrics, bins)
    return arrow_pass(with_inputs(df, s, column, reference), s, list(INPUTS.values()), names, work).drop(*INPUTS.values())


def safe_returns(df: DataFrame, s: Series, column: str, method: str = "pct", name: str = "returns") -> DataFrame:
    """Simple (pct) or log returns; null where they aren't finite. Gaps aren't filled first."""
    if method not in {"pct", "log"}:
        raise ValueError("method must be pct or log")
    made = {"pct": simple_return, "log": log_return}[method]
    return df.withColumn(name, made(F.col(column), s.lag(column)))


def compute_rolling(df: DataFrame, s: Series, column: str, metric: str, window: int, min_periods: int | None = None, lag: int = 1, bins: int = BINS, reference: str | None = None, name: str | None = None) -> DataFrame:
    """One statistic with min_periods: mean, std, zscore, iqr, autocorr, drawdown, entropy or beta."""
    x, name, least = F.col(column), name or f"rolling_{metric}", window if min_periods is None else min_periods
    w = s.last(window)
    enough = F.count(x).over(w) >= least
    if metric in {"mean", "std"}:
        return df.withColumn(name, F.when(enough, (F.avg if metric == "mean" else F.stddev_samp)(x).over(w)))
    if metric == "zscore":
        return df.withColumn(name, F.when(enough, div(x - F.avg(x).over(w), F.stddev_samp(x).over(w))))
    if metric == "drawdown":
        return df.withColumn(name, F.when(enough, div(x, F.max(x).over(w)) - 1))
    if metric == "iqr":
        q = F.percentile(x, F.array(F.lit(0.25), F.lit(0.75))).over(w)
        return df.withColumn("_q", F.when(enough, q)).withColumn(name, F.get("_q", F.lit(1)) - F.get("_q", F.lit(0))).drop("_q")
    if metric == "entropy":
        return df.withColumn("_v", F.when(enough, F.sort_array(F.collect_list(x).over(w)))).withColumn(name, entropy(F.col("_v"), bins)).drop("_v")
    if metric == "autocorr":
        rows = df.withColumn("_l", s.lag(column, lag))
        return rows.withColumn(name, pair_stats(s, x, F.col("_l"), window, least)[0]).drop("_l")
    if metric == "beta":
        y = F.col(reference)
        return df.withColumn(name, div(pair_stats(s, x, y, window, least)[1], F.when(F.count(y).over(w) >= least, F.var_samp(y).over(w))))
    raise ValueError(f"unknown metric {metric}")


# --- invariants --------------------------------------------------------------------------------------------

INVARIANTS = ("zscore", "robust_zscore", "local_ratio", "log_ratio", "relative_change", "rolling_energy", "normalized_energy", "minmax_position")


def invariants(df: DataFrame, s: Series, column: str, window: int = 20, periods: int = 1, reference: str | None = None, prefix: str = "", eps: float = EPS) -> DataFrame:
    """df with {prefix}{column}_{name} for each of INVARIANTS.

    robust_zscore is the distance to the window's median over MAD_SCALE times its median absolute deviation, 0 where
    that is 0; log_ratio is against the reference column, else the window's mean; normalized_energy is the window's
    mean square over its variance plus squared mean scale (1 + variance).
    """
    x, w = F.col(column), s.last(window)
    full = F.count(x).over(w) >= window
    rows = df.withColumns({
        "_mean": F.when(full, F.avg(x).over(w)), "_std": F.when(full, F.stddev_samp(x).over(w)), "_abs": F.when(full, F.avg(F.abs(x)).over(w)),
        "_e": F.when(full, F.sum(x * x).over(w)), "_lo": F.when(full, F.min(x).over(w)), "_hi": F.when(full, F.max(x).over(w)),
        "_sorted": F.when(full, F.sort_array(F.collect_list(x).over(w))), "_lag": s.lag(column, periods),
    })
    rows = rows.withColumn("_med", quantile(F.col("_sorted"), window, 0.5))
    rows = rows.withColumn("_mad", quantile(F.sort_array(F.transform("_sorted", lambda v: F.abs(v - F.col("_med")))), window, 0.5))
    ref = F.abs(F.col(reference)) if reference else F.abs(F.col("_mean"))
    made = {
        "zscore": div(x - F.col("_mean"), F.col("_std")),
        "robust_zscore": F.when(F.col("_mad") == 0, 0.0).otherwise(div(x - F.col("_med"), F.col("_mad") * MAD_SCALE)),
        "local_ratio": div(x, F.col("_abs")),
        "log_ratio": F.ln((F.abs(x) + eps) / (ref + eps)),
        "relative_change": div(x - F.col("_lag"), F.abs(F.col("_lag"))),
        "rolling_energy": F.col("_e"),
        "normalized_energy": div(F.col("_e") / window, 1 + F.col("_std") * F.col("_std")),
        "minmax_position": (x - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + eps),
    }
    rows = rows.withColumns({f"{prefix}{column}_{k}": v for k, v in made.items()})
    return rows.drop("_mean", "_std", "_abs", "_e", "_lo", "_hi", "_sorted", "_lag", "_med", "_mad")


def numeric_columns(df: DataFrame, excluded: tuple = ()) -> list[str]:
    """Columns of numeric type that aren't excluded."""
    kinds = ("tinyint", "smallint", "int", "bigint", "float", "double")
    return [c for c, t in df.dtypes if c not in excluded and (t in kinds or t.startswith("decimal"))]


def add_invariant_features(df: DataFrame, s: Series, columns: list[str], window: int = 20, prefix: str = "inv_") -> DataFrame:
    """Invariants of several columns; missing and non-numeric ones are skipped."""
    for c in [c for c in columns if c in numeric_columns(df)]:
        df = invariants(df, s, c, window, prefix=prefix)
    return df


# --- dynamics ----------------------------------------------------------------------------------------------


def dynamics(df: DataFrame, s: Series, column: str, periods: int = 1, prefix: str = "") -> DataFrame:
    """velocity, acceleration and jerk (first to third differences) and curvature a / (1 + v^2)^1.5."""
    names = [f"{prefix}{k}" for k in ("velocity", "acceleration", "jerk", "curvature")]
    x = [s.lag(column, k * periods) if k else F.col(column) for k in range(4)]
    v, a = x[0] - x[1], x[0] - 2 * x[1] + x[2]
    df = df.withColumns({names[0]: v, names[1]: a, names[2]: x[0] - 3 * x[1] + 3 * x[2] - x[3]})
    return df.withColumn(names[3], F.col(names[1]) / F.pow(1 + F.col(names[0]) * F.col(names[0]), 1.5))


def add_dynamics_features(df: DataFrame, s: Series, columns: list[str], prefix: str = "dyn_") -> DataFrame:
    for c in [c for c in columns if c in numeric_columns(df)]:
        df = dynamics(df, s, c, prefix=f"{prefix}{c}_")
    return df


# --- whole series ------------------------------------------------------------------------------------------


def summarize_series(df: DataFrame, keys: list[str], column: str, order: tuple[str, ...]) -> DataFrame:
    """One row a series: count, mean, std, var, skewness, kurtosis, zscore of the last value, min, max, last.

    One value has std and var 0; fewer than three have skewness 0, fewer than four kurtosis 0. Nulls don't count.
    """
    x = F.col(column)
    n = F.count(x)
    at = F.when(x.isNotNull(), F.struct(*order))
    g = df.groupBy(*keys).agg(n.alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("_std"), F.var_samp(x).alias("_var"), F.skewness(x).alias("_g1"), F.kurtosis(x).alias("_g2"), F.min(x).alias("min"), F.max(x).alias("max"), F.max_by(x, at).alias("last"))
    n, some = F.col("count").cast("double"), F.col("count") > 0
    one = lambda c: F.when(some, F.when(n >= 2, F.col(c)).otherwise(0.0))
    g = g.withColumns({"std": one("_std"), "var": one("_var")})
    skew = F.when(n >= 3, sample_skewness(n, F.col("_g1"), F.col("min"), F.col("max"))).otherwise(0.0)
    kurt = F.when(n >= 4, F.when(F.col("min") == F.col("max"), 0.0).otherwise(sample_kurtosis(n, F.col("_g2"), F.col("min"), F.col("max")))).otherwise(0.0)
    z = F.when((n >= 2) & (F.col("std") > 0), (F.col("last") - F.col("mean")) / F.col("std")).otherwise(0.0)
    return g.withColumns({"skewness": F.when(some, skew), "kurtosis": F.when(some, kurt), "zscore": F.when(some, z)}).select(*keys, "count", "mean", "std", "var", "skewness", "kurtosis", "zscore", "min", "max", "last")


def last_valid(df: DataFrame, keys: list[str], columns: list[str], order: tuple[str, ...]) -> DataFrame:
    """The last non-null value of each column, one row a series."""
    return df.groupBy(*keys).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(*order))).alias(c) for c in columns])


def summarize_frame(df: DataFrame, keys: list[str], columns: list[str], order: tuple[str, ...], prefix: str = "") -> DataFrame:
    """{prefix}{column}_{mean, std, min, max, first, last, delta, median} for each column."""
    aggs = []
    for c in columns:
        at = F.when(F.col(c).isNotNull(), F.struct(*order))
        first, last = F.min_by(c, at), F.max_by(c, at)
        made = {"mean": F.avg(c), "std": F.stddev_samp(c), "min": F.min(c), "max": F.max(c), "first": first, "last": last, "delta": last - first, "median": F.median(c)}
        aggs += [v.alias(f"{prefix}{c}_{k}") for k, v in made.items()]
    return df.groupBy(*keys).agg(*aggs)
