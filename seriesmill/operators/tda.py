"""Distances between neighbouring windows, regimes with hysteresis, and persistence of point clouds."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import log_return
from ..series import CHUNK_ROWS, Series, carry_forward
from .recursive import grouped


def rolling_wasserstein_profile(df: DataFrame, s: Series, column: str, window: int = 20, p: float = 1.0, name: str = "wasserstein") -> DataFrame:
    """Wasserstein distance of order p between the last `window` values and those before them; null until there are both."""
    if p <= 0:
        raise ValueError("p must be > 0")
    if window <= 0:
        raise ValueError("window must be > 0")
    old = s.window.rowsBetween(1 - 2 * window, -window)
    df = df.withColumns({"_new": F.sort_array(s.values(column, window)), "_old": F.when(F.count(column).over(old) == window, F.sort_array(F.collect_list(column).over(old)))})
    power = F.aggregate(F.zip_with("_new", "_old", lambda a, b: F.pow(F.abs(a - b), F.lit(float(p)))), F.lit(0.0), lambda a, v: a + v) / window
    return df.withColumn(name, F.pow(power, F.lit(1.0 / p))).drop("_new", "_old")


def wasserstein_distances(df: DataFrame, s: Series, column: str = "close", window: int = 20, use_log_returns: bool = True, p: float = 1.0) -> DataFrame:
    """wasserstein, and wasserstein_position: the sign of the mean's change where the distance exceeds its own mean of the window."""
    df = df.withColumn("_x", log_return(F.col(column), s.lag(column)) if use_log_returns else F.col(column))
    df = rolling_wasserstein_profile(df, s, "_x", window, p)
    df = df.withColumns({"_m": s.mean("_x", window), "_w": s.mean("wasserstein", window)})
    df = df.withColumn("_before", s.lag("_m", window))
    way = F.signum(F.col("_m") - F.col("_before"))
    return df.withColumn("wasserstein_position", F.when(F.col("wasserstein") > F.col("_w"), F.coalesce(way, F.lit(0.0))).otherwise(0.0)).drop("_x", "_m", "_w", "_before")


def wasserstein_regime_signal(df: DataFrame, s: Series, column: str, high_on: float = 80, high_off: float = 60, low_on: float = 20, low_off: float = 40, name: str = "regime_signal", chunk_rows: int = CHUNK_ROWS, bucket: Column | None = None) -> DataFrame:
    """1 from high_on until high_off, -1 from low_on until low_off, else 0: set and reset events carried forward."""
    if high_on <= high_off:
        raise ValueError("high_on must be greater than high_off")
    if low_on >= low_off:
        raise ValueError("low_off must be greater than low_on")
    x = F.col(column)
    events = {"_high": F.when(x >= high_on, 1).when(x <= high_off, 0), "_low": F.when(x <= low_on, 1).when(x >= low_off, 0)}
    df = carry_forward(df, s, events, chunk_rows, bucket)
    return df.withColumn(name, F.coalesce("_high", F.lit(0)) - F.coalesce("_low", F.lit(0))).drop("_high", "_low")


def has_ripser() -> bool:
    """Whether a faster persistence library is installed; nothing here needs it."""
    from importlib.util import find_spec

    return find_spec("ripser") is not None


def spanning_edges(points: np.ndarray) -> np.ndarray:
    """Lengths of a least spanning tree, ascending: deaths of the components of a growing point cloud."""
    n = len(points)
    best, used, out = np.full(n, np.inf), np.zeros(n, bool), []
    at = 0
    for _ in range(n - 1):
        used[at] = True
        best = np.minimum(best, np.sqrt(((points - points[at]) ** 2).sum(1)))
        best[used] = np.inf
        at = int(best.argmin())
        out.append(best[at])
    return np.sort(np.array(out))


def loops(points: np.ndarray) -> np.ndarray:
    """(birth, death) of the loops of a growing point cloud (Vietoris-Rips, coefficients modulo 2).

    An edge that closes a loop bears it; the first triangle whose boundary, reduced by those before it, ends at that
    edge fills it. Loops that are filled as they are born are left out. For clouds of up to some hundred points: there
    are as many triangles as triples.
    """
    n = len(points)
    far = np.sqrt(((points[:, None, :] - points[None, :, :]) ** 2).sum(2))
    i, j = np.triu_indices(n, 1)
    order = np.argsort(far[i, j], kind="stable")
    i, j = i[order], j[order]
    length, number = far[i, j], np.zeros((n, n), np.int64)
    number[i, j] = number[j, i] = np.arange(len(i))
    part, open_ = np.arange(n), set()
    for e, (a, b) in enumerate(zip(i, j)):
        if part[a] == part[b]:
            open_.add(e)
        else:
            part[part == part[b]] = part[a]
    corners = np.array(list(itertools.combinations(range(n), 3)), np.int64).reshape(-1, 3)
    sides = np.sort(np.stack([number[corners[:, x], corners[:, y]] for x, y in ((0, 1), (0, 2), (1, 2))], 1), axis=1)
    lowest: dict[int, set[int]] = {}
    out = []
    for k in np.argsort(sides[:, 2], kind="stable"):
        if not open_:
            break
        column = set(sides[k].tolist())
        while column and (low := max(column)) in lowest:
            column = column ^ lowest[low]
        if column:
            lowest[low] = column
            open_.discard(low)
            if length[sides[k, 2]] > length[low]:
                out.append((length[low], length[sides[k, 2]]))
    return np.array(sorted(out)).reshape(-1, 2)


def compute_persistence_diagram(points: np.ndarray, max_dim: int = 0) -> list[np.ndarray]:
    """(birth, death) arrays of components (dimension 0) and, for max_dim 1, of loops; higher dimensions are an error."""
    points = np.asarray(points, float)
    if points.ndim != 2 or len(points) < 2:
        raise ValueError("points must be two-dimensional with at least two rows")
    if max_dim not in {0, 1}:
        raise ValueError("max_dim must be 0 or 1")
    deaths = spanning_edges(points)
    zero = np.c_[np.zeros(len(deaths) + 1), np.append(deaths, np.inf)]
    return [zero, loops(points)][: max_dim + 1]


def persistence_entropy(bars: DataFrame, keys: list[str]) -> DataFrame:
    """bars (keys, birth, death) -> entropy -sum(p ln p) of finite lifetimes; 0 where there are none."""
    life = F.when(F.col("death") < float("inf"), F.col("death") - F.col("birth"))
    life = F.when(life > 0, life)
    g = bars.groupBy(*keys).agg(F.sum(life).alias("_t"), F.sum(life * F.ln(life)).alias("_s"))
    return g.select(*keys, F.coalesce(F.ln("_t") - F.try_divide("_s", "_t"), F.lit(0.0)).alias("entropy"))


def _profile(x: np.ndarray, window: int, dim: int, delay: int, max_dim: int = 0) -> np.ndarray:
    out = np.zeros(len(x))
    for t in range(window - 1, len(x)):
        w = x[t - window + 1 : t + 1]
        if np.isnan(w).any():
            continue
        n = window - (dim - 1) * delay
        if n >= 2:
            cloud = np.stack([w[i * delay : i * delay + n] for i in range(dim)], 1)
            out[t] = spanning_edges(cloud).sum() + (np.diff(loops(cloud), axis=1).sum() if max_dim else 0.0)
    return out


def rolling_persistence_profile(df: DataFrame, s: Series, column: str, window: int = 30, embed_dim: int = 2, embed_delay: int = 1, normalize_to_100: bool = True, span: int = 200, name: str = "persistence", max_dim: int = 0) -> DataFrame:
    """Total persistence of the delay embedding of each window, with max_dim 1 loops included; 0 where a window isn't full.

    With normalize_to_100 it is 100 times its share of the greatest in the last `span` rows, so the operator looks back
    over window + span rows and can run in chunks.
    """
    if window < 2 or embed_dim < 1 or embed_delay < 1 or window <= (embed_dim - 1) * embed_delay + 1:
        raise ValueError("window must hold at least two embedded points; embed_dim and embed_delay must be positive")
    if max_dim not in {0, 1}:
        raise ValueError("max_dim must be 0 or 1")

    def work(p: pd.DataFrame) -> dict[str, pd.Series]:
        return {name: pd.Series(_profile(p[column].to_numpy(float), window, embed_dim, embed_delay, max_dim), p.index)}

    df = grouped(df, s, [column], [name], work)
    if not normalize_to_100:
        return df
    top = F.max(name).over(s.last(span))
    return df.withColumn("_top", top).withColumn(name, F.when(F.col("_top") > 0, 100 * F.col(name) / F.col("_top")).otherwise(0.0)).drop("_top")
