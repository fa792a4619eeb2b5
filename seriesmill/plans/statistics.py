"""Queries of rolling statistics, invariants, dynamics, summaries and regimes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import regimes, rolling
from ..series import bounded
from .inputs import BARS, BARS_SQL, DAYS, DAYS_SQL, POINTS, POINTS_SQL, S_BARS, S_DAYS, S_POINTS, bars, finish, order_days, points, query, r, rounded

WINDOWS = rolling.WINDOWS
w, full = S_POINTS.w, S_POINTS.full
P = "series, event_id"


def _metrics(metrics: tuple):
    def build(spark, sf_dir):
        df = points(spark, sf_dir)
        out = bounded(df, POINTS, max(WINDOWS) + 1, lambda d, s: rolling.rolling_metrics(d, s, "value", WINDOWS, metrics=metrics))
        return finish(out, "series", "event_id", *[f"value__{m}_{n}" for n in WINDOWS for m in metrics])

    return build


def _each(make) -> str:
    """Columns of all windows: make(n) gives {metric: SQL}."""
    return ", ".join(rounded({f"value__{k}_{n}": x for k, x in make(n).items()}) for n in WINDOWS)


def _moments(n: int) -> dict[str, str]:
    flat = f"min(value) {w(n)} = max(value) {w(n)}"
    guard = f"count(value) {w(n)} >= {n}"
    return {
        "rolling_mean": S_POINTS.avg("value", n), "rolling_std": S_POINTS.std("value", n), "rolling_var": full("value", n, "var_samp(value)"),
        "rolling_skewness": f"CASE WHEN {guard} THEN CASE WHEN {flat} THEN 0 ELSE skewness(value) {w(n)} END END",
        "rolling_kurtosis": f"CASE WHEN {guard} THEN CASE WHEN {flat} THEN -3 ELSE kurtosis(value) {w(n)} END END",
        "rolling_zscore": f"CASE WHEN {guard} THEN (value - avg(value) {w(n)}) / nullif(stddev_samp(value) {w(n)}, 0) END",
    }


query("stat_moments", f"WITH {POINTS_SQL} SELECT {P}, {_each(_moments)} FROM points")(_metrics(tuple(_moments(2))))


def _range(n: int) -> dict[str, str]:
    low, high = S_POINTS.min("value", n), S_POINTS.max("value", n)
    return {"rolling_min": low, "rolling_max": high, "rolling_range": f"({high}) - ({low})", "rolling_drawdown": f"value / nullif({high}, 0) - 1"}


query("stat_range", f"WITH {POINTS_SQL} SELECT {P}, {_each(_range)} FROM points")(_metrics(tuple(_range(2))))


def _quantiles(n: int) -> dict[str, str]:
    q = lambda p: full("value", n, f"quantile_cont(value, {p})")
    v, b = f"v_{n}", rolling.BINS
    low, high = f"list_min({v})", f"list_max({v})"
    at = f"list_transform({v}, lambda x: least(floor((x - {low}) / ({high} - {low}) * {b}), {b - 1}))"
    part = f"(len(list_filter({at}, lambda y: y = b)) / {n}.0)"
    total = f"list_sum(list_transform(range({b}), lambda b: CASE WHEN {part} > 0 THEN -{part} * ln({part}) ELSE 0 END))"
    return {"rolling_quantile_25": q(0.25), "rolling_quantile_75": q(0.75), "rolling_iqr": f"({q(0.75)}) - ({q(0.25)})", "rolling_entropy": f"CASE WHEN {v} IS NOT NULL THEN CASE WHEN {low} = {high} THEN 0 ELSE {total} END END"}


_lists = ", ".join(f"{full('value', n, 'list(value)')} AS v_{n}" for n in WINDOWS)
query("stat_quantiles", f"WITH {POINTS_SQL}, listed AS (SELECT *, {_lists} FROM points) SELECT {P}, {_each(_quantiles)} FROM listed")(_metrics(tuple(_quantiles(2))))


def _pair(s, x: str, y: str, n: int) -> tuple[str, str]:
    a, b = f"CASE WHEN {y} IS NOT NULL THEN {x} END", f"CASE WHEN {x} IS NOT NULL THEN {y} END"
    guard = f"count({a}) {s.w(n)} >= {n}"
    cov = f"covar_samp({a}, {b}) {s.w(n)}"
    return f"CASE WHEN {guard} THEN {cov} / nullif(stddev_samp({a}) {s.w(n)} * stddev_samp({b}) {s.w(n)}, 0) END", f"CASE WHEN {guard} THEN {cov} END"


def _returns(n: int) -> dict[str, str]:
    return {"rolling_volatility": S_POINTS.std("lr", n), "realized_volatility": f"({S_POINTS.std('lr', n)}) * sqrt({n})", "rolling_autocorr": _pair(S_POINTS, "value", "x1", n)[0]}


_LR = "CASE WHEN value > 0 AND x1 > 0 THEN ln(value / x1) END AS lr"
query("stat_returns", f"WITH {POINTS_SQL}, a AS (SELECT *, {S_POINTS.lag('value')} AS x1 FROM points), b AS (SELECT *, {_LR} FROM a) SELECT {P}, {_each(_returns)} FROM b")(_metrics(tuple(_returns(2))))


def _reference(n: int) -> dict[str, str]:
    corr, cov = _pair(S_DAYS, "ret", "ref", n)
    return {"rolling_corr": corr, "rolling_cov": cov, "rolling_beta": f"({cov}) / nullif({S_DAYS.full('ref', n, 'var_samp(ref)')}, 0)"}


@query("stat_reference", f"""
WITH {DAYS_SQL}, a AS (SELECT *, value / nullif({S_DAYS.lag('value')}, 0) - 1 AS ret, reference / nullif({S_DAYS.lag('reference')}, 0) - 1 AS ref FROM days)
SELECT series, day, {_each(_reference)} FROM a""")
def stat_reference(spark, sf_dir):
    metrics = tuple(_reference(2))
    out = bounded(order_days(spark, sf_dir), DAYS, max(WINDOWS) + 1, lambda d, s: rolling.rolling_metrics(d, s, "value", WINDOWS, "reference", metrics=metrics))
    return finish(out, "series", "day", *[f"value__{m}_{n}" for n in WINDOWS for m in metrics])


@query("stat_min_periods", f"""
WITH {POINTS_SQL}, a AS (SELECT *, {S_POINTS.lag('value', 2)} AS x2, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS gap FROM points)
SELECT {P}, {rounded({'gap_mean': full('gap', 20, 'avg(gap)', 5), 'gap_std': full('gap', 20, 'stddev_samp(gap)', 5), 'gap_iqr': f"({full('gap', 20, 'quantile_cont(gap, 0.75)', 5)}) - ({full('gap', 20, 'quantile_cont(gap, 0.25)', 5)})", 'gap_drawdown': f"gap / nullif({full('gap', 20, 'max(gap)', 5)}, 0) - 1"})} FROM a""")
def stat_min_periods(spark, sf_dir):
    df = points(spark, sf_dir).withColumn("gap", F.when(F.col("event_id") % 3 != 0, F.col("value")))

    def run(d, s):
        for m in ("mean", "std", "iqr", "drawdown"):
            d = rolling.compute_rolling(d, s, "gap", m, 20, 5, name=f"gap_{m}")
        return d

    return finish(bounded(df, POINTS, 20, run), "series", "event_id", "gap_mean", "gap_std", "gap_iqr", "gap_drawdown")


N = 20
_MED = full("value", N, "median(value)")
_INV = {
    "zscore": "(value - m) / nullif(sd, 0)", "robust_zscore": "CASE WHEN mad = 0 THEN 0 ELSE (value - med) / (mad * 1.4826) END", "local_ratio": "value / nullif(ma, 0)",
    "log_ratio": "CASE WHEN m IS NOT NULL THEN ln((abs(value) + 1e-12) / (abs(m) + 1e-12)) END", "relative_change": "(value - x1) / nullif(abs(x1), 0)", "rolling_energy": "e",
    "normalized_energy": f"(e / {N}) / (1 + sd * sd)", "minmax_position": "(value - lo) / (hi - lo + 1e-12)",
}


@query("inv_features", f"""
WITH {POINTS_SQL}, a AS (SELECT *, {S_POINTS.avg('value', N)} AS m, {S_POINTS.std('value', N)} AS sd, {S_POINTS.avg('abs(value)', N)} AS ma, {S_POINTS.sum('value * value', N)} AS e, {S_POINTS.min('value', N)} AS lo,
  {S_POINTS.max('value', N)} AS hi, {_MED} AS med, {full('value', N, 'list(value)')} AS v, {S_POINTS.lag('value')} AS x1 FROM points),
b AS (SELECT *, CASE WHEN v IS NOT NULL THEN list_median(list_transform(v, lambda x: abs(x - med))) END AS mad FROM a)
SELECT {P}, {rounded({f'value_{k}': x for k, x in _INV.items()})} FROM b""")
def inv_features(spark, sf_dir):
    out = bounded(points(spark, sf_dir), POINTS, N, lambda d, s: rolling.invariants(d, s, "value", N))
    return finish(out, "series", "event_id", *[f"value_{k}" for k in rolling.INVARIANTS])


@query("dyn_features", f"""
WITH {POINTS_SQL}, a AS (SELECT *, {', '.join(f"{S_POINTS.lag('value', k)} AS x{k}" for k in (1, 2, 3))} FROM points)
SELECT {P}, {rounded({'velocity': 'value - x1', 'acceleration': 'value - 2 * x1 + x2', 'jerk': 'value - 3 * x1 + 3 * x2 - x3', 'curvature': '(value - 2 * x1 + x2) / pow(1 + (value - x1) * (value - x1), 1.5)'})} FROM a""")
def dyn_features(spark, sf_dir):
    out = bounded(points(spark, sf_dir), POINTS, 3, lambda d, s: rolling.dynamics(d, s, "value"))
    return finish(out, "series", "event_id", "velocity", "acceleration", "jerk", "curvature")


@query("series_summary", f"""
SELECT user_id, count(value) AS count, {rounded({'mean': 'avg(value)', 'std': 'CASE WHEN count(value) < 2 THEN 0 ELSE stddev_samp(value) END', 'var': 'CASE WHEN count(value) < 2 THEN 0 ELSE var_samp(value) END',
  'skewness': 'CASE WHEN count(value) < 3 OR min(value) = max(value) THEN 0 ELSE skewness(value) END', 'kurtosis': 'CASE WHEN count(value) < 4 OR min(value) = max(value) THEN 0 ELSE kurtosis(value) END',
  'zscore': 'CASE WHEN count(value) < 2 OR stddev_samp(value) = 0 THEN 0 ELSE (last(value ORDER BY ts, event_id) - avg(value)) / stddev_samp(value) END', 'min': 'min(value)', 'max': 'max(value)', 'last': 'last(value ORDER BY ts, event_id)'})}
FROM events GROUP BY user_id""")
def series_summary(spark, sf_dir):
    from .inputs import table

    return finish(rolling.summarize_series(table(spark, sf_dir, "events"), ["user_id"], "value", ("ts", "event_id")))


_FRAME = {"mean": "avg({c})", "std": "stddev_samp({c})", "min": "min({c})", "max": "max({c})", "first": "first({c} ORDER BY bar)", "last": "last({c} ORDER BY bar)", "delta": "last({c} ORDER BY bar) - first({c} ORDER BY bar)", "median": "median({c})"}


@query("frame_summary", f"WITH {BARS_SQL} SELECT symbol, {rounded({f'sec_{c}_{k}': x.format(c=c) for c in ('close', 'volume') for k, x in _FRAME.items()})} FROM bars GROUP BY symbol")
def frame_summary(spark, sf_dir):
    return finish(rolling.summarize_frame(bars(spark, sf_dir), ["symbol"], ["close", "volume"], ("bar",), "sec_"))


@query("series_last_valid", f"WITH {BARS_SQL} SELECT symbol, {rounded({c: f'last({c} ORDER BY bar)' for c in ('open', 'high', 'low', 'close', 'volume')})} FROM bars GROUP BY symbol")
def series_last_valid(spark, sf_dir):
    return finish(rolling.last_valid(bars(spark, sf_dir), ["symbol"], ["open", "high", "low", "close", "volume"], ("bar",)))


# --- regimes -----------------------------------------------------------------------------------------------


def label_sql(z: str, vol: str, dd: str, q1: str, q3: str) -> str:
    return f"""CASE WHEN {z} <= -3 THEN 'extreme_negative_outlier' WHEN {z} >= 3 THEN 'extreme_positive_outlier' WHEN {z} <= -2 THEN 'negative_outlier' WHEN {z} >= 2 THEN 'positive_outlier'
  WHEN {dd} <= -0.10 THEN 'drawdown_pressure' WHEN {vol} < {q1} THEN 'low_volatility_compression' WHEN {vol} > {q3} THEN 'high_volatility' ELSE 'normal' END"""


def regime_sql(base: str, source: str, s, column: str) -> str:
    """CTEs up to `regime`, with z_n, vol_n, dd_n and label_n of a column for every window."""
    lag = f"l1 AS (SELECT *, {s.lag(column)} AS x1 FROM {source})"
    ret = f"l2 AS (SELECT *, CASE WHEN {column} > 0 AND x1 > 0 THEN ln({column} / x1) END AS lr FROM l1)"
    one = ", ".join(f"CASE WHEN count({column}) {s.w(n)} >= {n} THEN ({column} - avg({column}) {s.w(n)}) / nullif(stddev_samp({column}) {s.w(n)}, 0) END AS z_{n}, {s.std('lr', n)} AS vol_{n}, {column} / nullif({s.max(column, n)}, 0) - 1 AS dd_{n}" for n in WINDOWS)
    two = ", ".join(f"{s.full(f'vol_{n}', n, f'quantile_cont(vol_{n}, 0.25)')} AS q1_{n}, {s.full(f'vol_{n}', n, f'quantile_cont(vol_{n}, 0.75)')} AS q3_{n}" for n in WINDOWS)
    three = ", ".join(f"{label_sql(f'z_{n}', f'vol_{n}', f'dd_{n}', f'q1_{n}', f'q3_{n}')} AS label_{n}" for n in WINDOWS)
    return f"{base}, {lag}, {ret}, l3 AS (SELECT *, {one} FROM l2), l4 AS (SELECT *, {two} FROM l3), regime AS (SELECT *, {three} FROM l4)"


_REG = ", ".join(rounded({f"value__zscore_{n}": f"z_{n}", f"value__volatility_{n}": f"vol_{n}", f"value__drawdown_{n}": f"dd_{n}"}) + f", label_{n} AS value__regime_{n}" for n in WINDOWS)


@query("regime_labels", f"WITH {regime_sql(POINTS_SQL, 'points', S_POINTS, 'value')} SELECT {P}, {_REG} FROM regime")
def regime_labels(spark, sf_dir):
    out = bounded(points(spark, sf_dir), POINTS, 2 * max(WINDOWS) + 1, lambda d, s: regimes.classify_series(d, s, "value", WINDOWS))
    return finish(out, "series", "event_id", *[f"value__{k}_{n}" for n in WINDOWS for k in ("zscore", "volatility", "drawdown", "regime")])


_LAST = ", ".join(f"{r(f'last(z_{n} ORDER BY bar) FILTER (z_{n} IS NOT NULL)')} AS close__zscore_{n}, {r(f'last(vol_{n} ORDER BY bar) FILTER (vol_{n} IS NOT NULL)')} AS close__volatility_{n}, {r(f'last(dd_{n} ORDER BY bar) FILTER (dd_{n} IS NOT NULL)')} AS close__drawdown_{n}, last(label_{n} ORDER BY bar) AS close__regime_{n}" for n in WINDOWS)


@query("flagship_regimes", f"WITH {regime_sql(BARS_SQL, 'bars', S_BARS, 'close')} SELECT symbol, {_LAST} FROM regime GROUP BY symbol")
def flagship_regimes(spark, sf_dir):
    """Hourly bars, rolling statistics of the close, and the last values and regimes of each series."""
    return finish(regimes.last_regimes(bars(spark, sf_dir), BARS, ["close"], WINDOWS))


_FLAG_ROWS = " UNION ALL ".join(f"SELECT symbol, {i} AS ordinal, last(z_{n} ORDER BY bar) FILTER (z_{n} IS NOT NULL) AS z, last(label_{n} ORDER BY bar) AS label, last(sk_{n} ORDER BY bar) FILTER (sk_{n} IS NOT NULL) AS sk, last(ku_{n} ORDER BY bar) FILTER (ku_{n} IS NOT NULL) AS ku FROM m GROUP BY symbol" for i, n in enumerate(WINDOWS))
_MOM = ", ".join(f"{S_BARS.full('close', n, 'skewness(close)')} AS sk_{n}, {S_BARS.full('close', n, 'kurtosis(close)')} AS ku_{n}" for n in WINDOWS)


@query("regime_flags", f"""
WITH {regime_sql(BARS_SQL, 'bars', S_BARS, 'close')}, m AS (SELECT *, {_MOM} FROM regime), f AS ({_FLAG_ROWS}),
g AS (SELECT symbol, coalesce(bool_or(contains(label, 'high_volatility')), false) AS high_volatility_regime, coalesce(bool_or(contains(label, 'low_volatility') OR contains(label, 'compression')), false) AS low_volatility_regime,
  coalesce(max(abs(z)), 0) AS big, coalesce(first(z ORDER BY ordinal) FILTER (z IS NOT NULL), 0) AS first_z, coalesce(bool_or(z >= 2), false) AS outlier_positive, coalesce(bool_or(z <= -2), false) AS outlier_negative,
  coalesce(bool_or(sk >= 1), false) AS distribution_skewed_positive, coalesce(bool_or(sk <= -1), false) AS distribution_skewed_negative, coalesce(bool_or(ku >= 3), false) AS fat_tail_risk FROM f GROUP BY symbol)
SELECT symbol, high_volatility_regime, low_volatility_regime, high_volatility_regime AND big >= 1 AS trend_expansion, abs(first_z) <= 0.5 AND NOT high_volatility_regime AS mean_reversion_zone, outlier_positive, outlier_negative,
  distribution_skewed_positive, distribution_skewed_negative, fat_tail_risk FROM g""")
def regime_flags(spark, sf_dir):
    b = rolling.rolling_metrics(bars(spark, sf_dir), BARS, "close", WINDOWS, metrics=("rolling_skewness", "rolling_kurtosis"))
    last = regimes.classify_series(b, BARS, "close", WINDOWS)
    at = F.struct("bar")
    pick = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), at))
    g = last.groupBy("symbol").agg(*[pick(f"close__{k}_{n}").alias(f"{k}_{n}") for n in WINDOWS for k in ("zscore", "regime", "rolling_skewness", "rolling_kurtosis")])
    rows = F.array(*[F.struct(F.lit(i).alias("ordinal"), F.col(f"zscore_{n}").alias("zscore"), F.col(f"regime_{n}").alias("regime"), F.col(f"rolling_skewness_{n}").alias("skewness"), F.col(f"rolling_kurtosis_{n}").alias("kurtosis")) for i, n in enumerate(WINDOWS)])
    return regimes.regime_flags(g.select("symbol", F.inline(rows)), ["symbol"])



@query("stat_safe_returns", f"WITH {POINTS_SQL}, a AS (SELECT *, {S_POINTS.lag('value')} AS x1 FROM points) SELECT {P}, {rounded({'pct': 'value / nullif(x1, 0) - 1', 'log': 'CASE WHEN value > 0 AND x1 > 0 THEN ln(value / x1) END'})} FROM a")
def stat_safe_returns(spark, sf_dir):
    run = lambda d, s: rolling.safe_returns(rolling.safe_returns(d, s, "value", "pct", "pct"), s, "value", "log", "log")
    return finish(bounded(points(spark, sf_dir), POINTS, 1, run), "series", "event_id", "pct", "log")


_TAGS = {"mean_reversion_extreme": "abs(first_z) >= 2", "high_volatility_regime": "high", "fat_tail_risk": "fat"}


@query("regime_tags", f"""
WITH {regime_sql(BARS_SQL, 'bars', S_BARS, 'close')}, m AS (SELECT *, {_MOM} FROM regime), f AS ({_FLAG_ROWS}),
g AS (SELECT symbol, coalesce(bool_or(contains(label, 'high_volatility')), false) AS high, coalesce(first(z ORDER BY ordinal) FILTER (z IS NOT NULL), 0) AS first_z, coalesce(bool_or(ku >= 3), false) AS fat FROM f GROUP BY symbol)
{' UNION ALL '.join(f"SELECT symbol, '{k}' AS tag FROM g WHERE {x}" for k, x in _TAGS.items())}""")
def regime_tags(spark, sf_dir):
    """Statistical tags of each series from its first z-score and its flags."""
    from ..operators import patterns

    z = f"close__zscore_{WINDOWS[0]}"
    first = regimes.last_regimes(bars(spark, sf_dir), BARS, ["close"], WINDOWS[:1]).select("symbol", F.col(z).alias("zscore"))
    return patterns.statistical_tags(regime_flags(spark, sf_dir).join(first, "symbol"), ["symbol"])
