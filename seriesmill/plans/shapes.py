"""Queries of feature windows, channel alignment, spectra, distances and persistence."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import align, spectral, tda, windows
from ..series import bounded, row_numbers
from .inputs import BARS, BARS_SQL, POINTS, S_BARS, S_POINTS, bars, finish, points, query, r, rounded, table

N, STEP = 24, 12
_WIN = f"""q AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar) - 1 AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM feat),
w AS (SELECT *, unnest(range(greatest(0, ceil((rn - {N - 1}) / {STEP}.0)::BIGINT), least(rn // {STEP}, (n - {N}) // {STEP}) + 1)) AS window_id FROM q)"""
_STAT = {"mean": "avg({c})", "std": "stddev_samp({c})", "min": "min({c})", "max": "max({c})", "first": "first({c} ORDER BY rn) FILTER ({c} IS NOT NULL)", "last": "last({c} ORDER BY rn) FILTER ({c} IS NOT NULL)", "median": "median({c})"}
_STAT["delta"] = f"{_STAT['last']} - {_STAT['first']}"
_SHOWN = {"variable_action": ("body_ratio", "gap"), "dynamics_features": ("close_velocity", "close_acceleration"), "volume_flow": ("volume",)}
_FEAT = f"feat AS (SELECT *, CASE WHEN high - low > 1e-12 THEN abs(close - open) / (high - low) ELSE 0 END AS body_ratio, open - {S_BARS.lag('close')} AS gap, close - {S_BARS.lag('close')} AS close_velocity, close - 2 * {S_BARS.lag('close')} + {S_BARS.lag('close', 2)} AS close_acceleration FROM bars)"
_COLS = {f"{s}__{c}_{k}": x.format(c=c) for s, cs in _SHOWN.items() for c in cs for k, x in _STAT.items()}


@query("win_features", f"WITH {BARS_SQL}, {_FEAT}, {_WIN} SELECT symbol, window_id, {rounded(_COLS)} FROM w GROUP BY symbol, window_id")
def win_features(spark, sf_dir):
    """Feature matrix of sliding windows; the columns shown are those with short SQL, the others are computed alike."""
    return finish(windows.build_feature_matrix(bars(spark, sf_dir), BARS, N, STEP), "symbol", "window_id", *_COLS)


@query("win_matrix_all")
def win_matrix_all(spark, sf_dir):
    """All columns of the feature matrix."""
    return finish(windows.build_feature_matrix(bars(spark, sf_dir), BARS, N, STEP, include_meta=True))


@query("win_meta", f"WITH {BARS_SQL}, feat AS (SELECT * FROM bars), {_WIN} SELECT symbol, window_id, count(*) AS n_samples, '1.0' AS schema_version, 'bar' AS time_column, min(bar) AS time_start, max(bar) AS time_end FROM w GROUP BY symbol, window_id")
def win_meta(spark, sf_dir):
    return windows.window_meta(windows.window_rows(bars(spark, sf_dir), BARS, N, STEP), BARS, "bar")


_GAPPY = "g AS (SELECT symbol, bar, CASE WHEN bar % 3 <> 0 THEN close END AS close, CASE WHEN bar % 5 <> 0 THEN volume END AS volume FROM bars)"


def gappy(spark, sf_dir):
    b = bars(spark, sf_dir)
    return b.select("symbol", "bar", F.when(F.col("bar") % 3 != 0, F.col("close")).alias("close"), F.when(F.col("bar") % 5 != 0, F.col("volume")).alias("volume"))


def _ff(c: str) -> str:
    w = "OVER (PARTITION BY symbol ORDER BY bar"
    return f"coalesce(last_value({c} IGNORE NULLS) {w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value({c} IGNORE NULLS) {w} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 0)"


@query("fill_ffill", f"WITH {BARS_SQL}, {_GAPPY} SELECT symbol, bar, {_ff('close')} AS close, {_ff('volume')} AS volume FROM g")
def fill_ffill(spark, sf_dir):
    return windows.fill_feature_matrix(gappy(spark, sf_dir), BARS, ["close", "volume"], "ffill")


@query("fill_median", f"WITH {BARS_SQL}, {_GAPPY} SELECT symbol, bar, {rounded({c: f'coalesce({c}, (SELECT median({c}) FROM g))' for c in ('close', 'volume')})} FROM g")
def fill_median(spark, sf_dir):
    return finish(windows.fill_feature_matrix(gappy(spark, sf_dir), BARS, ["close", "volume"], "median"))


@query("fill_zero", f"WITH {BARS_SQL}, {_GAPPY} SELECT symbol, bar, coalesce(close, 0) AS close, coalesce(volume, 0) AS volume FROM g")
def fill_zero(spark, sf_dir):
    return windows.fill_feature_matrix(gappy(spark, sf_dir), BARS, ["close", "volume"], "zero")


@query("matrix_report", f"""
WITH {BARS_SQL}, {_GAPPY} SELECT count(*) AS n_rows, 4::BIGINT AS n_features, {r("(count(*) FILTER (close IS NULL) + count(*) FILTER (volume IS NULL)) / (count(*) * 4.0)")} AS missing_ratio, 'symbol' AS non_numeric_columns, '' AS constant_columns FROM g""")
def matrix_report(spark, sf_dir):
    return finish(windows.pipeline_report(gappy(spark, sf_dir)).withColumns({c: F.array_join(c, ",") for c in ("non_numeric_columns", "constant_columns")}))


@query("row_positions", "SELECT event_type AS series, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS rn FROM events")
def row_positions(spark, sf_dir):
    """Row numbers by two levels, as chunked operators use them."""
    return row_numbers(points(spark, sf_dir), POINTS).select("series", "event_id", F.col("_rn").alias("rn"))


# --- channels ----------------------------------------------------------------------------------------------

TYPES = ("click", "purchase", "signup")


def channels(spark, sf_dir):
    """Hourly closes of three event types by hour, and every hour of the month as the reference."""
    b = bars(spark, sf_dir)
    made = {t: b.where(F.col("symbol") == t).select("bar", "close", "volume") for t in TYPES}
    span = b.agg(F.min("bar").alias("lo"), F.max("bar").alias("hi"))
    return {"ref": span.select(F.explode(F.sequence("lo", "hi")).alias("bar"), F.lit(1).alias("on"))} | made


_CH = f"""{BARS_SQL}, ref AS (SELECT unnest(range((SELECT min(bar) FROM bars), (SELECT max(bar) FROM bars) + 1)) AS bar), {', '.join(f"c_{t} AS (SELECT bar, close, volume FROM bars WHERE symbol = '{t}')" for t in TYPES)}"""
_JOIN = "FROM ref " + " ".join(f"LEFT JOIN c_{t} ON c_{t}.bar = ref.bar" for t in TYPES)
_CELLS = ", ".join(f"c_{t}.{c} AS {t}_{c}" for t in TYPES for c in ("close", "volume"))


@query("align_merge", f"WITH {_CH} SELECT ref.bar AS bar, 1 AS ref_on, {_CELLS} {_JOIN}")
def align_merge(spark, sf_dir):
    return align.merge_channels(channels(spark, sf_dir), "ref", [], "bar")


@query("align_ffill", f"WITH {_CH}, m AS (SELECT ref.bar AS bar, {_CELLS} {_JOIN}) SELECT bar, 1 AS ref_on, {', '.join(f'last_value({t}_{c} IGNORE NULLS) OVER (ORDER BY bar ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {t}_{c}' for t in TYPES for c in ('close', 'volume'))} FROM m")
def align_ffill(spark, sf_dir):
    return align.merge_channels(channels(spark, sf_dir), "ref", [], "bar", "ffill")


@query("align_index", f"WITH {_CH} SELECT ref.bar AS bar, close, volume FROM ref LEFT JOIN c_click ON c_click.bar = ref.bar")
def align_index(spark, sf_dir):
    ch = channels(spark, sf_dir)
    return align.align_to_index(ch["click"], ch["ref"], [], "bar")


@query("align_diagnose", f"WITH {_CH} SELECT 'ref' AS channel, 1.0::DOUBLE AS coverage_ratio, 0.0::DOUBLE AS missing_ratio, count(*) AS n_samples FROM ref " + " ".join(f"UNION ALL SELECT '{t}', {r(f'(SELECT count(*) FROM ref JOIN c_{t} USING (bar)) / (SELECT count(*) FROM ref)')}, 0.0, count(*) FROM c_{t}" for t in TYPES))
def align_diagnose(spark, sf_dir):
    return finish(align.diagnose_alignment(channels(spark, sf_dir), "ref", [], "bar"))


@query("align_coverage", f"WITH {_CH} SELECT {r('(SELECT count(*) FROM ref JOIN c_click USING (bar)) / (SELECT count(*) FROM ref)')} AS coverage_ratio")
def align_coverage(spark, sf_dir):
    ch = channels(spark, sf_dir)
    return finish(align.compute_coverage_ratio(ch["click"], ch["ref"], [], "bar"))


@query("align_missing", f"WITH {BARS_SQL}, {_GAPPY} SELECT symbol, {r('count(*) FILTER (close IS NULL) / count(*)')} AS missing_ratio FROM g GROUP BY symbol")
def align_missing(spark, sf_dir):
    return finish(align.compute_missing_ratio(gappy(spark, sf_dir), ["symbol"], "close"))


# --- spectra, distances, persistence -----------------------------------------------------------------------

F_N = 32


@query("spec_fft", f"""
WITH {BARS_SQL}, q AS (SELECT symbol, close, row_number() OVER (PARTITION BY symbol ORDER BY bar) - 1 AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM bars), w AS (SELECT symbol, rn // {F_N} AS window_id, rn % {F_N} AS j, close FROM q WHERE rn // {F_N} < n // {F_N}),
k AS (SELECT unnest(range({F_N // 2 + 1})) AS bin) SELECT symbol, window_id, bin::INTEGER AS bin, {r(f'bin / {F_N}.0')} AS freq, {r(f'sqrt(pow(sum(close * cos(2 * pi() * bin * j / {F_N})), 2) + pow(sum(close * sin(2 * pi() * bin * j / {F_N})), 2))')} AS magnitude FROM w, k GROUP BY symbol, window_id, bin""")
def spec_fft(spark, sf_dir):
    return finish(spectral.compute_fft_magnitude(bars(spark, sf_dir), BARS, "close", window=F_N))


@query("spec_wavelet", f"WITH {BARS_SQL} SELECT symbol, bar, {r(f'CASE WHEN count(close) {S_BARS.w(4)} = 4 THEN pow(({S_BARS.lag("close", 2)} + {S_BARS.lag("close", 3)} - close - {S_BARS.lag("close")}) / 2, 2) END')} AS wavelet_energy FROM bars")
def spec_wavelet(spark, sf_dir):
    return finish(bounded(bars(spark, sf_dir), BARS, 4, lambda d, s: spectral.wavelet_energy(d, s, "close", 2)), "symbol", "bar", "wavelet_energy")


@query("spec_energy", f"WITH {BARS_SQL} SELECT symbol, count(*) AS length, {r('sum(close * close)')} AS energy FROM bars GROUP BY symbol")
def spec_energy(spark, sf_dir):
    return finish(spectral.micro_doppler_features(bars(spark, sf_dir), ["symbol"], "close"))


@query("spec_regressor", f"""
WITH {BARS_SQL}, q AS (SELECT symbol, bar, close, (row_number() OVER (PARTITION BY symbol ORDER BY bar) - 1)::DOUBLE AS rn FROM bars), f AS (SELECT symbol, regr_slope(close, rn) AS b, regr_intercept(close, rn) AS a FROM q GROUP BY symbol)
SELECT symbol, bar, {r('a + b * rn')} AS y_pred, 1 AS degree FROM q JOIN f USING (symbol)""")
def spec_regressor(spark, sf_dir):
    return finish(spectral.regressor(bars(spark, sf_dir), BARS, max_degree=1), "symbol", "bar", "y_pred", "degree")


@query("spec_regressor_best")
def spec_regressor_best(spark, sf_dir):
    """Polynomial of the best degree up to four."""
    return finish(spectral.regressor(bars(spark, sf_dir), BARS), "symbol", "bar", "y_pred", "degree")


_OLD = f"CASE WHEN count(value) OVER (PARTITION BY series ORDER BY ts, event_id ROWS BETWEEN 39 PRECEDING AND 20 PRECEDING) = 20 THEN list_sort(list(value) OVER (PARTITION BY series ORDER BY ts, event_id ROWS BETWEEN 39 PRECEDING AND 20 PRECEDING)) END"
_WAS = f"d AS (SELECT *, list_sum(list_transform(list_zip(a, b), lambda z: abs(z[1] - z[2]))) / 20 AS w FROM (SELECT series, ts, event_id, list_sort({S_POINTS.full('value', 20, 'list(value)')}) AS a, {_OLD} AS b FROM (SELECT event_type AS series, ts, event_id, value FROM events) p) o)"


@query("tda_wasserstein", f"WITH {_WAS} SELECT series, event_id, {r('CASE WHEN b IS NOT NULL THEN w END')} AS wasserstein FROM d")
def tda_wasserstein(spark, sf_dir):
    return finish(bounded(points(spark, sf_dir), POINTS, 40, lambda d, s: tda.rolling_wasserstein_profile(d, s, "value", 20)), "series", "event_id", "wasserstein")


_BACK = "OVER (PARTITION BY series ORDER BY ts, event_id ROWS BETWEEN 39 PRECEDING AND 20 PRECEDING)"
_LOGS = f"""x AS (SELECT series, ts, event_id, CASE WHEN value > 0 AND x1 > 0 THEN ln(value / x1) END AS x FROM (SELECT event_type AS series, ts, event_id, value, lag(value) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS x1 FROM events) p),
l AS (SELECT *, list_sort({S_POINTS.full('x', 20, 'list(x)')}) AS a, CASE WHEN count(x) {_BACK} = 20 THEN list_sort(list(x) {_BACK}) END AS b, {S_POINTS.avg('x', 20)} AS m FROM x),
w AS (SELECT *, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN list_sum(list_transform(list_zip(a, b), lambda z: abs(z[1] - z[2]))) / 20 END AS w FROM l),
q AS (SELECT *, {S_POINTS.avg('w', 20)} AS usual, {S_POINTS.lag('m', 20)} AS before FROM w)"""


@query("tda_wasserstein_regime", f"WITH {_LOGS} SELECT series, event_id, {r('w')} AS wasserstein, CASE WHEN w > usual THEN coalesce(sign(m - before), 0) ELSE 0 END::DOUBLE AS wasserstein_position FROM q")
def tda_wasserstein_regime(spark, sf_dir):
    """Distances of log returns with their position."""
    return finish(bounded(points(spark, sf_dir), POINTS, 82, lambda d, s: tda.wasserstein_distances(d, s, "value", 20)), "series", "event_id", "wasserstein", "wasserstein_position")


_LATCH = "coalesce(last_value({e} IGNORE NULLS) OVER (PARTITION BY series ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0)"


@query("tda_hysteresis", f"""
WITH e AS (SELECT event_type AS series, ts, event_id, CASE WHEN value >= 80 THEN 1 WHEN value <= 60 THEN 0 END AS hi, CASE WHEN value <= 5 THEN 1 WHEN value >= 15 THEN 0 END AS lo FROM events)
SELECT series, event_id, {_LATCH.format(e='hi')} - {_LATCH.format(e='lo')} AS regime_signal FROM e""")
def tda_hysteresis(spark, sf_dir):
    return tda.wasserstein_regime_signal(points(spark, sf_dir), POINTS, "value", 80, 60, 5, 15).select("series", "event_id", "regime_signal")


@query("tda_entropy", f"""
WITH l AS (SELECT user_id, CASE WHEN value > 0 THEN value END AS life FROM events) SELECT user_id, {r('coalesce(ln(sum(life)) - sum(life * ln(life)) / nullif(sum(life), 0), 0)')} AS entropy FROM l GROUP BY user_id""")
def tda_entropy(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.lit(0.0).alias("birth"), F.col("value").alias("death"))
    return finish(tda.persistence_entropy(e, ["user_id"]))


@query("tda_persistence")
def tda_persistence(spark, sf_dir):
    """Total persistence of delay embeddings of the hourly close; tested against brute force."""
    return finish(bounded(bars(spark, sf_dir), BARS, 240, lambda d, s: tda.rolling_persistence_profile(d, s, "close", 30)), "symbol", "bar", "persistence")

