"""Queries of technical indicators: bounded frames, running sums, recursive smoothing, signals, volume."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import geometry, indicators, recursive, signals, states, volume
from ..series import bounded
from .inputs import BARS, BARS_SQL, QUERIES, S_BARS, Sql, bars, finish, query, r, rounded

K = "symbol, bar"
H, L, C, V = "high", "low", "close", "volume"
TP = "(high + low + close) / 3"
NUMBERED = f"n AS (SELECT *, {S_BARS.rn()} AS rn, lag(close) OVER (PARTITION BY symbol ORDER BY bar) AS pc, lag(high) OVER (PARTITION BY symbol ORDER BY bar) AS ph, lag(low) OVER (PARTITION BY symbol ORDER BY bar) AS pl FROM bars)"
TR = "greatest(high - low, abs(high - pc), abs(low - pc))"
full = S_BARS.full


def frames(halo: int, work, *names: str):
    def build(spark, sf_dir):
        return finish(bounded(bars(spark, sf_dir), BARS, halo, work), "symbol", "bar", *names)

    return build


# --- bounded frames ----------------------------------------------------------------------------------------

_WMA = " + ".join(f"{20 - k} * lag(close, {k}) OVER ({S_BARS.over})" if k else "20 * close" for k in range(20))
query("ind_averages", f"""
WITH {BARS_SQL} SELECT {K}, {rounded({'sma_20': S_BARS.avg(C, 20), 'wma_20': f'({_WMA}) / 210', 'mom_10': f'close - {S_BARS.lag(C, 10)}', 'roc_12': f'100 * (close / nullif({S_BARS.lag(C, 12)}, 0) - 1)'})} FROM bars""")(
    frames(20, lambda d, s: indicators.compute_roc(indicators.momentum(indicators.compute_wma(indicators.compute_sma(d, s, "close"), s, "close"), s), s), "sma_20", "wma_20", "mom_10", "roc_12")
)

_HH, _LL = S_BARS.max(H, 14), S_BARS.min(L, 14)
query("ind_oscillators", f"""
WITH {BARS_SQL}, a AS (SELECT *, {_HH} AS hh, {_LL} AS ll, {TP} AS tp FROM bars), b AS (SELECT *, 100 * (close - ll) / nullif(hh - ll, 0) AS k, {full('tp', 20, 'avg(tp)')} AS m, {full('tp', 20, 'list(tp)')} AS v FROM a)
SELECT {K}, {rounded({'stoch_k_14': 'k', 'stoch_d_14': S_BARS.avg('k', 3), 'williams_r_14': '-100 * (hh - close) / nullif(hh - ll, 0)', 'cci_20': '(tp - m) / nullif(0.015 * list_avg(list_transform(v, lambda x: abs(x - m))), 0)'})} FROM b""")(
    frames(20, lambda d, s: indicators.cci(indicators.compute_williams_r(indicators.compute_stochastic(d, s), s), s), "stoch_k_14", "stoch_d_14", "williams_r_14", "cci_20")
)

_BB = {"bb_middle_20": "m", "bb_upper_20": "m + 2 * sd", "bb_lower_20": "m - 2 * sd", "bb_bandwidth_20": "4 * sd / nullif(m, 0)", "bb_percent_b_20": "(close - (m - 2 * sd)) / nullif(4 * sd, 0)", "donchian_high_20": "hh", "donchian_low_20": "ll", "donchian_mid_20": "(hh + ll) / 2", "support_20": "ll", "resistance_20": "hh"} | {f"fib_{round(q * 1000)}_100": f"h1 - (h1 - l1) * {q}" for q in indicators.FIB}
query("ind_bands", f"""
WITH {BARS_SQL}, a AS (SELECT *, {S_BARS.avg(C, 20)} AS m, {S_BARS.std(C, 20)} AS sd, {S_BARS.max(H, 20)} AS hh, {S_BARS.min(L, 20)} AS ll, {S_BARS.max(H, 100)} AS h1, {S_BARS.min(L, 100)} AS l1 FROM bars)
SELECT {K}, {rounded(_BB)} FROM a""")(
    frames(100, lambda d, s: indicators.fibonacci_levels(indicators.support_resistance(indicators.donchian(indicators.compute_bollinger_bands(d, s), s), s), s), *_BB)
)
query("ind_true_range", f"WITH {BARS_SQL}, {NUMBERED} SELECT {K}, {rounded({'tr': TR, 'weighted_close': '(high + low + 2 * close) / 4'})} FROM n")(
    frames(1, lambda d, s: indicators.ohlc_to_series(indicators.compute_tr(d, s)), "tr", "weighted_close")
)


@query("ind_volume", f"""
WITH {BARS_SQL}, {NUMBERED} SELECT {K}, {rounded({'vwap': f'sum({TP} * volume) {S_BARS.upto} / nullif(sum(volume) {S_BARS.upto}, 0)', 'obv': f'sum(coalesce(sign(close - pc), 0) * volume) {S_BARS.upto}'})} FROM n""")
def ind_volume(spark, sf_dir):
    return finish(indicators.obv(indicators.vwap(bars(spark, sf_dir), BARS), BARS), "symbol", "bar", "vwap", "obv")


# --- recursive ---------------------------------------------------------------------------------------------


def recursive_query(names: tuple):
    return frames(recursive.HALO, lambda d, s: recursive.recursive_indicators(d, s), *names)


def ema(x: str, span: int, first: int = 0) -> str:
    return S_BARS.ewm(x, 2 / (span + 1), first)


def wilder(x: str, n: int = 14, first: int = 0) -> str:
    return f"CASE WHEN rn >= {first + n - 1} THEN {S_BARS.ewm(x, 1 / n, first)} END"


query("ewm_averages", f"""
WITH {BARS_SQL}, {NUMBERED}, a AS (SELECT *, {ema(C, 20)} AS e20, {ema(C, 50)} AS e50, {ema(C, 12)} - {ema(C, 26)} AS line FROM n), b AS (SELECT *, {ema('line', 9)} AS sig FROM a)
SELECT {K}, {rounded({'ema_20': 'e20', 'ema_50': 'e50', 'macd': 'line', 'macd_signal': 'sig', 'macd_hist': 'line - sig'})} FROM b""")(recursive_query(("ema_20", "ema_50", "macd", "macd_signal", "macd_hist")))

query("ewm_rsi_tsi", f"""
WITH {BARS_SQL}, {NUMBERED}, a AS (SELECT *, {wilder('greatest(close - pc, 0)', 14, 1)} AS g, {wilder('greatest(pc - close, 0)', 14, 1)} AS l, {ema('close - pc', 25, 1)} AS d1, {ema('abs(close - pc)', 25, 1)} AS a1 FROM n),
b AS (SELECT *, {ema('d1', 13, 1)} AS d2, {ema('a1', 13, 1)} AS a2 FROM a)
SELECT {K}, {rounded({'rsi_14': '100 - 100 / (1 + g / nullif(l, 0))', 'tsi': '100 * d2 / nullif(a2, 0)'})} FROM b""")(recursive_query(("rsi_14", "tsi")))

DI = f"""d AS (SELECT *, CASE WHEN high - ph > pl - low AND high - ph > 0 THEN high - ph ELSE 0 END AS up, CASE WHEN pl - low > high - ph AND pl - low > 0 THEN pl - low ELSE 0 END AS down FROM n),
e AS (SELECT *, {wilder(TR)} AS atr, {wilder('up')} AS wu, {wilder('down')} AS wd FROM d), f AS (SELECT *, 100 * wu / nullif(atr, 0) AS pdi, 100 * wd / nullif(atr, 0) AS mdi FROM e),
g AS (SELECT *, 100 * abs(pdi - mdi) / nullif(pdi + mdi, 0) AS dx FROM f), h AS (SELECT *, {wilder('dx', 14, 13)} AS adx FROM g)"""
_MID = ema(C, 20)
query("ewm_trend", f"""
WITH {BARS_SQL}, {NUMBERED}, {DI}, k AS (SELECT *, {_MID} AS mid, {wilder(TR, 20)} AS atr20 FROM h)
SELECT {K}, {rounded({'atr_14': 'atr', 'plus_di_14': 'pdi', 'minus_di_14': 'mdi', 'dx_14': 'dx', 'adx_14': 'adx', 'keltner_middle_20': 'mid', 'keltner_upper_20': 'mid + 2 * atr20', 'keltner_lower_20': 'mid - 2 * atr20'})} FROM k""")(
    recursive_query(("atr_14", "plus_di_14", "minus_di_14", "dx_14", "adx_14", "keltner_middle_20", "keltner_upper_20", "keltner_lower_20"))
)

_FAST, _SLOW = 2 / 3, 2 / 31
query("ewm_kama", f"""
WITH RECURSIVE {BARS_SQL}, {NUMBERED}, m AS (SELECT *, abs(close - pc) AS mv, lag(close, 10) OVER (PARTITION BY symbol ORDER BY bar) AS c10 FROM n),
x AS (SELECT symbol, bar, rn, close, pow(coalesce(abs(close - c10) / nullif({full('mv', 10, 'sum(mv)')}, 0), 0) * {_FAST - _SLOW} + {_SLOW}, 2) AS rate FROM m),
k AS (SELECT symbol, rn, close AS y FROM x WHERE rn = 10 UNION ALL SELECT x.symbol, x.rn, k.y + x.rate * (x.close - k.y) FROM k JOIN x ON x.symbol = k.symbol AND x.rn = k.rn + 1)
SELECT x.symbol AS symbol, bar, {r('y')} AS kama_10_2_30 FROM x LEFT JOIN k ON k.symbol = x.symbol AND k.rn = x.rn""")(
    frames(recursive.kama_halo(), lambda d, s: recursive.compute_kama(d, s, "close"), "kama_10_2_30")
)

query("ewm_kalman", f"""
WITH RECURSIVE {BARS_SQL}, {NUMBERED},
k AS (SELECT symbol, rn, close AS level, 0.0::DOUBLE AS speed, 1.0::DOUBLE AS a, 0.0::DOUBLE AS b, 1.0::DOUBLE AS c FROM n WHERE rn = 0
  UNION ALL SELECT symbol, rn, level + pa / (pa + 0.1) * (z - level), speed + pb / (pa + 0.1) * (z - level), (1 - pa / (pa + 0.1)) * pa, (1 - pa / (pa + 0.1)) * pb, pc - pb / (pa + 0.1) * pb
  FROM (SELECT n.symbol, n.rn, n.close AS z, k.level + k.speed AS level, k.speed, k.a + 2 * k.b + k.c + 0.001 AS pa, k.b + k.c AS pb, k.c + 0.001 AS pc FROM k JOIN n ON n.symbol = k.symbol AND n.rn = k.rn + 1) q)
SELECT n.symbol AS symbol, bar, {rounded({'estimate': 'level', 'velocity': 'speed'})} FROM n JOIN k ON k.symbol = n.symbol AND k.rn = n.rn""")(
    frames(recursive.HALO, lambda d, s: recursive.kalman_filter_1d(d, s, "close", True), "estimate", "velocity")
)


@query("ewm_last", f"WITH {BARS_SQL}, {NUMBERED}, a AS (SELECT *, {ema(C, 20)} AS e FROM n) SELECT symbol, {r('last(e ORDER BY bar)')} AS ema_20 FROM a GROUP BY symbol")
def ewm_last(spark, sf_dir):
    return finish(recursive.ema_last(bars(spark, sf_dir), ["symbol"], ("bar",), "close", 20))


_RSI = f"a AS (SELECT *, {wilder('greatest(close - pc, 0)', 14, 1)} AS g, {wilder('greatest(pc - close, 0)', 14, 1)} AS l FROM n), b AS (SELECT *, 100 - 100 / (1 + g / nullif(l, 0)) AS rsi FROM a)"
query("osc_stochrsi", f"""
WITH {BARS_SQL}, {NUMBERED}, {_RSI}, c AS (SELECT *, (rsi - ({S_BARS.min('rsi', 14)})) / nullif(({S_BARS.max('rsi', 14)}) - ({S_BARS.min('rsi', 14)}), 0) AS sr FROM b), d AS (SELECT *, {S_BARS.avg('sr', 3)} AS k FROM c)
SELECT {K}, {rounded({'stochrsi': 'sr', 'stochrsi_k': 'k', 'stochrsi_d': S_BARS.avg('k', 3)})} FROM d""")(
    frames(recursive.HALO, lambda d, s: recursive.compute_stochrsi(d, s), "stochrsi", "stochrsi_k", "stochrsi_d")
)
query("osc_regime", f"""
WITH {BARS_SQL}, {NUMBERED}, {_RSI}, c AS (SELECT *, {ema('close - pc', 25, 1)} AS d1, {ema('abs(close - pc)', 25, 1)} AS a1 FROM b), d AS (SELECT *, 100 * {ema('d1', 13, 1).replace('CASE WHEN', '(CASE WHEN', 1)}) / nullif({ema('a1', 13, 1)}, 0) AS tsi FROM c)
SELECT {K}, {rounded({'rsi': 'rsi', 'tsi': 'tsi'})}, CASE WHEN rsi >= 70 THEN 1 WHEN rsi <= 30 THEN -1 ELSE 0 END AS rsi_position, CASE WHEN tsi >= 25 THEN 1 WHEN tsi <= -25 THEN -1 ELSE 0 END AS tsi_position FROM d""")(
    frames(recursive.HALO, lambda d, s: recursive.compute_rsi_tsi_regime(d, s), "rsi", "tsi", "rsi_position", "tsi_position")
)
query("trend_helper", f"""
WITH {BARS_SQL}, {NUMBERED}, {DI} SELECT {K}, {rounded({'plus_di': 'pdi', 'minus_di': 'mdi', 'dx': 'dx', 'adx': 'adx'})}, CASE WHEN adx >= 25 THEN coalesce(sign(pdi - mdi), 0)::INTEGER ELSE 0 END AS position FROM h""")(
    frames(recursive.HALO, lambda d, s: recursive.compute_trend_helper_signal(d, s), "plus_di", "minus_di", "dx", "adx", "position")
)


_PARTS = ("ind_averages", "ind_oscillators", "ind_bands", "ind_volume", "ewm_averages", "ewm_rsi_tsi", "ewm_trend")


@query("technical_all", f"SELECT symbol, bar, {', '.join(indicators.TECHNICAL)} FROM " + " JOIN ".join(f"({QUERIES[q].sql}) {q}" + (" USING (symbol, bar)" if k else "") for k, q in enumerate(_PARTS)))
def technical_all(spark, sf_dir):
    """Every technical indicator of every bar, in the order of the feature table."""
    return finish(indicators.technical(bars(spark, sf_dir), BARS), "symbol", "bar", *indicators.TECHNICAL)


# --- geometry, states, signals -----------------------------------------------------------------------------

_GEO_SQL = """
a AS (SELECT *, high - low AS rng, abs(close - open) AS body, greatest(high - greatest(open, close), 0) AS up, greatest(least(open, close) - low, 0) AS down, lag(close) OVER (PARTITION BY symbol ORDER BY bar) AS pc FROM bars),
g AS (SELECT *, CASE WHEN rng > 1e-12 THEN body / rng ELSE 0 END AS b, CASE WHEN rng > 1e-12 THEN up / rng ELSE 0 END AS u, CASE WHEN rng > 1e-12 THEN down / rng ELSE 0 END AS d FROM a)"""
_GEO = {
    "range": "rng", "body_size": "body", "body_direction": "sign(close - open)", "upper_wick": "up", "lower_wick": "down", "body_ratio": "b", "upper_wick_ratio": "u", "lower_wick_ratio": "d", "wick_imbalance": "up - down",
    "wick_imbalance_ratio": "CASE WHEN rng > 1e-12 THEN (up - down) / rng ELSE 0 END", "close_position": "CASE WHEN rng > 1e-12 THEN (close - low) / rng ELSE 0 END", "gap": "open - pc", "return": "close / nullif(pc, 0) - 1",
    "log_return": "CASE WHEN close > 0 AND pc > 0 THEN ln(close / pc) END",
}
query("geo_features", f"WITH {BARS_SQL}, {_GEO_SQL} SELECT {K}, {rounded({f'{chr(34)}{k}{chr(34)}': x for k, x in _GEO.items()})} FROM g")(frames(1, lambda d, s: geometry.compute_ohlc_geometry(d, s), *geometry.GEOMETRY))
query("geo_states", f"""
WITH {BARS_SQL}, {_GEO_SQL} SELECT {K}, CASE WHEN b <= 0.1 THEN 'doji' WHEN b >= 0.6 THEN 'strong_body' WHEN b < 0.35 THEN 'weak_body' ELSE 'normal_body' END AS body_state,
  CASE WHEN close > open THEN 'up' WHEN close < open THEN 'down' ELSE 'neutral' END AS direction_state, CASE WHEN u >= 0.45 AND d >= 0.45 THEN 'both_rejection' WHEN u >= 0.45 THEN 'upper_rejection' WHEN d >= 0.45 THEN 'lower_rejection' ELSE 'none' END AS rejection_state,
  b <= 0.1 AS is_doji, b >= 0.6 AS is_strong_body, u >= 0.45 AS has_upper_rejection, d >= 0.45 AS has_lower_rejection FROM g""")(
    frames(1, lambda d, s: geometry.add_ohlc_geometry_features(d, s), "body_state", "direction_state", "rejection_state", "is_doji", "is_strong_body", "has_upper_rejection", "has_lower_rejection")
)


def _hold(x: str) -> str:
    return f"coalesce(least(greatest({x}, 0), 1), 0)"


_TRUE5 = f"(close - {S_BARS.lag(C, 5)}) / 5"
query("state_frame", f"""
WITH {BARS_SQL}, {_GEO_SQL},
h AS (SELECT *, {full(C, 5, 'avg(close)', 1)} AS fast, {full(C, 20, 'avg(close)', 1)} AS slow, {_TRUE5} AS slope, rng / nullif({S_BARS.avg('rng', 20)}, 0) AS vr, volume / nullif({S_BARS.avg(V, 20)}, 0) AS ar FROM g),
t AS (SELECT *, CASE WHEN fast > slow AND slope > 0 THEN 'rising' WHEN fast < slow AND slope < 0 THEN 'falling' ELSE 'sideways' END AS ts FROM h)
SELECT {K}, ts AS trend_state, {r(f"CASE WHEN ts = 'sideways' THEN 0 ELSE {_hold('100 * abs((fast - slow) / nullif(slow, 0))')} END")} AS trend_confidence, 'neutral' AS momentum_state, {r('0.0')} AS momentum_confidence,
  CASE WHEN vr <= 0.8 THEN 'compression' WHEN vr >= 1.2 THEN 'expansion' ELSE 'normal' END AS volatility_state, {r(_hold('abs(vr - 1)'))} AS volatility_confidence,
  CASE WHEN b <= 0.1 THEN 'indecision' WHEN u >= 0.45 THEN 'upper_rejection' WHEN d >= 0.45 THEN 'lower_rejection' WHEN b >= 0.6 AND close > open THEN 'strong_up' WHEN b >= 0.6 AND close < open THEN 'strong_down' ELSE 'normal' END AS structure_state,
  {r(_hold('greatest(b, u, d)'))} AS structure_confidence, CASE WHEN ar >= 1.5 THEN 'high' WHEN ar <= 0.7 THEN 'low' ELSE 'normal' END AS activity_state, {r(_hold('abs(ar - 1)'))} AS activity_confidence FROM t""")(
    frames(25, lambda d, s: states.build_signal_state_frame(d.withColumn("atr", F.col("high") - F.col("low")), s), *[f"{k}_{c}" for k in ("trend", "momentum", "volatility", "structure", "activity") for c in ("state", "confidence")])
)
query("state_slope", f"WITH {BARS_SQL}, a AS (SELECT *, {_TRUE5} AS slope FROM bars) SELECT {K}, {r('slope')} AS slope, CASE WHEN slope > 0 THEN 'rising' WHEN slope < 0 THEN 'falling' ELSE 'flat' END AS slope_state FROM a")(
    frames(5, lambda d, s: states.compute_slope_state(d, s, "close"), "slope", "slope_state")
)

_EDGE = "CASE WHEN sig = 1 AND coalesce(lag(sig) OVER (PARTITION BY symbol ORDER BY bar), 0) <> 1 THEN 1.0 ELSE 0.0 END"
query("sig_edges", f"WITH {BARS_SQL}, a AS (SELECT *, (close > open)::INTEGER AS sig FROM bars) SELECT {K}, {_EDGE}::DOUBLE AS compra, (0.0 - {_EDGE})::DOUBLE + 0.0 AS venta FROM a")(
    frames(1, lambda d, s: signals.detectar_venta(signals.detectar_compra(d.withColumn("sig", (F.col("close") > F.col("open")).cast("int")), s, "sig"), s, "sig"), "compra", "venta")
)


@query("sig_high_volume", f"""
WITH {BARS_SQL}, a AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar DESC) AS n FROM bars)
SELECT symbol, (avg(volume) FILTER (n <= 5) > avg(volume) FILTER (n > 5) + coalesce(stddev_samp(volume) FILTER (n > 5), 0))::INTEGER AS high_volume FROM a WHERE n <= 505 GROUP BY symbol""")
def sig_high_volume(spark, sf_dir):
    return signals.high_volume(bars(spark, sf_dir), BARS)


@query("sig_stops", f"""
WITH {BARS_SQL}, {NUMBERED}, {DI}, z AS (SELECT symbol, last(close ORDER BY bar) AS c, last(atr ORDER BY bar) AS atr, last(adx ORDER BY bar) AS adx, CASE WHEN last(pdi ORDER BY bar) > last(mdi ORDER BY bar) THEN 1 ELSE -1 END AS way FROM h GROUP BY symbol)
SELECT symbol, {rounded({'sl': 'c - way * 1.5 * atr', 'tp': 'c + way * (CASE WHEN adx >= 25 THEN 2.0 ELSE 1.5 END) * atr'})} FROM z""")
def sig_stops(spark, sf_dir):
    b = recursive.compute_directional_indicators(recursive.compute_atr(bars(spark, sf_dir), BARS), BARS).withColumnRenamed("atr_14", "atr")
    return finish(signals.stop_loss_take_profit(b, BARS, checked=False))


query("sig_reference_bands", f"""
WITH {BARS_SQL}, a AS (SELECT *, {S_BARS.avg(C, 20)} AS m, {S_BARS.std(C, 20)} AS sd FROM bars), b AS (SELECT *, (open - m) / nullif(2 * sd, 0) AS sig FROM a)
SELECT {K}, {rounded({'bb_middle': 'm', 'bb_upper': 'm + 2 * sd', 'bb_lower': 'm - 2 * sd', 'bb_bandwidth': '4 * sd / nullif(m, 0)', 'bb_percent_b': '(close - (m - 2 * sd)) / nullif(4 * sd, 0)', 'bb_signal': 'sig'})}, CASE WHEN sig >= 1 THEN 1 WHEN sig <= -1 THEN -1 ELSE 0 END AS bb_position FROM b""")(
    frames(20, lambda d, s: signals.compute_bollinger_reference_signal(d, s, predicted="open"), "bb_middle", "bb_upper", "bb_lower", "bb_bandwidth", "bb_percent_b", "bb_signal", "bb_position")
)

_BLOCKS = "a AS (SELECT *, bar // 24 AS block FROM bars), g AS (SELECT symbol, block, first(open ORDER BY bar) AS o, last(close ORDER BY bar) AS c FROM a GROUP BY 1, 2), s AS (SELECT *, (c - o) / nullif(abs(o), 0) AS score FROM g), l AS (SELECT *, CASE WHEN score > 0.1 THEN 'alcista' WHEN score < -0.1 THEN 'bajista' ELSE 'lateral' END AS trend FROM s)"
_BLK = Sql("symbol", "block")


@query("trend_blocks", f"""
WITH {BARS_SQL}, {_BLOCKS}, v AS (SELECT *, list(CASE trend WHEN 'alcista' THEN 1.0 WHEN 'bajista' THEN -1.0 ELSE 0.0 END::DOUBLE) {_BLK.w(5)} AS h FROM l)
SELECT symbol, block, {r('score')} AS score, trend, {r('list_sum(list_transform(h, lambda x, i: x * i)) / (len(h) * (len(h) + 1) / 2)')} AS trend_score FROM v""")
def trend_blocks(spark, sf_dir):
    return finish(signals.weighted_trend_score(signals.block_trends(bars(spark, sf_dir), ["symbol"], "bar", 24, 0.1), ["symbol"]))


@query("trend_profile", f"WITH {BARS_SQL}, {_BLOCKS} SELECT bars.symbol AS symbol, bar, {r('tanh(score * 10)')} AS trend_profile_24 FROM bars JOIN s ON s.symbol = bars.symbol AND s.block = bar // 24")
def trend_profile(spark, sf_dir):
    return finish(signals.compute_block_trend_profile(bars(spark, sf_dir), ["symbol"], "bar", 24), "symbol", "bar", "trend_profile_24")


_Q = {"strong_buy": 0.9, "buy": 0.7, "sell": 0.3, "strong_sell": 0.1}


@query("trend_struct", f"""
WITH {BARS_SQL}, a AS (SELECT symbol, {', '.join(f'quantile_cont(close, {q}) AS {k}' for k, q in _Q.items())}, last(close ORDER BY bar) AS v FROM bars GROUP BY symbol)
SELECT symbol, {rounded({k: k for k in _Q} | {'last_value': 'v'})}, CASE WHEN v >= strong_buy THEN 'strong_buy' WHEN v >= buy THEN 'buy' WHEN v <= strong_sell THEN 'strong_sell' WHEN v <= sell THEN 'sell' ELSE 'neutral' END AS signal FROM a""")
def trend_struct(spark, sf_dir):
    return finish(signals.build_trending_struct(bars(spark, sf_dir), ["symbol"], ("bar",), "close"))


# --- volume ------------------------------------------------------------------------------------------------


@query("vol_stats", f"""
WITH {BARS_SQL}, {NUMBERED} SELECT {K}, {rounded({'vol_sma_20': S_BARS.avg(V, 20), 'vol_ema_20': ema(V, 20), 'rvol_20': f'volume / nullif({S_BARS.avg(V, 20)}, 0)', 'vol_zscore_20': f'(volume - ({S_BARS.avg(V, 20)})) / nullif({S_BARS.std(V, 20)}, 0)', 'obv': f'sum(coalesce(sign(close - pc), 0) * volume) {S_BARS.upto}'})} FROM n""")
def vol_stats(spark, sf_dir):
    return finish(volume.compute_volume_stats(bars(spark, sf_dir), BARS), "symbol", "bar", "vol_sma_20", "vol_ema_20", "rvol_20", "vol_zscore_20", "obv")


@query("vol_prices", f"""
WITH {BARS_SQL}, a AS (SELECT *, {TP} AS tp, coalesce(((close - low) - (high - close)) / nullif(high - low, 0), 0) * volume AS mf FROM bars), b AS (SELECT *, tp - {S_BARS.lag('tp')} AS d, tp * volume AS pv FROM a),
c AS (SELECT *, CASE WHEN d > 0 THEN pv WHEN d IS NOT NULL THEN 0 END AS u, CASE WHEN d < 0 THEN pv WHEN d IS NOT NULL THEN 0 END AS w, sum(pv) {S_BARS.upto} / nullif(sum(volume) {S_BARS.upto}, 0) AS vwap FROM b)
SELECT {K}, {rounded({'typical_price': 'tp', 'vwap': 'vwap', 'rolling_vwap_20': f"({S_BARS.sum('pv', 20)}) / nullif({S_BARS.sum(V, 20)}, 0)", 'close_vwap_dist': 'close / nullif(vwap, 0) - 1', 'mfi_14': f"100 * ({S_BARS.sum('u', 14)}) / nullif(({S_BARS.sum('u', 14)}) + ({S_BARS.sum('w', 14)}), 0)", 'cmf_20': f"({S_BARS.sum('mf', 20)}) / nullif({S_BARS.sum(V, 20)}, 0)"})} FROM c""")
def vol_prices(spark, sf_dir):
    return finish(volume.compute_vwap_metrics(bars(spark, sf_dir), BARS), "symbol", "bar", "typical_price", "vwap", "rolling_vwap_20", "close_vwap_dist", "mfi_14", "cmf_20")


@query("vol_flow", f"""
WITH {BARS_SQL} SELECT {K}, {rounded({'volume_delta': 'buy_volume - sell_volume', 'volume_imbalance': '(buy_volume - sell_volume) / nullif(buy_volume + sell_volume, 0)', 'cvd': f'sum(buy_volume - sell_volume) {S_BARS.upto}'})} FROM bars""")
def vol_flow(spark, sf_dir):
    return finish(volume.compute_order_flow_metrics(bars(spark, sf_dir), BARS), "symbol", "bar", "volume_delta", "volume_imbalance", "cvd")


@query("vol_features", f"""
WITH {BARS_SQL} SELECT {K}, {r(f'volume / nullif({S_BARS.avg(V, 20)}, 0) * sign(close - open)')} AS breakout_volume_score FROM bars""")
def vol_features(spark, sf_dir):
    return finish(volume.add_volume_features(bars(spark, sf_dir), BARS), "symbol", "bar", "breakout_volume_score")
