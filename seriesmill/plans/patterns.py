"""Queries of candle, chart, liquidity, flow, mining and on-chain patterns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import patterns
from ..series import bounded
from .blocks import BOOK_METRICS_SQL, FLOW, book_metrics_of, flow_of
from .inputs import BARS, BARS_SQL, TRADES_SQL, bars, finish, query

K = ["symbol", "bar"]
_W = "OVER (PARTITION BY symbol ORDER BY bar)"
_SHAPES = f"""s0 AS (SELECT symbol, bar, open AS o, high AS h, low AS l, close AS c, high - low AS g, abs(close - open) AS body, high - greatest(open, close) AS up, least(open, close) - low AS dn FROM bars),
s1 AS (SELECT *, coalesce(body / nullif(g, 0), 0) AS b, coalesce(up / nullif(g, 0), 0) AS u, coalesce(dn / nullif(g, 0), 0) AS d, c > o AS bull, c < o AS bear FROM s0),
s2 AS (SELECT *, {', '.join(f'lag({x}, {k}) {_W} AS {p}{x}' for k, p in ((1, 'p'), (2, 'q')) for x in ('o', 'h', 'l', 'c', 'g', 'b', 'bull', 'bear'))},
  sign(c - first_value(c) OVER (PARTITION BY symbol ORDER BY bar ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)) AS t FROM s1)"""
_HANG, _STAND = "dn >= 2 * body AND up <= body AND b <= 0.35", "up >= 2 * body AND dn <= body AND b <= 0.35"
_IN, _NEAR = "least(o, c) >= least(po, pc) AND greatest(o, c) <= greatest(po, pc)", "greatest(pg, g, 1.0) * 0.002"
_SOLID = "b > 0.2 AND pb > 0.2 AND qb > 0.2"
ONE, TWO, THREE, MORE = "single_candle", "two_candle", "three_candle", "continuation_indecision"
#: name, category, direction (SQL), confidence (SQL), condition, span
CANDLES = (
    ("doji", ONE, "'neutral'", "0.72", "b <= 0.1", 1),
    ("dragonfly_doji", ONE, "'bullish'", "0.76", "b <= 0.1 AND d >= 0.6 AND u <= 0.1", 1),
    ("gravestone_doji", ONE, "'bearish'", "0.76", "b <= 0.1 AND u >= 0.6 AND d <= 0.1", 1),
    ("spinning_top", ONE, "'neutral'", "0.68", "b > 0.1 AND b <= 0.35 AND u >= 0.2 AND d >= 0.2", 1),
    ("marubozu", ONE, "CASE WHEN bull THEN 'bullish' WHEN bear THEN 'bearish' ELSE 'neutral' END", "0.80", "b >= 0.85 AND u <= 0.05 AND d <= 0.05", 1),
    ("hammer", ONE, "'bullish'", "CASE WHEN t < 0 THEN 0.78 ELSE 0.66 END", _HANG, 1),
    ("inverted_hammer", ONE, "'bullish'", "CASE WHEN t < 0 THEN 0.74 ELSE 0.64 END", _STAND, 1),
    ("shooting_star", ONE, "'bearish'", "CASE WHEN t > 0 THEN 0.78 ELSE 0.62 END", _STAND, 1),
    ("hanging_man", ONE, "'bearish'", "CASE WHEN t > 0 THEN 0.76 ELSE 0.62 END", _HANG, 1),
    ("bullish_engulfing", TWO, "'bullish'", "0.82", "pbear AND bull AND o <= pc AND c >= po", 2),
    ("bearish_engulfing", TWO, "'bearish'", "0.82", "pbull AND bear AND o >= pc AND c <= po", 2),
    ("bullish_harami", TWO, "'bullish'", "0.70", f"pbear AND pb >= 0.5 AND NOT bear AND {_IN}", 2),
    ("bearish_harami", TWO, "'bearish'", "0.70", f"pbull AND pb >= 0.5 AND NOT bull AND {_IN}", 2),
    ("piercing_line", TWO, "'bullish'", "0.76", "pbear AND bull AND o < least(pl, pc) AND c > (po + pc) / 2 AND c < po", 2),
    ("dark_cloud_cover", TWO, "'bearish'", "0.76", "pbull AND bear AND o > greatest(ph, pc) AND c < (po + pc) / 2 AND c > po", 2),
    ("tweezer_top", TWO, "'bearish'", "0.66", f"abs(ph - h) <= {_NEAR} AND NOT pbear AND NOT bull", 2),
    ("tweezer_bottom", TWO, "'bullish'", "0.66", f"abs(pl - l) <= {_NEAR} AND NOT pbull AND NOT bear", 2),
    ("morning_star", THREE, "'bullish'", "0.78", "qbear AND qb >= 0.5 AND pb <= 0.35 AND bull AND c > (qo + qc) / 2", 3),
    ("evening_star", THREE, "'bearish'", "0.78", "qbull AND qb >= 0.5 AND pb <= 0.35 AND bear AND c < (qo + qc) / 2", 3),
    ("three_white_soldiers", THREE, "'bullish'", "0.82", f"qbull AND pbull AND bull AND {_SOLID} AND qc < pc AND pc < c", 3),
    ("three_black_crows", THREE, "'bearish'", "0.82", f"qbear AND pbear AND bear AND {_SOLID} AND qc > pc AND pc > c", 3),
    ("inside_bar", MORE, "'neutral'", "0.68", "h < ph AND l > pl", 2),
    ("outside_bar", MORE, "'neutral'", "0.68", "h > ph AND l < pl", 2),
    ("bullish_kicker", MORE, "'bullish'", "0.74", "pbear AND bull AND (o > po OR b >= 0.6)", 2),
    ("bearish_kicker", MORE, "'bearish'", "0.74", "pbull AND bear AND (o < po OR b >= 0.6)", 2),
)


def union(rules, source: str, keep: str) -> str:
    return " UNION ALL ".join(f"SELECT {keep}, '{name}' AS name, '{kind}' AS category, {way} AS direction, ({sure})::DOUBLE AS confidence, {span} AS span FROM {source} WHERE {holds}" for name, kind, way, sure, holds, span in rules)


CANDLES_SQL = f"{BARS_SQL}, {_SHAPES}, found AS ({union(CANDLES, 's2', 'symbol, bar')})"


def candles(spark, sf_dir):
    return bounded(bars(spark, sf_dir), BARS, 6, lambda d, s: patterns.candlestick_patterns(d, s, [*K, *[c for c in ("_halo", "_rn", "_chunk") if c in d.columns]]))


@query("pat_candles", f"WITH {CANDLES_SQL} SELECT * FROM found")
def pat_candles(spark, sf_dir):
    return finish(candles(spark, sf_dir))


@query("pat_summary", f"""
WITH {CANDLES_SQL} SELECT symbol, count(*) AS total_patterns, count(*) FILTER (direction = 'bullish') AS bullish_count, count(*) FILTER (direction = 'bearish') AS bearish_count, count(*) FILTER (direction = 'neutral') AS neutral_count,
  count(*) FILTER (confidence >= 0.75) AS high_confidence_count, array_to_string(list_sort(list(DISTINCT category)), ',') AS active_categories FROM found GROUP BY symbol""")
def pat_summary(spark, sf_dir):
    return patterns.pattern_summary(candles(spark, sf_dir), ["symbol"]).withColumn("active_categories", F.array_join("active_categories", ","))


@query("pat_candles_last", f"WITH {CANDLES_SQL} SELECT found.* FROM found JOIN (SELECT symbol AS sy, max(bar) AS top FROM bars GROUP BY 1) e ON e.sy = symbol AND bar = top WHERE category <> 'chart_pattern'")
def pat_candles_last(spark, sf_dir):
    return finish(patterns.detect("candlestick", bars(spark, sf_dir), BARS).where("category <> 'chart_pattern'"))


@query("pat_flags", f"""
WITH {BARS_SQL}, {_SHAPES} SELECT symbol, bar, CASE WHEN bull THEN 'bullish' WHEN bear THEN 'bearish' ELSE 'neutral' END AS candle_class, b <= 0.1 AS doji, {_HANG} AS hammer,
  coalesce(pbear AND bull AND o <= pc AND c >= po, false) AS bullish_engulfing, coalesce(pbull AND bear AND o >= pc AND c <= po, false) AS bearish_engulfing FROM s2""")
def pat_flags(spark, sf_dir):
    return patterns.compute_candlestick_patterns(bars(spark, sf_dir), BARS).select(*K, "candle_class", "doji", "hammer", "bullish_engulfing", "bearish_engulfing")


# --- charts ------------------------------------------------------------------------------------------------

_SWINGS = """w AS (SELECT symbol, bar, high, low, close, count(*) OVER v AS n, max(high) OVER v AS hh, min(low) OVER v AS ll FROM bars WINDOW v AS (PARTITION BY symbol ORDER BY bar ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
swings AS (SELECT symbol, bar, close, 'high' AS kind, 0 AS nth, high AS value FROM w WHERE n = 5 AND high = hh UNION ALL SELECT symbol, bar, close, 'low', 1, low FROM w WHERE n = 5 AND low = ll)"""


@query("pat_swings", f"WITH {BARS_SQL}, {_SWINGS} SELECT symbol, bar, kind, nth, value FROM swings")
def pat_swings(spark, sf_dir):
    return patterns.swing_points(bars(spark, sf_dir), BARS).select("symbol", "bar", "kind", "nth", "value")


_V = "OVER (PARTITION BY symbol ORDER BY bar, nth)"
_HS = f"""l AS (SELECT *, {', '.join(f'lag(kind, {i}) {_V} AS k{i}, lag(value, {i}) {_V} AS v{i}' for i in range(1, 5))} FROM swings),
f AS (SELECT * FROM l WHERE k1 <> kind AND k2 <> k1 AND k3 <> k2 AND k4 <> k3 AND abs(v4 - value) / greatest(abs(v4), abs(value), 1.0) <= 0.08)"""
_HS_RULES = (
    ("head_and_shoulders", "chart_pattern", "'bearish'", "CASE WHEN close < least(v1, v3) THEN 0.66 ELSE 0.52 END", "kind = 'high' AND v2 > v4 * 1.03 AND v2 > value * 1.03", 5),
    ("inverse_head_and_shoulders", "chart_pattern", "'bullish'", "CASE WHEN close > greatest(v1, v3) THEN 0.66 ELSE 0.52 END", "kind = 'low' AND v2 < v4 * 0.97 AND v2 < value * 0.97", 5),
)


@query("pat_head_shoulders", f"WITH {BARS_SQL}, {_SWINGS}, {_HS} {union(_HS_RULES, 'f', 'symbol, bar')}")
def pat_head_shoulders(spark, sf_dir):
    return finish(patterns.head_and_shoulders(patterns.swing_points(bars(spark, sf_dir), BARS), BARS))


_PEN = f"pen AS (SELECT *, lag(close, 15) {_W} AS c0, lag(close, 10) {_W} AS c1, lag(high, 9) {_W} AS h0, lag(low, 9) {_W} AS l0, lag(high) {_W} AS h1, lag(low) {_W} AS l1 FROM bars)"
_NARROW = "h0 - l0 > 0 AND high - low < (h0 - l0) * 0.75 AND high < h0 AND low > l0"
_CH = "(c1 - c0) / greatest(abs(c0), 1.0)"
_PEN_RULES = (
    ("bullish_pennant", "chart_pattern", "'bullish'", "CASE WHEN close > h1 THEN 0.64 ELSE 0.5 END", f"{_NARROW} AND {_CH} >= 0.02", 16),
    ("bearish_pennant", "chart_pattern", "'bearish'", "CASE WHEN close < l1 THEN 0.64 ELSE 0.5 END", f"{_NARROW} AND {_CH} <= -0.02", 16),
)


@query("pat_pennants", f"WITH {BARS_SQL}, {_PEN} {union(_PEN_RULES, 'pen', 'symbol, bar')}")
def pat_pennants(spark, sf_dir):
    return finish(patterns.pennants(bars(spark, sf_dir), BARS))


# --- blocks ------------------------------------------------------------------------------------------------

_LIQ = (
    ("bid_liquidity_dominance", "liquidity", "'bullish'", "0.72", "orderbook_imbalance_total > 0.2", 1), ("ask_liquidity_dominance", "liquidity", "'bearish'", "0.72", "orderbook_imbalance_total < -0.2", 1),
    ("bid_wall", "liquidity", "'bullish'", "0.76", "bid_wall_score > 0.65", 1), ("ask_wall", "liquidity", "'bearish'", "0.76", "ask_wall_score > 0.65", 1), ("wide_spread", "liquidity", "'neutral'", "0.68", "spread_bps > 10", 1),
)


@query("pat_liquidity", f"WITH {BOOK_METRICS_SQL} {union(_LIQ, 'metrics', 'block')}")
def pat_liquidity(spark, sf_dir):
    return finish(patterns.liquidity_patterns(book_metrics_of(spark, sf_dir), ["block"]))


_WHALE, _LARGE = "block % 2 = 0", "block % 2 = 1"
_FLOW = (
    ("buy_flow_dominance", "event_flow", "'bullish'", "0.72", "flow_imbalance > 0.4", 1), ("sell_flow_dominance", "event_flow", "'bearish'", "0.72", "flow_imbalance < -0.4", 1),
    ("old_whale_order_still_active", "event_flow", "'neutral'", "0.68", f"{_WHALE} AND whale_order_age_minutes_max > 180", 1), ("persistent_whale_liquidity", "event_flow", "'neutral'", "0.7", f"{_WHALE} AND whale_order_age_minutes_mean > 60", 1),
    ("whale_liquidity_persistence", "event_flow", "'neutral'", "0.7", f"{_WHALE} AND whale_order_age_minutes_mean > 60", 1), ("recent_large_trade_cluster", "event_flow", "'neutral'", "0.7", f"{_LARGE} AND event_age_seconds_max < 600", 1),
    ("large_trade_cluster", "event_flow", "'neutral'", "0.7", f"{_LARGE} AND event_age_seconds_max < 600", 1),
)


@query("pat_flow", f"WITH {TRADES_SQL}, flow AS (SELECT block, {', '.join(f'{x} AS {k}' for k, x in FLOW.items())} FROM trades GROUP BY block) {union(_FLOW, 'flow', 'block')}")
def pat_flow(spark, sf_dir):
    return finish(patterns.flow_patterns(flow_of(spark, sf_dir), ["block"], F.when(F.col("block") % 2 == 0, "orderbook_whale_orders").otherwise("orderbook_large_trades")))


_MINE = {"miner_ratio": "close / nullif(open, 0)", "miner_inflow_btc": "buy_volume", "miner_outflow_btc": "sell_volume", "miner_netflow_btc": "buy_volume - sell_volume", "hash_rate": "high", "difficulty": "volume"}
_MP = f"(SELECT *, lag(hash_rate) {_W} AS ph, lag(difficulty) {_W} AS pd FROM mine)"
_HC, _DC = "(hash_rate - ph) / nullif(abs(ph), 0)", "(difficulty - pd) / nullif(abs(pd), 0)"
_MINING = (
    ("miner_pressure_high", "mining_regime", "'bearish'", "0.74", "miner_ratio >= 1.2", 1), ("miner_distribution", "mining_regime", "'bearish'", "0.7", "miner_netflow_btc < 0 OR miner_outflow_btc > miner_inflow_btc", 1),
    ("miner_accumulation", "mining_regime", "'bullish'", "0.7", "miner_netflow_btc > 0", 1), ("hash_rate_expansion", "mining_regime", "'bullish'", "0.68", f"{_HC} >= 0.02", 1), ("hash_rate_contraction", "mining_regime", "'bearish'", "0.68", f"{_HC} <= -0.02", 1),
    ("network_stress", "mining_regime", "'bearish'", "0.76", f"miner_ratio >= 1.5 OR ({_DC} > 0 AND {_HC} < 0)", 1),
)


@query("pat_mining", f"WITH {BARS_SQL}, mine AS (SELECT symbol, bar, {', '.join(f'{x} AS {k}' for k, x in _MINE.items())} FROM bars), m AS {_MP} {union(_MINING, 'm', 'symbol, bar')}")
def pat_mining(spark, sf_dir):
    b = bars(spark, sf_dir).selectExpr(*K, *[f"{x.replace('close / nullif(open, 0)', 'try_divide(close, open)')} AS {k}" for k, x in _MINE.items()])
    return finish(patterns.mining_patterns(b, BARS))


_CHAIN = {"accumulation_score": "close / 100", "distribution_score": "open / 100", "exchange_balance_btc": "volume", "mvrv": "high / 50", "sopr": "close / nullif(open, 0)", "long_term_holder_supply": "buy_volume", "short_term_holder_supply": "sell_volume"}
_XC = "(exchange_balance_btc - px) / nullif(abs(px), 0)"
_ONCHAIN = (
    ("accumulation_regime", "onchain_regime", "'bullish'", "0.72", "accumulation_score >= 0.6", 1), ("distribution_regime", "onchain_regime", "'bearish'", "0.72", "distribution_score >= 0.6", 1),
    ("holder_confidence_high", "onchain_regime", "'bullish'", "0.68", "long_term_holder_supply > short_term_holder_supply", 1), ("profit_taking_risk", "onchain_regime", "'bearish'", "0.7", "mvrv >= 2.5 OR sopr >= 1.05", 1),
    ("capitulation_risk", "onchain_regime", "'bearish'", "0.7", "mvrv <= 0.9 OR sopr < 1", 1), ("exchange_balance_rising", "onchain_regime", "'bearish'", "0.66", f"{_XC} >= 0.005", 1), ("exchange_balance_falling", "onchain_regime", "'bullish'", "0.66", f"{_XC} <= -0.005", 1),
)


@query("pat_onchain", f"WITH {BARS_SQL}, ch AS (SELECT symbol, bar, {', '.join(f'{x} AS {k}' for k, x in _CHAIN.items())} FROM bars), m AS (SELECT *, lag(exchange_balance_btc) {_W} AS px FROM ch) {union(_ONCHAIN, 'm', 'symbol, bar')}")
def pat_onchain(spark, sf_dir):
    b = bars(spark, sf_dir).selectExpr(*K, *[f"{x.replace('close / nullif(open, 0)', 'try_divide(close, open)')} AS {k}" for k, x in _CHAIN.items()])
    return finish(patterns.onchain_patterns(b, BARS))
