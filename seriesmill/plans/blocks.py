"""Queries of order books, event flow, outlier events and views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import events, microstructure, views
from .inputs import BARS, BARS_SQL, BOOK_SQL, HOUR, TRADES_SQL, bars, book, finish, points, query, r, rounded, table, trades

_SIDE = "CASE WHEN side IN ('buy', 'bid') THEN 'buy' ELSE 'sell' END"
TOPS = microstructure.LEVELS


def _top(side: str, n: int) -> str:
    return f"coalesce(sum(notional) FILTER (side = '{side}' AND level <= {n}), 0)"


BOOK_METRICS_SQL = f"""{BOOK_SQL}, ranked AS (SELECT *, row_number() OVER (PARTITION BY block, side ORDER BY CASE WHEN side = 'bid' THEN -price ELSE price END, tie) AS level FROM book),
m AS (SELECT block, max(price) FILTER (side = 'bid' AND level = 1) AS bb, max(price) FILTER (side = 'ask' AND level = 1) AS ba, max(quantity) FILTER (side = 'bid' AND level = 1) AS bq, max(quantity) FILTER (side = 'ask' AND level = 1) AS aq,
  coalesce(sum(notional) FILTER (side = 'bid'), 0) AS tb, coalesce(sum(notional) FILTER (side = 'ask'), 0) AS ta, count(*) FILTER (side = 'bid') AS nb, count(*) FILTER (side = 'ask') AS na,
  {', '.join(f'{_top(s, n)} AS {s}{n}' for s in ('bid', 'ask') for n in TOPS)} FROM ranked GROUP BY block HAVING count(*) FILTER (side = 'bid') > 0 AND count(*) FILTER (side = 'ask') > 0),
metrics AS (SELECT block, nb AS bid_levels, na AS ask_levels, bb AS best_bid, ba AS best_ask, ba - bb AS spread, (ba + bb) / 2 AS mid_price, (bb * aq + ba * bq) / nullif(bq + aq, 0) AS weighted_mid_price, (ba - bb) / nullif((ba + bb) / 2, 0) * 10000 AS spread_bps,
  tb AS total_bid_notional, ta AS total_ask_notional, (tb - ta) / nullif(tb + ta, 0) AS orderbook_imbalance_total, {', '.join(f'bid{n} AS bid_notional_top_{n}, ask{n} AS ask_notional_top_{n}, (bid{n} - ask{n}) / nullif(bid{n} + ask{n}, 0) AS depth_imbalance_top_{n}' for n in TOPS)},
  bid10 / nullif(bid10 + ask10, 0) AS bid_wall_score, ask10 / nullif(bid10 + ask10, 0) AS ask_wall_score FROM m)"""
_DOUBLES = ["best_bid", "best_ask", "spread", "mid_price", "weighted_mid_price", "spread_bps", "total_bid_notional", "total_ask_notional", "orderbook_imbalance_total", *[f"{k}_top_{n}" for n in TOPS for k in ("bid_notional", "ask_notional", "depth_imbalance")], "bid_wall_score", "ask_wall_score"]


def book_metrics_of(spark, sf_dir):
    return microstructure.orderbook_metrics(book(spark, sf_dir), ["block"], tie="tie")


@query("book_metrics", f"WITH {BOOK_METRICS_SQL} SELECT block, bid_levels, ask_levels, {rounded({c: c for c in _DOUBLES})} FROM metrics")
def book_metrics(spark, sf_dir):
    return finish(book_metrics_of(spark, sf_dir), "block", "bid_levels", "ask_levels", *_DOUBLES)


@query("book_side_by_side", f"""
WITH {BOOK_SQL}, ranked AS (SELECT *, row_number() OVER (PARTITION BY block, side ORDER BY CASE WHEN side = 'bid' THEN -price ELSE price END, tie) AS level FROM book)
SELECT block, level::INTEGER AS level, {', '.join(f"{r(f'''max({c}) FILTER (side = '{s}')''')} AS {s}_{c}" for s in ('bid', 'ask') for c in ('price', 'quantity', 'notional'))} FROM ranked GROUP BY block, level""")
def book_side_by_side(spark, sf_dir):
    return finish(microstructure.side_by_side(book(spark, sf_dir), ["block"], tie="tie"))


def _flow_side(k: str) -> dict[str, str]:
    f = f"FILTER ({_SIDE} = '{k}')"
    return {f"{k}_notional": f"coalesce(sum(notional) {f}, 0)", f"{k}_vwap": f"sum(price * quantity) {f} / nullif(sum(quantity) {f}, 0)"}


_B, _S = f"coalesce(sum(notional) FILTER ({_SIDE} = 'buy'), 0)", f"coalesce(sum(notional) FILTER ({_SIDE} = 'sell'), 0)"
FLOW = _flow_side("buy") | _flow_side("sell") | {
    "total_notional": f"{_B} + {_S}", "flow_imbalance": f"({_B} - {_S}) / nullif({_B} + {_S}, 0)", "event_age_seconds_mean": "avg(age_seconds)", "event_age_seconds_max": "max(age_seconds)", "event_age_seconds_min": "min(age_seconds)",
    "whale_order_age_seconds_mean": "avg(active_duration_seconds)", "whale_order_age_seconds_max": "max(active_duration_seconds)", "whale_order_age_seconds_min": "min(active_duration_seconds)",
    "whale_order_age_minutes_mean": "avg(active_duration_seconds) / 60", "whale_order_age_minutes_max": "max(active_duration_seconds) / 60",
}


def flow_of(spark, sf_dir):
    return microstructure.event_flow_metrics(trades(spark, sf_dir), ["block"])


@query("event_flow", f"""
WITH {TRADES_SQL} SELECT block, count(*) AS total_count, count(*) FILTER ({_SIDE} = 'buy') AS buy_count, count(*) FILTER ({_SIDE} = 'sell') AS sell_count, {rounded(FLOW)} FROM trades GROUP BY block""")
def event_flow(spark, sf_dir):
    return finish(flow_of(spark, sf_dir), "block", "total_count", "buy_count", "sell_count", *FLOW)


# --- events ------------------------------------------------------------------------------------------------

OUTLIERS_SQL = """p AS (SELECT user_id % 4 AS block, event_type AS metric, ts, event_id, value FROM events), st AS (SELECT block, metric, avg(value) AS m, stddev_samp(value) AS sd FROM p GROUP BY 1, 2),
z AS (SELECT p.*, (value - m) / sd AS z FROM p JOIN st USING (block, metric) WHERE sd > 0 AND abs((value - m) / sd) >= 2),
k AS (SELECT *, row_number() OVER (PARTITION BY block, metric ORDER BY abs(z) DESC, ts, event_id) AS r1 FROM z), o AS (SELECT *, row_number() OVER (PARTITION BY block ORDER BY ts, metric, event_id) AS r2 FROM k WHERE r1 <= 25)"""


def outliers(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 4).alias("block"), F.col("event_type").alias("metric"), "ts", "event_id", "value")
    return events.extract_events(e, ["block"], ("ts", "event_id"), F.when(F.col("block") == 0, "liquidations").when(F.col("block") == 1, "mining_network_health").otherwise("prices_ohlcv"))


_TYPE = "CASE WHEN block = 0 THEN 'liquidation_spike' WHEN block = 1 THEN 'miner_pressure_event' WHEN z >= 0 THEN 'outlier_positive' ELSE 'outlier_negative' END"


@query("outlier_events", f"""
WITH {OUTLIERS_SQL} SELECT block, metric, event_id, {r('value')} AS value, {r('z')} AS zscore, CASE WHEN z >= 0 THEN 'positive' ELSE 'negative' END AS direction, CASE WHEN abs(z) >= 3 THEN 'high' ELSE 'medium' END AS severity, {_TYPE} AS event_type FROM o WHERE r2 <= 150""")
def outlier_events(spark, sf_dir):
    return finish(outliers(spark, sf_dir), "block", "metric", "event_id", "value", "zscore", "direction", "severity", "event_type")


@query("outlier_counts", f"WITH {OUTLIERS_SQL} SELECT block, {_TYPE} AS event_type, CASE WHEN abs(z) >= 3 THEN 'high' ELSE 'medium' END AS severity, count(*) AS events FROM o WHERE r2 <= 150 GROUP BY 1, 2, 3")
def outlier_counts(spark, sf_dir):
    return events.event_counts(outliers(spark, sf_dir), ["block"])


@query("native_events", f"""
WITH {TRADES_SQL} SELECT block, event_id, side AS direction, {r('coalesce(nullif(notional, 0), nullif(quantity, 0))')} AS value, 'notional_usdt' AS metric, CASE WHEN abs(coalesce(nullif(notional, 0), nullif(quantity, 0))) >= 1000000 THEN 'high' ELSE 'medium' END AS severity, 'native event record' AS reason FROM trades""")
def native_events(spark, sf_dir):
    return finish(events.native_events(trades(spark, sf_dir)), "block", "event_id", "direction", "value", "metric", "severity", "reason")


# --- views -------------------------------------------------------------------------------------------------


@query("view_hourly_bars", f"WITH {BARS_SQL} SELECT symbol, bar, {rounded({c: c for c in ('open', 'high', 'low', 'close', 'volume')})} FROM bars")
def view_hourly_bars(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumnRenamed("event_type", "symbol")
    return finish(views.bucket_bars(e, ["symbol"], "ts", "event_id", "value", F.expr(f"unix_micros(cast(ts as timestamp)) div {HOUR}"), (1 + F.col("user_id") % 10).cast("double")))


@query("view_flat_bars", f"SELECT event_type AS series, event_id, {rounded({c: 'value' for c in ('open', 'high', 'low', 'close')})}, NULL::DOUBLE AS volume FROM events")
def view_flat_bars(spark, sf_dir):
    return finish(views.time_series_to_bars(points(spark, sf_dir).drop("ts"), excluded=("event_id",)))


@query("view_book_bars", f"WITH {BOOK_METRICS_SQL} SELECT block, {rounded({c: 'mid_price' for c in ('open', 'high', 'low', 'close')})}, NULL::DOUBLE AS volume FROM metrics")
def view_book_bars(spark, sf_dir):
    return finish(views.orderbook_to_bars(book_metrics_of(spark, sf_dir).select("block", "mid_price")))


@query("view_conversion", "SELECT event_type AS series, 'numeric_series_to_ohlc' AS method, 'value' AS reference_column, count(*) AS source_rows, count(*) AS derived_rows FROM events GROUP BY 1")
def view_conversion(spark, sf_dir):
    return views.time_series_to_candlestick(points(spark, sf_dir), ["series"])[1]


@query("view_ohlc_windows", """
WITH n AS (SELECT event_type AS series, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events),
w AS (SELECT *, unnest(range(greatest(0, ceil((rn - 19) / 5.0)::BIGINT), least(rn // 5, (n - 20) // 5) + 1)) AS window_id FROM n)
SELECT series, window_id, first(value ORDER BY rn) AS open, max(value) AS high, min(value) AS low, last(value ORDER BY rn) AS close, min(rn) AS start_idx, max(rn) AS end_idx FROM w GROUP BY 1, 2""")
def view_ohlc_windows(spark, sf_dir):
    from .inputs import POINTS

    return views.series_to_ohlc_windows(points(spark, sf_dir), POINTS, "value", 20, 5)


@query("view_time_series", f"WITH {BARS_SQL} SELECT symbol, bar, {rounded({c: c for c in ('open', 'high', 'low', 'close', 'volume')})} FROM bars")
def view_time_series(spark, sf_dir):
    return finish(views.candlestick_to_time_series(bars(spark, sf_dir), (*BARS.keys, *BARS.order)))
