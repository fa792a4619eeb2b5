"""Catalogue of provider endpoints: what exists, which slots it has, whether and how it is called."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TIMEFRAMES = ("1m", "5m", "15m", "1h")
LIVE_TIMEFRAMES = ("1m", "3m", "5m", "15m", "30m", "1h", "4h", "6h", "8h", "12h", "1d", "1w")
PROVIDERS = ("coinglass", "cryptoquant", "glassnode", "external_indices")
BASE_URLS = {"coinglass": "https://open-api-v4.coinglass.com", "cryptoquant": "https://api.cryptoquant.com/v1", "glassnode": "https://api.glassnode.com/v1"}
WINDOW_TYPES = ("snapshot", "event_list", "heatmap")

# The endpoints. One line each:
#   subtype  data type (type@window for those with an extraction window)  role  live status  [path  parameters]
# under a heading of provider and family. Parameters: futures, all (several exchanges), options, etf, index, book, map.
_TABLE = """
coinglass prices_ohlcv
  spot_ohlcv candlestick primary supported /api/spot/price/history futures
  futures_ohlcv candlestick primary supported /api/futures/price/history futures
  index_price time_series primary derived /api/spot/price/history futures
  mark_price time_series primary derived /api/futures/price/history futures
coinglass liquidity_microstructure
  orderbook_conventional time_series primary supported /api/futures/orderbook/ask-bids-history futures
  orderbook_large_trades event_list@latest primary supported /api/futures/orderbook/large-limit-order book
  orderbook_whale_orders event_list@latest primary derived /api/futures/orderbook/large-limit-order book
  market_depth time_series primary supported /api/futures/orderbook/aggregated-ask-bids-history all
  bid_ask_spread time_series primary derived /api/futures/orderbook/ask-bids-history futures
  liquidity_walls event_list@latest primary derived /api/futures/orderbook/large-limit-order book
coinglass volume_orderflow
  cvd time_series primary supported /api/futures/cvd/history futures
  taker_buy_sell_volume time_series primary supported /api/futures/aggregated-taker-buy-sell-volume/history all
  volume_delta time_series primary derived /api/futures/cvd/history futures
  buy_sell_pressure time_series primary derived /api/futures/aggregated-taker-buy-sell-volume/history all
  aggressive_volume time_series primary derived /api/futures/volume/footprint-history futures
coinglass institutional_flows
  etf_flows time_series tertiary supported /api/etf/bitcoin/flow-history etf
  stablecoin_flows time_series tertiary partial /api/index/stableCoin-marketCap-history index
coinglass liquidations
  long_liquidations time_series primary supported /api/futures/liquidation/aggregated-history all
  short_liquidations time_series primary supported /api/futures/liquidation/aggregated-history all
  long_short_liquidations time_series primary supported /api/futures/liquidation/aggregated-history all
  liquidation_heatmap heatmap@24h primary supported /api/futures/liquidation/aggregated-heatmap/model1 map
  liquidation_clusters event_list@24h primary derived /api/futures/liquidation/aggregated-heatmap/model1 map
  liquidation_map snapshot@latest primary supported /api/futures/liquidation/aggregated-map map
coinglass derivatives_open_interest
  open_interest time_series primary supported /api/futures/open-interest/history futures
  open_interest_change time_series primary derived /api/futures/open-interest/history futures
  funding_rate time_series primary supported /api/futures/funding-rate/history futures
  basis time_series primary supported /api/futures/basis/history futures
  futures_premium time_series primary derived /api/futures/basis/history futures
coinglass sentiment_positioning
  long_short_ratio time_series primary supported /api/futures/global-long-short-account-ratio/history futures
  top_trader_long_short_ratio time_series primary supported /api/futures/top-long-short-account-ratio/history futures
  account_long_short_ratio time_series primary supported /api/futures/global-long-short-account-ratio/history futures
  position_long_short_ratio time_series primary supported /api/futures/top-long-short-position-ratio/history futures
  fear_greed time_series primary supported /api/index/fear-greed-history index
  sentiment_index time_series primary derived /api/index/fear-greed-history index
coinglass options_volatility
  options_open_interest time_series secondary supported /api/option/exchange-oi-history options
  options_volume time_series secondary supported /api/option/exchange-vol-history options
  put_call_ratio time_series secondary derived /api/option/exchange-oi-history options
  max_pain snapshot@latest secondary supported /api/option/max-pain options_latest
cryptoquant institutional_flows
  exchange_inflow time_series primary partial
  exchange_outflow time_series primary partial
  exchange_netflow time_series primary partial
  exchange_reserve time_series primary partial
  stablecoin_flows time_series secondary partial
cryptoquant derivatives_open_interest
  open_interest time_series tertiary partial
  funding_rate time_series tertiary partial
  estimated_leverage_ratio time_series primary partial
cryptoquant sentiment_positioning
  long_short_ratio time_series secondary partial
  sentiment_index time_series secondary partial
cryptoquant on_chain_miners
  miner_reserve time_series primary partial
  miner_inflow time_series primary partial
  miner_outflow time_series primary partial
  miner_outflow_multiple time_series primary partial
  mpi time_series primary partial
  hash_rate time_series secondary partial
  difficulty time_series secondary partial
glassnode prices_ohlcv
  spot_ohlcv candlestick secondary partial
  futures_ohlcv candlestick secondary partial
  index_price time_series secondary partial
glassnode volume_orderflow
  cvd time_series secondary partial
  volume_delta time_series secondary partial
  buy_sell_pressure time_series secondary partial
glassnode institutional_flows
  etf_flows time_series primary partial
  exchange_inflow time_series secondary partial
  exchange_outflow time_series secondary partial
  exchange_netflow time_series secondary partial
  exchange_reserve time_series secondary partial
  stablecoin_flows time_series primary partial
glassnode liquidations
  long_liquidations time_series secondary partial
  short_liquidations time_series secondary partial
  long_short_liquidations time_series secondary partial
glassnode derivatives_open_interest
  open_interest time_series secondary partial
  open_interest_change time_series secondary partial
  funding_rate time_series secondary partial
  basis time_series secondary partial
  futures_premium time_series secondary partial
  estimated_leverage_ratio time_series secondary partial
glassnode sentiment_positioning
  long_short_ratio time_series tertiary partial
  fear_greed time_series tertiary partial
  sentiment_index time_series tertiary partial
glassnode on_chain_miners
  miner_reserve time_series secondary partial
  miner_inflow time_series secondary partial
  miner_outflow time_series secondary partial
  miner_outflow_multiple time_series secondary partial
  mpi time_series secondary partial
  hash_rate time_series primary partial
  difficulty time_series primary partial
  miner_revenue time_series primary partial
glassnode options_volatility
  implied_volatility time_series primary partial
  realized_volatility time_series primary partial
  options_open_interest time_series primary partial
  options_volume time_series primary partial
  put_call_ratio time_series primary partial
  skew time_series primary partial
  gamma_exposure heatmap@24h primary partial
  max_pain snapshot@latest primary partial
volmex options_volatility
  bviv time_series primary external_provider_required
cme_cf_benchmarks options_volatility
  bvx time_series primary external_provider_required
"""
# The request parameters that the endpoints name.
_SERIES = {"interval": "{timeframe}", "limit": "600"}
PARAMS = {
    "futures": {"exchange": "Binance", "symbol": "BTCUSDT"} | _SERIES,
    "all": {"exchange_list": "Binance,OKX,Bybit", "symbol": "BTC"} | _SERIES,
    "options": {"exchange": "Deribit", "symbol": "BTC"} | _SERIES,
    "options_latest": {"exchange": "Deribit", "symbol": "BTC"},
    "etf": {"symbol": "BTC"} | _SERIES,
    "index": _SERIES,
    "book": {"exchange": "Binance", "symbol": "BTCUSDT"},
    "map": {"exchange_list": "Binance,OKX,Bybit", "symbol": "BTC"},
}
ROLES = ("primary", "secondary", "tertiary", "not_available")
STATUSES = ("supported", "partial", "derived", "external_provider_required", "not_available")
#: Lower comes first: by role, then by live status.
PRIORITY_ORDER = {(role, status): 10 * i + j for i, role in enumerate(ROLES) for j, status in enumerate(STATUSES)}


def endpoint(provider: str, family: str, subtype: str, data_type: str = "time_series", role: str = "primary", status: str = "partial", path: str | None = None, params: dict | None = None, windows: list[str] | None = None, synthetic_status: str = "supported") -> dict[str, Any]:
    """One endpoint with what follows from its data type: slots, template, method."""
    if path is None and status == "supported":
        raise ValueError(f"{provider}/{family}/{subtype} is supported but has no live path")
    by_time = data_type not in WINDOW_TYPES
    if windows is None:
        windows = [] if by_time else ["latest" if data_type == "snapshot" else "24h"]
    slot = "timeframe" if by_time else "extraction_window"
    skip = synthetic_status == "skip"
    folder = "external_indices" if provider not in PROVIDERS else provider
    return {
        "provider": provider, "folder": folder, "family": family, "subtype": subtype, "endpoint_name": f"{provider}_{family}_{subtype}", "path": path, "method": "GET" if path else None, "coverage_role": role, "live_status": status,
        "synthetic_status": synthetic_status, "data_type": data_type, "supports_timeframe": by_time, "live_supported_timeframes": list(LIVE_TIMEFRAMES) if path and by_time else [],
        "synthetic_timeframes": list(TIMEFRAMES) if by_time and not skip else [], "extraction_windows": windows, "response_shape": provider, "synthetic_file_template": None if skip else f"{family}/{subtype}/{{{slot}}}_raw.json", "default_params": params or {},
    }


def _parse() -> list[dict[str, Any]]:
    out, provider, family = [], "", ""
    for line in _TABLE.strip("\n").split("\n"):
        words = line.split()
        if line[0] != " ":
            provider, family = words
            continue
        subtype, kind, role, status, *rest = words
        kind, _, window = kind.partition("@")
        path, params = rest or (None, None)
        out.append(endpoint(provider, family, subtype, kind, role, status, path, PARAMS.get(params), [window] if window else None))
    return out


ENDPOINTS = _parse()
_SCHEMA = """provider string, folder string, family string, subtype string, endpoint_name string, path string, method string, coverage_role string, live_status string, synthetic_status string, data_type string,
supports_timeframe boolean, live_supported_timeframes array<string>, synthetic_timeframes array<string>, extraction_windows array<string>, response_shape string, synthetic_file_template string, default_params map<string,string>"""


def registry(spark: SparkSession, endpoints: list[dict[str, Any]] | None = None) -> DataFrame:
    """The catalogue as a table; a hundred rows, so joins may broadcast it."""
    rows = ENDPOINTS if endpoints is None else endpoints
    names = [c.split()[0] for c in _SCHEMA.replace("\n", " ").split(", ")]
    return spark.createDataFrame([tuple(e.get(n) for n in names) for e in rows], _SCHEMA)


def slots(endpoints: DataFrame, timeframes: list[str] | None = None, windows: list[str] | None = None) -> DataFrame:
    """One row for each (endpoint, timeframe) or (endpoint, extraction_window), of those that are asked for."""
    keep = lambda c, asked: F.col(c) if asked is None else F.array_intersect(c, F.array(*[F.lit(x) for x in asked]).cast("array<string>"))
    slot = F.explode(F.when(F.col("supports_timeframe"), keep("synthetic_timeframes", timeframes)).otherwise(keep("extraction_windows", windows)))
    out = endpoints.withColumn("slot", slot)
    return out.withColumns({"timeframe": F.when(F.col("supports_timeframe"), F.col("slot")), "extraction_window": F.when(~F.col("supports_timeframe"), F.col("slot")), "member": F.concat_ws("/", "family", "subtype", F.concat("slot", F.lit("_raw.json")))})


def callable_live() -> Column:
    """Whether an endpoint can be called: it has a path and needs no other provider."""
    return F.col("path").isNotNull() & ~F.col("live_status").isin("external_provider_required", "not_available")


def priority() -> Column:
    p = F.create_map(*[x for (a, b), n in PRIORITY_ORDER.items() for x in (F.lit(f"{a}|{b}"), F.lit(n))])
    return F.coalesce(F.element_at(p, F.concat_ws("|", "coverage_role", "live_status")), F.lit(999))


def resolve_endpoints(endpoints: DataFrame, best_only: bool = False) -> DataFrame:
    """Callable endpoints with their priority, the best first within each family and subtype; best_only keeps that one."""
    from pyspark.sql import Window as W

    out = endpoints.where(callable_live()).withColumn("priority", priority())
    out = out.withColumn("choice", F.row_number().over(W.partitionBy("family", "subtype").orderBy("priority", "provider")))
    return (out.where("choice = 1") if best_only else out).orderBy("family", "subtype", "choice")


def extraction_status(slotted: DataFrame, mode: str) -> DataFrame:
    """slots with callable_live and the status that a run in this mode begins with."""
    if mode not in {"synthetic", "live"}:
        raise ValueError(f"Unsupported mode: {mode}")
    out = slotted.withColumn("callable_live", F.lit(mode == "live") & callable_live())
    skipped = F.when(F.col("live_status") == "external_provider_required", "skipped_live_external_provider_required").otherwise("skipped_live_path_missing")
    return out.withColumn("status", F.when(F.lit(mode == "synthetic") | F.col("callable_live"), "ok").otherwise(skipped))


def request_params(timeframe: Column, window: Column, asset: str, symbol: str) -> Column:
    """default_params with templates filled in; empty ones are dropped."""
    fill = {"{timeframe}": timeframe, "{extraction_window}": window, "{asset}": F.lit(asset), "{symbol}": F.lit(symbol)}

    def value(_, v):
        for k, x in fill.items():
            v = F.replace(v, F.lit(k), F.coalesce(x, F.lit("")))
        return v

    return F.map_filter(F.transform_values("default_params", value), lambda _, v: v != "")
