"""From payload text to typed rows: unwrap, normalise, detect, route, and the frames of each kind of block.

A payload is one JSON document (source_name, payload). Records stay maps of text until a frame casts what it needs, so
no schema is inferred per file and nothing is read twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import age_seconds, first_true, number, present, unix_seconds

RECORDS = "array<map<string,string>>"
TIME_NAMES = ("timestamp", "time", "t", "datetime", "date")
#: Names that never are metrics.
NOT_METRICS = ("timestamp", "timestamp_utc", "time", "t", "datetime", "date", "timeframe", "symbol", "exchange", "side", "window", "aggressor_side", "flow_direction", "exchange_interpretation", "dominant_side_liquidated", "derivatives_pressure", "sentiment_regime", "placed_at", "snapshot_time")


def _json(payload: Column | str, path: str) -> Column:
    return F.get_json_object(payload, path)


def _list(text: Column) -> Column:
    """Records of a JSON array of objects, or of one object; anything else gives none."""
    t = F.trim(text)
    return F.coalesce(F.from_json(F.when(t.startswith("["), t).when(t.startswith("{"), F.concat(F.lit("["), t, F.lit("]"))), RECORDS), F.array().cast(RECORDS))


# --- provider responses ------------------------------------------------------------------------------------


def unwrap(provider: Column, response: Column) -> Column:
    """Records of a provider's response; Glassnode keeps t as timestamp and v as value."""
    bare = F.trim(response).startswith("[")
    data = F.when(provider == "cryptoquant", _json(response, "$.result.data")).when(bare, F.when(~provider.isin("coinglass", "volmex", "cme_cf_benchmarks"), response)).otherwise(F.when(provider != "glassnode", _json(response, "$.data")))
    found = F.filter(_list(data), lambda m: m.isNotNull())
    short = F.transform(found, lambda m: F.create_map(F.lit("timestamp"), m["t"], F.lit("value"), m["v"]))
    return F.when(provider == "glassnode", short).otherwise(found)


def normalise_records(raw: DataFrame, keys: list[str], provider: str = "provider", response: str = "response") -> DataFrame:
    """raw -> one row for each record that stays: keys, pos, timestamp (unix seconds), record, values.

    Of records of one payload and timestamp the first in input order stays; those without a timestamp all stay. `values`
    holds what is numeric, numeric text included. A payload's records come in order of (timestamp or 0, pos).
    """
    rows = raw.select(*keys, F.posexplode(unwrap(F.col(provider), F.col(response))).alias("pos", "record"))
    at = F.coalesce(*[present(F.col("record")[c]) for c in TIME_NAMES])
    rows = rows.withColumn("timestamp", unix_seconds(at))
    first = F.row_number().over(W.partitionBy(*keys, "timestamp").orderBy("pos"))
    rows = rows.withColumn("_n", first).where("_n = 1 or timestamp is null").drop("_n")
    numeric = F.map_filter(F.transform_values("record", lambda _, v: number(v)), lambda _, v: v.isNotNull())
    return rows.withColumn("values", numeric)


def sorted_records(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.orderBy(*keys, F.coalesce("timestamp", F.lit(0)), "pos")


def quality(raw: DataFrame, rows: DataFrame, keys: list[str], min_records: int = 0, data_type: str = "data_type", provider: str = "provider", response: str = "response") -> DataFrame:
    """status, records_count, min_records_required, duplicates_removed of each payload; payloads without records count."""
    asked = raw.select(*keys, F.when(F.col(data_type).isin("snapshot", "event_list", "heatmap"), 0).otherwise(min_records).alias("min_records_required"), F.size(unwrap(F.col(provider), F.col(response))).alias("_all"))
    kept = rows.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.count(F.lit(1)).alias("_kept"))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    out = asked.join(kept, on, "left").withColumn("records_count", F.coalesce("_kept", F.lit(0)))
    return out.select(*keys, F.when(F.col("records_count") >= F.col("min_records_required"), "ok").otherwise("warning").alias("status"), "records_count", "min_records_required", (F.col("_all") - F.col("records_count")).alias("duplicates_removed"))


# --- detection and routing ---------------------------------------------------------------------------------

# The keys and words by which payloads are told apart.
_MINING_KEYS = ("miner_ratio", "hash_rate", "hashrate", "miner_inflow_btc", "miner_outflow_btc", "miner_netflow_btc", "difficulty")
_CHAIN_KEYS = ("mvrv", "nvt", "sopr", "long_term_holder_supply", "short_term_holder_supply", "accumulation_score", "distribution_score", "exchange_balance_btc")
_MINING_WORDS = ("miner", "mining", "hash_rate", "hashrate", "difficulty", "network_health")
_CHAIN_WORDS = ("onchain", "on_chain", "glassnode", "holder", "cohort", "mvrv", "nvt", "sopr")
_FLOW_WORDS = ("etf", "exchange_flow", "netflow", "inflow", "outflow")
_CANDLE_KEYS = ("open", "high", "low", "close")


def _any(c: Column, words: tuple) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def _keys(names: tuple) -> Column:
    return F.array(*[F.lit(n) for n in names])


def detect(payloads: DataFrame) -> DataFrame:
    """payloads with data_type, canonical_type, confidence, symbol, timeframe, asset, provider_source, snapshot_at, family.

    One ordered chain of rules over the metadata and the keys of the payload and its first record; the first that holds
    decides.
    """
    p = F.col("payload")
    low = lambda path: F.lower(F.coalesce(_json(p, path), F.lit("")))
    rows = payloads.withColumns({"_type": low("$.metadata.data_type"), "_book": low("$.metadata.order_book_type"), "_top": F.coalesce(F.json_object_keys(p), F.array().cast("array<string>"))})
    inner = F.coalesce(F.json_object_keys(_json(p, "$.records[0]")), F.array().cast("array<string>"))
    rows = rows.withColumn("_all", F.transform(F.concat("_top", inner), F.lower))
    t, b, top, every = F.col("_type"), F.col("_book"), F.col("_top"), F.col("_all")
    has = lambda *names: F.arrays_overlap(top, _keys(names))
    both = F.array_contains(top, "bids") & F.array_contains(top, "asks")
    firsts = F.transform(F.filter(F.map_values(F.coalesce(F.from_json(p, "map<string,string>"), F.create_map().cast("map<string,string>"))), lambda v: F.trim(v).startswith("[")), lambda v: F.coalesce(F.map_keys(F.get(_list(v), F.lit(0))), F.array().cast("array<string>")))
    candle_like = F.exists(firsts, lambda k: F.size(F.array_intersect(k, _keys(_CANDLE_KEYS))) == len(_CANDLE_KEYS))
    rules = [
        (F.array_contains(top, "candles") | t.isin("candlesticks", "ohlcv", "candles"), "candlestick"),
        (_any(t, _MINING_WORDS) | F.arrays_overlap(every, _keys(_MINING_KEYS)), "mining_network_health"),
        (_any(t, _CHAIN_WORDS) | F.arrays_overlap(every, _keys(_CHAIN_KEYS)), "onchain_holder_behavior"),
        (t.contains("cvd"), "cvd"),
        (_any(t, (*_FLOW_WORDS, "liquidation", "open_interest", "long_short")) | (t == "oi"), None),
        ((t == "orderbook_conventional") | (b == "conventional"), "orderbook_conventional"),
        ((t == "orderbook_large_trades") | (b == "large_trades"), "orderbook_large_trades"),
        ((t == "orderbook_whale_orders") | (b == "whale_orders"), "orderbook_whale_orders"),
        (both, "orderbook_conventional"),
        (has("large_buy_trades", "large_sell_trades"), "orderbook_large_trades"),
        (has("whale_buy_orders", "whale_sell_orders"), "orderbook_whale_orders"),
        (F.array_contains(top, "files") & has("summary", "validation"), "manifest"),
        (candle_like, "candlestick"),
    ]
    chain, rank = None, None
    for i, (holds, name) in enumerate(rules):
        value = t if name is None else F.lit(name)
        chain = F.when(holds, value) if chain is None else chain.when(holds, value)
        rank = F.when(holds, i) if rank is None else rank.when(holds, i)
    d = F.col("data_type")
    canonical = first_true((d == "candlestick", "ohlcv"), (d == "orderbook_conventional", "book_snapshot"), (d == "orderbook_large_trades", "event_list"), (d == "orderbook_whale_orders", "event_list_with_ttl"), (d == "manifest", "metadata"), (d == "unknown", "unknown"), otherwise="time_series")
    rows = rows.withColumns({"data_type": chain.otherwise("unknown"), "_rank": rank.otherwise(99)})
    meta = {"symbol": "symbol", "timeframe": "timeframe", "asset": "asset", "provider_source": "source", "family": "family"}
    rows = rows.withColumns({k: _json(p, f"$.metadata.{v}") for k, v in meta.items()} | {"snapshot_at": F.coalesce(present(_json(p, "$.metadata.timestamp_utc")), _json(p, "$.metadata.created_at_utc"))})
    return rows.withColumns({"canonical_type": canonical, "confidence": F.when(F.col("_rank") == 99, "low").when(F.col("_rank") == len(rules) - 1, "medium").otherwise("high")}).drop("_type", "_book", "_top", "_all", "_rank")


# Families of inputs and outputs, and words that lead to one.
OFFICIAL_FAMILIES = ("prices_ohlcv", "volume_orderflow", "liquidity_microstructure", "institutional_flows", "liquidations", "derivatives_open_interest", "sentiment_positioning", "mining_network_health", "onchain_holder_behavior")
INPUT_FAMILIES = ("prices_ohlcv", "liquidity_microstructure", "volume_orderflow", "institutional_flows", "liquidations", "derivatives_open_interest", "sentiment_positioning", "on_chain_miners", "options_volatility")
_CHAIN_ROUTE = (*_CHAIN_WORDS, "accumulation", "distribution", "exchange_balance", "realized_cap", "supply_in_profit", "supply_in_loss", "long_term_holder", "short_term_holder")
_BOOKS = {"orderbook_conventional": "conventional_orderbook", "orderbook_large_trades": "large_trades_orderbook", "orderbook_whale_orders": "whale_orders_orderbook"}


def route(detected: DataFrame, kind: str = "data_type") -> DataFrame:
    """detected with family_key, output_shape, output_filename and is_metadata, by ordered rules on data_type and shape."""
    d = F.lower(F.coalesce("data_type", F.lit("")))
    shape = F.concat_ws(" ", d, F.lower(F.coalesce("canonical_type", F.lit(""))), F.lower(F.coalesce(F.col(kind), F.lit(""))))
    derived, event, bar, regime = shape.contains("derived"), shape.contains("event"), shape.contains("bar"), shape.contains("regime")
    flow = first_true((derived, "candlestick_derived"), (event, "event_list"), (bar, "bar"), otherwise="time_series")
    chain = first_true((regime, "regimes"), (event, "event_list"), (bar, "bars"), otherwise="time_series")
    mood = first_true((derived, "candlestick_derived"), (bar, "bar"), otherwise="time_series")
    oi = first_true((regime, "regimes"), (derived, "candlestick_derived"), otherwise="time_series")
    cvd = d.contains("cvd")
    volume = first_true((cvd & derived, "cvd_candlestick_derived"), (cvd, "cvd_time_series"), (bar, "volume_bar"), otherwise="volume_features")
    rules: list[tuple[Column, str, Column | str]] = [
        (_any(d, (*_MINING_WORDS, "miner_ratio", "miner_inflow", "miner_outflow", "miner_netflow")), "mining_network_health", chain), (_any(d, _CHAIN_ROUTE), "onchain_holder_behavior", chain), (d == "candlestick", "prices_ohlcv", "candlestick"),
        *[(d == k, "liquidity_microstructure", v) for k, v in _BOOKS.items()], (d == "manifest", "metadata", "manifest"), (cvd | d.contains("volume"), "volume_orderflow", volume), (_any(d, _FLOW_WORDS), "institutional_flows", flow),
        (d.contains("liquidation"), "liquidations", flow), (d.contains("long_short"), "sentiment_positioning", mood), (d.contains("open_interest") | (d == "oi"), "derivatives_open_interest", oi), (d.contains("whale"), "liquidity_microstructure", "whale_orders_orderbook"),
    ]
    family, out = None, None
    for holds, name, s in rules:
        s = F.lit(s) if isinstance(s, str) else s
        family = F.when(holds, name) if family is None else family.when(holds, name)
        out = F.when(holds, s) if out is None else out.when(holds, s)
    rows = detected.withColumns({"family_key": family.otherwise("unknown"), "output_shape": out.otherwise("unknown")})
    return rows.withColumns({"output_filename": F.concat("output_shape", F.lit(".json")), "is_metadata": F.col("family_key") == "metadata"})


_FOUR = ("time_series", "bars", "event_list", "candlestick_derived")
VARIANTS = {
    "prices_ohlcv": ("candlestick", "time_series"), "volume_orderflow": ("cvd_time_series", "cvd_candlestick_derived", "orderflow_features"), "institutional_flows": _FOUR, "liquidations": _FOUR,
    "derivatives_open_interest": ("time_series", "candlestick_derived", "regimes"), "sentiment_positioning": ("time_series", "bars", "candlestick_derived"),
    "mining_network_health": ("time_series", "bars", "event_list", "regimes"), "onchain_holder_behavior": ("time_series", "bars", "event_list", "regimes"),
}
SUBTYPES = {"orderbook_conventional": "conventional", "orderbook_large_trades": "large_trades", "orderbook_whale_orders": "whale_orders"}


def variants(routed: DataFrame, has_volume: Column | None = None) -> DataFrame:
    """One row for each (block, family, shape) that is written: a block can have several shapes.

    Candles with a volume also give volume_features of volume_orderflow; metadata and unknown families give none.
    """
    d, fam = F.col("data_type"), F.col("family_key")
    pair = lambda f, names: F.array(*[F.struct(F.lit(f).alias("f"), F.lit(s).alias("s")) for s in names])
    none = pair("", ()).cast("array<struct<f:string,s:string>>")
    prices = F.when(F.coalesce(has_volume, F.lit(False)) if has_volume is not None else F.lit(True), F.concat(pair("prices_ohlcv", VARIANTS["prices_ohlcv"]), pair("volume_orderflow", ("volume_features",)))).otherwise(pair("prices_ohlcv", VARIANTS["prices_ohlcv"]))
    books = pair("liquidity_microstructure", ("orderbook", "time_series", "bars"))
    out = F.when((fam == "prices_ohlcv") & (d == "candlestick"), prices).when((fam == "volume_orderflow") & (d == "cvd"), pair("volume_orderflow", VARIANTS["volume_orderflow"]))
    out = out.when((fam == "liquidity_microstructure") & (d == "orderbook_conventional"), books).when((fam == "liquidity_microstructure") & d.isin(*SUBTYPES), F.concat(books, pair("liquidity_microstructure", ("event_list",))))
    for f, names in VARIANTS.items():
        if f not in {"prices_ohlcv", "volume_orderflow"}:
            out = out.when(fam == f, pair(f, names))
    sub = F.create_map(*[F.lit(x) for kv in SUBTYPES.items() for x in kv])
    rows = routed.withColumn("_v", F.explode(out.otherwise(none))).withColumns({"target_family": F.col("_v.f"), "target_shape": F.col("_v.s"), "source_subtype": F.element_at(sub, d)})
    return rows.drop("_v")


def decide(detected: DataFrame) -> DataFrame:
    """Which computations and targets a block gets; has_ohlc tells whether it has a time and open, high, low, close."""
    manifest = F.col("data_type") == "manifest"
    return detected.withColumns({"apply_technical_indicators": F.col("has_ohlc") & ~manifest, "apply_statistics": ~manifest, "apply_statistical_regimes": ~manifest, "apply_patterns": ~manifest, "target_hmi": F.lit(True), "target_ml": ~manifest, "target_advanced": ~manifest})


#: Kind -> chart, overlays, panels, modules, whether series and event order are preserved.
ROUTES = {
    "candlestick": ("candlestick", ("ema_20", "ema_50", "bollinger_bands", "vwap"), ("rsi_14", "macd", "atr_14", "returns_rolling_kurtosis_30"), ("fourier", "wavelet", "kalman", "tda"), True, False),
    "orderbook_conventional": ("orderbook_depth", ("bid_wall_score", "ask_wall_score"), ("orderbook_imbalance_total", "spread_bps"), ("liquidity_map", "orderbook_pressure"), False, False),
    "orderbook_large_trades": ("event_timeline", ("buy_flow", "sell_flow"), ("flow_imbalance", "notional_usdt", "age_seconds"), ("event_clustering", "flow_imbalance", "whale_ttl_analysis"), False, True),
    "orderbook_whale_orders": ("event_timeline", ("buy_flow", "sell_flow"), ("flow_imbalance", "notional_usdt", "age_seconds"), ("event_clustering", "flow_imbalance", "whale_ttl_analysis"), False, True),
    "manifest": ("metadata_summary", (), (), (), False, False),
}


def classify(detected: DataFrame) -> DataFrame:
    """detected with chart, overlays, panels, feature flags and modules: a left join to a table of five rows."""
    spark = detected.sparkSession
    rows = [(k, c, list(o), list(p), k != "manifest", k != "manifest", list(m), s, e) for k, (c, o, p, m, s, e) in ROUTES.items()]
    t = spark.createDataFrame(rows, "_kind string, chart_type string, overlays array<string>, panels array<string>, include_feature_vector boolean, include_patterns boolean, suggested_modules array<string>, preserve_time_series boolean, preserve_event_sequence boolean")
    out = detected.join(F.broadcast(t), F.col("data_type") == F.col("_kind"), "left").drop("_kind")
    empty, no = F.array().cast("array<string>"), F.lit(False)
    return out.withColumns({c: F.coalesce(c, empty) for c in ("overlays", "panels", "suggested_modules")} | {c: F.coalesce(c, no) for c in ("include_feature_vector", "include_patterns", "preserve_time_series", "preserve_event_sequence")})


# --- frames ------------------------------------------------------------------------------------------------

BLOCK = ["source_name"]


def _texts(blocks: DataFrame, keep: list, paths: tuple) -> DataFrame:
    """keep, and the text at each path of a payload as _t0, _t1...: a payload is read through once a path."""
    return blocks.select(*keep, *[_json("payload", p).alias(f"_t{i}") for i, p in enumerate(paths)])


def _rows(blocks: DataFrame, *paths: str, keep: tuple = ()) -> DataFrame:
    """Records of the first of the paths that has any, with their position."""
    own = [*BLOCK, *keep]
    rows = _texts(blocks, own, paths)
    # A column of its own for each list, so that it is parsed once and not wherever it is named.
    rows = rows.select(*own, *[_list(F.col(f"_t{i}")).alias(f"_l{i}") for i in range(len(paths))])
    lists = [F.col(f"_l{i}") for i in range(len(paths))]
    chosen = lists[-1]
    for x in reversed(lists[:-1]):
        chosen = F.when(F.size(x) > 0, x).otherwise(chosen)
    return rows.select(*own, F.posexplode(chosen).alias("pos", "m"))


def _cell(*names: str) -> Column:
    return F.coalesce(*[F.col("m")[n] for n in names])


def _time(c: Column) -> Column:
    return F.timestamp_seconds(unix_seconds(c))


def candles(blocks: DataFrame) -> DataFrame:
    """(source_name, symbol, timeframe, ts, open, high, low, close, volume, notional_volume) of candlestick blocks."""
    rows = _rows(blocks.where("data_type = 'candlestick'"), "$.candles", "$.records", "$.data", keep=("symbol", "timeframe"))
    num = lambda *n: number(_cell(*n))
    return rows.select(*BLOCK, F.coalesce("symbol", _cell("symbol")).alias("symbol"), F.coalesce("timeframe", _cell("timeframe")).alias("timeframe"), "pos", _time(_cell("timestamp", "timestamp_utc", "time")).alias("ts"), *[num(c).alias(c) for c in _CANDLE_KEYS], num("volume", "volume_btc").alias("volume"), num("notional_volume", "volume_usdt", "volume_usd").alias("notional_volume"))


def levels(blocks: DataFrame) -> DataFrame:
    """(source_name, side, pos, price, quantity, notional) of order books; of a list of snapshots the last counts."""
    books = blocks.where("data_type = 'orderbook_conventional'")
    books = _texts(books, BLOCK, ("$.records", "$.bids", "$.asks")).withColumn("_l", _list(F.col("_t0")))
    last = F.get("_l", F.size("_l") - 1)
    # Both sides from one reading of the payloads.
    sides = [F.struct(F.lit(side).alias("side"), F.when(F.size("_l") > 0, last[name]).otherwise(F.col(text)).alias("t")) for side, name, text in (("bid", "bids", "_t1"), ("ask", "asks", "_t2"))]
    rows = books.select(*BLOCK, F.inline(F.array(*sides))).select(*BLOCK, "side", F.posexplode(_list(F.col("t"))).alias("pos", "m"))
    return rows.select(*BLOCK, "side", "pos", number(_cell("price")).alias("price"), number(_cell("quantity_btc", "quantity", "amount")).alias("quantity"), number(_cell("notional_usdt", "notional_usd", "notional")).alias("notional"))


def trades(blocks: DataFrame) -> DataFrame:
    """Events of large trades and whale orders, with ages; buys and sells of separate lists are one frame."""
    b = blocks.where("data_type in ('orderbook_large_trades', 'orderbook_whale_orders')")
    names = ("large_buy_trades", "large_sell_trades", "whale_buy_orders", "whale_sell_orders", "records")
    own = [*BLOCK, F.col("data_type").alias("kind"), _time(F.col("snapshot_at")).alias("snapshot_at")]
    texts = _texts(b, own, tuple(f"$.{n}" for n in names))
    rows = texts.select(*BLOCK, "kind", "snapshot_at", F.posexplode(F.concat(*[_list(F.col(f"_t{i}")) for i in range(len(names))])).alias("pos", "m"))
    ts, placed = _time(_cell("timestamp", "timestamp_utc", "time")), _time(_cell("placed_at", "placed_at_utc"))
    snap = _time(_cell("snapshot_time", "snapshot_time_utc"))
    rows = rows.withColumns({"ts": ts, "placed_at": placed, "snapshot_time": snap})
    return rows.select(
        *BLOCK, "kind", "pos", F.when(F.col("kind") == "orderbook_whale_orders", "whale_order").otherwise("large_trade").alias("event_type"), _cell("side").alias("side"), number(_cell("price")).alias("price"),
        number(_cell("quantity_btc", "quantity", "amount")).alias("quantity"), number(_cell("notional_usdt", "notional_usd", "notional")).alias("notional"), "ts", "placed_at", "snapshot_time",
        F.coalesce(number(_cell("age_seconds")), F.when(F.col("kind") == "orderbook_large_trades", age_seconds(F.col("snapshot_at"), F.col("ts")))).alias("age_seconds"),
        F.coalesce(number(_cell("active_duration_seconds")), age_seconds(F.col("snapshot_time"), F.col("placed_at"))).alias("active_duration_seconds"),
    )


def metrics(blocks: DataFrame) -> DataFrame:
    """Long rows (source_name, ts, pos, metric, value) of time-series blocks: every numeric cell that isn't metadata."""
    rows = _rows(blocks.where("canonical_type = 'time_series'"), "$.records", "$.data")
    cells = F.map_filter(F.transform_values("m", lambda _, v: number(v)), lambda k, v: v.isNotNull() & ~k.isin(*NOT_METRICS))
    out = rows.select(*BLOCK, "pos", _time(_cell("timestamp", "timestamp_utc", "time")).alias("ts"), F.explode(cells).alias("metric", "value"))
    return out


def first_non_null(df: DataFrame, keys: list[str], column: str, order: tuple[str, ...]) -> DataFrame:
    return df.groupBy(*keys).agg(F.min_by(column, F.when(F.col(column).isNotNull(), F.struct(*order))).alias(column))
