"""Queries of the catalogue, payload normalisation, detection, routing and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import ingest, registry, sinks, synthetic, validate
from .inputs import finish, query, rounded, table

# --- catalogue ---------------------------------------------------------------------------------------------

_FAMILIES = {"prices_ohlcv": 28, "liquidity_microstructure": 15, "volume_orderflow": 32, "institutional_flows": 52, "liquidations": 27, "derivatives_open_interest": 56, "sentiment_positioning": 44, "on_chain_miners": 60, "options_volatility": 47}


@query("registry_slots", "SELECT * FROM (VALUES " + ", ".join(f"('{k}', {v}::BIGINT)" for k, v in _FAMILIES.items()) + ") t(family, payloads)")
def registry_slots(spark, sf_dir):
    """Slots of each family over all timeframes and windows."""
    return registry.slots(registry.registry(spark)).groupBy("family").agg(F.count(F.lit(1)).alias("payloads"))


def _text(x) -> str:
    return "NULL" if x is None else "'" + str(x).replace("'", "''") + "'"


#: The catalogue as SQL; the rules below are written once more in SQL.
_CATALOGUE = "e AS (SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(_text(x[c]) for c in ("provider", "family", "subtype", "endpoint_name", "path", "coverage_role", "live_status", "data_type")) + ")" for x in registry.ENDPOINTS) + ") t(provider, family, subtype, endpoint_name, path, role, status, data_type))"
_CALLABLE = "path IS NOT NULL AND status NOT IN ('external_provider_required', 'not_available')"
_PLACE = f"10 * (list_position({list(registry.ROLES)}, role) - 1) + list_position({list(registry.STATUSES)}, status) - 1"


@query("registry_best", f"""
WITH {_CATALOGUE}, p AS (SELECT *, {_PLACE} AS priority FROM e WHERE {_CALLABLE}), c AS (SELECT *, row_number() OVER (PARTITION BY family, subtype ORDER BY priority, provider) AS choice FROM p)
SELECT family, subtype, provider, priority::INTEGER AS priority, path FROM c WHERE choice = 1""")
def registry_best(spark, sf_dir):
    """The best callable endpoint of each family and subtype."""
    return registry.resolve_endpoints(registry.registry(spark), best_only=True).select("family", "subtype", "provider", "priority", "path")


@query("registry_status", "SELECT * FROM (VALUES ('live', 'ok', 38::BIGINT), ('live', 'skipped_live_path_missing', 57), ('live', 'skipped_live_external_provider_required', 2), ('synthetic', 'ok', 97)) t(mode, status, endpoints)")
def registry_status(spark, sf_dir):
    r = registry.registry(spark)
    both = [registry.extraction_status(r, m).select(F.lit(m).alias("mode"), "status") for m in ("live", "synthetic")]
    return both[0].unionByName(both[1]).groupBy("mode", "status").agg(F.count(F.lit(1)).alias("endpoints"))


_PARAMS = "d AS (SELECT * FROM (VALUES " + ", ".join(f"({_text(x['endpoint_name'])}, {_text(k)}, {_text(v)})" for x in registry.ENDPOINTS for k, v in sorted(x["default_params"].items())) + ") t(endpoint_name, k, v))"
_SLOTS = "s AS (SELECT * FROM (VALUES " + ", ".join(f"({_text(x['endpoint_name'])}, {_text(t)}, {str(x['supports_timeframe']).upper()})" for x in registry.ENDPOINTS for t in (x["synthetic_timeframes"] if x["supports_timeframe"] else x["extraction_windows"])) + ") t(endpoint_name, slot, timed))"
_FILLED = "replace(replace(replace(replace(v, '{timeframe}', CASE WHEN timed THEN slot ELSE '' END), '{extraction_window}', CASE WHEN timed THEN '' ELSE slot END), '{asset}', 'BTC'), '{symbol}', 'BTCUSDT')"


@query("registry_params", f"""
WITH {_CATALOGUE}, {_PARAMS}, {_SLOTS}, f AS (SELECT endpoint_name, slot, k, {_FILLED} AS v FROM s JOIN d USING (endpoint_name)), g AS (SELECT endpoint_name, slot, string_agg(k || '=' || v, '&' ORDER BY k) AS params FROM f WHERE v <> '' GROUP BY endpoint_name, slot)
SELECT endpoint_name, slot, coalesce(params, '') AS params FROM s JOIN e USING (endpoint_name) LEFT JOIN g USING (endpoint_name, slot) WHERE {_CALLABLE}""")
def registry_params(spark, sf_dir):
    """Request parameters of every live slot."""
    s = registry.slots(registry.registry(spark)).where(registry.callable_live())
    p = registry.request_params(F.col("timeframe"), F.col("extraction_window"), "BTC", "BTCUSDT")
    return s.select("endpoint_name", "slot", F.array_join(F.transform(F.array_sort(F.map_entries(p)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "&").alias("params"))


@query("synthetic_manifest", "SELECT * FROM (VALUES ('coinglass', 75062::BIGINT), ('cryptoquant', 40800), ('glassnode', 91211), ('external_indices', 4800)) t(folder, records_total)")
def synthetic_manifest(spark, sf_dir):
    """Records of the synthetic payloads by provider, after normalisation."""
    raw = synthetic.raw_payloads(spark)
    rows = ingest.normalise_records(raw, ["folder", "provider", "member"])
    return rows.groupBy("folder").agg(F.count(F.lit(1)).alias("records_total"))


# --- payloads made of events -------------------------------------------------------------------------------

KEYS = ["run_id", "provider", "family", "subtype", "data_type", "asset", "symbol", "exchange", "timeframe", "extraction_window"]


def event_payloads(spark, sf_dir):
    """One provider-shaped payload a day and event type: minute stamps in ms, values as text, in event order."""
    e = table(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    rec = F.struct("event_id", F.struct((F.expr("us div 60000000") * 60000).alias("time"), F.col("value").cast("string").alias("value"), F.col("event_id").alias("id")).alias("r"))
    g = e.groupBy(F.col("event_type").alias("subtype"), F.expr("us div 86400000000").alias("day")).agg(F.array_sort(F.collect_list(rec)).alias("x"))
    body = F.to_json(F.struct(F.lit("0").alias("code"), F.lit("success").alias("msg"), F.col("x.r").alias("data")))
    return g.select(F.lit("coinglass").alias("provider"), "subtype", "day", F.lit("time_series").alias("data_type"), body.alias("response"))


_ROWS = "r AS (SELECT event_type AS subtype, epoch_us(ts) // 86400000000 AS day, epoch_us(ts) // 60000000 * 60 AS timestamp, event_id, value, row_number() OVER (PARTITION BY event_type, epoch_us(ts) // 60000000 ORDER BY event_id) AS k FROM events)"


@query("ingest_records", f"WITH {_ROWS} SELECT subtype, day, timestamp, event_id AS id, {rounded({'value': 'value'})} FROM r WHERE k = 1")
def ingest_records(spark, sf_dir):
    """JSON payloads unwrapped, time stamps as seconds, numeric text cast, first of repeated stamps kept."""
    rows = ingest.normalise_records(event_payloads(spark, sf_dir), ["provider", "subtype", "day"])
    return finish(rows.select("subtype", "day", "timestamp", F.col("values")["id"].cast("long").alias("id"), F.col("values")["value"].alias("value")))


@query("ingest_quality", f"WITH {_ROWS} SELECT subtype, day, CASE WHEN count(*) FILTER (k = 1) >= 60 THEN 'ok' ELSE 'warning' END AS status, count(*) FILTER (k = 1) AS records_count, 60 AS min_records_required, count(*) FILTER (k > 1) AS duplicates_removed FROM r GROUP BY subtype, day")
def ingest_quality(spark, sf_dir):
    raw = event_payloads(spark, sf_dir)
    rows = ingest.normalise_records(raw, ["subtype", "day"])
    return ingest.quality(raw, rows, ["subtype", "day"], 60)


@query("ingest_props", "SELECT event_id, json_extract_string(props, '$.k')::DOUBLE AS k FROM events")
def ingest_props(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    cells = F.from_json("props", "map<string,string>")
    from ..functions.scalar import number

    return e.select("event_id", number(cells["k"]).alias("k"))


@query("ingest_validate", """
WITH r AS (SELECT event_type AS subtype, epoch_us(ts) // 86400000000 AS day, epoch_us(ts) // 60000000 AS m, event_id, lag(epoch_us(ts) // 60000000) OVER (PARTITION BY event_type, epoch_us(ts) // 86400000000 ORDER BY event_id) AS b FROM events),
g AS (SELECT subtype, day, coalesce(bool_or(b > m), false) AS unsorted, count(*) > count(DISTINCT m) AS twice, count(*) < 60 AS few FROM r GROUP BY 1, 2)
SELECT subtype, day, 'timestamps are not sorted' AS error FROM g WHERE unsorted UNION ALL SELECT subtype, day, 'duplicate timestamps found' FROM g WHERE twice UNION ALL SELECT subtype, day, 'records below minimum' FROM g WHERE few""")
def ingest_validate(spark, sf_dir):
    """Constraint violations of the payloads before they are normalised."""
    e = table(spark, sf_dir, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = e.select(F.col("event_type").alias("subtype"), F.floor(us / 86400000000).alias("day"), F.col("event_id").alias("pos"), F.floor(us / 60000000).alias("timestamp"))
    blocks = rows.select("subtype", "day").distinct().select("*", F.lit("time_series").alias("data_type"), F.lit("1m").alias("timeframe"), F.lit(None).cast("string").alias("extraction_window"), F.lit(60).alias("min_records_required"))
    return validate.input_errors(blocks, rows, ["subtype", "day"])


@query("ingest_time_forms", "SELECT event_id, epoch_us(ts) // 1000000 AS a, epoch_us(ts) // 1000000 AS b, epoch_us(ts) // 1000000 AS c FROM events")
def ingest_time_forms(spark, sf_dir):
    """Seconds, milliseconds and ISO text of the same moment."""
    from ..functions.scalar import unix_seconds

    us = F.unix_micros(F.col("ts").cast("timestamp"))
    iso = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    e = table(spark, sf_dir, "events")
    return e.select("event_id", unix_seconds(F.expr("unix_micros(cast(ts as timestamp)) div 1000000")).alias("a"), unix_seconds(F.expr("unix_micros(cast(ts as timestamp)) div 1000").cast("string")).alias("b"), unix_seconds(iso).alias("c"))


# --- detection ---------------------------------------------------------------------------------------------

#: metadata type, payload body, what it is, and where it goes
CASES = (
    ("ohlcv", "", "candlestick", "ohlcv", "prices_ohlcv", "candlestick"),
    ("miner_flows", "", "mining_network_health", "time_series", "mining_network_health", "time_series"),
    ("holder_cohorts", "", "onchain_holder_behavior", "time_series", "onchain_holder_behavior", "time_series"),
    ("cvd_1m", "", "cvd", "time_series", "volume_orderflow", "cvd_time_series"),
    ("etf_flows", "", "etf_flows", "time_series", "institutional_flows", "time_series"),
    ("liquidation_map", "", "liquidation_map", "time_series", "liquidations", "time_series"),
    ("open_interest_usd", "", "open_interest_usd", "time_series", "derivatives_open_interest", "time_series"),
    ("oi", "", "oi", "time_series", "derivatives_open_interest", "time_series"),
    ("long_short_ratio", "", "long_short_ratio", "time_series", "sentiment_positioning", "time_series"),
    ("orderbook_conventional", "", "orderbook_conventional", "book_snapshot", "liquidity_microstructure", "conventional_orderbook"),
    ("orderbook_large_trades", "", "orderbook_large_trades", "event_list", "liquidity_microstructure", "large_trades_orderbook"),
    ("orderbook_whale_orders", "", "orderbook_whale_orders", "event_list_with_ttl", "liquidity_microstructure", "whale_orders_orderbook"),
    ("", '"candles": []', "candlestick", "ohlcv", "prices_ohlcv", "candlestick"),
    ("", '"bids": [], "asks": []', "orderbook_conventional", "book_snapshot", "liquidity_microstructure", "conventional_orderbook"),
    ("", '"whale_buy_orders": []', "orderbook_whale_orders", "event_list_with_ttl", "liquidity_microstructure", "whale_orders_orderbook"),
    ("", '"large_sell_trades": []', "orderbook_large_trades", "event_list", "liquidity_microstructure", "large_trades_orderbook"),
    ("", '"records": [{"hash_rate": 1}]', "mining_network_health", "time_series", "mining_network_health", "time_series"),
    ("", '"records": [{"sopr": 1}]', "onchain_holder_behavior", "time_series", "onchain_holder_behavior", "time_series"),
    ("", '"files": [], "summary": {}', "manifest", "metadata", "metadata", "manifest"),
    ("", '"rows": [{"open": 1, "high": 1, "low": 1, "close": 1}]', "candlestick", "ohlcv", "prices_ohlcv", "candlestick"),
    ("", '"x": 1', "unknown", "unknown", "unknown", "unknown"),
)


def case_payloads(spark, sf_dir):
    """A payload for every nation, by the number of the nation."""
    body = F.array(*[F.lit('{"metadata": {"data_type": "' + t + '", "symbol": "BTC"}' + (", " + b if b else "") + "}") for t, b, *_ in CASES])
    n = table(spark, sf_dir, "nation")
    return n.select(F.col("n_name").alias("source_name"), F.get(body, F.col("n_nationkey") % len(CASES)).alias("payload"))


_CASES_SQL = "c AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{d}', '{c}', '{f}', '{s}', '{'low' if d == 'unknown' else 'medium' if 'rows' in b else 'high'}')" for i, (_, b, d, c, f, s) in enumerate(CASES)) + ") t(i, data_type, canonical_type, family_key, output_shape, confidence))"


@query("ingest_detect", f"WITH {_CASES_SQL} SELECT n_name AS source_name, data_type, canonical_type, confidence, 'BTC' AS symbol FROM nation JOIN c ON i = n_nationkey % {len(CASES)}")
def ingest_detect(spark, sf_dir):
    return ingest.detect(case_payloads(spark, sf_dir)).select("source_name", "data_type", "canonical_type", "confidence", "symbol")


@query("ingest_route", f"WITH {_CASES_SQL} SELECT n_name AS source_name, family_key, output_shape, output_shape || '.json' AS output_filename, family_key = 'metadata' AS is_metadata FROM nation JOIN c ON i = n_nationkey % {len(CASES)}")
def ingest_route(spark, sf_dir):
    return ingest.route(ingest.detect(case_payloads(spark, sf_dir))).select("source_name", "family_key", "output_shape", "output_filename", "is_metadata")


_SHAPES = {"prices_ohlcv": ingest.VARIANTS["prices_ohlcv"], **{k: v for k, v in ingest.VARIANTS.items() if k != "prices_ohlcv"}}
_SHAPE_ROWS = ", ".join(f"('{f}', '{s}')" for f, names in _SHAPES.items() for s in names)


@query("ingest_variants", f"""
WITH {_CASES_SQL}, b AS (SELECT n_name AS source_name, c.* FROM nation JOIN c ON i = n_nationkey % {len(CASES)}), v AS (SELECT * FROM (VALUES {_SHAPE_ROWS}) t(f, s))
SELECT source_name, f AS target_family, s AS target_shape FROM b JOIN v ON f = family_key UNION ALL SELECT source_name, 'volume_orderflow', 'volume_features' FROM b WHERE data_type = 'candlestick'
UNION ALL SELECT source_name, family_key, unnest(['orderbook', 'time_series', 'bars']) FROM b WHERE family_key = 'liquidity_microstructure' UNION ALL SELECT source_name, family_key, 'event_list' FROM b WHERE data_type IN ('orderbook_large_trades', 'orderbook_whale_orders')""")
def ingest_variants(spark, sf_dir):
    return ingest.variants(ingest.route(ingest.detect(case_payloads(spark, sf_dir))), F.lit(True)).select("source_name", "target_family", "target_shape")


@query("ingest_gate", f"WITH {_CASES_SQL} SELECT n_name AS source_name, data_type = 'candlestick' AS apply_technical_indicators, data_type <> 'manifest' AS apply_statistics, data_type <> 'manifest' AS apply_patterns, data_type <> 'manifest' AS target_ml FROM nation JOIN c ON i = n_nationkey % {len(CASES)}")
def ingest_gate(spark, sf_dir):
    d = ingest.detect(case_payloads(spark, sf_dir)).withColumn("has_ohlc", F.col("data_type") == "candlestick")
    return ingest.decide(d).select("source_name", "apply_technical_indicators", "apply_statistics", "apply_patterns", "target_ml")


_CHARTS = {k: (v[0], ",".join(v[1]), ",".join(v[2]), ",".join(v[3])) for k, v in ingest.ROUTES.items()}


@query("ingest_classify", f"""
WITH {_CASES_SQL}, m AS (SELECT * FROM (VALUES {', '.join(f"('{k}', '{a}', '{b}', '{c}', '{d}')" for k, (a, b, c, d) in _CHARTS.items())}) t(k, chart_type, overlays, panels, suggested_modules))
SELECT n_name AS source_name, chart_type, coalesce(overlays, '') AS overlays, coalesce(panels, '') AS panels, coalesce(suggested_modules, '') AS suggested_modules, coalesce(k <> 'manifest', false) AS include_feature_vector FROM nation JOIN c ON i = n_nationkey % {len(CASES)} LEFT JOIN m ON k = data_type""")
def ingest_classify(spark, sf_dir):
    c = ingest.classify(ingest.detect(case_payloads(spark, sf_dir)))
    return c.select("source_name", "chart_type", *[F.array_join(x, ",").alias(x) for x in ("overlays", "panels", "suggested_modules")], "include_feature_vector")


@query("report_data_types", f"WITH {_CASES_SQL} SELECT data_type, count(*) AS records FROM nation JOIN c ON i = n_nationkey % {len(CASES)} GROUP BY data_type")
def report_data_types(spark, sf_dir):
    return sinks.data_type_counts(ingest.detect(case_payloads(spark, sf_dir)))


@query("report_families", f"""
WITH {_CASES_SQL}, b AS (SELECT n_name AS source_name, c.* FROM nation JOIN c ON i = n_nationkey % {len(CASES)}), v AS (SELECT * FROM (VALUES {_SHAPE_ROWS}) t(f, s))
SELECT f AS target_family, s AS target_shape, count(*) AS records_processed FROM b JOIN v ON f = family_key GROUP BY f, s""")
def report_families(spark, sf_dir):
    """Blocks of each family and shape; prices without a volume have no volume features."""
    routed = ingest.variants(ingest.route(ingest.detect(case_payloads(spark, sf_dir))), F.lit(False))
    return sinks.family_index(routed).where("target_family <> 'liquidity_microstructure'").select("target_family", "target_shape", "records_processed")


# --- frames ------------------------------------------------------------------------------------------------


def frame_payloads(spark, sf_dir):
    """Payloads of candles, books and trades made from the sample tables, one a symbol, brand or user block."""
    from . import inputs

    doc = lambda kind, **cells: F.to_json(F.struct(F.struct(F.lit(kind).alias("data_type"), F.lit("2024-01-31T00:00:00Z").alias("timestamp_utc")).alias("metadata"), *[c.alias(k) for k, c in cells.items()]))
    bar = F.struct((F.col("bar") * 3600).alias("timestamp_utc"), "open", "high", "low", "close", F.col("volume").alias("volume_btc"), F.col("buy_volume").cast("string").alias("volume_usdt"))
    a = inputs.bars(spark, sf_dir).groupBy("symbol", F.expr("bar div 24").alias("d")).agg(F.collect_list(bar).alias("c"))
    a = a.select(F.concat_ws("-", F.lit("candles"), "symbol", "d").alias("source_name"), doc("ohlcv", candles=F.col("c")).alias("payload"))
    lv = F.struct("price", F.col("quantity").alias("quantity_btc"), F.col("notional").alias("notional_usd"), "tie")
    b = inputs.book(spark, sf_dir).groupBy("block").agg(*[F.array_sort(F.collect_list(F.when(F.col("side") == k, F.struct("tie", lv.alias("r"))))).alias(k) for k in ("bid", "ask")])
    b = b.select(F.concat_ws("-", F.lit("book"), "block").alias("source_name"), doc("orderbook_conventional", bids=F.col("bid.r"), asks=F.col("ask.r")).alias("payload"))
    tr = F.struct("side", F.col("price").cast("string").alias("price"), F.col("quantity").alias("amount"), F.col("notional").alias("notional_usd"), F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp_utc"))
    t = inputs.trades(spark, sf_dir).groupBy("block", F.to_date("ts").alias("d")).agg(F.collect_list(tr).alias("r"))
    t = t.select(F.concat_ws("-", F.lit("trades"), "block", "d").alias("source_name"), doc("orderbook_large_trades", records=F.col("r")).alias("payload"))
    return a.unionByName(b).unionByName(t)


@query("frame_candles", """
WITH b AS (SELECT event_type, epoch_us(ts) // 3600000000 AS bar, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low, last(value ORDER BY ts, event_id) AS close, sum(1 + user_id % 10)::DOUBLE AS volume, sum(CASE WHEN user_id % 2 = 0 THEN 1 + user_id % 10 ELSE 0 END)::DOUBLE AS notional_volume FROM events GROUP BY 1, 2)
SELECT 'candles-' || event_type || '-' || (bar // 24) AS source_name, bar * 3600 AS seconds, open, high, low, close, volume, notional_volume FROM b""")
def frame_candles(spark, sf_dir):
    c = ingest.candles(ingest.detect(frame_payloads(spark, sf_dir)))
    return c.select("source_name", F.unix_seconds("ts").alias("seconds"), "open", "high", "low", "close", "volume", "notional_volume")


@query("frame_levels", """
SELECT 'book-' || p_brand AS source_name, CASE WHEN p_size % 2 = 1 THEN 'bid' ELSE 'ask' END AS side, count(*) AS n, """ + rounded({"price": "sum(p_retailprice)", "quantity": "sum(p_size::DOUBLE)", "notional": "sum(p_retailprice * p_size)"}) + " FROM part GROUP BY 1, 2")
def frame_levels(spark, sf_dir):
    lv = ingest.levels(ingest.detect(frame_payloads(spark, sf_dir)))
    return finish(lv.groupBy("source_name", "side").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in ("price", "quantity", "notional")]))


@query("frame_trades", """
SELECT 'trades-' || (user_id % 8) || '-' || strftime(ts, '%Y-%m-%d') AS source_name, count(*) AS n, """ + rounded({"price": "sum(value)", "notional": "sum(value * (1 + user_id % 10))", "age_seconds": "max(1706659200 - epoch_us(ts) // 1000000)::DOUBLE"}) + " FROM events GROUP BY 1")
def frame_trades(spark, sf_dir):
    t = ingest.trades(ingest.detect(frame_payloads(spark, sf_dir)))
    return finish(t.groupBy("source_name").agg(F.count(F.lit(1)).alias("n"), F.sum("price").alias("price"), F.sum("notional").alias("notional"), F.max("age_seconds").alias("age_seconds")))


@query("frame_pipeline_blocks")
def frame_pipeline_blocks(spark, sf_dir):
    """The block table of the whole run over such payloads: kinds, sections and flags."""
    from .pipeline import blocks_of

    b = blocks_of(spark, frame_payloads(spark, sf_dir))
    return b.select("source_name", "data_type", "family_key", F.size("statistics").alias("statistics"), F.size("technical_indicators").alias("technical"), F.size("microstructure").alias("microstructure"), F.size("patterns").alias("patterns"), "flags.mean_reversion_zone")


@query("report_previews", "WITH n AS (SELECT event_type, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) SELECT event_type, event_id, value FROM n WHERE k <= 5")
def report_previews(spark, sf_dir):
    """The last five rows of each series."""
    e = table(spark, sf_dir, "events").select("event_type", "ts", "event_id", "value")
    return sinks.previews(e, ["event_type"], ("ts", "event_id"), 5).drop("ts")


@query("report_columns", "SELECT event_type AS metric, count(DISTINCT user_id % 4) AS blocks FROM events GROUP BY 1")
def report_columns(spark, sf_dir):
    """In how many blocks each metric occurs."""
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 4).alias("block"), F.col("event_type").alias("metric"))
    return sinks.column_frequency(e, ["block"])


@query("first_known", "SELECT event_type, first(value ORDER BY ts, event_id) FILTER (event_id % 3 <> 0) AS value FROM events GROUP BY 1")
def first_known(spark, sf_dir):
    """The first value that isn't null of each series."""
    e = table(spark, sf_dir, "events").withColumn("value", F.when(F.col("event_id") % 3 != 0, F.col("value")))
    return ingest.first_non_null(e, ["event_type"], "value", ("ts", "event_id"))
