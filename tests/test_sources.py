"""Catalogue, readers, normalisation, contracts and the run over payloads."""

from __future__ import annotations

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from seriesmill.plans import pipeline
from seriesmill.sources import ingest, readers, registry, sinks, synthetic, validate


def test_catalogue(spark):
    assert len(registry.ENDPOINTS) == 97
    with pytest.raises(ValueError):
        registry.endpoint("p", "f", "s", status="supported")
    timed = [e for e in registry.ENDPOINTS if e["supports_timeframe"]]
    assert all(e["synthetic_timeframes"] == list(registry.TIMEFRAMES) and e["extraction_windows"] == [] and e["synthetic_file_template"].endswith("/{timeframe}_raw.json") for e in timed)
    rest = [e for e in registry.ENDPOINTS if not e["supports_timeframe"]]
    assert all(e["synthetic_timeframes"] == [] and e["extraction_windows"] in (["latest"], ["24h"]) for e in rest)
    s = registry.slots(registry.registry(spark), ["1h"], [])
    assert s.count() == len(timed) and set(r["slot"] for r in s.select("slot").distinct().collect()) == {"1h"}


def test_resolution_prefers_primary(spark):
    rows = [registry.endpoint("glassnode", "prices_ohlcv", "spot_ohlcv", role="secondary", status="supported", path="/b"), registry.endpoint("coinglass", "prices_ohlcv", "spot_ohlcv", role="primary", status="supported", path="/a"), registry.endpoint("cryptoquant", "prices_ohlcv", "spot_ohlcv", role="not_available", status="not_available", synthetic_status="skip")]
    got = registry.resolve_endpoints(registry.registry(spark, rows)).collect()
    assert [r["provider"] for r in got] == ["coinglass", "glassnode"]
    assert registry.PRIORITY_ORDER[("primary", "supported")] < registry.PRIORITY_ORDER[("secondary", "supported")]
    with pytest.raises(ValueError):
        registry.extraction_status(registry.registry(spark, rows), "magic")


def test_params(spark):
    e = registry.endpoint("p", "f", "s", params={"interval": "{timeframe}", "symbol": "{symbol}", "w": "{extraction_window}"})
    r = registry.slots(registry.registry(spark, [e]), ["1h"]).select(registry.request_params(F.col("timeframe"), F.col("extraction_window"), "BTC", "BTCUSDT").alias("p")).first()
    assert r["p"] == {"interval": "1h", "symbol": "BTCUSDT"}


def test_keys_are_redacted(tmp_path, monkeypatch):
    f = tmp_path / ".env.example"
    f.write_text("# x\nCOINGLASS_API_KEY=xxx\nINPUT_API_KEY='secret'\nbad\n")
    monkeypatch.delenv("COINGLASS_API_KEY", raising=False)
    key = readers.api_key("coinglass", str(f))
    assert key == "secret" and readers.redact(readers.headers("coinglass", key)) == {"accept": "application/json", "CG-API-KEY": "***"}
    assert readers.redact(readers.headers("glassnode", key))["Authorization"] == "***" and readers.headers("glassnode", None) == {"accept": "application/json"}
    assert readers.url_of("https://x/", "/a/b", {"q": "1 2"}) == "https://x/a/b?q=1+2"


def test_http_source_gives_errors_as_rows(spark):
    r = readers.read_http(spark, ["http://127.0.0.1:9/x"], "coinglass", 1).first()
    assert r["status"] == "live_request_failed" and r["payload"] is None and r["error"]


def test_zip_round_trip(spark, tmp_path):
    path = str(tmp_path / "coinglass.zip")
    raw = synthetic.raw_payloads(spark, ["1h"], ["coinglass"])
    assert synthetic.write_zip(raw, path) == 38
    data = (tmp_path / "coinglass.zip").read_bytes()
    assert synthetic.validate_zip(spark, data, "coinglass", ["1h"]) == []
    assert synthetic.validate_zip(spark, data, "coinglass")
    assert readers.read_payloads(spark, path).count() == 38
    one = json.loads(readers.load_synthetic_response(spark, path, "prices_ohlcv", "spot_ohlcv", "1h"))
    assert one["code"] == "0" and len(one["data"]) == 600 and one["data"][-1]["time"] == synthetic.BASE_TS * 1000
    with pytest.raises(FileNotFoundError):
        readers.load_synthetic_response(spark, path, "prices_ohlcv", "none", "1h")
    (tmp_path / "a.json").write_text("{}")
    assert readers.resolve_input_path(str(tmp_path)) == path


def test_unwrap_and_normalise(spark):
    rows = [
        ("coinglass", '{"code":"0","data":[{"time":1782777600000,"v":"1.5"},{"time":1782777600000,"v":"2"},{"v":"x"},{"time":5,"v":3}]}'),
        ("cryptoquant", '{"result":{"data":[{"datetime":"2026-06-30T00:00:00Z","a":1}]}}'),
        ("glassnode", '[{"t":1782777600,"v":{"total":1}},{"t":1782777660,"v":2,"z":9}]'),
        ("volmex", '{"data":{"timestamp":7,"value":1}}'), ("coinglass", "[1, 2]"), ("coinglass", "not json"), ("coinglass", None),
    ]
    raw = spark.createDataFrame([(i, *r, "time_series") for i, r in enumerate(rows)], "id int, provider string, response string, data_type string")
    out = ingest.normalise_records(raw, ["id"])
    got = {}
    for r in ingest.sorted_records(out, ["id"]).collect():
        got.setdefault(r["id"], []).append((r["timestamp"], r["values"]))
    assert got[0] == [(None, {}), (5, {"time": 5.0, "v": 3.0}), (1782777600, {"time": 1782777600000.0, "v": 1.5})]
    assert got[1][0][0] == 1782777600 and [t for t, _ in got[2]] == [1782777600, 1782777660] and got[2][1][1] == {"timestamp": 1782777660.0, "value": 2.0} and got[3][0][0] == 7
    assert set(got) == {0, 1, 2, 3}
    q = {r["id"]: r for r in ingest.quality(raw, out, ["id"], 2).collect()}
    assert q[0]["duplicates_removed"] == 1 and q[0]["status"] == "ok" and q[5]["records_count"] == 0 and q[5]["status"] == "warning"


def test_contracts(spark):
    with pytest.raises(ValueError, match="Input must be a DataFrame"):
        validate.validate_dataframe([1])
    df = spark.createDataFrame([(1.0, "a", None)], "open double, s string, t double")
    with pytest.raises(ValueError, match="DataFrame is empty"):
        validate.validate_dataframe(df.limit(0))
    with pytest.raises(ValueError, match="Missing required columns"):
        validate.validate_ohlc_columns(df)
    with pytest.raises(ValueError, match="Non-numeric columns found"):
        validate.validate_numeric_columns(df, ["open", "s", "gone"])
    with pytest.raises(ValueError, match="Missing values"):
        validate.validate_feature_matrix(df.select("open", "t"), allow_nan=False)
    assert validate.infer_time_column(spark.createDataFrame([(1, 2)], "time int, timestamp int")) == "timestamp" and validate.infer_time_column(df) is None
    c = validate.build_feature_contract()
    assert c["required_columns"] == validate.REQUIRED_OHLC_COLUMNS and c["schema_version"] == "1.0" and not c["schema"]["open"].nullable


def test_envelopes_and_manifest(spark, tmp_path):
    raw = synthetic.raw_payloads(spark, ["1h"], ["cryptoquant", "external_indices"])
    slotted = registry.slots(registry.registry(spark).where("folder in ('cryptoquant', 'external_indices')"), ["1h"])
    env = sinks.raw_envelopes(slotted, raw, "run1", "synthetic")
    assert {r["status"] for r in env.select("status").collect()} == {"ok"}
    sinks.write_raw(env, str(tmp_path / "raw"))
    rows, q = sinks.normalised(env)
    m = {r["family"]: r for r in sinks.union_normalised(rows, q, str(tmp_path / "norm")).collect()}
    assert m["on_chain_miners"]["files"] == 7 and m["on_chain_miners"]["records_total"] == 7 * 600
    live = sinks.raw_envelopes(slotted, None, "run2", "live").groupBy("status").count().collect()
    assert {r["status"]: r["count"] for r in live} == {"skipped_live_path_missing": 17, "skipped_live_external_provider_required": 2}
    with pytest.raises(ValueError, match="Unknown official family"):
        sinks.union_normalised(rows, q.withColumn("family", F.lit("x")), str(tmp_path / "bad"))


def test_shape_contract():
    from pyspark.sql.types import StructType

    assert "prices_ohlcv/bars: missing bars" in validate.shape_errors("prices_ohlcv", "bars", StructType().add("source_name", "string").add("regime_flags", "string"), 1)
    assert any("unexpected family" in e for e in validate.shape_errors("x", "bars", StructType(), 0))
    with pytest.raises(ValueError):
        sinks.check_limits([{"target_family": "f", "target_shape": str(i)} for i in range(5)])


def test_whole_run(spark, tmp_path):
    src = tmp_path / "in" / "deep"
    src.mkdir(parents=True)
    t0 = synthetic.BASE_TS
    put = lambda name, doc: (src / f"{name}.json").write_text(json.dumps(doc))
    put("candles", {"metadata": {"data_type": "ohlcv", "symbol": "BTC", "timeframe": "1h"}, "candles": [{"timestamp_utc": t0 + 3600 * i, "open": 100 + i % 7, "high": 109 + i % 5, "low": 98 - i % 3, "close": 103 + i % 11, "volume_btc": "5"} for i in range(130)]})
    put("liq", {"metadata": {"data_type": "liquidation_map"}, "records": [{"timestamp": t0 + i, "value": 50 + (400 if i == 9 else i % 7)} for i in range(120)]})
    put("book", {"metadata": {"data_type": "orderbook_conventional"}, "bids": [{"price": 100 - i, "quantity_btc": 1, "notional_usd": 100} for i in range(5)], "asks": [{"price": 101 + i, "quantity_btc": 1, "notional_usd": 10} for i in range(5)]})
    put("trades", {"metadata": {"data_type": "orderbook_large_trades", "timestamp_utc": "2026-06-30T00:05:00Z"}, "large_buy_trades": [{"side": "buy", "price": 9, "quantity_btc": 1, "notional_usdt": 9, "timestamp_utc": "2026-06-30T00:00:00Z"}], "large_sell_trades": []})
    put("manifest", {"files": [], "summary": {}})
    put("odd", {"x": 1})
    rep = pipeline.run_pipeline(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    assert rep["validation"] == {"status": "ok", "errors": []}
    assert rep["records_processed"] == 6 and rep["data_types"]["unknown"] == 1 and rep["math_summary"]["records_with_technical_indicators"] == 1
    assert set(rep["families"]["active_families"]) == {"prices_ohlcv", "volume_orderflow", "liquidity_microstructure", "liquidations"}
    ev = spark.read.json(str(tmp_path / "out/families/liquidations/event_list")).first()
    assert ev["events"][0]["event_type"] == "liquidation_spike"
    derived = spark.read.json(str(tmp_path / "out/families/liquidations/candlestick_derived")).first()
    assert float(derived["math"]["technical_indicators"]["sma_20"]) > 0 and len(derived["candles"]) == 120
    book = spark.read.json(str(tmp_path / "out/families/liquidity_microstructure/orderbook")).where("source_name = 'book.json'").first()
    assert book["liquidity_metrics"]["best_bid"] == 100


def test_running_sums_of_long_blocks(spark):
    """vwap and obv count from a block's first bar, beyond the tail that the other indicators see."""
    n = pipeline.HALO + 300
    bars = [{"timestamp_utc": synthetic.BASE_TS + 60 * i, "open": 100, "high": 110 + i % 5, "low": 90, "close": 100 + i * i % 13 + i // 1000, "volume_btc": 1 + i % 4} for i in range(n)]
    payload = json.dumps({"metadata": {"data_type": "ohlcv", "symbol": "BTC", "timeframe": "1m"}, "candles": bars})
    got = pipeline.blocks_of(spark, spark.createDataFrame([("c.json", payload)], "source_name string, payload string")).select("technical_indicators").first()[0]
    volume = [b["volume_btc"] for b in bars]
    typical = [(b["high"] + b["low"] + b["close"]) / 3 for b in bars]
    sign = [0, *((b["close"] > a["close"]) - (b["close"] < a["close"]) for a, b in zip(bars, bars[1:]))]
    assert float(got["vwap"]) == pytest.approx(sum(t * v for t, v in zip(typical, volume)) / sum(volume), rel=1e-9)
    assert float(got["obv"]) == sum(s * v for s, v in zip(sign, volume))
    assert float(got["sma_20"]) == pytest.approx(sum(b["close"] for b in bars[-20:]) / 20)


def test_long_blocks_are_counted_once(spark, monkeypatch):
    """Only candles have running sums to make: their blocks are counted, and no others."""
    counted = []
    count = lambda df, s: counted.append(df.count()) or 1000
    monkeypatch.setattr(pipeline, "largest", count, raising=False)
    monkeypatch.setattr(pipeline.indicators, "largest", count)
    rows = [{"side": "buy", "price": 5 + i % 3, "amount": 1, "timestamp_utc": synthetic.BASE_TS + i} for i in range(30)]
    bars = [{"timestamp_utc": synthetic.BASE_TS + 60 * i, "open": 1, "high": 3, "low": 1, "close": 2, "volume_btc": 1} for i in range(7)]
    docs = [("t", {"metadata": {"data_type": "orderbook_large_trades"}, "records": rows}), ("c", {"metadata": {"data_type": "ohlcv"}, "candles": bars})]
    got = pipeline.blocks_of(spark, spark.createDataFrame([(k, json.dumps(d)) for k, d in docs], "source_name string, payload string"))
    seen = {r["source_name"]: r["view_technical"] for r in got.select("source_name", "view_technical").collect()}
    assert counted == [7]
    assert seen["t"]["obv"] == "0.0" and "vwap" not in seen["t"] and seen["c"]["obv"] == "0.0" and seen["c"]["vwap"] == "2.0"


def test_flags_do_not_hang_on_the_order_of_rows(spark):
    """Of metrics of one rank the first by name decides mean_reversion_zone."""
    rows = [("b", m, 2, None, i, float(v)) for m, last in (("a", 3), ("z", 30), ("m", 31)) for i, v in enumerate([*(j % 7 for j in range(29)), last])]
    names = "source_name string, metric string, ordinal int, ts timestamp, pos int, value double"
    for order in (rows, rows[::-1]):
        flags = pipeline.statistics(spark.createDataFrame(order, names).coalesce(1))[2].first()["flags"]
        assert flags["mean_reversion_zone"] is True


def test_seconds_of_text(spark):
    from seriesmill.functions.scalar import unix_seconds

    texts = ["2024-01-05T00:00:01Z", "2024-01-05", "2024", "1.0e-5", "1700000000000", "2024-x", "-7.5", ""]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string").select("i", unix_seconds(F.col("x")).alias("s")).orderBy("i").collect()
    assert [r["s"] for r in got] == [1704412801, 1704412800, 2024, 0, 1700000000, None, -7, None]


def test_archives_of_payloads(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("a.json", '{"candles": []}')
        z.writestr("skip.txt", "no")
    got = ingest.detect(readers.read_payloads(spark, str(tmp_path / "x.zip"))).collect()
    assert [(r["source_name"], r["data_type"]) for r in got] == [("a.json", "candlestick")]
