"""Queries of readers, writers and contracts: what is written is read back, what must be refused is refused."""

from __future__ import annotations

import io
import json
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from ..operators import indicators, recursive, regimes, rolling, windows
from ..series import bounded
from ..sources import ingest, readers, registry, sinks, validate
from ..storage import materialise, new_path
from .indicators import NUMBERED
from .ingest import _CASES_SQL, _FAMILIES, _SHAPE_ROWS, CASES, case_payloads, event_payloads
from .inputs import BARS, BARS_SQL, POINTS, POINTS_SQL, S_BARS, S_POINTS, bars, finish, points, query, r, rounded, table
from .statistics import P, regime_sql

# --- readers -----------------------------------------------------------------------------------------------


@query("source_folder", "SELECT n_nationkey AS key, n_name AS name FROM nation")
def source_folder(spark, sf_dir):
    """A folder of JSON files, nested by region, read as payloads of text."""
    path = new_path(spark, "json-folder")
    n = table(spark, sf_dir, "nation")
    n.select("n_regionkey", "n_nationkey", "n_name").write.partitionBy("n_regionkey").json(path)
    lines = readers.read_payloads(spark, path).select(F.explode(F.split(F.trim("payload"), "\n")).alias("line"))
    return lines.select(F.get_json_object("line", "$.n_nationkey").cast("bigint").alias("key"), F.get_json_object("line", "$.n_name").alias("name"))


def archives(spark, sf_dir):
    """One ZIP archive a region, with one JSON member a nation and one that isn't JSON: (path, content)."""

    def pack(p: pd.DataFrame) -> pd.DataFrame:
        raw = io.BytesIO()
        with zipfile.ZipFile(raw, "w") as z:
            for k, name in sorted(zip(p["n_nationkey"], p["n_name"])):
                z.writestr(f"nations/{k}/latest_raw.json", json.dumps({"key": int(k), "name": name}))
            z.writestr("readme.txt", "not a payload")
        return pd.DataFrame({"path": [f"region-{p['n_regionkey'].iloc[0]}.zip"], "content": [raw.getvalue()]})

    return table(spark, sf_dir, "nation").groupBy("n_regionkey").applyInPandas(pack, "path string, content binary")


def _member(rows):
    return rows.select("archive", "source_name", F.get_json_object("payload", "$.key").cast("bigint").alias("key"), F.get_json_object("payload", "$.name").alias("name"))


_ZIPPED = "SELECT 'region-' || n_regionkey || '.zip' AS archive, 'nations/' || n_nationkey || '/latest_raw.json' AS source_name, n_nationkey AS key, n_name AS name FROM nation"


@query("source_zip", _ZIPPED)
def source_zip(spark, sf_dir):
    """All JSON members of ZIP archives."""
    return _member(readers.zip_members(archives(spark, sf_dir)))


@query("source_zip_member", f"{_ZIPPED} WHERE n_nationkey = 7")
def source_zip_member(spark, sf_dir):
    """One member of one archive; no other is unpacked."""
    own = archives(spark, sf_dir).join(table(spark, sf_dir, "nation").where("n_nationkey = 7").select("n_regionkey"), F.col("path") == F.concat(F.lit("region-"), F.col("n_regionkey"), F.lit(".zip")))
    return _member(readers.zip_members(own, "nations/7/latest_raw.json"))


@query("source_http", "SELECT r_name AS name, 'ok' AS status FROM region UNION ALL SELECT NULL, 'live_request_failed'")
def source_http(spark, sf_dir):
    """Requests that need no network: documents in data URLs, and an address that refuses."""
    names = [x["r_name"] for x in table(spark, sf_dir, "region").select("r_name").orderBy("r_name").collect()]  # a request list is the driver's
    urls = ["data:application/json," + json.dumps({"name": n}).replace(" ", "%20") for n in names]
    rows = readers.read_http(spark, [*urls, "http://127.0.0.1:9/none"], "coinglass", 2)
    return rows.select(F.get_json_object("payload", "$.name").alias("name"), "status")


@query("source_headers", "SELECT * FROM (VALUES ('coinglass', 'CG-API-KEY', '***'), ('cryptoquant', 'Authorization', '***'), ('glassnode', 'Authorization', '***'), ('coinglass', 'accept', 'application/json'), ('cryptoquant', 'accept', 'application/json'), ('glassnode', 'accept', 'application/json')) t(provider, header, written)")
def source_headers(spark, sf_dir):
    """Headers of a request as they are written down: secrets don't show."""
    rows = [(p, k, v) for p in ("coinglass", "cryptoquant", "glassnode") for k, v in readers.redact(readers.headers(p, "secret")).items()]
    return spark.createDataFrame(rows, "provider string, header string, written string")


@query("source_urls", "SELECT n_nationkey AS key, 'https://host/v1/n' || n_nationkey || '?name=' || replace(url_encode(n_name), '%20', '+') AS url FROM nation")
def source_urls(spark, sf_dir):
    @F.pandas_udf("string")
    def url(key: pd.Series, name: pd.Series) -> pd.Series:
        return pd.Series([readers.url_of("https://host/", f"/v1/n{k}", {"name": n}) for k, n in zip(key, name)])

    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), url("n_nationkey", "n_name").alias("url"))


# --- writers -----------------------------------------------------------------------------------------------


@query("raw_written", "SELECT family, status, files FROM (VALUES " + ", ".join(f"('{k}', 'live_request_failed', {v}::BIGINT)" for k, v in _FAMILIES.items()) + ") t(family, status, files)")
def raw_written(spark, sf_dir):
    """Raw envelopes of all slots, written by run, family and subtype and read back; without responses all have failed."""
    path = new_path(spark, "raw")
    sinks.write_raw(sinks.raw_envelopes(registry.slots(registry.registry(spark)), None, "run-1", "synthetic"), path)
    return spark.read.json(path).where("run_id = 'run-1'").groupBy("family", "status").agg(F.count(F.lit(1)).alias("files"))


_DAYS = "d AS (SELECT event_type AS subtype, epoch_us(ts) // 86400000000 AS day, epoch_us(ts) // 60000000 AS minute FROM events)"


@query("normalised_written", f"WITH {_DAYS}, g AS (SELECT subtype, day, count(DISTINCT minute) AS n FROM d GROUP BY subtype, day) SELECT 'liquidations' AS family, count(*) AS files, sum(n)::BIGINT AS records_total FROM g")
def normalised_written(spark, sf_dir):
    """Normalised payloads, one an event type and day, written by family; the manifest is read back."""
    path = new_path(spark, "normalised")
    none = lambda *names: {n: F.lit(None).cast("string") for n in names}
    e = event_payloads(spark, sf_dir).withColumns({"run_id": F.lit("run-1"), "family": F.lit("liquidations"), "status": F.lit("ok"), "asset": F.lit("BTC"), "symbol": F.lit("BTCUSDT"), "extraction_window": F.col("day").cast("string"), "raw_response": F.col("response")} | none("exchange", "timeframe"))
    rows, quality = sinks.normalised(e.drop("response", "day"), 60)
    sinks.union_normalised(rows, quality, path)
    read = spark.read.json(f"{path}/records")
    return spark.read.json(f"{path}/manifest").join(read.groupBy("family").agg(F.count(F.lit(1)).alias("n")), "family").where("n = records_total").select("family", "files", "records_total")


@query("family_outputs", f"""
WITH {_CASES_SQL}, b AS (SELECT n_name AS source_name, c.* FROM nation JOIN c ON i = n_nationkey % {len(CASES)}), v AS (SELECT * FROM (VALUES {_SHAPE_ROWS}) t(f, s)),
w AS (SELECT f, s FROM b JOIN v ON f = family_key WHERE family_key <> 'liquidity_microstructure' UNION ALL SELECT family_key, unnest(['orderbook', 'time_series', 'bars']) FROM b WHERE family_key = 'liquidity_microstructure' UNION ALL SELECT family_key, 'event_list' FROM b WHERE data_type IN ('orderbook_large_trades', 'orderbook_whale_orders'))
SELECT f AS family, s AS shape, count(*) AS blocks, 'ok' AS status FROM w GROUP BY f, s""")
def family_outputs(spark, sf_dir):
    """Blocks written by family and shape, held against the contract of each, and counted from what was written."""
    path = new_path(spark, "families")
    d = ingest.route(ingest.detect(case_payloads(spark, sf_dir)))
    gates = ingest.decide(d.withColumn("has_ohlc", F.col("data_type") == "candlestick"))
    blocks = materialise(gates.withColumns({"feature_snapshot": F.create_map(F.lit("size"), F.length("payload").cast("double")), "source_subtype": F.lit(None).cast("string")}), "family-blocks")
    index = sinks.write_family_outputs(blocks, path, F.lit(False))
    status = sinks.validate_family_outputs(spark, index)["status"]
    kinds = [(o["target_family"], o["target_shape"]) for o in index["outputs"]]  # at most 36
    out = None
    for family, shape in kinds:
        n = spark.read.json(f"{path}/{family}/{shape}").agg(F.count(F.lit(1)).alias("blocks")).select(F.lit(family).alias("family"), F.lit(shape).alias("shape"), "blocks", F.lit(status).alias("status"))
        out = n if out is None else out.unionByName(n)
    return out


@query("matrix_preview", f"WITH {_CASES_SQL} SELECT n_name AS source_name, {r('n_nationkey')} AS key, {r('n_regionkey * 2')} AS twice FROM nation JOIN c ON i = n_nationkey % {len(CASES)} WHERE data_type <> 'manifest' AND data_type IN ({', '.join(repr(k) for k in ingest.ROUTES)})")
def matrix_preview(spark, sf_dir):
    """One row for each block that feeds the feature vector, one column a feature."""
    c = ingest.classify(ingest.detect(case_payloads(spark, sf_dir))).join(table(spark, sf_dir, "nation"), F.col("source_name") == F.col("n_name"))
    c = c.withColumn("feature_snapshot", F.create_map(F.lit("key"), F.col("n_nationkey").cast("double"), F.lit("twice"), F.col("n_regionkey") * 2.0)).withColumn("timeframe", F.lit(None).cast("string"))
    return finish(sinks.feature_matrix_preview(c, ["key", "twice"]), "source_name", "key", "twice")


# --- contracts ---------------------------------------------------------------------------------------------


def _said(spark, checks: dict) -> object:
    """(check, error) of calls: the text that they raise, or ok."""
    rows = []
    for name, call in checks.items():
        try:
            out = call()
            rows.append((name, "ok" if out is None else str(out)))
        except ValueError as e:
            rows.append((name, str(e)))
    return spark.createDataFrame(rows, "check string, said string")


def _values(rows: dict[str, str]) -> str:
    return "SELECT * FROM (VALUES " + ", ".join("('" + k + "', '" + v.replace("'", "''") + "')" for k, v in rows.items()) + ') t("check", said)'


@query("contract_schema", _values({
    "frame": "ok", "not a frame": "Input must be a DataFrame", "empty": "DataFrame is empty", "columns": "ok", "missing column": "Missing required columns: ['nothing']", "numeric": "ok", "text": "Non-numeric columns found: ['event_type']",
    "ohlc": "ok", "no ohlc": "Missing required columns: ['open', 'high', 'low', 'close']", "matrix": "ok", "matrix of text": "Non-numeric columns found: ['symbol']",
}))
def contract_schema(spark, sf_dir):
    e, b = table(spark, sf_dir, "events"), bars(spark, sf_dir)
    return _said(spark, {
        "frame": lambda: validate.validate_dataframe(e), "not a frame": lambda: validate.validate_dataframe([1]), "empty": lambda: validate.validate_dataframe(e.where("false")),
        "columns": lambda: validate.validate_required_columns(e, ["ts", "value"]), "missing column": lambda: validate.validate_required_columns(e, ["ts", "nothing"]),
        "numeric": lambda: validate.validate_numeric_columns(e, ["value", "nothing"]), "text": lambda: validate.validate_numeric_columns(e, ["event_type", "value"]),
        "ohlc": lambda: validate.validate_ohlc_columns(b), "no ohlc": lambda: validate.validate_ohlc_columns(e), "matrix": lambda: validate.validate_feature_matrix(b.drop("symbol")), "matrix of text": lambda: validate.validate_feature_matrix(b),
    })


@query("contract_names", _values({"time column": "ts", "time before date": "time", "no time column": "ok", "numeric columns": "event_id,user_id,value", "required": "open,high,low,close", "optional": "volume", "version": "1.0", "null allowed": "close:False,volume:True"}))
def contract_names(spark, sf_dir):
    """Time and numeric columns by name and type, and the contract of features."""
    e = table(spark, sf_dir, "events")
    c = validate.build_feature_contract(None, ["volume"])
    return _said(spark, {
        "time column": lambda: validate.infer_time_column(e), "time before date": lambda: validate.infer_time_column(e.withColumnsRenamed({"ts": "date"}).withColumn("time", F.lit(1))), "no time column": lambda: validate.infer_time_column(e.drop("ts")),
        "numeric columns": lambda: ",".join(sorted(rolling.numeric_columns(e))), "required": lambda: ",".join(c["required_columns"]), "optional": lambda: ",".join(c["optional_columns"]), "version": lambda: c["schema_version"],
        "null allowed": lambda: ",".join(f"{f.name}:{f.nullable}" for f in c["schema"].fields if f.name in {"close", "volume"}),
    })


@query("contract_windows", _values({"window": "ok", "no window": "window and step must be positive", "no step": "window and step must be positive", "without ohlc": "Missing required columns: open, high, low, close", "sections": "dynamics_features,invariant_features,technical_indicators,variable_action,volume_flow,window_meta"}))
def contract_windows(spark, sf_dir):
    sections = lambda: ",".join(sorted(c for c, k in windows.build_window(bars(spark, sf_dir).withColumn("atr", F.col("high") - F.col("low")), BARS, 24).dtypes if k.startswith("struct")))
    return _said(spark, {
        "window": lambda: windows.validate_positive_window(5, 1), "no window": lambda: windows.validate_positive_window(0), "no step": lambda: windows.validate_positive_window(5, 0),
        "without ohlc": lambda: windows.extract_window(points(spark, sf_dir), POINTS, 0, 5), "sections": sections,
    })


# --- operators ---------------------------------------------------------------------------------------------


@query("regime_frame", f"WITH {regime_sql(POINTS_SQL, 'points', S_POINTS, 'value')} SELECT {P}, {rounded({'zscore': 'z_20', 'volatility': 'vol_20', 'drawdown': 'dd_20'})}, label_20 AS stat_regime FROM regime")
def regime_frame(spark, sf_dir):
    """The regimes of one window, as one frame."""
    out = bounded(points(spark, sf_dir), POINTS, 41, lambda d, s: regimes.classify_statistical_regime(d, s, "value", 20))
    out = out.withColumnsRenamed({f"value__{k}_20": k for k in ("zscore", "volatility", "drawdown")})
    return finish(out, "series", "event_id", "zscore", "volatility", "drawdown", "stat_regime")


@query("price_series", f"WITH {BARS_SQL} SELECT symbol, bar, {rounded({'weighted_close': '(high + low + 2 * close) / 4', 'typical_price': '(high + low + close) / 3'})} FROM bars")
def price_series(spark, sf_dir):
    """Bars as one price each."""
    return finish(indicators.ohlc_to_series(indicators.ohlc_to_series(bars(spark, sf_dir)), "typical"), "symbol", "bar", "weighted_close", "typical_price")


@query("win_extract", f"WITH {BARS_SQL}, n AS (SELECT *, {S_BARS.rn()} AS rn FROM bars) SELECT symbol, bar, {rounded({c: c for c in ('open', 'high', 'low', 'close')})} FROM n WHERE rn >= 10 AND rn < 34")
def win_extract(spark, sf_dir):
    """Rows 10 to 33 of each series."""
    return finish(windows.extract_window(bars(spark, sf_dir), BARS, 10, 34), "symbol", "bar", "open", "high", "low", "close")


@query("win_flat", f"""
WITH {BARS_SQL}, n AS (SELECT *, {S_BARS.rn()} AS rn, count(*) OVER (PARTITION BY symbol) AS size FROM bars), w AS (SELECT *, rn // 24 AS window_id FROM n WHERE rn // 24 < size // 24)
SELECT symbol, window_id, count(*) AS window_meta__n_samples, {rounded({f'volume_flow__{c}_{k}': f'{f}({c})' for c in ('volume', 'buy_volume') for k, f in (('mean', 'avg'), ('min', 'min'), ('max', 'max'))})} FROM w GROUP BY symbol, window_id""")
def win_flat(spark, sf_dir):
    """Windows as structs of sections, made flat again."""
    nested = windows.build_window(bars(spark, sf_dir), BARS, 24, stats=("mean", "min", "max"))
    flat = windows.flatten_window(nested, list(windows.SECTIONS), include_meta=True)
    return finish(flat, "symbol", "window_id", "window_meta__n_samples", *[f"volume_flow__{c}_{k}" for c in ("volume", "buy_volume") for k in ("mean", "min", "max")])


def _kalman(c: str) -> str:
    return f"""k_{c} AS (SELECT symbol, rn, {c} AS level, 0.0::DOUBLE AS speed, 1.0::DOUBLE AS a, 0.0::DOUBLE AS b, 1.0::DOUBLE AS c FROM n WHERE rn = 0
  UNION ALL SELECT symbol, rn, level + pa / (pa + 0.1) * (z - level), speed + pb / (pa + 0.1) * (z - level), (1 - pa / (pa + 0.1)) * pa, (1 - pa / (pa + 0.1)) * pb, pc - pb / (pa + 0.1) * pb
  FROM (SELECT n.symbol, n.rn, n.{c} AS z, k.level + k.speed AS level, k.speed, k.a + 2 * k.b + k.c + 0.001 AS pa, k.b + k.c AS pb, k.c + 0.001 AS pc FROM k_{c} k JOIN n ON n.symbol = k.symbol AND n.rn = k.rn + 1) q)"""


@query("kalman_bars", f"""
WITH RECURSIVE {BARS_SQL}, {NUMBERED}, {_kalman('high')}, {_kalman('close')}
SELECT symbol, bar, {rounded({'high': 'k_high.level', 'close': 'k_close.level'})} FROM n JOIN k_high USING (symbol, rn) JOIN k_close USING (symbol, rn)""")
def kalman_bars(spark, sf_dir):
    """Filtered bars; two of the four prices are shown."""
    return finish(bounded(bars(spark, sf_dir), BARS, recursive.HALO, recursive.kalman_filter_ohlc), "symbol", "bar", "high", "close")
