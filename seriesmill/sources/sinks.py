"""Writers: raw envelopes, normalised payloads with a manifest, family outputs by shape, the report and its check.

Outputs are folders of JSON lines, one partition folder for each family and shape; a block's rows are nested in its
line (a block is one payload, so they are bounded by one input document).
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.regimes import FLAGS
from .ingest import INPUT_FAMILIES, OFFICIAL_FAMILIES, normalise_records, quality, variants
from .registry import extraction_status
from .validate import MAX_SHAPES, shape_errors


def raw_envelopes(slotted: DataFrame, payloads: DataFrame | None, run_id: str, mode: str, asset: str = "BTC", symbol: str = "BTCUSDT", min_records: int = 200) -> DataFrame:
    """One raw envelope a slot, with the status of its extraction; a slot without a response isn't an error of the run."""
    rows = extraction_status(slotted, mode)
    if payloads is None:
        rows = rows.withColumn("raw_response", F.lit(None).cast("string"))
    else:
        p = payloads.select(F.col("folder").alias("_f"), F.col("member").alias("_m"), F.col("response").alias("raw_response"))
        rows = rows.join(p, (F.col("folder") == F.col("_f")) & (F.col("member") == F.col("_m")), "left").drop("_f", "_m")
    failed = (F.col("status") == "ok") & F.col("raw_response").isNull()
    keep = F.when(F.col("status") == "ok", F.col("raw_response"))
    meta = F.create_map(F.lit("mode"), F.lit(mode), F.lit("path"), F.col("path"), F.lit("live_status"), F.col("live_status"), F.lit("min_records"), F.lit(str(min_records)))
    return rows.select(
        F.lit(run_id).alias("run_id"), "provider", F.lit(mode).alias("mode"), "endpoint_name", "family", "subtype", "data_type", F.lit(asset).alias("asset"), F.lit(symbol).alias("symbol"),
        F.element_at("default_params", "exchange").alias("exchange"), "timeframe", "extraction_window", "slot", F.when(failed, "live_request_failed").otherwise(F.col("status")).alias("status"), keep.alias("raw_response"), meta.alias("metadata"),
    )


def write_raw(envelopes: DataFrame, path: str) -> None:
    envelopes.write.mode("overwrite").partitionBy("run_id", "family", "subtype").json(path)


KEYS = ["run_id", "provider", "family", "subtype", "data_type", "asset", "symbol", "exchange", "timeframe", "extraction_window"]


def normalised(envelopes: DataFrame, min_records: int = 200) -> tuple[DataFrame, DataFrame]:
    """(record rows, quality rows) of the envelopes whose status is ok."""
    ok = envelopes.where("status = 'ok'")
    rows = normalise_records(ok, KEYS, response="raw_response")
    return rows, quality(ok, rows, KEYS, min_records, response="raw_response")


def union_normalised(rows: DataFrame, quality_rows: DataFrame, path: str) -> DataFrame:
    """Write records by family and return the manifest: family, files (payloads), records_total."""
    unknown = quality_rows.where(~F.col("family").isin(*INPUT_FAMILIES)).select("family").distinct().limit(1).collect()
    if unknown:
        raise ValueError(f"Unknown official family: {unknown[0]['family']}")
    rows.write.mode("overwrite").partitionBy("family").json(f"{path}/records")
    quality_rows.write.mode("overwrite").json(f"{path}/quality")
    manifest = input_manifest(quality_rows)
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return manifest


def input_manifest(quality_rows: DataFrame) -> DataFrame:
    return quality_rows.groupBy("family").agg(F.count(F.lit(1)).alias("files"), F.sum("records_count").alias("records_total"))


# --- family outputs ----------------------------------------------------------------------------------------


def header(blocks: DataFrame) -> list[Column]:
    """What every written block begins with."""
    flags = F.struct(*[(F.coalesce(F.col(f"flags.{c}"), F.lit(False)) if "flags" in blocks.columns else F.lit(False)).alias(c) for c in FLAGS])
    return [F.col("source_name"), F.col("target_family").alias("family_key"), F.coalesce("family", "family_key").alias("source_family_key"), F.col("target_shape").alias("output_shape"), F.col("symbol"), F.col("timeframe"), F.col("data_type"), F.col("source_subtype"), flags.alias("regime_flags")]


def _have(blocks: DataFrame, *names: str) -> list[str]:
    return [c for c in names if c in blocks.columns]


def math_for(blocks: DataFrame, shape: str) -> Column:
    """The sections of math that a shape may hold."""
    full = ("technical_indicators", "statistics", "statistical_regimes", "microstructure", "feature_snapshot")
    if shape in {"time_series", "candlestick"}:
        cells = [F.col(c) for c in _have(blocks, *full)]
    elif shape in {"candlestick_derived", "cvd_candlestick_derived"}:
        derived = [F.col("view_technical").alias("technical_indicators")] if "view_technical" in blocks.columns else []
        cells = derived + [F.col(c) for c in _have(blocks, *full[1:])]
    elif shape == "regimes":
        cells = [F.col(c) for c in _have(blocks, "statistical_regimes")]
    elif shape in {"event_list", "orderbook"}:
        cells = [F.col(c) for c in _have(blocks, "microstructure")]
    else:
        cells = []
    return F.struct(*cells, *([F.lit("1.0").alias("contract")]))


def serialise(blocks: DataFrame, shape: str) -> DataFrame:
    """blocks (catalogue columns and nested frames) -> the lines that are written for one shape.

    Nested frames, where there are any: bars, candles, events, bids, asks, series, statistics, statistical_regimes,
    technical_indicators, microstructure, feature_snapshot, patterns.
    """
    head, math = header(blocks), math_for(blocks, shape)
    col = lambda c, kind="array<string>": F.col(c) if c in blocks.columns else F.lit(None).cast(kind)
    size = lambda c: F.when(F.size(col(c)) >= 0, F.size(col(c))).otherwise(0)
    if shape == "bars":
        return blocks.select(*head, col("bars").alias("bars"), F.struct(size("bars").alias("rows")).alias("summary"), math.alias("math"))
    if shape in {"candlestick_derived", "cvd_candlestick_derived"}:
        conversion = F.struct(F.lit("numeric_series_to_ohlc").alias("method"), size("bars").alias("source_rows"), size("bars").alias("derived_rows"))
        return blocks.select(*head, F.col("data_type").alias("source_data_type"), conversion.alias("conversion"), col("bars").alias("candles"), math.alias("math"))
    if shape == "event_list":
        return blocks.select(*head, col("events").alias("events"), F.struct(size("events").alias("events")).alias("event_summary"), math.alias("math"))
    if shape == "regimes":
        return blocks.select(*head, col("statistical_regimes").alias("regimes"), math.alias("math"))
    if shape == "orderbook":
        return blocks.select(*head, col("bids").alias("bids"), col("asks").alias("asks"), col("microstructure").alias("liquidity_metrics"), math.alias("math"))
    if shape.endswith("_features"):
        snapshot = col("feature_snapshot", "map<string,double>")
        derived = F.struct(F.when(F.col("target_shape") == "volume_features", "prices_ohlcv").otherwise(F.col("family_key")).alias("family_key"), F.col("data_type").alias("data_type"), F.col("source_name").alias("source_name"))
        return blocks.select(*head, snapshot.alias("feature_snapshot"), F.array_sort(F.map_keys(snapshot)).alias("selected_features"), derived.alias("derived_from"), math.alias("math"))
    detected = F.struct(*[F.col(c) for c in ("data_type", "canonical_type", "confidence", "symbol", "timeframe", "asset", "provider_source")])
    decision = F.struct(*[F.col(c) for c in _have(blocks, "apply_technical_indicators", "apply_statistics", "apply_statistical_regimes", "apply_patterns", "target_hmi", "target_ml", "target_advanced")] or [F.lit(True).alias("apply_statistics")])
    routes = F.struct(*[F.col(c) for c in _have(blocks, "chart_type", "overlays", "panels", "suggested_modules", "include_feature_vector", "include_patterns", "preserve_time_series", "preserve_event_sequence")] or [F.lit(None).cast("string").alias("chart_type")])
    return blocks.select(*head, detected.alias("detected"), F.struct(col("series").alias("dataframe")).alias("normalized"), decision.alias("decision"), math.alias("math"), col("patterns").alias("patterns"), routes.alias("routes"))


def family_index(routed: DataFrame) -> DataFrame:
    """(family, shape): records_processed, symbols, timeframes, data_types; more than MAX_SHAPES shapes are an error."""
    g = routed.groupBy("target_family", "target_shape").agg(F.count(F.lit(1)).alias("records_processed"), F.array_sort(F.collect_set("symbol")).alias("symbols"), F.array_sort(F.collect_set("timeframe")).alias("timeframes"), F.array_sort(F.collect_set("data_type")).alias("data_types"))
    return g


def check_limits(index: list) -> None:
    by: dict[str, set] = {}
    for r in index:
        by.setdefault(r["target_family"], set()).add(r["target_shape"])
    wrong = {f: sorted(s) for f, s in by.items() if len(s) > MAX_SHAPES}
    if wrong:
        raise ValueError(f"more than {MAX_SHAPES} outputs for {wrong}")


def write_family_outputs(blocks: DataFrame, path: str, has_volume: Column | None = None) -> dict[str, Any]:
    """Write every shape of every family under path/family/shape; returns the index with active and inactive families.

    blocks are read once a shape (at most a dozen), so hand over a written table.
    """
    routed = variants(blocks, has_volume).where(F.col("target_family").isin(*OFFICIAL_FAMILIES))
    index = family_index(routed).collect()  # families times shapes: at most 36 rows
    check_limits(index)
    for shape in sorted({r["target_shape"] for r in index}):
        mine = routed.where(F.col("target_shape") == shape)
        for family in sorted({r["target_family"] for r in index if r["target_shape"] == shape}):
            serialise(mine.where(F.col("target_family") == family), shape).write.mode("overwrite").option("ignoreNullFields", False).json(f"{path}/{family}/{shape}")
    active = {r["target_family"] for r in index}
    return {"families_root": path, "active_families": [f for f in OFFICIAL_FAMILIES if f in active], "inactive_families": [f for f in OFFICIAL_FAMILIES if f not in active], "outputs": [r.asDict() for r in index]}


def validate_family_outputs(spark: SparkSession, index: dict[str, Any]) -> dict[str, Any]:
    """Read back what was written and hold it against the contract of each shape."""
    errors = []
    for o in index["outputs"]:
        family, shape = o["target_family"], o["target_shape"]
        df = spark.read.json(f"{index['families_root']}/{family}/{shape}")
        n = df.count()
        errors += shape_errors(family, shape, df.schema, n)
        if n != o["records_processed"]:
            errors.append(f"{family}/{shape}: {n} blocks, {o['records_processed']} expected")
        if n and not df.where((F.col("family_key") != family) | (F.col("output_shape") != shape)).isEmpty():
            errors.append(f"{family}/{shape}: blocks of another family or shape")
    return {"status": "ok" if not errors else "failed", "errors": errors}


# --- report ------------------------------------------------------------------------------------------------


def data_type_counts(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy(F.coalesce("data_type", F.lit("unknown")).alias("data_type")).agg(F.count(F.lit(1)).alias("records"))


def math_summary(blocks: DataFrame) -> DataFrame:
    """One row: how many blocks have each section of math."""
    n = lambda c: F.count_if(F.col(c).isNotNull()).alias(f"records_with_{c}") if c in blocks.columns else F.lit(0).cast("long").alias(f"records_with_{c}")
    return blocks.agg(F.count(F.lit(1)).alias("records_processed"), *[n(c) for c in ("technical_indicators", "view_technical", "statistics", "statistical_regimes", "microstructure", "feature_snapshot", "flags")])


def column_frequency(long_rows: DataFrame, block: list[str], column: str = "metric") -> DataFrame:
    """In how many blocks each numeric column occurs."""
    return long_rows.select(*block, column).distinct().groupBy(column).agg(F.count(F.lit(1)).alias("blocks"))


def previews(rows: DataFrame, block: list[str], order: tuple[str, ...], max_rows: int = 5) -> DataFrame:
    """The last rows of each block."""
    from pyspark.sql import Window as W

    w = W.partitionBy(*block).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= max_rows).drop("_n")


def feature_matrix_preview(blocks: DataFrame, names: list[str]) -> DataFrame:
    """One row for each block whose route includes the feature vector, one column a feature."""
    wanted = blocks.where("include_feature_vector")
    return wanted.select("source_name", "data_type", "symbol", "timeframe", *[F.element_at("feature_snapshot", n).alias(n) for n in names])

