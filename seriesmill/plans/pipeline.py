"""The whole run: payloads to families, report and validation.

payloads -> detect, route, decide, classify -> frames of all blocks at once -> statistics, regimes, indicators, book and
flow metrics, patterns -> one row a block -> family outputs -> report. Every step is one plan over all blocks; only the
last values of rolling operators leave, so series are cut to the rows those need before they are windowed.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import events, indicators, microstructure, patterns, regimes, rolling
from ..operators.recursive import HALO
from ..series import Series, largest
from ..sources import ingest, readers, sinks
from ..storage import materialise

BLOCK = ["source_name"]
WINDOWS = rolling.WINDOWS
PIPELINE, VERSION = "seriesmill", "0.1.0"


def tail(df: DataFrame, s: Series, rows: int) -> DataFrame:
    """The last rows of each series; Spark limits groups before the shuffle."""
    w = W.partitionBy(*s.keys).orderBy(*[F.desc(c) for c in s.order])
    return df.withColumn("_t", F.row_number().over(w)).where(F.col("_t") <= rows).drop("_t")


def spread(spark: SparkSession) -> int:
    """Partitions for work that isn't told by its bytes."""
    return 3 * spark.sparkContext.defaultParallelism


def nested(df: DataFrame, keys: list[str], name: str, order: tuple[str, ...]) -> DataFrame:
    """Rows of a block as one sorted array of structs; a block is one payload, so this is bounded by one document."""
    rest = [c for c in df.columns if c not in {*keys, *order}]
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, *rest))).alias(name))


def last_map(df: DataFrame, s: Series, columns: list[str], name: str) -> DataFrame:
    """The last non-null values of columns as one map."""
    at = F.struct(*s.order)
    picked = df.groupBy(*s.keys).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in columns])
    cells = F.map_from_entries(F.array(*[F.struct(F.lit(c), F.col(c).cast("string")) for c in columns]))
    return picked.select(*s.keys, F.map_filter(cells, lambda _, v: v.isNotNull()).alias(name))


def catalogue(payloads: DataFrame) -> DataFrame:
    """One row a payload with what it is and where it goes."""
    found = ingest.detect(payloads)
    return ingest.classify(ingest.decide(ingest.route(found).withColumn("has_ohlc", F.col("data_type") == "candlestick")))


def melted(df: DataFrame, names: tuple, label: Column) -> DataFrame:
    """Columns of a frame as rows (source_name, ts, pos, metric, value)."""
    cells = F.array(*[F.struct(F.concat(label, F.lit(c)).alias("metric"), F.col(c).alias("value")) for c in names])
    return df.select(*BLOCK, "ts", "pos", F.inline(cells)).where("value is not null")


def long_series(blocks: DataFrame, candles: DataFrame, levels: DataFrame, trades: DataFrame) -> DataFrame:
    """(source_name, metric, ordinal, ts, pos, value) of every numeric column; close, then value, come first.

    Levels of a book count as rows from the best price on.
    """
    none = F.lit("")
    ranked = microstructure.book_levels(levels, BLOCK, "pos").withColumns({"ts": F.lit(None).cast("timestamp"), "pos": F.col("level")})
    rows = ingest.metrics(blocks).unionByName(melted(candles, ("close", "open", "high", "low", "volume", "notional_volume"), none))
    rows = rows.unionByName(melted(trades, ("price", "quantity", "notional", "age_seconds", "active_duration_seconds"), none))
    rows = rows.unionByName(melted(ranked, ("price", "quantity", "notional"), F.concat(F.col("side"), F.lit("_"))))
    return rows.withColumn("ordinal", F.when(F.col("metric") == "close", 0).when(F.col("metric") == "value", 1).otherwise(2))


def statistics(series: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(statistics, regimes, flags) of each block: last values of every metric and window, and the block's flags."""
    s = Series((*BLOCK, "metric", "ordinal"), ("ts", "pos"))
    # Tails are few bytes but much work, and adaptive execution would give them to few tasks. (Keys in the order that
    # the tails already have would be no exchange of their own.)
    cut = tail(series, s, 2 * max(WINDOWS) + 2).repartition(spread(series.sparkSession), *reversed(s.keys))
    last = materialise(regimes.last_statistics(cut, s, "value", WINDOWS, tuple(m for m in rolling.METRICS if m != "rolling_entropy")), "statistics")
    made = [c for c in last.columns if c.startswith("value__")]
    part = lambda names: F.map_from_entries(F.array(*[F.struct(F.concat(F.col("metric"), F.lit(c.removeprefix("value"))), F.col(c).cast("string")) for c in names]))
    g = last.groupBy(*BLOCK).agg(F.collect_list(part([c for c in made if c.split("__")[1].startswith(("rolling", "realized"))])).alias("a"), F.collect_list(part([c for c in made if not c.split("__")[1].startswith(("rolling", "realized"))])).alias("b"))
    merge = lambda c: F.map_filter(F.map_from_entries(F.flatten(F.transform(c, F.map_entries))), lambda _, v: v.isNotNull())
    stats, regs = g.select(*BLOCK, merge("a").alias("statistics")), g.select(*BLOCK, merge("b").alias("statistical_regimes"))
    cells = F.array(*[F.struct(F.struct("ordinal", "metric", F.lit(i).alias("i")).alias("ordinal"), F.col(f"value__zscore_{n}").alias("zscore"), F.col(f"value__regime_{n}").alias("regime"), F.col(f"value__rolling_skewness_{n}").alias("skewness"), F.col(f"value__rolling_kurtosis_{n}").alias("kurtosis")) for i, n in enumerate(WINDOWS)])
    flags = regimes.regime_flags(last.select(*BLOCK, F.inline(cells)), BLOCK)
    return stats, regs, flags.select(*BLOCK, F.struct(*regimes.FLAGS).alias("flags"))


def blocks_of(spark: SparkSession, payloads: DataFrame) -> DataFrame:
    """One row a block with all nested frames and sections that families are written from."""
    cat = materialise(catalogue(payloads.repartition(spread(spark), *BLOCK)), "catalogue")
    candles = materialise(ingest.candles(cat).where("ts is not null"), "candles")
    levels, trades = materialise(ingest.levels(cat), "levels"), materialise(ingest.trades(cat), "trades")
    series = materialise(long_series(cat, candles, levels, trades), "series")
    bar = Series(tuple(BLOCK), ("ts", "pos"))

    stats, regs, flags = statistics(series)
    book = microstructure.orderbook_metrics(levels, BLOCK, tie="pos")
    flow = microstructure.event_flow_metrics(trades, BLOCK)
    as_map = lambda df: df.select(*BLOCK, F.map_filter(F.map_from_entries(F.array(*[F.struct(F.lit(c), F.col(c).cast("double")) for c in df.columns if c not in BLOCK])), lambda _, v: v.isNotNull()).alias("microstructure"))
    micro = as_map(book).unionByName(as_map(flow))

    kinds = cat.select(*BLOCK, F.col("data_type").alias("kind"))
    shown = ["name", "category", "direction", "confidence"]
    found = [patterns.detect("candlestick", candles.dropna(subset=["open", "high", "low", "close"]), bar).select(*BLOCK, *shown), patterns.liquidity_patterns(book, BLOCK).select(*BLOCK, *shown), patterns.flow_patterns(flow.join(kinds, BLOCK), BLOCK, F.col("kind")).select(*BLOCK, *shown)]
    hits = found[0].unionByName(found[1]).unionByName(found[2])
    pats = hits.groupBy(*BLOCK).agg(F.array_sort(F.collect_list(F.struct(*shown))).alias("patterns"))

    family = cat.select(*BLOCK, "family_key")
    outliers = events.extract_events(series.join(family, BLOCK), BLOCK, ("ts", "pos"), F.col("family_key"))
    own = events.native_events(trades.select(*BLOCK, "ts", "pos", "side", "notional", "quantity", "event_type"))
    cols = ["ts", "pos", "metric", "value", "direction", "severity", "event_type", "reason"]
    evs = nested(outliers.select(*BLOCK, *cols).unionByName(own.select(*BLOCK, *cols)), BLOCK, "events", ("ts", "pos", "metric"))

    # One row a block that has no candles: the metric that it is seen as. Joined, not a window over all rows of a block.
    first = series.groupBy(*BLOCK).agg(F.min(F.struct("ordinal", "metric")).alias("_r")).select(*BLOCK, F.col("_r.metric").alias("metric"))
    first = materialise(first.join(candles.select(*BLOCK).distinct(), BLOCK, "left_anti"), "reference")
    flat = series.join(first, [*BLOCK, "metric"]).select(*BLOCK, "ts", "pos", *[F.col("value").alias(c) for c in ("open", "high", "low", "close")], F.lit(None).cast("double").alias("volume"))
    own = candles.select(*BLOCK, "ts", "pos", "open", "high", "low", "close", "volume")
    bars = flat.unionByName(own)
    # Indicators of candles, and of the candles that other blocks are seen as, from one plan.
    # Running sums begin at a series' first row: they see all of it, what is bounded or forgets its tail.
    # Blocks that are seen as candles have no volume, so no VWAP, and an OBV of 0.
    sums = ["vwap", "obv"]
    near = materialise(tail(bars, bar, HALO), "tails")
    tech = last_map(indicators.technical(near.repartition(spread(spark), *BLOCK), bar, longest=HALO), bar, [c for c in indicators.TECHNICAL if c not in sums], "_near")
    longest = largest(own, bar)
    whole = last_map(indicators.obv(indicators.vwap(own, bar, longest=longest), bar, longest=longest), bar, sums, "_whole")
    tech = tech.join(whole.unionByName(first.select(*BLOCK, F.create_map(F.lit("obv"), F.lit("0.0")).alias("_whole"))), BLOCK)
    tech = tech.select(*BLOCK, F.map_concat("_near", "_whole").alias("view_technical"))
    side = lambda k, name: nested(levels.where(F.col("side") == k).drop("side"), BLOCK, name, ("pos",))
    frame = nested(series.select(*BLOCK, "ts", "pos", "metric", "value"), BLOCK, "series", ("ts", "pos", "metric"))

    out = cat.drop("payload")
    for part in (stats, regs, flags, tech, micro, pats, evs, nested(bars, BLOCK, "bars", ("ts", "pos")), side("bid", "bids"), side("ask", "asks"), frame, candles.groupBy(*BLOCK).agg((F.count("volume") > 0).alias("has_volume"))):
        out = out.join(part, BLOCK, "left")
    out = out.withColumn("technical_indicators", F.when(F.col("apply_technical_indicators"), F.col("view_technical")))
    snapshot = lambda c: F.coalesce(F.transform_values(c, lambda _, v: v.try_cast("double")), F.create_map().cast("map<string,double>"))
    return out.withColumn("feature_snapshot", F.map_filter(F.map_concat(snapshot("technical_indicators"), snapshot("microstructure"), snapshot("statistics")), lambda _, v: v.isNotNull()))


def run_pipeline(spark: SparkSession, input_path: str, output_path: str, max_rows: int = 5) -> dict[str, Any]:
    """Read payloads, write family outputs and the report under output_path; returns the report."""
    blocks = materialise(blocks_of(spark, readers.read_payloads(spark, input_path)), "blocks")
    index = sinks.write_family_outputs(blocks, f"{output_path}/families", F.col("has_volume"))
    shown = blocks.select("source_name", "data_type", "symbol", "timeframe", "family_key", "output_shape", "output_filename")
    shown.write.mode("overwrite").json(f"{output_path}/report/block_index")
    blocks.where("is_metadata").select("source_name", "data_type", "canonical_type").write.mode("overwrite").json(f"{output_path}/metadata/manifest")
    preview = sinks.previews(blocks.select("source_name", F.inline("series")), BLOCK, ("ts", "pos", "metric"), max_rows)
    preview.write.mode("overwrite").json(f"{output_path}/report/previews")
    counts = {r["data_type"]: r["records"] for r in sinks.data_type_counts(blocks).collect()}  # one row a data type
    math = sinks.math_summary(blocks).first().asDict()
    return {"pipeline": PIPELINE, "version": VERSION, "records_processed": math["records_processed"], "data_types": counts, "math_summary": math, "families": index, "validation": sinks.validate_family_outputs(spark, index)}

