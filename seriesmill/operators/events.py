"""Outlier events of metric series and native events of payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import div, first_true, present

PER_METRIC, PER_BLOCK = 25, 150
THRESHOLD, HIGH = 2.0, 3.0
LARGE_VALUE = 1_000_000


def event_type(family: Column, metric: Column, direction: Column) -> Column:
    return first_true(
        (family == "liquidations", "liquidation_spike"), ((family == "institutional_flows") & metric.contains("netflow"), "exchange_netflow_spike"),
        (family == "mining_network_health", "miner_pressure_event"), (family == "onchain_holder_behavior", "accumulation_distribution_event"), (direction == "positive", "outlier_positive"), otherwise="outlier_negative",
    )


def extract_events(points: DataFrame, block: list[str], order: tuple[str, ...], family: Column | None = None, threshold: float = THRESHOLD, per_metric: int = PER_METRIC, per_block: int = PER_BLOCK) -> DataFrame:
    """points (block..., metric, order..., value) -> outliers by whole-series z-score, the strongest of each metric.

    Mean and deviation come from one aggregate that is joined back (one row a metric), so a hot series needs no window
    over all its rows; ranks are taken of outliers alone. Of each block the first per_block by (time, metric) stay.
    """
    keys = [*block, "metric"]
    stats = points.groupBy(*keys).agg(F.avg("value").alias("_m"), F.stddev_samp("value").alias("_sd")).where("_sd > 0")
    z = div(F.col("value") - F.col("_m"), F.col("_sd"))
    out = points.join(stats, keys).withColumn("zscore", z).where(F.abs("zscore") >= threshold).drop("_m", "_sd")
    out = out.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(F.abs("zscore").desc(), *order))).where(F.col("_r") <= per_metric)
    first = W.partitionBy(*block).orderBy(order[0], "metric", *order[1:])
    out = out.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= per_block).drop("_r")
    up = F.col("zscore") >= 0
    out = out.withColumns({"direction": F.when(up, "positive").otherwise("negative"), "severity": F.when(F.abs("zscore") >= HIGH, "high").otherwise("medium")})
    out = out.withColumn("event_type", event_type(F.lit("") if family is None else family, F.col("metric"), F.col("direction")))
    return out.withColumn("reason", F.concat(F.lit("zscore "), F.when(up, ">=").otherwise("<="), F.lit(" "), F.round("zscore", 4).cast("string")))


def native_events(events: DataFrame, family: str = "") -> DataFrame:
    """One event a row, with direction, value, metric and severity from whichever columns there are."""
    have = {*events.columns}
    pick = lambda names, kind: F.coalesce(*[present(F.col(c).cast(kind)) for c in names if c in have], F.lit(None).cast(kind))
    value = pick(("notional", "notional_usdt", "notional_usd", "value", "quantity", "quantity_btc"), "double")
    metric = "notional_usdt" if {"notional", "notional_usdt", "notional_usd"} & have else "value"
    out = events.withColumns({"direction": pick(("side", "direction", "aggressor_side"), "string"), "value": value, "metric": F.lit(metric), "family_key": F.lit(family)})
    return out.withColumns({"severity": F.when(F.abs("value") >= LARGE_VALUE, "high").otherwise("medium"), "reason": F.lit("native event record")})


def event_counts(events: DataFrame, block: list[str]) -> DataFrame:
    """Counts of events by type and severity."""
    return events.groupBy(*block, "event_type", "severity").agg(F.count(F.lit(1)).alias("events"))
