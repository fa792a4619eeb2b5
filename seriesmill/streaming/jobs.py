"""Streaming jobs. State is bounded by watermarks, or by one small row a series; checkpoints lie in the shared folder."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..storage import new_path

LATE = "1 hour"


def source(spark: SparkSession, path: str, schema, files: int = 64) -> DataFrame:
    """A folder, a pattern or one file of Parquet as a stream, so many files a batch.

    A plain path is handed on as a pattern of itself: the file source takes one file as a match, not as a base path.
    """
    if not set("*?[{") & set(path):
        path = f"{path[:-1]}[{path[-1]}]"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def bars(stream: DataFrame, keys: list[str], ts: str, tie: str, value: str, size: str, step: str | None = None, late: str = LATE, volume: Column | None = None) -> DataFrame:
    """Open, high, low, close and volume of tumbling (or sliding, with a step) windows."""
    at = F.struct(ts, tie)
    x = F.col(value)
    g = stream.withWatermark(ts, late).groupBy(*keys, F.window(ts, size, step) if step else F.window(ts, size))
    out = g.agg(F.min_by(x, at).alias("open"), F.max(x).alias("high"), F.min(x).alias("low"), F.max_by(x, at).alias("close"), F.sum(F.lit(1.0) if volume is None else volume).alias("volume"))
    return out.select(*keys, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "open", "high", "low", "close", "volume")


def deduplicate(stream: DataFrame, keys: list[str], ts: str, late: str = LATE) -> DataFrame:
    """The first row of each key within the watermark."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def sessions(stream: DataFrame, keys: list[str], ts: str, gap: str, late: str = LATE) -> DataFrame:
    """Bursts: runs of events with gaps below `gap`."""
    g = stream.withWatermark(ts, late).groupBy(*keys, F.session_window(ts, gap)).agg(F.count(F.lit(1)).alias("events"))
    return g.select(*keys, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "events")


def ema(stream: DataFrame, keys: list[str], ts: str, value: str, span: int = 20, ttl_ms: int | None = None) -> DataFrame:
    """The exponential average of each series after each batch: (keys, rows, ema). State: one double and a count a series.

    With ttl_ms a series that is silent for so long is forgotten.
    """
    alpha = 2 / (span + 1)
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema}
    out = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", rows bigint, ema double"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, y = state.get if state.exists else (0, float("nan"))
        rows = pd.concat(list(batches)).sort_values(ts, kind="stable")
        for x in rows[value].dropna():
            y = x if n == 0 else alpha * x + (1 - alpha) * y
            n += 1
        state.update((int(n), float(y)))
        if ttl_ms:
            state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame({**{k: [v] for k, v in zip(keys, key)}, "rows": [n], "ema": [y if n else None]})

    timeout = GroupStateTimeout.ProcessingTimeTimeout if ttl_ms else GroupStateTimeout.NoTimeout
    return stream.groupBy(*keys).applyInPandasWithState(step, out, "rows bigint, ema double", "append", timeout)


def hysteresis(stream: DataFrame, keys: list[str], ts: str, value: str, on: float, off: float) -> DataFrame:
    """Switches of a latch that is set at `on` and reset at `off`: one row for each change."""
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema}
    out = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + f", `{ts}` {kinds[ts]}, state int"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values(ts, kind="stable")
        when, what = [], []
        for t, x in zip(rows[ts], rows[value]):
            new = 1 if x >= on else 0 if x <= off else now
            if new != now:
                when.append(t)
                what.append(new)
                now = new
        state.update((int(now),))
        if when:
            yield pd.DataFrame({**{k: [v] * len(when) for k, v in zip(keys, key)}, ts: when, "state": what})

    return stream.groupBy(*keys).applyInPandasWithState(step, out, "state int", "append", GroupStateTimeout.NoTimeout)


def run_available(out: DataFrame, name: str, spark: SparkSession) -> DataFrame:
    """Run a stream over what is there now into a table of the shared folder, and read that."""
    path, check = new_path(spark, name), new_path(spark, f"{name}-checkpoint")
    q: Any = out.writeStream.format("parquet").option("path", path).option("checkpointLocation", check).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(path)
