"""Channels on one time line: alignment, forward fill, coverage.

Channels are unioned with a tag and brought together by one aggregate over time: one shuffle, however many channels.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import div
from ..series import Series, carry_forward


def _check(channels: dict[str, DataFrame], reference: str) -> None:
    if not channels:
        raise ValueError("channels must not be empty")
    if reference not in channels:
        raise ValueError(f"reference channel {reference} is missing")


def merge_channels(channels: dict[str, DataFrame], reference: str, keys: list[str], ts: str = "ts", method: str | None = None) -> DataFrame:
    """One row for each (keys, ts) of the reference; columns {channel}_{column}. Of rows of one time in a channel one counts.

    method ffill: a missing value is the channel's last one before, also from times that the reference doesn't have.
    """
    _check(channels, reference)
    if method not in {None, "ffill"}:
        raise ValueError("method must be None or ffill")
    names = {f"{k}_{c}": (k, c, t) for k, d in channels.items() for c, t in d.dtypes if c not in {*keys, ts}}
    parts = []
    for k, d in channels.items():
        cells = [(F.col(c) if owner == k else F.lit(None).cast(t)).alias(n) for n, (owner, c, t) in names.items()]
        parts.append(d.select(*keys, ts, *cells, F.lit(k == reference).alias("_ref")))
    every = reduce(DataFrame.unionByName, parts)
    out = every.groupBy(*keys, ts).agg(*[F.any_value(n, True).alias(n) for n in names], F.bool_or("_ref").alias("_ref"))
    if method == "ffill":
        out = carry_forward(out, Series(tuple(keys), (ts,)), {n: F.col(n) for n in names})
    return out.where("_ref").drop("_ref")


def align_channels(channels: dict[str, DataFrame], reference: str, keys: list[str], ts: str = "ts", method: str | None = None) -> dict[str, DataFrame]:
    """Every channel on the reference's times."""
    merged = merge_channels(channels, reference, keys, ts, method)
    return {k: merged.select(*keys, ts, *[F.col(f"{k}_{c}").alias(c) for c in d.columns if c not in {*keys, ts}]) for k, d in channels.items()}


def align_to_index(df: DataFrame, index: DataFrame, keys: list[str], ts: str = "ts", method: str | None = None) -> DataFrame:
    """df on the times of index (keys, ts)."""
    return align_channels({"x": df, "index": index.select(*keys, ts)}, "index", keys, ts, method)["x"]


def compute_missing_ratio(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Share of nulls of each series; a table without rows gives 0 for no keys and no rows otherwise."""
    return df.groupBy(*keys).agg(F.coalesce(div(F.count_if(F.col(column).isNull()), F.count(F.lit(1))), F.lit(0.0)).alias("missing_ratio"))


def diagnose_alignment(channels: dict[str, DataFrame], reference: str, keys: list[str], ts: str = "ts") -> DataFrame:
    """channel, coverage_ratio (times of the reference that have a value), missing_ratio (nulls in its own rows), n_samples.

    A channel's value is its first column besides keys and time.
    """
    _check(channels, reference)
    value = {k: next((c for c in d.columns if c not in {*keys, ts}), ts) for k, d in channels.items()}
    parts = [d.select(F.lit(k).alias("channel"), *keys, ts, F.col(value[k]).isNotNull().alias("has")) for k, d in channels.items()]
    rows = reduce(DataFrame.unionByName, parts)
    own = rows.groupBy("channel").agg(div(F.count_if(~F.col("has")), F.count(F.lit(1))).alias("missing_ratio"), F.count(F.lit(1)).alias("n_samples"))
    times = rows.groupBy(*keys, ts).agg(F.bool_or(F.col("channel") == reference).alias("ref"), F.collect_set(F.when(F.col("has"), F.col("channel"))).alias("who")).where("ref")
    names = list(channels)
    seen = times.agg(F.count(F.lit(1)).alias("_all"), *[F.count_if(F.array_contains("who", k)).alias(f"_{i}") for i, k in enumerate(names)])
    share = seen.select(F.inline(F.array(*[F.struct(F.lit(k).alias("_c"), F.coalesce(div(F.col(f"_{i}"), F.col("_all")), F.lit(0.0)).alias("coverage_ratio")) for i, k in enumerate(names)])))
    out = share.join(own, F.col("_c") == F.col("channel"), "left")
    return out.select(F.col("_c").alias("channel"), "coverage_ratio", F.coalesce("missing_ratio", F.lit(0.0)).alias("missing_ratio"), F.coalesce("n_samples", F.lit(0)).alias("n_samples"))


def compute_coverage_ratio(df: DataFrame, index: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    """One row: the share of the index's times at which df has a value; 0 for an empty index."""
    out = diagnose_alignment({"x": df, "index": index.select(*keys, ts)}, "index", keys, ts)
    return out.where("channel = 'x'").select("coverage_ratio")
