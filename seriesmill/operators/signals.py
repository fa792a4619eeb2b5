"""Trading signals: edges, volume alarms, stop levels, reference bands, trend blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import div
from ..series import Series
from .indicators import compute_bollinger_bands
from .recursive import position, trend_label


def rising_edge(s: Series, signal: str) -> Column:
    return F.when((F.col(signal) == 1) & (F.coalesce(s.lag(signal), F.lit(0)) != 1), 1.0).otherwise(0.0)


def detectar_compra(df: DataFrame, s: Series, signal: str, name: str = "compra") -> DataFrame:
    """1 where the signal turns on, else 0."""
    return df.withColumn(name, rising_edge(s, signal))


def detectar_venta(df: DataFrame, s: Series, signal: str, name: str = "venta") -> DataFrame:
    """-1 where the signal turns on, else 0."""
    return df.withColumn(name, F.when(rising_edge(s, signal) == 1, -1.0).otherwise(0.0))


def high_volume(df: DataFrame, s: Series, column: str = "volume", lookback: int = 500, n_last: int = 5, k: float = 1.0) -> DataFrame:
    """One row a series: high_volume 1 if the last n_last rows' mean exceeds mean + k deviations of the lookback rows before.

    Only the last rows of a series are ranked and kept, which Spark prunes before it shuffles.
    """
    desc = s.window.orderBy(*[F.desc(c) for c in s.order])
    rows = df.withColumn("_n", F.row_number().over(desc)).where(F.col("_n") <= n_last + lookback)
    new = F.col("_n") <= n_last
    g = rows.groupBy(*s.keys).agg(F.avg(F.when(new, F.col(column))).alias("_a"), F.avg(F.when(~new, F.col(column))).alias("_m"), F.coalesce(F.stddev_samp(F.when(~new, F.col(column))), F.lit(0.0)).alias("_sd"))
    return g.select(*s.keys, F.when(F.col("_a") > F.col("_m") + k * F.col("_sd"), 1).otherwise(0).alias("high_volume"))


def stop_loss_take_profit(df: DataFrame, s: Series, strong: float = 25.0, stop: float = 1.5, take: float = 2.0, weak_take: float = 1.5, checked: bool = True) -> DataFrame:
    """One row a series: sl and tp from the last close, atr, adx, plus_di and minus_di.

    The target is `take` average ranges away in a strong trend (adx), else weak_take; the stop `stop` on the other
    side. With checked, an atr that isn't positive is an error.
    """
    at = F.struct(*s.order)
    g = df.groupBy(*s.keys).agg(*[F.max_by(c, at).alias(c) for c in ("close", "atr", "adx", "plus_di", "minus_di")])
    if checked and not g.where("atr is null or atr <= 0").isEmpty():
        raise ValueError("ATR must be positive")
    way = F.when(F.col("plus_di") > F.col("minus_di"), 1.0).otherwise(-1.0)
    far = F.when(F.col("adx") >= strong, take).otherwise(weak_take)
    return g.select(*s.keys, (F.col("close") - way * stop * F.col("atr")).alias("sl"), (F.col("close") + way * far * F.col("atr")).alias("tp"))


def compute_bollinger_reference_signal(df: DataFrame, s: Series, x: str = "close", predicted: str = "y_pred", window: int = 20, k: float = 2.0) -> DataFrame:
    """Bands around the close; bb_signal is the prediction's distance to the middle in half band widths, bb_position its sign outside."""
    df = compute_bollinger_bands(df, s, x, window, k).withColumnsRenamed({f"bb_{c}_{window}": f"bb_{c}" for c in ("middle", "upper", "lower", "bandwidth", "percent_b")})
    half = (F.col("bb_upper") - F.col("bb_lower")) / 2
    df = df.withColumn("bb_signal", div(F.col(predicted) - F.col("bb_middle"), half))
    return df.withColumn("bb_position", position(F.col("bb_signal"), -1.0, 1.0))


def block_trends(df: DataFrame, keys: list[str], row: str, step: int, sensitivity: float = 0.0) -> DataFrame:
    """Blocks of `step` rows: score (relative change from first open to last close) and its label."""
    block = F.expr(f"{row} div {step}")
    g = df.groupBy(*keys, block.alias("block")).agg(F.min_by("open", row).alias("_o"), F.max_by("close", row).alias("_c"))
    g = g.withColumn("score", div(F.col("_c") - F.col("_o"), F.abs("_o"))).drop("_o", "_c")
    return g.withColumn("trend", trend_label(F.col("score"), sensitivity))


def weighted_trend_score(blocks: DataFrame, keys: list[str], history: int = 5) -> DataFrame:
    """Score in [-1, 1] of each block's label and the history before it, newer labels weighing more (1..n)."""
    s = Series(tuple(keys), ("block",))
    sign = F.when(F.col("trend") == "alcista", 1.0).when(F.col("trend") == "bajista", -1.0).otherwise(0.0)
    rows = blocks.withColumn("_l", F.collect_list(sign).over(s.last(history)))
    score = F.expr("aggregate(transform(_l, (v, i) -> v * (i + 1)), 0D, (a, v) -> a + v) / (size(_l) * (size(_l) + 1) / 2)")
    return rows.withColumn("trend_score", score).drop("_l")


def compute_block_trend_profile(df: DataFrame, keys: list[str], row: str, step: int = 2, sensitivity: float = 10.0) -> DataFrame:
    """df with trend_profile_{step}: tanh of the block's score times the sensitivity."""
    g = block_trends(df, keys, row, step).select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("block").alias("_block"), F.tanh(F.col("score") * sensitivity).alias(f"trend_profile_{step}"))
    on = F.expr(f"{row} div {step}") == F.col("_block")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return df.join(g, on, "left").drop("_block", *(f"_{k}" for k in keys))


def build_trending_struct(df: DataFrame, keys: list[str], order: tuple[str, ...], column: str = "FullTrend") -> DataFrame:
    """Levels (quantiles 0.9, 0.7, 0.3 and 0.1), last_value and signal of each series."""
    q = F.percentile(column, F.array(F.lit(0.9), F.lit(0.7), F.lit(0.3), F.lit(0.1)))
    g = df.groupBy(*keys).agg(q.alias("_q"), F.max_by(column, F.when(F.col(column).isNotNull(), F.struct(*order))).alias("last_value"))
    g = g.select(*keys, *[F.get("_q", F.lit(i)).alias(c) for i, c in enumerate(("strong_buy", "buy", "sell", "strong_sell"))], "last_value")
    v = F.col("last_value")
    return g.withColumn("signal", F.when(v >= F.col("strong_buy"), "strong_buy").when(v >= F.col("buy"), "buy").when(v <= F.col("strong_sell"), "strong_sell").when(v <= F.col("sell"), "sell").otherwise("neutral"))
