"""Order books and event flow: conditional aggregates, one row a block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import div, number, side

LEVELS = (5, 10, 20)


def safe_sum(c: Column) -> Column:
    return F.coalesce(F.sum(number(c)), F.lit(0.0))


def book_levels(levels: DataFrame, keys: list[str], tie: str | None = None, deepest: int | None = None) -> DataFrame:
    """levels with `level`: 1 for the highest bid or the lowest ask of a block.

    With deepest, levels beyond it are left out (Spark then prunes before the shuffle).
    """
    price = F.when(F.col("side") == "bid", -F.col("price")).otherwise(F.col("price"))
    w = W.partitionBy(*keys, "side").orderBy(price.asc_nulls_last(), *([tie] if tie else []))
    out = levels.withColumn("level", F.row_number().over(w))
    return out.where(F.col("level") <= deepest) if deepest else out


def orderbook_metrics(levels: DataFrame, keys: list[str], tops: tuple = LEVELS, tie: str | None = None) -> DataFrame:
    """levels (side bid or ask, price, quantity, notional) -> metrics of each block that has both sides.

    Totals come from one aggregate over all levels; only the top levels are ranked.
    """
    bid, ask = F.col("side") == "bid", F.col("side") == "ask"
    total = levels.groupBy(*keys).agg(safe_sum(F.when(bid, F.col("notional"))).alias("total_bid_notional"), safe_sum(F.when(ask, F.col("notional"))).alias("total_ask_notional"), F.count_if(bid).alias("bid_levels"), F.count_if(ask).alias("ask_levels"))
    top = book_levels(levels, keys, tie, max(tops))
    at = lambda c, of: F.max(F.when(of & (F.col("level") == 1), F.col(c)))
    made = [at("price", bid).alias("best_bid"), at("price", ask).alias("best_ask"), at("quantity", bid).alias("_bq"), at("quantity", ask).alias("_aq")]
    for n in tops:
        made += [safe_sum(F.when(of & (F.col("level") <= n), F.col("notional"))).alias(f"{name}_notional_top_{n}") for name, of in (("bid", bid), ("ask", ask))]
    g = top.groupBy(*keys).agg(*made).join(total, keys).where("bid_levels > 0 and ask_levels > 0")
    b, a = F.col("best_bid"), F.col("best_ask")
    g = g.withColumns({"spread": a - b, "mid_price": (a + b) / 2, "weighted_mid_price": div(b * F.col("_aq") + a * F.col("_bq"), F.col("_bq") + F.col("_aq"))})
    balance = lambda x, y: div(F.col(x) - F.col(y), F.col(x) + F.col(y))
    g = g.withColumns({"spread_bps": div(F.col("spread"), F.col("mid_price")) * 10000, "orderbook_imbalance_total": balance("total_bid_notional", "total_ask_notional")} | {f"depth_imbalance_top_{n}": balance(f"bid_notional_top_{n}", f"ask_notional_top_{n}") for n in tops})
    return wall_scores(g).drop("_bq", "_aq")


def wall_scores(book: DataFrame) -> DataFrame:
    """Share of each side in the notional of the ten best levels."""
    both = F.col("bid_notional_top_10") + F.col("ask_notional_top_10")
    return book.withColumns({"bid_wall_score": div(F.col("bid_notional_top_10"), both), "ask_wall_score": div(F.col("ask_notional_top_10"), both)})


def weighted_avg_price(price: Column, quantity: Column) -> Column:
    return div(F.sum(price * quantity), F.sum(quantity))


def event_flow_metrics(events: DataFrame, keys: list[str], notional: str = "notional", quantity: str = "quantity") -> DataFrame:
    """Counts, notional, imbalance and average price of buys and sells, and ages where the columns exist.

    bid and ask count as buy and sell.
    """
    e = events.withColumns({"_side": side(F.col("side")), "_n": F.coalesce(number(notional), F.lit(0.0)), "_q": F.coalesce(number(quantity), F.lit(0.0)), "_p": number("price")})
    made = [F.count(F.lit(1)).alias("total_count")]
    for k in ("buy", "sell"):
        mine = F.col("_side") == k
        q = F.when(mine, F.col("_q"))
        made += [F.count_if(mine).alias(f"{k}_count"), F.coalesce(F.sum(F.when(mine, F.col("_n"))), F.lit(0.0)).alias(f"{k}_notional"), weighted_avg_price(F.col("_p"), q).alias(f"{k}_vwap")]
    if "age_seconds" in e.columns:
        age = number("age_seconds")
        made += [F.avg(age).alias("event_age_seconds_mean"), F.max(age).alias("event_age_seconds_max"), F.min(age).alias("event_age_seconds_min")]
    if "active_duration_seconds" in e.columns:
        age = number("active_duration_seconds")
        made += [F.avg(age).alias("whale_order_age_seconds_mean"), F.max(age).alias("whale_order_age_seconds_max"), F.min(age).alias("whale_order_age_seconds_min"), (F.avg(age) / 60).alias("whale_order_age_minutes_mean"), (F.max(age) / 60).alias("whale_order_age_minutes_max")]
    g = e.groupBy(*keys).agg(*made)
    b, a = F.col("buy_notional"), F.col("sell_notional")
    return g.withColumns({"total_notional": b + a, "flow_imbalance": div(b - a, b + a)})


def side_by_side(levels: DataFrame, keys: list[str], columns: tuple = ("price", "quantity", "notional"), tie: str | None = None) -> DataFrame:
    """bid_* and ask_* columns by level: one pivot-like aggregate instead of a join of both sides."""
    ranked = book_levels(levels, keys, tie)
    made = [F.max(F.when(F.col("side") == k, F.col(c))).alias(f"{k}_{c}") for k in ("bid", "ask") for c in columns]
    return ranked.groupBy(*keys, "level").agg(*made)
