"""Rule tables of candle, chart, liquidity, flow, mining and on-chain patterns.

Every rule is an expression over a row and lags of it; hits come out as rows by filtering an array of structs, so all
rows of all series are judged in one pass. `last_only` keeps what holds at the last row of each series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import div
from ..series import Series

HIGH_CONFIDENCE = 0.75
CANDLE = ("open", "high", "low", "close")


def rule(name: str, category: str, direction: str | Column, confidence: float | Column, holds: Column, span: int = 1, rank: int = 0) -> Column:
    """One hit as a struct, null if the rule doesn't hold."""
    direction = direction if isinstance(direction, Column) else F.lit(direction)
    confidence = confidence if isinstance(confidence, Column) else F.lit(float(confidence))
    return F.when(holds, F.struct(F.lit(name).alias("name"), F.lit(category).alias("category"), direction.alias("direction"), confidence.alias("confidence"), F.lit(span).alias("span"), F.lit(rank).alias("rank")))


def hits(rows: DataFrame, rules: list[Column], keep: list[str], unique: bool = False) -> DataFrame:
    """One row for each rule that holds: keep..., name, category, direction, confidence, span.

    unique: of rules of one name the first that holds in a row (by rank) counts.
    """
    found = F.filter(F.array(*rules), lambda r: r.isNotNull())
    if unique:
        found = F.filter(found, lambda r, i: ~F.exists(F.slice(found, 1, i), lambda q: q["name"] == r["name"]))
    out = rows.select(*keep, F.inline(found))
    return out.drop("rank")


def last_only(df: DataFrame, s: Series) -> DataFrame:
    """Rows at the end of each series: found by an aggregate that is joined back, not by a window over the series."""
    at = F.struct(*s.order)
    ends = df.groupBy(*[F.col(k).alias(f"_{k}") for k in s.keys]).agg(F.max(at).alias("_end"))
    on = at == F.col("_end")
    for k in s.keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return df.join(ends, on).drop("_end", *(f"_{k}" for k in s.keys))


# --- candles -----------------------------------------------------------------------------------------------


def candle_shapes(bars: DataFrame, s: Series) -> DataFrame:
    """Bars without nulls, with body, range, wicks and ratios (0 where the range is 0)."""
    bars = bars.where(" and ".join(f"{c} is not null" for c in CANDLE))
    o, h, low, c = (F.col(k) for k in CANDLE)
    bars = bars.withColumns({"rng": h - low, "body": F.abs(c - o), "upper": h - F.greatest(o, c), "lower": F.least(o, c) - low})
    ratio = lambda x: F.coalesce(div(F.col(x), F.col("rng")), F.lit(0.0))
    return bars.withColumns({"body_ratio": ratio("body"), "upper_ratio": ratio("upper"), "lower_ratio": ratio("lower"), "bull": c > o, "bear": c < o, "doji": (F.col("rng") > 0) & (ratio("body") <= 0.1)})


_LAGGED = (*CANDLE, "rng", "body_ratio", "bull", "bear")


def candle_rows(bars: DataFrame, s: Series, lookback: int = 5) -> DataFrame:
    """Shapes with the two candles before (p_*, q_*) and `trend`: the close against that `lookback` candles before."""
    rows = candle_shapes(bars, s)
    w = s.window.rowsBetween(-lookback, 0)
    made = {f"p_{c}": s.lag(c) for c in _LAGGED} | {f"q_{c}": s.lag(c, 2) for c in _LAGGED}
    return rows.withColumns(made | {"trend": F.signum(F.col("close") - F.first("close").over(w))})


def candle_rules() -> list[Column]:
    """The thresholds and confidences of the candle rules."""
    o, h, low, c, b, u, d = (F.col(k) for k in (*CANDLE, "body_ratio", "upper_ratio", "lower_ratio"))
    body, up, down, bull, bear = (F.col(k) for k in ("body", "upper", "lower", "bull", "bear"))
    po, ph, pl, pc, pb, pbull, pbear, prng = (F.col(f"p_{k}") for k in (*CANDLE, "body_ratio", "bull", "bear", "rng"))
    qo, qc, qb, qbull, qbear = (F.col(f"q_{k}") for k in ("open", "close", "body_ratio", "bull", "bear"))
    fell, rose = F.col("trend") < 0, F.col("trend") > 0
    hang = (down >= 2 * body) & (up <= body) & (b <= 0.35)
    stand = (up >= 2 * body) & (down <= body) & (b <= 0.35)
    inside = (F.least(o, c) >= F.least(po, pc)) & (F.greatest(o, c) <= F.greatest(po, pc))
    near = F.greatest(prng, F.col("rng"), F.lit(1.0)) * 0.002
    pair, mid, first_mid = pc.isNotNull(), (po + pc) / 2, (qo + qc) / 2
    one, two, three, more = "single_candle", "two_candle", "three_candle", "continuation_indecision"
    bodies = (b > 0.20) & (pb > 0.20) & (qb > 0.20)
    after = lambda when, yes, no: F.when(when, yes).otherwise(no)
    return [
        rule("doji", one, "neutral", 0.72, b <= 0.10),
        rule("dragonfly_doji", one, "bullish", 0.76, (b <= 0.10) & (d >= 0.60) & (u <= 0.10)),
        rule("gravestone_doji", one, "bearish", 0.76, (b <= 0.10) & (u >= 0.60) & (d <= 0.10)),
        rule("spinning_top", one, "neutral", 0.68, (b > 0.10) & (b <= 0.35) & (u >= 0.20) & (d >= 0.20)),
        rule("marubozu", one, F.when(bull, "bullish").when(bear, "bearish").otherwise("neutral"), 0.80, (b >= 0.85) & (u <= 0.05) & (d <= 0.05)),
        rule("hammer", one, "bullish", after(fell, 0.78, 0.66), hang),
        rule("inverted_hammer", one, "bullish", after(fell, 0.74, 0.64), stand),
        rule("shooting_star", one, "bearish", after(rose, 0.78, 0.62), stand),
        rule("hanging_man", one, "bearish", after(rose, 0.76, 0.62), hang),
        rule("bullish_engulfing", two, "bullish", 0.82, pbear & bull & (o <= pc) & (c >= po), 2),
        rule("bearish_engulfing", two, "bearish", 0.82, pbull & bear & (o >= pc) & (c <= po), 2),
        rule("bullish_harami", two, "bullish", 0.70, pbear & (pb >= 0.50) & ~bear & inside, 2),
        rule("bearish_harami", two, "bearish", 0.70, pbull & (pb >= 0.50) & ~bull & inside, 2),
        rule("piercing_line", two, "bullish", 0.76, pbear & bull & (o < F.least(pl, pc)) & (c > mid) & (c < po), 2),
        rule("dark_cloud_cover", two, "bearish", 0.76, pbull & bear & (o > F.greatest(ph, pc)) & (c < mid) & (c > po), 2),
        rule("tweezer_top", two, "bearish", 0.66, pair & (F.abs(ph - h) <= near) & ~pbear & ~bull, 2),
        rule("tweezer_bottom", two, "bullish", 0.66, pair & (F.abs(pl - low) <= near) & ~pbull & ~bear, 2),
        rule("morning_star", three, "bullish", 0.78, qbear & (qb >= 0.50) & (pb <= 0.35) & bull & (c > first_mid), 3),
        rule("evening_star", three, "bearish", 0.78, qbull & (qb >= 0.50) & (pb <= 0.35) & bear & (c < first_mid), 3),
        rule("three_white_soldiers", three, "bullish", 0.82, qbull & pbull & bull & bodies & (qc < pc) & (pc < c), 3),
        rule("three_black_crows", three, "bearish", 0.82, qbear & pbear & bear & bodies & (qc > pc) & (pc > c), 3),
        rule("inside_bar", more, "neutral", 0.68, (h < ph) & (low > pl), 2),
        rule("outside_bar", more, "neutral", 0.68, (h > ph) & (low < pl), 2),
        rule("bullish_kicker", more, "bullish", 0.74, pbear & bull & ((o > po) | (b >= 0.60)), 2),
        rule("bearish_kicker", more, "bearish", 0.74, pbull & bear & ((o < po) | (b >= 0.60)), 2),
    ]


def candlestick_patterns(bars: DataFrame, s: Series, keep: list[str] | None = None) -> DataFrame:
    """Every candle pattern of every bar; a bar looks back over five."""
    return hits(candle_rows(bars, s), candle_rules(), keep or [*s.keys, *s.order])


def compute_candlestick_patterns(bars: DataFrame, s: Series) -> DataFrame:
    """Bars with candle_class and flags doji, hammer, bullish_engulfing, bearish_engulfing."""
    o, h, low, c = (F.col(k) for k in CANDLE)
    body, rng, po, pc = F.abs(c - o), h - low, s.lag("open"), s.lag("close")
    up, down = h - F.greatest(o, c), F.least(o, c) - low
    ratio = F.coalesce(div(body, rng), F.lit(0.0))
    flag = lambda x: F.coalesce(x, F.lit(False))
    return bars.withColumns({
        "candle_class": F.when(c > o, "bullish").when(c < o, "bearish").otherwise("neutral"), "doji": flag(ratio <= 0.10), "hammer": flag((down >= 2 * body) & (up <= body) & (ratio <= 0.35)),
        "bullish_engulfing": flag((pc < po) & (c > o) & (o <= pc) & (c >= po)), "bearish_engulfing": flag((pc > po) & (c < o) & (o >= pc) & (c <= po)),
    })


# --- charts ------------------------------------------------------------------------------------------------


def swing_points(bars: DataFrame, s: Series, lookback: int = 2) -> DataFrame:
    """Local highs and lows of centred windows: one row each, with kind and value; ends of a series have no swing."""
    w = s.window.rowsBetween(-lookback, lookback)
    rows = bars.withColumns({"_n": F.count(F.lit(1)).over(w), "_hi": F.max("high").over(w), "_lo": F.min("low").over(w)}).where(F.col("_n") == 2 * lookback + 1)
    point = lambda kind, n, c, holds: F.when(holds, F.struct(F.lit(kind).alias("kind"), F.lit(n).alias("nth"), F.col(c).alias("value")))
    found = F.filter(F.array(point("high", 0, "high", F.col("high") == F.col("_hi")), point("low", 1, "low", F.col("low") == F.col("_lo"))), lambda x: x.isNotNull())
    return rows.select(*s.keys, *s.order, "close", F.inline(found))


def head_and_shoulders(swings: DataFrame, s: Series) -> DataFrame:
    """Five alternating swings whose middle one lies 3 % beyond shoulders that are within 8 % of each other.

    One row at each right shoulder; confidence 0.66 where its close lies beyond the neckline, else 0.52.
    """
    t = Series(s.keys, (*s.order, "nth"))
    rows = swings.withColumns({f"_k{i}": t.lag("kind", i) for i in range(1, 5)} | {f"_v{i}": t.lag("value", i) for i in range(1, 5)})
    v = [F.col("value"), *[F.col(f"_v{i}") for i in range(1, 5)]]
    turns = F.lit(True)
    for i in range(1, 5):
        turns = turns & (F.col(f"_k{i}") != F.col("kind" if i == 1 else f"_k{i - 1}"))
    alike = F.abs(v[4] - v[0]) / F.greatest(F.abs(v[4]), F.abs(v[0]), F.lit(1.0)) <= 0.08
    rows = rows.where(turns & alike)
    top, bottom = F.col("kind") == "high", F.col("kind") == "low"
    over = top & (v[2] > v[4] * 1.03) & (v[2] > v[0] * 1.03)
    under = bottom & (v[2] < v[4] * 0.97) & (v[2] < v[0] * 0.97)
    sure = F.when(F.when(top, F.col("close") < F.least(v[1], v[3])).otherwise(F.col("close") > F.greatest(v[1], v[3])), 0.66).otherwise(0.52)
    rules = [rule("head_and_shoulders", "chart_pattern", "bearish", sure, over, 5), rule("inverse_head_and_shoulders", "chart_pattern", "bullish", sure, under, 5)]
    return hits(rows, rules, [*s.keys, *s.order])


def pennants(bars: DataFrame, s: Series, pole: int = 6, flag: int = 10) -> DataFrame:
    """A pole of at least 2 % and a flag that narrows below 75 % with falling highs and rising lows."""
    n = pole + flag
    at = {"_c0": s.lag("close", n - 1), "_c1": s.lag("close", flag), "_h0": s.lag("high", flag - 1), "_l0": s.lag("low", flag - 1), "_h1": s.lag("high"), "_l1": s.lag("low")}
    rows = bars.withColumns(at)
    change = (F.col("_c1") - F.col("_c0")) / F.greatest(F.abs("_c0"), F.lit(1.0))
    start, end = F.col("_h0") - F.col("_l0"), F.col("high") - F.col("low")
    narrow = (start > 0) & (end < start * 0.75) & (F.col("high") < F.col("_h0")) & (F.col("low") > F.col("_l0"))
    sure = lambda x: F.when(x, 0.64).otherwise(0.50)
    rules = [
        rule("bullish_pennant", "chart_pattern", "bullish", sure(F.col("close") > F.col("_h1")), narrow & (change >= 0.02), n),
        rule("bearish_pennant", "chart_pattern", "bearish", sure(F.col("close") < F.col("_l1")), narrow & (change <= -0.02), n),
    ]
    return hits(rows, rules, [*s.keys, *s.order])


def statistical_tags(stats: DataFrame, keys: list[str]) -> DataFrame:
    """Tags of a block from its first z-score and regime flags."""
    tag = lambda name, holds: F.when(holds, F.lit(name))
    made = F.array(tag("mean_reversion_extreme", F.abs("zscore") >= 2), tag("high_volatility_regime", F.col("high_volatility_regime")), tag("fat_tail_risk", F.col("fat_tail_risk")))
    return stats.select(*keys, F.explode(F.filter(made, lambda t: t.isNotNull())).alias("tag"))


# --- books, flow, mining, chain ----------------------------------------------------------------------------


def liquidity_patterns(book: DataFrame, keys: list[str]) -> DataFrame:
    i, b, a, bps = (F.col(c) for c in ("orderbook_imbalance_total", "bid_wall_score", "ask_wall_score", "spread_bps"))
    k = "liquidity"
    return hits(book, [rule("bid_liquidity_dominance", k, "bullish", 0.72, i > 0.2), rule("ask_liquidity_dominance", k, "bearish", 0.72, i < -0.2), rule("bid_wall", k, "bullish", 0.76, b > 0.65), rule("ask_wall", k, "bearish", 0.76, a > 0.65), rule("wide_spread", k, "neutral", 0.68, bps > 10)], keys)


def flow_patterns(flow: DataFrame, keys: list[str], kind: Column) -> DataFrame:
    """kind: orderbook_whale_orders or orderbook_large_trades, which rules on ages are for."""
    have = {*flow.columns}
    c = lambda name: F.col(name) if name in have else F.lit(None).cast("double")
    i, k, whale, large = c("flow_imbalance"), "event_flow", kind == "orderbook_whale_orders", kind == "orderbook_large_trades"
    lasting, fresh = whale & (c("whale_order_age_minutes_mean") > 60), large & (c("event_age_seconds_max") < 600)
    rules = [
        rule("buy_flow_dominance", k, "bullish", 0.72, i > 0.4), rule("sell_flow_dominance", k, "bearish", 0.72, i < -0.4),
        rule("old_whale_order_still_active", k, "neutral", 0.68, whale & (c("whale_order_age_minutes_max") > 180)),
        rule("persistent_whale_liquidity", k, "neutral", 0.70, lasting), rule("whale_liquidity_persistence", k, "neutral", 0.70, lasting),
        rule("recent_large_trade_cluster", k, "neutral", 0.70, fresh), rule("large_trade_cluster", k, "neutral", 0.70, fresh),
    ]
    return hits(flow, rules, keys, unique=True)


def _columns(df: DataFrame, s: Series, names: tuple) -> DataFrame:
    df = df.withColumns({c: F.lit(None).cast("double") for c in names if c not in df.columns})
    return df.withColumns({f"p_{c}": s.lag(c) for c in names})


def _change(c: str) -> Column:
    return div(F.col(c) - F.col(f"p_{c}"), F.abs(f"p_{c}"))


def mining_patterns(df: DataFrame, s: Series) -> DataFrame:
    """Patterns of every row against the one before."""
    if "hash_rate" not in df.columns and "hashrate" in df.columns:
        df = df.withColumnRenamed("hashrate", "hash_rate")
    rows = _columns(df, s, ("miner_ratio", "miner_netflow_btc", "miner_inflow_btc", "miner_outflow_btc", "hash_rate", "difficulty"))
    ratio, net, k = F.col("miner_ratio"), F.col("miner_netflow_btc"), "mining_regime"
    rules = [
        rule("miner_pressure_high", k, "bearish", 0.74, ratio >= 1.2), rule("miner_distribution", k, "bearish", 0.70, net < 0), rule("miner_accumulation", k, "bullish", 0.70, net > 0),
        rule("miner_distribution", k, "bearish", 0.70, F.col("miner_outflow_btc") > F.col("miner_inflow_btc")), rule("hash_rate_expansion", k, "bullish", 0.68, _change("hash_rate") >= 0.02),
        rule("hash_rate_contraction", k, "bearish", 0.68, _change("hash_rate") <= -0.02), rule("network_stress", k, "bearish", 0.76, (_change("difficulty") > 0) & (_change("hash_rate") < 0)), rule("network_stress", k, "bearish", 0.76, ratio >= 1.5),
    ]
    return hits(rows, rules, [*s.keys, *s.order], unique=True)


def onchain_patterns(df: DataFrame, s: Series) -> DataFrame:
    rows = _columns(df, s, ("accumulation_score", "distribution_score", "exchange_balance_btc", "mvrv", "sopr", "long_term_holder_supply", "short_term_holder_supply"))
    mvrv, sopr, k = F.col("mvrv"), F.col("sopr"), "onchain_regime"
    rules = [
        rule("accumulation_regime", k, "bullish", 0.72, F.col("accumulation_score") >= 0.6), rule("distribution_regime", k, "bearish", 0.72, F.col("distribution_score") >= 0.6),
        rule("holder_confidence_high", k, "bullish", 0.68, F.col("long_term_holder_supply") > F.col("short_term_holder_supply")),
        rule("profit_taking_risk", k, "bearish", 0.70, mvrv >= 2.5), rule("profit_taking_risk", k, "bearish", 0.70, sopr >= 1.05), rule("capitulation_risk", k, "bearish", 0.70, mvrv <= 0.9), rule("capitulation_risk", k, "bearish", 0.70, sopr < 1),
        rule("exchange_balance_rising", k, "bearish", 0.66, _change("exchange_balance_btc") >= 0.005), rule("exchange_balance_falling", k, "bullish", 0.66, _change("exchange_balance_btc") <= -0.005),
    ]
    return hits(rows, rules, [*s.keys, *s.order], unique=True)


def pattern_summary(found: DataFrame, keys: list[str]) -> DataFrame:
    """Counts by direction, of high confidence, and the sorted categories, of each block."""
    n = lambda d: F.count_if(F.col("direction") == d)
    return found.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_patterns"), n("bullish").alias("bullish_count"), n("bearish").alias("bearish_count"), n("neutral").alias("neutral_count"),
        F.count_if(F.col("confidence") >= HIGH_CONFIDENCE).alias("high_confidence_count"), F.array_sort(F.collect_set("category")).alias("active_categories"),
    )


def detect(kind: str, df: DataFrame, s: Series) -> DataFrame:
    """Patterns at the last row of each series, by kind of block."""
    if kind == "candlestick":
        shaped = [candlestick_patterns(df, s), head_and_shoulders(swing_points(df, s), s), pennants(df, s)]
        every = shaped[0].unionByName(shaped[1]).unionByName(shaped[2])
        at = F.struct(*s.order)
        ends = df.groupBy(*[F.col(k).alias(f"_{k}") for k in s.keys]).agg(F.max(at).alias("_end"))
        on = at == F.col("_end")
        for k in s.keys:
            on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
        return every.join(ends, on).drop("_end", *(f"_{k}" for k in s.keys))
    if kind in {"mining_network_health", "onchain_holder_behavior"}:
        return last_only((mining_patterns if kind == "mining_network_health" else onchain_patterns)(df, s), s)
    raise ValueError(f"no patterns for {kind}")
