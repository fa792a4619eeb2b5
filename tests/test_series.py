"""Windows over series: full frames, and chunks that give what one window gives."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seriesmill import series
from seriesmill.operators import indicators, patterns, recursive, regimes, rolling, tda, volume
from seriesmill.series import Series, bounded, carry_forward, row_numbers, running_sum

S = Series(("k",), ("t",))


@pytest.fixture(scope="module")
def bars(spark):
    rng = np.random.default_rng(5)
    rows = []
    for k, n in (("hot", 900), ("cold", 120), (None, 40)):
        c = 100 + rng.normal(0, 1, n).cumsum()
        o = c + rng.normal(0, 0.4, n)
        rows += [(k, t, float(a), float(max(a, b) + 0.3), float(min(a, b) - 0.2), float(b), float(v), None if t % 17 == 3 else float(b)) for t, (a, b, v) in enumerate(zip(o, c, rng.integers(1, 50, n)))]
    return spark.createDataFrame(rows, "k string, t long, open double, high double, low double, close double, volume double, x double").repartition(5).cache()


def same(a, b, *columns):
    cols = ["k", "t", *columns]
    x, y = (d.select(*cols).toPandas().sort_values(["k", "t"], na_position="first", ignore_index=True) for d in (a, b))
    pd.testing.assert_frame_equal(x, y, rtol=1e-9, atol=1e-12)


def bucket():
    return F.floor(F.col("t") / 37)


def test_row_numbers(bars):
    got = row_numbers(bars, S, bucket()).select("k", "t", "_rn").collect()
    assert len(got) == 1060 and all(r["t"] == r["_rn"] for r in got)


OPERATORS = {
    "rolling": (101, lambda d, s: rolling.rolling_metrics(d, s, "x", (20, 50)), [f"x__{m}_{n}" for n in (20, 50) for m in rolling.METRICS]),
    "invariants": (20, lambda d, s: rolling.invariants(d, s, "close"), [f"close_{c}" for c in rolling.INVARIANTS]),
    "regimes": (101, lambda d, s: regimes.classify_series(d, s, "close", (20, 50)), [f"close__{c}_{n}" for n in (20, 50) for c in ("zscore", "volatility", "drawdown", "regime")]),
    "frames": (100, lambda d, s: indicators.frame_indicators(d, s), ["sma_20", "wma_20", "cci_20", "bb_upper_20", "fib_618_100", "stoch_d_14"]),
    "recursive": (600, lambda d, s: recursive.recursive_indicators(d, s), ["ema_20", "macd_hist", "rsi_14", "adx_14", "tsi", "keltner_upper_20"]),
    "wasserstein": (40, lambda d, s: tda.rolling_wasserstein_profile(d, s, "close"), ["wasserstein"]),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_chunks_give_what_one_window_gives(bars, name):
    halo, work, columns = OPERATORS[name]
    same(bounded(bars, S, halo, work, chunk_rows=200 if halo < 200 else 700, bucket=bucket()), work(bars, S), *columns)


def test_running_sums_and_fill_in_two_levels(bars):
    make = {"total": F.col("x"), "one": F.lit(1.0)}
    same(running_sum(bars, S, make, 50, bucket()), running_sum(bars, S, make), "total", "one")
    fill = {"f": F.when(F.col("t") % 90 == 7, F.col("close"))}
    same(carry_forward(bars, S, fill, 50, bucket()), carry_forward(bars, S, fill), "f")
    same(indicators.obv(bars, S, 50, bucket()), indicators.obv(bars, S), "obv")
    same(indicators.vwap(bars, S, 50, bucket()), indicators.vwap(bars, S), "vwap")
    same(tda.wasserstein_regime_signal(bars, S, "close", 103, 100, 95, 98, chunk_rows=50, bucket=bucket()), tda.wasserstein_regime_signal(bars, S, "close", 103, 100, 95, 98), "regime_signal")


def test_last_statistics_are_those_of_all_rows(bars):
    every = regimes.classify_series(rolling.rolling_metrics(bars, S, "x", (20, 50)), S, "x", (20, 50))
    made = [c for c in every.columns if c.startswith("x__")]
    want = every.groupBy("k").agg(F.lit(0).alias("t"), *[F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("t"))).alias(c) for c in made])
    same(regimes.last_statistics(bars, S, "x", (20, 50)).withColumn("t", F.lit(0)), want, *made)


def test_a_chunk_of_the_arrow_pass_is_small():
    """What a Python worker takes for the windows of a whole chunk: 24 MB (167 MB with chunks of 500,000 rows)."""
    import tracemalloc

    rng = np.random.default_rng(7)
    v = {c: rng.normal(100, 1, series.CHUNK_ROWS + 101) for c in rolling.INPUTS.values()}
    tracemalloc.start()
    rolling.every_window(v, "value", (20, 50, 100), ("rolling_quantile_25", "rolling_quantile_75", "rolling_iqr", "rolling_entropy"))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 60e6


def test_sum_is_null_in_rows_without_a_value(bars):
    got = running_sum(bars, S, {"total": F.col("x")}).where("k = 'cold'").orderBy("t").toPandas()
    want = got["x"].cumsum()
    pd.testing.assert_series_equal(got["total"], want, check_names=False)


def test_one_exchange_for_a_stack_of_windows(spark, bars):
    out = rolling.rolling_metrics(bars, S, "x", (20, 50, 100))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_technical_columns(bars):
    out = indicators.technical(bars.drop("x"), S)
    assert [c for c in out.columns if c in indicators.TECHNICAL] == list(indicators.TECHNICAL)
    assert indicators.technical(bars.select("k", "t", "close"), S).columns == ["k", "t", "close"]
    assert out.count() == 1060


def test_volume_class_is_the_functions(bars):
    assert volume.VolumeIndicators.compute_vwap_metrics is volume.compute_vwap_metrics


def test_patterns_see_every_row_once(bars):
    a = patterns.candlestick_patterns(bars, S)
    b = bounded(bars, S, 6, lambda d, s: patterns.candlestick_patterns(d, s, [*[c for c in ("k", "t", "_halo", "_rn", "_chunk") if c in d.columns]]), 100, bucket())
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_largest_of_nothing(spark):
    assert series.largest(spark.createDataFrame([], "k string, t long"), S) == 0


def test_kama_forgets_what_lies_before_its_halo():
    """A step far back changes nothing in the rows behind the halo."""
    from seriesmill.operators import recursive

    n = recursive.kama_halo()
    assert n > 45 * (31 / 2) ** 2
    flat = pd.Series([100.0 + 0.01 * (i % 2) for i in range(n + 50)])
    stepped = flat.copy()
    stepped.iloc[:20] = 1000.0
    a, b = recursive.kama(flat), recursive.kama(stepped)
    assert (a - b).iloc[n + 20 :].abs().max() < 1e-12
