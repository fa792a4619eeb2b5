"""Closed forms and pandas counterparts of the operators, with gaps, constants and short inputs."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seriesmill.functions import scalar
from seriesmill.operators import align, events, geometry, indicators, microstructure, patterns, recursive, regimes, rolling, signals, spectral, states, tda, views, volume, windows
from seriesmill.series import Series

S = Series(("k",), ("t",))


def frame(spark, **columns):
    n = len(next(iter(columns.values())))
    kinds = {k: "double" if any(isinstance(x, float) for x in v) or all(x is None for x in v) else "string" if any(isinstance(x, str) for x in v) else "long" for k, v in columns.items()}
    rows = [("a", t, *(v[t] for v in columns.values())) for t in range(n)]
    return spark.createDataFrame(rows, ", ".join(["k string", "t long", *[f"`{k}` {t}" for k, t in kinds.items()]]))


def col(df, name):
    return [r[name] for r in df.orderBy("t").collect()]


def ohlc(spark, n=60, seed=3):
    rng = np.random.default_rng(seed)
    c = 100 + rng.normal(0, 1, n).cumsum()
    o = c + rng.normal(0, 0.5, n)
    h, low = np.maximum(o, c) + 0.4, np.minimum(o, c) - 0.4
    return frame(spark, open=[*map(float, o)], high=[*map(float, h)], low=[*map(float, low)], close=[*map(float, c)], volume=[*map(float, rng.integers(1, 90, n))])


def close_to(got, want, tol=1e-9):
    got = pd.Series(got, dtype=float).to_numpy()
    np.testing.assert_allclose(got, np.asarray(want, float), rtol=tol, atol=tol)


# --- scalars -----------------------------------------------------------------------------------------------


def test_time_forms(spark):
    df = frame(spark, x=["1782777600", "1782777600000", "2026-06-30T00:00:00Z", "2026-06-30T02:00:00+02:00", "soon", None, "nan"])
    assert col(df.select("t", scalar.unix_seconds(F.col("x")).alias("y")), "y") == [1782777600] * 4 + [None] * 3
    df = frame(spark, x=["15m", "2h", "1d", "x", "", None])
    assert col(df.select("t", scalar.timeframe_seconds(F.col("x")).alias("y")), "y") == [900, 7200, 86400, 60, 60, 60]


def test_numbers(spark):
    df = frame(spark, x=["1.5", " 2 ", "nan", "inf", "-inf", "x", None])
    assert col(df.select("t", scalar.number("x").alias("y")), "y") == [1.5, 2.0, None, None, None, None, None]


def test_entropy(spark):
    df = spark.createDataFrame([(0, [1.0, 1.0, 2.0, 2.0]), (1, [3.0, 3.0]), (2, None), (3, [0.0, 0.5, 1.0])], "t long, x array<double>")
    got = col(df.select("t", scalar.entropy(F.col("x"), 2).alias("y")), "y")
    assert got[1] == 0.0 and got[2] is None
    close_to([got[0], got[3]], [np.log(2), -(1 / 3 * np.log(1 / 3) + 2 / 3 * np.log(2 / 3))])


# --- rolling -----------------------------------------------------------------------------------------------


def test_rolling_against_pandas(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(50, 10, 90)
    v = [None if i in (7, 8, 40) else float(a) for i, a in enumerate(x)]
    p = pd.Series(v, dtype=float)
    got = rolling.rolling_metrics(frame(spark, x=v), S, "x", (20,)).orderBy("t").toPandas()
    r = p.rolling(20)
    want = {"rolling_mean": r.mean(), "rolling_std": r.std(), "rolling_skewness": r.skew(), "rolling_kurtosis": r.kurt(), "rolling_quantile_25": r.quantile(0.25), "rolling_iqr": r.quantile(0.75) - r.quantile(0.25), "rolling_drawdown": p / r.max() - 1, "rolling_zscore": (p - r.mean()) / r.std(), "rolling_autocorr": r.corr(p.shift())}
    for k, w in want.items():
        close_to(got[f"x__{k}_20"], w, 1e-8)
    assert got["x__rolling_beta_20"].dropna().round(9).eq(1).all()


def test_constant_window(spark):
    got = rolling.rolling_metrics(frame(spark, x=[4.0] * 25), S, "x", (20,)).orderBy("t").toPandas().iloc[-1]
    assert got["x__rolling_skewness_20"] == 0 and got["x__rolling_kurtosis_20"] == -3 and got["x__rolling_std_20"] == 0 and pd.isna(got["x__rolling_zscore_20"]) and got["x__rolling_entropy_20"] == 0


def test_min_periods_and_gaps(spark):
    df = frame(spark, x=[1.0, 2.0, None, 4.0, 5.0])
    assert col(rolling.compute_rolling(df, S, "x", "mean", 3, 2, name="y"), "y") == [None, 1.5, 1.5, 3.0, 4.5]
    assert col(rolling.compute_rolling(frame(spark, x=[10.0, 12.0, 9.0, 11.0, 8.0]), S, "x", "drawdown", 5, 1, name="y"), "y") == pytest.approx([0, 0, 9 / 12 - 1, 11 / 12 - 1, 8 / 12 - 1])
    with pytest.raises(ValueError):
        rolling.compute_rolling(df, S, "x", "mode", 3)


def test_returns_guard(spark):
    df = rolling.safe_returns(frame(spark, x=[1.0, 0.0, 2.0, -1.0, 3.0]), S, "x", "log")
    assert col(df, "returns") == [None] * 5
    assert col(rolling.safe_returns(frame(spark, x=[1.0, 2.0, 0.0, 5.0]), S, "x"), "returns") == [None, 1.0, -1.0, None]


def test_invariants_contract(spark):
    df = frame(spark, x=[10.0] * 30 + [1000.0] + [10.0] * 29)
    got = rolling.invariants(df, S, "x", 20).orderBy("t").toPandas()
    assert got["x_zscore"][:19].isna().all() and np.isfinite(got["x_robust_zscore"][30]) and abs(got["x_robust_zscore"][30]) <= abs(got["x_zscore"][30])
    got = rolling.invariants(frame(spark, x=[100.0, 110.0, 121.0, 0.0]), S, "x", 2).orderBy("t").toPandas()
    close_to(got["x_relative_change"][:3], [np.nan, 0.1, 0.1])
    assert got["x_minmax_position"][1:].between(0, 1).all() and np.isfinite(got["x_log_ratio"][1:]).all()
    out = rolling.add_invariant_features(frame(spark, x=[1.0, 2.0], s=["a", "b"]), S, ["x", "s", "none"], 2)
    assert [c for c in out.columns if c.startswith("inv_")] == [f"inv_x_{k}" for k in rolling.INVARIANTS]


def test_dynamics_contract(spark):
    t = [float(i * i) for i in range(8)]
    got = rolling.dynamics(frame(spark, x=t), S, "x").orderBy("t").toPandas()
    assert got["acceleration"][2:].eq(2).all() and got["acceleration"][:2].isna().all() and got["jerk"][3:].eq(0).all() and got["jerk"][:3].isna().all()
    got = rolling.dynamics(frame(spark, x=[float(i) for i in range(8)]), S, "x", 2).orderBy("t").toPandas()
    assert got["velocity"][2:].eq(2).all()


def test_summary_edges(spark):
    df = spark.createDataFrame([("one", 0, 3.0), ("none", 0, None), ("two", 0, 1.0), ("two", 1, 5.0)], "k string, t long, x double")
    got = {r["k"]: r for r in rolling.summarize_series(df, ["k"], "x", ("t",)).collect()}
    assert got["one"]["std"] == 0 and got["one"]["zscore"] == 0 and got["none"]["mean"] is None and got["none"]["count"] == 0
    assert got["two"]["last"] == 5 and got["two"]["skewness"] == 0
    f = rolling.summarize_frame(frame(spark, x=[1.0, 2.0, 3.0, 4.0]), ["k"], ["x"], ("t",), "sec_").first()
    assert (f["sec_x_mean"], f["sec_x_min"], f["sec_x_max"], f["sec_x_first"], f["sec_x_last"], f["sec_x_delta"], f["sec_x_median"]) == (2.5, 1, 4, 1, 4, 3, 2.5)


# --- recursive ---------------------------------------------------------------------------------------------


def test_ema_with_gap(spark):
    close_to(col(recursive.compute_ema(frame(spark, x=[1.0, 2.0, None, 4.0]), S, "x", 3), "ema_3"), [1, 1.5, 1.5, 3.1666666666666665])


def test_ema_last_is_the_last_ema(spark):
    df = ohlc(spark, 200)
    close_to([recursive.ema_last(df, ["k"], ("t",), "close", 10).first()["ema_10"]], [col(recursive.compute_ema(df, S, "close", 10), "ema_10")[-1]], 1e-12)


def test_first_rows_of_wilder_averages(spark):
    got = recursive.recursive_indicators(ohlc(spark), S).orderBy("t").toPandas()
    first = {c: got[c].first_valid_index() for c in ("atr_14", "rsi_14", "adx_14", "ema_20", "plus_di_14")}
    assert first == {"atr_14": 13, "rsi_14": 14, "adx_14": 26, "ema_20": 0, "plus_di_14": 13}


def test_rsi_without_losses_is_null(spark):
    assert set(col(recursive.compute_rsi(frame(spark, close=[float(i) for i in range(30)]), S), "rsi_14")) == {None}


def test_kama_kalman_names(spark):
    df = ohlc(spark, 30)
    assert "kama_3_2_5" in recursive.compute_kama(df, S, "close", 3, 2, 5).columns
    assert "kalman_1d" in recursive.kalman_filter_1d(df, S, "close").columns
    assert recursive.kalman_filter_ohlc(df, S).columns == df.columns
    with pytest.raises(ValueError, match="must not be empty"):
        recursive.kalman_filter_1d(df.limit(0), S, "close")
    flat = recursive.kalman_filter_1d(frame(spark, x=[5.0] * 20), S, "x", True).orderBy("t").toPandas()
    close_to(flat["estimate"], [5] * 20)
    close_to(flat["velocity"], [0] * 20)


def test_threshold_order(spark):
    df = ohlc(spark, 5)
    with pytest.raises(ValueError):
        recursive.compute_rsi_tsi_regime(df, S, rsi_low=80, rsi_high=20)
    with pytest.raises(ValueError):
        recursive.compute_trend_helper_signal(df, S, adx_threshold=-1)
    with pytest.raises(ValueError, match="high_on"):
        tda.wasserstein_regime_signal(df, S, "close", high_on=70, high_off=80)
    with pytest.raises(ValueError, match="low_off"):
        tda.wasserstein_regime_signal(df, S, "close", low_on=30, low_off=20)
    with pytest.raises(ValueError, match="p must be > 0"):
        tda.rolling_wasserstein_profile(df, S, "close", 2, 0)


def test_moving_averages(spark):
    df = frame(spark, x=[1.0, 2.0, 3.0, 4.0, 5.0])
    assert col(indicators.compute_sma(df, S, "x", 3), "sma_3")[-1] == 4
    close_to(col(indicators.compute_wma(df, S, "x", 3), "wma_3")[2:], [(1 + 4 + 9) / 6, (2 + 6 + 12) / 6, (3 + 8 + 15) / 6])
    two = frame(spark, open=[1.0, 1.0], high=[12.0, 13.0], low=[9.0, 10.0], close=[11.0, 12.0])
    assert col(indicators.ohlc_to_series(two), "weighted_close") == [10.75, 11.75]


# --- geometry, states, signals -----------------------------------------------------------------------------


def test_geometry(spark):
    df = frame(spark, open=[100.0, 100.0, 100.0], high=[110.0, 100.0, 145.0], low=[90.0, 100.0, 100.0], close=[108.0, 100.0, 100.0])
    got = geometry.add_ohlc_geometry_features(df, S).orderBy("t").toPandas()
    assert set(geometry.GEOMETRY) <= set(got.columns)
    assert got["body_ratio"].tolist() == [0.4, 0, 0] and got["direction_state"].tolist() == ["up", "neutral", "neutral"]
    assert got["rejection_state"].tolist()[2] == "upper_rejection" and got["is_doji"].tolist() == [False, True, True]
    with pytest.raises(ValueError, match="Missing required columns"):
        geometry.compute_ohlc_geometry(df.drop("open"), S)


def test_states(spark):
    for x, want in (([float(i) for i in range(30)], "rising"), ([float(-i) for i in range(30)], "falling"), ([10.0] * 30, "flat")):
        assert col(states.compute_slope_state(frame(spark, x=x), S, "x", 5), "slope_state")[-1] == want
    atr = frame(spark, atr=[10.0] * 20 + [2.0] * 20 + [25.0] * 20)
    assert {"compression", "expansion"} <= set(col(states.compute_volatility_state(atr, S, window=10), "volatility_state"))
    base = ohlc(spark, 30)
    got = states.compute_momentum_state(base, S, ("nope",)).select("momentum_state", "momentum_confidence").distinct().collect()
    assert [tuple(r) for r in got] == [("neutral", 0.0)]
    got = states.compute_activity_state(base, S, ("nope",)).select("activity_state", "activity_confidence").distinct().collect()
    assert [tuple(r) for r in got] == [("normal", 0.0)]
    flat = states.compute_trend_state(frame(spark, close=[5.0] * 20), S)
    assert col(flat, "trend_state")[-1] == "sideways"
    geo = frame(spark, body_ratio=[0.7, 0.05], upper_wick_ratio=[0.1, 0.5], lower_wick_ratio=[0.1, 0.6], body_direction=[1.0, 0.0])
    assert col(states.compute_structure_state(geo, S), "structure_state") == ["strong_up", "indecision"]


def test_signals(spark):
    df = frame(spark, sig=[0.0, 1.0, 1.0, 0.0, 1.0])
    assert col(signals.detectar_compra(df, S, "sig"), "compra") == [0, 1, 0, 0, 1] and col(signals.detectar_venta(df, S, "sig"), "venta") == [0, -1, 0, 0, -1]
    vol = frame(spark, volume=[100.0] * 500 + [300.0, 310.0, 320.0, 330.0, 340.0])
    assert signals.high_volume(vol, S).first()["high_volume"] == 1
    up = frame(spark, close=[100.0], atr=[2.0], adx=[30.0], plus_di=[35.0], minus_di=[20.0])
    r = signals.stop_loss_take_profit(up, S).first()
    assert r["sl"] < 100 < r["tp"]
    r = signals.stop_loss_take_profit(up.withColumn("plus_di", F.lit(10.0)), S).first()
    assert r["tp"] < 100 < r["sl"]
    with pytest.raises(ValueError, match="ATR"):
        signals.stop_loss_take_profit(up.withColumn("atr", F.lit(0.0)), S)
    t = signals.block_trends(frame(spark, open=[10.0, 10.2], close=[10.1, 11.0]), ["k"], "t", 2)
    assert t.first()["trend"] == "alcista"
    s = signals.weighted_trend_score(signals.block_trends(ohlc(spark, 20), ["k"], "t", 2), ["k"])
    assert all(-1 <= r["trend_score"] <= 1 for r in s.collect())
    assert "trend_profile_2" in signals.compute_block_trend_profile(ohlc(spark, 6), ["k"], "t", 2).columns


def test_volume_columns(spark):
    df = ohlc(spark, 12).withColumns({"buy_volume": F.col("volume") * 0.6, "sell_volume": F.col("volume") * 0.4})
    out = volume.add_volume_features(df, S, 3, 3, 3, 3)
    want = {"vol_sma_3", "vol_ema_3", "rvol_3", "vol_zscore_3", "obv", "typical_price", "vwap", "rolling_vwap_3", "close_vwap_dist", "mfi_3", "cmf_3", "volume_delta", "volume_imbalance", "cvd", "breakout_volume_score"}
    assert want <= set(out.columns)


# --- regimes, books, patterns ------------------------------------------------------------------------------


def test_label_priority(spark):
    rows = [(-3.5, 1.0, -0.5, "extreme_negative_outlier"), (3.0, 1.0, 0.0, "extreme_positive_outlier"), (-2.0, 0.0, -0.2, "negative_outlier"), (2.5, 9.0, 0.0, "positive_outlier"), (0.0, 9.0, -0.1, "drawdown_pressure"), (0.0, 0.1, 0.0, "low_volatility_compression"), (0.0, 9.0, 0.0, "high_volatility"), (None, None, None, "normal")]
    df = spark.createDataFrame(rows, "z double, v double, d double, want string")
    got = df.select("want", regimes.label(F.col("z"), F.col("v"), F.col("d"), F.lit(0.5), F.lit(2.0)).alias("got")).collect()
    assert all(r["want"] == r["got"] for r in got)
    assert "stat_regime" in regimes.classify_statistical_regime(ohlc(spark, 30), S, "close").columns


def test_flags_of_a_block_without_statistics(spark):
    df = spark.createDataFrame([("b", 0, None, "normal", None, None)], "block string, ordinal int, zscore double, regime string, skewness double, kurtosis double")
    r = regimes.regime_flags(df, ["block"]).first()
    assert r["mean_reversion_zone"] and not r["trend_expansion"] and not r["outlier_positive"]


def test_book_and_flow_edges(spark):
    lv = spark.createDataFrame([("x", "bid", 99.0, 2.0, 198.0), ("x", "ask", 101.0, 1.0, 101.0), ("one", "bid", 5.0, 1.0, 5.0)], "b string, side string, price double, quantity double, notional double")
    r = microstructure.orderbook_metrics(lv, ["b"]).collect()
    assert [x["b"] for x in r] == ["x"] and r[0]["spread"] == 2 and r[0]["weighted_mid_price"] == pytest.approx((99 * 1 + 101 * 2) / 3)
    ev = spark.createDataFrame([("x", "bid", "10", "2", "20"), ("x", "sell", "bad", "1", None), ("y", "other", "1", "1", "1")], "b string, side string, price string, quantity string, notional string")
    got = {x["b"]: x for x in microstructure.event_flow_metrics(ev, ["b"]).collect()}
    assert got["x"]["buy_vwap"] == 10 and got["x"]["sell_vwap"] is None and got["x"]["flow_imbalance"] == 1 and got["y"]["flow_imbalance"] is None and got["y"]["total_count"] == 1


def test_outlier_events(spark):
    rows = [("b", "m", t, 1.0 + t % 3 * 0.01) for t in range(200)] + [("b", "m", 500, 90.0), ("b", "flat", 0, 1.0), ("b", "flat", 1, 1.0)]
    df = spark.createDataFrame(rows, "b string, metric string, t long, value double")
    r = events.extract_events(df, ["b"], ("t",)).collect()
    assert len(r) == 1 and r[0]["severity"] == "high" and r[0]["event_type"] == "outlier_positive" and r[0]["reason"].startswith("zscore >= ")


def test_candle_rules(spark):
    doji = frame(spark, open=[10.0], high=[11.0], low=[9.0], close=[10.05])
    assert {r["name"] for r in patterns.candlestick_patterns(doji, S).collect()} >= {"doji"}
    flat = frame(spark, open=[100.0], high=[100.0], low=[100.0], close=[100.0])
    assert "doji" in {r["name"] for r in patterns.candlestick_patterns(flat, S).collect()}
    eng = frame(spark, open=[10.0, 8.5], high=[10.5, 11.0], low=[8.8, 8.4], close=[9.0, 10.6])
    assert "bullish_engulfing" in {r["name"] for r in patterns.candlestick_patterns(eng, S).where("t = 1").collect()}
    out = patterns.compute_candlestick_patterns(eng, S)
    assert {"candle_class", "doji", "hammer", "bullish_engulfing", "bearish_engulfing"} <= set(out.columns) and out.count() == 2


def test_head_and_shoulders(spark):
    top = [10, 14, 18, 20, 17, 14, 12, 16, 22, 26, 21, 16, 13, 15, 18, 20.5, 17, 13, 9, 7]
    df = frame(spark, open=[float(x) for x in top], high=[x + 0.5 for x in top], low=[x - 0.5 for x in top], close=[float(x) for x in top])
    r = patterns.head_and_shoulders(patterns.swing_points(df, S), S).collect()
    assert [x["name"] for x in r] == ["head_and_shoulders"]


def test_first_rule_of_a_name_counts(spark):
    df = frame(spark, miner_ratio=[1.6], miner_netflow_btc=[-1.0], miner_inflow_btc=[1.0], miner_outflow_btc=[2.0])
    names = [r["name"] for r in patterns.mining_patterns(df, S).collect()]
    assert sorted(names) == ["miner_distribution", "miner_pressure_high", "network_stress"]


# --- windows, channels, spectra ----------------------------------------------------------------------------


@pytest.mark.parametrize(("n", "size", "step"), [(40, 10, 5), (40, 10, 15), (9, 10, 5), (10, 10, 10)])
def test_window_counts(spark, n, size, step):
    df = frame(spark, x=[float(i) for i in range(n)])
    got = windows.window_rows(df, S, size, step).groupBy("window_id").agg(F.count("*").alias("c"), F.min("t").alias("lo")).collect()
    assert sorted((r["window_id"], r["c"], r["lo"]) for r in got) == [(w, size, w * step) for w in range(windows.window_count(n, size, step))]
    with pytest.raises(ValueError):
        windows.window_rows(df, S, 0)


def test_feature_matrix(spark):
    X = windows.build_feature_matrix(ohlc(spark, 40), S, 10, 5)
    assert X.count() == 7 and any(c.startswith("variable_action__") for c in X.columns) and any(c.startswith("volume_flow__volume_") for c in X.columns)
    assert not any(c.startswith("technical_indicators") for c in X.columns)
    w = windows.build_window(ohlc(spark, 40), S, 10, 5)
    assert set(windows.SECTIONS) <= set(w.columns) and w.first()["tda_features"] is None
    flat = windows.flatten_window(w, list(windows.SECTIONS))
    assert "variable_action__range_mean" in flat.columns and not any(c.startswith("window_meta") for c in flat.columns)
    with pytest.raises(ValueError):
        windows.extract_window(frame(spark, x=[1.0]), S, 0, 1)
    assert windows.extract_window(ohlc(spark, 40), S, 5, 25).count() == 20


def test_fill(spark):
    df = frame(spark, a=[1.0, None, 3.0], b=[None, 2.0, None])
    assert col(windows.fill_feature_matrix(df, S, ["a", "b"], "ffill"), "b") == [2, 2, 2]
    assert col(windows.fill_feature_matrix(df, S, ["a", "b"], "zero"), "a") == [1, 0, 3]
    assert col(windows.fill_feature_matrix(df, S, ["a", "b"], "median"), "a") == [1, 2, 3]
    assert col(windows.fill_feature_matrix(df, S, method=None), "a") == [1, None, 3]
    with pytest.raises(ValueError):
        windows.fill_feature_matrix(df, S, ["a"], "mean")
    r = windows.pipeline_report(df.withColumn("c", F.lit(1.0))).first()
    assert r["n_rows"] == 3 and r["constant_columns"] == ["b", "c"] and r["non_numeric_columns"] == ["k"]


def test_channels(spark):
    ref = spark.createDataFrame([(t, float(t)) for t in range(10)], "ts long, close double")
    sparse = spark.createDataFrame([(t, float(t * 10)) for t in range(0, 10, 2)], "ts long, value double")
    m = align.merge_channels({"ref": ref, "sparse": sparse}, "ref", [], method="ffill").orderBy("ts").collect()
    assert [r["sparse_value"] for r in m] == [0, 0, 20, 20, 40, 40, 60, 60, 80, 80]
    d = {r["channel"]: r for r in align.diagnose_alignment({"ref": ref, "sparse": sparse}, "ref", []).collect()}
    assert d["ref"]["coverage_ratio"] == 1 and d["sparse"]["coverage_ratio"] == 0.5 and d["sparse"]["n_samples"] == 5
    assert align.compute_coverage_ratio(sparse, ref.limit(0), []).first()["coverage_ratio"] == 0
    assert align.align_channels({"ref": ref, "sparse": sparse}, "ref", [])["sparse"].count() == 10
    for bad in ({}, {"x": ref}):
        with pytest.raises(ValueError):
            align.merge_channels(bad, "ref", [])


def test_spectra(spark):
    x = [float(np.sin(2 * np.pi * 4 * i / 32)) for i in range(64)]
    got = spectral.compute_fft_magnitude(frame(spark, x=x), S, "x", 32.0, 32).toPandas()
    assert len(got) == 2 * 17 and set(got.sort_values("magnitude").tail(2)["freq"]) == {4.0}
    r = spectral.regressor(frame(spark, close=[float(3 + 2 * i - 0.1 * i * i) for i in range(50)]), S).orderBy("t").toPandas()
    close_to(r["y_pred"], [3 + 2 * i - 0.1 * i * i for i in range(50)], 1e-6)
    assert set(r["degree"]) == {2}


def test_persistence(spark):
    bars = spark.createDataFrame([("a", 0.0, 1.0), ("a", 0.0, 2.0), ("a", 0.0, 3.0), ("inf", 0.0, float("inf"))], "k string, birth double, death double")
    got = {r["k"]: r["entropy"] for r in tda.persistence_entropy(bars, ["k"]).collect()}
    p = np.array([1, 2, 3]) / 6
    assert got["inf"] == 0 and got["a"] == pytest.approx(-(p * np.log(p)).sum())
    pts = np.random.default_rng(0).random((10, 2))
    d = tda.compute_persistence_diagram(pts, 1)
    assert d[0].shape == (10, 2) and len(d) == 2 and isinstance(tda.has_ripser(), bool)
    with pytest.raises(ValueError):
        tda.compute_persistence_diagram(np.zeros(3))
    out = tda.rolling_persistence_profile(ohlc(spark, 50), S, "close", 10, span=20).toPandas()["persistence"]
    assert out.between(0, 100.0000001).all() and (out[:9] == 0).all()
    with pytest.raises(ValueError):
        tda.rolling_persistence_profile(ohlc(spark, 5), S, "close", 2, embed_dim=3)


def test_loops(spark):
    t = np.linspace(0, 2 * np.pi, 12, endpoint=False)
    circle = np.c_[np.cos(t), np.sin(t)]
    np.testing.assert_allclose(tda.loops(circle), [[2 * np.sin(np.pi / 12), np.sqrt(3)]])
    two = np.r_[circle, circle + [10, 0]]
    assert len(tda.loops(two)) == 2 and len(tda.loops(circle[:3])) == len(tda.loops(np.zeros((5, 2)))) == 0
    np.testing.assert_allclose(tda.compute_persistence_diagram([[0, 0], [1, 0], [1, 1], [0, 1]], 1)[1], [[1, np.sqrt(2)]])
    with pytest.raises(ValueError, match="max_dim"):
        tda.compute_persistence_diagram(circle, 2)
    with pytest.raises(ValueError, match="max_dim"):
        tda.rolling_persistence_profile(ohlc(spark, 5), S, "close", 4, max_dim=-1)
    x = np.array(col(ohlc(spark, 20), "close"))
    got = col(tda.rolling_persistence_profile(ohlc(spark, 20), S, "close", 8, normalize_to_100=False, max_dim=1), "persistence")
    clouds = [np.c_[x[k : k + 7], x[k + 1 : k + 8]] for k in range(13)]
    np.testing.assert_allclose(got[7:], [tda.spanning_edges(c).sum() + sum(d - b for b, d in tda.loops(c)) for c in clouds])


def test_persistence_against_brute_force(spark):
    x = np.array(col(ohlc(spark, 30), "close"))
    got = col(tda.rolling_persistence_profile(ohlc(spark, 30), S, "close", 8, normalize_to_100=False), "persistence")
    w = x[-8:]
    pts = np.stack([w[:7], w[1:]], 1)
    left, total = {*range(1, 7)}, 0.0
    inside = {0}
    while left:
        d, j = min((float(np.linalg.norm(pts[i] - pts[j])), j) for i in inside for j in left)
        total += d
        inside.add(j)
        left.remove(j)
    assert got[-1] == pytest.approx(total)


def test_views(spark):
    flat = views.time_series_to_bars(frame(spark, value=[1.0, 2.0]))
    assert flat.columns == ["k", "t", "open", "high", "low", "close", "volume"] and col(flat, "close") == [1, 2]
    assert views.time_series_to_bars(spark.createDataFrame([("a",)], "k string")).count() == 0
    assert views.reference_column(frame(spark, foo=[1.0], close=[2.0])) == "close"
    w = views.series_to_ohlc_windows(frame(spark, x=[3.0, 1.0, 4.0, 1.5]), S, "x", 2, 2).orderBy("window_id").collect()
    assert [(r["open"], r["high"], r["low"], r["close"], r["start_idx"], r["end_idx"]) for r in w] == [(3, 3, 1, 1, 0, 1), (4, 4, 1.5, 1.5, 2, 3)]
