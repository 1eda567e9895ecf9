import numpy as np
import pandas as pd
import pytest

from tidemark.operators.indicators import add_indicators, market_regime, relative_strength
from tidemark.operators.series import equal_weight_benchmark, grid


def _frame(df, *cols):
    return df.select("symbol", "bar_ix", *cols).toPandas().sort_values(["symbol", "bar_ix"]).reset_index(drop=True)


def test_smoothed_indicators_follow_pandas_over_a_long_series(make_bars, walk):
    rows = walk(5000)
    close = pd.Series([b[3] for b in rows])
    got = _frame(add_indicators(make_bars({"600000": rows}), {("ema", 2), ("ema", 60), ("rsi", 14), ("macd_dif", 26), ("macd_dea", 26)}), "ema_2", "ema_60", "rsi_14", "macd_dif_26", "macd_dea_26")
    ema = lambda n: close.ewm(span=n, adjust=False).mean()
    np.testing.assert_allclose(got["ema_2"], ema(2), rtol=1e-11)
    np.testing.assert_allclose(got["ema_60"], ema(60), rtol=1e-11)
    delta = close.diff()
    gain = delta.clip(lower=0).ewm(alpha=1 / 14, adjust=False).mean()
    loss = (-delta.clip(upper=0)).ewm(alpha=1 / 14, adjust=False).mean()
    rsi = (100 - 100 / (1 + gain / loss.replace(0, np.nan))).where(loss > 0, np.where(gain > 0, 100.0, 50.0))
    np.testing.assert_allclose(got["rsi_14"], rsi, atol=1e-9)
    dif = ema(12) - ema(26)
    np.testing.assert_allclose(got["macd_dif_26"], dif, atol=1e-9)
    np.testing.assert_allclose(got["macd_dea_26"], dif.ewm(span=9, adjust=False).mean(), atol=1e-9)


def test_rolling_indicators_follow_pandas(make_bars, walk):
    rows = walk(300, seed=2)
    f = pd.DataFrame(rows, columns=["open", "high", "low", "close", "volume"])
    keys = {("sma", 20), ("roc", 5), ("max_high", 20), ("min_low", 20), ("boll_upper", 20), ("volume_ratio", 20), ("lower_close_count", 5), ("volatility", 20), ("simple_rsi", 14)}
    got = _frame(add_indicators(make_bars({"600000": rows}), keys), *[f"{n}_{w}" for n, w in sorted(keys)])
    want = {
        "sma_20": f.close.rolling(20).mean(),
        "roc_5": f.close / f.close.shift(5) - 1,
        "max_high_20": f.high.rolling(20).max(),
        "min_low_20": f.low.rolling(20).min(),
        "boll_upper_20": f.close.rolling(20).mean() + 2 * f.close.rolling(20).std(ddof=0),
        "volume_ratio_20": f.volume / f.volume.rolling(20).mean(),
        "volatility_20": f.close.pct_change().rolling(20).std(),
    }
    for name, series in want.items():
        np.testing.assert_allclose(got[name].astype(float), series, atol=1e-9, err_msg=name)
    down = (f.close < f.close.shift(1)).astype(float)
    np.testing.assert_allclose(got["lower_close_count_5"].astype(float)[5:], down.rolling(4).sum().shift(1)[5:])


def test_a_missing_volume_empties_the_ratio_for_its_window(make_bars):
    rows = [(10, 11, 9, 10, 100.0)] * 4 + [(10, 11, 9, 10, None)] + [(10, 11, 9, 10, 100.0)] * 5
    got = _frame(add_indicators(make_bars({"600000": rows}), {("volume_ratio", 3)}), "volume_ratio_3")
    assert got["volume_ratio_3"].isna().tolist() == [True, True, False, False, True, True, True, False, False, False]


def test_simple_rsi_boundaries(make_bars):
    up = [(10 + i, 11 + i, 9 + i, 10 + i) for i in range(6)]
    flat = [(10, 11, 9, 10)] * 6
    got = _frame(add_indicators(make_bars({"600000": up, "600001": flat}), {("simple_rsi", 3)}), "simple_rsi_3")
    assert got.groupby("symbol")["simple_rsi_3"].last().tolist() == [100.0, 50.0]


def test_regimes_differ_only_at_equality(make_bars):
    bench = equal_weight_benchmark(make_bars({"600000": [(10, 10, 10, 10)] * 5}))
    got = market_regime(bench, 3).orderBy("session").collect()
    assert [r["regime"] for r in got] == ["unknown", "unknown", "bullish", "bullish", "bullish"]
    assert all(r["context"] is None for r in got)


def test_relative_strength_needs_every_benchmark_session(make_bars, walk, spark):
    bars = make_bars({"600000": walk(10)})
    bench = equal_weight_benchmark(bars).where("session <> date'2020-01-05'")
    got = _frame(relative_strength(bars, bench, 3), "relative_strength_3")["relative_strength_3"]
    assert got.notna().tolist() == [False, False, False, True, False, False, False, False, True, True]


def test_grid_fills_the_valuation_only(make_bars):
    bars = make_bars({"600000": [(1, 1, 1, 1), (2, 2, 2, 2), (3, 3, 3, 3)], "600001": [(5, 5, 5, 5)] * 3}).where("not (symbol = '600000' and bar_ix = 1)")
    row = grid(bars).where("symbol = '600000' and session = date'2020-01-02'").first()
    assert row["close"] is None and not row["observed"] and row["valuation_close"] == 1.0


def test_unknown_indicator_is_refused(make_bars):
    with pytest.raises(ValueError):
        add_indicators(make_bars({"600000": [(1, 1, 1, 1)]}), {("nope", 3)})


def test_means_remember_what_lies_many_blocks_back(make_bars, walk):
    rows = walk(600, seed=7)
    last = rows[-1][3]
    rows += [(last, last, last, last, 100)] * 2100
    close = pd.Series([b[3] for b in rows])
    got = _frame(add_indicators(make_bars({"600000": rows}), {("rsi", 14)}), "rsi_14")
    delta = close.diff()
    gain = delta.clip(lower=0).ewm(alpha=1 / 14, adjust=False).mean()
    loss = (-delta.clip(upper=0)).ewm(alpha=1 / 14, adjust=False).mean()
    np.testing.assert_allclose(got["rsi_14"][14:], (100 - 100 / (1 + gain / loss))[14:], atol=1e-6)
