"""Every signal against its rule in pandas, with default and with other parameters."""

import numpy as np
import pandas as pd
import pytest

from quantloom.operators.signals import SIGNALS
from quantloom.operators.stateful import stepped
from quantloom.plans.engine import apply_stages

N = 700


@pytest.fixture(scope="module")
def frames():
    out = {}
    for k, symbol in enumerate("AB"):
        rng = np.random.default_rng(k)
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.015, N) + 0.004 * np.sin(np.arange(N) / 40)))
        opened = close * np.exp(rng.normal(0, 0.012, N))
        high, low = np.maximum(opened, close) * np.exp(rng.exponential(0.006, N)), np.minimum(opened, close) * np.exp(-rng.exponential(0.006, N))
        out[symbol] = pd.DataFrame({"open": opened, "high": high, "low": low, "close": close, "volume": rng.integers(100, 900, N).astype(float)}, index=pd.bdate_range("2015-01-05", periods=N))
    return out


@pytest.fixture(scope="module")
def bars(spark, frames):
    whole = pd.concat([d.rename_axis("ts").reset_index().assign(symbol=s, ts=lambda x: x.ts.dt.date) for s, d in frames.items()])
    return spark.createDataFrame(whole).repartition(4).persist()


def sides(up, down):
    return up.astype(float) - down.astype(float)


def zscore(c, n):
    return (c - c.rolling(n).mean()) / c.rolling(n).std()


def true_range(d):
    before = d.close.shift()
    return pd.concat([d.high - d.low, (d.high - before).abs(), (d.low - before).abs()], axis=1).max(axis=1)


def wilder(x, n):
    return x.ewm(alpha=1 / n, adjust=False).mean()


def ema(x, n):
    return x.ewm(span=n, adjust=False).mean()


def strength(up, down):
    return (100 - 100 / (1 + up / down)).mask(down == 0, 100.0).mask((down == 0) & (up == 0), 50.0)


def moves(c):
    d = c.diff()
    return d.clip(lower=0).fillna(0.0), (-d).clip(lower=0).fillna(0.0)


def direction(d, n):
    up, down = d.high.diff(), -d.low.diff()
    atr = wilder(true_range(d), n)
    plus = 100 * wilder(up.where((up > down) & (up > 0), 0.0), n) / atr
    minus = 100 * wilder(down.where((down > up) & (down > 0), 0.0), n) / atr
    return plus, minus, wilder((100 * (plus - minus).abs() / (plus + minus)).fillna(0.0), n)


def held(x):
    return x.replace(0.0, np.nan).ffill().fillna(0.0)


def sma(d, fast=20, slow=50):
    f, s = d.close.rolling(fast).mean(), d.close.rolling(slow).mean()
    return sides(f > s, f < s)


def momentum(d, lookback=60, skip=5):
    return np.sign(d.close.shift(skip) / d.close.shift(skip + lookback) - 1).fillna(0)


def mean_reversion(d, window=20, k=2.0):
    return (-zscore(d.close, window) / k).clip(-1, 1).fillna(0)


def rsi_mean_reversion(d, window=14, oversold=30, overbought=70):
    rsi = strength(*(x.rolling(window).mean() for x in moves(d.close)))
    return sides(rsi < oversold, rsi > overbought)


def donchian_breakout(d, lookback=20):
    top, floor = (getattr(d.close.shift().rolling(lookback), f)() for f in ("max", "min"))
    return held(sides(d.close > top, d.close < floor))


def bollinger_bands(d, window=20, num_std=2.0):
    z = zscore(d.close, window)
    return sides(z < -num_std, z > num_std)


def macd_crossover(d, fast=12, slow=26, signal=9):
    macd = ema(d.close, fast) - ema(d.close, slow)
    return np.sign((macd - ema(macd, signal)).round(12))


def keltner_channel(d, ma=20, atr=14, multiplier=2.0):
    mid, reach = ema(d.close, ma), multiplier * true_range(d).rolling(atr).mean()
    return sides(d.close > mid + reach, d.close < mid - reach)


def vol_targeted_sma(d, fast=20, slow=50, vol=30, target=0.15):
    scale = (target / (np.log(d.close).diff().rolling(vol).std() * 252**0.5)).clip(upper=1.0).fillna(0.0)
    return sma(d, fast, slow) * scale


def trend_filtered_mean_reversion(d, z=20, threshold=1.5, trend=100):
    score, level = zscore(d.close, z), d.close.rolling(trend).mean()
    return sides((score < -threshold) & (d.close > level), (score > threshold) & (d.close < level))


def triple_ma_alignment(d, fast=10, medium=30, slow=100):
    f, m, s = (d.close.rolling(n).mean() for n in (fast, medium, slow))
    return sides((f > m) & (m > s), (f < m) & (m < s))


def williams_r(d, window=14, oversold=-80, overbought=-20):
    top, floor = d.high.rolling(window).max(), d.low.rolling(window).min()
    r = -100 * (top - d.close) / (top - floor)
    return sides(r < oversold, r > overbought)


def cci(d, window=20, threshold=100):
    tp = (d.high + d.low + d.close) / 3
    mad = tp.rolling(window).apply(lambda x: np.abs(x - x.mean()).mean(), raw=True)
    x = (tp - tp.rolling(window).mean()) / (0.015 * mad)
    return sides(x < -threshold, x > threshold)


def stochastic_oscillator(d, k=14, d_=3, oversold=20, overbought=80):
    top, floor = d.high.rolling(k).max(), d.low.rolling(k).min()
    x = (100 * (d.close - floor) / (top - floor)).rolling(d_).mean()
    return sides(x < oversold, x > overbought)


def trix(d, window=15, signal=9):
    x = ema(ema(ema(d.close, window), window), window).pct_change()
    return np.sign((x - ema(x, signal)).round(15)).fillna(0)


def aroon(d, window=25):
    up = d.high.rolling(window).apply(np.argmax, raw=True)
    down = d.low.rolling(window).apply(np.argmin, raw=True)
    return sides(up > down, up < down)


def chaikin_money_flow(d, window=20, threshold=0.05):
    flow = ((d.close - d.low) - (d.high - d.close)) / (d.high - d.low) * d.volume
    x = flow.rolling(window).sum() / d.volume.rolling(window).sum()
    return sides(x > threshold, x < -threshold)


def vwap_reversion(d, window=20, threshold=0.02):
    vwap = ((d.high + d.low + d.close) / 3 * d.volume).rolling(window).sum() / d.volume.rolling(window).sum()
    x = d.close / vwap - 1
    return sides(x < -threshold, x > threshold)


def adx(d, window=14, threshold=25):
    plus, minus, x = direction(d, window)
    return sides((x > threshold) & (plus > minus), (x > threshold) & (minus > plus))


def connors_rsi(d, window=2, oversold=10, overbought=90):
    rsi = strength(*(wilder(x, window) for x in moves(d.close)))
    return sides(rsi < oversold, rsi > overbought)


def fifty_two_week_high(d, window=252, near_high=0.95, near_low=0.70):
    x = d.close / d.close.rolling(window, min_periods=1).max()
    return sides(x >= near_high, x <= near_low)


def ultimate_oscillator(d, oversold=30, overbought=70):
    before = d.close.shift()
    floor, top = np.fmin(d.low, before), np.fmax(d.high, before)
    x = sum(w * (d.close - floor).rolling(n).sum() / (top - floor).rolling(n).sum() for n, w in ((7, 4), (14, 2), (28, 1))) * 100 / 7
    return sides(x < oversold, x > overbought)


def vol_managed_momentum(d, lookback=60, vol=20, target=0.15):
    scale = (target**2 / (np.log(d.close).diff().rolling(vol).var() * 252)).clip(upper=1.0).fillna(0.0)
    return np.sign(d.close / d.close.shift(lookback) - 1).fillna(0) * scale


def residual_momentum(d, lookback=120, skip=20, mean=60):
    r = d.close.pct_change()
    x = (r - r.rolling(mean).mean()).rolling(lookback).sum().shift(skip)
    return sides(x > 1e-9, x < -1e-9)


def overnight_gap(d, threshold=0.02):
    gap = d.open / d.close.shift() - 1
    return sides(gap < -threshold, gap > threshold)


def donchian_atr_trail(d, entry=20, atr=22, multiplier=3.0):
    top, floor = (getattr(d.close.shift().rolling(entry), f)() for f in ("max", "min"))
    reach = multiplier * true_range(d).rolling(atr).mean()
    stop, cover = d.high.rolling(atr).max() - reach, d.low.rolling(atr).min() + reach
    out, position = [], 0.0
    for row in zip(d.close, top, floor, stop, cover, strict=True):
        position = stepped(position, *row)
        out.append(position)
    return pd.Series(out, d.index)


def squeeze_breakout(d, window=20, bb=2.0, kc=1.5):
    mid, reach, atr = d.close.rolling(window).mean(), bb * d.close.rolling(window).std(), kc * true_range(d).rolling(window).mean()
    out, position = [], 0.0
    for c, m, b, k in zip(d.close, mid, reach, atr, strict=True):
        if np.isnan(m) or np.isnan(b) or np.isnan(k) or b < k:
            position = 0.0
        else:
            position = position or float(np.sign(c - m))
        out.append(position)
    return pd.Series(out, d.index)


def atr_channel_breakout(d, ma=20, atr=14, multiplier=2.0):
    mid, reach = d.close.rolling(ma).mean(), multiplier * wilder(true_range(d), atr)
    return held(sides(d.close > mid + reach, d.close < mid - reach))


def dual_momentum(d, lookback=120, trend=200):
    return ((d.close / d.close.shift(lookback) - 1 > 0) & (d.close > d.close.rolling(trend).mean())).astype(float)


def regime_filtered_trend(d, fast=20, slow=50, window=14, threshold=25):
    return sma(d, fast, slow) * (direction(d, window)[2] > threshold)


def coppock_curve(d, long=14, short=11, wma=10):
    x = d.close / d.close.shift(long) - 1 + d.close / d.close.shift(short) - 1
    weights = np.arange(1, wma + 1)
    return np.sign(x.rolling(wma).apply(lambda v: (v * weights).sum() / weights.sum(), raw=True)).fillna(0)


def true_strength_index(d, long=25, short=13):
    move = d.close.diff()
    return np.sign(ema(ema(move, long), short) / ema(ema(move.abs(), long), short)).fillna(0)


def chande_momentum(d, window=14, threshold=50):
    move = d.close.diff()
    up, down = (move.clip(lower=0)).rolling(window).sum(), (-move).clip(lower=0).rolling(window).sum()
    x = 100 * (up - down) / (up + down)
    return sides(x < -threshold, x > threshold)


def narrow_range_breakout(d, window=7):
    span = d.high - d.low
    narrow = (span == span.rolling(window).min()).shift(fill_value=False)
    return sides(narrow & (d.close > d.high.shift()), narrow & (d.close < d.low.shift()))


OTHER = {
    "sma": {"fast": 3, "slow": 120}, "momentum": {"lookback": 90, "skip": 0}, "mean_reversion": {"window": 80, "k": 1.0}, "bollinger_bands": {"window": 70, "num_std": 1.0}, "donchian_breakout": {"lookback": 5},
    "macd_crossover": {"fast": 2, "slow": 90, "signal": 3}, "keltner_channel": {"ma": 7, "atr": 90, "multiplier": 1.0}, "vol_targeted_sma": {"fast": 5, "slow": 9, "vol": 100, "target": 0.3}, "adx": {"window": 2, "threshold": 40.0},
    "triple_ma_alignment": {"fast": 2, "medium": 5, "slow": 200}, "williams_r": {"window": 100}, "trix": {"window": 3, "signal": 2}, "connors_rsi": {"window": 9, "oversold": 40.0, "overbought": 60.0}, "fifty_two_week_high": {"window": 64, "near_high": 0.99, "near_low": 0.9},
    "residual_momentum": {"lookback": 70, "skip": 3, "mean": 100}, "atr_channel_breakout": {"ma": 100, "atr": 3, "multiplier": 1.0}, "squeeze_breakout": {"window": 10, "bb": 1.5, "kc": 1.2}, "true_strength_index": {"long": 60, "short": 2},
    "donchian_atr_trail": {"entry": 5, "atr": 4, "multiplier": 1.0}, "vol_managed_momentum": {"lookback": 20, "vol": 90, "target": 0.25}, "chaikin_money_flow": {"window": 65}, "narrow_range_breakout": {"window": 3},
}


@pytest.mark.parametrize("name", SIGNALS)
def test_signal_is_its_rule(bars, frames, name):
    rule = globals()[name]
    runs = [{}, OTHER[name]] if name in OTHER else [{}]
    active = 0
    for params in runs:
        got = apply_stages(bars, SIGNALS[name](**params)).select("symbol", "ts", "signal").toPandas().sort_values(["symbol", "ts"])
        for symbol, d in frames.items():
            want = rule(d, **params).to_numpy()
            np.testing.assert_allclose(got[got.symbol == symbol].signal.to_numpy(), want, atol=1e-9, err_msg=f"{symbol} {params}")
            active += (want != 0).sum()
    assert active > 5, "the rule never fires on this fixture"
