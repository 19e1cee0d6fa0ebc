"""Factors, weights, portfolios, information coefficients and the backtest's aggregates against their rules in pandas."""

from dataclasses import replace

import numpy as np
import pandas as pd
import pytest

from quantloom.operators import factors, kernel
from quantloom.plans.engine import Base, Query

N, NAMES = 620, list("ABCDEFG")
DAYS = pd.bdate_range("2015-01-05", periods=N)


@pytest.fixture(scope="module")
def prices():
    rng = np.random.default_rng(8)
    return pd.DataFrame({s: 100 * np.exp(np.cumsum(rng.normal(0.0002 * k, 0.01 + 0.002 * k, N))) for k, s in enumerate(NAMES)}, index=DAYS)


@pytest.fixture(scope="module")
def panel(spark, prices):
    long = prices.rename_axis("ts").reset_index().melt("ts", var_name="symbol", value_name="close").assign(ts=lambda d: d.ts.dt.date, volume=1.0)
    frame = spark.createDataFrame(long).repartition(4).persist()
    return Base(lambda *_: frame, "")


def wide(query, value):
    got = query(None, "") if not isinstance(query, Query) else query(query.base.frame(None, "").sparkSession, "")
    d = got.toPandas()
    return d.pivot(index="ts", columns="symbol", values=value).astype(float).set_axis(DAYS)


def z(x):
    return x.sub(x.mean(axis=1), axis=0).div(x.std(axis=1), axis=0)


def ranked(x):
    return x.rank(axis=1, pct=True)


def momentum(p, lookback=126, skip=21):
    return p.shift(skip) / p.shift(skip + lookback) - 1


def residual(p):
    r = p.pct_change()
    return (r - r.rolling(60).mean()).rolling(126).sum().shift(21)


def composite(p):
    parts = np.stack([z(x).to_numpy() for x in (momentum(p), -(p / p.shift(5) - 1), -p.pct_change().rolling(63).std(), p / p.rolling(252).max())])
    known = (~np.isnan(parts)).sum(0)
    return pd.DataFrame(np.where(known > 0, np.nansum(parts, axis=0) / np.maximum(known, 1), np.nan), p.index, p.columns)


def alpha34(p):
    r = p.pct_change()
    return 2 - ranked((r.rolling(2).std() / r.rolling(5).std()).round(9)) - ranked(p.diff())


def alpha19(p):
    return -np.sign(p.diff(7)) * (1 + ranked((1 + p.pct_change().rolling(250).sum()).round(9)))


RULES = {
    "xs_momentum": momentum, "xs_reversal": lambda p: -(p / p.shift(5) - 1), "xs_low_volatility": lambda p: -p.pct_change().rolling(63).std(),
    "xs_short_term_reversal_1m": lambda p: -(p / p.shift(21) - 1), "xs_52w_high": lambda p: p / p.rolling(252).max(), "xs_residual_momentum": residual,
    "xs_risk_adjusted_momentum": lambda p: p.pct_change().rolling(126).mean() / p.pct_change().rolling(126).std(), "xs_composite": composite, "xs_alpha34": alpha34, "xs_alpha19": alpha19,
}


@pytest.mark.parametrize("name", factors.FACTORS)
def test_factor_is_its_rule(panel, prices, name):
    got = wide(Query(panel, factors.FACTORS[name], "SELECT symbol, ts, score FROM {t}"), "score")
    want = RULES[name](prices)
    assert want.notna().any().all()
    np.testing.assert_allclose(got.to_numpy(), want.to_numpy(), atol=1e-8)


def weighted(score, quantile=0.2):
    out = pd.DataFrame(0.0, score.index, score.columns)
    for day, row in score.iterrows():
        known = row.dropna().sort_values()
        if len(known) >= 2:
            k = max(1, int(quantile * len(known)))
            out.loc[day, known.index[-k:]], out.loc[day, known.index[:k]] = 1 / k, -1 / k
    return out


@pytest.mark.parametrize("quantile", [0.2, 0.45])
def test_portfolio_of_a_factor(spark, panel, prices, quantile):
    want = weighted(momentum(prices), quantile)
    got = wide(Query(panel, [*factors.momentum(), *factors.weights(quantile)], "SELECT symbol, ts, w FROM {t}"), "w")
    np.testing.assert_allclose(got.to_numpy(), want.to_numpy())
    if quantile == 0.2:
        rows = replace(factors.declared()["xs_portfolio"], base=panel)(spark, "").toPandas().sort_values("ts")
        r, before = prices.pct_change().fillna(0.0), want.shift(fill_value=0.0)
        net = (before * r).sum(axis=1) - (want - before).abs().sum(axis=1) * 0.001
        np.testing.assert_allclose(rows.net, net, atol=1e-6)
        np.testing.assert_allclose(rows.benchmark, r.mean(axis=1), atol=1e-6)


def test_information_coefficients(spark, panel, prices):
    score, ahead = -(prices / prices.shift(5) - 1), prices.shift(-1) / prices - 1
    both = score.notna() & ahead.notna()
    ic = ranked(score.where(both)).corrwith(ranked(ahead.where(both)), axis=1).dropna()
    declared = factors.declared()
    rows = replace(declared["rank_ic"], base=panel)(spark, "").toPandas().sort_values("ts")
    np.testing.assert_allclose(rows.ic, ic, atol=1e-6)
    one = replace(declared["ic_summary"], base=panel)(spark, "").first()
    want = (len(ic), ic.mean(), ic.std(), ic.mean() / ic.std(), ic.mean() / ic.std() * len(ic) ** 0.5, (ic > 1e-9).mean())
    np.testing.assert_allclose((one.n, one.mean_ic, one.std_ic, one.ir, one.t_stat, one.hit_rate), want, atol=2e-6)


def test_panel_keeps_long_symbols_on_common_dates(spark, panel, prices):
    frame = panel.frame(spark, "")
    gappy = frame.where("NOT (symbol = 'B' AND dayofmonth(ts) = 3) AND NOT (symbol = 'C' AND ts > DATE '2015-06-01')").withColumn("close", frame.close)
    kept = replace(factors._LONG.frame.__self__, base=Base(lambda *_: gappy, ""))
    panel_query = replace(factors.PANEL.frame.__self__, base=Base(kept.__call__, ""))
    rows = panel_query(spark, "").toPandas()
    dates = DAYS[(DAYS.day != 3)]
    assert set(rows.symbol) == set(NAMES) - {"C"} and set(pd.to_datetime(rows.ts)) == set(dates) and len(rows) == 6 * len(dates)


@pytest.fixture(scope="module")
def book(prices):
    rng = np.random.default_rng(5)
    signal = pd.DataFrame(rng.choice([-2.0, -0.5, 0.0, 0.5, 1.0], (N, 2), p=[0.1, 0.2, 0.3, 0.2, 0.2]), DAYS, ["A", "B"])
    signal[DAYS.day % 7 == 0] = np.nan
    pos = signal.clip(-1, 1).fillna(0.0)
    ret = prices[["A", "B"]].pct_change().fillna(0.0)
    turn = pos.diff().abs().fillna(pos.abs())
    net = pos.shift(fill_value=0.0) * ret - turn * 0.001
    return signal, pos, turn, net


@pytest.fixture(scope="module")
def backtest(spark, panel, book):
    signal = book[0]
    long = signal.rename_axis("ts").reset_index().melt("ts", var_name="symbol", value_name="signal").assign(ts=lambda d: d.ts.dt.date)
    rows = panel.frame(spark, "").join(spark.createDataFrame(long.astype(object).where(long.notna(), None), "ts date, symbol string, signal double"), ["symbol", "ts"]).persist()
    return Query(Base(lambda *_: rows, ""), kernel.backtest(), "SELECT symbol, ts, close, ret, pos, turn, gross, net, equity, peak FROM {t}").as_base()


def test_backtest_metrics(spark, backtest, book):
    _, _, turn, net = book
    rows = Query(backtest, [], f"SELECT symbol, {kernel.METRICS} FROM {{t}} GROUP BY symbol")(spark, "").collect()
    for r in rows:
        x = net[r.symbol]
        equity = 100_000 * (1 + x).cumprod()
        want = (N, x.mean() / x.std() * 252**0.5, x.mean() * 252, x.std() * 252**0.5, (equity / equity.cummax() - 1).min(), equity.iloc[-1] / equity.iloc[0] - 1, (turn[r.symbol] > 0).sum())
        np.testing.assert_allclose((r.n_bars, r.sharpe, r.ann_return, r.ann_vol, r.max_drawdown, r.total_return, r.n_trades), want, atol=2e-6)


def test_backtest_curves_and_markers(spark, backtest, book):
    _, pos, _, net = book
    declared = kernel.declared()
    run = lambda name: replace(declared[name], base=backtest)(spark, "").toPandas()
    rolling, moments, markers, drawdown = (run(n) for n in ("rolling_sharpe", "return_moments", "trade_markers", "drawdown_curve"))
    for symbol in "AB":
        x = net[symbol]
        want = (x.rolling(60).mean() / x.rolling(60).std() * 252**0.5).fillna(0.0)
        np.testing.assert_allclose(rolling[rolling.symbol == symbol].sort_values("ts").rolling_sharpe, want, atol=2e-5)
        m = moments[moments.symbol == symbol].iloc[0]
        np.testing.assert_allclose((m["n"], m["skew"], m["kurtosis"]), (N, x.skew(), x.kurt() + 3), atol=2e-6)
        equity = (1 + x).cumprod()
        np.testing.assert_allclose(drawdown[drawdown.symbol == symbol].sort_values("ts").drawdown, equity / equity.cummax() - 1, atol=2e-6)
        change = pos[symbol].diff()
        change = change[change.fillna(0) != 0]
        own = markers[markers.symbol == symbol].sort_values("ts")
        assert list(pd.to_datetime(own.ts)) == list(change.index) and list(own.side) == ["buy" if c > 0 else "sell" for c in change]


def test_forward_evaluation(spark, prices, book):
    from quantloom.operators.forward import closed, evaluated

    net, ret = book[3], prices.pct_change().fillna(0.0)
    rows = pd.concat([pd.DataFrame({"symbol": s, "ts": DAYS.date, "net": net[s].to_numpy(), "ret": ret[s].to_numpy()}) for s in "AB"])
    returns = spark.createDataFrame(rows)
    frozen = [("A", DAYS[300].date(), "x"), ("A", DAYS[500].date(), "y"), ("B", DAYS[-1].date(), "x"), ("Z", DAYS[0].date(), "x")]
    got = {(r.symbol, r.frozen_at): r for r in evaluated(spark.createDataFrame(frozen, "symbol string, frozen_at date, family string"), returns).collect()}
    assert len(got) == 4 and got["A", DAYS[500].date()].family == "y"
    for k in (300, 500):
        r, x, h = got["A", DAYS[k].date()], net.A[k + 1 :], ret.A[k + 1 :]
        want = (len(x), (1 + x).prod() - 1, x.mean() / x.std() * 252**0.5, (1 + h).prod() - 1, h.mean() / h.std() * 252**0.5)
        np.testing.assert_allclose((r.forward_bars, r.forward_return, r.forward_sharpe, r.held_return, r.held_sharpe), want, rtol=1e-9)
        assert r.as_of == DAYS[-1].date() and r.beats_held == (want[2] > want[4])
    for key in (("B", DAYS[-1].date()), ("Z", DAYS[0].date())):
        assert (got[key].forward_bars, got[key].as_of, got[key].forward_return, got[key].beats_held) == (0, None, 0.0, False)
    from pyspark.sql import functions as F

    assert closed(returns, F.lit(str(DAYS[2].date()))).count() == 4
    with pytest.raises(ValueError, match="closed"):
        closed(returns, F.lit(str(DAYS[0].date())))
