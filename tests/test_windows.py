"""Wide rolling windows, recursive averages and the trailing stop against pandas and a plain fold."""

import numpy as np
import pandas as pd
import pytest

from quantloom.functions.windows import roll
from quantloom.operators.signals import SIGNALS, trail_inputs
from quantloom.operators.stateful import stepped
from quantloom.plans import engine
from quantloom.plans.engine import Ewm, apply_stages
from quantloom.plans.search import shared

N = 1100
PANDAS = {"avg": "mean", "stddev_samp": "std", "var_samp": "var"}


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(1)
    rows = []
    for symbol in "AB":
        x = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, N)))
        gaps, late = x.copy(), x.copy()
        gaps[:37], gaps[500:503], late[:5] = np.nan, np.nan, np.nan
        rows.append(pd.DataFrame({"symbol": symbol, "ts": pd.bdate_range("2000-01-03", periods=N).date, "x": x, "gaps": gaps, "late": late, "same": np.full(N, 12.34)}))
    return pd.concat(rows, ignore_index=True)


@pytest.fixture(scope="module")
def series(spark, frame):
    return spark.createDataFrame(frame.astype(object).where(frame.notna(), None), "symbol string, ts date, x double, gaps double, late double, same double").persist()


def test_rolling_windows_from_tables(frame, series):
    asked = {f"{a}_{c}_{n}": (a, c, n, n) for a in ("max", "min", "avg", "sum", "stddev_samp", "var_samp") for c, n in (("x", 64), ("gaps", 100), ("same", 252), ("x", 500))}
    asked |= {"part_max": ("max", "x", 252, 1), "part_min": ("min", "gaps", 100, 1), "narrow": ("avg", "x", 20, 20)}
    stage = {name: roll(*r) for name, r in asked.items()}
    assert len(engine.rolls_of(stage.values())) == len(asked) - 1
    got = apply_stages(series, [stage]).toPandas().sort_values(["symbol", "ts"])
    assert list(got.columns) == [*frame.columns, *stage]
    for symbol, own in got.groupby("symbol"):
        had = frame[frame.symbol == symbol]
        for name, (agg, column, n, least) in asked.items():
            want = getattr(had[column].rolling(n, min_periods=least), PANDAS.get(agg, agg))().to_numpy()
            if column == "same" and agg in ("stddev_samp", "var_samp"):
                want = np.where(np.isnan(want), want, 0.0)
            np.testing.assert_allclose(own[name].astype(float).to_numpy(), want, rtol=1e-9, atol=1e-9, err_msg=name)


def test_recursive_averages_of_any_decay(frame, series):
    alphas = (1.0, 0.9, 2 / 3, 0.5, 2 / 13, 1 / 14, 2 / 27, 2 / 101, 2 / 501, 1e-4)
    got = apply_stages(series, [{f"e{k}": Ewm("late", a) for k, a in enumerate(alphas)}]).toPandas().sort_values(["symbol", "ts"])
    for symbol, own in got.groupby("symbol"):
        late = frame[frame.symbol == symbol].late
        for k, a in enumerate(alphas):
            np.testing.assert_allclose(own[f"e{k}"].astype(float).to_numpy(), late.ewm(alpha=a, adjust=False).mean().to_numpy(), rtol=1e-10, err_msg=str(a))


def test_recursive_average_of_one_block_a_row(series, frame, monkeypatch):
    monkeypatch.setattr(engine, "BLOCK", 4)
    got = apply_stages(series, [{"e": Ewm("x", 0.01)}]).where("symbol = 'A'").toPandas().sort_values("ts")
    np.testing.assert_allclose(got.e, frame[frame.symbol == "A"].x.ewm(alpha=0.01, adjust=False).mean(), rtol=1e-10)


@pytest.mark.parametrize("seed", range(3))
def test_trailing_stop_is_the_fold(spark, seed):
    """Wild prices, so that entries, both stops and turns on one bar all occur."""
    rng = np.random.default_rng(seed)
    rows = []
    for symbol in "ABCD":
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.03, 500)))
        high, low = close * (1 + rng.uniform(0, 0.03, 500)), close * (1 - rng.uniform(0, 0.03, 500))
        rows.append(pd.DataFrame({"symbol": symbol, "ts": pd.bdate_range("2000-01-03", periods=500).date, "open": close, "high": high, "low": low, "close": close, "volume": 1.0}))
    bars = spark.createDataFrame(pd.concat(rows))
    params = {"entry": 4, "atr": 3, "multiplier": [0.5, 0.9, 1.6][seed]}
    fed = apply_stages(bars, trail_inputs(**params)).toPandas().sort_values(["symbol", "ts"])
    got = apply_stages(bars, SIGNALS["donchian_atr_trail"](**params)).toPandas().sort_values(["symbol", "ts"])
    want, turns = [], 0
    for _, own in fed.groupby("symbol"):
        held = 0.0
        for row in own[["close", "eh", "el", "long_stop", "short_stop"]].itertuples(index=False):
            now = stepped(held, *row)
            turns += held * now < 0
            held = now
            want.append(held)
    assert list(got.signal) == want and {-1.0, 0.0, 1.0} <= set(want) and turns


def test_candidates_share_what_they_compute_alike():
    families = [SIGNALS["sma"](20, 50), SIGNALS["sma"](20, 100), SIGNALS["keltner_channel"](20, 14, 2.0), SIGNALS["donchian_atr_trail"](), SIGNALS["donchian_atr_trail"](30)]
    stages, signals = shared(families)
    columns = [name for stage in stages for name in stage]
    assert len(columns) == len(set(columns)) < sum(len(s) for own in families for s in own)
    assert sum("_roll" not in c and c.startswith("tr__") for c in columns) == 1  # one true range for all
    assert len(set(signals)) == len(families)


def test_long_series_in_chunks(spark):
    """One series of many chunks, and short ones beside it, against running it through; it is spread over tasks by chunk."""
    from pyspark.sql import functions as F

    from quantloom.functions.long_series import chunked, recursive_average, wealth

    rng = np.random.default_rng(4)
    rows = pd.concat([pd.DataFrame({"symbol": s, "day": np.arange(n), "net": rng.normal(0, 0.01, n)}) for s, n in (("long", 5000), ("short", 70), ("one", 1))])
    series = spark.createDataFrame(rows.sample(frac=1, random_state=1)).repartition(5)
    cut = chunked(series, ["day"], F.expr("day div 97"), rows=64)
    assert cut.where("i <> day OR chunk <> i div 64").count() == 0
    curve = wealth(cut.withColumn("growth", 1 + F.col("net")), "growth").toPandas().sort_values(["symbol", "i"])
    for alpha in (0.5, 0.02, 0.001):
        average = recursive_average(cut, "net", alpha, "average", rows=64)
        assert set(average.columns) == {*cut.columns, "average"}
        for symbol, own in average.toPandas().sort_values(["symbol", "i"]).groupby("symbol"):
            np.testing.assert_allclose(own.average, rows[rows.symbol == symbol].net.ewm(alpha=alpha, adjust=False).mean(), rtol=1e-9, atol=1e-15)
    for symbol, own in curve.groupby("symbol"):
        equity = (1 + rows[rows.symbol == symbol].net).cumprod()
        np.testing.assert_allclose(own.equity, equity, rtol=1e-10)
        np.testing.assert_allclose(own.drawdown, equity / equity.cummax() - 1, rtol=1e-9, atol=1e-12)
    plan = wealth(cut.withColumn("growth", 1 + F.col("net")), "growth")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(symbol" in plan and "chunk" in plan and "SinglePartition" not in plan
