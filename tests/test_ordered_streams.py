"""Streams that bring bars out of order, late, twice and after a restart."""

import datetime as dt

import numpy as np
import pytest

from quantloom.operators.stateful import stepped
from quantloom.streaming import ordered

FED = "symbol string, ts timestamp, close double, eh double, el double, long_stop double, short_stop double"
NETS = "symbol string, ts timestamp, net double, ret double, frozen_at timestamp"
DAY = dt.timedelta(days=1)
BEGIN = dt.datetime(2024, 1, 1)


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    had = spark.conf.get(key)
    spark.conf.set(key, ordered.PROVIDER)
    yield spark
    spark.conf.set(key, had)


def fed(spark, path, schema, batches, make, checkpoint, *, mode="append"):
    """Runs a query over batches, one file at a time, and gives what each has emitted."""
    out = []
    path.mkdir(exist_ok=True)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path)).withWatermark("ts", "6 days")
    q = make(stream).writeStream.foreachBatch(lambda df, _: out.extend(df.collect())).outputMode(mode).option("checkpointLocation", checkpoint).start()
    try:
        for rows in batches:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))
            q.processAllAvailable()
    finally:
        q.stop()
    return out


def test_positions_do_not_depend_on_the_order_of_arrival(rocks, tmp_path):
    rng = np.random.default_rng(1)
    bars = []
    for symbol in "AB":
        for k in range(24):
            close = float(rng.uniform(4, 12))
            bounds = (None, None) if k < 2 else (8.0, 7.0)
            bars.append((symbol, BEGIN + k * DAY, close, bounds[0], bounds[1], 6.0, 9.0))
    want = []
    for symbol in "AB":
        held = 0.0
        for row in (b for b in bars if b[0] == symbol):
            held = stepped(held, *(float("nan") if x is None else x for x in row[2:]))
            want.append((symbol, row[1], held))
    assert {w[2] for w in want} == {-1.0, 0.0, 1.0}
    late = sorted(bars, key=lambda b: b[1] + rng.integers(-2, 3) * DAY)
    batches = [late[:15], late[15:31] + late[10:12], late[31:], [(s, BEGIN + 60 * DAY, 7.5, 8.0, 7.0, 6.0, 9.0) for s in "AB"], [("C", BEGIN + 61 * DAY, 7.5, 8.0, 7.0, 6.0, 9.0)]]
    out = fed(rocks, tmp_path / "in", FED, batches, ordered.trailing_positions, str(tmp_path / "c"))
    got = sorted((r.symbol, r.ts, r.signal) for r in out)
    assert got == sorted(want)


def test_forward_scores_go_on_after_a_restart(rocks, tmp_path):
    rng = np.random.default_rng(2)
    frozen = BEGIN + 5 * DAY
    rows = [(s, BEGIN + k * DAY, float(rng.normal(0.002, 0.02)), float(rng.normal(0, 0.02)), frozen) for s in "AB" for k in range(40)]
    mixed = sorted(rows, key=lambda r: r[1] + rng.integers(-2, 3) * DAY)
    end = [[(s, BEGIN + 90 * DAY, 0.0, 0.0, frozen) for s in "AB"], [("C", BEGIN + 91 * DAY, 0.0, 0.0, frozen)]]
    run = lambda batches: fed(rocks, tmp_path / "in", NETS, batches, ordered.forward_scores, str(tmp_path / "c"), mode="update")
    first = run([mixed[:30], mixed[30:50]])
    second = run([mixed[50:], *end])
    assert first and max(r.n for r in first) < max(r.n for r in second)  # the state came back
    for symbol in "AB":
        last = max((r for r in second if r.symbol == symbol), key=lambda r: r.n)
        net, ret = (np.array([r[c] for r in rows if r[0] == symbol and r[1] > frozen]) for c in (2, 3))
        curve = np.cumprod(1 + net)
        assert last.n == len(net) == 34 and last.as_of == BEGIN + 39 * DAY
        np.testing.assert_allclose(last.forward_return, curve[-1] - 1)
        np.testing.assert_allclose(last.drawdown, min(0, (curve / np.maximum(1, np.maximum.accumulate(curve)) - 1).min()))
        for got, x in ((last.sharpe, net), (last.held_sharpe, ret)):
            np.testing.assert_allclose(got, 252**0.5 * x.mean() / x.std(ddof=1))
        np.testing.assert_allclose(last.held_return, np.prod(1 + ret) - 1)
        assert last.beats_held == (net.mean() / net.std() > ret.mean() / ret.std())


def test_state_of_a_silent_symbol_goes(rocks, tmp_path):
    bar = lambda s, k, close: (s, BEGIN + k * DAY, close, 8.0, 7.0, 6.0, 9.0)
    make = lambda stream: ordered.trailing_positions(stream, idle=20 * 86_400_000)
    batches = [[bar("A", 0, 8.5)], [bar("B", 10, 7.5)], [bar("B", 50, 7.5)], [bar("B", 51, 7.5)], [bar("A", 60, 7.5)], [bar("B", 90, 7.5)], [bar("B", 91, 7.5)]]
    out = {(r.symbol, (r.ts - BEGIN).days): r.signal for r in fed(rocks, tmp_path / "in", FED, batches, make, str(tmp_path / "c"))}
    assert out["A", 0] == 1.0 and out["A", 60] == 0.0  # a position that nothing has confirmed for 20 days is not carried on
