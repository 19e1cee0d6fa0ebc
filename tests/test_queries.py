"""Every declared query against DuckDB, and properties of the signals."""

import math

import duckdb
import numpy as np
import pandas as pd
import pytest

from quantloom import catalog
from quantloom.operators import statistics
from quantloom.operators.kernel import backtest
from quantloom.operators.signals import SIGNALS
from quantloom.operators.validation import GRID
from quantloom.plans.engine import apply_stages
from quantloom.sources.bars import BARS
from quantloom.sources.stores import upsert

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
ORACLE = catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    return c


@pytest.fixture(scope="module")
def bars(spark):
    return BARS.frame(spark, SF).where("symbol IN ('NO', 'RF')").persist()


def _normal(d: pd.DataFrame) -> pd.DataFrame:
    d = d[sorted(d.columns)].copy()
    for k in d:
        if d[k].dtype.kind not in "ifb":
            d[k] = d[k].astype(str).str.slice(0, 19).str.replace(" 00:00:00", "")
    return d.sort_values(list(d.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_oracle(spark, duck, name):
    a, b = _normal(catalog.queries()[name](spark, SF).toPandas()), _normal(duck.sql(ORACLE[name]).df())
    assert list(a.columns) == list(b.columns)
    pd.testing.assert_frame_equal(a, b, check_dtype=False, rtol=0, atol=2e-6)


def test_gate_scores_the_heads_finalist_on_the_sealed_holdout(spark):
    def nets(close, fast, slow):
        a, b = close.rolling(fast).mean(), close.rolling(slow).mean()
        pos = np.sign((a - b).fillna(0.0))
        return pos.shift(1, fill_value=0.0) * close.pct_change().fillna(0.0) - (pos - pos.shift(1, fill_value=0.0)).abs() * 0.001

    def sharpe(net):
        return math.sqrt(252) * net.mean() / net.std() if net.std() > 0 else 0.0

    want, whole = {}, {}
    for symbol, d in BARS.frame(spark, SF).toPandas().groupby("symbol"):
        close = d.sort_values("ts").close.reset_index(drop=True)
        cut = len(close) - max(int(0.2 * len(close)), 252)
        if cut <= 0:
            continue
        head, tail = close[:cut], close[cut:].reset_index(drop=True)
        pick = lambda c: max(range(len(GRID)), key=lambda k: (round(sharpe(nets(c, *GRID[k])), 9), -k))
        best = pick(head)
        score = sharpe(nets(tail, *GRID[best]))
        want[symbol] = (best, score > 0, score > sharpe(tail.pct_change().fillna(0.0)))
        whole[symbol] = pick(close)
    gate = {r.symbol: r for r in catalog.queries()["gate"](spark, SF).collect()}
    board = {r.symbol: r.config for r in catalog.queries()["leaderboard"](spark, SF).collect()}
    assert {s: (board[s], r.holdout_ok, r.beats_held) for s, r in gate.items()} == want
    assert any(best != whole[s] for s, (best, *_) in want.items())  # the holdout would have changed the choice


@pytest.mark.parametrize("name", SIGNALS)
def test_signal_has_no_look_ahead(bars, name):
    cut = pd.Timestamp("1998-01-01").date()
    run = lambda d: apply_stages(d, SIGNALS[name]())
    whole, part = (run(d).select("symbol", "ts", "signal").toPandas() for d in (bars, bars.where(f"ts < DATE '{cut}'")))
    whole = whole[whole.ts < cut]
    both = whole.merge(part, on=["symbol", "ts"], suffixes=("", "_cut"))
    assert len(both) == len(part) > 100
    assert np.allclose(both.signal, both.signal_cut, atol=1e-9)
    assert part.signal.between(-1, 1).all()


def test_ewm_matches_pandas(bars):
    got = apply_stages(bars, SIGNALS["macd_crossover"]()).where("symbol = 'NO'").toPandas().sort_values("ts")
    fast = got.close.ewm(span=12, adjust=False).mean()
    macd = fast - got.close.ewm(span=26, adjust=False).mean()
    assert np.allclose(got.ef, fast)
    assert (got.signal == np.sign((macd - macd.ewm(span=9, adjust=False).mean()).where(lambda x: x.abs() > 1e-12, 0))).all()


def _prices(spark, values):
    days = pd.bdate_range("2024-01-02", periods=len(values))
    return spark.createDataFrame(pd.DataFrame({"symbol": "A", "ts": days.date, "close": [float(v) for v in values]}), "symbol string, ts date, close double")


def test_kernel_closed_forms(spark):
    prices = _prices(spark, [100 * 1.01**i for i in range(20)])
    run = lambda signal, cost: apply_stages(prices.selectExpr("*", f"{signal} AS signal"), backtest(cost)).toPandas().sort_values("ts").equity
    assert np.allclose(run("1.0D", 0.0), [100_000 * 1.01**i for i in range(20)])
    assert (run("0.0D", 0.01) == 100_000).all()
    assert np.allclose(run("5.0D", 0.0), run("1.0D", 0.0))
    assert run("1.0D", 0.01).iloc[-1] < run("1.0D", 0.001).iloc[-1]


def test_statistics():
    assert statistics.expected_max_sharpe(1.0, 1) == 0
    assert statistics.expected_max_sharpe(1.0, 100) > statistics.expected_max_sharpe(1.0, 10) > 0
    assert math.isclose(statistics.probabilistic_sharpe(0.1, 0.1, 100, 0, 3), 0.5)
    assert statistics.minimum_backtest_years(0.0, 10) == math.inf
    assert statistics.detectable_sharpe(100, 4.3) > statistics.null_bar(4.3, 100)
    assert round(statistics.detectable_sharpe(607, 4.3), 2) == 2.13


def test_frontier(spark):
    from quantloom.operators.pool import frontier

    rows = [(f"S{k}", k < 3, 1000 + 84 * k) for k in range(607)]  # the median holdout of the graduates is 4.3 years
    pool = spark.createDataFrame(rows, "symbol string, graduated boolean, holdout_bars long")
    for power in (0.8, 0.95, 0.3):
        r = frontier(pool, power).first()
        want = statistics.detectable_sharpe(607, r.years, power)
        assert abs(r.years - 1084 / 252) < 1e-12 and abs(r.detectable - want) < 1e-9 and abs(r.error - statistics.standard_error(want, r.years)) < 1e-9
    assert frontier(pool.where("NOT graduated")).first().detectable is None


def test_upsert_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "store")
    a = spark.createDataFrame([("A", 1, 1.0), ("B", 1, 2.0)], "symbol string, k int, v double")
    b = spark.createDataFrame([("A", 1, 3.0), ("A", 2, 4.0)], "symbol string, k int, v double")
    for d in (a, b, b):
        upsert(d, path, ["symbol", "k"])
    assert sorted(map(tuple, spark.read.parquet(path).select("symbol", "k", "v").collect())) == [("A", 1, 3.0), ("A", 2, 4.0), ("B", 1, 2.0)]


def test_stream_appends_closed_hours(spark, tmp_path):
    from quantloom.streaming.bars import hourly_bars

    rows = [(i, f"2024-01-01 0{h}:30:00", "x", float(i)) for i, h in enumerate((0, 0, 1, 5))]
    events = spark.createDataFrame(rows, "event_id long, ts string, event_type string, value double").selectExpr("event_id", "CAST(ts AS timestamp_ntz) AS ts", "event_type", "value")
    events.write.parquet(str(tmp_path / "in"))
    stream = hourly_bars(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("hours").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert [(r.open, r.close, r.n) for r in spark.table("hours").orderBy("hour").collect()] == [(0.0, 1.0, 2), (2.0, 2.0, 1)]


def test_simulations_repeat(spark):
    q = catalog.queries()
    for name in ("null_iid", "ar1_edge"):
        a, b = (q[name](spark, SF).repartition(n).toPandas().sort_values(["symbol", "ts"]).close.to_numpy() for n in (1, 3))
        assert (a == b).all() and (a > 0).all()


def test_risk_of_returns(spark):
    from quantloom.operators.simulation import risk

    rng = np.random.default_rng(0)
    nets = {"calm": rng.normal(0.001, 0.002, 400), "wild": rng.normal(0.0, 0.03, 400), "one": [0.1]}
    rows = [(s, float(x)) for s, own in nets.items() for x in own]
    r = {x.symbol: x for x in risk(spark.createDataFrame(rows, "symbol string, net double"), n_paths=300).collect()}
    assert set(r) == {"calm", "wild"}
    for x in r.values():
        assert x.p5 < x.p50 < x.p95 and 0 <= x.p_loss <= x.p_drawdown <= 1
    mu, sigma = np.mean(nets["calm"]), np.std(nets["calm"], ddof=1)
    assert abs(r["calm"].mean - (np.exp(252 * mu) - 1)) < 4 * sigma * 252**0.5 / 300**0.5 * np.exp(252 * mu) and r["calm"].p_drawdown == 0
    assert r["wild"].p_loss > 0.2 and r["wild"].p_drawdown > 0.8
    with pytest.raises(ValueError, match="loss"):
        risk(spark.createDataFrame(rows, "symbol string, net double"), loss=0.0)


@pytest.mark.parametrize("phi", [0.0, 0.3, -0.4])
def test_autocorrelated_bars(spark, phi):
    from quantloom.operators.simulation import autocorrelated

    had = BARS.frame(spark, SF).toPandas().sort_values(["symbol", "ts"])
    got = autocorrelated(BARS.frame(spark, SF), phi).toPandas().sort_values(["symbol", "ts"])
    assert list(got.ts) == list(had.ts) and list(got.volume) == list(had.volume)
    assert ((got.high >= got[["open", "close"]].max(axis=1)) & (got.low <= got[["open", "close"]].min(axis=1))).all()
    both = [np.log(d.close).groupby(d.symbol).diff() for d in (had, got)]
    spread = [r.groupby(had.symbol.to_numpy()).std() for r in both]
    assert (abs(spread[1] / spread[0] - 1) < 0.15).all()
    own = both[1].groupby(got.symbol.to_numpy())
    assert abs(np.mean([r.autocorr() for _, r in own if len(r) > 500]) - phi) < 0.06


def test_store_keeps_what_passed_and_migrates_whole(spark, tmp_path):
    from quantloom.sources import stores

    bars = spark.createDataFrame([("A", 1, 1.0), ("B", 1, 2.0)], "symbol string, k int, v double")
    reports = spark.createDataFrame([("A", True), ("B", False)], "symbol string, passed boolean")
    where = (str(tmp_path / "bars"), str(tmp_path / "reports"))
    for _ in range(2):
        stores.store_gated(bars, reports, *where, ["symbol", "k"])
    assert [r.symbol for r in stores.read(spark, where[0], bars).collect()] == ["A"]
    assert stores.read(spark, where[1], reports).count() == 4
    assert not list(tmp_path.glob("*_staged_*"))

    pool = spark.createDataFrame([("A", i, i == 0) for i in range(9)] + [("B", 1, None), ("B", 1, None)], "symbol string, made int, graduated boolean")
    assert stores.migrate(pool, str(tmp_path / "pool")) == 11
    stores.retain(str(tmp_path / "pool"), pool, 5, "made")
    left = stores.read(spark, str(tmp_path / "pool"), pool)
    assert sorted(r.made for r in left.where("symbol = 'A'").collect()) == [0, 4, 5, 6, 7, 8]
    assert left.where("symbol = 'B'").count() == 2


def test_company_facts_prefer_tags_units_and_restatements(spark):
    import json

    from quantloom.sources import edgar

    row = lambda val, fy, filed, form="10-K", fp="FY": {"end": f"{fy}-12-31", "val": val, "fy": fy, "fp": fp, "form": form, "filed": filed, "accn": filed}
    facts = {
        "Revenues": {"units": {"USD": [row(100, 2022, "2023-02-01"), row(110, 2022, "2023-08-01", "10-K/A"), row(150, 2023, "2024-02-01"), row(9, 2023, "2024-03-01", "10-Q", "Q1")]}},
        "RevenueFromContractWithCustomerExcludingAssessedTax": {"units": {"EUR": [row(1, 2022, "2023-02-01")]}},
        "CostOfRevenue": {"units": {"USD": [row(60, 2023, "2024-02-01")]}},
        "NetCashProvidedByUsedInOperatingActivities": {"units": {"USD": [row(40, 2023, "2024-02-01")]}},
    }
    docs = spark.createDataFrame([(json.dumps({"entityName": "A", "facts": {"us-gaap": facts}}),), ("{}",), (None,)], "json string")
    got = {r.fy: r for r in edgar.history(docs).collect()}
    assert {fy: (r.revenue, r.gross, r.free_cash) for fy, r in got.items()} == {2022: (110.0, None, None), 2023: (150.0, 90.0, None)}
    last = edgar.snapshot(docs).first()
    assert (last.fy, last.growth, last.gross_margin, last.net_margin) == (2023, 40 / 110, 0.6, None)


def test_lifecycle_rules(spark):
    from quantloom.operators.book import lifecycle
    from quantloom.plans.engine import Base

    def curve(nets):
        wealth = np.cumprod(1 + np.array(nets))
        days = pd.bdate_range("2024-01-02", periods=len(nets)).date
        return spark.createDataFrame(pd.DataFrame({"symbol": "A", "ts": days, "net": nets, "equity": wealth}), "symbol string, ts date, net double, equity double")

    def judged(nets, held):
        return lifecycle(Base(lambda *_: curve(nets), ""), Base(lambda *_: curve(held), ""), "DATE '2024-01-01'")(spark, "").first()

    good, flat = [0.01, -0.002] * 40, [0.002, -0.004] * 40
    assert judged(good[:20], flat[:20]).reasons == "grace"
    assert judged(good, flat).state == "hold"
    assert judged(flat, good).reasons == "decayed,behind holding"
    assert judged([0.1, -0.3, *good], [0.1, -0.3, *flat]).reasons == "drawdown"


def test_band_reversion_and_its_filter(spark):
    from quantloom.operators import simulation as sim

    band = sim.Band(5.0)
    days = pd.bdate_range("2000-01-03", periods=4000).date
    rng = np.random.default_rng(2)
    own = pd.concat([pd.DataFrame({"symbol": s, "ts": days, "open": 1.0, "high": 1.0, "low": 1.0, "close": 50 * np.exp(np.cumsum(rng.normal(0.0003, 0.012, 4000))), "volume": 5.0}) for s in "AB"])
    d = sim.reverting(spark.createDataFrame(own), band).toPandas().sort_values(["symbol", "ts"])
    assert ((d.high >= d[["open", "close"]].max(axis=1)) & (d.low <= d[["open", "close"]].min(axis=1))).all()
    r = np.log(d.close).groupby(d.symbol).diff()
    assert abs(r.std() / 0.012 - 1) < 0.05
    assert abs(d.deviation.std() / 0.012 / band.deviation - 1) < 0.15
    assert all(o.deviation.corr(o.oracle_mean.shift(-1)) < -0.999 for _, o in d.groupby("symbol"))
    assert d.oracle_mean.corr(d.achievable_mean) > 0.3
    # the steady gain is where the filter with a gain of its own at every step ends
    for one in (band, sim.Band(1.0, 0.3)):
        move, see = np.array([[one.rho, 0.0], [1.0, 0.0]]), np.array([[1.0, -1.0]])
        p = np.eye(2) * one.deviation**2
        for _ in range(2000):
            p = move @ p @ move.T + np.diag([one.deviation**2 * (1 - one.rho**2), 0.0])
            k = p @ see.T / (see @ p @ see.T + 1 - one.share)
            p = p - k @ see @ p
        assert abs(k[0, 0] - one.gain) < 1e-12
    bars = spark.createDataFrame(d)
    gross, net = (sim.oracle_sharpe(bars, "oracle_mean", c).agg({"sharpe": "avg"}).first()[0] for c in (0.0, 0.001))
    known = sim.oracle_sharpe(bars, "achievable_mean", 0.0)
    assert gross > known.agg({"sharpe": "avg"}).first()[0] > 0 and gross > net
    assert abs(sim.capture(known, known).first().capture - 1) < 1e-12


def test_bootstrap_draws_whole_rows(spark, bars):
    from quantloom.operators.simulation import bootstrap

    had, got = (d.toPandas().sort_values(["symbol", "ts"]) for d in (bars, bootstrap(bars)))
    assert len(got) == len(had) - had.symbol.nunique()
    for symbol, own in got.groupby("symbol"):
        src = had[had.symbol == symbol]
        shapes = set((src.open / src.close).round(9)), set((own.open / own.close).round(9))
        assert shapes[1] <= shapes[0]
        growth = (src.close / src.close.shift()).dropna().round(9)
        assert (own.close / own.close.shift()).dropna().round(9).isin(set(growth)).mean() > 0.99
    assert ((got.high >= got[["open", "close"]].max(axis=1)) & (got.low <= got[["open", "close"]].min(axis=1))).all()
