"""Rules against plain Python and pandas on small tables: no text is shared with the queries."""

import datetime as dt
import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantloom.operators import fundamentals, pool, quality_checks, strategies
from quantloom.plans import panel_search, search
from quantloom.sources import universes


def sharpe(x):
    x = np.asarray(x, dtype=float)
    return 0.0 if len(x) < 2 or x.std(ddof=1) < 1e-12 else x.mean() / x.std(ddof=1)


def matrix(t=503, n=9, seed=3):
    rng = np.random.default_rng(seed)
    m = rng.normal(0, 0.01, (t, n))
    m[:, 2] += 0.002  # one that dominates
    m[:, 5] = 0.0  # one without spread
    return m


@pytest.fixture(scope="module")
def rows(spark):
    m = matrix()
    days = pd.bdate_range("2010-01-04", periods=len(m)).date
    flat = [("A", "f", k, days[i], i, len(m), 0.0, float(m[i, k])) for i in range(len(m)) for k in range(m.shape[1])]
    return spark.createDataFrame(flat, "symbol string, family string, config int, ts date, i int, n long, ret double, net double").persist()


def best(scores):
    return max(range(len(scores)), key=lambda k: (round(scores[k], 12), -k))


def test_overfitting(rows):
    m = matrix()
    groups = np.array_split(np.arange(len(m)), 10)
    lost = []
    for half in itertools.combinations(range(10), 5):
        inside = np.concatenate([groups[g] for g in half])
        outside = np.concatenate([groups[g] for g in range(10) if g not in half])
        tr, te = ([sharpe(m[part, k]) for k in range(m.shape[1])] for part in (inside, outside))
        place = sorted(range(len(te)), key=lambda k: (round(te[k], 12), k)).index(best(tr)) + 1
        lost.append(place / (len(te) + 1) <= 0.5)
    assert search.overfitting(rows).first().pbo == pytest.approx(np.mean(lost))


def _splits(m, parts):
    tr, te = zip(*[((lambda s: (s[k := best(s)], sharpe(m[test, k])))([sharpe(m[train, k]) for k in range(m.shape[1])])) for train, test in parts], strict=True)
    year = math.sqrt(252)
    return np.mean(tr) * year, np.mean(te) * year, np.mean(np.array(te) > 0)


def test_walk_forward(rows):
    m = matrix()
    fold = len(m) // 6
    parts = [(np.arange(i * fold), np.arange(i * fold, (i + 1) * fold if i < 5 else len(m))) for i in range(1, 6)]
    got = search.walk_forward(rows).first()
    assert (got.walk_is, got.walk_oos, got.walk_consistency) == pytest.approx(_splits(m, parts))
    assert got.walk_efficiency == pytest.approx(got.walk_oos / got.walk_is)


@pytest.mark.parametrize("embargo", [2, 60, 300])
def test_purged_folds(rows, embargo):
    m, n = matrix(), 503
    edges = [k * n // 5 for k in range(6)]
    parts = [([i for i in range(n) if i < a - embargo or i >= b + embargo], range(a, b)) for a, b in itertools.pairwise(edges)]
    parts = [(np.array(tr), np.array(te)) for tr, te in parts if tr]
    got = search.purged_folds(rows, {"f": embargo}).first()
    assert (got.purged_is, got.purged_oos, got.purged_consistency) == pytest.approx(_splits(m, parts))


def test_purged_folds_without_training_rows(rows):
    assert search.purged_folds(rows, {"f": 900}).count() == 0
    assert search.embargoes({"sma": [{"fast": 10, "slow": 200}], "gap": [{"threshold": 0.02}]}) == {"sma": 200, "gap": 2}


def test_report_and_repricing(spark, rows):
    from quantloom.operators.statistics import expected_max_sharpe, probabilistic_sharpe

    m = matrix()
    ratios = [sharpe(m[:, k]) * math.sqrt(252) for k in range(9)]
    report = search.validated(rows, {"f": [{"x": k} for k in range(9)]})
    one = report.first()
    sd = np.std(ratios, ddof=1)
    assert one.config == best(ratios) == 2 and one.sharpe == pytest.approx(ratios[2])
    assert one.margin == pytest.approx(ratios[2] - sd * expected_max_sharpe(1.0, 9))
    assert one.stability == pytest.approx(1 / (1 + sd / (abs(np.mean(ratios)) + 1e-9)))
    x = pd.Series(m[:, 2])
    assert (one.skew, one.kurtosis) == pytest.approx((x.skew(), x.kurt() + 3))
    prior = spark.createDataFrame([("A", 91)], "symbol string, trials int")
    again = search.repriced(report, prior).first()
    spread = max((np.percentile(ratios, 75) - np.percentile(ratios, 25)) / 1.34898, 1e-6)
    haircut = spread * expected_max_sharpe(1.0, 100)
    assert again.trials == 100 and again.dispersion == pytest.approx(spread) and again.margin == pytest.approx(ratios[2] - haircut)
    year = math.sqrt(252)
    assert again.probability == pytest.approx(probabilistic_sharpe(ratios[2] / year, haircut / year, 503, x.skew(), x.kurt() + 3))


def test_gate_and_its_reasons(spark):
    good = dict(symbol="A", since=dt.date(2000, 1, 1), until=dt.date(2010, 1, 1), sharpe=2.0, trials=100, margin=0.5, pbo=0.2, stability=0.6, holdout_sharpe=1.0, held_sharpe=0.5)
    bad = {"dsr": dict(margin=0.0), "pbo": dict(pbo=0.5), "stability": dict(stability=0.39), "mintrl": dict(sharpe=0.5), "holdout": dict(holdout_sharpe=0.0, held_sharpe=-1.0), "beats_held": dict(held_sharpe=1.0)}
    table = [good, {**good, "symbol": "neg", "sharpe": -1.0}] + [{**good, "symbol": k, **v} for k, v in bad.items()]
    out = {r.symbol: r for r in search.gated(spark.createDataFrame(pd.DataFrame(table))).collect()}
    assert out["A"].passed and out["A"].reasons == [] and out["A"].required_years == pytest.approx(2 * math.log(100) / 4)
    assert out["neg"].reasons == ["mintrl"] and out["neg"].required_years is None
    assert all(not out[k].passed and out[k].reasons == [k] for k in bad)


def test_candidates_fill_the_budget_and_reserve_a_refinement():
    families, reserve = search.coarse(budget=200)
    assert sum(map(len, families.values())) + reserve == 200 and min(map(len, families.values())) >= 2 and len(families) == 34 and reserve >= 2


def test_candidates_side_by_side_equal_each_alone(spark):
    rng = np.random.default_rng(1)
    days = pd.bdate_range("2015-01-01", periods=130).date
    close = 100 * np.cumprod(1 + rng.normal(0, 0.01, 130))
    bars = spark.createDataFrame(pd.DataFrame({"symbol": "A", "ts": days, "open": close, "high": close * 1.01, "low": close * 0.99, "close": close, "volume": 1000.0}))
    families = {"sma": [{"fast": 3, "slow": 9}, {"fast": 5, "slow": 20}], "adx": [{"window": 5}, {"window": 9}], "trix": [{"window": 4, "signal": 3}], "donchian_atr_trail": [{"entry": 9, "atr": 5}]}
    key = ["family", "config", "ts"]
    whole = search.returns(bars, families).toPandas()
    alone = pd.concat(search.returns(bars, {f: [p]}).toPandas().assign(config=k) for f, ps in families.items() for k, p in enumerate(ps))
    a, b = (d.sort_values(key, ignore_index=True)[[*key, "net"]] for d in (whole, alone))
    pd.testing.assert_frame_equal(a, b, check_dtype=False)


def test_panel_lifecycle(spark):
    def judged(nets, market):
        days = pd.bdate_range("2020-01-01", periods=len(nets)).date
        return panel_search.lifecycle(spark.createDataFrame([("f", 0, d, float(a), float(b)) for d, a, b in zip(days, nets, market, strict=True)], "family string, config int, ts date, net double, ret double")).first()

    good, flat = [0.01, -0.002] * 40, [0.002, -0.004] * 40
    assert judged(good[:20], flat[:20]).reasons == ["grace"] and judged(good, flat).state == "hold"
    assert judged(flat, good).reasons == ["decayed", "behind the panel"]
    assert judged([0.1, -0.35, *good], [0.1, -0.3, *flat]).reasons == ["drawdown"]


BASE = dict(symbol="A", fy=2022, revenue=100.0, net_income=5.0, gross=40.0, eps=1.0, shares=10.0, operating_cash=8.0, free_cash=6.0, assets=200.0, current_assets=50.0, current_liabilities=25.0, debt=60.0, retained=9.0, equity=90.0)
HISTORY = ", ".join(f"{c} {'string' if c == 'symbol' else 'int' if c == 'fy' else 'double'}" for c in BASE)


def history(spark, *years):
    return spark.createDataFrame([tuple({**BASE, **y}.values()) for y in years], HISTORY)


def test_f_score_signals(spark):
    better = dict(fy=2023, revenue=130.0, net_income=9.0, gross=60.0, operating_cash=12.0, debt=50.0, current_assets=60.0)
    out = {r.symbol: r for r in fundamentals.f_score(fundamentals.latest_pairs(history(spark, {}, better, dict(symbol="B"), dict(symbol="C", shares=None), dict(symbol="C", fy=2023, shares=None, assets=0.0)))).collect()}
    assert out["A"].f_score == 9 and all(out["A"][k] for k in fundamentals.SIGNALS)
    assert out["B"].f_score == 0 and not out["B"].roa_positive  # one year only
    assert [k for k in fundamentals.SIGNALS if out["C"][k]] == ["cfo_positive"]  # no assets, no shares


def test_quality_skips_what_is_not_reported(spark):
    out = {r.symbol: r for r in fundamentals.quality(history(spark, {}, dict(symbol="B", gross=None, equity=None, current_assets=None, retained=None))).collect()}
    safe = np.mean([1 - 110 / 200, (50 / 25) / 3, 1.0])
    assert out["A"].quality == pytest.approx(np.mean([0.0, (40 / 200) / 0.5, safe])) and out["A"].quality_flags == []
    assert out["B"].quality == 0.0 and out["B"].quality_flags == ["no gross profitability", "no financial safety"]


def test_distress(spark):
    sick = dict(net_income=-1.0, operating_cash=-1.0)
    cases = {"loss only": dict(net_income=-1.0), "solvent": sick, "insolvent": {**sick, "equity": -1.0}, "illiquid": {**sick, "current_assets": 20.0}, "unknown": {**sick, "equity": None, "current_assets": None}}
    out = {r.symbol: r for r in fundamentals.distress(fundamentals.latest_pairs(history(spark, *[dict(symbol=k, **v) for k, v in cases.items()]))).collect()}
    assert {k for k, r in out.items() if r.distressed} == {"insolvent", "illiquid"}
    assert out["insolvent"].reasons == ["loss", "cash burnt", "liabilities exceed assets"] and out["solvent"].reasons == []


def test_valuation(spark):
    years = [dict(fy=2020 + k, free_cash=6.0 * 1.05**k, revenue=100.0 + k) for k in range(4)]
    h = history(spark, *years, dict(symbol="N", fy=2023, free_cash=None, net_income=None), dict(symbol="P", fy=2023, free_cash=None, net_income=4.0, eps=-1.0))
    closes = spark.createDataFrame([("A", dt.date(2020, 12, 31), 5.0), ("A", dt.date(2021, 6, 1), 7.0), ("A", dt.date(2023, 1, 2), 9.0), ("A", dt.date(2024, 1, 2), 8.0), ("P", dt.date(2024, 1, 2), 8.0)], "symbol string, ts date, close double")
    priced = fundamentals.attach_prices(h, closes)
    assert {(r.symbol, r.fy): r.price for r in priced.collect()} == {("A", 2020): 5.0, ("A", 2021): 7.0, ("A", 2022): 7.0, ("A", 2023): 9.0, ("N", 2023): None, ("P", 2023): None}
    now = spark.createDataFrame([("A", 8.0), ("N", 1.0), ("P", 8.0)], "symbol string, close double")
    out = {r.symbol: r for r in fundamentals.valuation(priced, now).collect()}
    growth = 0.05
    flows = sum(6 * 1.05**3 * (1 + growth) ** k / 1.1**k for k in range(1, 6))
    value = (flows + 6 * 1.05**3 * (1 + growth) ** 5 * 1.025 / 0.075 / 1.1**5) / 10
    assert out["A"].value == pytest.approx(value) and out["A"].pe_percentile == 0.75 and out["A"].pe_n == 4
    assert out["A"].undervaluation == pytest.approx(np.mean([0.25, 1 - 0.75, min(max((value - 8) / value, 0), 1)]))
    assert out["N"].value is None and out["N"].undervaluation is None
    assert out["P"].is_proxy and out["P"].pe is None and out["P"].growth == pytest.approx(0.025)


def test_screens(spark):
    records = spark.createDataFrame([("A", 0.6, 0.4, 5, 0.1), ("B", None, None, 0, None), ("C", 0.4, 0.7, 8, -0.1)], "symbol string, quality double, value double, f_score int, margin_of_safety double")
    of = lambda df: {r.symbol: (r.passed, r.reasons) for r in df.collect()}
    assert of(fundamentals.screen_value(records, margin=True)) == {"A": (False, ["not cheap enough"]), "B": (True, []), "C": (False, ["no margin of safety"])}
    assert of(fundamentals.screen_quality(records, f_floor=6, keep_unscored=False)) == {"A": (False, ["f_score too low"]), "B": (False, ["no quality score"]), "C": (False, ["quality too low"])}
    snapshot = spark.createDataFrame([("A", 0.1, 0.2), ("B", None, 0.1), ("C", -0.1, -0.2)], "symbol string, growth double, net_margin double")
    assert {k: p for k, (p, _) in of(fundamentals.screen_fundamentals(snapshot)).items()} == {"A": True, "B": False, "C": False}
    universe = spark.createDataFrame([("A",), ("C",), ("Z",)], "symbol string")
    assert [r.symbol for r in fundamentals.screened_in(universe, records, fundamentals.screen_quality).orderBy("symbol").collect()] == ["A", "Z"]
    newer = spark.createDataFrame([("A", 2023, 1), ("B", 2021, 1)], "symbol string, fy int, v int")
    older = spark.createDataFrame([("A", 2022, 0), ("B", 2022, 0), ("C", 2020, 0)], "symbol string, fy int, v int")
    assert {r.symbol: r.v for r in fundamentals.merged_records(older, newer).collect()} == {"A": 1, "B": 0, "C": 0}


def series(closes, factor=None, days=None):
    days = days if days is not None else list(pd.bdate_range("2024-01-02", periods=len(closes)).date)
    return [("A", d, float(c), float(f)) for d, c, f in zip(days, closes, factor or [1] * len(closes), strict=True)]


def found(spark, bars, requested=("A",)):
    df = spark.createDataFrame(bars, "symbol string, ts date, close double, adj_factor double")
    asked = spark.createDataFrame([(s,) for s in requested], "symbol string")
    issues = quality_checks.check(df, asked)
    rows = issues.collect()
    return {r.check for r in rows} - {"survivorship_risk"}, rows, {r.symbol: r.passed for r in quality_checks.report(issues).collect()}


def test_quality_checks(spark):
    clean = [100 * 1.001**k for k in range(30)]
    days = list(pd.bdate_range("2024-01-02", periods=30).date)
    assert found(spark, series(clean))[0] == set()
    gap = [k for k in range(30) if k not in (10, 11, 12)]
    kinds, rows, _ = found(spark, series([clean[k] for k in gap], days=[days[k] for k in gap]))
    assert kinds == {"missing_bars"} and [r.context["missing"] for r in rows if r.check == "missing_bars"] == ["3"]
    assert found(spark, series([*clean[:10], *[clean[10]] * 5, *clean[15:]]))[0] == {"stale_data"}
    kinds, rows, _ = found(spark, series([*clean[:24], *[clean[24]] * 6]))  # a run at the end
    assert kinds == {"stale_data"} and [r.context["run"] for r in rows if r.check == "stale_data"] == ["6"]
    assert found(spark, series([*clean[:10], *[clean[10]] * 4, *clean[15:]][:25]))[0] == set()
    assert found(spark, series([*clean[:15], clean[15] * 0.6, *clean[16:]]))[0] == {"price_anomaly"}
    assert found(spark, series(clean, [1.0] * 15 + [0.25] * 15))[0] == {"split_dividend_consistency"}
    kinds, rows, passed = found(spark, series(clean[:1]), ("A", "none"))
    assert kinds == {"insufficient_data"} and len(rows) == 2 and passed == {"A": False, "none": False}
    with pytest.raises(ValueError):
        quality_checks.require_zoned(spark.sql("SELECT TIMESTAMP_NTZ '2024-01-01 00:00:00' AS ts"))


def test_normalizer(spark):
    raw = "symbol string, ts date, open double, high double, low double, close double, adj_close double, volume long"
    day = dt.date(2024, 1, 2)
    out = quality_checks.normalized(spark.createDataFrame([("A", day, 10.0, 12.0, 9.0, 11.0, 11.0, 5), ("B", day, 10.0, 12.0, 9.0, 11.0, 5.5, 5), ("C", day, 10.0, 10.2, 9.0, 10.3, 10.3, 5)], raw)).collect()
    got = {r.symbol: tuple(map(float, (r.open, r.high, r.low, r.close, r.adj_factor))) for r in out}
    assert got == {"A": (10, 12, 9, 11, 1), "B": (5, 6, 4.5, 5.5, 0.5), "C": (10, 10.3, 9, 10.3, 1)}
    with pytest.raises(Exception, match="positive"):
        quality_checks.normalized(spark.createDataFrame([("A", day, 1.0, 1.0, 1.0, 0.0, 1.0, 5)], raw)).collect()


def test_pool_rules(spark):
    e = spark.createDataFrame(
        [(1, "A", "2024-01-01", "v", 10, 900, True, 3.0, 504), (2, "A", "2024-01-02", "v", 20, 900, False, 0.0, 504), (3, "A", "2024-01-03", "v", 30, 900, False, 0.0, 504), (4, "B", "2024-01-01", "v", 5, 900, True, 0.5, 504)],
        "experiment_id long, symbol string, created string, version string, lifetime_trials long, n_bars long, graduated boolean, holdout_sharpe double, holdout_bars long")
    t = spark.createDataFrame([(1, "sma", 0.1, 0.5), (1, "adx", 0.4, 0.1), (2, "sma", 9.0, 0.0), (4, "sma", 0.2, 0.2)], "experiment_id long, family string, deflated double, walk_oos double")
    bar = math.sqrt(1 / 2) * math.sqrt(2 * math.log(2))
    assert {r.experiment_id for r in pool.retain_recent(e, 1).collect()} == {1, 3, 4}
    assert {r.symbol: r.trials for r in pool.prior_trials(e).collect()} == {"A": 30, "B": 5}
    board = {r.symbol: r for r in pool.leaderboard(e, t).collect()}
    assert (board["A"].family, board["A"].survives, board["B"].survives) == ("adx", True, False)
    miss = pool.near_misses(e, t).collect()
    assert [(r.symbol, r.family) for r in miss] == [("B", "sma")] and miss[0].ratio == pytest.approx(0.5 / bar)
    s = pool.summary(e, t).first()
    assert (s.n_experiments, s.n_symbols, s.n_trials, s.n_graduates, s.n_leaderboard_graduates, s.n_surviving) == (4, 2, 65, 2, 2, 1)
    positions = pool.frozen(e, t, F.lit("2024-02-01"))
    assert {r.symbol: r.survives for r in positions.collect()} == {"A": True, "B": False}
    held = spark.createDataFrame([("A", "adx")], "symbol string, family string")
    assert [r.symbol for r in pool.newly_promoted(held, positions).collect()] == ["B"]
    runs = spark.createDataFrame([(1, "experiment"), (1, "error"), (1, "filtered"), (2, "filtered")], "run int, outcome string")
    assert {r.run: (r.attempted, r.rate) for r in pool.yield_rates(runs).collect()} == {1: (2, 0.5), 2: (0, 1.0)}
    with pytest.raises(Exception, match="too low"):
        pool.require_yield(pool.yield_rates(runs), 0.6).collect()
    orders = pool.reconciled(spark.createDataFrame([("A", 5), ("B", -2), ("C", 1)], "symbol string, shares long"), spark.createDataFrame([("A", 5), ("B", 3), ("D", 4)], "symbol string, shares long"))
    assert sorted((r.symbol, r.leg, r.side, r.shares) for r in orders.collect()) == [("B", 0, "buy", 2), ("B", 1, "buy", 3), ("C", 0, "sell", 1), ("D", 0, "buy", 4)]


def test_strategy_factory_and_lineage():
    assert dict(strategies.build("sma").params) == {"fast": 20, "slow": 50}
    for name, params in (("none", {}), ("sma", {"x": 1}), ("sma", {"fast": 0}), ("sma", {"fast": 60}), ("sma", {"fast": 2.5}), ("sma", {"fast": True})):
        with pytest.raises(ValueError):
            strategies.build(name, params)
    line = strategies.Lineage("1", strategies.build("sma").parameter_hash, "parquet", "parquet-1", True, "2020-01-01", "2021-01-01")
    assert strategies.Lineage.from_json(line.to_json()) == line
    assert strategies.search_version(["b", "a"], refine=True) == strategies.search_version(["a", "b"], refine=True) != strategies.search_version(["a"], refine=True)


def test_universe_files_and_stored_bars(spark, tmp_path):
    (tmp_path / "a.txt").write_text(" msft\n\nAAPL\nMSFT\nBRK-B\ntoolong1\n")
    (tmp_path / "b.txt").write_text("zz\naapl\n")
    a, b = str(tmp_path / "a.txt"), str(tmp_path / "b.txt")
    assert [r.symbol for r in universes.load_universe(spark, a).collect()] == ["MSFT", "AAPL", "BRK-B", "TOOLONG1"]
    assert [r.symbol for r in universes.load_universe(spark, a, well_formed=True).collect()] == ["MSFT", "AAPL", "BRK-B"]
    assert [r.symbol for r in universes.merge_universes(spark, [a, b]).collect()] == ["AAPL", "BRK-B", "MSFT", "TOOLONG1", "ZZ"]
    days = pd.bdate_range("2024-01-02", periods=9).date
    spark.createDataFrame([(s, d, 1.0) for s in "AB" for d in days], "symbol string, ts date, close double").write.partitionBy("symbol").parquet(str(tmp_path / "bars"))
    got = universes.ParquetBars(str(tmp_path / "bars")).bars(spark, "A", "2024-01-03", "2024-01-05")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert [str(r.ts) for r in got.collect()] == ["2024-01-03", "2024-01-04"]
    assert "PartitionFilters: [isnotnull(symbol" in plan and "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in plan


def test_streams_ingest_once_and_keep_state(spark, tmp_path):
    from quantloom.operators.stateful import stepped
    from quantloom.streaming import ingest

    rows = [("A", f"2024-01-0{d} 00:00:00", float(d)) for d in (1, 2, 3)]
    bars = spark.createDataFrame([*rows, rows[0]], "symbol string, ts string, close double").selectExpr("symbol", "CAST(ts AS timestamp) AS ts", "close")
    bars.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(bars.schema).parquet(str(tmp_path / "in"))
    for run in range(2):  # the second replays everything
        q = ingest.ingest(stream, str(tmp_path / "store"), ["symbol", "ts"]).option("checkpointLocation", str(tmp_path / f"c{run}")).start()
        q.processAllAvailable()
        q.stop()
    assert spark.read.parquet(str(tmp_path / "store")).count() == 3

    bounds = [(10.0, 9.0, 5.0, 8.0, 12.0), (9.5, 11.0, 5.0, 8.0, 12.0), (7.0, 11.0, 5.0, 8.0, 12.0), (4.0, 11.0, 5.0, 3.0, 12.0)]
    want, held = [], 0.0
    for b in bounds:
        held = stepped(held, *b)
        want.append(held)
    assert want == [1.0, 1.0, 0.0, -1.0]


def test_calibration_counts(spark):
    from quantloom.plans import calibration

    v = spark.createDataFrame([("A", True, True, 2.0, 2.0, 1.0), ("B", False, False, 0.1, 2.0, 0.2), ("C", True, False, 0.3, 2.0, 0.4)], "symbol string, passed boolean, clears boolean, holdout_sharpe double, years double, walk_oos double").withColumns({"margin": F.lit(0.5), "purged_oos": F.lit(0.1)})
    r = calibration.calibrated(v).first()
    assert (r.n_symbols, r.n_graduates, r.n_clear, r.max_holdout, r.walk_median) == (3, 2, 1, 2.0, 0.4) and r.bar == pytest.approx(math.sqrt(0.5) * math.sqrt(2 * math.log(3)))
    oracle = spark.createDataFrame([(s, 4.0) for s in "ABC"], "symbol string, sharpe double")
    p = calibration.power(v, oracle).first()
    assert p.detected == pytest.approx(2 / 3) and p.capture == pytest.approx(0.3 / 4)
    assert calibration.power(v, oracle.withColumn("sharpe", F.lit(0.1))).first().capture is None


def test_probability_of_the_sharpe_ratio(spark):
    from quantloom.operators.simulation import probabilistic
    from quantloom.operators.statistics import probabilistic_sharpe

    x = pd.Series(np.random.default_rng(2).standard_t(4, 300) * 0.01 + 0.001)
    df = spark.createDataFrame([("A", float(v)) for v in x] + [("flat", 0.0)] * 9 + [("short", 0.1), ("short", 0.2)], "symbol string, net double")
    out = {r.symbol: r.psr for r in probabilistic(df, 0.02).collect()}
    assert out["A"] == pytest.approx(probabilistic_sharpe(x.mean() / x.std(), 0.02, 300, x.skew(), x.kurt() + 3), abs=1e-6)
    assert out["flat"] is None and out["short"] is None
