"""The universe hunt: an outcome for every symbol, pruned reads, vetoes, promotion."""

import numpy as np
import pandas as pd
import pytest

from quantloom.operators import fundamentals
from quantloom.plans import hunt
from quantloom.plans.hunt import Screens
from quantloom.plans.search import Gate

BARS = "symbol string, ts date, open double, high double, low double, close double, volume double"
EASY = Gate(margin=-99, pbo=2.0, stability=-1.0, holdout=-99, beat_holding=False, budget=4)


@pytest.fixture(scope="module")
def bars(spark):
    rng = np.random.default_rng(0)

    def of(symbol, n):
        close = 100 * np.exp(np.cumsum(0.006 + rng.normal(0, 0.004, n)))
        return pd.DataFrame({"symbol": symbol, "ts": pd.bdate_range("2015-01-05", periods=n).date, "open": close, "high": close, "low": close, "close": close, "volume": 1.0})

    rows = pd.concat([of(s, 560) for s in ("GOOD", "SICK", "POOR", "DEAR", "HOLE", "TWICE")] + [of("SHORT", 503)])
    rows.loc[(rows.symbol == "HOLE") & (rows.index == 17), "close"] = 0.0
    rows.loc[(rows.symbol == "TWICE") & (rows.index == 17), "ts"] = pd.Timestamp("2015-01-05").date()
    return spark.createDataFrame(rows, BARS)


@pytest.fixture(scope="module")
def universe(spark):
    names = ["GOOD", "SICK", "POOR", "DEAR", "HOLE", "TWICE", "SHORT", "NONE", "GOOD", None]
    return spark.createDataFrame([(n,) for n in names], "symbol string")


@pytest.fixture(scope="module")
def known(spark):
    records = spark.createDataFrame([("GOOD", 0.9, 0.8), ("DEAR", 0.1, 0.1), ("POOR", 0.9, 0.2), ("SICK", 0.7, None)], "symbol string, value double, quality double")
    screens = (lambda df: fundamentals.screen_value(df, 0.5), lambda df: fundamentals.screen_quality(df, 0.5))
    sound = spark.createDataFrame([("GOOD", True, []), ("SICK", False, ["growth too low"])], "symbol string, passed boolean, reasons array<string>")
    distress = spark.createDataFrame([("SICK", True, ["loss"]), ("GOOD", False, [])], "symbol string, distressed boolean, reasons array<string>")
    return Screens(records, screens, sound, distress)


def test_every_symbol_has_an_outcome(universe, bars, known):
    found = hunt.outcomes(hunt.screened(universe, known), bars, 1)
    assert {r.symbol: (r.outcome, r.reason, r.n_bars) for r in found.collect()} == {
        "GOOD": ("searched", None, 560), "SICK": ("searched", None, 560), "POOR": ("filtered", "quality too low", None), "DEAR": ("filtered", "not cheap enough", None),
        "HOLE": ("failed", "1 bars without a positive close", 560), "TWICE": ("failed", "1 bars of a time that has another", 560),
        "SHORT": ("failed", "251 bars before the holdout, 252 are needed", 503), "NONE": ("failed", "no bars", 0),
    }
    assert found.count() == 8 and {r.symbol: r.value for r in found.collect()}["GOOD"] == 0.9
    assert hunt.yield_rate(found).first().asDict() == {"attempted": 6, "searched": 2, "failed": 4, "filtered": 2, "rate": 2 / 6}
    none = hunt.outcomes(hunt.screened(universe.limit(0)), bars, 1)
    assert none.collect() == [] and hunt.yield_rate(none).first().rate == 1.0
    assert {r.reason for r in hunt.outcomes(hunt.screened(universe.where("symbol = 'GOOD'")), bars, 0).collect()} == {"no valid strategies"}


def test_only_the_partitions_of_screened_symbols_are_read(spark, universe, bars, known, tmp_path):
    bars.repartition("symbol").write.partitionBy("symbol").parquet(str(tmp_path / "bars"))
    stored = spark.read.parquet(str(tmp_path / "bars"))
    wanted = hunt.bars_of(stored, hunt.wanted(hunt.screened(universe, known)))
    plan = wanted._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower()
    assert {r.symbol for r in wanted.select("symbol").distinct().collect()} == {"GOOD", "SICK", "HOLE", "TWICE", "SHORT"}


def test_vetoes_records_and_promotion(spark, universe, bars, known, monkeypatch):
    earlier = spark.createDataFrame([("OLD", "sma", True, 7), ("GOOD", "momentum", False, 5), ("GOOD", "sma", False, 11)], "symbol string, family string, graduated boolean, lifetime_trials long")
    book = spark.createDataFrame([("OLD", "sma", "closed"), ("GONE", "sma", "open")], "symbol string, family string, status string")
    step = lambda had: hunt.hunt_and_promote(universe, bars, ("sma", "momentum"), EASY, known, earlier, had, keep=lambda df: df.persist())
    done, after = step(book)
    rows = {r.symbol: r for r in done.verdicts.collect()}
    assert set(rows) == {"GOOD", "SICK"} and all(r.passed for r in rows.values())
    assert rows["GOOD"].graduated and rows["GOOD"].vetoes == [] and rows["GOOD"].value == 0.9
    assert not rows["SICK"].graduated and rows["SICK"].vetoes == ["fundamentals", "distress"]
    assert rows["GOOD"].lifetime_trials == 4 + 11 and rows["SICK"].lifetime_trials == 4  # the pool's candidates count
    board = hunt.ranked(done.verdicts).collect()
    assert [r.symbol for r in board] == ["GOOD", "SICK"] and board[1].survives is None and board[1].holdout_sharpe is None
    opened = {(r.symbol, r.status) for r in after.where("promoted").collect()}
    assert opened == {("GOOD", "open")}
    again = step(after.drop("promoted"))[1]
    assert again.where("promoted").count() == 0 and again.count() == after.count() == 3


def test_screens_only_record_without_bounds(spark, universe, known):
    rows = hunt.screened(universe, Screens(known.records)).collect()
    assert all(r.filtered is None for r in rows) and {r.symbol: r.value for r in rows}["DEAR"] == 0.1
    assert hunt.version(("b", "a"), EASY, refine=False) == hunt.version(("a", "b"), EASY, refine=False) != hunt.version(("a", "b"), Gate(), refine=False)
