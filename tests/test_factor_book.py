"""The factor hunt and the book of versions."""

import numpy as np
import pandas as pd
import pytest

from quantloom.plans import factor_book as fb
from quantloom.plans.search import Gate

GRADUATES = "family string, universe string, params string"
JUDGED = "family string, universe string, n long, sharpe double, held_sharpe double, drawdown double, reasons array<string>, state string"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def step(spark):
    def run(book, graduates, judged, now):
        made = fb.step(book, spark.createDataFrame([(*g, "{}") for g in graduates], GRADUATES), spark.createDataFrame(judged, JUDGED), now)
        return spark.createDataFrame(made.collect(), fb.BOOK)

    return run


def test_versions(spark, step):
    book = step(spark.createDataFrame([], fb.BOOK), [("a", "u"), ("b", "u"), ("a", "v"), ("a", "u")], [], "2024-01-01")
    assert [(r.family, r.universe, r.status, str(r.valid_from), r.valid_to) for r in sorted(book.collect())] == [("a", "u", "open", "2024-01-01", None), ("a", "v", "open", "2024-01-01", None), ("b", "u", "open", "2024-01-01", None)]
    judged = [("a", "u", 30, 1.0, 0.5, 0.1, [], "hold"), ("b", "u", 30, -1.0, 0.5, 0.4, ["decayed", "drawdown"], "retire")]
    second = step(book, [("a", "u"), ("b", "u")], judged, "2024-02-01")
    assert rows(step(second, [("a", "u"), ("b", "u")], judged, "2024-02-01")) == rows(second)  # twice is once
    assert rows(step(second, [], judged[:1], "2024-02-09")) == rows(second)  # nothing new: no version
    versions = {(r.family, r.universe, str(r.valid_from)): (r.status, str(r.valid_to), r.n, r.reasons) for r in second.collect()}
    assert versions == {
        ("a", "u", "2024-01-01"): ("open", "2024-02-01", 0, []), ("a", "u", "2024-02-01"): ("open", "None", 30, []), ("a", "v", "2024-01-01"): ("open", "None", 0, []),
        ("b", "u", "2024-01-01"): ("open", "2024-02-01", 0, []), ("b", "u", "2024-02-01"): ("retired", "None", 30, ["decayed", "drawdown"]),
    }
    again = [("a", "u", 50, 0.2, 0.5, 0.2, ["behind the panel"], "retire"), ("b", "u", 99, 9.0, 0.0, 0.0, [], "hold")]
    third = step(second, [("a", "u"), ("b", "u")], again, "2024-03-01")
    closed = lambda df: rows(df.where("status = 'retired' OR valid_to IS NOT NULL"))
    assert set(map(repr, closed(second))) < set(map(repr, closed(third)))  # what has ended stays as it is, and is not promoted again
    assert {(r.family, r.universe, r.status) for r in fb.current(third).collect()} == {("a", "u", "retired"), ("a", "v", "open"), ("b", "u", "retired")}
    assert {(r.family, r.n) for r in fb.as_of(third, "2024-02-15").where("universe = 'u'").collect()} == {("a", 30), ("b", 30)}
    assert {(r.family, r.n) for r in fb.as_of(third, "2024-01-31").where("universe = 'u'").collect()} == {("a", 0), ("b", 0)}
    same_day = step(second, [], [("a", "u", 31, 1.1, 0.5, 0.1, [], "hold")], "2024-02-01")
    assert same_day.count() == second.count() and same_day.where("n = 31").count() == 1  # a second look on one day replaces the first


@pytest.fixture(scope="module")
def bars(spark):
    rng = np.random.default_rng(0)
    make = lambda s, n: pd.DataFrame({"symbol": s, "ts": pd.bdate_range("2020-01-01", periods=n).date, "close": 50 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))})
    return spark.createDataFrame(pd.concat([*(make(s, 620) for s in "ABCD"), make("SHORT", 503)])).persist()


def test_hunt_of_factors(spark, bars):
    names = lambda *x: spark.createDataFrame([(n,) for n in x], "symbol string")
    done = fb.hunt(names("A", "B", "C", "SHORT", "NONE", "A", None), bars, Gate(budget=4), ("xs_reversal", "xs_low_volatility"), keep=lambda df: df.persist())
    assert {(r.symbol, r.outcome, r.reason) for r in done.outcomes.collect()} == {("A", "panel", None), ("B", "panel", None), ("C", "panel", None), ("SHORT", "failed", "503 closes, 504 are needed"), ("NONE", "failed", "no bars")}
    verdict = done.verdict.first()
    assert verdict.family in ("xs_reversal", "xs_low_volatility") and verdict.params and verdict.universe == done.universe
    with pytest.raises(ValueError, match="at least 2"):
        fb.hunt(names("A", "SHORT"), bars, Gate(budget=4), ("xs_reversal",))


def test_states_of_open_factors(spark, bars):
    panel = fb.panel_of(bars.where("symbol <> 'SHORT'"))
    u = fb.universe_of(panel)
    book = fb.step(spark.createDataFrame([], fb.BOOK), spark.createDataFrame([("xs_reversal", u, '{"n": 5, "quantile": 0.2}'), ("xs_low_volatility", u, '{"n": 21, "quantile": 0.2}')], GRADUATES), spark.createDataFrame([], JUDGED), "2021-10-01")
    book = spark.createDataFrame(book.collect(), fb.BOOK)
    judged = {r.family: r for r in fb.states(book, panel, u).collect()}
    dates = panel.select("ts").distinct().where("ts > DATE '2021-10-01'").count()
    assert {r.n for r in judged.values()} == {dates} and dates > 63
    early = fb.states(book, panel.where("ts <= DATE '2021-10-01'"), u).collect()
    assert {(r.n, r.state, tuple(r.reasons)) for r in early} == {(0, "hold", ("grace",))}
    assert fb.states(book, panel, "another").collect() == []
