"""Market regimes, benchmark, distribution, company files and store rules against pandas and by hand."""

import json

import numpy as np
import pandas as pd
import pytest

from quantloom.operators import book, kernel
from quantloom.plans.engine import Base
from quantloom.sources import edgar, stores

N = 120
DAYS = pd.bdate_range("2024-01-02", periods=N)


@pytest.fixture(scope="module")
def nets():
    rng = np.random.default_rng(3)
    return pd.DataFrame({"A": rng.normal(0.001, 0.02, N), "B": rng.normal(-0.001, 0.01, N), "still": np.zeros(N)}, index=DAYS)


@pytest.fixture(scope="module")
def prices():
    rng = np.random.default_rng(4)
    return pd.Series(100 * np.exp(np.cumsum(rng.normal(0, 0.02, N))), index=DAYS).drop(DAYS[[7, 50]])


def base(df):
    return Base(lambda spark, _: spark.createDataFrame(df), "")


def book_of(nets):
    return base(nets.rename_axis("ts").reset_index().melt("ts", var_name="symbol", value_name="net").assign(ts=lambda d: d.ts.dt.date))


def sharpe(r):
    return float(np.sqrt(252) * r.mean() / r.std()) if len(r) > 1 and r.std() > 0 else 0.0


def test_regimes_of_a_market(spark, nets, prices):
    market = base(pd.DataFrame({"symbol": "market", "ts": prices.index.date, "close": prices.to_numpy()}))
    got = {(r.symbol, r.regime): (r.n, r.total, r.sharpe) for r in kernel.by_regime(book_of(nets), market)(spark, "").collect()}
    want = {}
    for symbol, own in nets.items():
        own, close = own.align(prices, join="inner")
        bear = (close.pct_change(20) < 0).to_numpy()
        for name, part in (("bear", own[bear]), ("bull", own[~bear])):
            want[symbol, name] = (len(part), round((1 + part).prod() - 1, 6), round(sharpe(part), 6))
    assert set(got) == set(want)
    for key, row in want.items():
        np.testing.assert_allclose(got[key], row, atol=2e-6)


def test_against_a_benchmark(spark, nets, prices):
    other = prices.pct_change().fillna(0.0)
    got = {r.symbol: r for r in kernel.against(book_of(nets), base(pd.DataFrame({"ts": other.index.date, "net": other.to_numpy()})))(spark, "").collect()}
    for symbol, own in nets.items():
        own, bench = own.align(other, join="inner")
        excess, beta = own - bench, own.cov(bench) / bench.var()
        rel = (1 + own).cumprod() / (1 + bench).cumprod()
        want = (len(own), beta, (own.mean() - beta * bench.mean()) * 252, excess.std() * 252**0.5, excess.mean() / excess.std() * 252**0.5, (rel / rel.cummax() - 1).min())
        r = got[symbol]
        np.testing.assert_allclose((r.n, r.beta, r.alpha, r.tracking_error, r.information_ratio, r.relative_drawdown), want, atol=2e-6)
    twin = kernel.against(book_of(nets[["A"]]), base(pd.DataFrame({"ts": nets.index.date, "net": nets.A.to_numpy()})))(spark, "").first()
    assert (twin.tracking_error, twin.information_ratio, twin.relative_drawdown) == (0, 0, 0) and twin.beta == 1


def test_shape_of_a_distribution(spark, nets):
    frame = spark.createDataFrame(nets.melt(var_name="symbol", value_name="net"))
    got = {r.symbol: (r.n, r.skew, r.kurtosis) for r in spark.sql(kernel.shape("net", "{t}", "symbol"), t=frame).collect()}
    for symbol, x in nets.items():
        c, sd = x - x.mean(), x.std()
        want = (N, (c**3).mean() / sd**3, (c**4).mean() / sd**4 - 3) if sd > 0 else (N, 0, 0)
        np.testing.assert_allclose(got[symbol], want, atol=2e-6)


def test_company_files_by_ticker(spark, tmp_path):
    listed = {"0": {"cik_str": 320, "ticker": "aaa", "title": "A Inc"}, "1": {"cik_str": 7, "ticker": "BBB", "title": "B"}, "2": {"cik_str": 7, "ticker": "BBB.A", "title": "B"}, "3": {"cik_str": 9, "ticker": "AAA", "title": "again"}, "4": {"cik_str": 11, "ticker": "NONE", "title": "no file"}}
    (tmp_path / "tickers.json").write_text(json.dumps(listed))
    row = lambda val: {"end": "2023-12-31", "val": val, "fy": 2023, "fp": "FY", "form": "10-K", "filed": "2024-02-01", "accn": "x"}
    facts = lambda name, val: json.dumps({"entityName": name, "facts": {"us-gaap": {"Revenues": {"units": {"USD": [row(val)]}}}}}, indent=1)
    (tmp_path / "facts").mkdir()
    for cik, val in ((320, 5.0), (7, 6.0), (99, 7.0)):
        (tmp_path / "facts" / f"CIK{cik:010d}.json").write_text(facts(f"Name {cik}", val))
    (tmp_path / "facts" / "readme.txt").write_text("no document")
    companies = edgar.tickers(spark, str(tmp_path / "tickers.json"))
    assert {(r.symbol, r.cik, r.title) for r in companies.collect()} == {("AAA", 320, "A Inc"), ("BBB", 7, "B"), ("BBB.A", 7, "B"), ("NONE", 11, "no file")}
    docs = edgar.company_facts(spark, str(tmp_path / "facts"), companies)
    assert {(r.symbol, r.fy, r.value) for r in edgar.annual_facts(docs).collect()} == {("AAA", 2023, 5.0), ("BBB", 2023, 6.0), ("BBB.A", 2023, 6.0)}


def test_upsert_needs_an_order_for_rows_of_one_key(spark, tmp_path):
    rows = spark.createDataFrame([("A", 1, 1.0, 5), ("A", 1, 2.0, 6), ("B", 1, 3.0, 1)], "symbol string, k int, v double, at int")
    with pytest.raises(ValueError, match="share a key"):
        stores.upsert(rows, str(tmp_path / "s"), ["symbol", "k"])
    stores.upsert(rows, str(tmp_path / "s"), ["symbol", "k"], order="at")
    assert sorted(r.v for r in spark.read.parquet(str(tmp_path / "s")).collect()) == [2.0, 3.0]
    with pytest.raises(ValueError, match="share a key"):
        stores.upsert(rows.withColumn("at", rows.k), str(tmp_path / "s"), ["symbol", "k"], order="at")


def test_shards_of_two_versions_are_refused(spark):
    shard = lambda *versions: base(pd.DataFrame([{"shard": str(k), "version": v, "mode": "iid", "symbol": "A", "sharpe": 3.0, "years": 4.0} for k, v in enumerate(versions)]))
    assert book.require_mergeable(book.merged_calibration(shard("v1", "v1"))(spark, "")).first().n == 2
    with pytest.raises(Exception, match="cannot be merged"):
        book.require_mergeable(book.merged_calibration(shard("v1", "v2"))(spark, "")).collect()
