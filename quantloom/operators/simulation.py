"""Series without an edge, with a planted one, and simulated risk, all made from given bars and returns.

A synthetic series has the dates, the length, the mean and the spread of a symbol's own log returns. Draws are hashes of
symbol, row and seed, so that a series is the same on any partitioning; recursions are the engine's recursive averages.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from quantloom.operators.kernel import COST, run
from quantloom.operators.statistics import SQUARED, probabilistic_sharpe
from quantloom.plans.engine import Ewm, with_ewms
from quantloom.sources.bars import BARS

YEAR = 252
BAR = ["symbol", "ts", "open", "high", "low", "close", "volume"]


def uniform(seed: int, *keys: str) -> Column:
    """Within 0 and 1, both left out."""
    return F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(1 << 40)).cast("double") / (1 << 40) + 2.0**-42


def normal(seed: int, *keys: str) -> Column:
    return F.sqrt(-2 * F.ln(uniform(2 * seed, *keys))) * F.cos(2 * math.pi * uniform(2 * seed + 1, *keys))


def risk(returns: DataFrame, n_paths: int = 500, n_steps: int = YEAR, loss: float = 0.2, seed: int = 7) -> DataFrame:
    """Per symbol of ``returns(symbol, net)``: how geometric Brownian paths with its returns' mean and spread end, from 1.

    The probability to end, or to fall from a peak, by the loss or more, percentiles and mean of the final return. A symbol of under two returns has no row.
    """
    if n_paths < 1 or n_steps < 1 or not 0 < loss <= 1:
        raise ValueError("paths and steps must be positive, the loss within 0 and 1")
    own = returns.groupBy("symbol").agg(F.avg("net").alias("mu"), F.stddev_samp("net").alias("sigma")).where("sigma IS NOT NULL")
    cells = own.withColumn("path", F.explode(F.sequence(F.lit(1), F.lit(n_paths)))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n_steps))))
    w = Window.partitionBy("symbol", "path").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    move = F.col("mu") - F.col("sigma") * F.col("sigma") / 2 + F.col("sigma") * normal(seed, "symbol", "path", "step")
    drawn = cells.withColumn("price", F.exp(F.sum(move).over(w)))
    drawn = drawn.withColumn("down", F.col("price") / F.greatest(F.max("price").over(w), F.lit(1.0)) - 1)
    ended = drawn.groupBy("symbol", "path").agg((F.max_by("price", "step") - 1).alias("last"), F.min("down").alias("worst"))
    return ended.groupBy("symbol").agg(
        F.avg((F.col("last") <= -loss).cast("double")).alias("p_loss"), F.avg((F.col("worst") <= -loss).cast("double")).alias("p_drawdown"),
        *[F.percentile("last", p).alias(f"p{round(100 * p)}") for p in (0.05, 0.5, 0.95)], F.avg("last").alias("mean"),
    )


def _measured(bars: DataFrame) -> DataFrame:
    """``bars`` plus k (their number), start (the first close), and the mean and spread of the symbol's log returns."""
    by_time = Window.partitionBy("symbol").orderBy("ts")
    known = bars.withColumns({"k": F.row_number().over(by_time), "start": F.first("close").over(by_time), "moved": F.ln(F.col("close") / F.lag("close").over(by_time))})
    whole = Window.partitionBy("symbol")
    return known.withColumns({"mean": F.coalesce(F.avg("moved").over(whole), F.lit(0.0)), "spread": F.coalesce(F.stddev_samp("moved").over(whole), F.lit(0.0))}).drop("moved")


def autoregressive(rows: DataFrame, shock: Column, rho: float, name: str) -> DataFrame:
    """``rows(symbol, ts, k, ...)`` plus a stationary series that keeps ``rho`` of its last value; a negative one turns its sign at every row."""
    kept = abs(rho)
    turn = F.when(F.col("k") % 2 == 0, -1.0).otherwise(1.0) if rho < 0 else F.lit(1.0)
    first = F.when(F.col("k") == 1, (1 - kept) / math.sqrt(1 - kept**2)).otherwise(1.0)
    had = rows.columns
    made = with_ewms(rows.withColumn("_shock", shock * turn * first), {"_kept": Ewm("_shock", 1 - kept)})
    return made.select(*had, (F.col("_kept") / (1 - kept) * turn).alias(name))


def as_bars(rows: DataFrame, log_price: Column, seed: int) -> DataFrame:
    """``rows`` with open, high, low and close of a log price: a bar opens at the last close and overshoots its body by an exponential part of the spread."""
    by_time = Window.partitionBy("symbol").orderBy("ts")
    over = lambda n: F.exp(-F.ln(uniform(seed + n, "symbol", "k")) * F.col("spread") / 4)
    closed = rows.withColumn("close", F.exp(log_price))
    opened = closed.withColumn("open", F.coalesce(F.lag("close").over(by_time), "start"))
    return opened.withColumns({"high": F.greatest("open", "close") * over(50), "low": F.least("open", "close") / over(51)})


def _summed(x: Column) -> Column:
    return F.sum(x).over(Window.partitionBy("symbol").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0))


def autocorrelated(bars: DataFrame, phi: float = 0.3, seed: int = 11) -> DataFrame:
    """Bars with the mean and spread of the symbols' own, whose log returns keep ``phi`` of the last one's excess; 0 is the independent null."""
    rows = autoregressive(_measured(bars), F.col("spread") * math.sqrt(1 - phi**2) * normal(seed, "symbol", "k"), phi, "excess")
    return as_bars(rows, F.ln("start") + _summed(F.col("mean") + F.col("excess")), seed).select(*BAR)


class Band(NamedTuple):
    """A log price that is a random walk and a deviation that reverts by half in ``half_life`` bars; ``share`` of a return's variance is the deviation's."""

    half_life: float
    share: float = 0.5

    @property
    def rho(self) -> float:
        return 0.5 ** (1 / self.half_life)

    @property
    def deviation(self) -> float:
        """Spread of the deviation in spreads of a return."""
        return math.sqrt(self.share / (2 * (1 - self.rho)))

    @property
    def gain(self) -> float:
        """The steady gain of the Kalman filter of the deviation a, seen through returns alone.

        A return shows a - a', so its surprise is that of (rho - 1) a' and the noise; p is the variance of what a is not known by.
        """
        shock, noise = self.deviation**2 * (1 - self.rho**2), 1 - self.share
        p = self.deviation**2
        while True:
            surprise = (1 - self.rho) ** 2 * p + shock + noise
            gain = (shock - self.rho * (1 - self.rho) * p) / surprise
            after = self.rho**2 * p + shock - gain**2 * surprise
            if abs(after - p) <= 1e-15 * p:
                return gain
            p = after


def filtered(rows: DataFrame, log_price: Column, drift: Column, band: Band, name: str = "estimate") -> DataFrame:
    """``rows(symbol, ts, ...)`` plus the causal estimate of the deviation: what it keeps of the last one, and the gain's part of the return.

    The estimate before the first return is 0.
    """
    by_time = Window.partitionBy("symbol").orderBy("ts")
    keeps = band.rho + band.gain * (1 - band.rho)
    had = rows.columns
    moved = log_price - F.lag(log_price).over(by_time) - drift
    made = rows.withColumns({"_moved": moved, "_nth": F.row_number().over(by_time)})
    made = with_ewms(made.withColumn("_seen", F.when(F.col("_nth") == 2, F.col("_moved") * (1 - keeps)).otherwise(F.col("_moved"))), {"_state": Ewm("_seen", 1 - keeps)})
    return made.select(*had, (F.coalesce("_state", F.lit(0.0)) * (band.gain / (1 - keeps))).alias(name))


def reverting(bars: DataFrame, band: Band, seed: int = 13) -> DataFrame:
    """Bars around a reverting deviation, with what is known of the next return: from the hidden deviation, and from prices alone."""
    by_time = Window.partitionBy("symbol").orderBy("ts")
    shock = F.col("spread") * (band.deviation * math.sqrt(1 - band.rho**2)) * normal(seed, "symbol", "k")
    rows = autoregressive(_measured(bars), shock, band.rho, "deviation")
    level = F.ln("start") + _summed(F.col("mean") + F.col("spread") * math.sqrt(1 - band.share) * normal(seed + 1, "symbol", "k"))
    made = as_bars(rows, level + F.col("deviation"), seed)
    made = filtered(made, F.ln("close"), F.col("mean"), band)
    ahead = lambda x: F.col("mean") + (band.rho - 1) * F.lag(x).over(by_time)
    return made.withColumns({"oracle_mean": ahead("deviation"), "achievable_mean": ahead("estimate")}).select(*BAR, "deviation", "oracle_mean", "achievable_mean")


def oracle_sharpe(bars: DataFrame, mean: str, cost: float = 0.0) -> DataFrame:
    """(symbol, n, sharpe) of holding the sign of a conditional mean over the very bar that it predicts."""
    w = Window.partitionBy("symbol").orderBy("ts")
    held = (
        bars.withColumn("ret", F.col("close") / F.lag("close").over(w) - 1).where("ret IS NOT NULL")
        .withColumn("pos", F.coalesce(F.when(~F.isnan(mean), F.signum(mean)), F.lit(0.0)))
        .withColumn("net", F.col("pos") * F.col("ret") - F.abs(F.col("pos") - F.coalesce(F.lag("pos").over(w), F.lit(0.0))) * cost)
    )
    ratio = F.lit(YEAR**0.5) * F.avg("net") / F.expr("nullif(stddev_samp(net), 0)")
    return held.groupBy("symbol").agg(F.count("*").alias("n"), F.coalesce(F.when(F.count("*") >= 3, ratio), F.lit(0.0)).alias("sharpe"))


def capture(finalists: DataFrame, oracle: DataFrame) -> DataFrame:
    """Share of the oracle's median that the finalists' median reaches; null where it is within its error.

    Both have (symbol, sharpe), the oracle also its number of bars.
    """
    both = finalists.select("symbol", F.col("sharpe").alias("found")).join(oracle, "symbol")
    own = both.agg(F.count("*").alias("n"), F.median("found").alias("found"), F.median("sharpe").alias("known"), (F.median("n") / YEAR).alias("years"))
    error = F.sqrt((1 + F.col("known") ** 2 / SQUARED) / F.col("years"))
    return own.select("n", "found", "known", error.alias("error"), F.when(F.col("known") > error, F.col("found") / F.col("known")).alias("capture"))


def bootstrap(bars: DataFrame, seed: int = 3) -> DataFrame:
    """Bars resampled with replacement: each draw brings a row's return with its own open, high, low and volume.

    Draws follow hashed positions, so that they are the same on any partitioning; closes compound
    from the first close of the symbol. A symbol of one bar has no return to draw and gives no rows.
    """
    w = Window.partitionBy("symbol").orderBy("ts")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    shape = [(F.col(c) / F.col("close")).alias(f"{c}_x") for c in ("open", "high", "low")]
    source = (
        bars.withColumns({"back": F.lag("close").over(w), "start": F.first("close").over(w)}).where("back IS NOT NULL")
        .withColumns({"i": F.row_number().over(w), "n": F.count("*").over(Window.partitionBy("symbol"))})
        .select("symbol", "ts", "i", "n", "start", (F.col("close") / F.col("back")).alias("growth"), *shape, "volume")
    )
    drawn = source.select("symbol", "ts", "start", (F.pmod(F.xxhash64("symbol", "i", F.lit(seed)), F.col("n")) + 1).alias("i"))
    made = (
        drawn.join(source.select("symbol", "i", "growth", "open_x", "high_x", "low_x", "volume"), ["symbol", "i"])
        .withColumn("close", F.col("start") * F.exp(F.sum(F.ln("growth")).over(upto)))
        .withColumn("open", F.col("close") * F.col("open_x"))
    )
    return made.select(
        "symbol", "ts", "open", F.greatest(F.col("close") * F.col("high_x"), "open", "close").alias("high"),
        F.least(F.col("close") * F.col("low_x"), "open", "close").alias("low"), "close", "volume",
    )


def _normal_or_none(sharpe: float, bar: float, n: float, skew: float, kurtosis: float) -> float | None:
    try:
        return None if any(pd.isna(x) for x in (sharpe, bar, n, skew, kurtosis)) else probabilistic_sharpe(sharpe, bar, int(n), skew, kurtosis)
    except ValueError:
        return None


@F.pandas_udf(DoubleType())
def _psr(sharpe: pd.Series, bar: pd.Series, n: pd.Series, skew: pd.Series, kurtosis: pd.Series) -> pd.Series:
    """Null where the standard error cannot be measured."""
    return pd.Series([_normal_or_none(*row) for row in zip(sharpe, bar, n, skew, kurtosis, strict=True)], dtype="float64")


def probabilistic(returns: DataFrame, bar: float = 0.0) -> DataFrame:
    """(symbol, psr): probability that the true per-bar Sharpe ratio of ``returns(symbol, net)`` exceeds the bar.

    With the bias-corrected moments of the returns; one row a symbol meets Python. A symbol without spread, or of under four bars, has none.
    """
    n = F.count("*")
    own = returns.groupBy("symbol").agg(
        F.when(F.stddev_samp("net") > 1e-12, F.avg("net") / F.stddev_samp("net")).alias("sharpe"), n.alias("n"),
        F.when(n >= 4, F.skewness("net") * F.sqrt(n * (n - 1)) / (n - 2)).alias("skew"),
        F.when(n >= 4, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis("net") + 6) + 3).alias("kurt"),
    )
    return own.select("symbol", F.round(_psr("sharpe", F.lit(bar), F.col("n").cast("double"), "skew", "kurt"), 6).alias("psr"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    six = lambda df: df.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in df.dtypes])
    own = BARS.frame
    return {
        "probabilistic_sharpe": lambda spark, sf_dir: probabilistic(run("sma").frame(spark, sf_dir)),
        "monte_carlo_risk": lambda spark, sf_dir: six(risk(run("sma").frame(spark, sf_dir))),
        "null_iid": lambda spark, sf_dir: autocorrelated(own(spark, sf_dir), 0.0),
        "ar1_edge": lambda spark, sf_dir: autocorrelated(own(spark, sf_dir)),
        "band_reversion": lambda spark, sf_dir: reverting(own(spark, sf_dir), BAND),
        "kalman_deviation": lambda spark, sf_dir: filtered(own(spark, sf_dir), F.ln("close"), F.lit(0.0), BAND).select("symbol", F.col("ts").cast("string").alias("ts"), F.round("estimate", 9).alias("estimate")),
        "oracle_sharpes": _oracles,
        "null_bootstrap": lambda spark, sf_dir: bootstrap(own(spark, sf_dir)),
    }


BAND = Band(5.0)


def oracle_sql() -> dict[str, str]:
    """The filter as a fold over each symbol's returns."""
    keeps = BAND.rho + BAND.gain * (1 - BAND.rho)
    fold = f"list_reduce(list_concat([[0.0]], list_transform(moves, lambda v: [v])), lambda a, v: list_append(a, {keeps!r} * a[-1] + {BAND.gain!r} * v[1]))"
    return {
        "kalman_deviation": f"""SELECT symbol, CAST(ts AS VARCHAR) AS ts, round(estimate, 9) AS estimate FROM (SELECT symbol, unnest(tss) AS ts, unnest({fold}) AS estimate FROM
            (SELECT symbol, list(ts ORDER BY ts) AS tss, list(moved ORDER BY ts) FILTER (moved IS NOT NULL) AS moves FROM (SELECT symbol, ts, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY ts)) AS moved FROM {BARS.sql}) GROUP BY symbol))"""
    }


def _oracles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gross, net and achievable oracle of each half-life."""
    parts = []
    for half_life in (1.0, 5.0, 20.0):
        bars = reverting(BARS.frame(spark, sf_dir), Band(half_life))
        for kind, mean, cost in (("gross", "oracle_mean", 0.0), ("net", "oracle_mean", COST), ("achievable", "achievable_mean", COST)):
            parts.append(oracle_sharpe(bars, mean, cost).select(F.lit(half_life).alias("half_life"), F.lit(kind).alias("kind"), "symbol", "n", F.round("sharpe", 6).alias("sharpe")))
    return reduce(DataFrame.unionByName, parts)
