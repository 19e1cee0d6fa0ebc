"""Positions tested forward: each by what came after the day it was frozen, and bars that are not closed yet."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.functions.windows import compounded
from quantloom.operators.kernel import YEAR, run
from quantloom.plans.engine import _SPARK, render


def evaluated(positions: DataFrame, returns: DataFrame) -> DataFrame:
    """``positions(symbol, frozen_at, ...)`` plus forward_bars, as_of, forward and holding returns and ratios, and whether it beats holding.

    ``returns(symbol, ts, net, ret)`` are computed over the whole history, so no indicator restarts; rows up to the freeze do not count. A position without
    any bar since has 0 bars, nothing earned, and does not beat.
    """
    after = returns.join(positions.select("symbol", "frozen_at").distinct(), "symbol").where(F.col("ts") > F.col("frozen_at"))
    sharpe = lambda x: F.coalesce(F.when(F.stddev_samp(x) > 1e-12, math.sqrt(YEAR) * F.avg(x) / F.stddev_samp(x)), F.lit(0.0))
    total = lambda x: F.expr(render(compounded(x), _SPARK))
    scores = after.groupBy("symbol", "frozen_at").agg(
        F.count("*").alias("forward_bars"), F.max("ts").alias("as_of"), total("net").alias("forward_return"), sharpe("net").alias("forward_sharpe"), total("ret").alias("held_return"), sharpe("ret").alias("held_sharpe"),
    )
    both = positions.join(scores, ["symbol", "frozen_at"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    known: list[Column] = [F.coalesce("forward_bars", F.lit(0)).cast("long").alias("forward_bars"), "as_of", *map(zero, ("forward_return", "forward_sharpe", "held_return", "held_sharpe"))]
    return both.select(*positions.columns, *known).withColumn("beats_held", F.col("forward_sharpe") > F.col("held_sharpe"))


def closed(bars: DataFrame, as_of: Column) -> DataFrame:
    """Bars of days before ``as_of``'s: that day's own is not closed yet. None left is an error."""
    left = bars.where(F.col("ts").cast("date") < as_of.cast("date"))
    if left.isEmpty():
        raise ValueError("no bar is closed yet")
    return left


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
        book = run("sma").frame(spark, sf_dir)
        own = book.groupBy("symbol").agg(F.date_add(F.min("ts"), 500 + 100 * F.length("symbol")).alias("frozen_at"))
        return evaluated(own, book).select("symbol", F.col("frozen_at").cast("string").alias("frozen_at"), "forward_bars", F.col("as_of").cast("string").alias("as_of"),
            *[F.round(c, 6).alias(c) for c in ("forward_return", "forward_sharpe", "held_return", "held_sharpe")], "beats_held")

    return {"forward_positions": positions}


def oracle_sql() -> dict[str, str]:
    sharpe = lambda x: f"coalesce(CASE WHEN stddev_samp({x}) > 1e-12 THEN {math.sqrt(YEAR)!r} * avg({x}) / stddev_samp({x}) END, 0.0)"
    return {
        "forward_positions": f"""WITH b AS MATERIALIZED (SELECT symbol, ts, net, ret FROM {run('sma').sql}), p AS (SELECT symbol, CAST(min(ts) + INTERVAL 1 DAY * (500 + 100 * length(symbol)) AS DATE) AS frozen_at FROM b GROUP BY symbol),
            s AS (SELECT p.symbol, frozen_at, count(b.ts) AS forward_bars, max(ts) AS as_of, coalesce(product(1 + net) - 1, 0.0) AS forward_return, {sharpe('net')} AS forward_sharpe, coalesce(product(1 + ret) - 1, 0.0) AS held_return, {sharpe('ret')} AS held_sharpe
                FROM p LEFT JOIN b ON b.symbol = p.symbol AND b.ts > p.frozen_at GROUP BY p.symbol, frozen_at)
            SELECT symbol, CAST(frozen_at AS VARCHAR) AS frozen_at, forward_bars, CAST(as_of AS VARCHAR) AS as_of, round(forward_return, 6) AS forward_return, round(forward_sharpe, 6) AS forward_sharpe,
                round(held_return, 6) AS held_return, round(held_sharpe, 6) AS held_sharpe, forward_sharpe > held_sharpe AS beats_held FROM s"""
    }
