"""How often the gate lets something through: the unmodified search on symbols without an edge, and with a planted one."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.operators.factors import ALL_BARS
from quantloom.operators.grid import CATALOG
from quantloom.operators.kernel import YEAR
from quantloom.operators.pool import null_bar
from quantloom.operators.simulation import autocorrelated
from quantloom.operators.statistics import SQUARED
from quantloom.plans import search
from quantloom.plans.search import Gate


def judged(bars: DataFrame, names: Iterable[str] = tuple(CATALOG), gate: Gate = Gate(), *, refine: bool = True, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Verdicts of the search on every symbol of ``bars``, plus bar (of all symbols that could be searched) and clears.

    A symbol that is too short to be split has no verdict and does not count.
    """
    _, verdicts = search.search(bars, names, gate, refine=refine, keep=keep)
    verdicts = keep(verdicts)
    size = F.broadcast(verdicts.agg(F.count("*").alias("n_symbols")))
    known = verdicts.crossJoin(size).withColumn("years", F.col("holdout_bars") / YEAR)
    known = known.withColumn("bar", null_bar(F.col("n_symbols"), F.col("years")))
    return known.withColumn("clears", F.col("passed") & (F.col("holdout_sharpe") > F.col("bar")))


def calibrated(verdicts: DataFrame) -> DataFrame:
    """One row: symbols, graduates, their rate, those over the bar, the bar at the median holdout, and the greatest statistics."""
    return verdicts.agg(
        F.count("*").alias("n_symbols"), F.count_if("passed").alias("n_graduates"), F.avg(F.col("passed").cast("double")).alias("graduation_rate"), F.count_if("clears").alias("n_clear"),
        null_bar(F.count("*"), F.median("years")).alias("bar"), F.max("margin").alias("max_margin"), F.max(F.when(F.col("passed"), F.col("holdout_sharpe"))).alias("max_holdout"),
        F.median("walk_oos").alias("walk_median"), F.median("purged_oos").alias("purged_median"),
    )


def power(verdicts: DataFrame, oracle: DataFrame) -> DataFrame:
    """One row: the rate of detection of a planted edge, and the finalists' median over the median of ``oracle(symbol, sharpe)``.

    The capture is null where the oracle's own median is within its standard error of nothing.
    """
    both = verdicts.join(oracle.select("symbol", F.col("sharpe").alias("oracle")), "symbol")
    error = F.sqrt((1 + F.pow(F.median("oracle"), 2) / SQUARED) / F.median("years"))
    return both.agg(
        F.count("*").alias("n_symbols"), F.avg(F.col("passed").cast("double")).alias("detected"), F.count_if("clears").alias("n_clear"),
        F.when(F.median("oracle") > error, F.median("holdout_sharpe") / F.median("oracle")).alias("capture"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    six = lambda df: df.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in df.dtypes])
    run = lambda s, d, phi: judged(autocorrelated(ALL_BARS.frame(s, d), phi=phi), keep=search._kept)
    return {
        "calibrate_gate": lambda s, d: six(calibrated(run(s, d, 0.0))),
        "measure_power": lambda s, d: six(calibrated(run(s, d, 0.3))),
    }
