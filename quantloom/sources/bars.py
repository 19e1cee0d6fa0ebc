"""Bars of the driver's tables: one OHLCV row per symbol and day, from line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.plans.engine import Base

#: A total order of the trades of a day.
ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that a task takes of a table that is dealt out by key.
TASK_ROWS = 250_000


def tasks_of(rows: DataFrame) -> int:
    """Tasks for a table's rows: as many as there are cores, and more as it grows. What is counted is a scan, which reads no column."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // TASK_ROWS))


def ohlcv(trades: DataFrame, symbol: str, price: str) -> DataFrame:
    """One shuffle with map-side partial aggregates; the scan reads only what is used."""
    key = F.struct(*ORDER)
    return (
        trades.withColumns({"symbol": F.expr(symbol), "ts": F.col("l_shipdate").cast("date"), "px": F.expr(price), "k": key})
        .groupBy("symbol", "ts")
        .agg(
            F.min_by("px", "k").alias("open"), F.max("px").alias("high"), F.min("px").alias("low"),
            F.max_by("px", "k").alias("close"), F.sum("l_quantity").alias("volume"),
        )
    )


def _sql(symbol: str, price: str) -> str:
    by = ", ".join(ORDER)
    return (
        f"(SELECT symbol, ts, first(px ORDER BY {by}) AS open, max(px) AS high, min(px) AS low, last(px ORDER BY {by}) AS close, sum(l_quantity) AS volume "
        f"FROM (SELECT *, {symbol} AS symbol, CAST(l_shipdate AS DATE) AS ts, {price} AS px FROM lineitem) GROUP BY symbol, ts)"
    )


_FLAG_SQL = "l_returnflag || l_linestatus"
_EQUITY = "100 + l_extendedprice / 100000.0"
_UNIT = "l_extendedprice / l_quantity"

#: Equity-like prices: symbols are return flag and line status.
BARS = Base(
    lambda spark, sf_dir: ohlcv(table(spark, sf_dir, "lineitem"), _FLAG_SQL, _EQUITY),
    _sql(_FLAG_SQL, _EQUITY),
)
#: Unit prices, with gaps and jumps, for the data-quality checks.
RAW_BARS = Base(
    lambda spark, sf_dir: ohlcv(table(spark, sf_dir, "lineitem"), _FLAG_SQL, _UNIT),
    _sql(_FLAG_SQL, _UNIT),
)


def from_table(name: str) -> Base:
    return Base(lambda spark, sf_dir: table(spark, sf_dir, name), name)
