"""Universes from text files, and the contract of a bars source."""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TICKER = "^[A-Z]{1,5}([.-][A-Z])?$"


class BarsSource(ABC):
    """Bars of a symbol in [start, end), as (symbol, ts, open, high, low, close, adj_close, volume); failures are OSError."""

    adapter_version: str

    @abstractmethod
    def bars(self, spark: SparkSession, symbol: str, start: str, end: str) -> DataFrame: ...


class ParquetBars(BarsSource):
    """A store partitioned by symbol: symbol prunes its partitions, the range is pushed down to the files."""

    adapter_version = "parquet-1"

    def __init__(self, path: str) -> None:
        self.path = path

    def bars(self, spark: SparkSession, symbol: str, start: str, end: str) -> DataFrame:
        stored = spark.read.parquet(self.path)
        return stored.where((F.col("symbol") == symbol) & (F.col("ts") >= F.lit(start).cast("date")) & (F.col("ts") < F.lit(end).cast("date"))).orderBy("ts")


def _symbols(spark: SparkSession, path: str | list[str]) -> DataFrame:
    lines = spark.read.text(path).select(F.upper(F.trim("value")).alias("symbol"), F.monotonically_increasing_id().alias("line"))
    return lines.where("symbol <> ''")


def load_universe(spark: SparkSession, path: str, *, well_formed: bool = False) -> DataFrame:
    """(symbol) of a file with one ticker a line: trimmed, upper-cased, each once, in the order first seen."""
    first = _symbols(spark, path).groupBy("symbol").agg(F.min("line").alias("line"))
    return (first.where(F.col("symbol").rlike(TICKER)) if well_formed else first).orderBy("line").select("symbol")


def merge_universes(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The sorted union of several files' symbols."""
    return _symbols(spark, paths).select("symbol").distinct().orderBy("symbol")
