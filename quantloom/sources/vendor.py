"""Vendors of bars as a Spark data source: a partition a symbol, fetched by the task that reads it.

What a query asks of symbol and ts reaches the vendor as symbols and one half-open range of dates, so that nothing is fetched to be
thrown away. A symbol that fails stops the read with its name; a hunt that wants to go on without it screens first.
"""

from __future__ import annotations

import datetime as dt
from abc import ABC, abstractmethod
from collections.abc import Iterable, Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
)

BARS = "symbol string, ts date, open double, high double, low double, close double, adj_close double, volume double"
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
FIRST, LAST = dt.date(1, 1, 1), dt.date(9999, 12, 31)
_DAY = dt.timedelta(days=1)


class Vendor(ABC):
    """What a vendor has to offer; it travels to the tasks."""

    version: str

    @abstractmethod
    def symbols(self) -> list[str]: ...

    @abstractmethod
    def fetch(self, symbol: str, start: dt.date, end: dt.date) -> Iterable[tuple]:
        """(ts, open, high, low, close, adj_close, volume) of start <= ts < end; failures are OSError."""


class Wanted(InputPartition):
    def __init__(self, symbol: str) -> None:
        super().__init__(symbol)
        self.symbol = symbol


class BarsReader(DataSourceReader):
    def __init__(self, vendor: Vendor) -> None:
        self.vendor, self.only, self.start, self.end = vendor, None, FIRST, LAST

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Takes what bounds symbol and ts; gives the rest back to Spark."""
        for f in filters:
            if not self._takes(f):
                yield f

    def _takes(self, f: Filter) -> bool:
        match f:
            case IsNotNull(("symbol",)) | IsNotNull(("ts",)):
                pass
            case EqualTo(("symbol",), value):
                self._keep({value})
            case In(("symbol",), values):
                self._keep(set(values))
            case EqualTo(("ts",), day):
                self._within(day, day + _DAY)
            case GreaterThanOrEqual(("ts",), day):
                self._within(day, LAST)
            case GreaterThan(("ts",), day):
                self._within(day + _DAY, LAST)
            case LessThan(("ts",), day):
                self._within(FIRST, day)
            case LessThanOrEqual(("ts",), day):
                self._within(FIRST, day + _DAY)
            case _:
                return False
        return True

    def _keep(self, symbols: set[str]) -> None:
        self.only = symbols if self.only is None else self.only & symbols

    def _within(self, start: dt.date, end: dt.date) -> None:
        self.start, self.end = max(self.start, start), min(self.end, end)

    def partitions(self) -> list[InputPartition]:
        known = self.vendor.symbols()
        return [Wanted(s) for s in known if self.only is None or s in self.only] if self.start < self.end else []

    def read(self, partition: Any) -> Iterator[tuple]:
        if partition is None:  # nothing is wanted
            return
        try:
            for ts, *values in self.vendor.fetch(partition.symbol, self.start, self.end):
                yield (partition.symbol, ts, *values)
        except OSError as error:
            raise OSError(f"{partition.symbol}: {error}") from error


def register(spark: SparkSession, name: str, vendor: Vendor) -> None:
    """Makes ``spark.read.format(name)`` read the vendor's bars, and lets filters through to it."""

    class Bars(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return BARS

        def reader(self, schema: Any) -> DataSourceReader:
            return BarsReader(vendor)

    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(Bars)


def bars(spark: SparkSession, name: str) -> DataFrame:
    return spark.read.format(name).load()
