"""A vendor as a data source: partitions by symbol, filters that reach the fetch."""

import datetime as dt
import json
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from quantloom.sources import vendor

START = dt.date(2024, 1, 1)
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Recorded(vendor.Vendor):
    """Thirty bars a symbol; every fetch is written down where the test can see it."""

    version = "recorded-1"

    def __init__(self, folder):
        self.folder = folder

    def symbols(self):
        return ["AAA", "BBB", "CCC", "DOWN"]

    def fetch(self, symbol, start, end):
        with open(f"{self.folder}/{symbol}-{start}-{end}.json", "w") as f:
            json.dump([symbol, str(start), str(end)], f)
        if symbol == "DOWN":
            raise OSError("throttled")
        for k in range(30):
            day = START + dt.timedelta(days=k)
            if start <= day < end:
                yield (day, 1.0, 2.0, 0.5, float(k), float(k), 10.0)


@pytest.fixture
def source(spark, tmp_path):
    name = f"recorded_{tmp_path.name}"
    vendor.register(spark, name, Recorded(str(tmp_path)))
    return vendor.bars(spark, name), lambda: sorted(json.loads(p.read_text()) for p in tmp_path.glob("*.json"))


def test_only_what_is_asked_for_is_fetched(source):
    bars, fetched = source
    asked = bars.where((F.col("symbol").isin("AAA", "CCC")) & (F.col("ts") >= F.lit("2024-01-05").cast("date")) & (F.col("ts") < F.lit("2024-01-08").cast("date")))
    assert asked.rdd.getNumPartitions() == 2
    rows = sorted((r.symbol, str(r.ts), r.close) for r in asked.collect())
    assert rows == [(s, f"2024-01-0{d}", d - 1.0) for s in ("AAA", "CCC") for d in (5, 6, 7)]
    assert fetched() == [["AAA", "2024-01-05", "2024-01-08"], ["CCC", "2024-01-05", "2024-01-08"]]
    plan = asked._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan.split("BatchScan")[0]  # the vendor has done all of it


def test_other_filters_stay_with_spark(source):
    bars, fetched = source
    got = bars.where("symbol = 'BBB' AND ts = DATE '2024-01-03' OR symbol = 'BBB' AND close > 28").where("symbol = 'BBB' AND ts > DATE '2024-01-02'")
    assert sorted(str(r.ts) for r in got.collect()) == ["2024-01-03", "2024-01-30"]
    assert fetched() == [["BBB", "2024-01-03", "9999-12-31"]]
    assert bars.where("symbol = 'ZZZ'").collect() == [] and bars.where("symbol = 'AAA' AND ts > DATE '2024-02-01' AND ts < DATE '2024-01-01'").collect() == []


def test_a_failing_symbol_is_named(source):
    with pytest.raises(Exception, match="DOWN: throttled"):
        source[0].where("symbol = 'DOWN'").collect()
