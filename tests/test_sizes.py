"""Ties, and what a task or an exchange holds as tables grow."""

import pytest
from pyspark.sql import functions as F

from quantloom import catalog
from quantloom.operators import pool, quality_checks
from quantloom.operators.grid import CATALOG
from quantloom.plans import calibration, search
from quantloom.sources import bars
from quantloom.sources.bars import BARS

SF = "/root/testdata/sf0.001"


def test_best_trial_of_ties_is_the_same_in_any_order(spark):
    rows = [(1, "A-1", 0.5, 0.3), (1, "A-1", 0.5, -0.2), (1, "A-1", 0.5, None), (1, "B-1", 0.5, -1.0), (1, "A-0", None, -3.0), (2, "A-1", None, 1.0)]
    for own in (rows, rows[::-1]):
        trials = spark.createDataFrame(own, "experiment_id long, family string, deflated double, walk_oos double").coalesce(1)
        assert {r.experiment_id: tuple(r.best) for r in pool.best_trials(trials).collect()} == {1: ("A-1", 0.5, -0.2), 2: ("A-1", None, 1.0)}


def test_splits_of_the_segments_are_not_exchanged(spark):
    rows = spark.range(400).selectExpr("'A' AS symbol", "'f' AS family", "CAST(id % 4 AS int) AS config", "CAST(id div 4 AS int) AS i", "100L AS n", "sin(id) AS net")
    plan = search.overfitting(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Broadcast") < plan.index("hashpartitioning")


def test_searched_bars_are_made_once(spark):
    verdicts = search.search(BARS.frame(spark, SF), ("sma",), search.Gate(budget=4), refine=False, keep=lambda df: df.localCheckpoint())[1]
    assert verdicts.count() > 0 and "parquet" not in verdicts._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", ["calibrate_gate", "measure_power"])
def test_calibrations_search_the_whole_catalog(spark, monkeypatch, name):
    searched = []

    def caught(own, names, gate, *, refine, keep):
        searched.append((set(names), gate, refine))
        rows = own.groupBy("symbol").agg(F.lit(True).alias("passed"), F.count("*").alias("holdout_bars"))
        return own, rows.withColumns({c: F.lit(1.0) for c in ("holdout_sharpe", "margin", "walk_oos", "purged_oos")})

    monkeypatch.setattr(search, "search", caught)
    assert calibration.queries()[name](spark, SF).columns[0] == "n_symbols"
    assert searched == [(set(CATALOG), search.Gate(budget=200), True)]


def _exchanges(df):
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "hashpartitioning" in line]


def _dealt_by(df, key):
    """Exchanges by a key are for a number of rows, not for the session's number of partitions."""
    own = [line for line in _exchanges(df) if f"hashpartitioning({key}" in line]
    return own and all("REPARTITION_BY_NUM" in line for line in own)


def test_tasks_grow_with_the_rows(spark):
    least = spark.sparkContext.defaultParallelism
    assert (bars.tasks_of(spark.range(10)), bars.tasks_of(spark.range(100 * bars.TASK_ROWS + 1))) == (least, 101)


def test_merged_trials_are_dealt_by_rows(spark):
    grouped = pool.trials(spark, SF).groupBy("experiment_id").count()
    assert _dealt_by(grouped, "experiment_id")


def test_checked_bars_are_dealt_by_rows(spark):
    assert _dealt_by(quality_checks._issues(spark, SF), "symbol")


def test_tape_is_dealt_by_rows(spark):
    own = _exchanges(catalog.queries()["tape_average"](spark, SF))
    wide = [line for line in own if "_bucket" in line and "chunk" not in line]
    assert any("REPARTITION_BY_NUM" in line for line in wide) and sum("REPARTITION_BY_NUM" in line for line in own) >= 2
