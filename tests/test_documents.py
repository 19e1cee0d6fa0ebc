"""Nested documents: scans of files, pruned reads, a store whose writes are whole or not there."""

import json

import pytest
from pyspark.sql import functions as F

from quantloom.operators import pool
from quantloom.sources import documents
from quantloom.sources.documents import DocumentStore

CURVE = "date string, equity double, cash double, benchmark double"


def experiment(k, symbol="A", **more):
    trial = {"strategy_name": "sma", "parameters": {"fast": 5, "slow": 20}, "observed_sharpe": 1.0, "deflated_sharpe": 0.5, "pbo": 0.2, "parameter_stability_score": 0.7}
    return {"experiment_id": f"e{k}", "created_at": f"2024-01-{k + 1:02d}T00:00:00Z", "symbol": symbol, "strategy_names": ["sma"], "trials": [trial, {**trial, "strategy_name": "adx", "n_evaluated_configs": 7, "walk_forward_oos_sharpe": -0.25}], "lifetime_trials": 10 * k, **more}


@pytest.fixture
def files(tmp_path):
    won = {"graduate": {"strategy_name": "sma", "parameters": {"fast": 5}, "gate_result": {"passed": True, "reasons": []}, "holdout_sharpe": 1.5, "holdout_total_return": 0.2, "holdout_n_bars": 300}, "n_bars": 900, "search_config_version": "v2"}
    a, b = [experiment(0), experiment(1, **won)], [experiment(2, "B", unknown_field={"x": 1})]
    (tmp_path / "pool.json").write_text(json.dumps(a + b, indent=2) + "\n")
    (tmp_path / "parts").mkdir()
    (tmp_path / "parts" / "A.json").write_text(json.dumps(a, indent=2) + "\n")
    (tmp_path / "parts" / "B.json").write_text(json.dumps(b))
    return tmp_path


def test_files_and_folders_hold_the_same_pool(spark, files):
    one, many = (documents.scan(spark, str(files / p), documents.EXPERIMENT) for p in ("pool.json", "parts"))
    rows = sorted(map(tuple, documents.experiments(one).collect()))
    assert rows == sorted(map(tuple, documents.experiments(many).collect()))
    assert rows[0][3:] == ("legacy-unspecified", 0, None, False, None, None) and rows[1][3:] == ("v2", 10, 900, True, 1.5, 300)
    trials = documents.trials(many)
    assert {(r.experiment_id, r.family, r.n_configs, r.walk_oos) for r in trials.collect()} == {(f"e{k}", f, n, w) for k in range(3) for f, n, w in (("sma", 1, None), ("adx", 7, -0.25))}
    assert documents.latest(one).first().experiment_id == "e2" and documents.latest(one.limit(0)).collect() == []
    assert documents.scan(spark, str(files / "nothing.json"), documents.EXPERIMENT).collect() == []
    assert {(r.symbol, r.trials) for r in pool.prior_trials(documents.experiments(one)).collect()} == {("A", 10), ("B", 20)}


def test_positions_and_points(spark, tmp_path):
    (tmp_path / "book.json").write_text(json.dumps([{"symbol": "A", "strategy_name": "sma", "parameters": {"fast": 5}, "frozen_at": "2024-01-01", "score": {"forward_bars": 9, "forward_sharpe": 0.5}}, {"symbol": "B", "strategy_name": "adx", "status": "closed", "exit_reasons": ["decayed"]}]))
    book = {r.symbol: r for r in documents.scan(spark, str(tmp_path / "book.json"), documents.POSITION).collect()}
    assert book["A"].score.forward_bars == 9 and book["A"].parameters == {"fast": 5.0} and book["B"].exit_reasons == ["decayed"]
    curve = DocumentStore(spark, str(tmp_path / "curve"), CURVE, ("date",))
    point = lambda d, e: spark.createDataFrame([(d, e, 0.0, None)], CURVE)
    for p in (point("2024-01-01", 1.0), point("2024-01-02", 2.0), point("2024-01-02", 3.0), point("2024-01-02", 3.0)):
        documents.append_point(curve, p)
    assert sorted((r.date, r.equity) for r in curve.read().collect()) == [("2024-01-01", 1.0), ("2024-01-02", 3.0)]


def test_store_reads_only_the_nested_fields_that_are_asked_for(spark, files, tmp_path):
    store = DocumentStore(spark, str(tmp_path / "store"), documents.EXPERIMENT, ("experiment_id",))
    assert store.read().collect() == []
    store.add(documents.scan(spark, str(files / "parts"), documents.EXPERIMENT))
    plan = store.read().selectExpr("explode(trials.strategy_name) AS family")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<trials:array<struct<strategy_name:string>>>" in plan
    assert store.read().count() == 3


def test_adds_are_whole_and_refuse_repeats(spark, files, tmp_path, monkeypatch):
    store = DocumentStore(spark, str(tmp_path / "store"), documents.EXPERIMENT, ("experiment_id",))
    rows = documents.scan(spark, str(files / "pool.json"), documents.EXPERIMENT)
    store.add(rows.where("symbol = 'A'"))
    with pytest.raises(ValueError, match="already"):
        store.add(rows)
    with pytest.raises(ValueError, match="twice"):
        store.add(rows.where("symbol = 'B'").unionByName(rows.where("symbol = 'B'")))
    assert store.read().count() == 2  # the refused writes left folders, but no commits
    monkeypatch.setattr(DocumentStore, "_commit", lambda *_: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        store.add(rows.where("symbol = 'B'"))
    monkeypatch.undo()
    assert store.read().count() == 2
    (tmp_path / "store" / "commits" / "000000000001").write_text('{"kind": "ad')  # a writer that died while committing
    assert store.read().count() == 2
    store.add(rows.where("symbol = 'B'"))
    assert store.read().count() == 3 and [c["number"] for c in store.commits()] == [0, 2]


def test_of_two_writers_of_one_id_one_fails(spark, files, tmp_path):
    first, second = (DocumentStore(spark, str(tmp_path / "store"), documents.EXPERIMENT, ("experiment_id",)) for _ in range(2))
    rows = documents.scan(spark, str(files / "pool.json"), documents.EXPERIMENT)
    real, raced = second._commit, []

    def late(number, record):
        if not raced:  # the other writer commits between this one's check and its commit
            raced.append(number)
            first.add(rows.where("experiment_id = 'e0'"))
        return real(number, record)

    second._commit = late
    with pytest.raises(ValueError, match="already"):
        second.add(rows)
    assert raced == [0] and first.read().count() == 1
    second.add(rows.where("experiment_id <> 'e0'"))
    assert first.read().count() == 3


def test_put_and_retain(spark, files, tmp_path):
    store = DocumentStore(spark, str(tmp_path / "store"), documents.EXPERIMENT, ("experiment_id",))
    rows = documents.scan(spark, str(files / "pool.json"), documents.EXPERIMENT)
    for _ in range(2):
        store.put(rows)
    store.put(rows.where("experiment_id = 'e1'").withColumn("rationale", rows.symbol))
    got = {r.experiment_id: r.rationale for r in store.read().collect()}
    assert got == {"e0": None, "e1": "A", "e2": None}
    store.retain(F.col("graduate").isNotNull() | (F.col("symbol") == "B"))
    assert {r.experiment_id for r in store.read().collect()} == {"e1", "e2"} and store.commits()[-1]["kind"] == "base"
    store.add(rows.where("experiment_id = 'e0'"))
    assert store.read().count() == 3


def test_targets_and_closes(spark):
    positions = spark.createDataFrame([("A", "open"), ("B", "open"), ("C", "closed"), ("D", "open"), ("E", "open")], "symbol string, status string")
    signals = spark.createDataFrame([("A", 1.0, 30.0), ("B", -1.0, 7.0), ("C", 1.0, 5.0), ("E", 0.0, 5.0)], "symbol string, position double, close double")
    assert sorted(map(tuple, documents.targets(positions, signals, 1000.0).collect())) == [("A", "buy", 16), ("B", "sell", -71)]
    bars = spark.createDataFrame([("A", 2, 5.0), ("A", 1, 4.0), ("B", 1, None), ("B", 2, 6.0)], "symbol string, ts int, close double")
    assert [tuple(r) for r in documents.closes(bars).collect()] == [("A", 1, 4.0), ("A", 2, 5.0), ("B", 2, 6.0)]
    assert [r.close for r in documents.closes(bars, "A").collect()] == [4.0, 5.0]


def test_least_yield(spark):
    rates = lambda x: spark.createDataFrame([("r", 4, x)], "run string, attempted int, rate double")
    assert pool.require_yield(rates(0.25)).first().rate == 0.25
    with pytest.raises(Exception, match="too low in run r"):
        pool.require_yield(rates(0.24)).collect()
