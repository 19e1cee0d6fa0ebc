"""Nested research documents: experiments with their trials, positions with their scores, equity points, calibrations.

Documents are read with one schema each, whatever fields a file lacks, and an explode of one nested field reads that field
alone. ``DocumentStore`` keeps them in Parquet behind a log of commits: a write adds a folder of data, and is there for
readers only once its commit is; commits are numbered and each number is created once, so of two writers of one number the later
sees what the earlier has added, and checks again.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The names of the documents' fields, which files that exist already have.

TRIAL = (
    "strategy_name: string, parameters: map<string, double>, observed_sharpe: double, deflated_sharpe: double, pbo: double, parameter_stability_score: double, "
    "n_evaluated_configs: bigint, walk_forward_oos_sharpe: double, purged_cv_oos_sharpe: double, deflated_sharpe_probability: double"
)
GATE = "passed: boolean, dsr_ok: boolean, pbo_ok: boolean, stability_ok: boolean, mintrl_ok: boolean, holdout_ok: boolean, beats_buy_and_hold_ok: boolean, required_track_record_years: double, gate_config_version: string, reasons: array<string>"
GRADUATE = f"strategy_name: string, parameters: map<string, double>, gate_result: struct<{GATE}>, holdout_sharpe: double, holdout_total_return: double, holdout_n_bars: bigint"
EXPERIMENT = (
    "experiment_id string, created_at string, symbol string, strategy_names array<string>, gate_config struct<dsr_min: double, pbo_max: double, stability_min: double, holdout_sharpe_min: double, "
    f"require_beat_buy_and_hold: boolean, trial_budget: bigint>, trials array<struct<{TRIAL}>>, lifetime_trials bigint, best_strategy_name string, best_gate_result struct<{GATE}>, "
    f"graduate struct<{GRADUATE}>, search_config_version string, n_bars bigint, rationale string"
)
SCORE = "forward_bars: bigint, forward_return: double, forward_sharpe: double, buy_and_hold_return: double, buy_and_hold_sharpe: double, beats_buy_and_hold: boolean, as_of: string"
POSITION = (
    f"symbol string, strategy_name string, parameters map<string, double>, frozen_at string, score struct<{SCORE}>, status string, closed_at string, exit_reasons array<string>, "
    "survives_universe_deflation boolean, universe_deflation_bar double, universe_n_symbols bigint"
)
#: What a record that was written before a field had it counts as.
OLD_VERSION = "legacy-unspecified"
OLD_CONFIGS = 1


def scan(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The documents of a JSON file, or of all files of a folder (one a symbol), each a list of them; nothing where there is no such path."""
    return spark.read.schema(schema).json(path, multiLine=True) if _exists(spark, path) else spark.createDataFrame([], schema)


def parsed(texts: DataFrame, column: str, schema: str) -> DataFrame:
    """Documents that are held as text, one a row; what is no document is left out."""
    rows = texts.select(F.from_json(column, schema).alias("d")).select("d.*")
    return rows.where(F.col(rows.columns[0]).isNotNull())


def experiments(documents: DataFrame) -> DataFrame:
    """One row an experiment, as the pool's operators take it."""
    return documents.select(
        "experiment_id", "symbol", F.col("created_at").alias("created"), F.coalesce("search_config_version", F.lit(OLD_VERSION)).alias("version"), "lifetime_trials", "n_bars",
        F.col("graduate").isNotNull().alias("graduated"), F.col("graduate.holdout_sharpe").alias("holdout_sharpe"), F.col("graduate.holdout_n_bars").alias("holdout_bars"),
    )


def trials(documents: DataFrame) -> DataFrame:
    """One row a trial: only the fields that are asked for are read of the nested ones."""
    each = documents.select("experiment_id", "symbol", F.explode("trials").alias("t"))
    return each.select(
        "experiment_id", "symbol", F.col("t.strategy_name").alias("family"), F.col("t.observed_sharpe").alias("observed"), F.col("t.deflated_sharpe").alias("deflated"),
        F.col("t.walk_forward_oos_sharpe").alias("walk_oos"), F.col("t.purged_cv_oos_sharpe").alias("purged_oos"), F.coalesce("t.n_evaluated_configs", F.lit(OLD_CONFIGS).cast("long")).alias("n_configs"),
    )


def latest(documents: DataFrame) -> DataFrame:
    """The document that was created last (ties by id); none of none."""
    return documents.orderBy(F.desc("created_at"), F.desc("experiment_id")).limit(1)


class Conflict(Exception):
    """The commit of this number is another writer's."""


def _path(spark: SparkSession, path: str) -> tuple[object, object]:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _exists(spark: SparkSession, path: str) -> bool:
    fs, where = _path(spark, path)
    return fs.exists(where)


@dataclass
class DocumentStore:
    """Documents of one schema with a key of their own, in ``path``/data, behind the commits of ``path``/commits."""

    spark: SparkSession
    path: str
    schema: str
    key: tuple[str, ...]

    def commits(self) -> list[dict]:
        """The log in order: small records, one a write. One that a writer has not finished is not there yet."""
        folder = f"{self.path}/commits"
        if not _exists(self.spark, folder):
            return []
        rows = self.spark.read.text(folder, wholetext=True).select("value", F.col("_metadata.file_name").alias("file")).collect()
        return [{**json.loads(r["value"]), "number": int(r["file"])} for r in sorted(rows, key=lambda r: r["file"]) if r["value"].endswith("\n")]

    def _next(self) -> int:
        folder = f"{self.path}/commits"
        if not _exists(self.spark, folder):
            return 0
        fs, where = _path(self.spark, folder)
        return max([int(f.getPath().getName()) for f in fs.listStatus(where)], default=-1) + 1

    def _commit(self, number: int, record: dict) -> None:
        fs, where = _path(self.spark, f"{self.path}/commits/{number:012d}")
        try:
            out = fs.create(where, False)
        except Py4JJavaError as error:
            if fs.exists(where):
                raise Conflict(number) from error
            raise
        out.write(bytearray((json.dumps(record) + "\n").encode()))
        out.close()

    def _written(self, rows: DataFrame) -> str:
        name = uuid.uuid4().hex
        rows.select(*[F.col(f.name).cast(f.dataType) for f in self._fields()]).write.parquet(f"{self.path}/data/{name}")
        return name

    def _fields(self) -> list:
        return self.spark.createDataFrame([], self.schema).schema.fields

    def _keys_repeat(self, rows: DataFrame) -> bool:
        return not rows.groupBy(*self.key).count().where("count > 1").isEmpty()

    def read(self) -> DataFrame:
        """What is committed: of rows that were put anew the last."""
        log = self.commits()
        start = max([i for i, c in enumerate(log) if c["kind"] == "base"], default=0)
        log = log[start:]
        if not log:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.schema).parquet(*[f"{self.path}/data/{c['folder']}" for c in log])
        if all(c["kind"] != "put" for c in log):
            return rows
        names = self.spark.createDataFrame([(c["folder"], k) for k, c in enumerate(log)], "_folder string, _nth int")
        marked = rows.withColumn("_folder", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)).join(F.broadcast(names), "_folder")
        last = Window.partitionBy(*self.key)
        return marked.withColumn("_last", F.max("_nth").over(last)).where("_nth = _last").select(*rows.columns)

    def add(self, rows: DataFrame) -> None:
        """All rows or none: a key that is there already, or comes twice, is an error."""
        folder = self._written(rows)
        new = self.spark.read.schema(self.schema).parquet(f"{self.path}/data/{folder}")
        if self._keys_repeat(new):
            raise ValueError(f"a key of {self.key} comes twice")
        while True:
            number = self._next()
            if not self.read().join(new.select(*self.key), list(self.key), "left_semi").isEmpty():
                raise ValueError(f"a key of {self.key} is in {self.path} already")
            try:
                return self._commit(number, {"kind": "add", "folder": folder})
            except Conflict:
                continue

    def put(self, rows: DataFrame) -> None:
        """Rows by key, over those that are there: the same put twice is one."""
        folder = self._written(rows)
        if self._keys_repeat(self.spark.read.schema(self.schema).parquet(f"{self.path}/data/{folder}")):
            raise ValueError(f"a key of {self.key} comes twice")
        while True:
            try:
                return self._commit(self._next(), {"kind": "put", "folder": folder})
            except Conflict:
                continue

    def retain(self, kept: Column) -> None:
        """Rewrites the store to the rows that a condition keeps; fails if something was written meanwhile."""
        number = self._next()
        folder = self._written(self.read().where(kept))
        self._commit(number, {"kind": "base", "folder": folder})


def append_point(curve: DocumentStore, points: DataFrame) -> None:
    """Equity points by their date: one that is there is replaced."""
    curve.put(points)


def targets(positions: DataFrame, signals: DataFrame, equity: float) -> DataFrame:
    """(symbol, side, shares) of the open ``positions(symbol, status)``: equal parts of the equity among those with a signal, in whole shares.

    ``signals(symbol, position, close)`` are the latest; a symbol without one, or without a price, has no quote and leaves its part to the others.
    """
    quoted = positions.where("status = 'open'").select("symbol").join(signals.where("close > 0"), "symbol").where("position <> 0")
    size = F.broadcast(quoted.agg(F.count("*").alias("_n")))
    raw = F.lit(equity) / F.col("_n") * F.col("position") / F.col("close")
    shares = F.when(raw < 0, F.ceil(raw)).otherwise(F.floor(raw)).cast("long")
    return quoted.crossJoin(size).select("symbol", F.when(shares > 0, "buy").when(shares < 0, "sell").otherwise("flat").alias("side"), shares.alias("shares"))


def closes(bars: DataFrame, symbol: str | None = None) -> DataFrame:
    """(symbol, ts, close) of bars that have a close, in order; of one symbol or of all."""
    own = bars if symbol is None else bars.where(F.col("symbol") == symbol)
    return own.where("close IS NOT NULL").select("symbol", "ts", "close").orderBy("symbol", "ts")
